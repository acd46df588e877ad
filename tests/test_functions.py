"""Hand-checked cases of the text functions, nulls and empty texts among them."""

import pytest
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal import session
from textkraal.functions import language as fl
from textkraal.functions.normalize import pieces
from textkraal.operators import near
from textkraal.operators import tokenizer as tz
from textkraal.operators import tokens as tk
from textkraal.operators import validation as va
from textkraal.operators.components import connected_components
from textkraal.operators.records import bounded_sample, first_of_each, hashed_split, upper_median, with_positions
from textkraal.operators.similarity import containing, set_similarity
from textkraal.plans import scalars


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("Izwe lakithi kodwa emva", "TARGET_LANGUAGE"), ("the and of Molo", "FOREIGN_LANGUAGE"), ("the and kodwa umntu isizwe", "MIXED_LANGUAGE"),
        ("the izwe umntu incwadi indlela", "UNCERTAIN"), ("Molo unjani", "UNCERTAIN"), ("", "UNCERTAIN"), (None, "UNCERTAIN"),
    ],
)
def test_language_v1(spark, text, want):
    assert one(spark, fl.language_v1, text) == want


def test_language_v2_differs(spark):
    assert one(spark, fl.language_v2, "the izwe imali incwadi indlela") == "MIXED_LANGUAGE"
    # umntu is a listed phrase whatever its case, so this one is not mixed
    assert one(spark, fl.language_v2, "the izwe umntu incwadi indlela") == "TARGET_LANGUAGE"


def test_spelling(spark):
    assert one(spark, fl.spelling_v1, "6aza ke") == "modern" and one(spark, fl.spelling_v2, "6aza ke") == "mixed"
    assert one(spark, fl.spelling_v2, "6a 6a 6a") == "traditional"
    assert one(spark, fl.modern_spelling, "1936") == "193bh"


def test_repetitive(spark):
    assert one(spark, fl.repetitive, "bemihla ngemihla bemihla ngemihla bemihla ngemihla") is True
    assert one(spark, fl.repetitive, "a b c d e f g h") is False
    assert one(spark, fl.repetitive, None) is False and one(spark, fl.repetitive, "") is False


def test_headers(spark):
    for line, want in (("12", True), ("ISAHLUKO IV", True), ("", True), ("Abantu bonke baya", True), ("Umntu omkhulu uhamba", False)):
        assert one(spark, fl.is_header, line) is want, line
    assert one(spark, lambda c: fl.is_header(c, strict=False), "Abantu bonke baya") is False


def test_pieces(spark):
    assert one(spark, lambda c: F.size(pieces(c)), "") == 0
    assert one(spark, lambda c: F.size(pieces(c)), " \n a\tb ") == 2
    assert one(spark, lambda c: F.size(pieces(c)), "a b c") == 3


def test_words(spark):
    assert one(spark, lambda c: fl.found(c, fl.WORD), "x² ²a Ⅷa é a") == ["x²", "²a", "Ⅷa", "e", "a"]


def test_offsets_are_lossless(spark):
    text = "Qaphelisisa  upelo lwakho, xyzqwerty.\n"
    rows = tk.offset_tokens(spark.createDataFrame([("r", text), ("e", ""), ("n", None)], "record_id string, text string")).orderBy("n").collect()
    assert "".join(r.surface for r in rows) == text
    assert all(text[r.start : r.end] == r.surface for r in rows)


@pytest.mark.parametrize(
    "word,want",
    [
        ("umntu", ("noun", "um", "ntu", "NC_001")), ("abantu", ("noun", "aba", "ntu", "NC_001")), ("imithetho", ("noun", "imi", "thetho", "NC_003")),
        ("amaXhosa", ("noun", "ama", "xhosa", "NC_005")), ("xyzqwerty99", ("unknown", None, None, None)), ("is", ("unknown", None, None, None)),
        ("under", ("noun", "u", "nder", "NC_009")), ("abuyele", ("verb_pattern", "abuye", "a-buye", None)), ("afana", ("verb_pattern", "afana", "a-f-ana", None)), ("ba-thetha", ("verb", "ba-", "thetha", "AGR_SUBJ_NC2")),
    ],
)
def test_analysis(spark, word, want):
    assert tuple(one(spark, tk.analysis, word)) == want


def test_overlay(spark):
    assert tuple(one(spark, va.strip_overlay, "Isigama: Noun - igama elichaza into")) == ("igama elichaza into", "Isigama: Noun")
    assert tuple(one(spark, va.strip_overlay, "")) == ("", "")


def test_pre_tokens_join_to_the_text(spark):
    assert one(spark, tz.pre_tokens, "a  b\n c") == ["a", "  ", "b", "\n ", "c"]


def test_merging():
    assert tz.split_word("aab", {("a", "b"): 0}) == ["a", "ab"]


def test_tokenizer_round_trip(spark):
    rows = [(1, "Igama  lam nguMzi."), (2, "Umntu\nngumntu ngabantu."), (3, "Ndithi 'molo' kuye."), (4, "")]
    t = spark.createDataFrame(rows, "id int, text string")
    m = tz.train(spark, tz.word_table(t), merges=10)
    back = {r.id: r.text for r in tz.decode(tz.encode(t, m, "id"), "id").collect()}
    assert back == {i: x for i, x in rows if x}
    assert m.collect() == tz.train(spark, tz.word_table(t.repartition(3)), merges=10).collect()


def test_training_by_passes_gives_the_same_rules(spark):
    words = spark.createDataFrame([("aaaa", 5), ("abab", 4), ("babab", 3), ("x", 9), ("ccab", 2), ("", 1)], "word string, n long")
    a = [tuple(r) for r in tz.train(spark, words, merges=12).collect()]
    assert a == [tuple(r) for r in tz.train(spark, words, merges=12, driver_words=0).collect()] and len(a) > 5
    assert tz.train(spark, words.limit(0)).count() == 0


def test_ids(spark):
    v = spark.createDataFrame([("<unk>", 1), ("ab", 7), ("c", 8)], "token string, id long")
    e = spark.createDataFrame([(1, ["ab", "c", "zz"]), (2, []), (3, None)], "k int, tokens array<string>")
    assert {r.k: r.ids for r in tz.with_ids(e, v).collect()} == {1: [7, 8, 1], 2: [], 3: None}


def test_positions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k", "'x' as at2").repartition(6)
    assert {r.k: r.at for r in with_positions(df, ["k"]).collect()} == {i: i for i in range(1000)}
    assert with_positions(df.limit(0), ["k"]).count() == 0


def test_segments(spark, tmp_path):
    body = "Umfazi uhamba ngendlela ende"  # a line that no header rule knows
    lines = ["1936", body, "Ubomi bu", body + " b", "ib1", "q2w", body + " c", "ISAHLUKO IV", "k7z", "Umfula omkhulu uyagobhoza"]
    spark.createDataFrame([("r", "\n".join(lines)), ("e", ""), ("n", None)], "record_id string, text string").write.parquet(f"{tmp_path}/corpus_records.parquet")
    got = [r.segment for r in scalars.QUERIES["t11_segments"](spark, str(tmp_path)).orderBy("seg").collect()]
    # short lines inside are dropped; one of up to three characters ends a segment, the next such line opens one
    assert got == [f"{body}\n{body} b", f"q2w\n{body} c", "k7z\nUmfula omkhulu uyagobhoza"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ityala lamawele", ("Ityala Lamawele", "Novel", "novel_excerpt")), ("u-don jadu", ("U-Don Jadu", "Novel", "novel_excerpt")), ("apha u-don jadu", ("U-Don Jadu", "Novel", "novel_excerpt")),
        ("apha udon jadu", ("Unknown Mqhayi", "Unclassified", "unclassified")), ("usamson", ("Unknown Mqhayi", "Unclassified", "unclassified")), ("Umntu", ("General Mqhayi", "Cultural Term", "cultural_content")),
        ("", ("Unknown Mqhayi", "Unclassified", "unclassified")), (None, ("Unknown Mqhayi", "Unclassified", "unclassified")),
    ],
)
def test_sections(spark, text, want):
    assert tuple(one(spark, lambda c: fl.section(c, lx.LITERARY_SECTIONS, lx.NO_SECTION["literary"], lx.NO_SECTION["untitled"]), text)) == want


def test_no_cluster_without_a_shared_folder():
    class Context:
        applicationId, master = "other", "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["x"] == got["y"] == "x" and got["z"] == "z" and "q" not in got
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_hashed_split_covers_and_is_stable(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    a = {r.k: r.new_split for r in hashed_split(df, "k", {"train": 0.8, "validation": 0.15, "test": 0.05}).collect()}
    sizes = {s: list(a.values()).count(s) for s in ("train", "validation", "test")}
    assert sizes == {"train": 80, "validation": 15, "test": 6}
    assert a == {r.k: r.new_split for r in hashed_split(df.repartition(7), "k", {"train": 0.8, "validation": 0.15, "test": 0.05}).collect()}


def test_first_of_each_and_median(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 3, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_of_each(df, "k", ["o"]).collect()} == {("a", "y"), (None, "z")}
    assert upper_median(spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int"), "n").first()["median"] == 3


def test_bounded_sample(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    a = [r.k for r in bounded_sample(df, ["k"], 300).collect()]
    assert len(set(a)) == 300 and a == [r.k for r in bounded_sample(df.repartition(5), ["k"], 300).collect()]
    assert a == [r.k for r in df.orderBy(F.xxhash64("k"), "k").limit(300).collect()]
    assert bounded_sample(df.limit(7), ["k"], 300).count() == 7 and bounded_sample(df.limit(0), ["k"], 3).count() == 0


def test_first_k_under_skew(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, concat('k', id), 'hot') as key", "id")
    got = tk.first_k(df, "key", ["id"], 3).where("key = 'hot'").orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 4] and [r["rank"] for r in got] == [1, 2, 3]


def test_set_similarity_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    sets = {i: sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 9))}) for i in range(40)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "a int, items array<string>")
    for t in (0.5, 0.8):
        want = {(i, j) for i in sets for j in sets if sets[i] and sets[j] and len({*sets[i]} & {*sets[j]}) >= t * len({*sets[i]} | {*sets[j]}) - 1e-12}
        got = {(r.a, r.b) for r in set_similarity(df, df.withColumnRenamed("a", "b"), t, strict=False).collect()}
        assert got == want


def test_near_pairs_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abdeghiklmnost") for _ in range(rnd.randint(4, 8)))
    base = [[word() for _ in range(rnd.choice([1, 6, 20, 60]))] for _ in range(30)]
    texts = []
    for w in base:
        for k in range(4):
            v = list(w)
            if k:
                v[rnd.randrange(len(v))] = word()
            texts.append(" ".join(v))
    texts += ["", "abc", "abcd" * 50, "abcd" * 50, None]
    df = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "k long, norm string, other boolean")
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in enumerate(texts) if t and len(t) >= 5}
    share = {(i, j): len(x & y) / len(x | y) for i, x in sets.items() for j, y in sets.items()}
    for t in (0.8, 0.9):
        got = {(r.a, r.b): r.jaccard for r in near.near_pairs(df, t, bands=24, width=5).collect()}
        want = {p: v for p, v in share.items() if p[0] < p[1] and v > t}
        assert got == want and want
        got = {(r.a, r.b) for r in near.near_pairs(df, t, cross="other", bands=24, width=5, strict=False).collect()}
        assert got == {p for p, v in share.items() if p[0] % 3 and p[1] % 3 == 0 and v >= t}
    assert near.near_pairs(df.limit(0), 0.9).count() == 0


def test_hot_terms_are_split(spark, monkeypatch):
    monkeypatch.setattr(near, "HOT", 50)
    family = "umphepheli wathenga iinduku emihadini kakhulu ngomso kwakhona nasemva koko"
    df = spark.createDataFrame([(i, family + f" {i:02}", i % 2 == 0) for i in range(40)], "k long, norm string, other boolean")
    assert near.near_pairs(df, 0.8).count() == 40 * 39 // 2
    assert near.near_pairs(df, 0.8, cross="other").count() == 400


def test_containing(spark):
    t = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "zzz"), (3, None)], "key int, text string")
    p = spark.createDataFrame([(1, "defghijklmnopqr"), (2, "defghijklmnopqq"), (3, "abc"), (4, ""), (5, None), (6, "zz")], "part_key int, part string")
    assert sorted(tuple(r) for r in containing(t, p).collect()) == [(1, 1), (1, 3), (2, 6)]
