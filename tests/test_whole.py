"""Nothing is cut: every copy and every text counts."""

from textkraal.plans import checked, corpus


def test_copies_have_their_near_links(spark, tmp_path):
    text = "umphepheli wathenga iinduku emihadini kakhulu ngomso kwakhona nasemva koko ngenye imini"
    rows = [(1, text), (2, text), (3, text), (4, text + "!"), (5, text + "!"), (6, "into eyahlukileyo ngokupheleleyo"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in checked.QUERIES["j6_near_classes"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 4), (5, 4, 4), (6, 6, 0)}


def test_digest_tells_every_text_and_copy(spark, tmp_path):
    rows = [(f"r{i}", f"text {i}") for i in range(5000)]
    cases = {"a": rows, "same": rows[::-1], "changed": [*rows[1:], ("r0", "other")], "removed": rows[1:], "repeated": [*rows, rows[0]], "swapped": [("r1", "text 0"), ("r0", "text 1"), *rows[2:]]}
    spark.createDataFrame([(k, *r) for k, x in cases.items() for r in x], "source string, record_id string, text string").write.parquet(f"{tmp_path}/corpus_records.parquet")
    got = {r.source: (r.records, r.digest) for r in corpus.QUERIES["k8_corpus_digest"](spark, str(tmp_path)).collect()}
    assert got["a"] == got["same"] and len({x for _, x in got.values()}) == 5 and got["repeated"][0] == 5001
    texts = {r.source: r.digest for r in corpus.corpus_hash(spark, str(tmp_path)).collect()}  # of texts alone, so a swap of ids is none
    assert texts["a"] == texts["same"] == texts["swapped"] and len(set(texts.values())) == 4
