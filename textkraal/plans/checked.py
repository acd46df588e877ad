"""Queries of validation, similarity, the tokenizer, scorers and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions.language import found, old_letters
from textkraal.functions.normalize import pieces
from textkraal.operators import near
from textkraal.operators import similarity as sim
from textkraal.operators import tokenizer as tz
from textkraal.operators import validation as va
from textkraal.operators.records import with_positions
from textkraal.plans.scalars import OLD, PIECES, WS
from textkraal.session import load, materialize, shared_dir
from textkraal.sources import readers


def rec(s, d):
    return load(s, d, "corpus_records")


def reference(s, d):
    return rec(s, d).where("validation_status = 'authoritative'").select("record_id", "text")


def candidates(s, d):
    return rec(s, d).where("validation_status in ('unvalidated', 'uncertain', 'candidate')").select("record_id", "text", "source", "orthography")


def vocabulary_coverage(s, d):
    c = candidates(s, d).select("record_id", "text").distinct()
    return va.coverage(c, va.reference_vocabulary(reference(s, d))).drop("uncovered")


def covered_words(s, d):
    w = candidates(s, d).select(F.explode(pieces(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.join(va.reference_vocabulary(reference(s, d)), "word", "left_semi")


def uncovered_words(s, d):
    """The first five words of each candidate that the reference lacks."""
    c = candidates(s, d).select("record_id", "text").distinct().select("record_id", F.posexplode(pieces(F.lower("text"))).alias("pos", "word"))
    u = c.join(va.reference_vocabulary(reference(s, d)), "word", "left_anti")
    w = Window.partitionBy("record_id").orderBy("pos")  # the words of one text
    return u.withColumn("k", F.row_number().over(w)).where("k <= 5").select("record_id", "k", "word")


def english_contamination(s, d):
    e = va.english_words(F.col("text"))
    return rec(s, d).select("record_id", F.size(e).alias("n"), F.array_join(F.slice(e, 1, 5), " ").alias("words"))


def results(s, d):
    return va.validate(candidates(s, d), va.reference_vocabulary(reference(s, d)))


def validated(s, d):
    """The validation results of the candidates; of corrections, of which a result has one at most, the fields."""
    fix = F.get("corrections", F.lit(0))
    return results(s, d).select("*", *[fix[k].alias(f"correction_{k}") for k in ("original", "corrected", "reason")]).drop("corrections")


def routed_results(s, d):
    """The results written to a folder for each route and read again: validated records under their corrected text.

    A validated result with corrections goes to the corrections as well.
    """
    v = materialize(results(s, d), "results")
    path = f"{shared_dir(s)}/textkraal/routes-{uuid.uuid4().hex}"
    routes = F.array_compact(F.array("validation_status", F.when((F.col("validation_status") == "validated") & (F.size("corrections") > 0), "corrections")))
    v.select("record_id", "corrected_text", "language_class", "confidence", "reason", F.explode(routes).alias("route")).write.partitionBy("route").parquet(path)
    return s.read.parquet(path).select("route", "record_id", "corrected_text", "language_class", "confidence", "reason")


def validation_summary(s, d):
    """Rows per route of the pipeline; their sum is that of the candidates."""
    v = results(s, d)
    return v.groupBy("language_class", "validation_status", "confidence").agg(F.count("*").alias("rows"))


def overlay(s, d):
    x = rec(s, d).select("record_id", va.strip_overlay(F.col("text")).alias("o"))
    return x.select("record_id", "o.kept", "o.removed")


def word_kinds(s, d):
    w = rec(s, d).select(F.explode(pieces(F.col("text"))).alias("word")).distinct()
    return w.select("word", va.is_english_word(F.col("word")).alias("english"), va.is_target_word(F.col("word")).alias("target"))


def novel_items(s, d):
    """Evaluation items that are no document's text."""
    docs = load(s, d, "documents").select(F.trim("text").alias("text"))
    return load(s, d, "eval_items").select("item_id", F.trim("text").alias("text")).join(docs, "text", "left_anti").select("item_id")


def contamination(s, d):
    """Per suite the test items, those whose text is a document's, and the share of those that are not."""
    novel = novel_items(s, d).withColumn("novel", F.lit(1))
    g = load(s, d, "eval_items").select("item_id", "suite").join(novel, "item_id", "left").groupBy("suite").agg(F.count("*").alias("items"), F.count_if(F.col("novel").isNull()).alias("contaminated"))
    return g.withColumn("score", F.round(F.lit(1) - F.col("contaminated") / F.col("items"), 6))


def contained_items(s, d):
    """Documents that contain an evaluation item of over 20 characters word for word."""
    t = load(s, d, "documents").select(F.col("doc_id").alias("key"), "text")
    p = load(s, d, "eval_items").where("length(text) > 20").select(F.col("item_id").alias("part_key"), F.col("text").alias("part"))
    return sim.containing(t, p).select(F.col("key").alias("doc_id"), F.col("part_key").alias("item_id"))


def _spaced(c):
    """Lower case, white space as single spaces, trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def near_documents(s, d):
    """Pairs of documents of different texts with over 0.9 of their 5-character pieces in common.

    One document, that of the smallest id, stands for each distinct text; near_classes() has the others.
    """
    x = load(s, d, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("k"))
    return near.near_pairs(x.select("k", _spaced(F.col("text")).alias("norm")), 0.9).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_classes(s, d):
    """(doc_id, class_id, links) of every document with a text: documents of one text are a class, named by its
    smallest id as in near_documents(); links counts the other documents of the same or of a near text."""
    x = load(s, d, "documents").where("text is not null and doc_id is not null").select("doc_id", F.sha2("text", 256).alias("h")).distinct()
    size = materialize(x.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    p = materialize(near_documents(s, d).select("a", "b"), "near")
    ends = p.union(p.select("b", "a")).toDF("class_id", "other")
    others = ends.join(size.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("near"))
    c = size.join(others, "class_id", "left").select("h", "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return x.join(c, "h").select("doc_id", "class_id", "links")


def best_match(s, d):
    """For each evaluation item the document with most words in common, if over 0.8 of both."""
    a = load(s, d, "eval_items").select(F.col("item_id").alias("a"), va_words(F.col("text")).alias("items"))
    b = load(s, d, "documents").select(F.col("doc_id").alias("b"), va_words(F.col("text")).alias("items"))
    p = sim.set_similarity(a, b, 0.8)
    g = p.groupBy("a").agg(F.max(F.struct(F.round("jaccard", 6).alias("jaccard"), (-F.col("b")).alias("b"))).alias("m"))
    return g.select(F.col("a").alias("item_id"), (-F.col("m.b")).alias("doc_id"), F.col("m.jaccard").alias("jaccard"))


def va_words(c):
    return sim.word_set(c)


def memorization(s, d):
    """Items found exactly, and nearly, among the documents."""
    items = load(s, d, "eval_items").agg(F.count("*").alias("items"))
    near = best_match(s, d).agg(F.count("*").alias("near"))
    novel = novel_items(s, d).agg(F.count("*").alias("novel"))
    return items.crossJoin(F.broadcast(near)).crossJoin(F.broadcast(novel)).select("items", (F.col("items") - F.col("novel")).alias("exact"), "near")


def split_leakage(s, d):
    """Pairs of different texts of two splits with over 0.9 of their 5-character pieces in common, and the nearest."""
    r = rec(s, d).where("split is not null and length(text) >= 30").select("split", "text").distinct()
    g = materialize(r.select("split", F.xxhash64("split", "text").alias("k"), _spaced(F.col("text")).alias("norm")), "splits")
    out = None
    for x, y in (("train", "validation"), ("train", "test"), ("validation", "test")):
        p = near.near_pairs(g.where(F.col("split").isin(x, y)).withColumn("second", F.col("split") == y), 0.9, cross="second")
        p = p.agg(F.count("*").alias("pairs"), F.round(F.max("jaccard"), 6).alias("nearest"))
        p = p.select(F.lit(f"{x}-{y}").alias("splits"), "pairs", "nearest")
        out = p if out is None else out.union(p)
    return out


def cooccurring(s, d):
    """Pairs of subjects of the same labelled document; a document has at most nine."""
    t = load(s, d, "subject_labels").dropna().distinct()
    a, b = t.withColumnRenamed("subject", "p1"), t.withColumnRenamed("subject", "p2")
    return a.join(b, "doc_id").where("p1 < p2").groupBy("p1", "p2").agg(F.count("*").alias("n"))


def linked_observations(s, d):
    """Evidence items whose surface form starts with a noun prefix, linked to that prefix's observation."""
    from textkraal.functions.language import first_prefix

    e = load(s, d, "evidence_items").select("surface_form").distinct().withColumn("p", first_prefix(F.lower("surface_form"), lx.PREFIXES)).where("p is not null")
    return e.select("surface_form", F.concat(F.lit("NC_PREFIX_"), F.upper("p")).alias("observation_id"))


def entry_status(s, d):
    """Entries by surface form: SUPPORTED with two examples and five occurrences, UNDER_REVIEW with one, else OBSERVED."""
    e = load(s, d, "evidence_items").groupBy(F.lower("surface_form").alias("form")).agg(F.countDistinct("record_id").alias("examples"))
    n = rec(s, d).where("language_class = 'TARGET_LANGUAGE'").select(F.explode(found(F.lower("text"), "[a-z]+")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    j = e.join(n, "form", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("form", "examples", "n", F.when((F.col("examples") >= 2) & (F.col("n") >= 5), "SUPPORTED").when(F.col("examples") >= 1, "UNDER_REVIEW").otherwise("OBSERVED").alias("status"))


def manifest(s, d):
    """One row of counts that describes the corpus."""
    r = rec(s, d).agg(F.count("*").alias("records"), F.countDistinct("source").alias("sources"), F.count_if(F.col("language_class") == "TARGET_LANGUAGE").alias("analysed"))
    counts = [load(s, d, t).agg(F.count("*").alias(n)) for t, n in (("evidence_items", "evidence"), ("validation_results", "results"))]
    return r.crossJoin(F.broadcast(counts[0])).crossJoin(F.broadcast(counts[1]))


def report_json(s, d):
    """The manifest as one JSON line."""
    m = manifest(s, d)
    return m.select(F.to_json(F.struct(*sorted(m.columns))).alias("report"))


# --- tokenizer


def merges(s, d):
    return load(s, d, "bpe_merges").select(F.col("merge_rank").alias("rank"), F.col("left_piece").alias("left"), F.col("right_piece").alias("right"))


def texts(s, d):
    """The distinct records that have a text."""
    return rec(s, d).where("record_id is not null and text is not null").select("record_id", "text").distinct()


def encoded(s, d):
    return tz.encode(texts(s, d), merges(s, d), "record_id")


def vocabulary(s, d):
    """(token, id): the special tokens, then all characters of the corpus in order, then the merged tokens by rank."""
    chars = rec(s, d).select(F.explode(F.array_distinct(F.split("text", ""))).alias("token")).where("token <> ''").distinct()
    merged = merges(s, d).select(F.concat("left", "right").alias("token"), "rank").groupBy("token").agg(F.min("rank").alias("rank"))
    base = with_positions(chars, ["token"]).select("token", (F.col("at") + len(tz.SPECIAL)).alias("id"))
    n = base.agg((F.count("*") + len(tz.SPECIAL)).alias("n"))
    more = with_positions(merged.join(chars, "token", "left_anti"), ["rank"]).crossJoin(F.broadcast(n)).select("token", (F.col("at") + F.col("n")).alias("id"))
    special = s.createDataFrame([(t, i) for i, t in enumerate(tz.SPECIAL)], "token string, id long")
    return special.union(base).union(more)


def tokenizer_metrics(s, d):
    """Tokens per word, characters per token, fragmentation, coverage, and texts that decode to themselves.

    fragmentation: the share of distinct words of more than one token; coverage: occurrences of the words that are one token,
    per distinct word, so it can exceed 1.
    """
    e = materialize(encoded(s, d), "encoded")
    back = tz.decode(e, "record_id").join(texts(s, d).withColumnRenamed("text", "original"), "record_id")
    n = e.agg(F.sum(F.size("tokens")).alias("tokens"))
    w = texts(s, d).agg(F.sum(F.size(pieces(F.col("text")))).alias("words"), F.sum(F.length("text")).alias("chars"))
    rt = back.agg(F.count("*").alias("texts"), F.count_if(F.col("text") == F.col("original")).alias("round_trips"))
    t = tz.word_table(texts(s, d))
    t = t.join(tz.encode_words(t, merges(s, d)), "word").agg(
        F.round(F.avg((F.size("tokens") > 1).cast("int")), 6).alias("fragmentation"), F.round(F.sum(F.when(F.size("tokens") == 1, F.col("n")).otherwise(0)) / F.count("*"), 6).alias("coverage")
    )
    out = n.crossJoin(F.broadcast(w)).crossJoin(F.broadcast(rt)).crossJoin(F.broadcast(t))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6).alias(f"{a}_per_{b[:-1]}")
    return out.select("tokens", "words", "chars", "texts", "round_trips", "fragmentation", "coverage", ratio("tokens", "words"), ratio("chars", "tokens"))


def trained(s, d):
    return tz.train(s, tz.word_table(rec(s, d).where("language_class = 'TARGET_LANGUAGE'")))


def vocabulary_sweep(s, d):
    """Tokens per word of the corpus under merge lists of several sizes, and which one is chosen: that of the fewest tokens
    per word, of equals the smallest. Each distinct word is encoded once per list."""
    m = materialize(trained(s, d), "merges")
    w = materialize(tz.word_table(texts(s, d)), "words")
    out = None
    for k in (50, 100, 200):
        e = tz.encode_words(w, m.where(F.col("rank") < k)).join(w, "word").agg(F.sum(F.size("tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("words"))
        e = e.select(F.lit(k).alias("merges"), "tokens", "words", F.round(F.try_divide(F.col("tokens"), F.col("words")), 6).alias("tokens_per_word"))
        out = e if out is None else out.union(e)
    best = Window.orderBy("tokens_per_word", "merges")  # a row for each list
    return out.withColumn("chosen", F.row_number().over(best) == 1)


def batches(s, d, size=32):
    """Encoded texts in batches by id, padded to the batch's longest: the places, those attended to, and those whose label
    counts; padding has the label -100."""
    e = with_positions(encoded(s, d), ["record_id"]).withColumn("batch", F.floor(F.col("at") / size))
    n = F.max(F.size("tokens")).over(Window.partitionBy("batch")) + 2  # the texts of one batch
    t, mask = tz.padded(F.col("tokens"), F.col("length"))
    labels = F.zip_with(t, mask, lambda x, m: F.when(m == 1, x).otherwise("-100"))
    return e.withColumn("length", n).select(
        "record_id", "batch", "length", F.size(t).alias("padded"), F.aggregate(mask, F.lit(0), lambda a, b: a + b).alias("attended"), F.size(F.filter(labels, lambda x: x != "-100")).alias("labelled")
    )


# --- scorers of given texts


def scores(s, d):
    """Points of each text by plain rules: no English word, expected words, length, letters, repetition, diversity."""
    w = found(F.lower("text"), "[a-z]+")
    x = rec(s, d).select("record_id", "text", w.alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    distinct = F.size(F.array_distinct("w")) / n
    expected = lambda words: sum((F.contains(F.lower("text"), F.lit(v)).cast("int") for v in words), F.lit(0))
    return x.select(
        "record_id", (~F.exists("w", lambda v: v.isin(lx.ENGLISH_V1))).alias("no_english"), (expected(["umntu", "abantu", "indlela", "umthetho"]) >= 2).alias("expected_words"),
        F.round(1 - distinct, 6).alias("repetition"), F.round(F.least(F.lit(1.0), F.size("w") / 20), 6).alias("coherence"),
        F.round(0.3 * F.least(F.lit(1.0), F.size("w") / 20) + 0.4 * distinct + 0.3 * F.when(F.size("w") >= 5, 1.0).otherwise(0.5), 6).alias("blend"),
    )


def rubric(s, d):
    """Additive points: at least three words, a sentence end, only usual characters, no old letters."""
    t = F.col("text")
    pts = lambda c, k: F.when(c, k).otherwise(0)
    total = pts(F.size(pieces(t)) >= 3, 25) + pts(t.rlike(r"[.!?]\s*$"), 25) + pts(t.rlike(r"^[a-zA-Z0-9\s.,;:!?'\-]*$"), 25) + pts(old_letters(t) == 0, 25)
    return rec(s, d).select("record_id", total.alias("points"))


def quality(s, d):
    """Distinct texts per source; a source with two or more scores 100, else 0."""
    g = rec(s, d).groupBy("source").agg(F.countDistinct("text").alias("texts"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))
    return g.withColumn("score", F.when(F.col("texts") >= 2, 100).otherwise(0))


# fixed values: lines as a training run writes them
LOG = [
    "  Ep 1/20  step 50  loss 6.6601  avg 7.2597  lr 1.50e-04", "[epoch 1/20]  val_loss=5.3607  ppl=212.8", "noise",
    "  Ep 2/20  step 100  loss 5.1  avg 5.9  lr 1.40e-04", "[epoch 2/20]  val_loss=4.7701  ppl=117.93",
]


def log_rows(s, d):
    """A training log, written as text and parsed."""
    path = f"{shared_dir(s)}/textkraal/log-{uuid.uuid4().hex}"
    s.createDataFrame([(x,) for x in LOG], "value string").coalesce(1).write.text(path)
    return readers.training_log(readers.text_lines(s, path))


QUERIES = {
    "j2_covered_words": covered_words, "j3_uncovered_words": uncovered_words, "g27_coverage": vocabulary_coverage, "g28_english_words": english_contamination, "v1_validated": validated, "k5_routed_results": routed_results,
    "v2_pipeline_summary": validation_summary, "t5_overlay": overlay, "t6_t7_word_kinds": word_kinds, "t21_target_part": lambda s, d: rec(s, d).select("record_id", va.target_part(F.col("text")).alias("part")),
    "j4_novel_items": novel_items, "n8_contamination": contamination, "j5_contained_items": contained_items, "j6_near_documents": near_documents, "j6_near_classes": near_classes, "j7_best_match": best_match, "n13_memorization": memorization,
    "d9_split_leakage": split_leakage, "j9_cooccurrence": cooccurring, "j11_linked_observations": linked_observations, "q1_entry_status": entry_status, "q8_manifest": manifest, "k2_report": report_json,
    "b1_pre_tokens": lambda s, d: texts(s, d).select("record_id", F.array_join(tz.pre_tokens(F.col("text")), "␟").alias("pieces")),
    "b2_word_table": lambda s, d: tz.word_table(rec(s, d)), "b3_base_vocabulary": vocabulary,
    "b4_train": trained, "b6_encoded": lambda s, d: encoded(s, d).select("record_id", F.size("tokens").alias("n"), F.array_join("tokens", "␟").alias("tokens")),
    "b7_decoded": lambda s, d: tz.decode(encoded(s, d), "record_id"), "b9_metrics": tokenizer_metrics, "b10_sweep": vocabulary_sweep, "b12_batches": batches,
    "n5_n12_scores": scores, "n7_quality": quality, "n9_rubric": rubric, "n10_round_trip": lambda s, d: tz.decode(encoded(s, d), "record_id").join(texts(s, d).withColumnRenamed("text", "original"), "record_id").select("record_id", (F.col("text") == F.col("original")).alias("same")),
    "r1_training_log": log_rows,
}

_EN = ", ".join(f"'{w}'" for w in lx.ENGLISH_V1)
_XH = ", ".join(f"'{w}'" for w in lx.XHOSA_V1)
_ENO, _XHO = (", ".join(f"'{w}'" for w in x) for x in (lx.ENGLISH_OVERLAY, lx.XHOSA_OVERLAY))
_LP = PIECES.replace("(text", "(lower(text)")
_VOC = f"(SELECT DISTINCT unnest({_LP}) AS word FROM corpus_records WHERE validation_status = 'authoritative' UNION SELECT unnest({lx.KNOWN_WORDS}))"
_CAND = "(SELECT DISTINCT record_id, text, source, orthography FROM corpus_records WHERE validation_status IN ('unvalidated', 'uncertain', 'candidate'))"


def _v1(p: str) -> str:
    w = rf"regexp_extract_all(lower({p}), '[a-zA-Z\x{{c0}}-\x{{17f}}]+')"
    e = f"(len(list_filter({w}, lambda q: q IN ({_EN}))) / greatest(len({w}), 1))"
    x = f"(len(list_filter({w}, lambda q: q IN ({_XH}))) / greatest(len({w}), 1))"
    return f"CASE WHEN len({w}) < 3 THEN 'UNCERTAIN' WHEN {e} > 0.3 AND {x} < 0.1 THEN 'FOREIGN_LANGUAGE' WHEN {e} > 0.15 AND {x} > 0.05 THEN 'MIXED_LANGUAGE' WHEN {x} > 0.05 OR {e} < 0.15 THEN 'TARGET_LANGUAGE' ELSE 'UNCERTAIN' END"


_PART = f"""CASE WHEN regexp_matches(text, '^(.+?):{WS}*(.+?){WS}*-{WS}*(.+)$') THEN trim(regexp_extract(text, '^(.+?):{WS}*(.+?){WS}*-{WS}*(.+)$', 3)) ELSE
  nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '{WS}*,{WS}*|{WS}*;{WS}*'), lambda p: CASE {_v1('p')} WHEN 'TARGET_LANGUAGE' THEN p WHEN 'MIXED_LANGUAGE' THEN
  array_to_string(list_filter(list_filter(regexp_split_to_array(p, '{WS}+'), lambda r: r <> ''), lambda r: lower(r) NOT IN ({_EN})), ' ') END), lambda y: y IS NOT NULL AND y <> ''), ' '), '') END"""
_COV = f"(SELECT record_id, sum(CASE WHEN word IN (SELECT word FROM {_VOC}) THEN 1 ELSE 0 END)::BIGINT AS covered, count(*) AS total FROM (SELECT record_id, unnest({_LP}) AS word FROM (SELECT DISTINCT record_id, text FROM {_CAND})) GROUP BY record_id)"
_VAL = f"""WITH x AS (SELECT c.*, {_v1('text')} AS lang, covered, total::BIGINT AS total, coalesce(covered, 0) / greatest(coalesce(total, 0), 1) AS share, len(list_filter({_LP}, lambda r: r IN ({_EN}))) > 0 AS english,
   {_PART} AS part, ({OLD}) > 0 AS old, replace(replace(text, '6', 'bh'), '5', 'hl') AS modern FROM {_CAND} c LEFT JOIN {_COV} USING (record_id)),
 y AS (SELECT *, CASE WHEN lang = 'FOREIGN_LANGUAGE' THEN 1 WHEN lang = 'UNCERTAIN' THEN 2 WHEN lang = 'MIXED_LANGUAGE' AND english AND coalesce(length(part) > length(text) * 0.5, false) THEN 3
   WHEN lang = 'MIXED_LANGUAGE' AND english THEN 4 WHEN old AND (coalesce(source, '') = 'ingqokelela_yembongi' OR contains(lower(modern), 'bhala') OR contains(lower(modern), 'bhalwe')) THEN 5 WHEN old THEN 6
   WHEN lang = 'TARGET_LANGUAGE' AND share >= 0.7 THEN 7 WHEN lang = 'TARGET_LANGUAGE' AND share >= 0.5 THEN 8 WHEN lang = 'TARGET_LANGUAGE' AND share >= 0.3 THEN 9 WHEN lang = 'TARGET_LANGUAGE' THEN 10 ELSE 11 END AS k FROM x),
 u AS (SELECT record_id, list(word ORDER BY pos)[1:5] AS uncovered FROM (SELECT record_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT record_id, {PIECES} AS w FROM (SELECT DISTINCT record_id, text FROM {_CAND})))
   WHERE lower(word) NOT IN (SELECT word FROM {_VOC}) GROUP BY 1),
 o AS (SELECT y.*, u.uncovered, round_even(share * 100, 0)::INT AS pct, list_filter({PIECES}, lambda r: lower(r) IN ({_EN})) AS en FROM y LEFT JOIN u USING (record_id)),
 v AS (SELECT record_id, text AS original_text, CASE k WHEN 3 THEN part WHEN 5 THEN modern ELSE text END AS corrected_text, lang AS language_class,
   {[v[0] for v in va.OUTCOMES.values()]}[k] AS validation_status, {[v[1] for v in va.OUTCOMES.values()]}[k] AS confidence, {[v[2] for v in va.OUTCOMES.values()]}[k] AS reference_source, coalesce(orthography, 'unknown') AS orthography,
   CASE WHEN k = 1 THEN 'Text is classified as foreign language (English). Contains ' || len({PIECES}) || ' words with ' || len(en) || ' English indicators.'
     WHEN k = 2 THEN 'Insufficient evidence to classify language. No clear Xhosa or English indicators found.'
     WHEN k = 3 THEN 'Mixed-language record (pedagogical overlay). Extracted Xhosa portion (' || length(part) || ' chars from ' || length(text) || ').'
     WHEN k = 4 THEN 'Mixed-language content with ' || len(en) || ' English words: ' || array_to_string(en[1:5], ', ') || '...'
     WHEN k = 5 THEN 'Traditional orthography normalized (6→bh, 5→hl). Old orthography is authentic to Mqhayi''s era.' WHEN k = 6 THEN 'Contains traditional orthography characters that cannot be verified.'
     WHEN k IN (7, 8) THEN 'Target language text with ' || pct || '% reference vocabulary coverage (' || covered || '/' || total || ' words).' WHEN k = 9 THEN 'Moderate reference coverage (' || pct || '%). Needs manual review.'
     WHEN k = 10 THEN 'Low reference coverage (' || pct || '%). Uncovered words: ' || CASE WHEN len(uncovered) > 0 THEN '[' || chr(39) || array_to_string(uncovered, chr(39) || ', ' || chr(39)) || chr(39) || ']' ELSE '[]' END
     ELSE 'No authoritative evidence to validate or correct. Leaving as UNCERTAIN.' END AS reason,
   CASE WHEN k IN (3, 5) THEN text END AS correction_original, CASE k WHEN 3 THEN part WHEN 5 THEN modern END AS correction_corrected,
   CASE k WHEN 3 THEN 'Removed English translation overlay from pedagogical content' WHEN 5 THEN 'Traditional orthography normalization' END AS correction_reason FROM o)"""
_TEXTS = "(SELECT DISTINCT record_id, text FROM corpus_records WHERE record_id IS NOT NULL AND text IS NOT NULL)"
_PRE = r"regexp_extract_all(text, '(?s)[\p{L}\p{Nl}\p{No}\p{Nd}_]+|[^\p{L}\p{Nl}\p{No}\p{Nd}_\s]+|\s+')"
_NOVEL = "SELECT item_id FROM eval_items e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE trim(d.text) = trim(e.text))"
_WSET = "list_distinct(" + _LP + ")"
_BEST = f"""WITH a AS (SELECT item_id, len({_WSET}) AS n, unnest({_WSET}) AS w FROM eval_items), b AS (SELECT doc_id, len({_WSET}) AS m, unnest({_WSET}) AS w FROM documents),
 j AS (SELECT item_id, doc_id, count(*) / (any_value(n) + any_value(m) - count(*)) AS jac FROM a JOIN b USING (w) GROUP BY 1, 2 HAVING jac > 0.8)"""


def _near_sql(table: str, key: str, pairs: str, tail: str) -> str:
    t = r"trim(lower(regexp_replace(text, '\s+', ' ', 'g')))"
    return f"""WITH s AS ({table}), g AS (SELECT DISTINCT {key} AS id, unnest(list_transform(generate_series(1, length({t}) - 4), lambda i: substring({t}, i, 5))) AS g FROM s),
 n AS (SELECT id, count(*) AS n FROM g GROUP BY id), df AS (SELECT g, count(*) AS f FROM g GROUP BY g),
 r AS (SELECT g.id, g.g, n, row_number() OVER (PARTITION BY g.id ORDER BY f, g.g) AS pos FROM g JOIN df USING (g) JOIN n USING (id)),
 p AS (SELECT * FROM r WHERE pos <= n - ceil(n * 0.9 - 1e-9) + 1),
 c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (g) WHERE {pairs}),
 o AS (SELECT a, b, count(*) AS o FROM c JOIN g x ON x.id = a JOIN g y ON y.id = b AND y.g = x.g GROUP BY a, b),
 l AS (SELECT a, b, o / (x.n + y.n - o) AS jac FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE o / (x.n + y.n - o) > 0.9) {tail}"""


_SPLITS = _near_sql(
    "SELECT split, text, min(record_id) AS record_id FROM corpus_records WHERE split IS NOT NULL AND length(text) >= 30 GROUP BY 1, 2", "record_id || '@' || split",
    "split_part(a.id, '@', 2) || '-' || split_part(b.id, '@', 2) IN ('train-validation', 'train-test', 'validation-test')",
    ", z AS (SELECT split_part(a, '@', 2) || '-' || split_part(b, '@', 2) AS splits, jac FROM l) SELECT k AS splits, count(jac) AS pairs, round(max(jac), 6) AS nearest FROM (SELECT unnest(['train-validation', 'train-test', 'validation-test']) AS k) LEFT JOIN z ON splits = k GROUP BY k",
)
_STRIPW = r"""regexp_replace(lower(word), '^[''"\-.,;:!?]+|[''"\-.,;:!?]+$', '', 'g')"""

SQL = {
    "j2_covered_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_LP}) AS word FROM corpus_records WHERE validation_status IN ('unvalidated', 'uncertain', 'candidate')) WHERE word IN (SELECT word FROM {_VOC}) GROUP BY word",
    "j3_uncovered_words": f"WITH w AS (SELECT record_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT DISTINCT record_id, {_LP} AS w FROM {_CAND})) SELECT record_id, word, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS k FROM w WHERE word NOT IN (SELECT word FROM {_VOC}) QUALIFY k <= 5",
    "g27_coverage": f"SELECT record_id, covered, total::BIGINT AS total FROM {_COV}",
    "g28_english_words": f"SELECT record_id, len(e) AS n, array_to_string(list_slice(e, 1, 5), ' ') AS words FROM (SELECT record_id, list_filter({_LP}, lambda r: r IN ({_EN})) AS e FROM corpus_records)",
    "v1_validated": _VAL + " SELECT * FROM v",
    "k5_routed_results": _VAL + " SELECT unnest(CASE WHEN validation_status = 'validated' AND correction_reason IS NOT NULL THEN ['validated', 'corrections'] ELSE [validation_status] END) AS route, record_id, corrected_text, language_class, confidence, reason FROM v", "v2_pipeline_summary": _VAL + " SELECT language_class, validation_status, confidence, count(*) AS rows FROM v GROUP BY ALL",
    "t21_target_part": f"SELECT record_id, {_PART} AS part FROM corpus_records",
    "t6_t7_word_kinds": rf"""SELECT word, low <> '' AND (low IN ({_ENO}) OR (NOT regexp_matches(word, '[65''\-]') AND low NOT IN ({_XHO}) AND regexp_matches(low, '^[a-z]+$') AND length(low) > 3
      AND NOT regexp_matches(low, '^[uaio][befhiklmnoprstvwxyz]|\b(ng|cw|hl|kh|ph|th|xh)\w+') AND regexp_matches(low, '(tion|ity|ous|ing|ed|ly|er|al|ion|ness|ship|ment)$'))) AS english,
      low <> '' AND (regexp_matches(word, '[''65]') OR regexp_matches(low, '^([uaieo][mbnkgchtfdsjqxz]|ng|kw|swa|(ya|ye|yo)[mnkgchtfdsjqxzblrvw])') OR low IN ({_XHO})) AS target
      FROM (SELECT word, {_STRIPW} AS low FROM (SELECT DISTINCT unnest({PIECES}) AS word FROM corpus_records))""",
    "j4_novel_items": _NOVEL, "n8_contamination": f"SELECT suite, count(*) AS items, count(*) FILTER (item_id NOT IN ({_NOVEL})) AS contaminated, round(1 - count(*) FILTER (item_id NOT IN ({_NOVEL})) / count(*), 6) AS score FROM eval_items GROUP BY suite",
    "k2_report": """SELECT '{"analysed":' || count(*) FILTER (language_class = 'TARGET_LANGUAGE') || ',"evidence":' || (SELECT count(*) FROM evidence_items) || ',"records":' || count(*) || ',"results":' || (SELECT count(*) FROM validation_results)
      || ',"sources":' || count(DISTINCT source) || '}' AS report FROM corpus_records""",
    "j5_contained_items": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN eval_items e ON length(e.text) > 20 AND contains(d.text, e.text)",
    "j6_near_documents": _near_sql("SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text", "doc_id", "a.id < b.id", "SELECT a, b, round(jac, 6) AS jaccard FROM l"),
    "j7_best_match": _BEST + " SELECT item_id, doc_id, round(jac, 6) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(jac, 6) DESC, doc_id) = 1",
    "n13_memorization": _BEST + f" SELECT (SELECT count(*) FROM eval_items) AS items, (SELECT count(*) FROM eval_items) - (SELECT count(*) FROM ({_NOVEL})) AS exact, (SELECT count(DISTINCT item_id) FROM j) AS near",
    "d9_split_leakage": _SPLITS,
    "j9_cooccurrence": "WITH t AS (SELECT DISTINCT * FROM subject_labels WHERE doc_id IS NOT NULL AND subject IS NOT NULL) SELECT a.subject AS p1, b.subject AS p2, count(*) AS n FROM t a JOIN t b USING (doc_id) WHERE a.subject < b.subject GROUP BY 1, 2",
    "j11_linked_observations": "SELECT DISTINCT surface_form, 'NC_PREFIX_' || upper(p) AS observation_id FROM (SELECT surface_form, CASE " + " ".join(f"WHEN lower(surface_form) LIKE '{p}%' AND length(surface_form) > {len(p) + 1} THEN '{p}'" for p in lx.PREFIXES) + " END AS p FROM evidence_items) WHERE p IS NOT NULL",
    "q1_entry_status": "WITH e AS (SELECT lower(surface_form) AS form, count(DISTINCT record_id) AS examples FROM evidence_items GROUP BY 1), c AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM corpus_records WHERE language_class = 'TARGET_LANGUAGE') GROUP BY 1) SELECT form, examples, coalesce(c.n, 0) AS n, CASE WHEN examples >= 2 AND coalesce(c.n, 0) >= 5 THEN 'SUPPORTED' WHEN examples >= 1 THEN 'UNDER_REVIEW' ELSE 'OBSERVED' END AS status FROM e LEFT JOIN c USING (form)",
    "q8_manifest": "SELECT count(*) AS records, count(DISTINCT source) AS sources, count(*) FILTER (language_class = 'TARGET_LANGUAGE') AS analysed, (SELECT count(*) FROM evidence_items) AS evidence, (SELECT count(*) FROM validation_results) AS results FROM corpus_records",
    "b1_pre_tokens": f"SELECT record_id, array_to_string({_PRE}, chr(9247)) AS pieces FROM {_TEXTS}",
    "b2_word_table": rf"SELECT word, count(*) AS n FROM (SELECT unnest({_PRE}) AS word FROM corpus_records) WHERE NOT regexp_matches(word, '^\s+$') GROUP BY word",
    "b3_base_vocabulary": f"""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM corpus_records WHERE text <> ''),
      m AS (SELECT left_piece || right_piece AS token, min(merge_rank) AS rank FROM bpe_merges GROUP BY 1)
      SELECT unnest({tz.SPECIAL}) AS token, unnest(range({len(tz.SPECIAL)})) AS id UNION ALL SELECT token, row_number() OVER (ORDER BY token) + {len(tz.SPECIAL) - 1} FROM c
      UNION ALL SELECT token, row_number() OVER (ORDER BY rank) + {len(tz.SPECIAL) - 1} + (SELECT count(*) FROM c) FROM m WHERE token NOT IN (SELECT token FROM c)""",
    "b7_decoded": f"SELECT record_id, text FROM {_TEXTS} WHERE text <> ''", "n10_round_trip": f"SELECT record_id, true AS same FROM {_TEXTS} WHERE text <> ''",
    "r1_training_log": """SELECT * FROM (VALUES ('step', 1, 50, 6.6601::DOUBLE, 7.2597::DOUBLE, 1.5e-4::DOUBLE, NULL::DOUBLE, NULL::DOUBLE), ('epoch', 1, NULL, NULL, NULL, NULL, 5.3607, 212.8),
      ('step', 2, 100, 5.1, 5.9, 1.4e-4, NULL, NULL), ('epoch', 2, NULL, NULL, NULL, NULL, 4.7701, 117.93)) t(kind, epoch, step, loss, avg, lr, val_loss, ppl)""",
    "n5_n12_scores": f"""SELECT record_id, len(list_filter(w, lambda r: r IN ({_EN}))) = 0 AS no_english,
      (contains(lower(text), 'umntu')::INT + contains(lower(text), 'abantu')::INT + contains(lower(text), 'indlela')::INT + contains(lower(text), 'umthetho')::INT) >= 2 AS expected_words,
      round(1 - u, 6) AS repetition, round(least(1.0, len(w) / 20), 6) AS coherence, round(0.3 * least(1.0, len(w) / 20) + 0.4 * u + 0.3 * CASE WHEN len(w) >= 5 THEN 1.0 ELSE 0.5 END, 6) AS blend
      FROM (SELECT *, len(list_distinct(w)) / greatest(len(w), 1) AS u FROM (SELECT record_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM corpus_records))""",
    "n7_quality": "SELECT source, count(DISTINCT text) AS texts, round(avg(length(text)), 4) AS mean_length, CASE WHEN count(DISTINCT text) >= 2 THEN 100 ELSE 0 END AS score FROM corpus_records GROUP BY 1",
    "n9_rubric": rf"SELECT record_id, CASE WHEN len({PIECES}) >= 3 THEN 25 ELSE 0 END + CASE WHEN regexp_matches(text, '[.!?]\s*$') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(text, '^[a-zA-Z0-9\s.,;:!?''\-]*$') THEN 25 ELSE 0 END + CASE WHEN ({OLD}) = 0 THEN 25 ELSE 0 END AS points FROM corpus_records",
}
