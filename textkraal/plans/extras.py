"""Queries of the remaining sources, sinks and reports, and of the streaming slice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions.language import confidence_band, first_prefix, found
from textkraal.operators import tokenizer as tz
from textkraal.operators import tokens as tk
from textkraal.plans.checked import encoded, merges, rec, texts, vocabulary
from textkraal.plans.observed import _ANALYSIS, _KEYS, TARGET, TOK, _seen, target, target_tokens
from textkraal.plans.scalars import V1, V1_FROM
from textkraal.session import load, materialize, shared_dir
from textkraal.sources import readers
from textkraal.streaming.ingest import daily_counts


def place(s, name):
    return f"{shared_dir(s)}/textkraal/{name}-{uuid.uuid4().hex}"


def whole_files(s, d):
    """The test items of a suite as one text file, read whole: its characters, a line break after each text."""
    path = place(s, "whole")
    t = load(s, d, "eval_items").where("suite is not null").select(F.md5("suite").alias("file"), F.coalesce("text", F.lit("")).alias("value"))
    t.repartition("file").write.partitionBy("file").text(path)
    w = readers.whole_texts(s, path).select(F.regexp_extract("path", "file=([^/]*)", 1).alias("file"), F.length("text").alias("chars"))
    names = load(s, d, "eval_items").where("suite is not null").select("suite", F.md5("suite").alias("file")).distinct()
    return w.join(names, "file").groupBy("suite").agg(F.sum("chars").alias("chars"))


def json_files(s, d):
    """Curated entries as JSON documents of several lines, a file each, read back; a list is flattened, a broken file skipped."""
    path = place(s, "json")
    entries = [(k, f'{{\n "id": "{k}",\n "prefix": "{p}"\n}}') for p, k in lx.NOUN_CLASS.items()]
    files = [*[(str(i), t) for i, (_, t) in enumerate(entries)], ("list", "[" + ",\n".join(f'{{"id": "{v}", "prefix": "{c}"}}' for c, v in lx.SUBJECT_CONCORDS.items()) + "]"), ("broken", '{"id": "broken')]
    s.createDataFrame(files, "file string, value string").repartition("file").write.partitionBy("file").text(path)
    return readers.json_documents(s, path, "id string, prefix string").select("id", "prefix").where("id is not null")


def doubled(s, d):
    """A source list that is extended with itself: the union of a table and its copy."""
    x = load(s, d, "eval_items").select("suite")
    return x.unionByName(x).groupBy("suite").agg(F.count("*").alias("n"))


def markdown(s, d):
    """A report in Markdown, one line a row, in order."""
    g = rec(s, d).groupBy(F.coalesce("language_class", F.lit("(none)")).alias("c")).agg(F.count("*").alias("n"))
    body = g.select(F.col("c").alias("k"), F.concat(F.lit("| "), "c", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))
    return s.createDataFrame([("", "| class | records |")], "k string, line string").union(body).select("line")


def harvest(s, d):
    """The first twenty, in order, of words that look like verbs and like nouns."""
    out = None
    for kind, p in (("verb", r"\b(?:ndi|u|ba|si)ya[a-z]+\b"), ("noun", r"\b(?:um|aba|isi|izi|ama)[a-z]{3,}\b")):
        w = target(s, d).select(F.explode(found(F.lower("text"), p)).alias("word")).distinct().orderBy("word").limit(20).select(F.lit(kind).alias("kind"), "word")
        out = w if out is None else out.union(w)
    return out


def agreement_entries(s, d):
    """Per subject concord its tokens and forms, and the observation it is linked to."""
    c = first_prefix(F.col("low"), list(lx.SUBJECT_CONCORDS))
    g = target_tokens(s, d).select(c.alias("concord"), "low").where("concord is not null").groupBy("concord").agg(F.count("*").alias("tokens"), F.countDistinct("low").alias("forms"))
    return g.withColumn("status", F.when((F.col("forms") >= 2) & (F.col("tokens") >= 5), "SUPPORTED").otherwise("UNDER_REVIEW"))


def saved_vocabulary(s, d):
    """Merge list and vocabulary written as tables and read back: (token, id), special tokens, characters, merges."""
    path = place(s, "vocabulary")
    m = merges(s, d)
    chars = m.select(F.explode(F.split(F.concat("left", "right"), "")).alias("token")).where("token <> ''").distinct()
    n = len(tz.SPECIAL)
    t = s.createDataFrame([(0, i, x) for i, x in enumerate(tz.SPECIAL)], "part int, pos int, token string")
    t = t.union(chars.select(F.lit(1), F.ascii("token"), "token")).union(m.select(F.lit(2), "rank", F.concat("left", "right")))
    t.write.parquet(path)
    back = s.read.schema("part int, pos int, token string").parquet(path)
    return back.groupBy("part").agg(F.count("*").alias("tokens"), F.min("token").alias("first"), F.max("token").alias("last")).withColumn("special", F.lit(n))


def padded(s, d):
    """Ids of each text between <bos> and <eos>, 64 places, with the place of <eos> and the places attended to."""
    e = encoded(s, d)
    t, m = tz.padded(F.col("tokens"), 64)
    x = e.select("record_id", t.alias("tokens"), F.array_position(t, "<eos>").alias("end"), F.aggregate(m, F.lit(0), lambda a, b: a + b).alias("attended"))
    return tz.with_ids(x, vocabulary(s, d)).select("record_id", F.array_join("ids", " ").alias("ids"), "end", "attended")


def compression(s, d):
    """Tokens and characters per token of the modern and of the older texts under each of two merge lists: the existing one,
    and one trained on the modern texts. Each distinct word is encoded once per list."""
    kind = F.when(F.col("orthography") == "modern", "modern").otherwise("older")
    t = rec(s, d).where("text is not null").select("record_id", "text", kind.alias("corpus")).distinct()
    w = t.select("corpus", F.explode(tz.pre_tokens(F.col("text"))).alias("word")).groupBy("corpus", "word").agg(F.count("*").alias("n"))
    w = materialize(w, "pieces")
    white = F.col("word").rlike(r"^\s+$")
    own = tz.train(s, w.where((F.col("corpus") == "modern") & ~white).select("word", "n"))
    out = None
    for name, m in (("existing", merges(s, d)), ("trained", own)):
        e = w.join(tz.encode_words(w.where(~white), m), "word", "left").withColumn("size", F.coalesce(F.size("tokens"), F.lit(1)))
        e = e.withColumn("size", F.when(white, 1).otherwise(F.col("size")))
        g = e.groupBy("corpus").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum(F.length("word") * F.col("n")).alias("chars"))
        g = g.select(F.lit(name).alias("tokenizer"), "corpus", "tokens", "chars", F.round(F.col("chars") / F.col("tokens"), 6).alias("chars_per_token"))
        out = g if out is None else out.union(g)
    return out


def gate(s, d):
    """The coverage report: families of observations with their patterns and tokens."""
    g = tk.all_observations(target_tokens(s, d)).groupBy("family", "pattern").agg(F.count("*").alias("n"))
    return g.groupBy("family").agg(F.count("*").alias("patterns"), F.sum("n").alias("tokens"))


QUERIES = {
    "s5_json_documents": json_files, "s6_whole_files": whole_files, "s11_doubled": doubled, "k6_markdown": markdown, "q7_gate_report": gate, "q2_agreement_entries": agreement_entries,
    "t24_confidence_bands": lambda s, d: load(s, d, "evidence_items").groupBy("surface_form").agg(F.count("*").alias("n")).withColumn("confidence", confidence_band(F.col("n"))),
    "t27_pattern_harvest": harvest, "a2_word_lists": lambda s, d: texts(s, d).select("record_id", F.array_join(F.transform(found(F.col("text"), tk.WORD), lambda w: tk.analysis(w)["type"]), " ").alias("types")),
    "a5_verb_patterns": lambda s, d: target_tokens(s, d).where(first_prefix(F.col("low"), list(lx.SUBJECT_CONCORDS)).isNotNull()).groupBy("low").agg(F.count("*").alias("n")).where("n >= 5").orderBy("low").limit(50),
    "w6_top_characters": lambda s, d: rec(s, d).select(F.explode(F.split(F.lower("text"), "")).alias("ch")).where("ch rlike '[a-z]'").groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(10),
    "b5_padded": padded, "b8_saved_vocabulary": saved_vocabulary, "b11_compression": compression,
    "st1_stream_daily_counts": lambda s, d: daily_counts(s, f"{d}/raw_lines.parquet*"),
}

_ALL = TOK.replace(TARGET, "(SELECT DISTINCT record_id, text, NULL AS orthography FROM corpus_records WHERE record_id IS NOT NULL AND text IS NOT NULL)")
SQL = {
    "s5_json_documents": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}')" for p, k in [*lx.NOUN_CLASS.items(), *lx.SUBJECT_CONCORDS.items()]) + ") t(id, prefix)",
    "s6_whole_files": "SELECT suite, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars FROM eval_items WHERE suite IS NOT NULL GROUP BY suite",
    "q7_gate_report": TOK + " SELECT family, count(DISTINCT pattern) AS patterns, count(*) AS tokens FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS family, pattern FROM {_seen(f)}" for f in _KEYS) + ") GROUP BY family",
    "a2_word_lists": f"{_ALL} SELECT r.record_id, coalesce(types, '') AS types FROM (SELECT DISTINCT record_id, text FROM corpus_records WHERE record_id IS NOT NULL AND text IS NOT NULL) r LEFT JOIN (SELECT record_id, string_agg(type, ' ' ORDER BY pos) AS types FROM {_ANALYSIS} GROUP BY record_id) USING (record_id)",
    "s11_doubled": "SELECT suite, 2 * count(*) AS n FROM eval_items GROUP BY 1",
    "k6_markdown": "SELECT '| class | records |' AS line UNION ALL SELECT '| ' || coalesce(language_class, '(none)') || ' | ' || count(*) || ' |' FROM corpus_records GROUP BY language_class",
    "t24_confidence_bands": "SELECT surface_form, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'HIGH_CONFIDENCE' WHEN count(*) >= 5 THEN 'SUPPORTED' ELSE 'OBSERVED' END AS confidence FROM evidence_items GROUP BY 1",
    "t27_pattern_harvest": " UNION ALL ".join(rf"SELECT * FROM (SELECT DISTINCT '{k}' AS kind, unnest(regexp_extract_all(lower(text), '{p}')) AS word FROM {TARGET} ORDER BY word LIMIT 20)" for k, p in (("verb", r"\b(?:ndi|u|ba|si)ya[a-z]+\b"), ("noun", r"\b(?:um|aba|isi|izi|ama)[a-z]{3,}\b"))),
    "q2_agreement_entries": f"{TOK} SELECT c AS concord, count(*) AS tokens, count(DISTINCT low) AS forms, CASE WHEN count(DISTINCT low) >= 2 AND count(*) >= 5 THEN 'SUPPORTED' ELSE 'UNDER_REVIEW' END AS status FROM k WHERE c IS NOT NULL GROUP BY c",
    "a5_verb_patterns": f"{TOK} SELECT low, count(*) AS n FROM k WHERE c IS NOT NULL GROUP BY low HAVING count(*) >= 5 ORDER BY low LIMIT 50",
    "w6_top_characters": "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS ch FROM corpus_records) WHERE regexp_matches(ch, '[a-z]') GROUP BY ch ORDER BY n DESC, ch LIMIT 10",
    "st1_stream_daily_counts": f"SELECT strftime(received_at, '%Y-%m-%d') AS day, {V1} AS language_class, count(*) AS lines FROM {V1_FROM.replace('{table}', '(SELECT received_at, CASE WHEN json_valid(payload) THEN payload::JSON ->> ' + chr(39) + 'text' + chr(39) + ' END AS text FROM raw_lines WHERE received_at IS NOT NULL)').replace('len(w) < 3', 'coalesce(len(w), 0) < 3')} GROUP BY ALL".replace("len(w) < 3", "coalesce(len(w), 0) < 3"),
}
