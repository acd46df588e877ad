"""Queries over corpus records: sources, sinks, joins, rollups, deduplication, splits, governance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textkraal.functions.language import found, strip
from textkraal.functions.normalize import pieces
from textkraal.operators.records import first_of_each, hashed_split, upper_median, with_positions
from textkraal.plans.scalars import PIECES, STRIP
from textkraal.session import load, shared_dir
from textkraal.sources import readers


def rec(s, d):
    return load(s, d, "corpus_records")


RAW_FIELDS = (
    "record_id string, text string, source string, source_type string, source_title string, source_section string, language string, provenance_type string, confidence string, "
    "validation_status string, token_count int, orthography string, language_class string, retrieval_date string, generator string, original_text string"
)


def raw_records(s, d):
    """The payloads of raw_lines that are whole JSON; unknown keys are dropped, absent ones null."""
    j = load(s, d, "raw_lines").select("line_id", F.try_parse_json("payload").alias("j")).where("j is not null")
    cols = [F.try_variant_get("j", f"$.{n}", t).alias(n) for n, t in (x.split() for x in RAW_FIELDS.split(", "))]
    return j.select("line_id", *cols)


def text_round_trip(s, d):
    """The corpus as text lines, written and read again: one line per line break in a text."""
    path = f"{shared_dir(s)}/textkraal/lines-{uuid.uuid4().hex}"
    rec(s, d).where("language_class = 'TARGET_LANGUAGE' and text is not null").select(F.explode(F.split("text", "\r\n|\n|\r")).alias("value")).write.text(path)
    lines = readers.text_lines(s, path)
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def json_round_trip(s, d):
    """Records written as JSON lines, fields in order, and read with a fixed schema."""
    path = f"{shared_dir(s)}/textkraal/json-{uuid.uuid4().hex}"
    rec(s, d).select("record_id", "source", "text", "token_count").write.json(path)
    return readers.json_records(s, path, "record_id string, source string, text string, token_count int")


def corpus_hash(s, d):
    """Per source a SHA-256 of the sorted hashes of all its texts, copies included.

    In two levels, so that no task holds the hashes of a source: the sorted hashes that start with the same three digits
    are hashed, then the sorted digests of those up to 4096 groups.
    """
    h = rec(s, d).where("text is not null").select("source", F.sha2("text", 256).alias("h"))
    g = h.groupBy("source", F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("g"))
    return g.groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("b", F.lit(":"), "g"))), ""), 256).alias("digest"))


def corpus_digest(s, d):
    """Per source its records with a text and a digest of all their ids and texts: each pair of id and text is hashed, the
    eight 32-bit words of the hashes are summed apart, and the count and the sums are hashed. Every copy counts."""
    r = rec(s, d).where("text is not null")
    h = F.sha2(F.concat_ws(":", F.coalesce(F.sha2("record_id", 256), F.lit("null")), F.sha2("text", 256)), 256)
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")
    g = r.select("source", h.alias("h")).groupBy("source").agg(F.count("*").alias("records"), *[F.sum(word(i)).alias(f"w{i}") for i in range(8)])
    return g.select("source", "records", F.sha2(F.concat_ws(":", "records", *[f"w{i}" for i in range(8)]), 256).alias("digest"))


def routed(s, d):
    """validation_results by status, the corrected apart from the merely accepted."""
    v = load(s, d, "validation_results")
    route = F.when(F.size("corrections") > 0, "corrections").otherwise(F.coalesce("validation_status", F.lit("unknown")))
    return v.select(route.alias("route")).groupBy("route").agg(F.count("*").alias("rows"))


def status_lookup(s, d):
    """Each validation result with its record, the first by extraction_date, if there is one."""
    r = first_of_each(rec(s, d).select("record_id", "extraction_date", "source", "source_title"), "record_id", ["extraction_date"])
    return load(s, d, "validation_results").select("record_id", "validation_status").distinct().join(r.drop("extraction_date"), "record_id")


def required(s, d):
    """Records with all five required fields that are authoritative in provenance and status, the first of each id."""
    need = ["record_id", "text", "source", "provenance_type", "validation_status"]
    r = rec(s, d).select(*need, "extraction_date")
    for c in need:
        r = r.where(F.coalesce(F.col(c), F.lit("")) != "")
    r = r.where("provenance_type = 'authoritative' and validation_status = 'authoritative'")
    return first_of_each(r, "record_id", ["extraction_date"]).select("record_id", "source")


def by_column(*cols):
    """Counts of the values of each column, in one pass: a row is turned into one (column, value) per column."""

    def q(s, d):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
        return rec(s, d).select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))

    return q


COUNTED = ("language_class", "source", "orthography", "confidence", "validation_status", "source_type")


def work_rollup(s, d):
    r = rec(s, d).groupBy(F.col("source_title").alias("work"))
    kinds = [F.count_if(F.col("orthography") == k).alias(k) for k in ("modern", "traditional", "mixed")]
    return r.agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(pieces(F.col("text")))).alias("words"), *kinds)


def totals(s, d):
    return rec(s, d).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(pieces(F.col("text")))).alias("words"))


def key():
    """The text in lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))


def duplicates(s, d):
    g = rec(s, d).where("text is not null").select(key().alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    g = g.agg(F.sum("n").alias("records"), F.count("*").alias("distinct_texts"))
    return g.select("records", "distinct_texts", (F.col("records") - F.col("distinct_texts")).alias("duplicates"), F.round(F.try_divide(F.col("records") - F.col("distinct_texts"), F.col("records")), 6).alias("rate"))


def length_stats(s, d):
    return upper_median(rec(s, d).where("text is not null").select(F.length("text").alias("n")), "n")


def length_buckets(s, d):
    n = F.length("text")
    return rec(s, d).agg(F.count_if(n < 20).alias("under_20"), F.count_if(n < 50).alias("under_50"), F.count_if(n > 500).alias("over_500"))


def spelling_conflicts(s, d):
    g = rec(s, d).where("text is not null").groupBy(F.md5("text").alias("text_hash")).agg(F.countDistinct("orthography").alias("labels"))
    return g.where("labels > 1")


def tiers(s, d):
    """The works of each provenance type with their records: the list as rows, so that no task gathers a type's works."""
    return rec(s, d).where("source_title is not null").groupBy("provenance_type", F.col("source_title").alias("work")).agg(F.count("*").alias("records"))


def integrity(s, d):
    r = rec(s, d)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return r.agg(
        F.count("*").alias("records"), F.count_if(blank("text")).alias("empty_text"), F.countDistinct("record_id").alias("ids"),
        F.count_if(blank("source") | blank("source_title") | blank("source_url")).alias("missing_provenance"),
        F.count_if((F.col("provenance_type") == "generated") | ~blank("generator")).alias("generated"),
        F.count_if(F.col("text").rlike(r"(?i)\b(the|and|of)\b")).alias("english_like"),
    )


def expansion(s, d):
    """Growth of the second phase over the first: records, characters, words."""
    r = rec(s, d).groupBy("v2_phase").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))
    a, b = (r.where(F.col("v2_phase") == p).select(F.col("records").alias(f"r{i}"), F.col("chars").alias(f"c{i}")) for i, p in ((1, "V2-1"), (2, "V2-2")))
    return a.crossJoin(F.broadcast(b)).select(F.round(F.col("r2") / F.col("r1"), 4).alias("record_ratio"), F.round(F.col("c2") / F.col("c1"), 4).alias("char_ratio"))


def purity(s, d):
    r = rec(s, d)
    kind = F.when(F.col("provenance_type") == "generated", "generated").when(F.col("language_class") == "TARGET_LANGUAGE", "analysed").otherwise("set_aside")
    return r.groupBy(kind.alias("status")).agg(F.count("*").alias("records"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


def coverage(s, d):
    """Per domain its records and those validated, and a total row."""
    r = rec(s, d).groupBy(F.coalesce("source_type", F.lit("(none)")).alias("domain")).agg(F.count("*").alias("records"), F.count_if(F.col("validation_status") == "validated").alias("validated"))
    return r.union(rec(s, d).agg(F.lit("(all)").alias("domain"), F.count("*").alias("records"), F.count_if(F.col("validation_status") == "validated").alias("validated")))


def first_wins(s, d):
    """The first record, by id, of each normalised text of more than 20 characters."""
    r = rec(s, d).where(F.length(key()) > 20).select("record_id", key().alias("k"))
    return r.groupBy("k").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n")).select("record_id", "n")


def first_across_files(s, d):
    """The first record of each text, in order of file and id: records, then raw lines. Case and white space at the ends are
    of no account; texts are compared by their hash."""
    a = rec(s, d).select(F.lit(1).alias("file"), "record_id", "text")
    b = raw_records(s, d).select(F.lit(2).alias("file"), "record_id", "text")
    r = a.union(b).where("text is not null").select("file", "record_id", F.md5(F.lower(strip(F.col("text")))).alias("k"))
    return first_of_each(r, "k", ["file", "record_id"]).select("file", "record_id", F.col("k").alias("text_key"))


def across_sources(s, d):
    """Records and raw lines, the first of each text over ten characters; records come before raw lines."""
    a = rec(s, d).select(F.lit(1).alias("file"), "record_id", "text")
    b = raw_records(s, d).select(F.lit(2).alias("file"), "record_id", "text")
    r = a.union(b).where(F.length(key()) > 10).select("file", "record_id", key().alias("k"))
    return first_of_each(r, "k", ["file", "record_id"]).groupBy("file").agg(F.count("*").alias("kept"))


def set_ops(s, d):
    """Words of train and test texts: in both, in one only, in either."""
    w = rec(s, d).where("split in ('train', 'test')").select("split", F.explode(found(F.lower("text"), "[a-z]+")).alias("w")).distinct()
    g = w.groupBy("w").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    return g.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if(F.col("b") == 0).alias("train_only"), F.count_if(F.col("a") == 0).alias("test_only"), F.count("*").alias("either"))


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def documents_split(s, d):
    return hashed_split(load(s, d, "documents").select("doc_id"), "doc_id", SHARES)


def split_at_cuts(s, d):
    """Documents split at the int-truncated sums of the shares, where documents_split() sums the truncated shares."""
    return hashed_split(load(s, d, "documents").select("doc_id"), "doc_id", SHARES, at_sums=True)


def split_by_source(s, d):
    return hashed_split(load(s, d, "documents").select("doc_id", "source"), "doc_id", SHARES, by="source")


WEIGHTS = {"novel": 3.0, "poetry": 3.0, "drama": 2.0, "proverb": 2.0, "schoolbook": 1.5, "newspaper": 1.0}


def weighted(s, d):
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return rec(s, d).select("record_id", F.coalesce(w[F.coalesce("source_type", F.lit(""))], F.lit(1.0)).alias("weight"))


def sampled(s, d):
    """Every tenth document in order of id."""
    return with_positions(load(s, d, "documents").select("doc_id"), ["doc_id"]).where("at % 10 = 0").select("doc_id")


def trend(s, d):
    """Value of the first and the last event per type, and the change."""
    e = load(s, d, "events").groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return e.select("event_type", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round(F.col("last") - F.col("first"), 6).alias("change"))


def status_pivot(s, d):
    r = rec(s, d).groupBy("source_type").pivot("validation_status", ["authoritative", "rejected", "uncertain", "validated"]).agg(F.count(F.lit(1)))
    return r.na.fill(0, ["authoritative", "rejected", "uncertain", "validated"])


def quality_rules(s, d):
    """Rows that break each rule: keys, enumerations, spans and references."""
    r, e = rec(s, d), load(s, d, "evidence_items")
    one = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    classes = ["TARGET_LANGUAGE", "MIXED_LANGUAGE", "FOREIGN_LANGUAGE", "UNCERTAIN"]
    rules = [
        one("record_id unique", r.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")),
        one("text not empty", r.where("coalesce(trim(text), '') = ''")),
        one("language_class known", r.where(~F.coalesce(F.col("language_class"), F.lit("")).isin(classes))),
        one("token_count not negative", r.where("token_count < 0")),
        one("span in order", e.where("character_span.start > character_span.end")),
        one("evidence has a record", e.join(r.select("record_id"), "record_id", "left_anti")),
    ]
    out = rules[0]
    for x in rules[1:]:
        out = out.union(x)
    return out


def registry(s, d):
    """Hash of each record's text, to be preserved."""
    return rec(s, d).select("record_id", "source", F.sha2("text", 256).alias("source_hash")).distinct()


def node_counts(s, d):
    """Nodes of the evidence graph."""
    out = None
    for name, df, c in (("records", rec(s, d), "record_id"), ("works", rec(s, d), "source_title"), ("evidence", load(s, d, "evidence_items"), "surface_form"), ("sources", rec(s, d), "source")):
        x = df.agg(F.countDistinct(c).alias("n")).select(F.lit(name).alias("node"), "n")
        out = x if out is None else out.union(x)
    return out


def evidence_sources(s, d):
    """The records that are evidence of each surface form, as rows, with the number of items; a form's evidence isn't gathered."""
    return load(s, d, "evidence_items").groupBy("surface_form", "record_id").agg(F.count("*").alias("items"))


def memorization_sample(s, d):
    """The beginnings of the first hundred test records, in order of id."""
    r = rec(s, d).where("split = 'test' and text is not null").select("record_id", F.substring("text", 1, 200).alias("prompt")).distinct()
    return r.orderBy("record_id").limit(100)


def admitted(s, d):
    """The training corpus: authoritative records and validated ones that are neither foreign nor generated."""
    r = rec(s, d)
    a = r.where("validation_status = 'authoritative'")
    b = r.where("validation_status = 'validated' and coalesce(language_class, '') <> 'FOREIGN_LANGUAGE' and coalesce(source, '') <> 'generated'")
    return a.unionByName(b).select("record_id", "text").select("record_id", F.size(pieces(F.col("text"))).alias("words"))


def training_corpus(s, d):
    """The lines of the training corpus with their provenance: a line for each line of an admitted text that isn't blank."""
    r = rec(s, d).where("validation_status = 'authoritative' or (validation_status = 'validated' and coalesce(language_class, '') <> 'FOREIGN_LANGUAGE' and coalesce(source, '') <> 'generated')")
    x = r.select("record_id", "source", "source_title", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))
    return x.where(strip(F.col("line")) != "").distinct()


def integrity_rules(s, d):
    """Violations of each assertion on evidence and results: they must refer to analysed records and hold what they claim.

    One pass over each table; the records are joined once to either.
    """
    r = rec(s, d).select("record_id", "text", "language_class").groupBy("record_id").agg(F.min("text").alias("text"), F.min("language_class").alias("language_class"))
    e = load(s, d, "evidence_items").select("record_id", "surface_form", "context", "character_span").join(r, "record_id", "left")
    span = F.substring(F.col("text"), F.col("character_span.start") + 1, F.col("character_span.end") - F.col("character_span.start"))
    known = F.col("language_class") == "TARGET_LANGUAGE"
    v = load(s, d, "validation_results").select("record_id", "original_text", "validation_status", "corrected_text").join(r, "record_id", "left")
    tests = [
        (e, {"evidence is of an analysed record": known, "evidence has a form": F.coalesce(F.col("surface_form"), F.lit("")) != "", "form stands at its span": F.col("character_span").isNull() | (span == F.col("surface_form")), "context holds the form": F.contains("context", "surface_form")}),
        (v, {"result is of a record": F.col("text").isNotNull(), "original text preserved": F.col("original_text") == F.col("text"), "only rejected results lack a text": (F.col("validation_status") == "rejected") | F.col("corrected_text").isNotNull()}),
    ]
    out = None
    for df, rules in tests:
        g = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
        g = g.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(f"`{name}`"))])).alias("rule", "violations"))
        out = g if out is None else out.union(g)
    return out


PROVENANCE = ["record_id", "source", "source_type", "source_title", "source_section", "language", "provenance_type", "confidence", "validation_status", "orthography", "language_class", "generator", "token_count"]

def _lines(s, d):
    """The stripped lines of all texts that aren't blank."""
    return rec(s, d).select(F.explode(F.split("text", "\n")).alias("line")).select(strip(F.col("line")).alias("line")).where("line <> ''")


QUERIES = {
    "s1_distinct_lines": lambda s, d: _lines(s, d).distinct(),
    "s2_all_lines": lambda s, d: _lines(s, d).groupBy("line").agg(F.count("*").alias("n")),
    "s3_json_records": raw_records, "s4_required_records": required, "s7_trimmed_lines": lambda s, d: rec(s, d).select("record_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines")),
    "k1_json_round_trip": json_round_trip, "k3_text_lines": text_round_trip, "k4_provenance": lambda s, d: rec(s, d).select(*PROVENANCE), "k5_routes": routed, "k8_corpus_hash": corpus_hash, "k8_corpus_digest": corpus_digest,
    "f6_admission": admitted, "v3_training_corpus": training_corpus, "j1_status_lookup": status_lookup, "g1_counts": by_column(*COUNTED), "g2_work_rollup": work_rollup, "g3_totals": totals,
    "g8_length_stats": length_stats, "g8_length_buckets": length_buckets, "g9_duplicates": duplicates, "g24_spelling_conflicts": spelling_conflicts, "g26_coverage": coverage, "g29_tiers": tiers,
    "g30_integrity": integrity, "g31_expansion": expansion, "g32_purity": purity, "w4_sorted_head": lambda s, d: rec(s, d).orderBy(F.asc_nulls_last("source"), F.asc_nulls_last("source_type"), "text", "record_id").select("record_id").limit(100),
    "w5_frequent_sources": lambda s, d: rec(s, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20),
    "w7_trend": trend, "w8_every_tenth": sampled, "d1_first_wins": first_across_files, "d2_first_by_text": first_wins, "d3_across_sources": across_sources,
    "d4_union": lambda s, d: rec(s, d).select("record_id", "text").unionByName(raw_records(s, d).select("record_id", "text")).agg(F.count("*").alias("rows"), F.countDistinct("record_id").alias("ids")),
    "d5_set_operations": set_ops, "d6_split": documents_split, "d7_split_by_source": split_by_source, "d8_split_at_cuts": split_at_cuts, "d10_weights": weighted, "r2_status_pivot": status_pivot,
    "q3_evidence_sources": evidence_sources, "n17_memorization_sample": memorization_sample, "q4_graph_nodes": node_counts, "q5_registry": registry, "q10_quality_rules": quality_rules, "v4_integrity_rules": integrity_rules,
}

_K = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_RAW = "(SELECT line_id, payload::JSON AS j FROM (SELECT line_id, payload FROM raw_lines WHERE json_valid(payload)))"
_RAWCOLS = ", ".join(f"(j ->> '{n}')::{'INT' if t == 'int' else 'VARCHAR'} AS {n}" for n, t in (x.split() for x in RAW_FIELDS.split(", ")))
_UNION = f"SELECT 1 AS file, record_id, text FROM corpus_records UNION ALL SELECT 2, j ->> 'record_id', j ->> 'text' FROM {_RAW}"
_LINES = "(SELECT unnest(string_split(text, chr(10))) AS text FROM corpus_records WHERE text IS NOT NULL)"
_ACROSS = f"SELECT file, count(*) AS kept FROM (SELECT file, row_number() OVER (PARTITION BY {_K} ORDER BY file, record_id) AS rn FROM ({_UNION}) WHERE length({_K}) > 10) WHERE rn = 1 GROUP BY file"
_BLANK = "coalesce(trim({}), '') = ''"


def _split_sql(by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = "doc_id, " + by if by else "doc_id"
    return f"""SELECT {cols}, CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'validation' ELSE 'test' END AS new_split
      FROM (SELECT {cols}, row_number() OVER ({part}ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER ({part}) AS n FROM documents)"""


_ADMIT = f"""SELECT record_id, len({PIECES}) AS words FROM (SELECT * FROM corpus_records WHERE validation_status = 'authoritative' UNION ALL SELECT * FROM corpus_records
  WHERE validation_status = 'validated' AND coalesce(language_class, '') <> 'FOREIGN_LANGUAGE' AND coalesce(source, '') <> 'generated')"""
_RULES = """SELECT 'record_id unique' AS rule, count(*) AS violations FROM (SELECT record_id FROM corpus_records GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'text not empty', count(*) FROM corpus_records WHERE coalesce(trim(text), '') = ''
  UNION ALL SELECT 'language_class known', count(*) FROM corpus_records WHERE coalesce(language_class, '') NOT IN ('TARGET_LANGUAGE', 'MIXED_LANGUAGE', 'FOREIGN_LANGUAGE', 'UNCERTAIN')
  UNION ALL SELECT 'token_count not negative', count(*) FROM corpus_records WHERE token_count < 0
  UNION ALL SELECT 'span in order', count(*) FROM evidence_items WHERE character_span."start" > character_span."end"
  UNION ALL SELECT 'evidence has a record', count(*) FROM evidence_items e WHERE NOT EXISTS (SELECT 1 FROM corpus_records c WHERE c.record_id = e.record_id)"""
_FIRST = "SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY extraction_date) AS rn FROM corpus_records"

SQL = {
    "s1_distinct_lines": f"SELECT DISTINCT line FROM (SELECT {STRIP} AS line FROM {_LINES}) WHERE line <> ''",
    "s2_all_lines": f"SELECT line, count(*) AS n FROM (SELECT {STRIP} AS line FROM {_LINES}) WHERE line <> '' GROUP BY line",
    "s3_json_records": f"SELECT line_id, {_RAWCOLS} FROM {_RAW}",
    "s4_required_records": "SELECT record_id, source FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY extraction_date) AS rn FROM corpus_records WHERE coalesce(record_id, '') <> '' AND coalesce(text, '') <> '' AND coalesce(source, '') <> '' AND provenance_type = 'authoritative' AND validation_status = 'authoritative') WHERE rn = 1",
    "s7_trimmed_lines": "SELECT record_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM corpus_records",
    "k1_json_round_trip": "SELECT record_id, source, text, token_count FROM corpus_records",
    "k3_text_lines": rf"SELECT line, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM corpus_records WHERE language_class = 'TARGET_LANGUAGE' AND text IS NOT NULL) GROUP BY line",
    "k4_provenance": f"SELECT {', '.join(PROVENANCE)} FROM corpus_records",
    "k5_routes": "SELECT CASE WHEN len(corrections) > 0 THEN 'corrections' ELSE coalesce(validation_status, 'unknown') END AS route, count(*) AS rows FROM validation_results GROUP BY 1",
    "k8_corpus_hash": """WITH h AS (SELECT source, sha256(text) AS h FROM corpus_records WHERE text IS NOT NULL),
      g AS (SELECT source, h[1:3] AS b, sha256(array_to_string(list_sort(list(h)), '')) AS g FROM h GROUP BY 1, 2)
      SELECT source, sha256(array_to_string(list_sort(list(b || ':' || g)), '')) AS digest FROM g GROUP BY source""",
    "f6_admission": _ADMIT,
    "v3_training_corpus": f"""SELECT DISTINCT record_id, source, source_title, line_no, line FROM (SELECT record_id, source, source_title, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
      FROM (SELECT *, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM corpus_records WHERE validation_status = 'authoritative' OR (validation_status = 'validated' AND coalesce(language_class, '') <> 'FOREIGN_LANGUAGE' AND coalesce(source, '') <> 'generated')))
      WHERE {STRIP.replace('text', 'line')} <> ''""",
    "j1_status_lookup": f"SELECT DISTINCT v.record_id, v.validation_status, r.source, r.source_title FROM validation_results v JOIN ({_FIRST}) r ON r.record_id = v.record_id AND r.rn = 1",
    "g1_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM corpus_records GROUP BY {c}" for c in COUNTED),
    "g2_work_rollup": f"SELECT source_title AS work, count(*) AS records, sum(length(text))::BIGINT AS chars, sum(len({PIECES}))::BIGINT AS words, count(*) FILTER (orthography = 'modern') AS modern, count(*) FILTER (orthography = 'traditional') AS traditional, count(*) FILTER (orthography = 'mixed') AS mixed FROM corpus_records GROUP BY 1",
    "g3_totals": f"SELECT count(*) AS records, sum(length(text))::BIGINT AS chars, sum(len({PIECES}))::BIGINT AS words FROM corpus_records",
    "g8_length_stats": "SELECT count(*) AS total, min(n) AS shortest, max(n) AS longest, round(avg(n))::BIGINT AS mean, list_sort(list(n))[count(*) // 2 + 1] AS median FROM (SELECT length(text) AS n FROM corpus_records WHERE text IS NOT NULL)",
    "g8_length_buckets": "SELECT count(*) FILTER (length(text) < 20) AS under_20, count(*) FILTER (length(text) < 50) AS under_50, count(*) FILTER (length(text) > 500) AS over_500 FROM corpus_records",
    "g9_duplicates": f"SELECT count(*) AS records, count(DISTINCT {_K}) AS distinct_texts, records - distinct_texts AS duplicates, round(duplicates / records, 6) AS rate FROM corpus_records WHERE text IS NOT NULL",
    "g24_spelling_conflicts": "SELECT md5(text) AS text_hash, count(DISTINCT orthography) AS labels FROM corpus_records WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT orthography) > 1",
    "g26_coverage": "SELECT coalesce(source_type, '(none)') AS domain, count(*) AS records, count(*) FILTER (validation_status = 'validated') AS validated FROM corpus_records GROUP BY 1 UNION ALL SELECT '(all)', count(*), count(*) FILTER (validation_status = 'validated') FROM corpus_records",
    "g29_tiers": "SELECT provenance_type, source_title AS work, count(*) AS records FROM corpus_records WHERE source_title IS NOT NULL GROUP BY 1, 2",
    "n17_memorization_sample": "SELECT DISTINCT record_id, substring(text, 1, 200) AS prompt FROM corpus_records WHERE split = 'test' AND text IS NOT NULL ORDER BY record_id LIMIT 100",
    "g30_integrity": rf"SELECT count(*) AS records, count(*) FILTER ({_BLANK.format('text')}) AS empty_text, count(DISTINCT record_id) AS ids, count(*) FILTER ({_BLANK.format('source')} OR {_BLANK.format('source_title')} OR {_BLANK.format('source_url')}) AS missing_provenance, count(*) FILTER (provenance_type = 'generated' OR NOT {_BLANK.format('generator')}) AS generated, count(*) FILTER (regexp_matches(text, '(?i)\b(the|and|of)\b')) AS english_like FROM corpus_records",
    "g31_expansion": "SELECT round(count(*) FILTER (v2_phase = 'V2-2') / count(*) FILTER (v2_phase = 'V2-1'), 4) AS record_ratio, round(sum(length(text)) FILTER (v2_phase = 'V2-2') / sum(length(text)) FILTER (v2_phase = 'V2-1'), 4) AS char_ratio FROM corpus_records",
    "g32_purity": "SELECT CASE WHEN provenance_type = 'generated' THEN 'generated' WHEN language_class = 'TARGET_LANGUAGE' THEN 'analysed' ELSE 'set_aside' END AS status, count(*) AS records, count(DISTINCT text) AS texts FROM corpus_records GROUP BY 1",
    "w4_sorted_head": "SELECT record_id FROM corpus_records ORDER BY source NULLS LAST, source_type NULLS LAST, text, record_id LIMIT 100",
    "w5_frequent_sources": "SELECT source, count(*) AS n FROM corpus_records WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 20",
    "w7_trend": "SELECT event_type, round(arg_min(value, (ts, event_id)), 6) AS first, round(arg_max(value, (ts, event_id)), 6) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS change FROM events GROUP BY 1",
    "w8_every_tenth": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 10 = 0",
    "d3_across_sources": _ACROSS,
    "d1_first_wins": f"SELECT file, record_id, k AS text_key FROM (SELECT file, record_id, md5(lower({STRIP})) AS k, row_number() OVER (PARTITION BY lower({STRIP}) ORDER BY file, record_id) AS rn FROM ({_UNION}) WHERE text IS NOT NULL) WHERE rn = 1",
    "d2_first_by_text": f"SELECT min(record_id) AS record_id, count(*) AS n FROM corpus_records WHERE length({_K}) > 20 GROUP BY {_K}",
    "d4_union": f"SELECT count(*) AS rows, count(DISTINCT record_id) AS ids FROM ({_UNION})",
    "d5_set_operations": "WITH w AS (SELECT DISTINCT split, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM corpus_records WHERE split IN ('train', 'test')), g AS (SELECT w, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM w GROUP BY w) SELECT count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (b = 0) AS train_only, count(*) FILTER (a = 0) AS test_only, count(*) AS either FROM g",
    "d6_split": _split_sql(), "d7_split_by_source": _split_sql("source"), "d8_split_at_cuts": _split_sql().replace("floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9)", "floor(n * (0.8 + 0.1) + 1e-9)"),
    "d10_weights": "SELECT record_id, CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END::DOUBLE AS weight FROM corpus_records",
    "r2_status_pivot": "SELECT source_type, " + ", ".join(f"count(*) FILTER (validation_status = '{k}') AS {k}" for k in ("authoritative", "rejected", "uncertain", "validated")) + " FROM corpus_records GROUP BY 1",
    "q3_evidence_sources": "SELECT surface_form, record_id, count(*) AS items FROM evidence_items GROUP BY 1, 2",
    "q4_graph_nodes": "SELECT 'records' AS node, count(DISTINCT record_id) AS n FROM corpus_records UNION ALL SELECT 'works', count(DISTINCT source_title) FROM corpus_records UNION ALL SELECT 'evidence', count(DISTINCT surface_form) FROM evidence_items UNION ALL SELECT 'sources', count(DISTINCT source) FROM corpus_records",
    "q5_registry": "SELECT DISTINCT record_id, source, sha256(text) AS source_hash FROM corpus_records",
    "q10_quality_rules": _RULES, 
    "v4_integrity_rules": """WITH r AS (SELECT record_id, min(text) AS text, min(language_class) AS language_class FROM corpus_records GROUP BY 1),
      e AS (SELECT e.*, r.text, r.language_class FROM evidence_items e LEFT JOIN r USING (record_id)), v AS (SELECT v.*, r.text FROM validation_results v LEFT JOIN r USING (record_id))
      SELECT 'evidence is of an analysed record' AS rule, count(*) FILTER (NOT coalesce(language_class = 'TARGET_LANGUAGE', false)) AS violations FROM e
      UNION ALL SELECT 'evidence has a form', count(*) FILTER (coalesce(surface_form, '') = '') FROM e
      UNION ALL SELECT 'form stands at its span', count(*) FILTER (NOT coalesce(character_span IS NULL OR substring(text, character_span."start" + 1, character_span."end" - character_span."start") = surface_form, false)) FROM e
      UNION ALL SELECT 'context holds the form', count(*) FILTER (NOT coalesce(contains(context, surface_form), false)) FROM e
      UNION ALL SELECT 'result is of a record', count(*) FILTER (text IS NULL) FROM v
      UNION ALL SELECT 'original text preserved', count(*) FILTER (NOT coalesce(original_text = text, false)) FROM v
      UNION ALL SELECT 'only rejected results lack a text', count(*) FILTER (NOT coalesce(validation_status = 'rejected' OR corrected_text IS NOT NULL, false)) FROM v""",
}
