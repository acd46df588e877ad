"""Queries of the scalar text functions and filters, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions import language as fl
from textkraal.functions.normalize import WS as WS_JAVA
from textkraal.functions.normalize import let, pieces
from textkraal.operators.records import first_of_each, with_positions
from textkraal.session import load


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def per_record(name: str, expr, table: str = "corpus_records", key: str = "record_id", text: str = "text"):
    """A query (key, name) that applies expr to the text of every row."""

    def q(spark, sf_dir):
        return load(spark, sf_dir, table).select(key, expr(F.col(text)).alias(name))

    return q


def sql_per_record(name: str, expr: str, table: str = "corpus_records", key: str = "record_id") -> str:
    return f"SELECT {key}, {expr} AS {name} FROM {table}"


WS = r"[\x09-\x0d\x1c-\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PIECES = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')"
WORDS = r"regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+(?:[-''][\p{L}\p{Nl}\p{No}]+)*')"
STRIP = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
OLD = "length(text) - length(translate(text, '65', ''))"


def _share(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: x IN ({_in(words)}))) / greatest(len(w), 1)"


V1 = f"""CASE WHEN len(w) < 3 THEN 'UNCERTAIN' WHEN e > 0.3 AND x < 0.1 THEN 'FOREIGN_LANGUAGE' WHEN e > 0.15 AND x > 0.05 THEN 'MIXED_LANGUAGE'
  WHEN x > 0.05 OR e < 0.15 THEN 'TARGET_LANGUAGE' ELSE 'UNCERTAIN' END"""
V1_FROM = rf"""(SELECT *, {_share(lx.ENGLISH_V1)} AS e, {_share(lx.XHOSA_V1)} AS x FROM
  (SELECT *, regexp_extract_all(lower(text), '[a-zA-Z\x{{c0}}-\x{{17f}}]+') AS w FROM {{table}}))"""
V2_FROM = rf"""(SELECT *, {_share(lx.ENGLISH_V2)} AS e, len(regexp_extract_all(text, '(?i)\b({"|".join(lx.XHOSA_V2)})\b')) / greatest(len(w), 1) AS x FROM
  (SELECT *, regexp_extract_all(lower(text), '[a-zA-Z]+') AS w FROM {{table}}))"""


def language_class_distribution(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(fl.language_v1(F.col("text")).alias("language_class"))
    return d.groupBy("language_class").agg(F.count("*").alias("documents"))


def jaccard_sizes(c: Column) -> Column:
    n = F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    return F.size(F.array_distinct(let(n, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 4, F.lit(1))), lambda i: F.substring(t, i, 5)))))


def lines_of(spark, sf_dir):
    """(record_id, pos, line) of every row of corpus_records."""
    r = load(spark, sf_dir, "corpus_records").select("record_id", "text").distinct()
    return r.select("record_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def header_lines(spark, sf_dir):
    return lines_of(spark, sf_dir).select("record_id", "pos", fl.is_header(F.col("line")).alias("strict"), fl.is_header(F.col("line"), strict=False).alias("literal"))


def _header_sql(strict: bool) -> str:
    rules = [*lx.HEADER_LINES, *([lx.HEADER_CLASS] if strict else [])]
    hits = " OR ".join(f"regexp_matches(text, '{p}')" for p in rules)
    return f"(text = '' OR (length(text) <= 2 AND text NOT IN ({_in(lx.SHORT_LINES)})) OR {hits})"


def segments(spark, sf_dir):
    """Paragraph segments of every text, of 20 to 500 characters, lines joined by line breaks.

    A header ends a segment. While one is open, a line of up to three characters ends it and one of up to nine is
    dropped; otherwise any line opens one. So whether one is open before a line follows from the last line that was
    longer or a header, and the number of lines of up to three characters since.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("pos")  # the lines of one text
    r = lines_of(spark, sf_dir).withColumn("n", F.length(fl.strip(F.col("line")))).withColumn("head", fl.is_header(F.col("line")))
    r = r.withColumn("tiny", ~F.col("head") & (F.col("n") <= 3)).withColumn("tinies", F.sum(F.col("tiny").cast("int")).over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("tiny"), F.struct((~F.col("head")).alias("body"), "tinies")), ignorenulls=True).over(before)
    r = r.withColumn("last", last).withColumn("since", F.col("tinies") - F.col("tiny").cast("int") - F.coalesce(F.col("last.tinies"), F.lit(0)))
    r = r.withColumn("open", (F.coalesce(F.col("last.body"), F.lit(False)).cast("int") + F.col("since")) % 2 == 1)
    r = r.where("not head and (not open or n >= 10)").withColumn("seg", F.sum((~F.col("open")).cast("int")).over(w))
    g = r.groupBy("record_id", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = fl.strip(F.array_join(F.transform("l", lambda x: F.regexp_replace(x["line"], f"{WS_JAVA}+$", "")), "\n"))
    return g.select("record_id", "seg", text.alias("segment")).where(F.length("segment").between(20, 500))


def sections(rules: str, untitled: str | None = None):
    """A query of the section of each text by one of the two rule lists."""

    def q(spark, sf_dir):
        of = fl.section(F.col("text"), lx.LITERARY_SECTIONS if rules == "literary" else lx.LEARNER_SECTIONS, lx.NO_SECTION[rules], untitled)
        return load(spark, sf_dir, "corpus_records").select("record_id", of.alias("s")).select("record_id", F.col("s.title").alias("title"), F.col("s.section").alias("section"), F.col("s.type").alias("type"))

    return q


def cleaned(c: Column) -> Column:
    """A text that is just I becomes 1; in others split and misread names are repaired."""
    out = F.when(F.trim(c) == "I", F.replace(c, F.lit("I"), F.lit("1"))).otherwise(c)
    for pattern, to in lx.NAME_REPAIRS:
        out = F.regexp_replace(out, pattern, to)
    return out


def record_ids(spark, sf_dir):
    """Ids of the first document of each text: source, how many texts came before, and the start of the text's hash.

    Documents come in order of doc_id; texts are equal if they agree but for case and white space at their ends.
    """
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "text", F.lower(fl.strip(F.col("text"))).alias("k"))
    first = first_of_each(d, F.md5("k"), ["doc_id"]).select("doc_id", "source", F.substring(F.md5("text"), 1, 8).alias("h"))
    at = F.lpad(F.col("at").cast("string"), 6, "0")
    return with_positions(first, ["doc_id"]).select("doc_id", F.concat_ws("_", F.coalesce("source", F.lit("")), at, "h").alias("record_id"))


def kept_lines(spark, sf_dir):
    """Lines that are no marker or number, have five characters or more, and aren't in a foreign language."""
    s = fl.strip(F.col("line"))
    return lines_of(spark, sf_dir).where(~s.rlike(r"^(===|—)|^\d+$") & (F.length(s) >= 5) & (fl.language_v1(s) != "FOREIGN_LANGUAGE")).select("record_id", "pos")


QUERIES = {
    "t1_language_class_distribution": language_class_distribution,
    "t1_language_v1": per_record("language_v1", fl.language_v1),
    "t2_language_v2": per_record("language_v2", fl.language_v2),
    "t3_spelling_v1": per_record("spelling", fl.spelling_v1),
    "t4_spelling_v2": per_record("spelling", fl.spelling_v2),
    "t8_sections": sections("literary", lx.NO_SECTION["untitled"]), "t8_learner_sections": sections("learner"),
    "t9_repetitive": per_record("repetitive", fl.repetitive),
    "t10_clean_text": per_record("cleaned", cleaned),
    "t11_segments": segments,
    "t12_key_lower": per_record("key", lambda c: F.lower(fl.strip(c))),
    "t13_key_spaces": per_record("key", lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))),
    "t14_record_ids": record_ids,
    "t15_token_count": per_record("n", lambda c: F.size(pieces(c))),
    "t16_word_tokens": lambda s, d: load(s, d, "corpus_records").select("record_id", F.array_join(fl.found(F.col("text"), fl.WORD), "|").alias("words")),
    "t18_contexts": lambda s, d: _contexts(s, d),
    "t19_source_hash": per_record("hash", lambda c: F.sha2(c, 256)),
    "t20_modern_spelling": per_record("modern", fl.modern_spelling),
    "t22_char_5grams": per_record("n", jaccard_sizes),
    "t23_word_trigrams": lambda s, d: _trigrams(s, d),
    "t28_perplexity": lambda s, d: load(s, d, "events").select("event_id", F.round(F.exp(F.col("value") / 100), 4).alias("perplexity")),
    "f1_line_skip": kept_lines,
    "f2_filter_text": lambda s, d: load(s, d, "corpus_records").where(F.length("text").between(10, 200) & (F.size(pieces(F.col("text"))) >= 3) & F.col("text").rlike(r"^[a-zA-Z0-9 .,;:!?'\-]*\z")).select("record_id"),
    "f3_segment_length": lambda s, d: load(s, d, "corpus_records").where(F.length(fl.strip(F.col("text"))).between(20, 500)).select("record_id"),
    "f4_header_lines": header_lines,
    "f5_authentic": lambda s, d: load(s, d, "corpus_records").where("language_class = 'TARGET_LANGUAGE'").select("record_id"),
    "f7_not_foreign": lambda s, d: load(s, d, "corpus_records").where("language_class <> 'FOREIGN_LANGUAGE'").select("record_id"),
    "f8_text_minimum": lambda s, d: load(s, d, "corpus_records").select("record_id", F.array_join(F.slice(pieces(F.col("text")), 1, 16), " ").alias("head"), F.size(pieces(F.col("text"))).alias("n")).where("n >= 4").drop("n"),
    "f9_missing_provenance": lambda s, d: load(s, d, "corpus_records").where("coalesce(trim(source), '') = '' or coalesce(trim(source_title), '') = '' or coalesce(trim(source_url), '') = ''").select("record_id"),
    "f10_generated": lambda s, d: load(s, d, "corpus_records").where("source = 'generated' or provenance_type = 'generated' or coalesce(generator, '') <> ''").select("record_id"),
    "f11_english_like": lambda s, d: load(s, d, "corpus_records").where(F.col("text").rlike(r"(?i)\b(the|and|of|with|that)\b")).select("record_id"),
}


def _contexts(spark, sf_dir):
    """Each evidence span with 80 characters on either side, from the record's own text."""
    r = load(spark, sf_dir, "corpus_records").select("record_id", "text").distinct()
    e = load(spark, sf_dir, "evidence_items").where("character_span is not null").select("record_id", "character_span.start", "character_span.end").distinct()
    a = F.greatest(F.col("start") - 80, F.lit(0))
    return e.join(r, "record_id").select("record_id", "start", "end", F.substring(F.col("text"), a + 1, F.col("end") + 80 - a).alias("context"))


def _trigrams(spark, sf_dir):
    w = pieces(F.lower("text"))
    t = let(w, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(v, i), F.get(v, i + 1), F.get(v, i + 2))))
    r = load(spark, sf_dir, "corpus_records").where(F.size(w) >= 3).select(F.explode(t).alias("trigram"))
    return r.groupBy("trigram").agg(F.count("*").alias("n")).where("n >= 2")




def _sections_sql(rules: list[tuple], none: tuple[str, str, str], untitled: str = "") -> str:
    cols = []
    quoted = lambda x: chr(39) + (x or untitled).replace("'", "''") + chr(39)
    for i, name in ((1, "title"), (2, "section"), (3, "type")):
        whens = " ".join(f"WHEN regexp_matches(lower(text), '{r[0]}') THEN {quoted(r[i])}" for r in rules)
        cols.append(f"CASE {whens} ELSE '{none[i - 1]}' END AS {name}")
    return f"SELECT record_id, {', '.join(cols)} FROM corpus_records"


_LINES = "(SELECT record_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM (SELECT DISTINCT record_id, text FROM corpus_records WHERE text IS NOT NULL))"
_STRIPPED = f"(SELECT record_id, pos, line, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS text FROM {_LINES})"
_REPEATED = " OR ".join(f"len(regexp_extract_all(lower(text), '{p}')) >= 2" for p in lx.REPEATED_PHRASES)

SQL = {
    "t1_language_class_distribution": f"SELECT {V1} AS language_class, count(*) AS documents FROM {V1_FROM.replace('{table}', 'documents')} GROUP BY 1",
    "t1_language_v1": f"SELECT record_id, {V1} AS language_v1 FROM {V1_FROM.replace('{table}', 'corpus_records')}",
    "t2_language_v2": f"""SELECT record_id, CASE WHEN len(w) < 3 THEN 'UNCERTAIN' WHEN e > 0.4 AND x < 0.05 THEN 'FOREIGN_LANGUAGE'
      WHEN x > 0.01 OR e < 0.2 THEN 'TARGET_LANGUAGE' ELSE 'MIXED_LANGUAGE' END AS language_v2 FROM {V2_FROM.replace('{table}', 'corpus_records')}""",
    "t3_spelling_v1": sql_per_record("spelling", f"CASE WHEN {OLD} > 2 THEN 'traditional' ELSE 'modern' END"),
    "t4_spelling_v2": sql_per_record("spelling", f"CASE WHEN {OLD} > 2 THEN 'traditional' WHEN {OLD} > 0 THEN 'mixed' ELSE 'modern' END"),
    "t8_sections": _sections_sql(lx.LITERARY_SECTIONS, lx.NO_SECTION["literary"], lx.NO_SECTION["untitled"]), "t8_learner_sections": _sections_sql(lx.LEARNER_SECTIONS, lx.NO_SECTION["learner"]),
    "t9_repetitive": f"""WITH r AS (SELECT row_number() OVER () AS k, record_id, text, {PIECES} AS w FROM corpus_records),
      p AS (SELECT k, w[i] || ' ' || w[i + 1] AS p FROM (SELECT k, w, unnest(generate_series(1, len(w) - 1)) AS i FROM r)),
      m AS (SELECT k, max(c) AS c FROM (SELECT k, p, count(*) AS c FROM p GROUP BY k, p) GROUP BY k)
      SELECT record_id, coalesce(len(w) >= 6 AND ((len(w) - 1 > 4 AND c > (len(w) - 1) * 0.3) OR {_REPEATED}), false) AS repetitive FROM r LEFT JOIN m USING (k)""",
    "t10_clean_text": r"""SELECT record_id, CASE WHEN trim(text) = 'I' THEN replace(text, 'I', '1') ELSE
      regexp_replace(regexp_replace(replace(text, 'Mqhayi' || chr(10), 'Mqhayi '), 'MQ[ H]AYI|MQAYI', 'MQHAYI', 'g'), 'KRUN[EE]|KFUNE', 'KRUNE', 'g') END AS cleaned FROM corpus_records""",
    "t11_segments": f"""WITH l AS (SELECT record_id, pos, line, {_header_sql(True)} AS head, NOT head AND length(text) <= 3 AS tiny, length(text) AS n FROM {_STRIPPED}),
      g AS (SELECT *, coalesce(max(CASE WHEN NOT tiny THEN pos END) OVER (PARTITION BY record_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p FROM l),
      o AS (SELECT g.*, (coalesce(NOT b.head, false)::INT + g.pos - g.p - 1) % 2 = 1 AS open FROM g LEFT JOIN l b ON b.record_id = g.record_id AND b.pos = g.p),
      k AS (SELECT *, sum((NOT open)::INT) OVER (PARTITION BY record_id ORDER BY pos) AS seg FROM o WHERE NOT head AND (NOT open OR n >= 10)),
      t AS (SELECT record_id, seg::BIGINT AS seg, {STRIP.replace('text', "string_agg(regexp_replace(line, '" + WS + "+$', ''), chr(10) ORDER BY pos)")} AS segment FROM k GROUP BY record_id, seg)
      SELECT * FROM t WHERE length(segment) BETWEEN 20 AND 500""",
    "t12_key_lower": sql_per_record("key", f"lower({STRIP})"),
    "t13_key_spaces": sql_per_record("key", r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"),
    "t14_record_ids": f"""SELECT doc_id, concat_ws('_', coalesce(source, ''), lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 6, '0'), substring(md5(text), 1, 8)) AS record_id
      FROM (SELECT *, row_number() OVER (PARTITION BY lower({STRIP}) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1""",
    "t15_token_count": sql_per_record("n", f"len({PIECES})"),
    "t16_word_tokens": sql_per_record("words", f"coalesce(array_to_string({WORDS}, '|'), '')"),
    "t18_contexts": """SELECT record_id, a.s AS start, a.e AS "end", substring(text, greatest(a.s - 80, 0) + 1, a.e + 80 - greatest(a.s - 80, 0)) AS context
      FROM (SELECT DISTINCT record_id, character_span."start" AS s, character_span."end" AS e FROM evidence_items WHERE character_span IS NOT NULL) a
      JOIN (SELECT DISTINCT record_id, text FROM corpus_records) USING (record_id)""",
    "t19_source_hash": sql_per_record("hash", "sha256(text)"),
    "t20_modern_spelling": sql_per_record("modern", "replace(replace(text, '6', 'bh'), '5', 'hl')"),
    "t22_char_5grams": r"""SELECT record_id, len(list_distinct(list_transform(generate_series(1, greatest(length(t) - 4, 1)), lambda i: substring(t, i, 5)))) AS n
      FROM (SELECT record_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM corpus_records)""",
    "t23_word_trigrams": f"""WITH r AS (SELECT list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda x: x <> '') AS w FROM corpus_records),
      t AS (SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS trigram FROM (SELECT w, unnest(generate_series(1, len(w) - 2)) AS i FROM r WHERE len(w) >= 3))
      SELECT trigram, count(*) AS n FROM t GROUP BY trigram HAVING count(*) >= 2""",
    "t28_perplexity": "SELECT event_id, round(exp(value / 100), 4) AS perplexity FROM events",
    "f1_line_skip": rf"SELECT record_id, pos FROM {V1_FROM.replace('{table}', _STRIPPED)} WHERE {V1} <> 'FOREIGN_LANGUAGE' AND NOT regexp_matches(text, '^(===|—)|^\d+$') AND length(text) >= 5",
    "f2_filter_text": rf"SELECT record_id FROM corpus_records WHERE length(text) BETWEEN 10 AND 200 AND len({PIECES}) >= 3 AND regexp_matches(text, '^[a-zA-Z0-9 .,;:!?''\-]*$')",
    "f3_segment_length": f"SELECT record_id FROM corpus_records WHERE length({STRIP}) BETWEEN 20 AND 500",
    "f4_header_lines": f"SELECT record_id, pos, {_header_sql(True)} AS strict, {_header_sql(False)} AS literal FROM {_STRIPPED}",
    "f5_authentic": "SELECT record_id FROM corpus_records WHERE language_class = 'TARGET_LANGUAGE'",
    "f7_not_foreign": "SELECT record_id FROM corpus_records WHERE language_class <> 'FOREIGN_LANGUAGE'",
    "f8_text_minimum": f"SELECT record_id, array_to_string(list_slice(w, 1, 16), ' ') AS head FROM (SELECT record_id, {PIECES} AS w FROM corpus_records) WHERE len(w) >= 4",
    "f9_missing_provenance": "SELECT record_id FROM corpus_records WHERE coalesce(trim(source), '') = '' OR coalesce(trim(source_title), '') = '' OR coalesce(trim(source_url), '') = ''",
    "f10_generated": "SELECT record_id FROM corpus_records WHERE source = 'generated' OR provenance_type = 'generated' OR coalesce(generator, '') <> ''",
    "f11_english_like": r"SELECT record_id FROM corpus_records WHERE regexp_matches(text, '(?i)\b(the|and|of|with|that)\b')",
}
