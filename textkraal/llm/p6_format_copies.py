"""Problem 6: duplicates hidden by formatting.

Each normalised (field name, value) pair is hashed, the hashes of a record's fields are added up (a commutative
multiset hash, so the order of fields is of no account), records are grouped by that fingerprint and every
member's fields are compared with those of the record that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.normalize import letters_digits
from textkraal.session import load, materialize

#: A fingerprint of at least this share of the rows in groups is hot; there are at most 1/HOT of them.
HOT = 1 / 1000


def fingerprint(fields: list[str], seed: int) -> Column:
    """Sum over the fields of a 56-bit hash of name and value; null and empty values add nothing."""
    total = F.lit(0).cast("long")
    for name in fields:
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), F.col(name)), 8)
        total = total + F.when(F.col(name).isNull() | (F.col(name) == ""), F.lit(0).cast("long")).otherwise(h)
    return total


def format_copies(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(kept_id, copy_id): copies of the record with the smallest key that agree in the letters and digits of fields.

    Null keys are dropped; a record whose fields hold no letter or digit at all is a copy of nothing; rows that
    repeat a key and its fields count once; other columns are ignored. An empty table gives no rows.
    """
    norm = records.select(F.col(key).alias("id"), *[F.coalesce(letters_digits(F.col(c)), F.lit("")).alias(c) for c in fields])
    norm = norm.where(F.col("id").isNotNull() & (F.length(F.concat(*fields)) > 0))
    rows = norm.select("id", *fields, fingerprint(fields, 1).alias("f1"), fingerprint(fields, 2).alias("f2"))
    groups = (
        rows.select("id", "f1", "f2").distinct()
        .groupBy("f1", "f2").agg(F.min("id").alias("kept_id"), F.count("*").alias("n"))
        .where("n > 1")
    )
    groups = materialize(groups, "p6groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    groups = groups.withColumn("hot", F.col("n") >= max(2.0, total * HOT))
    # at most 1/HOT rows are broadcast; rows of hot groups never go through a shuffle on the fingerprint
    few, rest = F.broadcast(groups.where("hot")), groups.where("not hot")
    own = [F.col(c) for c in ("id", "f1", "f2", "kept_id", "hot", *fields)]
    cold = rows.join(F.broadcast(groups.where("hot").select("f1", "f2")), ["f1", "f2"], "left_anti").join(rest, ["f1", "f2"])
    members = materialize(rows.join(few, ["f1", "f2"]).select(*own).union(cold.select(*own)), "p6members")
    heads = members.where("id = kept_id").groupBy("f1", "f2", "hot").agg(F.min(F.struct(*fields)).alias("head"))
    this = F.struct(*fields)
    of = [members.join(F.broadcast(heads.where("hot").drop("hot")), ["f1", "f2"]), members.where("not hot").join(heads.where("not hot").drop("hot"), ["f1", "f2"])]
    joined = materialize(of[0].union(of[1]).select("id", "kept_id", (this == F.col("head")).alias("same"), *[F.when(this != F.col("head"), F.col(c)).alias(c) for c in fields]), "p6compared")
    # texts that share a fingerprint with others are grouped by the fields themselves; there are hardly any
    odd = joined.where("not same").select("id", *fields)
    odd = odd.join(odd.groupBy(*fields).agg(F.min("id").alias("kept_id")), fields)
    out = joined.where("same").select("kept_id", F.col("id").alias("copy_id")).union(odd.select("kept_id", "id"))
    return out.where("kept_id <> copy_id").distinct()


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, text) of corpus_records and of the payloads of raw_lines that are whole JSON."""
    corpus = load(spark, sf_dir, "corpus_records").select("record_id", "text")
    raw = load(spark, sf_dir, "raw_lines").select(F.try_parse_json("payload").alias("j"))
    raw = raw.select(
        F.try_variant_get("j", "$.record_id", "string").alias("record_id"), F.try_variant_get("j", "$.text", "string").alias("text")
    )
    return corpus.union(raw)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy, with the record kept for it."""
    return format_copies(text_records(spark, sf_dir), "record_id", ["text"])


def p6_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that remains of each group and how many copies it stands for, itself included."""
    c = p6_found(spark, sf_dir)
    return c.groupBy("kept_id").agg((F.count("*") + 1).alias("copies"))


def p6_record_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the corpus that agree in text, title and source alike."""
    return format_copies(load(spark, sf_dir, "corpus_records"), "record_id", ["text", "source_title", "source"])


_SQL = """
WITH t AS (
  SELECT record_id, text FROM corpus_records
  UNION ALL
  SELECT payload::JSON ->> 'record_id', payload::JSON ->> 'text' FROM (SELECT payload FROM raw_lines WHERE json_valid(payload))
), n AS (
  SELECT DISTINCT record_id AS id, regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g') AS k FROM t WHERE record_id IS NOT NULL AND text IS NOT NULL
), g AS (SELECT k, min(id) AS kept_id FROM n WHERE k <> '' GROUP BY k HAVING count(*) > 1)
"""

SQL = {
    "p6_found": _SQL + "SELECT DISTINCT kept_id, id AS copy_id FROM n JOIN g USING (k) WHERE id <> kept_id",
    "p6_record_copies": """WITH n AS (SELECT DISTINCT record_id AS id, k1, k2, k3 FROM (SELECT record_id,
        regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]', '', 'g') AS k1, regexp_replace(lower(coalesce(source_title, '')), '[^\\pL\\pN]', '', 'g') AS k2,
        regexp_replace(lower(coalesce(source, '')), '[^\\pL\\pN]', '', 'g') AS k3 FROM corpus_records WHERE record_id IS NOT NULL) WHERE k1 || k2 || k3 <> ''),
      g AS (SELECT k1, k2, k3, min(id) AS kept_id FROM n GROUP BY ALL)
      SELECT DISTINCT kept_id, id AS copy_id FROM n JOIN g USING (k1, k2, k3) WHERE id <> kept_id""",
    "p6_copy_counts": _SQL + "SELECT kept_id, count(*) AS copies FROM n JOIN g USING (k) GROUP BY kept_id",
}
QUERIES = {"p6_found": p6_found, "p6_copy_counts": p6_copy_counts, "p6_record_copies": p6_record_copies}
