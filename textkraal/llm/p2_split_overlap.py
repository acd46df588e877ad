"""Problem 2: same or near-same records across splits.

A cosine join of the texts' vectors of 5-character pieces, each with weight 1. A Jaccard similarity of 0.8 of two sets of n
and m pieces means a dot product of at least 4 (n + m) / 9, a cosine of 8/9 at least. Inverted lists of single pieces are
no way to the candidates: pruned by the residual norm to the n / 5 + 1 rarest pieces of a text they still join a tenth of
all pairs of texts, as most pieces belong to common words. So the terms of the lists here are conjunctions of WIDTH
pieces: the pieces of least value under WIDTH hash functions, BANDS times. Whether two texts share such a term depends on
their similarity alone, not on the frequency of anything, so a family of near copies of any size is found like two texts
are: a pair of similarity J shares none with probability (1 - J**WIDTH)**BANDS, 7e-5 at 0.8 and under 1e-6 from 0.85 on.

Within a list, pairs are pruned by the largest dot product that their norms admit (n and m differ by a fifth at most) and
by the residual: at most (n + m) / 9 pieces are in one of the two only, which is no less than the bits that differ between
the parities of hashed pieces. Both follow from the similarity. What is left gets its exact dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.normalize import clean_key, spaced_letters_digits
from textkraal.operators.near import DESCRIBED, candidates, describing, exact
from textkraal.session import load, materialize

MIN_CHARS, GRAM, SIMILARITY = 30, 5, 0.8
BANDS, WIDTH = 24, 5
#: The map of the evaluation texts' terms has at least 16 bits a term; with more terms than MAP_BITS / 16 none is used,
#: and all terms go through the shuffle. It is at most 16 MB.
MAP_BITS = 1 << 26


def _map(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the map of terms that are not 0, of one task."""
        words = np.zeros(bits // 64, dtype=np.uint64)
        for b in batches:
            at = b.column("terms").flatten().to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        slot = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(words[slot].view(np.int64))], names=["slot", "bits"])

    return run


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text and term; those of train only where the map has the term."""
        for b in batches:
            term = b.column("terms").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), BANDS)
            if shared is not None:
                words = shared.value
                at = term.view(np.uint64) % np.uint64(len(words) * 64)
                met = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                keep = (met == 1) | ~b.column("train").to_numpy(zero_copy_only=False)[row]
                term, row = term[keep], row[keep]
            rest = [b.column(c).take(pa.array(row)) for c in ("k1", "train", "n", "p0", "p1", "p2", "p3")]
            yield pa.RecordBatch.from_arrays([pa.array(term), *rest], names=["term", "k", "train", "n", "p0", "p1", "p2", "p3"])

    return run


def overlap_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records(record_id, text, split, source).

    members: record_id, split, source, train and the key (k1, k2) of its normalised text; links: the pairs of texts, one
    of an evaluation split (e1, e2), one of train (t1, t2), with cosine and Jaccard similarity. Equal texts are one
    class, so copies, however many, cost one link. Null texts and splits, and texts under 30 characters, take no part;
    repeated rows count once; empty tables give empty results.
    """
    spark = records.sparkSession
    r = records.select(
        "record_id", clean_key(F.col("split")).alias("split"), clean_key(F.col("source")).alias("source"), spaced_letters_digits(F.col("text")).alias("norm")
    ).where(F.col("record_id").isNotNull() & F.col("split").isin("train", "validation", "test") & (F.length("norm") >= MIN_CHARS))
    r = r.select("*", (F.col("split") == "train").alias("train"), F.xxhash64(F.lit(1), "norm").alias("k1"), F.xxhash64(F.lit(2), "norm").alias("k2"))
    members = r.select("record_id", "split", "source", "train", "k1", "k2")
    each = r.select("k1", "k2", "train", "norm").dropDuplicates(["k1", "k2", "train"])
    texts = materialize(each.mapInArrow(describing(GRAM, BANDS, WIDTH), f"k1 long, k2 long, train boolean, norm string, {DESCRIBED}"), "p2texts")

    small = texts.select("k1", "train", "n", "p0", "p1", "p2", "p3", "terms")
    terms = texts.where("not train").count() * BANDS
    shared = None
    if 16 * terms <= MAP_BITS:
        bits = max(1 << 16, 1 << (16 * terms).bit_length())
        got = texts.where("not train").select("terms").mapInArrow(_map(bits), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(words)
    p = small.mapInArrow(_postings(shared), "term long, k long, train boolean, n int, p0 long, p1 long, p2 long, p3 long")
    near = materialize(candidates(materialize(p, "p2terms"), SIMILARITY, "train").distinct(), "p2near")
    et = texts.where("not train").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("norm").alias("e_norm"))
    tt = texts.where("train").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("norm").alias("t_norm"))
    pairs = near.join(et, near.a == et.e1).join(tt, F.col("b") == tt.t1).select("e1", "e2", "t1", "t2", "e_norm", "t_norm")
    links = pairs.mapInArrow(exact(GRAM, SIMILARITY, ["e1", "e2", "t1", "t2"], "e_norm", "t_norm"), "e1 long, e2 long, t1 long, t2 long, cosine double, jaccard double")
    return members, materialize(links, "p2links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records, one of train and one of validation or test, whose texts are nearly the same."""
    members, links = overlap_classes(load(spark, sf_dir, "corpus_records").select("record_id", "text", "split", "source"))
    e = members.where("not train").select(F.col("record_id").alias("e"), F.col("k1").alias("e1"), F.col("k2").alias("e2")).distinct()
    t = members.where("train").select(F.col("record_id").alias("t"), F.col("k1").alias("t1"), F.col("k2").alias("t2")).distinct()
    both = links.join(e, ["e1", "e2"]).join(t, ["t1", "t2"]).where("e <> t")
    return both.select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b")).distinct()


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: records, and those with the same or nearly the same text in train."""
    members, links = overlap_classes(load(spark, sf_dir, "corpus_records").select("record_id", "text", "split", "source"))
    hit = links.groupBy(F.col("e1").alias("k1"), F.col("e2").alias("k2")).agg(F.max("jaccard").alias("best"))
    m = members.where("not train").groupBy("record_id", "split", "k1", "k2").agg(F.min("source").alias("source"))
    m = m.join(hit, ["k1", "k2"], "left")
    return m.groupBy("split", F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.count("*").alias("records"), F.count("best").alias("overlapping"), F.count_if(F.col("best") == 1).alias("same_pieces")
    )


def p2_record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of a split: its class of equal texts, and the number of classes of the other side that it overlaps.

    The form for large families, where the pairs of p2_found are too many: all links are counted, none is expanded.
    """
    members, links = overlap_classes(load(spark, sf_dir, "corpus_records").select("record_id", "text", "split", "source"))
    ends = [links.select(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2"), F.lit(x == "t").alias("train")) for x in "et"]
    n = ends[0].union(ends[1]).groupBy("k1", "k2", "train").agg(F.count("*").alias("links"))
    m = members.select("record_id", "split", "train", "k1", "k2").distinct().join(n, ["k1", "k2", "train"], "left")
    return m.select("record_id", "split", F.hex("k1").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


#: CTEs of the texts k(t, id) of 30 characters and more, and of the links l(x, y) of evaluation and train texts.
_LINKS = """WITH n AS (
      SELECT DISTINCT record_id, split = 'train' AS train, trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) AS t
      FROM corpus_records WHERE split IN ('train', 'validation', 'test') AND record_id IS NOT NULL AND text IS NOT NULL
    ), k AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT t FROM n WHERE length(t) >= 30)),
    g AS (SELECT id, unnest(list_distinct(list_transform(generate_series(1, length(t) - 4), lambda i: substring(t, i, 5)))) AS g FROM k),
    c AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    df AS (SELECT g, count(*) AS f FROM g GROUP BY g),
    r AS (SELECT g.id, g.g, row_number() OVER (PARTITION BY g.id ORDER BY f, g.g) AS pos, c.n FROM g JOIN df USING (g) JOIN c ON c.id = g.id),
    p AS (SELECT id, g, n FROM r WHERE pos <= n - ceil(0.8 * n) + 1),
    side AS (SELECT DISTINCT k.id, train FROM n JOIN k USING (t)),
    cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b USING (g)
      WHERE a.id IN (SELECT id FROM side WHERE NOT train) AND b.id IN (SELECT id FROM side WHERE train) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
    o AS (SELECT x, y, count(*) AS o FROM cand JOIN g a ON a.id = x JOIN g b ON b.id = y AND b.g = a.g GROUP BY x, y),
    l AS (SELECT x, y FROM o JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y WHERE 5 * o >= 4 * (cx.n + cy.n - o))"""
_MEMBERS = """, m AS (SELECT DISTINCT record_id, trim(lower(split)) AS split, nullif(trim(lower(source)), '') AS source, trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) AS t
      FROM corpus_records WHERE split IN ('train', 'validation', 'test') AND record_id IS NOT NULL AND text IS NOT NULL AND length(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g'))) >= 30)"""
SQL = {
    "p2_found": _LINKS + """
    SELECT DISTINCT least(e.record_id, t.record_id) AS record_id_a, greatest(e.record_id, t.record_id) AS record_id_b
    FROM l JOIN k kx ON kx.id = x JOIN k ky ON ky.id = y JOIN n e ON e.t = kx.t AND NOT e.train JOIN n t ON t.t = ky.t AND t.train
    WHERE e.record_id <> t.record_id""",
    "p2_overlap_report": _LINKS + _MEMBERS + """, b AS (SELECT x, max(o.o = cx.n AND o.o = cy.n) AS same FROM l JOIN o USING (x, y) JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y GROUP BY x),
    z AS (SELECT record_id, split, t, min(source) AS source FROM m WHERE split <> 'train' GROUP BY ALL)
    SELECT split, coalesce(source, '(none)') AS source, count(*) AS records, count(b.x) AS overlapping, count(*) FILTER (same) AS same_pieces FROM z JOIN k USING (t) LEFT JOIN b ON b.x = k.id GROUP BY 1, 2""",
}
QUERIES = {"p2_found": p2_found, "p2_overlap_report": p2_overlap_report, "p2_record_links": p2_record_links}
