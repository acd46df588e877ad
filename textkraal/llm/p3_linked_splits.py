"""Problem 3: splits that keep related records together.

Components of the graph of sources and works, then largest-differencing balance: the extreme weights are combined
again and again into many equal bins, and whole bins go to splits by target proportion.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.normalize import clean_key, letters_digits
from textkraal.operators.components import connected_components
from textkraal.session import load, materialize

#: Titles that stand for no particular work, by their letters and digits (fixed values).
PLACEHOLDERS = [
    "akukhosihloko", "akwaziwa", "anon", "anonymous", "ayaziwa", "general", "misc", "miscellaneous", "na", "nil", "none",
    "notavailable", "notitle", "notitled", "null", "other", "others", "tba", "tbc", "tbd", "title", "unidentified", "unknown",
    "unknowntitle", "unnamed", "unspecified", "untitled", "various",
]

_ORD = r"(?:\d+\s*(?:st|nd|rd|th)?|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|new|revised)"
_NUM = r"(?:\d+|[ivxlc]+)"
#: Closing notes of edition, printing or volume, one or several.
NOTE = (
    r"(?i)(?:[\s\p{P}]*(?:(?<=[\s\p{P}])|^)(?:"
    rf"{_ORD}[\s\-]*(?:ed|edn|edition|printing|print|impression|reprint)\b"
    rf"|(?:ed|edn|edition|printing|impression)\.?\s*{_NUM}"
    rf"|re-?print(?:ed)?(?:\s+{_NUM})?"
    rf"|u?shicilelo(?:\s+l\p{{L}}*)?[\s\-]*{_NUM}"
    rf"|(?:vol|volume|umqulu|part|icandelo)\b\.?\s*{_NUM}"
    r"))+[\s\p{P}]*$"
)


def work_key(title: Column) -> Column:
    """Letters and digits of a title without its closing note; null where it names no particular work."""
    bare = letters_digits(F.regexp_replace(title, NOTE, ""))
    whole = letters_digits(title)
    return F.when((bare != "") & ~bare.isin(PLACEHOLDERS) & ~whole.isin(PLACEHOLDERS), bare)


def linked_nodes(records: DataFrame) -> DataFrame:
    """(record_id, source, work) as keys of the graph; record_id null rows are dropped, repeated rows stay."""
    return records.select("record_id", clean_key(F.col("source")).alias("source"), work_key(F.col("source_title")).alias("work")).where(
        "record_id is not null"
    )


def source_components(nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, label) over 's:source' and 'w:work' keys; isolated sources and works are components of one. more: further edges (a, b)."""
    e = nodes.select(
        F.coalesce(F.concat(F.lit("s:"), "source"), F.concat(F.lit("w:"), "work")).alias("a"),
        F.coalesce(F.concat(F.lit("w:"), "work"), F.concat(F.lit("s:"), "source")).alias("b"),
    )
    e = e.where("a is not null")
    return connected_components((e if more is None else e.union(more)).distinct())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different sources that must share a split, the smaller first."""
    c = source_components(linked_nodes(load(spark, sf_dir, "corpus_records")))
    s = materialize(c.where("startswith(node, 's:')").select(F.substring("node", 3, 1 << 30).alias("source"), "label"), "p3sources")
    return (
        s.select(F.col("source").alias("source_a"), "label")
        .join(s.select(F.col("source").alias("source_b"), "label"), "label")
        .where("source_a < source_b").select("source_a", "source_b")
    )


def differencing_bins(weights: list[tuple[str, int]], bins: int) -> dict[str, int]:
    """Largest differencing (Karmarkar and Karp) into a number of bins: key -> bin.

    The two partial partitions of largest spread are merged, the heaviest bins of one with the lightest of the other.
    """
    heap = []
    for n, (key, w) in enumerate(sorted(weights, key=lambda x: (-x[1], x[0]))):
        sums = [w] + [0] * (bins - 1)
        heapq.heappush(heap, (-w, n, sums, [[key]] + [[] for _ in range(bins - 1)]))
    n = len(heap)
    while len(heap) > 1:
        _, _, s1, k1 = heapq.heappop(heap)
        _, _, s2, k2 = heapq.heappop(heap)
        merged = sorted(
            ((s1[i] + s2[bins - 1 - i], k1[i] + k2[bins - 1 - i]) for i in range(bins)), key=lambda x: -x[0]
        )
        n += 1
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, [x for x, _ in merged], [k for _, k in merged]))
    return {k: b for b, keys in enumerate(heap[0][3]) for k in keys} if heap else {}


def allocate(bin_weight: dict[int, int], shares: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits, the heaviest first, each to the split furthest below its target."""
    total, got, out = sum(bin_weight.values()), dict.fromkeys(shares, 0), {}
    for b, w in sorted(bin_weight.items(), key=lambda x: (-x[1], x[0])):
        s = max(shares, key=lambda k: (shares[k] * total - got[k], shares[k]))
        out[b] = s
        got[s] += w
    return out


def assign_splits(records: DataFrame, shares: dict[str, float] | None = None, bins: int = 100, packets: int = 1024, heavy: int = 2000) -> DataFrame:
    """(record_id, component, split): records linked by source or work, directly or in a chain, get one split.

    A record without source and usable title is its own component. Components of at least 1/heavy of all records
    (so at most `heavy` of them) are balanced one by one; the rest goes into `packets` packets by hash, so the
    driver holds at most heavy + packets weights whatever the size of the corpus.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark = records.sparkSession
    nodes = linked_nodes(records).distinct()
    key = F.coalesce(F.concat(F.lit("s:"), "source"), F.concat(F.lit("w:"), "work"))
    own = F.concat(F.lit("r:"), F.col("record_id"))
    # the rows of one record may differ in source or work; then the record links them
    several = nodes.select("record_id", own.alias("a"), key.alias("b")).where("b is not null").distinct()
    several = several.join(several.groupBy("record_id").count().where("count > 1").select("record_id"), "record_id", "left_semi").select("a", "b")
    comp = source_components(nodes, several)
    labelled = (
        nodes.withColumn("node", F.coalesce(key, own)).join(comp, "node", "left")
        .groupBy("record_id").agg(F.min(F.coalesce("label", "node")).alias("component"))
    )
    labelled = materialize(labelled, "p3labelled")
    sizes = materialize(labelled.groupBy("component").agg(F.count("*").alias("w")), "p3sizes")
    total = sizes.agg(F.sum("w")).first()[0] or 0
    big = F.col("w") * heavy >= total
    unit = F.when(big, F.col("component")).otherwise(F.concat(F.lit("packet "), F.pmod(F.xxhash64("component"), F.lit(packets))))
    units = sizes.groupBy(unit.alias("unit")).agg(F.sum("w").alias("w")).collect()  # at most heavy + packets rows
    where = differencing_bins([(r.unit, r.w) for r in units], bins)
    weight = dict.fromkeys(range(bins), 0)
    for r in units:
        weight[where[r.unit]] += r.w
    split = allocate(weight, shares)
    small = spark.createDataFrame([(u, split[b]) for u, b in where.items()], "unit string, split string")
    chosen = sizes.select("component", unit.alias("unit")).join(F.broadcast(small), "unit").select("component", "split")
    return labelled.join(chosen, "component").select("record_id", "component", "split")


def p3_assigned_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every record."""
    return assign_splits(load(spark, sf_dir, "corpus_records"))


def p3_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, components and share of each new split."""
    a = p3_assigned_splits(spark, sf_dir)
    g = a.groupBy("split", "component").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("records"), F.count("*").alias("components"))
    total = g.agg(F.sum("records").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("split", "records", "components", F.round(F.col("records") / F.col("total"), 6).alias("share"))


def p3_source_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its component: the smallest source of it; the form for large components, where pairs are too many."""
    c = source_components(linked_nodes(load(spark, sf_dir, "corpus_records")))
    s = c.where("startswith(node, 's:')").select(F.substring("node", 3, 1 << 30).alias("source"), "label")
    first = s.groupBy("label").agg(F.min("source").alias("component"), F.count("*").alias("sources"))
    return s.join(first, "label").select("source", "component", "sources")


QUERIES = {"p3_found": p3_found, "p3_assigned_splits": p3_assigned_splits, "p3_split_shares": p3_split_shares, "p3_source_components": p3_source_components}
SQL: dict[str, str] = {}
