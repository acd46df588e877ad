"""Deduplication, splits, routing and rollups of corpus records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkraal.session import materialize


def first_of_each(rows: DataFrame, key: str | Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    A minimum of structs with map-side combination, so that a key with a third of all rows is no hot task. Null keys
    form one group. Ties in `order` are broken by the remaining columns.
    """
    key = F.col(key) if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in order]
    g = rows.groupBy(key.alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return g.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])


def hashed_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 42, by: str | None = None, at_sums: bool = False) -> DataFrame:
    """rows with a column new_split: keys in order of a seeded hash, cut at the int-truncated shares; the last takes the rest.

    The global position of a key is its rank inside a bucket of leading hash digits plus the sizes of the buckets
    before, so no task sorts all rows. With `by` each of its groups is split on its own. at_sums cuts at the truncated
    sums of the shares.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    x = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    group = [by] if by else []
    size = x.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b")
    size = size.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(*group))).drop("_n")
    join = reduce(lambda a, b: a & b, [x[c].eqNullSafe(size[c]) for c in [*group, "_b"]])
    x = x.join(size, join).drop(*[size[c] for c in [*group, "_b"]])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    names, at, out, upto = list(shares), F.lit(0).cast("long"), None, 0.0
    for name in names[:-1]:
        upto += shares[name]
        at = F.floor(F.col("_total") * upto + 1e-9) if at_sums else at + F.floor(F.col("_total") * shares[name] + 1e-9)
        out = F.when(rank <= at, name) if out is None else out.when(rank <= at, name)
    return x.withColumn("new_split", out.otherwise(names[-1])).drop("_h", "_b", "_before", "_total")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """One row: min, max, mean (rounded) and the upper middle value, from a histogram of the values."""
    h = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))  # as many rows as distinct values
    c = h.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
    total = h.agg(F.sum("n").alias("total"), F.min("v").alias("shortest"), F.max("v").alias("longest"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n")).cast("long").alias("mean"))
    c = c.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2))
    return c.groupBy("total", "shortest", "longest", "mean").agg(F.min("v").alias("median"))


def bounded_sample(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most `most` rows, those of smallest hash of `key`; the choice does not depend on the partitioning.

    The rows are counted first and all but about 1.2 * most of them fall to a filter on the hash, so the tasks together
    send about that many rows to the final ordering, however many rows and tasks there are. Fewer rows are all kept;
    ties of the hash are broken by the key; null keys hash like any value.
    """
    h = F.xxhash64(*key)
    n = rows.count()
    if n > most:
        wide = 2.0**64
        cut = min(1.0, (1.2 * most + 100) / n)
        rows = rows.where(h.cast("double") + F.lit(wide / 2) < F.lit(wide * cut))
    return rows.withColumn("_h", h).orderBy("_h", *key).limit(most).drop("_h")


def with_positions(rows: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """rows with their place in the given order, from 0 on, which must be a total one for a defined result.

    Rows are parted by sampled ranges of the order, and a place is the rank in the range plus the sizes of those before,
    so no task sorts more than its range; the ranges are written first, for a sample drawn again may cut elsewhere.
    """
    x = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    size = x.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each shuffle partition
    size = size.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return x.join(F.broadcast(size), "_range").withColumn(name, F.col("_before") + rank - 1).drop("_range", "_before")
