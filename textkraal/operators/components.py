"""Connected components by minimum labels, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkraal.operators.records import with_positions
from textkraal.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node in edges; label is the smallest node of its component.

    Nodes are numbered in their order first, so that the rounds run on numbers. Each round takes the smallest label among
    a node's neighbours, hooks it under the node's present root and halves the paths, so a chain of n nodes needs about
    log n rounds. Neighbourhoods are never gathered: all groupings are minima with map-side combination. In the joins the
    side that repeats a hub or a root meets one row of the other, so Spark splits such a partition (adaptive skew join).
    Null ends are dropped; an edge from a node to itself makes it a node of its own; no edges give no rows.
    """
    named = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct(), "edges")
    number = materialize(with_positions(named.select(F.col("u").alias("name")).union(named.select("v")).distinct(), ["name"], "id"), "nodes")
    e = named.join(number.select(F.col("name").alias("u"), F.col("id").alias("a")), "u").join(number.select(F.col("name").alias("v"), F.col("id").alias("b")), "v").select("a", "b")
    label = _labels(e, max_rounds)
    at = number.select(F.col("id").alias("label"), F.col("name").alias("first"))
    return label.join(number.withColumnRenamed("id", "node"), "node").join(at, "label").select(F.col("name").alias("node"), F.col("first").alias("label"))


def _labels(e: DataFrame, max_rounds: int) -> DataFrame:
    """(node, label) of numbered nodes."""
    both = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")).distinct(), "edges")
    f = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("p"))
    f = materialize(f.select(F.col("u").alias("node"), "p"), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(f.select(F.col("node").alias("v"), "p"), "v")
            .groupBy("u").agg(F.min("p").alias("m"))
            .withColumnRenamed("u", "node")
        )
        g = f.join(near, "node").select("node", "p", F.least("p", "m").alias("g"))
        hooked = g.groupBy(F.col("p").alias("root")).agg(F.min("g").alias("h"))
        step = g.join(hooked, g.p == hooked.root).select("node", "p", F.least("g", "h").alias("q"))
        jump = step.select(F.col("node").alias("q"), F.col("q").alias("qq"))
        new = materialize(
            step.join(jump, "q").select("node", F.least("q", "qq").alias("p"), (F.least("q", "qq") != F.col("p")).alias("moved")),
            "labels",
        )
        if new.where("moved").limit(1).count() == 0:
            return new.select("node", F.col("p").alias("label"))
        f = new.select("node", "p")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
