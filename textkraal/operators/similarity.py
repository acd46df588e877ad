"""Exact joins on shared pieces of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkraal.functions.normalize import let, pieces


def char_grams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-case text with single spaces; a shorter text has none."""
    t = F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))
    return let(t, lambda x: F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, n)))).otherwise(F.array().cast("array<string>")))


def word_set(text: Column) -> Column:
    return F.array_distinct(pieces(F.lower(text)))


def set_similarity(left: DataFrame, right: DataFrame, threshold: float, left_key: str = "a", right_key: str = "b", strict: bool = True) -> DataFrame:
    """(a, b, jaccard) of the pairs of sets at or, if strict, above the threshold. Inputs: (key, items array).

    Prefix filter: in order of their number in both inputs only the rarest n - ceil(t * n) + 1 items of a set are
    indexed, so that no pair is lost and common items aren't joined; sizes must fit the threshold; the survivors'
    sets are compared in full. Empty and null sets take part in no pair.
    """
    l0, r0 = (d.select(F.col(k).alias(k), F.col("items")).where(F.size("items") > 0) for d, k in ((left, left_key), (right, right_key)))
    ex = lambda d, k: d.select(k, F.size("items").alias("n"), F.explode("items").alias("item"))
    le, re_ = ex(l0, left_key), ex(r0, right_key)
    df = le.select("item").union(re_.select("item")).groupBy("item").agg(F.count("*").alias("df"))
    keep = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1

    def prefix(d: DataFrame, k: str) -> DataFrame:
        d = d.join(df, "item").withColumn("pos", F.row_number().over(Window.partitionBy(k).orderBy("df", "item")))  # the items of one set
        return d.where(keep).select("item", k, F.col("n").alias(f"n_{k}"))

    p = prefix(le, left_key).join(prefix(re_, right_key), "item")
    small, large = F.least(f"n_{left_key}", f"n_{right_key}"), F.greatest(f"n_{left_key}", f"n_{right_key}")
    p = p.where(small >= threshold * large - 1e-9).select(left_key, right_key).distinct()
    x = p.join(l0.withColumnRenamed("items", "x"), left_key).join(r0.withColumnRenamed("items", "y"), right_key)
    both = F.size(F.array_intersect("x", "y"))
    x = x.withColumn("jaccard", both / (F.size("x") + F.size("y") - both))
    return x.where(F.col("jaccard") > threshold if strict else F.col("jaccard") >= threshold - 1e-12).select(left_key, right_key, "jaccard")


def containing(texts: DataFrame, parts: DataFrame, gram: int = 12) -> DataFrame:
    """(key, part_key) of the texts that contain a part. Inputs: texts(key, text), parts(part_key, part).

    A part meets only texts that hold its rarest gram, of `gram` characters or, where it is shorter, of 4 or 1. Empty
    and null parts take no part.
    """
    if gram > 1:
        shorter = 4 if gram > 4 else 1
        short = parts.where(F.length("part") < gram)
        if not short.limit(1).isEmpty():
            return containing(texts, parts.where(F.length("part") >= gram), gram=-gram).union(containing(texts, short, shorter))
    gram = abs(gram)
    grams = lambda c: let(c, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - gram + 1, F.lit(1))), lambda i: F.substring(x, i, gram)))
    p = parts.where(F.length("part") >= gram).select("part_key", "part", F.explode(F.array_distinct(grams(F.col("part")))).alias("g"))
    wanted = p.select("g").distinct()
    t = texts.select("key", F.explode(F.array_distinct(grams(F.col("text")))).alias("g")).join(wanted, "g")
    df = t.groupBy("g").agg(F.count("*").alias("df"))
    # a gram no text holds rules its part out; of the others the rarest is the one to join on
    rare = p.join(df, "g", "left").groupBy("part_key", "part").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r"))
    c = t.join(rare.where("r.df > 0").select("part_key", "part", F.col("r.g").alias("g")), "g").select("key", "part_key", "part").distinct()
    return c.join(texts, "key").where(F.contains("text", "part")).select("key", "part_key")
