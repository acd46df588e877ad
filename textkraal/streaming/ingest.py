"""Structured Streaming over delivered lines: what an mtime-polling loop does, as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.language import language_v1
from textkraal.session import shared_dir

SCHEMA = "line_id bigint, batch string, received_at timestamp_ntz, payload string"


def delivered(spark: SparkSession, path: str, late: str = "30 days") -> DataFrame:
    """A stream of (record_id, text, received_at, language_class): whole payloads, the first of each record_id.

    Lines without a time can't be told late from early and are left out; a repeat of a record_id within `late` is dropped,
    and the state kept for it is given up after that time.
    """
    lines = spark.readStream.schema(SCHEMA).parquet(path).where("received_at is not null and payload is not null")
    j = lines.select(F.col("received_at").cast("timestamp").alias("received_at"), F.try_parse_json("payload").alias("j")).where("j is not null")
    r = j.select("received_at", F.try_variant_get("j", "$.record_id", "string").alias("record_id"), F.try_variant_get("j", "$.text", "string").alias("text"))
    r = r.where("record_id is not null").withWatermark("received_at", late).dropDuplicatesWithinWatermark(["record_id"])
    return r.withColumn("language_class", language_v1(F.col("text")))


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, language_class, lines) of all that has arrived so far, as a table; reads what is there and stops."""
    lines = spark.readStream.schema(SCHEMA).parquet(path).where("received_at is not null")
    text = F.try_variant_get(F.try_parse_json("payload"), "$.text", "string")
    d = lines.select(F.date_format("received_at", "yyyy-MM-dd").alias("day"), language_v1(text).alias("language_class"))
    g = d.groupBy("day", "language_class").agg(F.count("*").alias("lines"))
    place = f"{shared_dir(spark)}/textkraal/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")

    g.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day string, language_class string, lines bigint").parquet(f"{place}/out")
