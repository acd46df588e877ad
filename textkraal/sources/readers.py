"""Readers of text, JSON and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.language import strip


def text_lines(spark: SparkSession, path: str, drop_blank: bool = False) -> DataFrame:
    """(line) of all text files of a path; blank lines are kept unless dropped."""
    df = spark.read.text(path).select(F.col("value").alias("line"))
    return df.select(strip(F.col("line")).alias("line")).where("line <> ''") if drop_blank else df


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_records(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines under a fixed schema: unknown keys dropped, broken lines skipped, rows without a required value too."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    df = df.where("_bad is null").drop("_bad")
    for c in required:
        df = df.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return df


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, one object or a list of objects each; broken files are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())


def training_log(lines: DataFrame) -> DataFrame:
    """Step and epoch lines of a training log as columns; other lines are left out."""
    v = F.col("line")
    get = lambda p, t: F.regexp_extract(v, p, 1).try_cast(t)
    num = r"([0-9.]+(?:e[+-]?\d+)?)"
    return lines.select(
        F.when(v.contains("val_loss="), "epoch").when(v.contains("step"), "step").alias("kind"),
        F.coalesce(get(r"Ep\s+(\d+)/", "int"), get(r"\[epoch (\d+)/", "int")).alias("epoch"), get(r"step\s+(\d+)", "int").alias("step"),
        get(rf"\bloss\s+{num}", "double").alias("loss"), get(rf"avg\s+{num}", "double").alias("avg"), get(rf"lr\s+{num}", "double").alias("lr"),
        get(rf"val_loss={num}", "double").alias("val_loss"), get(rf"ppl={num}", "double").alias("ppl"),
    ).where("kind is not null and epoch is not null")
