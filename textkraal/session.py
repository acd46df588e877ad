"""Spark session, table loading and the shared folder that lineage is cut in."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}


def get_session(app: str = "textkraal", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they needn't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).parent
    out = Path(tempfile.mkdtemp(prefix="textkraal-code-")) / "textkraal_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus; only the columns used later are read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset, on a local master only, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _FALLBACK:
        _FALLBACK[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="textkraal-")
    return _FALLBACK[sc.applicationId]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    The files survive the loss of any executor; release() deletes them. An empty df gives an empty table of the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textkraal/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that materialize() has written so far in this application, and say how many.

    For a caller that has written its results: DataFrames that read those tables can't be read afterwards.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
