"""Readers and writers: format by suffix, partial scans, run folders, partitioned and capped sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, under ``spark.checkpoint.dir``. Where that is unset, a local one if all tasks
    run in this process (tests), and an error if they run elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "gristmill-io")
    return f"{root.rstrip('/')}/io-{uuid.uuid4().hex}"


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .csv (with header), .json/.jsonl, .orc; anything else is Parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".csv"):
        return reader.csv(path, header=True, inferSchema=schema is None)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    if path.endswith(".orc"):
        return reader.orc(path)
    return reader.parquet(path)


def read_parts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n part files of a folder, by name."""
    files = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect())
    return spark.read.parquet(*files[:n])


def ingest_json(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Newline JSON to Parquet once; a target that is there already is read as it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
        spark.read.json(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def optional(df: DataFrame, name: str, kind: str, default: object = None):
    """The column cast to ``kind``, or the default where the table lacks it."""
    return (F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)).alias(name)


def write_parquet(df: DataFrame, path: str, max_records: int = 300_000, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_hashed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One folder per hash bucket of the key, dealt by the same hash so that each folder has one file."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """One file with a header; for results of a bounded size."""
    df.coalesce(1).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def latest_run(spark: SparkSession, root: str, suffix: str) -> str | None:
    """The run folder ``<id><suffix>`` of greatest name under ``root``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName().endswith(suffix)] if fs.exists(base) else []
    return f"{root}/{max(found)}" if found else None


def write_pointer(spark: SparkSession, pointer: str, run: str) -> None:
    """Name the run that readers are to use, as a one-row JSON folder."""
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(pointer)


def pointed_run(spark: SparkSession, pointer: str) -> str | None:
    """The run that a pointer names, null where it names none."""
    rows = spark.read.schema("run string").json(pointer).limit(1).collect()
    return rows[0]["run"] if rows else None


def write_audit(rows: DataFrame, path: str, about: dict[str, str]) -> None:
    """An audit's rows as Parquet under ``rows``, and what it is about, with their number, as JSON under ``meta``."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    spark = rows.sparkSession
    n = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(k, v) for k, v in {**about, "rows": str(n)}.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
