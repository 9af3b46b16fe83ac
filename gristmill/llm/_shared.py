"""What the training-data operators have in common: intermediate tables, folds and safe input columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local folder if all tasks run in
    this process (tests), and an error if they run elsewhere, since other machines could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "gristmill-shared")
    return path.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends, a lost executor costs no recompute."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``write_table`` that no plan will read any more: what was made from them has been written itself."""
    for df in tables:
        if path := getattr(df, "_written", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; null keys get null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def hash_limit(bound: int, n: int) -> int:
    """The greatest 64-bit hash of a share of ``bound`` in ``n``: of n keys, about ``bound`` hash to it or below, at any n."""
    return min((1 << 63) - 1, -(1 << 63) + ((1 << 64) * bound) // max(n, 1))


def sample_hash(*key: Column) -> Column:
    return F.xxhash64(*key, F.lit(20_011))


def bounded_share(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of ``df`` by a keyed hash (all of them when there are fewer); used only to fit models."""
    n = df.count()
    return df if n <= bound else df.where(sample_hash(key) <= hash_limit(bound, n))
