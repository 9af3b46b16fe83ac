"""Temporal hold-out splits, dense ids, activity segments, item popularity and history before the test event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIGHT_MAX, MID_MAX = 7, 19


def recency_rank(events: DataFrame) -> DataFrame:
    """``rn``: 1 for a user's latest event, by (ts, review_id) descending."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("review_id"))
    return events.withColumn("rn", F.row_number().over(latest))


def leave_two_out(events: DataFrame, min_events: int) -> DataFrame:
    """``part`` for users with at least ``min_events`` events: the latest is test, the one before valid, the rest train.

    The count is a window over the same partitioning as the rank, so users are shuffled once and never joined back."""
    counted = events.withColumn("n_events", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where(F.col("n_events") >= min_events)
    part = F.when(F.col("rn") == 1, "test").when(F.col("rn") == 2, "valid").otherwise("train")
    return recency_rank(counted).withColumn("part", part).drop("n_events")


def leave_last_out(events: DataFrame) -> DataFrame:
    return recency_rank(events).withColumn("part", F.when(F.col("rn") == 1, "test").otherwise("train")).drop("rn")


def cold_items(split: DataFrame) -> DataFrame:
    """Items of test events that no train event has."""
    return split.where("part = 'test'").select("item_id").distinct().join(split.where("part = 'train'").select("item_id").distinct(), "item_id", "left_anti")


def index_ids(events: DataFrame, key: str) -> DataFrame:
    """(key, idx): 0 for the most frequent id; equal counts in ascending order of the id as text.

    A range-partitioned sort numbers each partition by itself and adds the sizes of those before it, so no task sees all ids."""
    counts = events.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = counts.repartitionByRange(F.desc("n"), F.asc(key)).withColumn("pid", F.spark_partition_id()).persist()
    sizes = sorted_.groupBy("pid").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("pid", F.coalesce(F.sum("size").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pid").orderBy(F.desc("n"), F.asc(key))
    # One row per partition of the sort, so the broadcast is bounded by the number of partitions.
    return sorted_.withColumn("at", F.row_number().over(inside)).join(F.broadcast(before), "pid").select(key, (F.col("before") + F.col("at") - 1).alias("idx"))


def segment(count: Column) -> Column:
    return F.when(count <= LIGHT_MAX, "light").when(count <= MID_MAX, "mid").otherwise("heavy")


def user_segments(train: DataFrame) -> DataFrame:
    return train.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_train_count")).withColumn("user_segment", segment(F.col("user_train_count")))


def item_popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_train_pop_count"))


def train_history(train: DataFrame, test: DataFrame, half_days: float = 180.0) -> DataFrame:
    """The latest train event of each (user, item) at least a day before the user's test event; its weight decays with the days."""
    anchor = test.select("user_id", F.col("ts").alias("test_ts"))
    days = F.datediff("test_ts", "ts")
    aged = train.join(anchor, "user_id").withColumn("days_to_test", days).where("days_to_test >= 1")
    latest = aged.groupBy("user_id", "item_id").agg(F.max_by(F.struct("ts", "rating", "days_to_test"), F.struct("ts", "review_id")).alias("last"))
    return latest.select("user_id", "item_id", F.col("last.ts").alias("hist_ts"), F.col("last.rating").alias("hist_rating"), F.col("last.days_to_test").cast("long").alias("days_to_test"), F.exp(-F.col("last.days_to_test") / half_days).alias("hist_recency_w"))


def hash_split(key: Column, eval_percent: int) -> Column:
    """"eval" for a fixed share of keys by their value, which no partitioning changes."""
    return F.when(F.pmod(key.cast("long"), F.lit(100)) < eval_percent, "eval").otherwise("train")
