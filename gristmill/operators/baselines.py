"""Popularity baselines and hybrids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_popular(train: DataFrame, groups: DataFrame, group: str, k: int) -> DataFrame:
    """Each group's k most frequent items: group, item_id, n, nth."""
    counts = train.join(groups, "item_id").groupBy(group, "item_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "item_id"))).where(F.col("nth") <= k)


def favourite_group(train: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    counts = train.join(groups, "item_id").groupBy("user_id", group).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), group))).where("nth = 1").select("user_id", group)


def group_popular_lists(train: DataFrame, users: DataFrame, groups: DataFrame, group: str, k: int) -> DataFrame:
    """The k most frequent items of each user's favourite group."""
    mine = users.join(favourite_group(train, groups, group), "user_id")
    return mine.join(group_popular(train, groups, group, k), group).select("user_id", "item_id", F.col("nth").alias("rank"))


def hybrid_by_activity(segments: DataFrame, heavy: DataFrame, light: DataFrame) -> DataFrame:
    """Heavy users get one list, the others the other. Lists: user_id, item_id, rank."""
    is_heavy = segments.where("user_segment = 'heavy'").select("user_id")
    return heavy.join(is_heavy, "user_id", "left_semi").unionByName(light.join(is_heavy, "user_id", "left_anti"))


def merged_list(first: Column, second: Column, k: int) -> Column:
    """The first list, then what the second adds, cut to k."""
    return F.slice(F.concat(first, F.filter(second, lambda x: ~F.array_contains(first, x))), 1, k)


def cluster_bonus(rows: DataFrame, bonus: float) -> DataFrame:
    """Ranks again after items of the user's favourite group got a bonus. ``rows``: user_id, item_id, score, in_favourite."""
    scored = rows.withColumn("boosted", F.round(F.col("score") + bonus * F.col("in_favourite"), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("boosted"), "item_id")))
