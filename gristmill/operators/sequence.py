"""Sequence and tower features of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scalars import dot


def recent_weights(events: DataFrame, n: int, decay: float) -> DataFrame:
    """Each user's n latest events with weight decay ** place."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("review_id")))
    return events.withColumn("nth", nth).where(F.col("nth") <= n).withColumn("w", F.pow(F.lit(decay), F.col("nth") - 1))


def tower_scores(candidates: DataFrame, train: DataFrame, rank: int = 16, reg: float = 0.1, alpha: float = 20.0, iterations: int = 5, seed: int = 42) -> DataFrame:
    """Two-tower scores: user and item factors learned from implicit events, their dot product per candidate, ranked by user. The
    factors are learned by alternating least squares where the data is, and are joined, never collected."""
    from pyspark.ml.recommendation import ALS

    events = train.select(F.col("user_id").cast("int").alias("u"), F.col("item_id").cast("int").alias("i"), F.lit(1.0).alias("r"))
    model = ALS(userCol="u", itemCol="i", ratingCol="r", implicitPrefs=True, alpha=alpha, rank=rank, maxIter=iterations, regParam=reg, seed=seed).fit(events)
    users = model.userFactors.select(F.col("id").cast("long").alias("user_id"), F.col("features").alias("u"))
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").alias("i"))
    scored = candidates.join(users, "user_id", "left").join(items, "item_id", "left").withColumn("tower_score", F.round(F.coalesce(dot(F.col("u"), F.col("i")), F.lit(0.0)), 6)).drop("u", "i")
    return scored.withColumn("tower_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("tower_score"), "item_id")))
