"""Batch serving: strategies with fallback, replay assembly, single-user scoring, latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order in which a strategy's scores are tried.
ATTEMPTS = {"reward_rerank": ("reward", "xgboost", "baseline"), "xgboost": ("xgboost", "baseline"), "baseline": ("baseline",)}


def serve(rows: DataFrame, strategy: str, k: int) -> DataFrame:
    """Each user's k best by the first score of the strategy that *all* of the user's rows have; ``used`` names it."""
    tries = ATTEMPTS[strategy]
    user = Window.partitionBy("user_id")
    ready = {t: F.min(F.col(f"{t}_score").isNotNull().cast("int")).over(user) == 1 for t in tries}
    used = F.coalesce(*[F.when(ready[t], F.lit(t)) for t in tries])
    score = F.coalesce(*[F.when(F.col("used") == t, F.col(f"{t}_score")) for t in tries])
    ranked = rows.withColumn("used", used).withColumn("served_score", score).withColumn("served_rank", F.row_number().over(user.orderBy(F.desc("served_score"), "item_id")))
    return ranked.where(F.col("served_rank") <= k)


def replay(scores: DataFrame, users: DataFrame, items: DataFrame, prefix: str = "replay") -> DataFrame:
    """Scores with user and item attributes and a request id."""
    joined = scores.join(users, "user_id", "left").join(items, "item_id", "left")
    return joined.withColumn("request_id", F.concat_ws("-", F.lit(prefix), F.col("user_id").cast("string")))


def latency_summary(rows: DataFrame, latency: str, *by: str) -> DataFrame:
    """Requests, mean, and linearly interpolated percentiles."""
    quantiles = [F.round(F.percentile(latency, F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(latency), 6).alias("mean"), *quantiles)
