"""Recall funnels, ranking metrics, audits and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scalars import inverse_log_rank


def rank_of_truth(truth: DataFrame, ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """Each user's true item and its rank, null where it isn't ranked. ``truth``: user_id, item_id."""
    return truth.join(ranked.select("user_id", "item_id", F.col(rank).alias("hit_rank")), ["user_id", "item_id"], "left")


def rank_in_lists(truth: DataFrame, lists: DataFrame) -> DataFrame:
    """``rank_of_truth`` from one list per user, which is not expanded. ``lists``: user_id, best (structs with item_id, best first)."""
    place = F.nullif(F.array_position(F.col("best.item_id"), F.col("item_id")), F.lit(0))
    return truth.join(lists, "user_id", "left").select("user_id", "item_id", place.alias("hit_rank"))


def hit_rate(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def ndcg(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, inverse_log_rank(rank)).otherwise(0.0))


def ranking_metrics(hits: DataFrame, k: int, *by: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_users"), F.round(hit_rate(F.col("hit_rank"), k), 6).alias("recall_at_k"), F.round(ndcg(F.col("hit_rank"), k), 6).alias("ndcg_at_k"))


def coverage(truth: DataFrame, top: DataFrame, popularity: DataFrame, tail_quantile: float = 0.8) -> DataFrame:
    """User and item coverage, the share of tail items among shown rows, and novelty (mean -log2 of an item's share of events)."""
    cut = popularity.agg(F.percentile("item_train_pop_count", F.lit(tail_quantile)).alias("cut"), F.sum("item_train_pop_count").alias("events"), F.count(F.lit(1)).alias("items"))
    shown = top.join(popularity, "item_id", "left").withColumn("pop", F.coalesce("item_train_pop_count", F.lit(1))).crossJoin(F.broadcast(cut))
    novelty = -F.log(F.col("pop") / F.col("events")) / F.log(F.lit(2.0))
    out = shown.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("shown_items"), F.max("items").alias("items"), F.avg((F.col("pop") <= F.col("cut")).cast("double")).alias("tail"), F.avg(novelty).alias("novelty"))
    return out.crossJoin(F.broadcast(truth.agg(F.count(F.lit(1)).alias("n")))).select(F.round(F.col("users") / F.col("n"), 6).alias("user_coverage"), F.round(F.col("shown_items") / F.col("items"), 6).alias("item_coverage"), F.round("tail", 6).alias("tail_coverage"), F.round("novelty", 6).alias("novelty"))


def recall_funnel(truth: DataFrame, everything: DataFrame, kept: DataFrame) -> DataFrame:
    """truth_in_all, truth_in_pretrim, pretrim_cut_loss, hard_miss."""
    both = truth.join(everything.select("user_id", "item_id", F.lit(1).alias("a")).distinct(), ["user_id", "item_id"], "left").join(kept.select("user_id", "item_id", F.lit(1).alias("p")).distinct(), ["user_id", "item_id"], "left")
    a, p = F.avg(F.coalesce("a", F.lit(0))), F.avg(F.coalesce("p", F.lit(0)))
    return both.agg(F.count(F.lit(1)).alias("n_users"), F.round(a, 6).alias("truth_in_all"), F.round(p, 6).alias("truth_in_pretrim"), F.round(a - p, 6).alias("pretrim_cut_loss"), F.round(1 - a, 6).alias("hard_miss"))


def rank_thresholds(hits: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Of the true items that are ranked, the share within each threshold."""
    return hits.where("hit_rank is not null").agg(F.count(F.lit(1)).alias("n_hits"), *[F.round(F.avg((F.col("hit_rank") <= k).cast("double")), 6).alias(f"within_{k}") for k in thresholds])


def pool_sizes(truth: DataFrame, kept: DataFrame) -> DataFrame:
    sizes = truth.select("user_id").join(kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("avg_pool"), F.percentile("n", F.lit(0.5)).cast("double").alias("median_pool"), F.max("n").cast("long").alias("max_pool"))


def route_attribution(truth: DataFrame, routes: DataFrame) -> DataFrame:
    """Per route: share of users whose true item it has at all, and it alone; the mean number of routes that have it is ``overlap``,
    the share of users whose item no route has ``zero_hit``."""
    found = truth.join(routes.select("user_id", "item_id", "source").distinct(), ["user_id", "item_id"])
    with_n = found.withColumn("n_routes", F.count(F.lit(1)).over(Window.partitionBy("user_id", "item_id")))
    total = truth.agg(F.count(F.lit(1)).alias("n_users"))
    out = with_n.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.sum((F.col("n_routes") == 1).cast("long")).alias("unique_hits"), F.avg("n_routes").alias("overlap"))
    missed = truth.join(found, ["user_id", "item_id"], "left_anti").agg(F.count(F.lit(1)).alias("missed"))
    return out.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(missed)).select("source", F.round(F.col("missed") / F.col("n_users"), 6).alias("zero_hit"), F.round(F.col("hits") / F.col("n_users"), 6).alias("any_hit"), F.round(F.col("unique_hits") / F.col("n_users"), 6).alias("unique_hit"), F.round("overlap", 6).alias("overlap"))


def list_change(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """Per user, the Jaccard similarity of two top-k lists, then its mean and the share of users whose first item changed."""
    one = before.where(F.col("rank") <= k).groupBy("user_id").agg(F.collect_set("item_id").alias("a"), F.max(F.when(F.col("rank") == 1, F.col("item_id"))).alias("a1"))
    two = after.where(F.col("rank") <= k).groupBy("user_id").agg(F.collect_set("item_id").alias("b"), F.max(F.when(F.col("rank") == 1, F.col("item_id"))).alias("b1"))
    both = one.join(two, "user_id")
    jaccard = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return both.agg(F.count(F.lit(1)).alias("n_users"), F.round(F.avg(jaccard), 6).alias("mean_jaccard"), F.round(F.avg((F.col("a1") != F.col("b1")).cast("double")), 6).alias("first_changed"))


def swap_rate(rows: DataFrame, before: str, after: str, k: int) -> DataFrame:
    """Of the first k places of either order, the share whose item the other has elsewhere or not at all; and the share of users
    whose positive is in the pool (what a perfect order could reach) and of those whose positive is in the first k before and after."""
    top = rows.where((F.col(before) <= k) | (F.col(after) <= k))
    swaps = top.agg(F.avg((F.col(before) != F.col(after)).cast("double")).alias("s"))
    user = rows.groupBy("user_id").agg(F.max("label").alias("reach"), F.max(F.when(F.col(before) <= k, F.col("label")).otherwise(0)).alias("b"), F.max(F.when(F.col(after) <= k, F.col("label")).otherwise(0)).alias("a"))
    return user.agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("reach", "oracle_recall"), ("b", "recall_before"), ("a", "recall_after"))]).crossJoin(F.broadcast(swaps)).select(F.round("s", 6).alias("swap_rate"), "oracle_recall", "recall_before", "recall_after")


def improved_degraded(hits_before: DataFrame, hits_after: DataFrame) -> DataFrame:
    both = hits_before.select("user_id", F.col("hit_rank").alias("b")).join(hits_after.select("user_id", F.col("hit_rank").alias("a")), "user_id")
    far = 1_000_000
    a, b = F.coalesce("a", F.lit(far)), F.coalesce("b", F.lit(far))
    return both.agg(F.sum((a < b).cast("long")).alias("improved"), F.sum((a > b).cast("long")).alias("degraded"), F.sum((a == b).cast("long")).alias("same"))


def calibration_bins(scored: DataFrame, n: int = 10, weight: str | None = None) -> DataFrame:
    """bin, n, mean score, share of positives and their distance; ``scored``: score in 0..1, label; ``weight``: how often a row counts."""
    bin_ = F.least(F.floor(F.col("score") * n), F.lit(n - 1)).cast("long")
    w = F.col(weight) if weight else F.lit(1.0)
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    return scored.withColumn("bin", bin_).groupBy("bin").agg(F.sum(w).cast("long").alias("n"), F.round(mean("score"), 6).alias("mean_score"), F.round(mean("label"), 6).alias("positive_rate"), F.round(F.abs(mean("score") - mean("label")), 6).alias("gap"))


def popularity_band(popularity: DataFrame, least: int = 10) -> DataFrame:
    """tail up to the 20 % quantile, head from the 80 % quantile, else mid; unknown with fewer than ``least`` items."""
    cuts = popularity.agg(F.percentile("item_train_pop_count", F.lit(0.2)).alias("low"), F.percentile("item_train_pop_count", F.lit(0.8)).alias("high"), F.count("item_train_pop_count").alias("known"))
    band = F.when(F.col("known") < least, "unknown").when(F.col("item_train_pop_count") <= F.col("low"), "tail").when(F.col("item_train_pop_count") >= F.col("high"), "head").otherwise("mid")
    return popularity.crossJoin(F.broadcast(cuts)).withColumn("pop_band", band).drop("low", "high", "known")
