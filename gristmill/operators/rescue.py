"""Bounded rescue reranking: band weights, score fusion, shortlist, frontier gate, stacking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scalars import bands
from gristmill.operators.features import min_max, user


@dataclass(frozen=True)
class Rescue:
    """The bands that may be rescued and what each is worth."""

    alpha: float = 0.12
    weights: dict = field(default_factory=lambda: {"011_030": 1.0, "031_060": 0.7, "061_100": 0.35})


def route_segment(rank: Column) -> Column:
    return bands(rank, [(10, "top10_anchor"), (30, "11-30"), (40, "31-40"), (60, "41-60"), (100, "61-100")], "unrouted")


def band_weight(rank: Column, how: Rescue) -> Column:
    w = how.weights
    return F.when(rank.between(11, 30), w["011_030"]).when(rank.between(31, 60), w["031_060"]).when(rank.between(61, 100), w["061_100"]).otherwise(0.0)


def rescue_fusion(rows: DataFrame, how: Rescue = Rescue()) -> DataFrame:  # noqa: B008
    """final_score and final_rank: the scaled base score plus alpha * scaled sidecar score * band weight, for ranks 11 to 100 that
    have a sidecar score. ``rows``: user_id, item_id, base_rank, base_score, sidecar_score."""
    bonus = how.alpha * F.coalesce(min_max(F.col("sidecar_score")), F.lit(0.0)) * band_weight(F.col("base_rank"), how)
    scored = rows.withColumn("rescue_bonus", F.round(bonus, 9)).withColumn("final_score", F.round(min_max(F.col("base_score")) + F.col("rescue_bonus"), 9))
    return scored.withColumn("final_rank", F.row_number().over(user().orderBy(F.desc("final_score"), "base_rank", "item_id")))


def shortlist(rows: DataFrame, score: str, top: int, per_band: int, size: int) -> DataFrame:
    """The best overall and the best of each band, filled up to the size by score."""
    at = F.row_number().over(user().orderBy(F.desc(score), "item_id"))
    in_band = F.row_number().over(Window.partitionBy("user_id", "band").orderBy(F.desc(score), "item_id"))
    marked = rows.withColumn("seed", ((at <= top) | (in_band <= per_band)).cast("int"))
    order = F.row_number().over(user().orderBy(F.desc("seed"), F.desc(score), "item_id"))
    return marked.withColumn("place", order).where(F.col("place") <= size)


def frontier_gate(rows: DataFrame, target: int, margin: float, cap: int) -> DataFrame:
    """A rescued row passes the target rank only by ``margin``; otherwise it stays behind it, and none rises above ``cap``."""
    frontier = F.max(F.when(F.col("base_rank") == target, F.col("final_score"))).over(user())
    passes = (F.col("base_rank") <= target) | (F.coalesce(F.col("final_score") - frontier, F.lit(-1.0)) >= margin)
    capped = F.when(F.col("base_rank") <= target, F.col("final_rank")).when(passes, F.greatest("final_rank", F.lit(cap))).otherwise(F.greatest("final_rank", F.col("base_rank")))
    return rows.withColumn("gate_pass", passes).withColumn("gated_rank", F.row_number().over(user().orderBy(capped, F.desc("final_score"), "item_id")))


def first_hit(rows: DataFrame, rank: str, k: int) -> DataFrame:
    """Per user, the rank of the first positive, null beyond k."""
    best = F.min(F.when(F.col("label") == 1, F.col(rank)))
    return rows.groupBy("user_id").agg(F.when(best <= k, best).alias("hit_rank"))


def gate(metrics: DataFrame, least_pretrim: float, most_cut: float, most_miss: float) -> DataFrame:
    """Whether a recall funnel is good enough to build on."""
    ok = (F.col("truth_in_pretrim") >= least_pretrim) & (F.col("pretrim_cut_loss") <= most_cut) & (F.col("hard_miss") <= most_miss)
    return metrics.withColumn("gate_pass", ok)
