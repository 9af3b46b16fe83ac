"""Per-user relative features, group gaps, tag overlap, matches and text similarities. All are windows over one user partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scalars import dot, unit

def user() -> Window:
    return Window.partitionBy("user_id")


def average_rank(value: Column, group: Window) -> Column:
    """Ascending rank in which equal values share the mean of their places. ``group`` is an unordered window."""
    return F.rank().over(group.orderBy(value)) + (F.count(value).over(Window.partitionBy("user_id", value)) - 1) / 2


def percent_rank_average(value: Column) -> Column:
    return average_rank(value, user()) / F.count(value).over(user())


def rank_pct(value: Column) -> Column:
    """0 for the lowest, 1 for the highest; 0 in a group of one."""
    n = F.count(value).over(user())
    return F.when(n <= 1, 0.0).otherwise((average_rank(value, user()) - 1) / (n - 1))


def descending_rank_pct(rank: Column) -> Column:
    """1 for the first; 1 in a group of one."""
    n = F.count(rank).over(user())
    return F.when(n <= 1, 1.0).otherwise(1 - (rank - 1) / (n - 1))


def min_max(value: Column) -> Column:
    low, high = F.min(value).over(user()), F.max(value).over(user())
    return F.when(high <= low, 0.0).otherwise((value - low) / (high - low + 1e-9))


def z_sigmoid(value: Column) -> Column:
    """Population deviation; a flat group has z = 0."""
    std = F.stddev_pop(value).over(user())
    z = F.when(std > 1e-9, (value - F.avg(value).over(user())) / std).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def relative_features(rows: DataFrame, name: str) -> DataFrame:
    """Centred by mean, by median, z by sample deviation, percentile with mean ranks for ties."""
    v = F.col(name)
    std = F.coalesce(F.stddev_samp(v).over(user()), F.lit(0.0))
    return rows.withColumns({
        f"{name}_centered": v - F.avg(v).over(user()), f"{name}_median_gap": v - F.percentile(v, F.lit(0.5)).over(user()),
        f"{name}_z": F.when(std > 0, (v - F.avg(v).over(user())) / std).otherwise(0.0), f"{name}_pct": percent_rank_average(v),
    })


def group_gaps(rows: DataFrame, name: str, item: str = "item_id") -> DataFrame:
    """Distance to the user's best, mean, mean of the best 3 and of the best 10."""
    v, at = F.col(name), F.row_number().over(user().orderBy(F.desc(name), F.asc(item)))
    ranked = rows.withColumn("_at", at)
    top = lambda k: F.avg(F.when(F.col("_at") <= k, v)).over(user())
    return ranked.withColumns({f"{name}_gap_max": v - F.max(v).over(user()), f"{name}_gap_mean": v - F.avg(v).over(user()), f"{name}_gap_top3": v - top(3), f"{name}_gap_top10": v - top(10)}).drop("_at")


def frontier_margin(rows: DataFrame, score: str, rank: str, target: int) -> DataFrame:
    """Distance to the score at the target rank (to the last there is, in smaller groups)."""
    at = F.least(F.lit(target), F.max(rank).over(user()))
    return rows.withColumn("frontier", at).withColumn("margin", F.col(score) - F.max(F.when(F.col(rank) == F.col("frontier"), F.col(score))).over(user())).drop("frontier")


def tag_overlap(rows: DataFrame, liked: str, avoided: str, tags: str) -> DataFrame:
    """Counts, ratios, net score and a conflict flag of an item's tags against the user's liked and avoided ones."""
    pos, neg, n = F.size(F.array_intersect(liked, tags)), F.size(F.array_intersect(avoided, tags)), F.greatest(F.size(tags), F.lit(1))
    return rows.withColumns({"n_liked": pos, "n_avoided": neg, "liked_ratio": pos / n, "avoided_ratio": neg / n, "net": (pos - neg) / n, "conflict": ((pos > 0) & (neg > 0)).cast("int")})


def match_total(parts: dict[str, float]) -> Column:
    """A weighted mix of match columns; missing ones are 0."""
    out = F.lit(0.0)
    for name, weight in parts.items():
        out = out + weight * F.coalesce(F.col(name), F.lit(0.0))
    return out


def conflict_gap(positive: Column, negative: Column) -> Column:
    """How much nearer an item is to what the user likes than to what it avoids."""
    return positive - negative


def vector_similarities(rows: DataFrame, views: dict[str, tuple[str, str]]) -> DataFrame:
    """Cosine of each named pair of vector columns."""
    return rows.withColumns({name: dot(unit(F.col(a)), unit(F.col(b))) for name, (a, b) in views.items()})
