"""Fusing routes into one candidate list per user, and cutting it to size in layers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scalars import inverse_log_rank

SOURCES = ("als", "cluster", "popular", "profile", "context")

# Route weights by user segment, in the order of SOURCES.
SOURCE_WEIGHTS = {
    "light": (0.45, 0.25, 0.15, 0.15, 0.14),
    "mid": (0.70, 0.15, 0.08, 0.07, 0.08),
    "heavy": (0.85, 0.08, 0.03, 0.04, 0.05),
}


@dataclass(frozen=True)
class FusionPolicy:
    """Fixed values of the fusion."""

    quality: float = 0.04
    semantic: float = 0.03
    backbone: float = 0.35
    backbone_top: dict = field(default_factory=lambda: {"light": 3, "mid": 5, "heavy": 8})
    support_cap: float = 60.0
    richness_cap: float = 8.0
    richness_blend: float = 0.25
    keep: dict = field(default_factory=lambda: {"light": 150, "mid": 150, "heavy": 150})
    als_safety: int = 20


@dataclass(frozen=True)
class Layers:
    """Tier quotas and rank limits of the layered cut."""

    front: int = 120
    rescue: int = 20
    rescue_max_rank: int = 400
    l1: int = 180
    l2: int = 130
    l3: int = 70
    l1_ranks: tuple[int, int, int] = (110, 65, 65)  # als, cluster, profile
    l2_ranks: tuple[int, int, int] = (260, 180, 180)
    challenger: int = 0
    lane: int = 0
    lane_max_rank: int = 300
    lane_max_pop: float = 60.0


def by_segment(values: dict[str, float], default: float = 0.0) -> Column:
    return F.coalesce(*[F.when(F.col("user_segment") == s, F.lit(float(v))) for s, v in values.items()], F.lit(float(default)))


def source_weight() -> Column:
    cases = [F.when((F.col("user_segment") == s) & (F.col("source") == n), F.lit(w)) for s, row in SOURCE_WEIGHTS.items() for n, w in zip(SOURCES, row, strict=True)]
    return F.coalesce(*cases, F.lit(0.0))


def quality_score(stars: Column, reviews: Column) -> Column:
    gate = F.least(F.log(F.coalesce(reviews, F.lit(0)) + 1.0) / F.log(F.lit(501.0)), F.lit(1.0))
    return F.coalesce(stars, F.lit(0.0)) / 5.0 * gate


def score_sources(candidates: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """source_norm, source_weight, signal_score, quality_score of each route's row. ``users``: user_id, user_segment; ``items``:
    item_id, stars, review_count, item_train_pop_count and whatever else is carried."""
    joined = candidates.join(users, "user_id", "left").join(items, "item_id", "left")
    scored = joined.withColumn("source_norm", inverse_log_rank(F.col("source_rank"))).withColumn("source_weight", source_weight())
    signal = F.col("source_weight") * F.col("source_norm") * F.coalesce("source_confidence", F.lit(1.0))
    return scored.withColumn("signal_score", signal).withColumn("quality_score", quality_score(F.col("stars"), F.col("review_count")))


def fuse(scored: DataFrame) -> DataFrame:
    """One row per (user, item): summed signal, best quality, the set of sources (sorted), and the best rank of each.

    A user has one segment, so it is a key; the set of sources is read off their ranks. What is aggregated are numbers only, which
    hash aggregation holds in place, and no row carries a list through the shuffle."""
    ranks = [F.min(F.when(F.col("source") == s, F.col("source_rank"))).alias(f"{s}_rank") for s in SOURCES]
    fused = scored.groupBy("user_id", "item_id", "user_segment").agg(F.sum("signal_score").alias("signal_score"), F.max("quality_score").alias("quality_score"), F.max("item_train_pop_count").alias("item_train_pop_count"), *ranks)
    present = F.array(*[F.when(F.col(f"{s}_rank").isNotNull(), F.lit(s)) for s in sorted(SOURCES)])
    return fused.withColumn("source_set", F.array_compact(present))


def source_flags(fused: DataFrame) -> DataFrame:
    """has_<source>, source_count, nonpopular_source_count, profile_cluster_source_count; a rank is there just where the source is."""
    has = {s: F.col(f"{s}_rank").isNotNull().cast("double") for s in SOURCES}
    return fused.withColumns(
        {f"has_{s}": c for s, c in has.items()}
        | {"source_count": sum(list(has.values())[1:], has["als"]), "nonpopular_source_count": has["als"] + has["cluster"] + has["profile"] + has["context"], "profile_cluster_source_count": has["cluster"] + has["profile"]}
    )


def semantic_gates(fused: DataFrame, policy: FusionPolicy) -> DataFrame:
    """semantic_effective_score: score * confidence, behind a log gate by support and a linear one by tag richness."""
    support = F.least(F.log(F.col("semantic_support") + 1.0) / F.log(F.lit(policy.support_cap + 1)), F.lit(1.0))
    rich = F.least(F.col("semantic_tag_richness") / policy.richness_cap, F.lit(1.0))
    score = F.col("semantic_score") * F.col("semantic_confidence") * support * (1 - policy.richness_blend + policy.richness_blend * rich)
    return fused.withColumn("semantic_support_gate", support).withColumn("semantic_effective_score", score)


def debias(fused: DataFrame, item_cap: float = 200.0, floor: float = 0.6, power: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """Popularity gate, its inverse, support adjusted by popularity, and the multiplier of the factorisation backbone."""
    pop = F.coalesce("item_train_pop_count", F.lit(0))
    gate = F.least(F.log(pop + 1.0) / F.log(F.lit(item_cap + 1)), F.lit(1.0))
    log2 = F.log(pop + 2.0) / F.log(F.lit(2.0))
    alone = (F.col("profile_cluster_source_count") <= 0.5).cast("double")
    heavy = (F.col("user_segment") == "heavy").cast("double")
    mult = F.greatest(F.lit(floor), 1 - 0.25 * gate - 0.1 * gate * heavy - 0.15 * gate * alone)
    return fused.withColumns({"item_pop_gate": gate, "item_pop_inv": 1 / log2, "als_backbone_mult": mult, "semantic_support_adj": F.col("semantic_support") / F.pow(F.greatest(log2, F.lit(1.0)), F.lit(alpha)), "quality_gate": floor + (1 - floor) * F.pow(gate, F.lit(power))})


def pre_score(fused: DataFrame, policy: FusionPolicy) -> DataFrame:
    """signal + quality + semantics + what the factorisation's first ranks are worth."""
    near = F.col("als_rank").isNotNull() & (F.col("als_rank") <= by_segment(policy.backbone_top))
    backbone = F.when(near, policy.backbone * inverse_log_rank(F.col("als_rank"))).otherwise(0.0)
    semantic = F.coalesce(F.col("semantic_effective_score"), F.lit(0.0)) if "semantic_effective_score" in fused.columns else F.lit(0.0)
    return fused.withColumn("als_backbone_score", backbone).withColumn("pre_score", F.round(F.col("signal_score") + policy.quality * F.col("quality_score") + policy.semantic * semantic + F.col("als_backbone_score"), 9))


def head_score(fused: DataFrame, source_weight: float = 0.02, source_cap: int = 2, rank_weight: float = 0.03, rank_cap: int = 30, popular_penalty: float = 0.02) -> DataFrame:
    """pre_score, more for several sources and for good profile and cluster ranks, less for popular items that nothing else brings."""
    several = source_weight * F.least(F.greatest(F.col("source_count") - 1, F.lit(0.0)), F.lit(float(source_cap)))
    near = lambda s: F.when(F.col(f"{s}_rank") <= rank_cap, rank_weight * inverse_log_rank(F.col(f"{s}_rank"))).otherwise(0.0)
    only = F.when((F.col("has_popular") > 0.5) & (F.col("source_count") <= 1), popular_penalty).otherwise(0.0)
    return fused.withColumn("head_score", F.round(F.col("pre_score") + several + near("profile") + near("cluster") - only, 9))


def _or_zero(fused: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in fused.columns else F.lit(0.0)


#: What each piece of personal evidence is worth in the challenger score; columns that a table lacks count 0.
CHALLENGER = {
    "profile_mv_evidence_score": 1.0, "semantic_effective_score": 0.16, "semantic_support_gate": 0.10, "tower_inv": 0.16, "seq_inv": 0.12,
    "nonpopular_source_count": 0.04, "profile_mv_route_count": 0.03, "profile_cluster_source_count": 0.05, "item_pop_inv": 0.10, "item_pop_gate": -0.08, "has_popular": -0.04,
}


def challenger_score(fused: DataFrame, max_rank: int = 300, max_pop: float = 60.0, min_semantic: float = 0.0) -> DataFrame:
    """The score of items that personal evidence speaks for and popularity doesn't, and whether a row may challenge."""
    ok = (F.col("pre_rank") <= max_rank) & (F.col("item_train_pop_count") <= max_pop) & (F.col("nonpopular_source_count") >= 1) & (F.col("profile_cluster_source_count") >= 1) & (F.col("has_popular") < 0.5)
    if "semantic_score" in fused.columns:
        ok = ok & (F.col("semantic_score") >= min_semantic)
    score = 0.32 * inverse_log_rank(F.col("profile_rank")) + 0.16 * inverse_log_rank(F.col("cluster_rank"))
    for name, weight in CHALLENGER.items():
        if name in fused.columns:
            score = score + weight * _or_zero(fused, name)
    return fused.withColumn("challenger_ok", ok).withColumn("challenger_score", F.when(ok, F.round(score, 9)).otherwise(0.0))


def head_bonus(fused: DataFrame, bonus: float) -> DataFrame:
    """Ranked again with what challengers get on top of their head score."""
    seeded = fused.withColumnRenamed("head_score", "head_seed").withColumn("head_score", F.round(F.col("head_seed") + F.when(F.col("challenger_ok"), bonus).otherwise(0.0), 9)).drop("pre_rank")
    return rank_candidates(seeded, F.desc("head_score"), F.desc("head_seed"), F.desc("pre_score"))


def rank_candidates(fused: DataFrame, *order: Column, name: str = "pre_rank") -> DataFrame:
    return fused.withColumn(name, F.row_number().over(Window.partitionBy("user_id").orderBy(*order, F.asc("item_id"))))


def flat_cut(ranked: DataFrame, policy: FusionPolicy) -> DataFrame:
    """The first ranks by segment, and what the factorisation ranks highest."""
    return ranked.where((F.col("pre_rank") <= by_segment(policy.keep, 150)) | (F.col("als_rank") <= policy.als_safety))


def layered_cut(ranked: DataFrame, layers: Layers, policy: FusionPolicy) -> DataFrame:
    """The layered cut; ``pre_rank`` becomes the rank in the new order.

    Tiers: challengers (``challenger_score``, where the table has it), the profile lane (brought by several profile routes, not too
    popular), rescue (agreed on by profile or cluster and another route), L1 and L2 (a route ranks it well), L3. Seeds are the front
    guard and each tier's quota; a tier's ranks are counted over all its rows, so front-guard rows use up quota. The rest fills up
    to the user's size, with the priority of L2 seeds; the safety rows of the factorisation stay beyond that size if they are in
    the pool. Every step is a window over the user, so the rows are shuffled once."""
    within = lambda limits: (F.col("als_rank") <= limits[0]) | (F.col("cluster_rank") <= limits[1]) | (F.col("profile_rank") <= limits[2])
    rescue = (F.col("pre_rank") > layers.front) & (F.col("pre_rank") <= layers.rescue_max_rank) & (F.col("nonpopular_source_count") >= 2) & (F.col("profile_cluster_source_count") >= 1)
    beyond = F.col("pre_rank") > layers.front
    challenger = beyond & F.col("challenger_ok") if layers.challenger and "challenger_ok" in ranked.columns else F.lit(False)
    lane = beyond & (F.col("pre_rank") <= layers.lane_max_rank) & (_or_zero(ranked, "profile_mv_route_count") >= 1) & (F.col("item_train_pop_count") <= layers.lane_max_pop) & (F.col("profile_cluster_source_count") >= 1) & (F.col("has_popular") < 0.5) if layers.lane else F.lit(False)
    tier = F.when(challenger, 0).when(lane, 1).when(rescue, 2).when(F.coalesce(within(layers.l1_ranks), F.lit(False)), 3).when(F.coalesce(within(layers.l2_ranks), F.lit(False)), 4).otherwise(5)
    lane_score = _or_zero(ranked, "profile_mv_evidence_score") + inverse_log_rank(F.col("profile_rank")) + 0.1 * _or_zero(ranked, "profile_mv_route_count")
    rescue_score = inverse_log_rank(F.col("profile_rank")) + inverse_log_rank(F.col("cluster_rank")) + 0.75 * inverse_log_rank(F.col("als_rank")) + 0.03 * F.col("nonpopular_source_count") + 0.01 * F.col("source_count")
    user = Window.partitionBy("user_id")
    rows = ranked.withColumn("tier", tier).withColumn("tier_score", F.when(F.col("tier") == 0, _or_zero(ranked, "challenger_score")).when(F.col("tier") == 1, F.round(lane_score, 9)).when(F.col("tier") == 2, F.round(rescue_score, 9)).otherwise(0.0))
    rows = rows.withColumn("tier_rank", F.row_number().over(Window.partitionBy("user_id", "tier").orderBy(F.desc("tier_score"), "pre_rank", "item_id")))
    front = F.col("pre_rank") <= layers.front
    quota = F.element_at(F.create_map(*[F.lit(x) for x in (0, layers.challenger, 1, layers.lane, 2, layers.rescue, 3, layers.l1, 4, layers.l2, 5, layers.l3)]), F.col("tier"))
    rows = rows.withColumn("seed", front | (F.col("tier_rank") <= quota)).withColumn("size", by_segment(policy.keep, 150).cast("int"))
    rows = rows.withColumn("seeds", F.sum(F.col("seed").cast("int")).over(user)).withColumn("rest_rank", F.row_number().over(Window.partitionBy("user_id", "seed").orderBy("pre_rank", "item_id")))
    pool = rows.where(F.col("seed") | (F.col("rest_rank") <= F.greatest(F.col("size") - F.col("seeds"), F.lit(0))))
    priority = F.when(~F.col("seed"), 5).when(front, 0).otherwise(F.col("tier") + 1)
    place = F.when(~F.col("seed"), F.col("rest_rank")).when(front, F.col("pre_rank")).otherwise(F.col("tier_rank"))
    pool = pool.withColumn("layered_rank", F.row_number().over(user.orderBy(priority, place, "pre_rank", "item_id")))
    kept = pool.where((F.col("layered_rank") <= F.col("size")) | (F.col("als_rank") <= policy.als_safety))
    return kept.withColumn("pre_rank", F.col("layered_rank")).drop("tier", "tier_score", "tier_rank", "seed", "size", "seeds", "rest_rank", "layered_rank")
