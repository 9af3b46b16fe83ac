"""Structured rerank: features, calibration, blending and a linear scorer as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scalars import inverse_log_rank, sigmoid
from gristmill.operators.features import min_max


def rank_features(rows: DataFrame) -> DataFrame:
    """Null-safe counts, inverse ranks, flags and interactions of fused candidates."""
    inv = {f"{s}_rank_inv": inverse_log_rank(F.col(f"{s}_rank")) for s in ("als", "cluster", "profile", "popular", "context")}
    rows = rows.withColumns(inv | {"log_pop": F.log1p(F.coalesce("item_train_pop_count", F.lit(0))), "pre_rank_inv": inverse_log_rank(F.col("pre_rank"))})
    best = F.greatest(*[F.col(x) for x in inv])
    return rows.withColumns({"best_route_inv": best, "route_gap": best - F.col("pre_rank_inv"), "als_x_pop": F.col("als_rank_inv") * F.col("log_pop"), "multi_source": (F.col("source_count") >= 2).cast("int")})


def history_flags(history: DataFrame, short: int = 90, mid: int = 365, caps: tuple[int, int, int] = (3, 4, 3)) -> DataFrame:
    """Each user's latest short, mid and old events, at most ``caps`` of each, with recency 1, 0.5 and 0.2."""
    age = F.when(F.col("days_to_test") <= short, "short").when(F.col("days_to_test") <= mid, "mid").otherwise("old")
    nth = F.row_number().over(Window.partitionBy("user_id", "age").orderBy("days_to_test", F.desc("hist_ts"), F.desc("hist_rating"), "item_id"))
    cap = F.when(F.col("age") == "short", caps[0]).when(F.col("age") == "mid", caps[1]).otherwise(caps[2])
    kept = history.withColumn("age", age).withColumn("nth", nth).where(F.col("nth") <= cap)
    return kept.withColumn("recency", F.when(F.col("age") == "short", 1.0).when(F.col("age") == "mid", 0.5).otherwise(0.2))


def labels(rows: DataFrame, truth: DataFrame, valid_as_positive: bool = False) -> DataFrame:
    """label_true, label_valid and label. ``truth``: user_id, true_item, valid_item."""
    joined = rows.join(truth, "user_id", "left")
    hit = lambda c: F.coalesce((F.col("item_id") == F.col(c)).cast("int"), F.lit(0))
    joined = joined.withColumn("label_true", hit("true_item")).withColumn("label_valid", hit("valid_item"))
    label = F.greatest("label_true", "label_valid") if valid_as_positive else F.col("label_true")
    return joined.withColumn("label", label).drop("true_item", "valid_item")


def route_quality(rows: DataFrame, routes: tuple[str, ...], top: int = 200, prior: float = 200.0, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Per route, the smoothed hit rate of its first ``top`` ranks over the overall one, clipped. One pass, a row per route."""
    base = rows.agg(F.avg("label").alias("base")).crossJoin(F.broadcast(rows.agg(*[F.struct(F.sum(F.when(F.col(f"{r}_rank") <= top, F.col("label")).otherwise(0)).alias("hits"), F.sum((F.coalesce(F.col(f"{r}_rank"), F.lit(top + 1)) <= top).cast("long")).alias("n")).alias(r) for r in routes])))
    stacked = base.select("base", F.explode(F.array(*[F.struct(F.lit(r).alias("source"), F.col(r).alias("s")) for r in routes])).alias("x"))
    lift = (F.col("x.s.hits") + prior * F.col("base")) / (F.col("x.s.n") + prior) / F.col("base")
    return stacked.select(F.col("x.source").alias("source"), F.col("x.s.n").alias("n"), F.round(F.greatest(F.least(lift, F.lit(high)), F.lit(low)), 6).alias("lift"))


def route_factor(lifts: dict[str, float]) -> Column:
    """Mean lift of the row's sources; a source without a lift counts in the number but not in the sum."""
    total = F.lit(0.0)
    for source, lift in lifts.items():
        total = total + F.when(F.col(f"{source}_rank").isNotNull(), F.lit(float(lift))).otherwise(0.0)
    return F.when(F.col("source_count") > 0, total / F.col("source_count")).otherwise(1.0)


def blend(rows: DataFrame, prior: str, model: str, alpha: float, factor: Column | None = None, gamma: float = 0.25, top: int | None = None) -> DataFrame:
    """(1 - alpha) * prior * factor ** gamma + alpha * model, both scaled by user; beyond ``top`` the prior order stays."""
    base = min_max(F.col(prior)) * (F.pow(factor, F.lit(gamma)) if factor is not None else F.lit(1.0))
    rows = rows.withColumn("blend_score", F.round((1 - alpha) * base + alpha * F.col(model), 9))
    if top is None:
        return rows.withColumn("blend_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("blend_score"), "pre_rank", "item_id")))
    return rows.withColumn("blend_rank", F.row_number().over(Window.partitionBy("user_id").orderBy((F.col("pre_rank") > top).cast("int"), F.when(F.col("pre_rank") <= top, -F.col("blend_score")).otherwise(0.0), "pre_rank", "item_id")))


def blend_guard(rows: DataFrame, model: str, least_std: float = 0.015, least_spread: float = 0.06, least_unique: int = 20) -> DataFrame:
    """``guarded`` for all rows if the model's scores hardly differ (deviation, 5 % to 95 % spread, or different values at 6 places):
    then ``model_signal`` is the scores' rank in the user's list, 1 for the best, instead of the scores."""
    about = rows.agg(F.stddev_pop(model).alias("std"), (F.percentile(model, F.lit(0.95)) - F.percentile(model, F.lit(0.05))).alias("spread"), F.countDistinct(F.round(model, 6)).alias("different"))
    guard = about.select(((F.col("std") < least_std) | (F.col("spread") < least_spread) | (F.col("different") < least_unique)).alias("guarded"))
    user = Window.partitionBy("user_id")
    n = F.count(F.lit(1)).over(user)
    place = F.row_number().over(user.orderBy(F.desc(model), "item_id"))
    by_rank = F.when(n <= 1, 1.0).otherwise(1 - (place - 1) / (n - 1))
    return rows.crossJoin(F.broadcast(guard)).withColumn("model_signal", F.when(F.col("guarded"), by_rank).otherwise(F.col(model)))


def alpha_grid(rows: DataFrame, alphas: list[float], k: int) -> DataFrame:
    """alpha, recall_at_k, ndcg_at_k, best first: NDCG, then recall, then the smaller alpha. ``rows``: prior, model (0..1), label."""
    grid = rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")))
    score = F.round((1 - F.col("alpha")) * F.col("prior") + F.col("alpha") * F.col("model"), 9)
    at = F.row_number().over(Window.partitionBy("user_id", "alpha").orderBy(F.desc(score), "pre_rank", "item_id"))
    hits = grid.withColumn("at", at).groupBy("alpha", "user_id").agg(F.min(F.when(F.col("label") == 1, F.col("at"))).alias("hit"))
    return hits.groupBy("alpha").agg(F.round(F.avg(F.when(F.col("hit") <= k, 1.0).otherwise(0.0)), 6).alias("recall_at_k"), F.round(F.avg(F.when(F.col("hit") <= k, inverse_log_rank(F.col("hit"))).otherwise(0.0)), 6).alias("ndcg_at_k"))


def linear_score(model: dict[str, tuple[float, float, float, float]], bias: float) -> Column:
    """One expression: impute, standardise, add what a missing value is worth, sigmoid. ``model``: column -> weight, mean, std, missing weight."""
    z = F.lit(bias)
    for name, (weight, mean, std, missing) in model.items():
        value = F.coalesce(F.col(name).cast("double"), F.lit(mean))
        z = z + weight * (value - mean) / (std if std else 1.0) + F.when(F.col(name).isNull(), missing).otherwise(0.0)
    return sigmoid(z)


def platt(score: Column, a: float, b: float) -> Column:
    return sigmoid(a * score + b)


def residual(global_z: Column, bucket_z: Column, weight: float) -> Column:
    """A bucket's calibration shrunk to the global one."""
    return global_z + weight * (bucket_z - global_z)


def weighed(rows: DataFrame, *columns: str) -> DataFrame:
    """The different rows of ``columns`` with ``n``, how often each stands: a fit and its averages need no more than these."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("n"))


def fit_gbt(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42, weight: str | None = None):
    """Gradient-boosted trees on the label, trained where the data is. ``weight``: how often a row counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(rows)


def fit_logistic(rows: DataFrame, features: list[str], reg: float = 0.01, weight: str | None = None):
    """Logistic regression, also for Platt calibration (one feature) and for stacking (several ranks). ``weight``: how often a row counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
    from pyspark.ml.linalg import Vectors

    if weight is None:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label", regParam=reg)]).fit(rows)
    # MLlib's own scaling takes weights for how sure rows are, so its deviations are not those of the rows that the weights stand for.
    total = rows.agg(F.sum(weight).alias("n"), *[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(c) for c in features]).first()
    squares = rows.agg(*[F.sum(F.col(weight) * (F.col(c) - (total[c] or 0.0)) ** 2).alias(c) for c in features]).first()
    scale = [((total["n"] - 1) / squares[c]) ** 0.5 if squares[c] else 0.0 for c in features]
    stages = [VectorAssembler(inputCols=features, outputCol="plain"), ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="plain", outputCol="features")]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, weightCol=weight, standardization=False)]).fit(rows)


def positive_probability(scored: DataFrame, name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")
