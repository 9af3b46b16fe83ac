"""User and merchant profiles: sequences, dominant labels, preferences, states, evidence streams, tag sidecars, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_view(events: DataFrame, k: int) -> DataFrame:
    """Per user, over its k latest events: their number, counts by type (most frequent first), different items, days spanned, repeat ratio,
    dominant type (of equals the one that sorts first). ``events``: user_id, event_id, ts, item, event_type."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = events.withColumn("nth", nth).where(F.col("nth") <= k)
    kinds = recent.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "event_type")))
    kinds = kinds.groupBy("user_id").agg(pairs.alias("p")).select("user_id", F.col("p")[0]["event_type"].alias("dominant_type"), F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["event_type"], (-x["minus"]).cast("string"))), ",").alias("type_counts"))
    return recent.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("item").alias("n_items"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("span_days"),
        F.round(1 - F.countDistinct("item") / F.count(F.lit(1)), 6).alias("repeat_ratio"),
    ).join(kinds, "user_id")


def dominant_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Each key's most frequent non-empty label; of equals the one that sorts first."""
    counts = rows.where(F.coalesce(F.trim(label), F.lit("")) != "").groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    return counts.withColumn("nth", nth).where("nth = 1").select(key, F.col(label).alias("dominant"), F.col("n").alias("dominant_n"))


def preference_profile(rows: DataFrame, key: str, label: str, weight: Column, k: int) -> DataFrame:
    """Each key's k labels of greatest weight, with their share, rank and the margin of the first over the second.

    Weights are added in the order of their ranks, so that the last bit of a share, by which one like 0.625 is rounded, doesn't depend
    on how rows arrive. The SQL's engine adds them in that order, too, as it sorts once for both windows."""
    sums = rows.groupBy(key, label).agg(F.round(F.sum(weight), 9).alias("weight"))
    own = Window.partitionBy(key)
    order = own.orderBy(F.desc("weight"), label)
    total = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = sums.withColumn("share", F.col("weight") / total).withColumn("nth", F.row_number().over(order))
    first, second = F.max(F.when(F.col("nth") == 1, F.col("share"))).over(own), F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("share"))).over(own), F.lit(0.0))
    return ranked.withColumn("margin", first - second).where(F.col("nth") <= k)


def overlap_resolve(liked: Column, avoided: Column) -> tuple[Column, Column]:
    """What is both liked and avoided is neither."""
    return F.array_except(liked, avoided), F.array_except(avoided, liked)


def ratio_band(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio >= 0.66, "high").when(ratio >= 0.33, "medium").otherwise("low")


def density_band(n: Column) -> Column:
    return F.when(n <= 7, "sparse").when(n <= 17, "medium").otherwise("dense")


def density_cap(rows: DataFrame, key: str, order: list[Column], caps: dict[str, int]) -> DataFrame:
    """Each key's first rows, as many as its density band allows."""
    own = Window.partitionBy(key)
    band = density_band(F.count(F.lit(1)).over(own))
    cap = F.coalesce(*[F.when(F.col("band") == b, F.lit(c)) for b, c in caps.items()])
    return rows.withColumn("band", band).withColumn("nth", F.row_number().over(own.orderBy(*order))).where(F.col("nth") <= cap)


def merchant_segment(reviews: Column, mean: Column, deviation: Column) -> Column:
    return F.when(reviews < 10, "low_signal").when((mean >= 4) & (deviation < 1), "high_stable").when((mean >= 4) | (deviation >= 1.4), "high_controversial").when(mean >= 3, "mixed_reputation").otherwise("low_reputation")


def evidence_stream(rows: DataFrame, key: str, text: str, weight: str, ts: str, most: int) -> DataFrame:
    """Equal texts of a key merged (weights summed, latest time), then its ``most`` weightiest."""
    merged = rows.groupBy(key, text).agg(F.sum(weight).alias("weight"), F.max(ts).alias("ts"), F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), F.desc("ts"), text))
    return merged.withColumn("nth", nth).where(F.col("nth") <= most)


def tag_sidecar(rows: DataFrame, key: str, tag: str, polarity: Column, scale: float = 8.0) -> DataFrame:
    """Long tags with positive, negative and net weight, support and a confidence in 0..1."""
    pos, neg = F.sum((polarity > 0).cast("long")), F.sum((polarity < 0).cast("long"))
    out = rows.groupBy(key, tag).agg(pos.alias("pos"), neg.alias("neg"), F.count(F.lit(1)).alias("support"))
    net = (F.col("pos") - F.col("neg")) / F.col("support")
    return out.where("support >= 1").withColumn("net", F.round(net, 6)).withColumn("confidence", F.round(F.least(F.abs(net) * F.col("support") / scale, F.lit(1.0)), 6))


def item_strength(confidence: Column, refs: Column, snippets: Column) -> Column:
    return 0.45 * confidence + 0.35 * F.least(refs, F.lit(3)) / 3 + 0.20 * F.least(snippets, F.lit(2)) / 2


def quality_pool(accepted: Column, hard_fails: Column) -> Column:
    return F.when(hard_fails > 0, "reject").when(accepted >= 5, "quality_first").when(accepted >= 2, "balanced").otherwise("reject")


def pair_weight(source: Column, bucket: Column, slot: Column, decay: float = 0.8) -> Column:
    s = F.when(source == "observed", 1.0).when(source == "hard", 0.8).otherwise(0.5)
    b = F.when(bucket == "focus", 1.2).otherwise(1.0)
    return s * b * F.pow(F.lit(decay), slot)


def weight_summary(rows: DataFrame, key: str, weight: str, cap: float = 1.0) -> DataFrame:
    """Largest, capped sum, mean and mean of the two largest weights of a key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(weight)))
    ranked = rows.withColumn("nth", nth)
    return ranked.groupBy(key).agg(F.max(weight).alias("max_w"), F.least(F.sum(weight), F.lit(cap)).alias("capped_w"), F.avg(weight).alias("mean_w"), F.avg(F.when(F.col("nth") <= 2, F.col(weight))).alias("top2_w"))
