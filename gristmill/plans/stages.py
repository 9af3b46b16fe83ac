"""Queries: rich negatives, rivals and slates, profile and merchant assets, audits, cohorts, snippets, relabelling, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.scalars import learned_rank_band, scaled_round
from gristmill.operators import assets, baselines, cohorts, features, metrics, profiles, ranking, rescue, sampling, selection, split, text
from gristmill.plans.recall import floats, out, settled, types
from gristmill.plans.registry import query
from gristmill.plans.rerank import small
from gristmill.plans.sql import SETTLED, cte
from gristmill.sources import tables


def picks(name: str, base: str, keys: str, buckets: list[tuple[str, str, str, int]], budget: int) -> str:
    """Registers the expressions of a bucket selection over ``base``: (name, condition, order, quota) in turn; the last one's name."""
    last = f"{name}_0"
    cte(**{last: f"SELECT *, CAST(NULL AS INT) AS b, CAST(NULL AS BIGINT) AS bn FROM {base}"})
    for i, (_, able, order, quota) in enumerate(buckets):
        free = f"(b IS NULL AND coalesce({able}, false))"
        cte(**{f"{name}_{i + 1}": f"SELECT * EXCLUDE (b, bn, f, pos), CASE WHEN f AND pos <= {quota} THEN {i} ELSE b END AS b, CASE WHEN f AND pos <= {quota} THEN pos ELSE bn END AS bn FROM (SELECT *, {free} AS f, row_number() OVER (PARTITION BY {keys}, {free} ORDER BY {order}) AS pos FROM {last})"})
        last = f"{name}_{i + 1}"
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, *_) in enumerate(buckets))
    cte(**{name: f"SELECT * EXCLUDE (b, bn), CASE b {names} END AS bucket, row_number() OVER (PARTITION BY {keys} ORDER BY b, bn) AS pick_order FROM {last} WHERE b IS NOT NULL QUALIFY pick_order <= {budget}"})
    return name


RICH = selection.RichNegatives()
cte(
    disliked="SELECT user_id, item_id, min(hist_rating) AS low_rating, max(hist_ts) AS low_ts FROM history WHERE hist_rating <= 2 GROUP BY user_id, item_id",
    rich_pool="SELECT r.*, low_rating, low_ts FROM (SELECT *, min(CASE WHEN label = 1 THEN pre_rank END) OVER (PARTITION BY user_id) AS best_rank, max(CASE WHEN label = 1 THEN pre_score END) OVER (PARTITION BY user_id) AS best_score FROM small_rows) r LEFT JOIN disliked d ON d.user_id = r.user_id AND d.item_id = r.item_id WHERE label = 0",
)
picks(
    "rich_picks", "rich_pool", "user_id",
    [
        ("observed_dislike", "low_rating IS NOT NULL", "low_rating, low_ts DESC NULLS LAST, pre_rank, item_id", 2), ("hard", "pre_rank <= 20", "pre_rank, pre_score DESC, item_id", 4),
        ("near", "abs(pre_rank - best_rank) <= 10", "round(abs(pre_score - best_score), 9), pre_rank, item_id", 3), ("mid", "pre_rank > 20 AND pre_rank <= 60", "pre_rank, pre_score DESC, item_id", 3),
        ("tail", "pre_rank > 60", "pre_rank DESC, pre_score, item_id", 2), ("fill", "true", "pre_rank, pre_score DESC, item_id", 16),
    ], 16,
)


@query("SELECT user_id, item_id, bucket, pick_order FROM rich_picks")
def h4_rich_negatives(b):
    return out(selection.rich_negatives(small(b), b.history, RICH).select("user_id", "item_id", "bucket", "pick_order"))


cte(
    rival_rows="SELECT f.user_id, f.item_id AS focus, r.item_id AS rival, f.pre_rank AS focus_rank, r.pre_rank AS rival_rank, r.pre_rank < f.pre_rank AS outranks, abs(r.pre_rank - f.pre_rank) AS rank_gap, r.category = f.category AS same_category, round(r.head_score - f.head_score, 9) AS hardness, CASE WHEN f.pre_rank <= 10 THEN 'head_guard' WHEN f.pre_rank <= 30 THEN 'boundary_11_30' WHEN f.pre_rank <= 60 THEN 'rescue_31_60' WHEN f.pre_rank <= 100 THEN 'rescue_61_100' ELSE 'outside' END AS band FROM small_rows f JOIN small_rows r ON r.user_id = f.user_id AND f.label = 1 AND r.label = 0",
    deep_rivals="SELECT * FROM rival_rows WHERE band IN ('rescue_31_60', 'rescue_61_100')",
)
picks(
    "boundary_picks", "rival_rows", "user_id, focus",
    [
        ("topk_incumbent", "outranks AND rival_rank <= 10", "rival_rank, rival", 3), ("competition_confuser", "outranks AND same_category", "hardness DESC, rival_rank, rival", 3),
        ("fit_risk_confuser", "rank_gap <= 10", "rank_gap, rival_rank, rival", 2), ("semantic_confuser", "same_category", "rival_rank, rival", 2), ("fill", "true", "hardness DESC, rival_rank, rival", 12),
    ], 12,
)
_OWN = "(CASE WHEN band = 'rescue_31_60' THEN rival_rank BETWEEN 31 AND 60 ELSE rival_rank BETWEEN 61 AND 100 END)"
for _v, _plan in enumerate([[(_OWN, 2), ("rival_rank BETWEEN 11 AND 30", 1)], [(_OWN, 1), ("rival_rank BETWEEN 11 AND 30", 1), ("rival_rank BETWEEN 1 AND 10", 1)], [(_OWN, 1), ("rival_rank BETWEEN 31 AND 60", 1), ("rival_rank BETWEEN 11 AND 30", 1)]]):
    picks(f"slate_{_v}", "deep_rivals", "user_id, focus", [*[(f"plan_{i}", able, "rank_gap, rival_rank, rival", n) for i, (able, n) in enumerate(_plan)], ("fill", "true", "rank_gap, rival_rank, rival", 4)], 4)
cte(
    plain_slates="SELECT user_id, focus, rival, 'ranked' AS bucket, pos // 4 AS variant, pos % 4 + 1 AS pick_order, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, focus ORDER BY hardness DESC, rival_rank, rival) - 1 AS pos, count(*) OVER (PARTITION BY user_id, focus) AS n FROM rival_rows WHERE band NOT IN ('rescue_31_60', 'rescue_61_100')) WHERE pos // 4 < 3 AND (pos // 4 = 0 OR (pos // 4 + 1) * 4 <= n)",
    all_slates=" UNION ALL ".join(f"SELECT user_id, focus, rival, bucket, {v}::BIGINT AS variant, pick_order FROM slate_{v}" for v in range(3)) + " UNION ALL SELECT user_id, focus, rival, bucket, variant::BIGINT, pick_order::BIGINT FROM plain_slates",
)


def paired(b):
    return b.keep("pairs", lambda: selection.rivals(small(b).withColumn("score", F.col("head_score"))))


@query("SELECT user_id, focus, rival, bucket, pick_order FROM boundary_picks")
def h6_boundary_rivals(b):
    return out(selection.boundary_rivals(paired(b), 12).select("user_id", "focus", "rival", "bucket", "pick_order"))


@query("SELECT user_id, focus, rival, bucket, variant, pick_order FROM all_slates")
def h6_listwise_slates(b):
    return out(selection.listwise_slates(paired(b), 4, 3).select("user_id", "focus", "rival", "bucket", "variant", "pick_order"))


@query("SELECT user_id, item_id, CASE WHEN (SELECT stddev_pop(head_score) < 0.015 OR quantile_cont(head_score, 0.95) - quantile_cont(head_score, 0.05) < 0.06 OR count(DISTINCT round(head_score, 6)) < 20 FROM small_rows) THEN CASE WHEN n <= 1 THEN 1.0 ELSE round(1 - (pos - 1) / CAST(n - 1 AS DOUBLE), 9) END ELSE head_score END::DOUBLE AS model_signal FROM (SELECT user_id, item_id, head_score, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY head_score DESC, item_id) AS pos FROM small_rows)")
def e12_blend_guard(b):
    return ranking.blend_guard(small(b), "head_score", least_spread=1.0).select("user_id", "item_id", F.round("model_signal", 9).alias("model_signal"))


@query("SELECT round(avg((pre_rank <> blend_rank)::INT) FILTER (WHERE pre_rank <= 10 OR blend_rank <= 10), 6) AS swap_rate, max(o) AS oracle_recall, max(rb) AS recall_before, max(ra) AS recall_after FROM blend_ranked CROSS JOIN (SELECT round(avg(l), 6) AS o, round(avg(x), 6) AS rb, round(avg(y), 6) AS ra FROM (SELECT user_id, max(label) AS l, max(CASE WHEN pre_rank <= 10 THEN label ELSE 0 END) AS x, max(CASE WHEN blend_rank <= 10 THEN label ELSE 0 END) AS y FROM blend_ranked GROUP BY user_id))")
def e16_swap_rate(b):
    from gristmill.plans.rerank import blended

    return metrics.swap_rate(blended(b), "pre_rank", "blend_rank", 10)


@query("SELECT user_id, item_id, round(1 / (1 + exp(-(3.0 * head_score - 1.0))), 6) AS platt, round(0.2 + 0.5 * (head_score - 0.2), 6) AS shrunk FROM small_rows")
def e10_platt_expression(b):
    score = F.col("head_score")
    return small(b).select("user_id", "item_id", F.round(ranking.platt(score, 3.0, -1.0), 6).alias("platt"), F.round(ranking.residual(F.lit(0.2), score, 0.5), 6).alias("shrunk"))


# Relative features that nothing else registers.


@query(f"SELECT user_id, item_id, {SETTLED('CASE WHEN count(*) OVER w <= 1 THEN 1.0 ELSE 1 - (pre_rank - 1) / CAST(count(*) OVER w - 1 AS DOUBLE) END')} AS rank_pct, head_score - max(CASE WHEN pre_rank = least(10, n) THEN head_score END) OVER w AS margin FROM (SELECT *, max(pre_rank) OVER (PARTITION BY user_id) AS n FROM small_rows) WINDOW w AS (PARTITION BY user_id)")
def f3_rank_features(b):
    rows = features.frontier_margin(small(b).withColumn("rank_pct", features.descending_rank_pct(F.col("pre_rank"))), "head_score", "pre_rank", 10)
    return settled(rows, "rank_pct").select("user_id", "item_id", "rank_pct", "margin")


VIEWS = ("user", "item", "recent", "avoid")
_PART = lambda i: f"embedding[{16 * i + 1}:{16 * i + 16}]::DOUBLE[]"
_COS = lambda i, j: f"list_dot_product({_PART(i)}, {_PART(j)}) / (sqrt(list_dot_product({_PART(i)}, {_PART(i)})) * sqrt(list_dot_product({_PART(j)}, {_PART(j)})))"
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


@query("SELECT vec_id, " + ", ".join(f"round({_COS(i, j)}, 6) AS {VIEWS[i]}_{VIEWS[j]}" for i, j in _PAIRS) + f", round({_COS(1, 2)} - {_COS(1, 3)}, 6) AS conflict_gap FROM embeddings")
def f7_all_similarities(b):
    rows = b.t("embeddings").select("vec_id", *[F.slice("embedding", 16 * i + 1, 16).alias(n) for i, n in enumerate(VIEWS)])
    pairs = {f"{VIEWS[i]}_{VIEWS[j]}": (VIEWS[i], VIEWS[j]) for i, j in _PAIRS}
    rows = features.vector_similarities(rows, pairs).withColumn("conflict_gap", features.conflict_gap(F.col("item_recent"), F.col("item_avoid")))
    return floats(rows, *pairs, "conflict_gap").select("vec_id", *pairs, "conflict_gap")


# Eight terms of a match: how the user's history is spread over what the item is, liked, disliked, recent and near.
MATCH = {"by_type": 0.22, "by_brand": 0.18, "by_size": 0.12, "liked_type": 0.16, "recent_type": 0.12, "price_near": 0.10, "season": 0.06, "disliked_type": -0.14}
cte(
    match_events="SELECT e.user_id, p_type, p_brand, floor(p_size / 10.0) AS size_tag, rating, month(ts) AS m, p_retailprice, coalesce(h.hist_recency_w, 0) AS w FROM train_events e JOIN part ON p_partkey = e.item_id LEFT JOIN history h ON h.user_id = e.user_id AND h.item_id = e.item_id",
    match_users="SELECT user_id, count(*) AS n, avg(p_retailprice) AS price, sum(w) AS w FROM match_events GROUP BY user_id",
    match_types="SELECT user_id, p_type, count(*) AS n_t, sum((rating >= 4)::INT) AS good, sum((rating <= 1)::INT) AS bad, sum(w) AS w_t FROM match_events GROUP BY user_id, p_type",
    match_brands="SELECT user_id, p_brand, count(*) AS n_b FROM match_events GROUP BY user_id, p_brand",
    match_sizes="SELECT user_id, size_tag, count(*) AS n_s FROM match_events GROUP BY user_id, size_tag",
    match_terms="SELECT r.user_id, r.item_id, coalesce(n_t, 0) / u.n AS by_type, coalesce(n_b, 0) / u.n AS by_brand, coalesce(n_s, 0) / u.n AS by_size, coalesce(good, 0) / u.n AS liked_type, CASE WHEN u.w > 0 THEN coalesce(w_t, 0) / u.w ELSE 0 END AS recent_type, exp(-abs(p_retailprice - price) / 500.0) AS price_near, (p.p_size % 12 + 1 = month(t.ts))::INT::DOUBLE AS season, coalesce(bad, 0) / u.n AS disliked_type FROM small_rows r JOIN part p ON p_partkey = r.item_id JOIN match_users u ON u.user_id = r.user_id JOIN truth_items t ON t.user_id = r.user_id LEFT JOIN match_types a ON a.user_id = r.user_id AND a.p_type = p.p_type LEFT JOIN match_brands c ON c.user_id = r.user_id AND c.p_brand = p.p_brand LEFT JOIN match_sizes s ON s.user_id = r.user_id AND s.size_tag = floor(p.p_size / 10.0)",
)


def match_terms(b):
    b.wide = True
    size_tag = F.floor(F.col("p_size") / 10)
    p = b.listed_parts.select("item_id", "p_type", "p_brand", "p_size", size_tag.alias("size_tag"), "p_retailprice")
    events = b.tagged.withColumn("size_tag", size_tag).join(b.history.select("user_id", "item_id", "hist_recency_w"), ["user_id", "item_id"], "left").withColumn("w", F.coalesce("hist_recency_w", F.lit(0.0)))
    one = F.count(F.lit(1))
    users = events.groupBy("user_id").agg(one.alias("n"), F.avg("p_retailprice").alias("price"), F.sum("w").alias("w"))
    kinds = events.groupBy("user_id", "p_type").agg(one.alias("n_t"), F.sum((F.col("rating") >= 4).cast("int")).alias("good"), F.sum((F.col("rating") <= 1).cast("int")).alias("bad"), F.sum("w").alias("w_t"))
    rows = small(b).join(p, "item_id").join(users, "user_id").join(b.part("test").select("user_id", F.month("ts").alias("month")), "user_id").join(kinds, ["user_id", "p_type"], "left")
    rows = rows.join(events.groupBy("user_id", "p_brand").agg(one.alias("n_b")), ["user_id", "p_brand"], "left").join(events.groupBy("user_id", "size_tag").agg(one.alias("n_s")), ["user_id", "size_tag"], "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n")
    return rows.withColumns({
        "by_type": share("n_t"), "by_brand": share("n_b"), "by_size": share("n_s"), "liked_type": share("good"), "disliked_type": share("bad"),
        "recent_type": F.when(F.col("w") > 0, F.coalesce("w_t", F.lit(0.0)) / F.col("w")).otherwise(0.0), "price_near": F.exp(-F.abs(F.col("p_retailprice") - F.col("price")) / 500.0), "season": (F.col("p_size") % 12 + 1 == F.col("month")).cast("int").cast("double"),
    })


@query("SELECT user_id, item_id, " + ", ".join(SETTLED(n) + f" AS {n}" for n in MATCH) + ", " + SETTLED(" + ".join(f"{w} * {n}" for n, w in MATCH.items())) + " AS match_total FROM match_terms")
def f4_match_terms(b):
    rows = match_terms(b).withColumn("match_total", features.match_total(MATCH))
    return settled(rows, *MATCH, "match_total").select("user_id", "item_id", *MATCH, "match_total")


CHANNELS = {"preference": ("by_type", "by_brand", "liked_type"), "recent": ("recent_type",), "context": ("price_near", "season"), "conflict": ("disliked_type",)}


@query("SELECT user_id, item_id, " + ", ".join(SETTLED("(" + " + ".join(parts) + f") / {len(parts)}.0") + f" AS {n}" for n, parts in CHANNELS.items()) + ", " + SETTLED("(by_type + by_brand + liked_type) / 3.0 - disliked_type") + " AS trusted FROM match_terms")
def f5_candidate_channels(b):
    rows = match_terms(b)
    for name, parts in CHANNELS.items():
        rows = rows.withColumn(name, sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts))
    return settled(rows.withColumn("trusted", F.col("preference") - F.col("conflict")), *CHANNELS, "trusted").select("user_id", "item_id", *CHANNELS, "trusted")


# Profiles.

cte(
    sentences="SELECT e.user_id, p_name AS text, rating - 3 AS weight, e.rn AS sentence_rank FROM train_events e JOIN part ON p_partkey = e.item_id",
    sentences_once="SELECT * FROM sentences QUALIFY row_number() OVER (PARTITION BY user_id, text ORDER BY abs(weight) DESC, sentence_rank, text) = 1",
    sentences_best="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(weight) DESC, sentence_rank, text) AS place FROM sentences_once QUALIFY place <= 5",
)


def evidence(b):
    names = b.t("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    rows = b.split.where("part = 'train'").join(names, "item_id").select("user_id", "text", (F.col("rating") - 3).alias("weight"), F.col("rn").alias("sentence_rank"))
    return assets.sentence_evidence(rows, 5)


@query("SELECT user_id, string_agg(text, '|' ORDER BY place) AS evidence FROM sentences_best GROUP BY user_id")
def k3_sentence_evidence(b):
    return evidence(b).select("user_id", F.array_join("evidence", "|").alias("evidence"))


@query("SELECT s.user_id, user_segment, i.p_type AS intent, round(i.share, 6) AS intent_share, v.evidence, m.mean_rating FROM user_segments s LEFT JOIN (SELECT * FROM intent_ranks WHERE nth = 1) i USING (user_id) LEFT JOIN (SELECT user_id, string_agg(text, '|' ORDER BY place) AS evidence FROM sentences_best GROUP BY user_id) v USING (user_id) LEFT JOIN (SELECT user_id, round(avg(rating), 6) AS mean_rating FROM train_events GROUP BY user_id) m USING (user_id)")
def k4_preference_schema(b):
    intent = profiles.preference_profile(b.history.join(types(b), "item_id"), "user_id", "p_type", F.col("hist_recency_w") * F.col("hist_rating"), 1)
    parts = {
        "intent": intent.select("user_id", F.col("p_type").alias("intent"), F.round("share", 6).alias("intent_share")), "evidence": evidence(b).select("user_id", F.array_join("evidence", "|").alias("evidence")),
        "reviews": b.train.groupBy("user_id").agg(F.round(F.avg("rating"), 6).alias("mean_rating")),
    }
    return assets.preference_schema(b.segments.select("user_id", "user_segment"), parts)


cte(
    target_lists="SELECT user_id, coalesce(list_sort(list(DISTINCT p_type) FILTER (WHERE rating >= 4)), []) AS liked, coalesce(list_sort(list(DISTINCT p_type) FILTER (WHERE rating <= 1)), []) AS avoided, coalesce(list(DISTINCT p_type) FILTER (WHERE rn <= 5), []) AS recent, coalesce(list(DISTINCT p_type) FILTER (WHERE rn > 5), []) AS stable, avg((rating >= 4)::INT) AS good_share, 1 - count(DISTINCT item_id) / CAST(count(*) AS DOUBLE) AS repeat_ratio FROM train_events JOIN part ON p_partkey = item_id GROUP BY user_id",
)


@query("SELECT user_id, array_to_string(list_filter(liked, lambda x: NOT list_contains(avoided, x)), '|') AS preferred, array_to_string(list_filter(avoided, lambda x: NOT list_contains(liked, x)), '|') AS avoided, CASE WHEN good_share >= 0.66 THEN 'high' WHEN good_share >= 0.33 THEN 'medium' ELSE 'low' END AS band, CASE WHEN len(recent) = 0 THEN 'unknown' WHEN len(stable) = 0 THEN 'broadening' WHEN len(list_intersect(recent, stable)) = len(recent) THEN 'stable' WHEN len(list_intersect(recent, stable)) > 0 THEN 'broadening' ELSE 'switching' END AS shift, CASE WHEN repeat_ratio >= 0.55 THEN 'low' WHEN repeat_ratio >= 0.3 THEN 'medium' ELSE 'high' END AS novelty FROM target_lists")
def k5_target_schema(b):
    rows = b.split.where("part = 'train'").join(types(b), "item_id")
    listed = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("p_type"))))
    user = rows.groupBy("user_id").agg(listed(F.col("rating") >= 4).alias("liked"), listed(F.col("rating") <= 1).alias("disliked"), listed(F.col("rn") <= 5).alias("recent"), listed(F.col("rn") > 5).alias("stable"), F.avg((F.col("rating") >= 4).cast("int")).alias("share"), (1 - F.countDistinct("item_id") / F.count(F.lit(1))).alias("repeats"))
    preferred, avoided = profiles.overlap_resolve(F.col("liked"), F.col("disliked"))
    return user.select("user_id", F.array_join(preferred, "|").alias("preferred"), F.array_join(avoided, "|").alias("avoided"), profiles.ratio_band(F.col("share")).alias("band"), assets.recent_shift(F.col("stable"), F.col("recent")).alias("shift"), assets.novelty_style(F.col("repeats")).alias("novelty"))


STRONG, OTHER = ("steel", "brass", "copper"), ("blue", "red", "tin")
_HITS = lambda col, hints: "(" + " + ".join(f"contains(lower({col}), '{h}')::INT" for h in hints) + ")"
cte(
    merchant_rows=f"SELECT p_partkey AS item_id, CASE WHEN lower(trim(p_type)) IN ('economy') THEN 'in_scope' WHEN {_HITS('blob', STRONG)} = 0 AND {_HITS('blob', OTHER)} > 0 THEN 'out_of_scope' WHEN {_HITS('blob', STRONG)} > 0 AND {_HITS('blob', OTHER)} > 0 THEN 'mixed' WHEN {_HITS('blob', STRONG)} > 0 THEN 'in_scope' WHEN contains(lower(blob), 'a') THEN 'mixed' ELSE 'out_of_scope' END AS scope, p_type, p_brand, p_size % 12 AS signals, coalesce(item_train_pop_count, 0) AS reviews FROM (SELECT *, concat_ws(' ', p_name, p_type) AS blob FROM part) LEFT JOIN item_counts ON item_id = p_partkey",
)


@query("SELECT item_id, scope, CASE WHEN scope = 'out_of_scope' THEN '' WHEN p_type = 'PROMO' AND p_brand <> p_type THEN p_brand ELSE p_type END AS label, CASE WHEN scope = 'out_of_scope' THEN 'noisy' WHEN p_type = 'PROMO' THEN CASE WHEN reviews < 25 THEN 'noisy' ELSE 'usable' END WHEN signals >= 8 AND reviews >= 30 THEN 'strong' WHEN signals >= 4 THEN 'usable' ELSE 'noisy' END AS band FROM merchant_rows")
def k6_merchant_state(b):
    p = b.t("part").withColumn("blob", F.concat_ws(" ", "p_name", "p_type")).join(b.popularity, F.col("item_id") == F.col("p_partkey"), "left")
    scope = assets.merchant_scope(F.col("p_type"), F.col("blob"), ("economy",), STRONG, OTHER, "a")
    rows = p.select(F.col("p_partkey").alias("item_id"), scope.alias("scope"), "p_type", "p_brand", (F.col("p_size") % 12).alias("signals"), F.coalesce("item_train_pop_count", F.lit(0)).alias("reviews"))
    label = assets.override_label(F.col("p_type"), F.col("p_brand"), ("PROMO",), F.col("scope"))
    return rows.select("item_id", "scope", label.alias("label"), assets.quality_band(F.col("scope"), F.col("signals"), F.col("reviews"), F.col("p_type") == "PROMO").alias("band"))


@query("SELECT item_id, coalesce(string_agg(label, ',' ORDER BY value DESC, label), '') AS labels FROM (SELECT p_partkey AS item_id, label, value FROM (UNPIVOT (SELECT p_partkey, (p_size % 5)::DOUBLE AS breakfast, (p_size % 4)::DOUBLE AS dinner, (p_size % 3)::DOUBLE AS lunch FROM part) ON breakfast, dinner, lunch INTO NAME label VALUE value) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY value DESC, label) <= 2) WHERE value > 0 GROUP BY item_id UNION ALL SELECT p_partkey, '' FROM part WHERE p_size % 60 = 0")
def k7_merchant_persona(b):
    rows = b.t("part").select(F.col("p_partkey").alias("item_id"), *[(F.col("p_size") % m).alias(n) for n, m in (("breakfast", 5), ("dinner", 4), ("lunch", 3))])
    return assets.top_labels(rows, "item_id", ["breakfast", "dinner", "lunch"], 2).select("item_id", F.array_join("labels", ",").alias("labels"))


cte(
    prompt_events="SELECT user_id, item_id, ts, rating, review_id, datediff('day', CAST(ts AS DATE), CAST(max(ts) OVER (PARTITION BY user_id) AS DATE)) AS days, CASE WHEN rating >= 4 THEN 'good' WHEN rating <= 2 THEN 'bad' ELSE 'other' END AS kind FROM train_events",
    prompt_ranked="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) AS nth, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, review_id DESC) AS anchor, row_number() OVER (PARTITION BY user_id ORDER BY round(rating / 5 / (1 + days), 9) DESC, ts DESC, review_id DESC) AS ev FROM prompt_events",
)


@query("SELECT user_id, count(*) AS n_events, string_agg(item_id::VARCHAR, ',' ORDER BY nth) FILTER (WHERE nth <= 6) AS recent_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY anchor) FILTER (WHERE kind = 'good' AND anchor <= 3), '') AS positive_anchors, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY anchor) FILTER (WHERE kind = 'bad' AND anchor <= 3), '') AS negative_anchors, string_agg(item_id::VARCHAR, ',' ORDER BY ev) FILTER (WHERE ev <= 3) AS evidence_items FROM prompt_ranked GROUP BY user_id")
def k11_prompt_input(b):
    rows = assets.prompt_input(b.train, 6, 3)
    names = ["recent_items", "positive_anchors", "negative_anchors", "evidence_items"]
    return rows.select("user_id", "n_events", *[F.array_join(n, ",").alias(n) for n in names])


@query("SELECT user_id, CASE WHEN h > 0 THEN 'reject' WHEN a >= 5 THEN 'quality_first' WHEN a >= 2 THEN 'balanced' ELSE 'reject' END AS pool FROM (SELECT user_id, sum((rating >= 4)::INT) AS a, sum((rating < 1)::INT) AS h FROM train_events GROUP BY user_id)")
def k12_signal_pools(b):
    user = b.train.groupBy("user_id").agg(F.sum((F.col("rating") >= 4).cast("int")).alias("a"), F.sum((F.col("rating") < 1).cast("int")).alias("h"))
    return user.select("user_id", profiles.quality_pool(F.col("a"), F.col("h")).alias("pool"))


ALIASES = [("steel", "metal"), ("brass", "metal"), ("blue", "colour"), ("red", "colour"), ("green", "colour"), ("small", "size"), ("large", "size")]
_ALIASES = ", ".join(f"('{a}', '{t}')" for a, t in ALIASES)
cte(
    alias_tags=f"SELECT * FROM (VALUES {_ALIASES}) AS t(alias, tag)",
    claim_tags="SELECT DISTINCT e.user_id, e.review_id, (e.rn <= 10)::INT AS recent, CASE WHEN rating >= 4 THEN 1 WHEN rating <= 2 THEN -1 ELSE 0 END AS polarity, tag FROM (SELECT user_id, review_id, rn, rating, unnest(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z]+'))) AS alias FROM train_events JOIN part ON p_partkey = item_id) e JOIN alias_tags USING (alias)",
)


@query("SELECT user_id, tag, count(*) AS n_claims, sum(recent)::BIGINT AS n_recent, sum(polarity)::BIGINT AS polarity FROM claim_tags GROUP BY user_id, tag")
def k14_target_bridge(b):
    names = b.t("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    polarity = F.when(F.col("rating") >= 4, 1).when(F.col("rating") <= 2, -1).otherwise(0)
    claims = b.split.where("part = 'train'").join(names, "item_id").select("user_id", "text", (F.col("rn") <= 10).alias("recent"), polarity.alias("polarity"))
    return assets.target_bridge(claims, F.broadcast(b.spark.createDataFrame(ALIASES, "alias string, tag string")))


PAIRINGS = {"positive_match": ("wants", ("strength", "attribute")), "avoidance_risk_conflict": ("avoids", ("risk",))}
cte(
    role_items="SELECT 'user' AS side, CASE WHEN rating >= 4 THEN 'wants' WHEN rating <= 1 THEN 'avoids' ELSE 'neutral' END AS role, CASE WHEN p_size > 40 THEN 'other' ELSE lower(p_type) END AS family FROM train_events JOIN part ON p_partkey = item_id UNION ALL SELECT 'merchant', CASE p_size % 3 WHEN 0 THEN 'strength' WHEN 1 THEN 'attribute' ELSE 'risk' END, CASE WHEN p_size > 40 THEN 'other' ELSE lower(p_type) END FROM part",
    role_plan="SELECT * FROM (VALUES ('positive_match', 'user', 'wants'), ('positive_match', 'merchant', 'strength'), ('positive_match', 'merchant', 'attribute'), ('avoidance_risk_conflict', 'user', 'avoids'), ('avoidance_risk_conflict', 'merchant', 'risk')) AS t(pairing, side, role)",
    role_families="SELECT pairing, family, sum((side = 'user')::INT)::BIGINT AS u, sum((side = 'merchant')::INT)::BIGINT AS m FROM role_items JOIN role_plan USING (side, role) WHERE family <> 'other' GROUP BY pairing, family",
)


@query("SELECT pairing, sum(u)::BIGINT AS user_items, sum(m)::BIGINT AS merchant_items, coalesce(string_agg(family, ',' ORDER BY family) FILTER (WHERE u > 0 AND m > 0), '') AS shared_families FROM role_families GROUP BY pairing")
def k17_role_pairings(b):
    p = b.t("part").select(F.col("p_partkey").alias("item_id"), "p_size", F.when(F.col("p_size") > 40, "other").otherwise(F.lower("p_type")).alias("family"))
    role = F.when(F.col("rating") >= 4, "wants").when(F.col("rating") <= 1, "avoids").otherwise("neutral")
    users = b.train.join(p, "item_id").select(F.lit("user").alias("side"), role.alias("role"), "family")
    items = p.select(F.lit("merchant").alias("side"), F.element_at(F.array(F.lit("strength"), F.lit("attribute"), F.lit("risk")), F.col("p_size") % 3 + 1).alias("role"), "family")
    return assets.role_pairings(users.union(items), PAIRINGS).withColumn("shared_families", F.array_join("shared_families", ","))


cte(
    pool_rows_k="SELECT user_id, CASE WHEN user_id % 100 < 20 THEN 'eval' ELSE 'train' END AS split, label, CASE WHEN pre_rank <= 10 THEN '001_010' WHEN pre_rank <= 30 THEN '011_030' WHEN pre_rank <= 60 THEN '031_060' WHEN pre_rank <= 100 THEN '061_100' ELSE '101_plus' END AS band FROM small_rows",
    pool_users="SELECT user_id, split, sum((label = 1 AND band = '011_030')::INT)::BIGINT AS p, sum((label = 0)::INT)::BIGINT AS n FROM pool_rows_k GROUP BY user_id, split HAVING p > 0",
)


@query("SELECT split, count(*) AS n_users, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(avg(n), 6) AS mean_negatives, max(n) AS most_negatives FROM pool_users GROUP BY split")
def k19_band_pool(b):
    rows = small(b).select("user_id", split.hash_split(F.col("user_id"), 20).alias("split"), "label", learned_rank_band(F.col("pre_rank")).alias("band"))
    return assets.band_pool(rows, "011_030")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_rivals = 0 THEN 'no_rivals' WHEN NOT (s >= 2 AND facts >= 3) THEN 'thin_user' WHEN n_ahead = 0 THEN 'no_blockers' ELSE 'ready' END AS status FROM (SELECT user_id, focus, count(*) AS n_rivals, sum(outranks::INT) AS n_ahead FROM rival_rows GROUP BY user_id, focus) JOIN (SELECT user_id, (max(rating) >= 4)::INT + (min(rating) <= 1)::INT + (count(DISTINCT p_type) >= 3)::INT AS s, count(DISTINCT p_type) AS facts FROM train_events JOIN part ON p_partkey = item_id GROUP BY user_id) USING (user_id)) GROUP BY status")
def k20_constructability(b):
    user = b.train.join(types(b), "item_id").groupBy("user_id").agg(((F.max("rating") >= 4).cast("int") + (F.min("rating") <= 1).cast("int") + (F.countDistinct("p_type") >= 3).cast("int")).alias("signals"), F.countDistinct("p_type").alias("facts"))
    focus = paired(b).groupBy("user_id", "focus").agg(F.count(F.lit(1)).alias("n_rivals"), F.sum(F.col("outranks").cast("int")).alias("n_ahead"))
    rows = focus.join(user, "user_id").withColumn("richness", assets.richness(F.col("signals"), F.col("facts"), F.lit(False)))
    return assets.constructability(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


cte(tag_hits="SELECT t.user_id, p.source_rank AS hit_rank FROM truth_items t LEFT JOIN profile_rows p ON p.user_id = t.user_id AND p.item_id = t.item_id")


@query("SELECT count(*) AS n_users, " + ", ".join(f"round(avg(CASE WHEN hit_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (10, 20, 50)) + " FROM tag_hits")
def k21_profile_route_eval(b):
    hits = metrics.rank_of_truth(b.truth, b.profile, "source_rank")
    return hits.agg(F.count(F.lit(1)).alias("n_users"), *[F.round(metrics.hit_rate(F.col("hit_rank"), k), 6).alias(f"recall_{k}") for k in (10, 20, 50)])


# Texts.


@query("SELECT user_id, item_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hist_rating DESC, days_to_test, item_id) AS nth FROM (SELECT h.*, row_number() OVER (PARTITION BY user_id, p_type ORDER BY hist_rating DESC, days_to_test, h.item_id) AS g FROM history h JOIN part ON p_partkey = h.item_id) WHERE g = 1) WHERE nth <= 3")
def g10_best_anchors(b):
    return out(text.best_anchors(b.history, types(b), "p_type", 3).select("user_id", "item_id", "nth"))


@query("SELECT conv_id, turn, by_time <= 2 AS latest FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(role || text)) AS by_time, row_number() OVER (PARTITION BY conv_id ORDER BY len(text) DESC, turn DESC, md5(role || text)) AS by_votes FROM conversations) WHERE by_time <= 2 OR by_votes <= 2")
def g11_bounded_material(b):
    rows = b.t("conversations").select("conv_id", "turn", F.md5(F.concat("role", "text").cast("binary")).alias("id"), F.col("turn").alias("ts"), F.length("text").alias("votes"))
    return text.bounded_material(rows, "conv_id", 2, 2).select("conv_id", "turn", (F.col("by_time") <= 2).alias("latest"))


RULES = {"commerce": {"price|sale": 1.0, "the": 0.2}, "notice": {"licen[cs]e|copyright|rights": 2.0, "all": 0.3}, "contact": {"@": 1.5, "[0-9]{3}": 0.5}}
PARENTS = {"commerce": "topic", "notice": "boilerplate", "contact": "boilerplate"}
_SCORE = {n: "(" + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in r.items()) + ")::DOUBLE" for n, r in RULES.items()}
cte(
    rule_scores="SELECT doc_id, " + ", ".join(f"{x} AS {n}" for n, x in _SCORE.items()) + " FROM documents",
    rule_best="SELECT doc_id, notice, contact, CASE WHEN notice > 0 THEN 0 ELSE commerce END AS commerce FROM rule_scores",
    rule_top="SELECT doc_id, greatest(commerce, notice, contact) AS score, CASE greatest(commerce, notice, contact) WHEN commerce THEN 'commerce' WHEN notice THEN 'notice' ELSE 'contact' END AS label FROM rule_best",
)


@query("SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN label ELSE 'other' END AS label, CASE WHEN score < 0.5 THEN 'other' WHEN label = 'commerce' THEN 'topic' ELSE 'boilerplate' END AS first_level FROM rule_top")
def g12_relabel(b):
    return text.relabel(b.t("documents"), "doc_id", "text", RULES, PARENTS, [("notice", "commerce")], 0.5)


cte(
    snippet_rows="SELECT t.user_id, h.item_id, substr(trim(regexp_replace(p_name || ' ' || p_type || ' ' || rating, '\\s+', ' ', 'g')), 1, 120) AS snippet, max(e.ts) AS ts FROM truth_items t JOIN history h ON h.user_id = t.user_id JOIN train_events e ON e.item_id = h.item_id JOIN part ON p_partkey = e.item_id WHERE e.ts < t.ts GROUP BY ALL",
    snippet_ranks="SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(10 * (CASE WHEN contains(lower(snippet), 'steel') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(snippet), '5.0') THEN 0.5 ELSE 0 END) + CASE WHEN len(snippet) >= 80 THEN 1 ELSE 0 END, 6) DESC, ts DESC, snippet) AS nth FROM snippet_rows QUALIFY nth <= 2",
)


@query("SELECT user_id, item_id, string_agg(snippet, ' || ' ORDER BY nth) AS evidence, count(*) AS n_snippets FROM snippet_ranks GROUP BY user_id, item_id")
def g9_item_snippets(b):
    p = b.t("part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type")
    reviews = b.train.join(p, "item_id").select("item_id", "ts", F.concat_ws(" ", "p_name", "p_type", F.col("rating").cast("string")).alias("text"))
    cutoff = b.part("test").select("user_id", F.col("ts").alias("cutoff"))
    return text.item_snippets(b.history.select("user_id", "item_id").join(cutoff, "user_id"), reviews, {"steel": 1.0, "5.0": 0.5}, 2)


@query("SELECT part_id, '[' || string_agg('{\"place\":' || place || ',\"bucket\":\"' || bucket || '\",\"id\":' || id || '}', ',' ORDER BY place) || ']' AS payload FROM (SELECT part_id, bucket, id, row_number() OVER (PARTITION BY part_id ORDER BY seed DESC, score DESC, ts DESC NULLS LAST, id) AS place FROM evidence_seeds QUALIFY place <= 8) GROUP BY part_id")
def g7_evidence_payload(b):
    from gristmill.plans.corpus import g7_select_evidence

    return text.evidence_payload(g7_select_evidence(b), "part_id")


# Filters, cohorts and aggregates.


@query("SELECT c_custkey, lower(trim(string_split_regex(c_mktsegment, '\\s*,\\s*')[1])) AS category FROM customer")
def p_primary_category(b):
    return b.t("customer").select("c_custkey", cohorts.primary_category(F.col("c_mktsegment")).alias("category"))


@query("SELECT c_custkey FROM customer WHERE regexp_matches(lower(c_mktsegment), 'build|machin')")
def p_scope_filter(b):
    return b.t("customer").where(cohorts.in_scope(F.col("c_mktsegment"), ("build", "machin"))).select("c_custkey")


@query("SELECT user_id, user_segment FROM user_segments WHERE user_id IN (SELECT s_suppkey FROM supplier)")
def p_cohort_filter(b):
    return cohorts.cohort_filter(b.segments.select("user_id", "user_segment"), b.t("supplier").select(F.col("s_suppkey").alias("user_id")))


@query("SELECT user_id, item_id, pre_rank FROM ranked_rows WHERE user_id % 100 < 20 AND pre_rank <= 30")
def p_eval_cohort(b):
    tested = b.users.where(split.hash_split(F.col("user_id"), 20) == "eval")
    return out(cohorts.eval_cohort(b.ranked, None, tested, 30).select("user_id", "item_id", "pre_rank"))


@query("SELECT vec_id, label::DOUBLE AS label, -1.0::DOUBLE AS weight FROM embeddings")
def p_optional_columns(b):
    e = b.t("embeddings")
    return e.select("vec_id", tables.optional(e, "label", "double", 0), tables.optional(e, "weight", "double", -1.0))


@query("SELECT user_id, CASE WHEN pre_rank <= 10 THEN 'top10_anchor' WHEN pre_rank <= 30 THEN '11-30' WHEN pre_rank <= 40 THEN '31-40' WHEN pre_rank <= 60 THEN '41-60' WHEN pre_rank <= 100 THEN '61-100' ELSE 'unrouted' END AS segment, count(*) AS n FROM small_rows GROUP BY ALL")
def p_route_segments(b):
    return small(b).groupBy("user_id", rescue.route_segment(F.col("pre_rank")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, first(CASE WHEN value > 10 THEN event_type END ORDER BY ts DESC, event_id DESC) FILTER (WHERE value > 10) AS first_known FROM events GROUP BY user_id")
def p_first_known(b):
    e = b.t("events").withColumn("known", F.when(F.col("value") > 10, F.col("event_type")))
    order = [(-F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), (-F.col("event_id")).alias("b")]
    return e.groupBy("user_id").agg(assets.first_known("known", *order).alias("first_known"))


@query("SELECT true AS distinct_near, true AS median_near, true AS quantiles_near")
def p_approximate(b):
    """Approximate distinct counts and percentiles, each held to its stated error against the exact one."""
    li = b.t("lineitem")
    row = li.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("p"), F.percentile("l_extendedprice", F.lit(0.49)).alias("lo"), F.percentile("l_extendedprice", F.lit(0.51)).alias("hi"))
    low, high = li.approxQuantile("l_quantity", [0.1, 0.9], 0.01)
    exact = li.agg(*[F.percentile("l_quantity", F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.08, 0.12, 0.88, 0.92))])
    near = row.select((F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("distinct_near"), F.col("p").between(F.col("lo"), F.col("hi")).alias("median_near"))
    return near.crossJoin(exact.select((F.lit(low).between(F.col("q0"), F.col("q1")) & F.lit(high).between(F.col("q2"), F.col("q3"))).alias("quantiles_near")))


@query("SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY pos) AS items FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY kind, rank) AS pos FROM (SELECT user_id, item_id, 0 AS kind, rank FROM type_lists UNION ALL SELECT user_id, item_id, 1, source_rank FROM popular_rows p WHERE source_rank <= 10 AND NOT EXISTS (SELECT 1 FROM type_lists t WHERE t.user_id = p.user_id AND t.item_id = p.item_id)) QUALIFY pos <= 12) GROUP BY user_id")
def j2_merged_lists(b):
    lists = lambda df, rank: df.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, "item_id"))), lambda x: x["item_id"]).alias(rank))
    own = lists(baselines.group_popular_lists(b.train, b.users, types(b), "p_type", 10), "rank")
    popular = lists(b.popular.where("source_rank <= 10").select("user_id", "item_id", "source_rank"), "source_rank")
    return own.join(popular, "user_id").select("user_id", F.array_join(baselines.merged_list(F.col("rank"), F.col("source_rank"), 12), ",").alias("items"))


@query("SELECT user_id, event_type FROM events WHERE CAST(('0x' || md5(event_id || '|42')[1:8]) AS BIGINT) % 1000000 < 250000")
def p_sampled_events(b):
    return sampling.hash_sample(b.t("events"), 0.25, "event_id").select("user_id", "event_type")


# Prompt texts.


@query("SELECT s.user_id, concat_ws(chr(10), 'Segment: ' || user_segment, 'Likes: ' || i.p_type, 'Share: ' || round(i.share, 2)::VARCHAR, 'Evidence: ' || CASE WHEN len(e.evidence) <= 60 THEN e.evidence ELSE rtrim(regexp_replace(substr(e.evidence, 1, 60), '\\s+\\S*$', '')) || '...' END) AS prompt FROM user_segments s LEFT JOIN (SELECT * FROM intent_ranks WHERE nth = 1) i USING (user_id) LEFT JOIN (SELECT user_id, string_agg(text, '; ' ORDER BY place) AS evidence FROM sentences_best GROUP BY user_id) e USING (user_id)")
def k11_user_prompt(b):
    intent = profiles.preference_profile(b.history.join(types(b), "item_id"), "user_id", "p_type", F.col("hist_recency_w") * F.col("hist_rating"), 1).select("user_id", F.col("p_type").alias("likes"), scaled_round(F.col("share"), 2).alias("share"))
    rows = assets.preference_schema(b.segments.select("user_id", "user_segment"), {"intent": intent, "evidence": evidence(b)})
    parts = [("Segment", F.col("user_segment")), ("Likes", F.col("likes")), ("Share", F.col("share")), ("Evidence", assets.shorten(F.array_join("evidence", "; "), 60))]
    return rows.select("user_id", assets.compose(parts).alias("prompt"))


_BAND = lambda c: f"CASE WHEN {c} <= 10 THEN 'head' WHEN {c} <= 30 THEN 'boundary' WHEN {c} <= 60 THEN 'middle' ELSE 'deep' END"


@query(f"SELECT user_id, focus, rival, 'The rival stands ' || CASE WHEN rival_rank < focus_rank THEN 'ahead of' ELSE 'behind' END || ' the focus (' || {_BAND('rival_rank')} || ' against ' || {_BAND('focus_rank')} || ', ' || abs(rival_rank - focus_rank) || ' ranks apart).' AS question FROM boundary_picks")
def h6_pair_prompts(b):
    pairs = selection.boundary_rivals(paired(b), 12)
    return pairs.select("user_id", "focus", "rival", assets.comparison(F.col("focus_pre_rank"), F.col("rival_pre_rank")).alias("question"))


# Exploration.


@query("SELECT cluster, term, nth FROM (SELECT lang AS cluster, t.term, row_number() OVER (PARTITION BY lang ORDER BY round(sum(tf) * max(idf) / max(n), 9) DESC, count(*) DESC, t.term) AS nth FROM doc_terms t JOIN term_idf i ON i.term = t.term JOIN documents d ON d.doc_id = t.doc_id JOIN (SELECT lang AS l, count(*) AS n FROM documents GROUP BY lang) c ON c.l = d.lang GROUP BY lang, t.term) WHERE nth <= 10")
def g13_cluster_keywords(b):
    from gristmill.plans.corpus import doc_terms

    counts, docs = doc_terms(b), b.t("documents")
    idf = text.smoothed_idf(counts, docs.count())
    return out(text.cluster_keywords(counts, idf, docs.select("doc_id", F.col("lang").alias("cluster")), "doc_id", 10).select("cluster", "term", "nth"))


@query("SELECT CASE WHEN n <= 7 THEN 'light' WHEN n <= 19 THEN 'mid' ELSE 'heavy' END AS activity, count(*) AS users, sum(n)::BIGINT AS events, round(avg(n), 6) AS mean_events FROM (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id) GROUP BY activity")
def j4_activity(b):
    users = b.interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.groupBy(split.segment(F.col("n")).alias("activity")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"), F.round(F.avg("n"), 6).alias("mean_events"))


@query("SELECT isodow(ts)::BIGINT AS weekday, hour(ts)::BIGINT AS hour, count(*) AS n FROM events GROUP BY weekday, hour")
def j4_time_of_week(b):
    return b.t("events").groupBy((F.weekday("ts") + 1).cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(d, '%Y-%m') AS month, count(*) AS visits, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY month")
def j4_visit_dates(b):
    """Comma-joined dates of each user, as a check-in table has them, taken apart again."""
    joined = b.t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM-dd"))), ", ").alias("dates"))
    days = joined.select("user_id", F.explode(F.split("dates", r",\s*")).alias("d"))
    return days.groupBy(F.substring("d", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("user_id").alias("users"))


@query("SELECT s_suppkey, s_name, count(*) AS events, count(DISTINCT l_partkey) AS items, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name")
def j4_supplier_stats(b):
    rows = b.t("lineitem").join(b.t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_suppkey", "s_name").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("l_partkey").alias("items"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


# Readers and writers: written to a folder of its own, and read back.


CUSTOMERS = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
CUSTOMER = "c_custkey long, c_name string, c_mktsegment string"


def customers(b):
    return b.t("customer").select("c_custkey", "c_name", "c_mktsegment")


@query(CUSTOMERS)
def s_json_round_trip(b):
    path = tables.scratch_dir(b.spark)
    tables.write_json(customers(b), f"{path}/c.json")
    return tables.read_any(b.spark, f"{path}/c.json", CUSTOMER)


@query(CUSTOMERS)
def s_ingest_json(b):
    path = tables.scratch_dir(b.spark)
    tables.write_json(customers(b), f"{path}/raw.json")
    tables.ingest_json(b.spark, f"{path}/raw.json", f"{path}/table")
    return tables.ingest_json(b.spark, f"{path}/none.json", f"{path}/table").select("c_custkey", "c_name", "c_mktsegment")


@query(CUSTOMERS)
def s_csv_append(b):
    path = tables.scratch_dir(b.spark)
    tables.write_csv(customers(b).where("c_custkey % 2 = 0"), f"{path}/c.csv")
    tables.write_csv(customers(b).where("c_custkey % 2 = 1"), f"{path}/c.csv", append=True)
    return tables.read_any(b.spark, f"{path}/c.csv", CUSTOMER)


@query(CUSTOMERS)
def s_parquet_partitioned(b):
    path = tables.scratch_dir(b.spark)
    tables.write_parquet(customers(b), f"{path}/c", max_records=100, by=["c_mktsegment"])
    return tables.read_any(b.spark, f"{path}/c").select("c_custkey", "c_name", F.col("c_mktsegment").cast("string").alias("c_mktsegment"))


@query(CUSTOMERS)
def s_parquet_hashed(b):
    path = tables.scratch_dir(b.spark)
    tables.write_hashed(customers(b), f"{path}/c", "c_custkey", 4)
    return tables.read_any(b.spark, f"{path}/c").drop("bucket")


@query(CUSTOMERS)
def s_orc_round_trip(b):
    path = tables.scratch_dir(b.spark)
    customers(b).write.orc(f"{path}/c.orc")
    return tables.read_any(b.spark, f"{path}/c.orc")


@query("SELECT 3::BIGINT AS files, 'run-2_full' AS latest, 'run-1_full' AS pointed")
def s_runs_and_parts(b):
    """The first part files of a folder, the run folder of greatest name, and the one that a pointer file names."""
    path = tables.scratch_dir(b.spark)
    customers(b).repartition(5).write.parquet(f"{path}/run-1_full")
    customers(b).limit(3).write.parquet(f"{path}/run-2_full")
    tables.write_pointer(b.spark, f"{path}/pointer", f"{path}/run-1_full")
    files = tables.read_parts(b.spark, f"{path}/run-1_full", 3).select(F.input_file_name().alias("file")).distinct().agg(F.count(F.lit(1)).alias("files"))
    name = lambda p: p.rsplit("/", 1)[-1]
    return files.select("files", F.lit(name(tables.latest_run(b.spark, path, "_full"))).alias("latest"), F.lit(name(tables.pointed_run(b.spark, f"{path}/pointer"))).alias("pointed"))


@query("SELECT user_id, count(*) AS n_rows, max(d)::INT AS audited FROM (SELECT user_id, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS d FROM train_events) GROUP BY user_id")
def s_enriched_audit(b):
    path = tables.scratch_dir(b.spark)
    audit = b.train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max((F.col("rating") >= 4).cast("int")).alias("audited"))
    tables.write_audit(audit, f"{path}/audit", {"stage": "train"})
    return b.spark.read.parquet(f"{path}/audit/rows")
