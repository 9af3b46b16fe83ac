"""Queries: rank features, negatives, calibration, blending, evaluation, relative features, rescue and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import features, fusion, metrics, profiles, ranking, rescue, sampling, serving
from gristmill.operators.split import hash_split
from gristmill.plans.recall import floats, out, settled, types
from gristmill.plans.registry import query
from gristmill.plans.sql import ILR, SETTLED, cte

DICE = lambda *keys: "CAST(('0x' || md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ", '42'))[1:8]) AS BIGINT) % 1000000"

# The pool of the later stages is the flat cut at its surveyed size, with the label and the item's category.
PRETRIM = 150
cte(
    small_rows=f"SELECT * FROM labeled_rows WHERE pre_rank <= {PRETRIM}",
    model_rows="SELECT *, round(head_score + ((item_id % 17) / 100.0), 9) AS model_score FROM small_rows",
)


def small(b):
    """Each user's pretrimmed candidates: what the rank model, its features and the rescue read."""
    t = b.part("test").select("user_id", F.col("item_id").alias("true_item"))
    rows = fusion.flat_cut(b.ranked, fusion.FusionPolicy()).join(t, "user_id").withColumn("label", (F.col("item_id") == F.col("true_item")).cast("int")).drop("true_item")
    return rows.join(b.listed_parts.select("item_id", F.col("p_type").alias("category")), "item_id")


def modelled(b):
    return small(b).withColumn("model_score", F.round(F.col("head_score") + (F.col("item_id") % 17) / 100.0, 9))


@query(f"SELECT user_id, item_id, round(ln(1 + item_train_pop_count), 6) AS log_pop, round(greatest({ILR('cluster_rank')}, {ILR('profile_rank')}, {ILR('popular_rank')}), 6) AS best_route_inv, round(greatest({ILR('cluster_rank')}, {ILR('profile_rank')}, {ILR('popular_rank')}) - {ILR('pre_rank')}, 6) AS route_gap, (source_count >= 2)::INT AS multi_source FROM small_rows")
def e1_rank_features(b):
    return floats(ranking.rank_features(small(b)), "log_pop", "best_route_inv", "route_gap").select("user_id", "item_id", "log_pop", "best_route_inv", "route_gap", "multi_source")


@query("SELECT r.user_id, r.item_id, p_size AS size, user_train_count FROM small_rows r JOIN part ON p_partkey = r.item_id JOIN user_segments USING (user_id)")
def e2_attach_features(b):
    sizes = b.t("part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("size"))
    return small(b).join(sizes, "item_id").join(b.segments.drop("user_segment"), "user_id").select("user_id", "item_id", "size", "user_train_count")


cte(
    aged_history="SELECT *, CASE WHEN days_to_test <= 90 THEN 'short' WHEN days_to_test <= 365 THEN 'mid' ELSE 'old' END AS age FROM history",
    aged_ranked="SELECT *, row_number() OVER (PARTITION BY user_id, age ORDER BY days_to_test, hist_ts DESC, hist_rating DESC, item_id) AS nth FROM aged_history",
)


@query("SELECT user_id, item_id, age, CASE age WHEN 'short' THEN 1.0 WHEN 'mid' THEN 0.5 ELSE 0.2 END::DOUBLE AS recency FROM aged_ranked WHERE nth <= CASE age WHEN 'short' THEN 3 WHEN 'mid' THEN 4 ELSE 3 END")
def e3_history_flags(b):
    return ranking.history_flags(b.history).select("user_id", "item_id", "age", "recency")


@query(f"SELECT r.user_id, r.item_id, (r.item_id = t.item_id)::INT AS label_true, coalesce(r.item_id = v.item_id, false)::INT AS label_valid, greatest((r.item_id = t.item_id)::INT, coalesce(r.item_id = v.item_id, false)::INT) AS label FROM ranked_rows r JOIN truth_items t ON t.user_id = r.user_id LEFT JOIN (SELECT user_id, item_id FROM split_events WHERE part = 'valid') v ON v.user_id = r.user_id WHERE pre_rank <= {PRETRIM}")
def e4_labels(b):
    truth = b.truth.withColumnRenamed("item_id", "true_item").join(b.part("valid").select("user_id", F.col("item_id").alias("valid_item")), "user_id", "left")
    return ranking.labels(fusion.flat_cut(b.ranked, fusion.FusionPolicy()), truth, True).select("user_id", "item_id", "label_true", "label_valid", "label")


@query(f"SELECT CASE WHEN d < 200000 THEN 'test' WHEN d < 350000 THEN 'calib' ELSE 'train' END AS part, count(*) AS n FROM (SELECT {DICE('user_id')} AS d FROM truth_items) GROUP BY part")
def e5_user_split(b):
    d = sampling.keyed_random("user_id")
    return b.users.select(F.when(d < 200_000, "test").when(d < 350_000, "calib").otherwise("train").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


NEG = sampling.Negatives(hard_rank=20, hard=5, near_window=10, near=4, mix=3, mix_floor=2, category=4, easy_from=30, easy_to=60, easy=4, random=3, total=14)


def _nth(able, order):
    return f"({able}) AND row_number() OVER (PARTITION BY user_id, coalesce(({able}), false) ORDER BY {order}, item_id)"


cte(
    neg_best="SELECT *, min(CASE WHEN label = 1 THEN pre_rank END) OVER w AS best, max(CASE WHEN label = 1 THEN category END) OVER w AS best_category, max(CASE WHEN label = 1 THEN item_train_pop_count END) OVER w AS best_pop FROM small_rows WINDOW w AS (PARTITION BY user_id)",
    neg_rows=f"SELECT *, {DICE('user_id', 'item_id')} AS dice, abs(ln(1 + item_train_pop_count) - ln(1 + best_pop)) AS gap FROM neg_best WHERE label = 0 AND best IS NOT NULL",
    neg_marked=f"SELECT *, {_nth('pre_rank <= 20', 'pre_rank')} <= 5 AS in_hard, {_nth('abs(pre_rank - best) <= 10', 'abs(pre_rank - best), pre_rank')} <= 4 AS in_near, {_nth('nonpopular_source_count >= 2', 'pre_rank')} <= 3 AS in_mix, {_nth('category = best_category AND gap <= 0.8', 'round(gap, 9), pre_rank')} <= 4 AS in_category, {_nth('pre_rank BETWEEN 30 AND 60', 'pre_rank DESC')} <= 4 AS in_easy, {_nth('true', 'dice')} <= 3 AS in_random FROM neg_rows",
    neg_pooled="SELECT *, CASE WHEN in_hard THEN 'hard' WHEN in_near THEN 'near_pos' WHEN in_mix THEN 'route_mix' WHEN in_category THEN 'same_category' WHEN in_easy THEN 'easy' WHEN in_random THEN 'random' END AS pool, CASE WHEN in_hard THEN 0 WHEN in_near THEN 1 WHEN in_mix THEN 2 WHEN in_category THEN 3 WHEN in_easy THEN 4 ELSE 5 END AS priority FROM neg_marked",
    neg_taken="SELECT *, CASE WHEN pool = 'route_mix' AND row_number() OVER (PARTITION BY user_id, pool ORDER BY pre_rank, item_id) <= 2 THEN 0 ELSE 1 END AS first FROM neg_pooled WHERE pool IS NOT NULL",
)


@query("SELECT user_id, item_id, pool, row_number() OVER (PARTITION BY user_id ORDER BY first, priority, pre_rank, item_id) AS pick_order, pre_rank FROM neg_taken QUALIFY pick_order <= 14")
def e6_negative_sampler(b):
    return out(sampling.sample_negatives(small(b), NEG))


WEIGHT = f"CASE WHEN label = 1 THEN CASE WHEN pre_rank <= 50 THEN 3.0 WHEN pre_rank <= 150 THEN 1.8 ELSE 1.2 END ELSE CASE WHEN pre_rank <= 50 THEN 1.2 WHEN pre_rank <= 150 THEN 1.0 ELSE 0.9 END END * power(greatest(least({ILR('pre_rank')}, 1.0), 0.05), 0.4)"


@query(f"SELECT label, pre_rank, count(*) AS n, round(max({WEIGHT}), 6) AS weight FROM small_rows GROUP BY label, pre_rank")
def e7_sample_weights(b):
    return out(small(b).withColumn("w", sampling.sample_weight(F.col("label"), F.col("pre_rank"))).groupBy("label", "pre_rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("w"), 6).alias("weight")))


@query(f"SELECT user_id, round(greatest(least(coalesce(sum(w), 1.0), 3.0), 0.5), 6) AS sum_weight, round(greatest(least(coalesce(avg(w), 1.0), 3.0), 0.5), 6) AS mean_weight, round(greatest(least(coalesce(max(w), 1.0), 3.0), 0.5), 6) AS max_weight FROM (SELECT user_id, CASE WHEN label = 1 THEN {WEIGHT} END AS w FROM small_rows) GROUP BY user_id")
def e8_group_weights(b):
    rows = small(b).withColumn("weight", sampling.sample_weight(F.col("label"), F.col("pre_rank")))
    return floats(sampling.group_weights(rows), "sum_weight", "mean_weight", "max_weight")


GBT = ["log_pop", "best_route_inv", "pre_rank_inv", "source_count"]


def e9_gbt_ranker(b):
    """Gradient-boosted trees over the sampled pool; no SQL can express the fit."""
    rows = b.keep("weighed", lambda: ranking.weighed(ranking.rank_features(small(b)), "label", *GBT))
    scored = ranking.positive_probability(ranking.fit_gbt(rows, GBT, trees=5, depth=3, weight="n").transform(rows), "learned_score")
    return scored.groupBy("label").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum(F.col("n") * F.col("learned_score")) / F.sum("n"), 6).alias("mean_score"))


query(None)(e9_gbt_ranker)


def e10_platt(b):
    """A logistic fit of one score, and the calibrated bins."""
    rows = b.keep("weighed", lambda: ranking.weighed(small(b).withColumn("label", F.col("label").cast("double")), "label", "head_score"))
    scored = ranking.positive_probability(ranking.fit_logistic(rows, ["head_score"], weight="n").transform(rows), "score")
    return metrics.calibration_bins(scored, weight="n")


query(None)(e10_platt)


@query("SELECT source, n, round(greatest(least((hits + 200 * base) / (n + 200) / base, 1.15), 0.85), 6) AS lift FROM (SELECT 'cluster' AS source, count(*) FILTER (WHERE cluster_rank <= 200) AS n, coalesce(sum(label) FILTER (WHERE cluster_rank <= 200), 0) AS hits, avg(label) AS base FROM small_rows UNION ALL SELECT 'profile', count(*) FILTER (WHERE profile_rank <= 200), coalesce(sum(label) FILTER (WHERE profile_rank <= 200), 0), avg(label) FROM small_rows UNION ALL SELECT 'popular', count(*) FILTER (WHERE popular_rank <= 200), coalesce(sum(label) FILTER (WHERE popular_rank <= 200), 0), avg(label) FROM small_rows)")
def e11_route_quality(b):
    return ranking.route_quality(small(b), ("cluster", "profile", "popular"))


LIFT = {"cluster": 1.05, "profile": 0.95, "popular": 0.9}
cte(
    scaled_rows="SELECT *, (head_score - min(head_score) OVER w) / (max(head_score) OVER w - min(head_score) OVER w + 1e-9) AS base, (model_score - min(model_score) OVER w) / (max(model_score) OVER w - min(model_score) OVER w + 1e-9) AS model, ((cluster_rank IS NOT NULL)::INT * 1.05 + (profile_rank IS NOT NULL)::INT * 0.95 + (popular_rank IS NOT NULL)::INT * 0.9) / source_count AS factor FROM model_rows WINDOW w AS (PARTITION BY user_id)",
    blended_rows="SELECT *, round(0.8 * base * power(factor, 0.25) + 0.2 * model, 9) AS blend_score FROM scaled_rows",
    blend_ranked="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (pre_rank > 30)::INT, CASE WHEN pre_rank <= 30 THEN -blend_score ELSE 0 END, pre_rank, item_id) AS blend_rank FROM blended_rows",
)


def scaled(b):
    return modelled(b).withColumn("model", features.min_max(F.col("model_score"))).withColumn("base", features.min_max(F.col("head_score")))


def blended(b):
    return ranking.blend(scaled(b), "head_score", "model", 0.2, ranking.route_factor(LIFT), top=30)


@query("SELECT user_id, item_id, blend_rank, blend_score FROM blend_ranked")
def e12_route_factor_blend(b):
    return out(blended(b).select("user_id", "item_id", "blend_rank", "blend_score"))


cte(
    grid_hits="SELECT alpha, user_id, min(CASE WHEN label = 1 THEN place_at END) AS hit FROM (SELECT user_id, alpha, label, row_number() OVER (PARTITION BY user_id, alpha ORDER BY round((1 - alpha) * base + alpha * model, 9) DESC, pre_rank, item_id) AS place_at FROM scaled_rows CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5])::DOUBLE AS alpha)) GROUP BY alpha, user_id",
)


@query(f"SELECT alpha, round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit <= 10 THEN {ILR('hit')} ELSE 0.0 END), 6) AS ndcg_at_k FROM grid_hits GROUP BY alpha")
def e13_alpha_grid(b):
    return ranking.alpha_grid(scaled(b).withColumnRenamed("base", "prior").select("user_id", "item_id", "pre_rank", "label", "prior", "model"), [0.0, 0.25, 0.5], 10)


LINEAR = {"head_score": (2.0, 0.05, 0.02, 0.0), "profile_rank": (-0.4, 20.0, 10.0, -0.3), "cluster_rank": (-0.2, 20.0, 10.0, -0.1)}


@query("SELECT user_id, item_id, round(1 / (1 + exp(-(0.1 + 2.0 * (head_score - 0.05) / 0.02 - 0.4 * (coalesce(profile_rank, 20) - 20.0) / 10.0 + CASE WHEN profile_rank IS NULL THEN -0.3 ELSE 0 END - 0.2 * (coalesce(cluster_rank, 20) - 20.0) / 10.0 + CASE WHEN cluster_rank IS NULL THEN -0.1 ELSE 0 END))), 6) AS score FROM small_rows")
def e14_linear_scorer(b):
    return small(b).select("user_id", "item_id", F.round(ranking.linear_score(LINEAR, 0.1), 6).alias("score"))


cte(
    blend_hits="SELECT t.user_id, r.blend_rank AS hit_rank FROM truth_items t LEFT JOIN blend_ranked r ON r.user_id = t.user_id AND r.item_id = t.item_id",
    pop_cut="SELECT quantile_cont(item_train_pop_count, 0.8) AS cut, sum(item_train_pop_count) AS events, count(*) AS items FROM item_counts",
)


@query("SELECT round(count(DISTINCT user_id) / CAST((SELECT count(*) FROM truth_items) AS DOUBLE), 6) AS user_coverage, round(count(DISTINCT b.item_id) / CAST(max(items) AS DOUBLE), 6) AS item_coverage, round(avg((coalesce(c.item_train_pop_count, 1) <= cut)::INT), 6) AS tail_coverage, round(avg(-ln(coalesce(c.item_train_pop_count, 1) / CAST(events AS DOUBLE)) / ln(2.0)), 6) AS novelty FROM blend_ranked b LEFT JOIN item_counts c ON c.item_id = b.item_id CROSS JOIN pop_cut WHERE blend_rank <= 10")
def e15_eval_coverage(b):
    return metrics.coverage(b.truth, blended(b).where("blend_rank <= 10").select("user_id", "item_id"), b.popularity)


@query(f"SELECT user_segment, count(*) AS n_users, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit_rank <= 10 THEN {ILR('hit_rank')} ELSE 0.0 END), 6) AS ndcg_at_k FROM blend_hits JOIN user_segments USING (user_id) GROUP BY user_segment")
def e15_eval_metrics(b):
    return metrics.ranking_metrics(metrics.rank_of_truth(b.truth, blended(b), "blend_rank").join(b.segments, "user_id"), 10, "user_segment")


cte(
    top_before="SELECT user_id, list(item_id) AS a, max(CASE WHEN pre_rank = 1 THEN item_id END) AS a1 FROM blend_ranked WHERE pre_rank <= 10 GROUP BY user_id",
    top_after="SELECT user_id, list(item_id) AS b, max(CASE WHEN blend_rank = 1 THEN item_id END) AS b1 FROM blend_ranked WHERE blend_rank <= 10 GROUP BY user_id",
)


@query("SELECT count(*) AS n_users, round(avg(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE)), 6) AS mean_jaccard, round(avg((a1 <> b1)::INT), 6) AS first_changed FROM top_before JOIN top_after USING (user_id)")
def e16_list_change(b):
    rows = blended(b)
    return metrics.list_change(rows.withColumn("rank", F.col("pre_rank")), rows.withColumn("rank", F.col("blend_rank")), 10)


@query("SELECT sum((coalesce(b.blend_rank, 1000000) < coalesce(b.pre_rank, 1000000))::INT)::BIGINT AS improved, sum((coalesce(b.blend_rank, 1000000) > coalesce(b.pre_rank, 1000000))::INT)::BIGINT AS degraded, sum((coalesce(b.blend_rank, 1000000) = coalesce(b.pre_rank, 1000000))::INT)::BIGINT AS same FROM truth_items t LEFT JOIN blend_ranked b ON b.user_id = t.user_id AND b.item_id = t.item_id")
def e16_improved_degraded(b):
    rows = blended(b)
    return metrics.improved_degraded(metrics.rank_of_truth(b.truth, rows, "pre_rank"), metrics.rank_of_truth(b.truth, rows, "blend_rank"))


@query("SELECT least(CAST(floor(model * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(model), 6) AS mean_score, round(avg(label), 6) AS positive_rate, round(abs(avg(model) - avg(label)), 6) AS gap FROM scaled_rows GROUP BY bin")
def e17_calibration_audit(b):
    return metrics.calibration_bins(scaled(b).withColumn("score", F.col("model")))


@query("SELECT pop_band, user_segment, count(*) AS n_users, round(avg(CASE WHEN b.hit_rank <= 10 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN t.hit_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_delta FROM truth_ranks t JOIN blend_hits b USING (user_id) JOIN user_segments USING (user_id) JOIN pop_bands USING (item_id) GROUP BY pop_band, user_segment")
def e18_slice_eval(b):
    rows = blended(b)
    before = metrics.rank_of_truth(b.truth, rows, "pre_rank").withColumnRenamed("hit_rank", "before")
    after = metrics.rank_of_truth(b.truth, rows, "blend_rank").select("user_id", F.col("hit_rank").alias("after"))
    sliced = before.join(after, "user_id").join(b.segments, "user_id").join(metrics.popularity_band(b.popularity), "item_id")
    return sliced.groupBy("pop_band", "user_segment").agg(F.count(F.lit(1)).alias("n_users"), F.round(metrics.hit_rate(F.col("after"), 10) - metrics.hit_rate(F.col("before"), 10), 6).alias("recall_delta"))


@query(f"SELECT user_id, item_id, {SETTLED('head_score - avg(head_score) OVER w')} AS head_score_centered, {SETTLED('head_score - quantile_cont(head_score, 0.5) OVER w')} AS head_score_median_gap, {SETTLED('CASE WHEN stddev_samp(head_score) OVER w > 0 THEN (head_score - avg(head_score) OVER w) / stddev_samp(head_score) OVER w ELSE 0 END', 4)} AS head_score_z, {SETTLED('(rank() OVER (PARTITION BY user_id ORDER BY head_score) + (count(*) OVER (PARTITION BY user_id, head_score) - 1) / 2.0) / count(*) OVER w')} AS head_score_pct FROM small_rows WINDOW w AS (PARTITION BY user_id)")
def f1_relative_features(b):
    r = features.relative_features(small(b), "head_score")
    return settled(settled(r, "head_score_centered", "head_score_median_gap", "head_score_pct"), "head_score_z", places=4).select("user_id", "item_id", "head_score_centered", "head_score_median_gap", "head_score_z", "head_score_pct")


cte(
    user_likes="SELECT user_id, list(DISTINCT p_type) FILTER (WHERE rating >= 4) AS liked, list(DISTINCT p_type) FILTER (WHERE rating <= 1) AS avoided FROM train_events JOIN part ON p_partkey = item_id GROUP BY user_id",
    item_tag_lists="SELECT p_partkey AS item_id, list_distinct([p_type, ['TYPE-X', p_type][1 + CAST(p_size % 2 AS INT)]]) AS tags FROM part",
)


@query("SELECT r.user_id, r.item_id, len(list_intersect(coalesce(liked, []), tags))::BIGINT AS n_liked, len(list_intersect(coalesce(avoided, []), tags))::BIGINT AS n_avoided, round((len(list_intersect(coalesce(liked, []), tags)) - len(list_intersect(coalesce(avoided, []), tags))) / CAST(len(tags) AS DOUBLE), 6) AS net FROM small_rows r JOIN user_likes USING (user_id) JOIN item_tag_lists i ON i.item_id = r.item_id")
def f2_tag_overlap(b):
    liked = b.train.join(types(b), "item_id").groupBy("user_id").agg(F.collect_set(F.when(F.col("rating") >= 4, F.col("p_type"))).alias("liked"), F.collect_set(F.when(F.col("rating") <= 1, F.col("p_type"))).alias("avoided"))
    tags = b.t("part").select(F.col("p_partkey").alias("item_id"), F.array_distinct(F.array("p_type", F.when(F.col("p_size") % 2 == 0, F.lit("TYPE-X")).otherwise(F.col("p_type")))).alias("tags"))
    rows = small(b).join(liked, "user_id").join(tags, "item_id")
    return out(floats(features.tag_overlap(rows, "liked", "avoided", "tags"), "net").select("user_id", "item_id", "n_liked", "n_avoided", "net"))


cte(gap_rows="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY head_score DESC, item_id) AS gap_at FROM small_rows")


@query(f"SELECT user_id, item_id, {SETTLED('head_score - max(head_score) OVER w')} AS head_score_gap_max, {SETTLED('head_score - avg(head_score) OVER w')} AS head_score_gap_mean, {SETTLED('head_score - avg(CASE WHEN gap_at <= 3 THEN head_score END) OVER w')} AS head_score_gap_top3, {SETTLED('head_score - avg(CASE WHEN gap_at <= 10 THEN head_score END) OVER w')} AS head_score_gap_top10 FROM gap_rows WINDOW w AS (PARTITION BY user_id)")
def f3_group_gaps(b):
    names = ["head_score_gap_max", "head_score_gap_mean", "head_score_gap_top3", "head_score_gap_top10"]
    return settled(features.group_gaps(small(b), "head_score"), *names).select("user_id", "item_id", *names)


@query("SELECT r.user_id, r.item_id, round(0.5 * coalesce(t.weight, 0) + 0.3 * coalesce(s.weight, 0) + 0.2 * (p_retailprice < 1000)::INT, 6) AS match_total FROM small_rows r JOIN part ON p_partkey = r.item_id LEFT JOIN user_tags t ON t.user_id = r.user_id AND t.tag_type = 'category' AND t.tag = p_type LEFT JOIN user_tags s ON s.user_id = r.user_id AND s.tag_type = 'size' AND s.tag = CAST(CAST(floor(p_size / 10.0) AS BIGINT) AS VARCHAR)")
def f4_match_features(b):
    p = b.t("part").select(F.col("p_partkey").alias("item_id"), "p_type", F.floor(F.col("p_size") / 10).cast("string").alias("size_tag"), (F.col("p_retailprice") < 1000).cast("int").alias("cheap"))
    kind = b.user_tags.where("tag_type = 'category'").select("user_id", F.col("tag").alias("p_type"), F.col("weight").alias("by_type"))
    size = b.user_tags.where("tag_type = 'size'").select("user_id", F.col("tag").alias("size_tag"), F.col("weight").alias("by_size"))
    rows = small(b).join(p, "item_id").join(kind, ["user_id", "p_type"], "left").join(size, ["user_id", "size_tag"], "left")
    return rows.select("user_id", "item_id", F.round(features.match_total({"by_type": 0.5, "by_size": 0.3, "cheap": 0.2}), 6).alias("match_total"))


@query("SELECT e.user_id, round(sum(CASE WHEN rating >= 4 THEN 1.0 ELSE 0 END) / count(*), 6) AS preference, round(sum(CASE WHEN rating <= 1 THEN 1.0 ELSE 0 END) / count(*), 6) AS conflict, round(max(hist_recency_w), 6) AS recent FROM train_events e LEFT JOIN history h ON h.user_id = e.user_id AND h.item_id = e.item_id GROUP BY e.user_id")
def f5_match_channels(b):
    rows = b.train.join(b.history.select("user_id", "item_id", "hist_recency_w"), ["user_id", "item_id"], "left")
    return rows.groupBy("user_id").agg(F.round(F.avg((F.col("rating") >= 4).cast("int")), 6).alias("preference"), F.round(F.avg((F.col("rating") <= 1).cast("int")), 6).alias("conflict"), F.round(F.max("hist_recency_w"), 6).alias("recent"))


cte(
    intent_sums="SELECT user_id, p_type, round(sum(hist_recency_w * hist_rating), 9) AS weight FROM history JOIN part ON p_partkey = item_id GROUP BY user_id, p_type",
    intent_ranks="SELECT *, weight / sum(weight) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, p_type) AS nth FROM intent_sums",
)


@query("SELECT user_id, p_type, nth, round(share, 6) AS share, round(max(CASE WHEN nth = 1 THEN share END) OVER w - coalesce(max(CASE WHEN nth = 2 THEN share END) OVER w, 0), 6) AS margin FROM intent_ranks WINDOW w AS (PARTITION BY user_id) QUALIFY nth <= 2")
def f6_user_intent(b):
    rows = b.history.join(types(b), "item_id")
    p = profiles.preference_profile(rows, "user_id", "p_type", F.col("hist_recency_w") * F.col("hist_rating"), 2)
    return out(floats(p, "share", "margin").select("user_id", "p_type", "nth", "share", "margin"))


@query("SELECT vec_id, round(list_dot_product(embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[]) / (sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])) * sqrt(list_dot_product(embedding[17:32]::DOUBLE[], embedding[17:32]::DOUBLE[]))), 6) AS sim_ab FROM embeddings")
def f7_vector_similarities(b):
    rows = b.t("embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("a"), F.slice("embedding", 17, 16).alias("b"))
    return floats(features.vector_similarities(rows, {"sim_ab": ("a", "b")}), "sim_ab").select("vec_id", "sim_ab")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN user_id % 100 < 20 THEN 'eval' ELSE 'train' END AS split FROM truth_items) GROUP BY split")
def h2_hash_split(b):
    return b.users.select(hash_split(F.col("user_id"), 20).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, hit_rank FROM truth_ranks WHERE hit_rank BETWEEN 11 AND 60")
def h1_target_universe(b):
    return out(metrics.rank_of_truth(b.truth, b.ranked, "pre_rank").where("hit_rank between 11 and 60").select("user_id", "hit_rank"))


cte(
    banded_rows="SELECT *, CASE WHEN pre_rank <= 10 THEN '001_010' WHEN pre_rank <= 30 THEN '011_030' WHEN pre_rank <= 60 THEN '031_060' WHEN pre_rank <= 100 THEN '061_100' ELSE '101_plus' END AS band FROM model_rows",
    banded_seeds="SELECT *, row_number() OVER (PARTITION BY user_id, band ORDER BY pre_rank, item_id) <= CASE band WHEN '001_010' THEN 2 WHEN '011_030' THEN 3 WHEN '031_060' THEN 2 ELSE 0 END AS seed FROM banded_rows WHERE label = 0",
)


def banded(b):
    from gristmill.functions.scalars import learned_rank_band

    return modelled(b).withColumn("band", learned_rank_band(F.col("pre_rank"))).withColumn("rank", F.col("pre_rank"))


@query("SELECT user_id, item_id, band, row_number() OVER (PARTITION BY user_id ORDER BY seed DESC, pre_rank, item_id) AS pick_order FROM banded_seeds QUALIFY pick_order <= 10")
def h3_layered_negatives(b):
    return out(sampling.layered_negatives(banded(b), {"001_010": 2, "011_030": 3, "031_060": 2}, 10).select("user_id", "item_id", "band", "pick_order"))


@query("SELECT c.user_id, c.item_id AS chosen, r.item_id AS rejected, r.pre_rank - c.pre_rank AS rank_gap, row_number() OVER (PARTITION BY c.user_id ORDER BY r.pre_rank - c.pre_rank DESC, r.item_id) AS nth FROM model_rows c JOIN model_rows r ON r.user_id = c.user_id AND c.label = 1 AND r.label = 0 AND c.pre_rank < r.pre_rank QUALIFY nth <= 5")
def h5_preference_pairs(b):
    pairs = sampling.preference_pairs(modelled(b).withColumns({"rank": F.col("pre_rank"), "score": F.col("head_score")}), 5)
    return out(pairs.select("user_id", "chosen", "rejected", "rank_gap", "nth"))


@query("SELECT n_users, truth_in_all, truth_in_pretrim, (truth_in_pretrim >= 0.01 AND pretrim_cut_loss <= 0.5 AND hard_miss <= 0.99) AS gate_pass FROM (SELECT count(*) AS n_users, round(avg((hit_rank IS NOT NULL)::INT), 6) AS truth_in_all, round(avg(coalesce(hit_rank <= 60, false)::INT), 6) AS truth_in_pretrim, round(avg((hit_rank IS NOT NULL)::INT) - avg(coalesce(hit_rank <= 60, false)::INT), 6) AS pretrim_cut_loss, round(1 - avg((hit_rank IS NOT NULL)::INT), 6) AS hard_miss FROM truth_ranks)")
def h7_gate(b):
    ranked = b.ranked
    return rescue.gate(metrics.recall_funnel(b.truth, ranked, ranked.where("pre_rank <= 60")), 0.01, 0.5, 0.99).select("n_users", "truth_in_all", "truth_in_pretrim", "gate_pass")


@query("SELECT user_id, item_id, round((head_score - min(head_score) OVER w) / (max(head_score) OVER w - min(head_score) OVER w + 1e-9), 6) AS min_max, round(CASE WHEN count(*) OVER w <= 1 THEN 0 ELSE (rank() OVER (PARTITION BY user_id ORDER BY head_score) + (count(*) OVER (PARTITION BY user_id, head_score) - 1) / 2.0 - 1) / (count(*) OVER w - 1) END, 6) AS rank_pct, round(1 / (1 + exp(-CASE WHEN stddev_pop(head_score) OVER w > 1e-9 THEN (head_score - avg(head_score) OVER w) / stddev_pop(head_score) OVER w ELSE 0 END)), 4) AS z_sigmoid FROM small_rows WINDOW w AS (PARTITION BY user_id)")
def h8_normalisers(b):
    v = F.col("head_score")
    return small(b).select("user_id", "item_id", F.round(features.min_max(v), 6).alias("min_max"), F.round(features.rank_pct(v), 6).alias("rank_pct"), F.round(features.z_sigmoid(v), 4).alias("z_sigmoid"))


BAND_W = "CASE WHEN pre_rank BETWEEN 11 AND 30 THEN 1.0 WHEN pre_rank BETWEEN 31 AND 60 THEN 0.7 WHEN pre_rank BETWEEN 61 AND 100 THEN 0.35 ELSE 0 END"
cte(
    rescue_rows=f"SELECT *, round(0.12 * model * {BAND_W}, 9) AS rescue_bonus FROM scaled_rows",
    rescue_scores="SELECT *, round(base + rescue_bonus, 9) AS final_score FROM rescue_rows",
    rescue_ranks="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, pre_rank, item_id) AS final_rank, max(CASE WHEN pre_rank = 10 THEN final_score END) OVER (PARTITION BY user_id) AS frontier FROM rescue_scores",
)


def rescued(b):
    rows = modelled(b).select("user_id", "item_id", "label", "pre_rank", F.col("pre_rank").alias("base_rank"), F.col("head_score").alias("base_score"), F.col("model_score").alias("sidecar_score"))
    return rescue.rescue_fusion(rows)


@query("SELECT user_id, item_id, rescue_bonus, final_rank FROM rescue_ranks")
def h9_rescue_fusion(b):
    return out(rescued(b).select("user_id", "item_id", "rescue_bonus", "final_rank"))


cte(short_seeds="SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY model_score DESC, item_id) <= 5 OR row_number() OVER (PARTITION BY user_id, band ORDER BY model_score DESC, item_id) <= 2)::INT AS seed FROM banded_rows")


@query("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY seed DESC, model_score DESC, item_id) AS place FROM short_seeds QUALIFY place <= 12")
def h10_shortlist(b):
    return out(rescue.shortlist(banded(b), "model_score", 5, 2, 12).select("user_id", "item_id", "place"))


cte(
    gate_rows="SELECT *, (pre_rank <= 10 OR coalesce(final_score - frontier, -1) >= 0.01) AS gate_pass FROM rescue_ranks",
    gate_ranks="SELECT user_id, item_id, gate_pass, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN pre_rank <= 10 THEN final_rank WHEN gate_pass THEN greatest(final_rank, 5) ELSE greatest(final_rank, pre_rank) END, final_score DESC, item_id) AS gated_rank FROM gate_rows",
)


@query("SELECT user_id, item_id, gate_pass, gated_rank FROM gate_ranks")
def h11_frontier_gate(b):
    return out(rescue.frontier_gate(rescued(b), 10, 0.01, 5).select("user_id", "item_id", "gate_pass", "gated_rank"))


@query("SELECT user_id, CASE WHEN min(CASE WHEN label = 1 THEN final_rank END) <= 10 THEN min(CASE WHEN label = 1 THEN final_rank END) END AS hit_rank FROM rescue_ranks GROUP BY user_id")
def h12_topk_eval(b):
    return out(rescue.first_hit(rescued(b), "final_rank", 10))


def h13_stacking(b):
    """Logistic regression over the ranks of two scorers."""
    ranks = rescued(b).select("label", F.col("base_rank").cast("double").alias("r1"), F.col("final_rank").cast("double").alias("r2"))
    rows = b.keep("weighed", lambda: ranking.weighed(ranks, "label", "r1", "r2"))
    scored = ranking.positive_probability(ranking.fit_logistic(rows, ["r1", "r2"], weight="n").transform(rows), "score")
    return metrics.calibration_bins(scored, weight="n")


query(None)(h13_stacking)

cte(
    serve_rows="SELECT user_id, item_id, base AS baseline_score, model AS xgboost_score, CASE WHEN user_id % 3 = 0 THEN NULL ELSE round(base + 0.1 * model, 9) END AS reward_score FROM scaled_rows",
    served_rows="SELECT user_id, item_id, CASE WHEN min((reward_score IS NOT NULL)::INT) OVER w = 1 THEN 'reward' ELSE 'xgboost' END AS used, CASE WHEN min((reward_score IS NOT NULL)::INT) OVER w = 1 THEN reward_score ELSE xgboost_score END AS served_score FROM serve_rows WINDOW w AS (PARTITION BY user_id)",
)


def served(b, strategy):
    rows = scaled(b).select("user_id", "item_id", F.col("base").alias("baseline_score"), F.col("model").alias("xgboost_score"), F.when(F.col("user_id") % 3 == 0, None).otherwise(F.round(F.col("base") + 0.1 * F.col("model"), 9)).alias("reward_score"))
    return serving.serve(rows, strategy, 5)


@query("SELECT user_id, item_id, used, row_number() OVER (PARTITION BY user_id ORDER BY served_score DESC, item_id) AS served_rank FROM served_rows QUALIFY served_rank <= 5")
def i1_serve_with_fallback(b):
    return out(served(b, "reward_rerank").select("user_id", "item_id", "used", "served_rank"))


@query("SELECT b.user_id, b.item_id, b.user_segment, p_brand AS brand, 'replay-' || b.user_id AS request_id FROM blend_ranked b JOIN part ON p_partkey = b.item_id WHERE blend_rank <= 3")
def i2_replay(b):
    brands = b.t("part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"))
    rows = blended(b).where("blend_rank <= 3").select("user_id", "item_id")
    return serving.replay(rows, b.segments.select("user_id", "user_segment"), brands)


@query("SELECT user_id, item_id, blend_rank FROM blend_ranked WHERE user_id = 7")
def i3_single_user(b):
    return out(blended(b).where("user_id = 7").select("user_id", "item_id", "blend_rank"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def i4_latency_summary(b):
    return serving.latency_summary(b.t("events"), "value", "event_type")

