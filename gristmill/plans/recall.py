"""Queries: splits, routes, fusion, cuts and recall audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.scalars import pre_rank_band
from gristmill.operators import baselines, fusion, metrics, routes, split
from gristmill.plans.base import MIN_EVENTS
from gristmill.plans.registry import query
from gristmill.plans.sql import CTES, ILR, NUDGE, SETTLED, cte


def out(df, **types):
    """Ranks and counts as long, so that both engines agree on the width."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def floats(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def settled(df, *names, places=6):
    """Rounded with half-way cases up, for values that are made of decimal ones and would fall on either side by a last bit."""
    return df.withColumns({n: F.round(F.col(n) + NUDGE, places) for n in names})


ROUTE = "SELECT user_id, item_id, source, CAST(source_rank AS BIGINT) AS source_rank, round(source_score, 6) AS source_score, round(source_confidence, 6) AS source_confidence FROM {}"
#: Of scores that the route itself has rounded already.
ROUNDED = "SELECT user_id, item_id, source, CAST(source_rank AS BIGINT) AS source_rank, CAST(source_score AS DOUBLE) AS source_score, round(source_confidence, 6) AS source_confidence FROM {}"


def route(df):
    return out(floats(df.select(*routes.COLUMNS), "source_score", "source_confidence"))


def rounded_route(df):
    return out(floats(df.select(*routes.COLUMNS), "source_confidence"))


@query("SELECT user_id, item_id, ts, rating, review_id, rn, part FROM split_events")
def a1_leave_two_out(b):
    return out(split.leave_two_out(b.interactions, MIN_EVENTS).select("user_id", "item_id", "ts", "rating", "review_id", "rn", "part"))


@query(f"SELECT user_segment, count(*) AS n_users, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit_rank <= 10 THEN {ILR('hit_rank')} ELSE 0.0 END), 6) AS ndcg_at_k FROM (SELECT t.user_id, p.source_rank AS hit_rank, user_segment FROM truth_items t JOIN user_segments USING (user_id) LEFT JOIN popular_rows p ON p.user_id = t.user_id AND p.item_id = t.item_id) GROUP BY user_segment")
def a1_leave_two_out_popular_eval(b):
    hits = metrics.rank_of_truth(b.truth, b.popular, "source_rank").join(b.segments, "user_id")
    return metrics.ranking_metrics(hits, 10, "user_segment")


cte(
    last_out="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) AS lrn FROM interactions",
)


@query("SELECT count(*) AS cold_items, coalesce(sum(item_id), 0)::BIGINT AS ids FROM (SELECT DISTINCT item_id FROM last_out WHERE lrn = 1 EXCEPT SELECT item_id FROM last_out WHERE lrn > 1)")
def a2_leave_last_out_cold_items(b):
    return split.cold_items(split.leave_last_out(b.interactions)).agg(F.count(F.lit(1)).alias("cold_items"), F.coalesce(F.sum("item_id"), F.lit(0)).alias("ids"))


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER (ORDER BY count(*) DESC, CAST(item_id AS VARCHAR)) - 1 AS idx FROM interactions GROUP BY item_id")
def a3_index_ids(b):
    return out(split.index_ids(b.interactions, "item_id"))


@query("SELECT user_id, user_train_count, user_segment FROM user_segments")
def a4_user_segments(b):
    return b.segments


@query("SELECT item_id, item_train_pop_count FROM item_counts")
def a4_item_popularity(b):
    return b.popularity


@query("SELECT user_id, item_id, hist_ts, hist_rating, days_to_test, round(hist_recency_w, 6) AS hist_recency_w FROM history")
def a5_train_history(b):
    return floats(b.history, "hist_recency_w")


def b1_als_route(b):
    return out(routes.als_route(b.users, b.train, 20))


query(None)(b1_als_route)


@query(ROUTE.format("cluster_rows"))
def b2_cluster_route(b):
    return route(b.cluster)


@query(ROUTE.format("popular_rows"))
def b3_popular_route(b):
    return route(b.popular)


WIDE = 8
cte(
    user_vectors=f"SELECT user_id, list_transform(embedding[1:{WIDE}], lambda x: CAST(x AS DOUBLE)) AS vector, (user_id % 100) / 100.0 AS confidence FROM user_segments JOIN embeddings ON vec_id = user_id % 500",
    weighed_events="SELECT e.item_id, e.user_id, greatest((0.25 + 0.75 * confidence) * sqrt(0.5 + 0.5 * rating / 5) * power(CAST(user_train_count AS DOUBLE), -0.25), 0.05) AS w, vector FROM train_events e JOIN user_segments USING (user_id) JOIN user_vectors v ON v.user_id = e.user_id",
    raw_item_vectors="SELECT item_id, [" + ", ".join(f"sum(w * vector[{i + 1}])" for i in range(WIDE)) + "] AS v FROM weighed_events GROUP BY item_id",
    unit_item_vectors="SELECT item_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM raw_item_vectors",
    unit_user_vectors="SELECT user_id, confidence, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u FROM user_vectors",
    vector_rows="SELECT t.user_id, i.item_id, 'profile' AS source, row_number() OVER (PARTITION BY t.user_id ORDER BY round(list_dot_product(u, v), 6) DESC, i.item_id) AS source_rank, round(list_dot_product(u, v), 6) AS source_score, confidence AS source_confidence FROM truth_items t JOIN unit_user_vectors uv ON uv.user_id = t.user_id CROSS JOIN unit_item_vectors i WHERE confidence >= 0.3 AND round(list_dot_product(u, v), 6) >= -1 QUALIFY source_rank <= 20",
)


def user_vectors(b):
    v = b.t("embeddings").select("vec_id", F.slice("embedding", 1, WIDE).alias("vector"))
    return b.segments.select("user_id").join(v, F.col("user_id") % 500 == F.col("vec_id")).select("user_id", F.col("vector").cast("array<double>").alias("vector"), ((F.col("user_id") % 100) / 100.0).alias("confidence"))


@query(ROUNDED.format("vector_rows"))
def b4_profile_vector_route(b):
    vectors = user_vectors(b)
    return rounded_route(routes.vector_route(b.users, vectors, routes.item_vectors(b.train, vectors, WIDE), 20))


@query(ROUNDED.format("profile_rows"))
def b5_tag_route(b):
    return rounded_route(b.profile)


cte(
    bridge_tags="SELECT user_id, tag_type, tag, weight FROM user_tags QUALIFY row_number() OVER (PARTITION BY tag_type, tag ORDER BY abs(weight) DESC, user_id) <= 3000",
    bridge_len="SELECT user_id, sqrt(sum(weight * weight)) AS len FROM bridge_tags GROUP BY user_id",
    bridge_near="SELECT a.user_id, b.user_id AS other, round(sum(a.weight * b.weight) / max(x.len * y.len), 9) AS sim FROM bridge_tags a JOIN bridge_tags b ON a.tag_type = b.tag_type AND a.tag = b.tag AND a.user_id <> b.user_id JOIN bridge_len x ON x.user_id = a.user_id JOIN bridge_len y ON y.user_id = b.user_id WHERE a.user_id IN (SELECT user_id FROM truth_items) GROUP BY a.user_id, b.user_id",
    bridge_best="SELECT user_id, other, sim FROM bridge_near WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) <= 24",
    liked_items="SELECT user_id AS other, item_id, max(rating) AS rating FROM train_events GROUP BY user_id, item_id",
    bridge_scores="SELECT user_id, item_id, round(sum(sim * (0.5 + 0.5 * rating / 5)) / sum(sim), 9) AS source_score, round(0.8 + 0.2 * count(*) / 24, 6) AS source_confidence FROM bridge_best JOIN liked_items USING (other) GROUP BY user_id, item_id",
    bridge_rows="SELECT user_id, item_id, 'profile' AS source, row_number() OVER (PARTITION BY user_id ORDER BY source_score DESC, source_confidence DESC, item_id) AS source_rank, source_score, source_confidence FROM bridge_scores QUALIFY source_rank <= 20",
    type_users="SELECT user_id, tag_type, sum(weight) AS w FROM user_tags GROUP BY user_id, tag_type",
    type_items="SELECT item_id, tag_type, sum(weight) AS w2 FROM item_tags GROUP BY item_id, tag_type",
    type_scores="SELECT u.user_id, item_id, round(sum(w * w2) / max(total), 9) AS source_score FROM type_users u JOIN type_items i USING (tag_type) JOIN (SELECT user_id, sum(abs(w)) AS total FROM type_users GROUP BY user_id) t ON t.user_id = u.user_id GROUP BY u.user_id, item_id",
    type_rows="SELECT user_id, item_id, 'profile' AS source, row_number() OVER (PARTITION BY user_id ORDER BY source_score DESC, item_id) AS source_rank, source_score, 1.0 AS source_confidence FROM type_scores WHERE source_score > 0 QUALIFY source_rank <= 20",
)


@query(ROUNDED.format("bridge_rows"))
def b6_bridge_user_route(b):
    return rounded_route(routes.bridge_user_route(b.users, b.user_tags, b.train, 20))


@query(ROUNDED.format("type_rows"))
def b7_bridge_type_route(b):
    return rounded_route(routes.bridge_type_route(b.users, b.user_tags, b.item_tags, 20))


cte(
    mv_short=CTES["vector_rows"].replace("'profile'", "'profile_mv_short_semantic'").replace("source_rank <= 20", "source_rank <= 10"),
    mv_user_tail=f"SELECT user_id, list_transform(embedding[{WIDE + 1}:{2 * WIDE}], lambda x: CAST(x AS DOUBLE)) AS vector, (user_id % 100) / 100.0 AS confidence FROM user_segments JOIN embeddings ON vec_id = user_id % 500",
    mv_long=CTES["vector_rows"].replace("'profile'", "'profile_mv_long_core'").replace("unit_user_vectors", "(SELECT user_id, confidence, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u FROM mv_user_tail)").replace("source_rank <= 20", "source_rank <= 10").replace("list_dot_product(u, v), 6) >= -1", "list_dot_product(u, v), 6) >= 0.1"),
)


@query(ROUNDED.format("(SELECT * FROM mv_short UNION ALL SELECT * FROM mv_long)"))
def b8_multivector_routes(b):
    short = user_vectors(b)
    items = routes.item_vectors(b.train, short, WIDE)
    e = b.t("embeddings").select("vec_id", F.slice("embedding", WIDE + 1, WIDE).cast("array<double>").alias("vector"))
    long_ = b.segments.select("user_id").join(e, F.col("user_id") % 500 == F.col("vec_id")).select("user_id", "vector", ((F.col("user_id") % 100) / 100.0).alias("confidence"))
    one = routes.vector_route(b.users, short, items, 10, source="profile_mv_short_semantic")
    return rounded_route(one.unionByName(routes.vector_route(b.users, long_, items, 10, least_score=0.1, source="profile_mv_long_core")))


cte(
    merged_best="SELECT user_id, item_id, count(*) AS n_routes, max(struct_pack(s := source_score, c := source_confidence, r := -source_rank)) AS best FROM (SELECT * FROM profile_rows UNION ALL SELECT * FROM type_rows) GROUP BY user_id, item_id",
    merged_rows="SELECT user_id, item_id, 'profile' AS source, row_number() OVER (PARTITION BY user_id ORDER BY best.s DESC, best.c DESC, n_routes DESC, item_id) AS source_rank, best.s AS source_score, best.c AS source_confidence FROM merged_best QUALIFY source_rank <= 40",
)


@query(ROUNDED.format("merged_rows"))
def b9_merge_profile_routes(b):
    return rounded_route(routes.merge_routes(b.profile.unionByName(routes.bridge_type_route(b.users, b.user_tags, b.item_tags, 20)), 40))


WEIGHTS = {"bias": -0.5, "score": 1.2, "rank": -0.01, "confidence": 0.3, "score_confidence": 0.4, "score_rank": 0.6}
cte(
    calibrated_scores=f"SELECT user_id, item_id, source, source_confidence, round(1 / (1 + exp(-(-0.5 + 1.2 * source_score - 0.01 * source_rank + 0.3 * source_confidence + 0.4 * source_score * source_confidence + 0.6 * source_score * {ILR('source_rank')}))), 9) AS source_score FROM profile_rows",
)


@query(ROUNDED.format("(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_score DESC, item_id) AS source_rank FROM calibrated_scores QUALIFY source_rank <= 30)"))
def b10_calibrate_route(b):
    return rounded_route(routes.calibrate(b.profile, WEIGHTS, 30))


cte(
    item_traits="SELECT p_partkey AS item_id, p_size / 50.0 AS small, p_retailprice / 2000.0 AS price, 29.9 + (p_partkey % 40) / 100.0 AS lat, -90.1 + (p_partkey % 37) / 100.0 AS lon, coalesce(item_train_pop_count, 0) AS support FROM part LEFT JOIN item_counts ON item_id = p_partkey",
    context_users="SELECT user_id, sum(w * small) / sum(w) AS small, sum(w * price) / sum(w) AS price, sum(w * lat) / sum(w) AS lat, sum(w * lon) / sum(w) AS lon FROM (SELECT h.user_id, i.*, (0.35 + 0.65 * hist_rating / 5) * exp(-days_to_test / 180.0) AS w FROM history h JOIN truth_items t ON t.user_id = h.user_id JOIN item_traits i ON i.item_id = h.item_id) GROUP BY user_id",
    context_scores="SELECT u.user_id, i.item_id, round(greatest(least((0.6 * (u.small * i.small + u.price * i.price) / (sqrt(u.small * u.small + u.price * u.price) * sqrt(i.small * i.small + i.price * i.price)) + 0.4 * exp(-(6371.0 * 2 * asin(least(sqrt(power(sin(radians(i.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(i.lat)) * power(sin(radians(i.lon - u.lon) / 2), 2)), 1.0))) / 8.0)) * (0.82 + 0.18 * least(ln(1 + support) / ln(51.0), 1.0)), 1.5), 0.0), 6) AS source_score FROM context_users u CROSS JOIN item_traits i",
    context_rows="SELECT user_id, item_id, 'context' AS source, row_number() OVER (PARTITION BY user_id ORDER BY source_score DESC, item_id) AS source_rank, source_score, 1.0 AS source_confidence FROM context_scores WHERE source_score >= 0.05 QUALIFY source_rank <= 20",
)


@query(ROUNDED.format("context_rows"))
def b11_context_route(b):
    p = b.t("part").join(b.popularity, F.col("item_id") == F.col("p_partkey"), "left")
    traits = p.select(F.col("p_partkey").alias("item_id"), (F.col("p_size") / 50.0).alias("small"), (F.col("p_retailprice") / 2000.0).alias("price"), (29.9 + (F.col("p_partkey") % 40) / 100.0).alias("lat"), (-90.1 + (F.col("p_partkey") % 37) / 100.0).alias("lon"), F.coalesce("item_train_pop_count", F.lit(0)).alias("support"))
    return rounded_route(routes.context_route(b.users, b.history, traits, ["small", "price"], 20))


@query(f"SELECT user_id, item_id, source, user_segment, {SETTLED('source_weight * source_norm * source_confidence')} AS signal_score, {SETTLED('quality_score')} AS quality_score FROM scored_rows")
def c1_source_scores(b):
    s = fusion.score_sources(b.candidates, b.segments, b.listed_items)
    return settled(s, "signal_score", "quality_score").select("user_id", "item_id", "source", "user_segment", "signal_score", "quality_score")


@query(f"SELECT user_id, item_id, {SETTLED('signal_score')} AS signal_score, {SETTLED('quality_score')} AS quality_score, sources, cluster_rank::BIGINT AS cluster_rank, popular_rank::BIGINT AS popular_rank, profile_rank::BIGINT AS profile_rank FROM fused_rows")
def c2_fuse(b):
    f = fusion.fuse(fusion.score_sources(b.candidates, b.segments, b.listed_items))
    return out(settled(f, "signal_score", "quality_score").select("user_id", "item_id", "signal_score", "quality_score", F.array_join("source_set", ",").alias("sources"), "cluster_rank", "popular_rank", "profile_rank"))


@query("SELECT user_id, item_id, source_count, nonpopular_source_count, profile_cluster_source_count, has_popular FROM flagged_rows")
def c3_source_flags(b):
    return b.fused.select("user_id", "item_id", "source_count", "nonpopular_source_count", "profile_cluster_source_count", "has_popular")


cte(
    semantic_rows="SELECT user_id, item_id, (item_id % 10) / 10.0 AS semantic_score, (item_id % 7) / 7.0 AS semantic_confidence, CAST(item_train_pop_count AS DOUBLE) AS semantic_support, CAST(item_id % 12 AS DOUBLE) AS semantic_tag_richness, item_train_pop_count, user_segment, profile_cluster_source_count FROM flagged_rows",
)


def semantic(b):
    return b.fused.withColumns({"semantic_score": (F.col("item_id") % 10) / 10.0, "semantic_confidence": (F.col("item_id") % 7) / 7.0, "semantic_support": F.col("item_train_pop_count").cast("double"), "semantic_tag_richness": (F.col("item_id") % 12).cast("double")})


@query("SELECT user_id, item_id, round(semantic_score * semantic_confidence * least(ln(semantic_support + 1) / ln(61.0), 1.0) * (0.75 + 0.25 * least(semantic_tag_richness / 8.0, 1.0)), 6) AS semantic_effective_score FROM semantic_rows")
def c4_semantic_gates(b):
    return floats(fusion.semantic_gates(semantic(b), fusion.FusionPolicy()), "semantic_effective_score").select("user_id", "item_id", "semantic_effective_score")


@query("SELECT user_id, item_id, round(gate, 6) AS item_pop_gate, round(ln(2.0) / ln(item_train_pop_count + 2.0), 6) AS item_pop_inv, round(greatest(0.6, 1 - 0.25 * gate - 0.1 * gate * (user_segment = 'heavy')::INT - 0.15 * gate * (profile_cluster_source_count <= 0.5)::INT), 6) AS als_backbone_mult FROM (SELECT *, least(ln(item_train_pop_count + 1.0) / ln(201.0), 1.0) AS gate FROM semantic_rows)")
def c5_debias(b):
    return floats(fusion.debias(semantic(b)), "item_pop_gate", "item_pop_inv", "als_backbone_mult").select("user_id", "item_id", "item_pop_gate", "item_pop_inv", "als_backbone_mult")


@query("SELECT user_id, item_id, pre_score FROM pre_rows")
def c6_pre_score(b):
    return fusion.pre_score(b.fused, fusion.FusionPolicy()).select("user_id", "item_id", "pre_score")


@query("SELECT user_id, item_id, pre_rank, head_score FROM ranked_rows")
def c7_head_policy(b):
    return out(b.ranked.select("user_id", "item_id", "pre_rank", "head_score"))


@query(f"SELECT user_id, item_id, round(0.32 * {ILR('profile_rank')} + 0.16 * {ILR('cluster_rank')} + 0.04 * nonpopular_source_count + 0.05 * profile_cluster_source_count + 0.10 * ln(2.0) / ln(item_train_pop_count + 2.0) - 0.08 * least(ln(item_train_pop_count + 1.0) / ln(201.0), 1.0) - 0.04 * has_popular, 9) AS challenger_score FROM ranked_rows WHERE pre_rank <= 300 AND item_train_pop_count <= 60 AND nonpopular_source_count >= 1 AND has_popular < 0.5")
def c8_challenger(b):
    scored = fusion.challenger_score(fusion.debias(b.ranked.withColumn("semantic_support", F.lit(0.0))))
    return scored.where("challenger_ok").select("user_id", "item_id", "challenger_score")


BONUS = 0.015
cte(
    challenger_rows=f"SELECT *, (pre_rank <= 300 AND item_train_pop_count <= 60 AND nonpopular_source_count >= 1 AND profile_cluster_source_count >= 1 AND has_popular < 0.5) AS challenger_ok, round(0.32 * {ILR('profile_rank')} + 0.16 * {ILR('cluster_rank')} + 0.04 * nonpopular_source_count + 0.05 * profile_cluster_source_count + 0.10 * ln(2.0) / ln(item_train_pop_count + 2.0) - 0.08 * least(ln(item_train_pop_count + 1.0) / ln(201.0), 1.0) - 0.04 * has_popular, 9) AS raw_challenger FROM ranked_rows",
    bonus_rows=f"SELECT * EXCLUDE (pre_rank, head_score), round(head_score + CASE WHEN challenger_ok THEN {BONUS} ELSE 0 END, 9) AS head_score, head_score AS head_seed, CASE WHEN challenger_ok THEN raw_challenger ELSE 0 END AS challenger_score FROM challenger_rows",
    bonus_ranks="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY head_score DESC, head_seed DESC, pre_score DESC, item_id) AS pre_rank FROM bonus_rows",
)


def challenged(b):
    scored = fusion.challenger_score(fusion.debias(b.ranked.withColumn("semantic_support", F.lit(0.0))))
    return fusion.head_bonus(scored, BONUS)


@query("SELECT user_id, item_id, pre_rank, head_score FROM bonus_ranks")
def c8_head_bonus(b):
    return out(challenged(b).select("user_id", "item_id", "pre_rank", "head_score"))


LAYERS = fusion.Layers(front=20, rescue=5, rescue_max_rank=60, l1=15, l2=12, l3=6, l1_ranks=(10, 12, 12), l2_ranks=(40, 40, 40))
POLICY = fusion.FusionPolicy(keep={"light": 40, "mid": 50, "heavy": 60})
cte(
    tiered_rows=f"SELECT *, CASE WHEN pre_rank > 20 AND pre_rank <= 60 AND nonpopular_source_count >= 2 AND profile_cluster_source_count >= 1 THEN 2 WHEN cluster_rank <= 12 OR profile_rank <= 12 THEN 3 WHEN cluster_rank <= 40 OR profile_rank <= 40 THEN 4 ELSE 5 END AS tier, round({ILR('profile_rank')} + {ILR('cluster_rank')} + 0.03 * nonpopular_source_count + 0.01 * source_count, 9) AS rescue_score, CASE user_segment WHEN 'light' THEN 40 WHEN 'mid' THEN 50 ELSE 60 END AS size FROM ranked_rows",
    tier_ranks="SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY CASE WHEN tier = 2 THEN rescue_score ELSE 0 END DESC, pre_rank, item_id) AS tier_rank FROM tiered_rows",
    seed_rows="SELECT *, (pre_rank <= 20 OR tier_rank <= CASE tier WHEN 2 THEN 5 WHEN 3 THEN 15 WHEN 4 THEN 12 ELSE 6 END) AS seed FROM tier_ranks",
    rest_rows="SELECT *, count(*) FILTER (WHERE seed) OVER (PARTITION BY user_id) AS seeds, row_number() OVER (PARTITION BY user_id, seed ORDER BY pre_rank, item_id) AS rest_rank FROM seed_rows",
    pool_rows="SELECT *, CASE WHEN NOT seed THEN 5 WHEN pre_rank <= 20 THEN 0 ELSE tier + 1 END AS priority, CASE WHEN NOT seed THEN rest_rank WHEN pre_rank <= 20 THEN pre_rank ELSE tier_rank END AS place FROM rest_rows WHERE seed OR rest_rank <= greatest(size - seeds, 0)",
    layered_rows="SELECT user_id, item_id, size, row_number() OVER (PARTITION BY user_id ORDER BY priority, place, pre_rank, item_id) AS layered_rank FROM pool_rows",
)


FULL_LAYERS = fusion.Layers(front=20, challenger=6, lane=0, rescue=5, rescue_max_rank=60, l1=15, l2=12, l3=6, l1_ranks=(10, 12, 12), l2_ranks=(40, 40, 40))
cte(
    full_tiered=f"SELECT *, CASE WHEN pre_rank > 20 AND challenger_ok THEN 0 WHEN pre_rank > 20 AND pre_rank <= 60 AND nonpopular_source_count >= 2 AND profile_cluster_source_count >= 1 THEN 2 WHEN cluster_rank <= 12 OR profile_rank <= 12 THEN 3 WHEN cluster_rank <= 40 OR profile_rank <= 40 THEN 4 ELSE 5 END AS tier, round({ILR('profile_rank')} + {ILR('cluster_rank')} + 0.03 * nonpopular_source_count + 0.01 * source_count, 9) AS rescue_score, CASE user_segment WHEN 'light' THEN 40 WHEN 'mid' THEN 50 ELSE 60 END AS size FROM bonus_ranks",
    full_ranks="SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY CASE tier WHEN 0 THEN challenger_score WHEN 2 THEN rescue_score ELSE 0 END DESC, pre_rank, item_id) AS tier_rank FROM full_tiered",
    full_seeds="SELECT *, (pre_rank <= 20 OR tier_rank <= CASE tier WHEN 0 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 15 WHEN 4 THEN 12 ELSE 6 END) AS seed FROM full_ranks",
    full_rest="SELECT *, count(*) FILTER (WHERE seed) OVER (PARTITION BY user_id) AS seeds, row_number() OVER (PARTITION BY user_id, seed ORDER BY pre_rank, item_id) AS rest_rank FROM full_seeds",
    full_pool="SELECT *, CASE WHEN NOT seed THEN 5 WHEN pre_rank <= 20 THEN 0 ELSE tier + 1 END AS priority, CASE WHEN NOT seed THEN rest_rank WHEN pre_rank <= 20 THEN pre_rank ELSE tier_rank END AS place FROM full_rest WHERE seed OR rest_rank <= greatest(size - seeds, 0)",
    full_layered="SELECT user_id, item_id, size, row_number() OVER (PARTITION BY user_id ORDER BY priority, place, pre_rank, item_id) AS layered_rank FROM full_pool",
)


@query("SELECT user_id, item_id, layered_rank AS pre_rank FROM full_layered WHERE layered_rank <= size")
def c9_layered_with_challengers(b):
    return out(fusion.layered_cut(challenged(b), FULL_LAYERS, POLICY).select("user_id", "item_id", "pre_rank"))


@query("SELECT user_id, item_id, layered_rank AS pre_rank FROM layered_rows WHERE layered_rank <= size")
def c9_layered_pretrim(b):
    return out(fusion.layered_cut(b.ranked, LAYERS, POLICY).select("user_id", "item_id", "pre_rank"))


@query("SELECT user_id, item_id, pre_rank FROM ranked_rows WHERE pre_rank <= CASE user_segment WHEN 'light' THEN 40 WHEN 'mid' THEN 50 ELSE 60 END")
def c10_flat_pretrim(b):
    return out(fusion.flat_cut(b.ranked, POLICY).select("user_id", "item_id", "pre_rank"))


cte(
    sequence_rows="SELECT user_id, item_id, ts, review_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) AS nth FROM train_events QUALIFY nth <= 10",
    sequence_brand="SELECT user_id, cluster_id, sum(power(0.85, nth - 1)) AS w FROM sequence_rows JOIN clusters USING (item_id) GROUP BY user_id, cluster_id",
)


@query("SELECT r.user_id, r.item_id, round(coalesce(w, 0), 6) AS seq_score FROM ranked_rows r JOIN clusters c ON c.item_id = r.item_id LEFT JOIN sequence_brand s ON s.user_id = r.user_id AND s.cluster_id = c.cluster_id")
def c11_sequence_features(b):
    from gristmill.operators import sequence

    recent = sequence.recent_weights(b.train, 10, 0.85).join(b.clusters, "item_id").groupBy("user_id", "cluster_id").agg(F.sum("w").alias("w"))
    rows = b.ranked.join(b.clusters, "item_id").join(recent, ["user_id", "cluster_id"], "left")
    return rows.select("user_id", "item_id", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("seq_score"))


def c11_tower_features(b):
    from gristmill.operators import sequence

    return out(floats(sequence.tower_scores(b.ranked, b.train), "tower_score").select("user_id", "item_id", "tower_score", "tower_rank"))


query(None)(c11_tower_features)


@query(f"SELECT count(*) AS n_users, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit_rank <= 10 THEN {ILR('hit_rank')} ELSE 0 END), 6) AS ndcg_at_k FROM truth_ranks")
def c12_quick_eval(b):
    return metrics.ranking_metrics(metrics.rank_of_truth(b.truth, b.ranked, "pre_rank"), 10)


@query("SELECT count(*) AS n_users, round(avg(a), 6) AS truth_in_all, round(avg(p), 6) AS truth_in_pretrim, round(avg(a) - avg(p), 6) AS pretrim_cut_loss, round(1 - avg(a), 6) AS hard_miss FROM (SELECT (hit_rank IS NOT NULL)::INT AS a, coalesce(hit_rank <= 60, false)::INT AS p FROM truth_ranks)")
def d1_recall_funnel(b):
    ranked = b.ranked
    return metrics.recall_funnel(b.truth, ranked, ranked.where("pre_rank <= 60"))


@query("SELECT count(*) AS n_hits, round(avg((hit_rank <= 10)::INT), 6) AS within_10, round(avg((hit_rank <= 30)::INT), 6) AS within_30, round(avg((hit_rank <= 80)::INT), 6) AS within_80 FROM truth_ranks WHERE hit_rank IS NOT NULL")
def d2_rank_thresholds(b):
    return metrics.rank_thresholds(metrics.rank_of_truth(b.truth, b.ranked, "pre_rank"), (10, 30, 80))


@query("SELECT round(avg(n), 6) AS avg_pool, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_pool, max(n)::BIGINT AS max_pool FROM (SELECT t.user_id, count(r.item_id) AS n FROM truth_items t LEFT JOIN ranked_rows r ON r.user_id = t.user_id GROUP BY t.user_id)")
def d3_pool_sizes(b):
    return metrics.pool_sizes(b.truth, b.ranked)


cte(
    route_hits="SELECT DISTINCT t.user_id, c.source FROM truth_items t JOIN candidate_rows c ON c.user_id = t.user_id AND c.item_id = t.item_id",
    route_hit_counts="SELECT *, count(*) OVER (PARTITION BY user_id) AS n_routes FROM route_hits",
)


@query("SELECT source, round(1 - (SELECT count(DISTINCT user_id) FROM route_hits) / CAST((SELECT count(*) FROM truth_items) AS DOUBLE), 6) AS zero_hit, round(count(*) / CAST((SELECT count(*) FROM truth_items) AS DOUBLE), 6) AS any_hit, round(sum((n_routes = 1)::INT) / CAST((SELECT count(*) FROM truth_items) AS DOUBLE), 6) AS unique_hit, round(avg(n_routes), 6) AS overlap FROM route_hit_counts GROUP BY source")
def d4_route_attribution(b):
    return metrics.route_attribution(b.truth, b.candidates)


cte(
    pop_cuts="SELECT quantile_cont(item_train_pop_count, 0.2) AS low, quantile_cont(item_train_pop_count, 0.8) AS high FROM item_counts",
    pop_bands="SELECT item_id, item_train_pop_count, CASE WHEN item_train_pop_count <= low THEN 'tail' WHEN item_train_pop_count >= high THEN 'head' ELSE 'mid' END AS pop_band FROM item_counts CROSS JOIN pop_cuts",
)


@query("SELECT user_segment, coalesce(pop_band, 'cold') AS pop_band, count(*) AS n, round(avg((hit_rank IS NOT NULL)::INT), 6) AS hit_rate, CAST(quantile_cont(item_train_pop_count, 0.5) AS DOUBLE) AS median_pop FROM truth_ranks JOIN user_segments USING (user_id) LEFT JOIN pop_bands USING (item_id) GROUP BY ALL")
def d5_segment_popularity_audit(b):
    hits = metrics.rank_of_truth(b.truth, b.ranked, "pre_rank").join(b.segments, "user_id").join(metrics.popularity_band(b.popularity), "item_id", "left")
    return hits.groupBy("user_segment", F.coalesce("pop_band", F.lit("cold")).alias("pop_band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit_rank").isNotNull().cast("int")), 6).alias("hit_rate"), F.percentile("item_train_pop_count", F.lit(0.5)).cast("double").alias("median_pop"))


@query("SELECT CASE WHEN pre_rank <= 10 THEN '001_010' WHEN pre_rank <= 30 THEN '011_030' WHEN pre_rank <= 80 THEN '031_080' WHEN pre_rank <= 150 THEN '081_150' ELSE '151_plus' END AS band, count(*) AS n FROM ranked_rows GROUP BY band")
def p_rank_bands(b):
    return b.ranked.groupBy(pre_rank_band(F.col("pre_rank")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


cte(
    fav_type="SELECT user_id, p_type FROM train_events JOIN part ON p_partkey = item_id GROUP BY user_id, p_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, p_type) = 1",
    type_popular="SELECT p_type, item_id, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, item_id) AS nth FROM train_events JOIN part ON p_partkey = item_id GROUP BY p_type, item_id QUALIFY nth <= 10",
    type_lists="SELECT user_id, c.item_id, nth AS rank FROM truth_items JOIN fav_type USING (user_id) JOIN type_popular c USING (p_type)",
)


def types(b):
    return b.t("part").select(F.col("p_partkey").alias("item_id"), "p_type")


@query("SELECT user_id, item_id, rank::BIGINT AS rank FROM type_lists")
def j1_category_popular(b):
    return out(baselines.group_popular_lists(b.train, b.users, types(b), "p_type", 10))


@query("SELECT user_id, item_id, rank::BIGINT AS rank FROM type_lists WHERE user_id IN (SELECT user_id FROM user_segments WHERE user_segment = 'heavy') UNION ALL SELECT user_id, item_id, source_rank::BIGINT FROM popular_rows WHERE source_rank <= 10 AND user_id NOT IN (SELECT user_id FROM user_segments WHERE user_segment = 'heavy')")
def j2_activity_hybrid(b):
    popular = b.popular.where("source_rank <= 10").select("user_id", "item_id", F.col("source_rank").alias("rank"))
    return out(baselines.hybrid_by_activity(b.segments, baselines.group_popular_lists(b.train, b.users, types(b), "p_type", 10), popular))


@query("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(head_score + 0.05 * in_fav, 9) DESC, item_id) AS rank FROM (SELECT r.user_id, r.item_id, head_score, (p.p_type = f.p_type)::INT AS in_fav FROM ranked_rows r JOIN part p ON p_partkey = r.item_id JOIN fav_type f ON f.user_id = r.user_id) QUALIFY rank <= 10")
def j2_cluster_bonus(b):
    fav = baselines.favourite_group(b.train, types(b), "p_type").withColumnRenamed("p_type", "fav")
    rows = b.ranked.join(types(b), "item_id").join(fav, "user_id").select("user_id", "item_id", F.col("head_score").alias("score"), (F.col("p_type") == F.col("fav")).cast("int").alias("in_favourite"))
    return out(baselines.cluster_bonus(rows, 0.05).where("rank <= 10").select("user_id", "item_id", "rank"))


def j3_als_grid(b):
    """Hit rate at 20 of each (rank, reg); a query per cell, since a factorisation is a job of its own."""
    cells = []
    for rank, reg in ((8, 0.1), (16, 0.3)):
        found = routes.als_lists(b.users, b.train, 20, rank=rank, reg=reg, iterations=3)
        cells.append(metrics.ranking_metrics(metrics.rank_in_lists(b.truth, found), 20).withColumns({"rank": F.lit(rank), "reg": F.lit(reg)}))
    return out(cells[0].unionByName(cells[1]))


query(None)(j3_als_grid)
