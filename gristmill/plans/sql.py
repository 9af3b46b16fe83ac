"""The same relations in SQL, as named common table expressions, for checking the DataFrame plans against another engine."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(**named: str) -> None:
    CTES.update(named)


def sql(body: str) -> str:
    """``body`` with the expressions that it needs, and those that these need, in the order of their definition."""
    names = list(CTES)
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in needed and re.search(rf"\b{n}\b", text):
                needed.add(n)
                todo.append(CTES[n])
    # Materialised: several of them are read by many others, and would be computed anew for each.
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names if n in needed)
    return f"WITH {head} {body}" if head else body


#: Added before a value made of decimal ones is rounded, so that half-way cases go up in either engine.
NUDGE = 3.7e-11

ILR = lambda c: f"(CASE WHEN {c} IS NULL THEN 0.0 ELSE ln(2.0) / ln(CAST({c} AS DOUBLE) + 1) END)"
SETTLED = lambda x, places=6: f"round({x} + {NUDGE}, {places})"

cte(
    interactions="SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, CAST(least(ceil(l_quantity / 10), 5) AS DOUBLE) AS rating, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || strftime(l_shipdate, '%Y%m%d') || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS review_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    counted_events="SELECT *, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) AS rn FROM interactions",
    split_events="SELECT user_id, item_id, ts, rating, review_id, rn, CASE WHEN rn = 1 THEN 'test' WHEN rn = 2 THEN 'valid' ELSE 'train' END AS part FROM counted_events WHERE n_events >= 7",
    train_events="SELECT * FROM split_events WHERE part = 'train'",
    truth_items="SELECT user_id, item_id, ts FROM split_events WHERE part = 'test'",
    user_segments="SELECT user_id, count(*) AS user_train_count, CASE WHEN count(*) <= 7 THEN 'light' WHEN count(*) <= 19 THEN 'mid' ELSE 'heavy' END AS user_segment FROM train_events GROUP BY user_id",
    item_counts="SELECT item_id, count(*) AS item_train_pop_count FROM train_events GROUP BY item_id",
    history_rows="SELECT e.user_id, e.item_id, e.ts AS hist_ts, e.rating AS hist_rating, datediff('day', CAST(e.ts AS DATE), CAST(t.ts AS DATE)) AS days_to_test, row_number() OVER (PARTITION BY e.user_id, e.item_id ORDER BY e.ts DESC, e.review_id DESC) AS hrn FROM train_events e JOIN truth_items t USING (user_id) WHERE datediff('day', CAST(e.ts AS DATE), CAST(t.ts AS DATE)) >= 1",
    history="SELECT user_id, item_id, hist_ts, hist_rating, CAST(days_to_test AS BIGINT) AS days_to_test, exp(-days_to_test / 180.0) AS hist_recency_w FROM history_rows WHERE hrn = 1",
    item_attrs="SELECT item_id, round(avg(rating), 6) AS stars, count(*) AS review_count, count(*) AS item_train_pop_count FROM train_events GROUP BY item_id",
    clusters="SELECT p_partkey AS item_id, p_brand AS cluster_id FROM part",
    item_tags="SELECT p_partkey AS item_id, 'category' AS tag_type, p_type AS tag, 1.0 AS weight FROM part UNION ALL SELECT p_partkey, 'size', CAST(CAST(floor(p_size / 10.0) AS BIGINT) AS VARCHAR), 0.5 FROM part",
    user_tags="SELECT e.user_id, tag_type, tag, count(*) / CAST(max(user_train_count) AS DOUBLE) AS weight FROM train_events e JOIN item_tags USING (item_id) JOIN user_segments USING (user_id) GROUP BY e.user_id, tag_type, tag",
    popular_top="SELECT item_id, row_number() OVER (ORDER BY item_train_pop_count DESC, item_id) AS source_rank, CAST(item_train_pop_count AS DOUBLE) AS source_score FROM item_counts QUALIFY source_rank <= 50",
    popular_rows="SELECT user_id, p.item_id, 'popular' AS source, source_rank, source_score, 1.0 AS source_confidence FROM (SELECT user_id FROM truth_items) CROSS JOIN popular_top p",
    cluster_own="SELECT user_id, cluster_id, count(*) AS cnt FROM train_events JOIN clusters USING (item_id) GROUP BY user_id, cluster_id",
    cluster_mine="SELECT user_id, cluster_id, 0.35 + 0.65 * cnt / total AS source_confidence FROM (SELECT *, sum(cnt) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, cluster_id) AS r FROM cluster_own) WHERE r <= 3",
    cluster_items="SELECT cluster_id, item_id, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, item_id) AS item_rank FROM train_events JOIN clusters USING (item_id) GROUP BY cluster_id, item_id QUALIFY item_rank <= 80",
    cluster_rows=f"SELECT user_id, item_id, 'cluster' AS source, row_number() OVER (PARTITION BY user_id ORDER BY source_confidence * {ILR('item_rank')} DESC, item_id) AS source_rank, source_confidence * n AS source_score, source_confidence FROM truth_items t JOIN cluster_mine USING (user_id) JOIN (SELECT cluster_id, item_id, n, item_rank FROM cluster_items) c USING (cluster_id)".replace("SELECT user_id, item_id, 'cluster'", "SELECT user_id, c.item_id, 'cluster'").replace("DESC, item_id)", "DESC, c.item_id)") + " QUALIFY source_rank <= 80",
    tag_totals="SELECT user_id, sum(abs(weight)) AS total FROM user_tags GROUP BY user_id",
    tag_scores="SELECT u.user_id, i.item_id, round(sum(u.weight * i.weight) / max(total), 9) AS source_score FROM user_tags u JOIN item_tags i ON u.tag_type = i.tag_type AND u.tag = i.tag JOIN tag_totals t ON t.user_id = u.user_id GROUP BY u.user_id, i.item_id",
    profile_rows="SELECT user_id, item_id, 'profile' AS source, row_number() OVER (PARTITION BY user_id ORDER BY source_score DESC, item_id) AS source_rank, source_score, 1.0 AS source_confidence FROM tag_scores WHERE source_score > 0 QUALIFY source_rank <= 80",
    candidate_rows="SELECT * FROM popular_rows UNION ALL SELECT * FROM cluster_rows UNION ALL SELECT * FROM profile_rows",
    scored_rows=f"SELECT c.*, user_segment, item_train_pop_count, {ILR('source_rank')} AS source_norm, CASE user_segment WHEN 'light' THEN CASE source WHEN 'cluster' THEN 0.25 WHEN 'popular' THEN 0.15 ELSE 0.15 END WHEN 'mid' THEN CASE source WHEN 'cluster' THEN 0.15 WHEN 'popular' THEN 0.08 ELSE 0.07 END ELSE CASE source WHEN 'cluster' THEN 0.08 WHEN 'popular' THEN 0.03 ELSE 0.04 END END AS source_weight, coalesce(stars, 0) / 5.0 * least(ln(coalesce(review_count, 0) + 1.0) / ln(501.0), 1.0) AS quality_score FROM candidate_rows c LEFT JOIN user_segments USING (user_id) LEFT JOIN item_attrs USING (item_id)",
    fused_rows="SELECT user_id, item_id, sum(source_weight * source_norm * source_confidence) AS signal_score, max(quality_score) AS quality_score, max(item_train_pop_count) AS item_train_pop_count, max(user_segment) AS user_segment, string_agg(source, ',' ORDER BY source) AS sources, CAST(NULL AS BIGINT) AS als_rank, min(CASE WHEN source = 'cluster' THEN source_rank END) AS cluster_rank, min(CASE WHEN source = 'popular' THEN source_rank END) AS popular_rank, min(CASE WHEN source = 'profile' THEN source_rank END) AS profile_rank, CAST(NULL AS BIGINT) AS context_rank FROM scored_rows GROUP BY user_id, item_id",
    flagged_rows="SELECT *, (als_rank IS NOT NULL)::INT::DOUBLE AS has_als, (cluster_rank IS NOT NULL)::INT::DOUBLE AS has_cluster, (popular_rank IS NOT NULL)::INT::DOUBLE AS has_popular, (profile_rank IS NOT NULL)::INT::DOUBLE AS has_profile, (context_rank IS NOT NULL)::INT::DOUBLE AS has_context, ((cluster_rank IS NOT NULL)::INT + (popular_rank IS NOT NULL)::INT + (profile_rank IS NOT NULL)::INT)::DOUBLE AS source_count, ((cluster_rank IS NOT NULL)::INT + (profile_rank IS NOT NULL)::INT)::DOUBLE AS nonpopular_source_count, ((cluster_rank IS NOT NULL)::INT + (profile_rank IS NOT NULL)::INT)::DOUBLE AS profile_cluster_source_count FROM fused_rows",
    pre_rows="SELECT *, round(signal_score + 0.04 * quality_score, 9) AS pre_score FROM flagged_rows",
    head_rows=f"SELECT *, round(pre_score + 0.02 * least(greatest(source_count - 1, 0), 2) + CASE WHEN profile_rank <= 30 THEN 0.03 * {ILR('profile_rank')} ELSE 0 END + CASE WHEN cluster_rank <= 30 THEN 0.03 * {ILR('cluster_rank')} ELSE 0 END - CASE WHEN has_popular > 0.5 AND source_count <= 1 THEN 0.02 ELSE 0 END, 9) AS head_score FROM pre_rows",
    ranked_rows="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY head_score DESC, pre_score DESC, item_id) AS pre_rank FROM head_rows",
    truth_ranks="SELECT t.user_id, t.item_id, r.pre_rank AS hit_rank FROM truth_items t LEFT JOIN ranked_rows r ON t.user_id = r.user_id AND t.item_id = r.item_id",
    labeled_rows="SELECT r.*, (r.item_id = t.item_id)::INT AS label, p_type AS category FROM ranked_rows r JOIN truth_items t ON r.user_id = t.user_id JOIN part ON p_partkey = r.item_id",
)
