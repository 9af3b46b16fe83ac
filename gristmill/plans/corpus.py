"""Queries: exploration aggregates, text operators, user and merchant profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import profiles, sampling, text
from gristmill.plans.recall import floats, out
from gristmill.plans.registry import query
from gristmill.plans.rerank import DICE
from gristmill.plans.sql import cte

STOP = "('" + "', '".join(text.STOPWORDS) + "')"
cte(
    doc_words=f"SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z]+'), lambda w: len(w) >= 3 AND w NOT IN {STOP}) AS words FROM documents",
    doc_terms="SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM doc_words) GROUP BY doc_id, term",
    term_idf="SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1 AS idf FROM doc_terms GROUP BY term",
    source_terms="SELECT source, term, sum(tf)::BIGINT AS tf, round(sum(tf) * max(idf), 6) AS tfidf FROM doc_terms JOIN term_idf USING (term) JOIN documents USING (doc_id) GROUP BY source, term",
)


def words(b):
    return b.t("documents").select("doc_id", "lang", "source", text.tokens(F.col("text")).alias("words"))


def doc_terms(b):
    return text.term_counts(words(b), "doc_id", "words")


@query("SELECT doc_id, len(words)::BIGINT AS n_words, len(list_distinct(words))::BIGINT AS n_distinct FROM doc_words")
def g1_tokens(b):
    return out(words(b).select("doc_id", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")))


@query("SELECT doc_id, greatest(2 * len(words) - 1, 0)::BIGINT AS n_grams FROM doc_words")
def g1_bigrams(b):
    return out(words(b).select("doc_id", F.size(text.with_bigrams(F.col("words"))).alias("n_grams")))


@query("SELECT term, df, round(idf, 6) AS idf FROM term_idf WHERE df >= 5")
def g2_smoothed_idf(b):
    n = b.t("documents").count()
    return floats(text.smoothed_idf(doc_terms(b), n).where("df >= 5"), "idf")


@query("SELECT source, term, tf, row_number() OVER (PARTITION BY source ORDER BY tfidf DESC, tf DESC, term) AS nth FROM source_terms QUALIFY nth <= 10")
def g3_group_top_terms(b):
    counts = doc_terms(b)
    idf = text.smoothed_idf(counts, b.t("documents").count())
    by_source = counts.join(b.t("documents").select("doc_id", "source"), "doc_id")
    return out(text.group_top_terms(by_source, idf, "source", 10).select("source", "term", "tf", "nth"))


@query("SELECT p_type, count(*) AS n, round(avg(rating), 6) AS avg_rating, round(avg((rating >= 4)::INT), 6) AS high, round(avg((rating <= 2)::INT), 6) AS low, round(avg((rating >= 4)::INT) - avg((rating <= 2)::INT), 6) AS strength FROM interactions JOIN part ON p_partkey = item_id GROUP BY p_type")
def g4_topic_rating(b):
    rows = b.interactions.join(b.t("part").select(F.col("p_partkey").alias("item_id"), "p_type"), "item_id")
    return text.topic_rating(rows, "p_type", "rating")


@query("SELECT conv_id, count(*) AS n_texts, md5(string_agg(text, ' ' ORDER BY nth)) AS digest FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS nth FROM conversations WHERE role = 'user' QUALIFY nth <= 3) GROUP BY conv_id HAVING count(*) >= 2")
def g5_latest_text(b):
    rows = b.t("conversations").where("role = 'user'")
    joined = text.latest_text(rows, "conv_id", [F.desc("turn"), F.asc("text")], "text", 3, 2)
    return joined.select("conv_id", "n_texts", F.md5("text").alias("digest"))


@query("SELECT doc_id, round(least(0.4 * (1 - len(regexp_replace(text, '[^A-Za-z]', '', 'g')) / CAST(greatest(len(text), 1) AS DOUBLE)) + 0.3 * len(regexp_replace(text, '[^A-Z]', '', 'g')) / CAST(greatest(len(text), 1) AS DOUBLE) + CASE WHEN regexp_matches(lower(text), 'https?://|www\\.|click here|promo code|free gift') THEN 0.5 ELSE 0 END, 1.0), 6) AS spam FROM documents")
def g6_spam_score(b):
    return b.t("documents").select("doc_id", F.round(text.spam_score(F.col("text")), 6).alias("spam"))


def g6_diverse_subset(b):
    """Greedy and sequential within a group, so tested on a small fixture instead of SQL."""
    rows = words(b).select("source", F.col("doc_id").alias("id"), F.col("words"), F.round(F.log1p(F.size("words")), 6).alias("score"))
    return text.diverse_subset(rows, "source", 5, 0.4)


query(None)(g6_diverse_subset)
cte(
    evidence_rows="SELECT l_partkey AS part_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS id, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'mixed' WHEN l_quantity <= 10 THEN 'negative' WHEN l_quantity >= 35 AND l_returnflag <> 'R' THEN 'positive' ELSE 'mixed' END AS bucket, round(0.5 * least(l_quantity / 400.0, 1.0) + 0.3 * least(ln(1 + l_tax) / ln(21.0), 1.0) + 0.2 * exp(-date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01') / 365.0), 9) AS score, l_suppkey FROM lineitem",
    evidence_seeds="SELECT *, (row_number() OVER (PARTITION BY part_id, bucket ORDER BY score DESC, ts DESC NULLS LAST, id) <= CASE bucket WHEN 'positive' THEN 2 WHEN 'negative' THEN 2 ELSE 1 END)::INT AS seed FROM evidence_rows",
)


@query("SELECT part_id, id, bucket, row_number() OVER (PARTITION BY part_id ORDER BY seed DESC, score DESC, ts DESC NULLS LAST, id) AS place FROM evidence_seeds QUALIFY place <= 8")
def g7_select_evidence(b):
    li = b.t("lineitem")
    bad, good = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), F.col("l_quantity") > 25
    bucket = text.rating_bucket(F.when(F.col("l_quantity") <= 10, 1).when(F.col("l_quantity") >= 35, 5).otherwise(3), good, (F.col("l_returnflag") == "R"))
    days = F.datediff(F.lit("2002-01-01").cast("date"), "l_shipdate")
    rows = li.select(F.col("l_partkey").alias("part_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")).alias("id"), F.col("l_shipdate").alias("ts"), F.when(bad, "mixed").otherwise(bucket).alias("bucket"), F.round(text.evidence_score(F.col("l_quantity"), F.col("l_tax"), days), 9).alias("score"))
    return text.select_evidence(rows, "part_id", {"positive": 2, "negative": 2, "mixed": 1}, 8).select("part_id", "id", "bucket", F.col("place").cast("long").alias("place"))


@query("SELECT source, doc_id, nth FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY round(least(n_chars / 400.0, 1.0), 6) DESC, doc_id) AS nth FROM documents) WHERE nth <= 3")
def g8_tip_evidence(b):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round(F.least(F.col("n_chars") / 400.0, F.lit(1.0)), 6)), "doc_id"))
    return out(b.t("documents").withColumn("nth", nth).where("nth <= 3").select("source", "doc_id", "nth"))


@query("SELECT doc_id, 1.0 * contains(lower(text), 'the')::INT + 0.5 * contains(lower(text), 'and')::INT AS score FROM documents")
def g9_keyword_score(b):
    return b.t("documents").select("doc_id", text.keyword_score(F.col("text"), {"the": 1.0, "and": 0.5}).alias("score"))


@query("SELECT user_id, item_id, nth FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY hist_rating DESC, days_to_test, item_id) AS nth FROM history) WHERE nth <= 3")
def g10_history_anchors(b):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("hist_rating"), "days_to_test", "item_id"))
    return out(b.history.withColumn("nth", nth).where("nth <= 3").select("user_id", "item_id", "nth"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'digits' END, CASE WHEN regexp_matches(text, '!!') THEN 'shout' END, CASE WHEN regexp_matches(text, '\\|') THEN 'table' END], lambda x: x IS NOT NULL)), ',') AS labels FROM documents")
def g12_rule_labels(b):
    rules = {"digits": "[0-9]{3}", "shout": "!!", "table": r"\|"}
    return b.t("documents").select("doc_id", F.array_join(text.rule_labels(F.col("text"), rules), ",").alias("labels"))


def g13_kmeans(b):
    """Cluster sizes of the embedding table, small clusters merged; the fit is iterative."""
    rows = b.t("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return text.merge_small(text.clusters(rows, 10), 20).groupBy("merged").agg(F.count(F.lit(1)).alias("n"))


query(None)(g13_kmeans)


@query("SELECT label, merged, count(*) AS n FROM (SELECT label, CASE WHEN count(*) OVER (PARTITION BY label) < 48 THEN 'other' ELSE CAST(label AS VARCHAR) END AS merged FROM embeddings) GROUP BY ALL")
def g14_merge_small(b):
    return text.merge_small(b.t("embeddings").withColumn("cluster", F.col("label")), 48).groupBy("label", "merged").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {DICE('doc_id')}, doc_id) AS nth FROM documents) WHERE nth <= 4")
def g15_stratified_sample(b):
    return sampling.stratified_sample(b.t("documents"), "source", "doc_id", 4).select("source", "doc_id")


cte(recent_events="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 20")


@query("SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_items, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS span_days, round(1 - count(DISTINCT event_type) / CAST(count(*) AS DOUBLE), 6) AS repeat_ratio, max(dominant_type) AS dominant_type, max(type_counts) AS type_counts FROM recent_events JOIN (SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS dominant_type, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS type_counts FROM (SELECT user_id, event_type, count(*) AS n FROM recent_events GROUP BY user_id, event_type) GROUP BY user_id) USING (user_id) GROUP BY user_id")
def k1_sequence_view(b):
    return profiles.sequence_view(b.t("events").withColumn("item", F.col("event_type")), 20)


@query("SELECT user_id, event_type AS dominant, count(*) AS dominant_n FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def k2_dominant_label(b):
    return profiles.dominant_label(b.t("events"), "user_id", "event_type")


@query("SELECT user_id, event_type, n, round(weight, 4) AS weight FROM (SELECT user_id, event_type, count(*) AS n, sum(value) AS weight, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, max(ts) DESC, event_type) AS nth FROM events GROUP BY user_id, event_type) WHERE nth <= 3")
def k8_evidence_stream(b):
    return floats(profiles.evidence_stream(b.t("events"), "user_id", "event_type", "value", "ts", 3), "weight", places=4).select("user_id", "event_type", "n", "weight")


@query("SELECT user_id, CASE WHEN n <= 7 THEN 'sparse' WHEN n <= 17 THEN 'medium' ELSE 'dense' END AS band, least(n, CASE WHEN n <= 7 THEN 4 WHEN n <= 17 THEN 8 ELSE 12 END) AS kept FROM (SELECT user_id, count(*) AS n FROM train_events GROUP BY user_id)")
def k9_density_caps(b):
    kept = profiles.density_cap(b.train, "user_id", [F.desc("ts"), F.desc("review_id")], {"sparse": 4, "medium": 8, "dense": 12})
    return kept.groupBy("user_id", "band").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT item_id, CASE WHEN n < 10 THEN 'low_signal' WHEN m >= 4 AND s < 1 THEN 'high_stable' WHEN m >= 4 OR s >= 1.4 THEN 'high_controversial' WHEN m >= 3 THEN 'mixed_reputation' ELSE 'low_reputation' END AS segment FROM (SELECT item_id, count(*) AS n, round(avg(rating), 6) AS m, round(stddev_samp(rating), 6) AS s FROM interactions GROUP BY item_id)")
def k6_merchant_segment(b):
    about = b.interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("m"), F.round(F.stddev_samp("rating"), 6).alias("s"))
    return about.select("item_id", profiles.merchant_segment(F.col("n"), F.col("m"), F.col("s")).alias("segment"))


@query("SELECT user_id, p_type, pos, neg, support, round((pos - neg) / CAST(support AS DOUBLE), 6) AS net, round(least(abs((pos - neg) / CAST(support AS DOUBLE)) * support / 8.0, 1.0), 6) AS confidence FROM (SELECT user_id, p_type, sum((rating >= 4)::INT)::BIGINT AS pos, sum((rating <= 1)::INT)::BIGINT AS neg, count(*) AS support FROM train_events JOIN part ON p_partkey = item_id GROUP BY user_id, p_type)")
def k13_tag_sidecar(b):
    rows = b.train.join(b.t("part").select(F.col("p_partkey").alias("item_id"), "p_type"), "item_id")
    polarity = F.when(F.col("rating") >= 4, 1).when(F.col("rating") <= 1, -1).otherwise(0)
    return profiles.tag_sidecar(rows, "user_id", "p_type", polarity)


@query("SELECT p_partkey AS item_id, round(0.45 * p_size / 50.0 + 0.35 * least(p_size % 5, 3) / 3.0 + 0.20 * least(p_size % 4, 2) / 2.0, 6) AS strength FROM part")
def k15_item_strength(b):
    p = b.t("part")
    return p.select(F.col("p_partkey").alias("item_id"), F.round(profiles.item_strength(F.col("p_size") / 50.0, F.col("p_size") % 5, F.col("p_size") % 4), 6).alias("strength"))


@query("SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS sizes, round(count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE), 6) AS share FROM part GROUP BY p_brand, p_type")
def k16_alignment_audit(b):
    p = b.t("part")
    out_ = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_size").alias("sizes")).crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"))))
    return out_.select("p_brand", "p_type", "n", "sizes", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT user_id, round(max(w), 6) AS max_w, round(least(sum(w), 1.0), 6) AS capped_w, round(avg(w), 6) AS mean_w, round(avg(CASE WHEN nth <= 2 THEN w END), 6) AS top2_w FROM (SELECT user_id, w, row_number() OVER (PARTITION BY user_id ORDER BY w DESC) AS nth FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.8 ELSE 0.5 END * power(0.8, event_id % 4) AS w FROM events)) GROUP BY user_id")
def k18_pair_weights(b):
    source = F.when(F.col("event_type") == "click", "observed").when(F.col("event_type") == "view", "hard").otherwise("other")
    rows = b.t("events").withColumn("w", profiles.pair_weight(source, F.lit("x"), F.col("event_id") % 4))
    return floats(profiles.weight_summary(rows, "user_id", "w"), "max_w", "capped_w", "mean_w", "top2_w")


@query("SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS mean_balance, CAST(quantile_cont(c_acctbal, 0.5) AS DOUBLE) AS median_balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def j4_city_stats(b):
    rows = b.t("customer").join(F.broadcast(b.t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.percentile("c_acctbal", F.lit(0.5)).cast("double").alias("median_balance"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, count(DISTINCT o_custkey) AS users FROM orders GROUP BY month")
def j4_month_histogram(b):
    return b.t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("users"))


@query("SELECT rating, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 6) AS share FROM interactions GROUP BY rating")
def j4_rating_share(b):
    rows = b.interactions
    return rows.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).select("rating", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT p_type, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity, round(corr(l_quantity, l_discount), 4) AS r FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def j4_category_stats(b):
    rows = b.t("lineitem").join(b.t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.round(F.corr("l_quantity", "l_discount"), 4).alias("r"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%' AND c_acctbal >= 3.0 AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 5 AND max(o_orderdate) >= TIMESTAMP '2000-01-01')")
def p_hard_filter(b):
    active = b.t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last")).where("n >= 5 and last >= '2000-01-01'")
    return b.t("customer").where("c_mktsegment like 'B%' and c_acctbal >= 3.0").join(active, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT category, count(*) AS n FROM (SELECT DISTINCT p_partkey, lower(trim(unnest(string_split(p_name, ' ')))) AS category FROM part) WHERE category <> '' GROUP BY category")
def p_category_explode(b):
    rows = b.t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("c")).select("p_partkey", F.lower(F.trim("c")).alias("category")).where("category <> ''").distinct()
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
