"""Tokens, tf-idf, topics, evidence selection and text filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOPWORDS = ("the", "and", "for", "with", "that", "this", "was", "are", "from", "not")


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased runs of ASCII letters of at least ``least`` letters, without stop words, in text order."""
    words = F.split(F.lower(text), r"[^a-zA-Z]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def with_bigrams(words: Column) -> Column:
    pairs = F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, key: str, words: str) -> DataFrame:
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def smoothed_idf(counts: DataFrame, n_docs: int | Column) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1; ``counts`` has one row per (document, term)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def group_top_terms(counts: DataFrame, idf: DataFrame, group: str, k: int) -> DataFrame:
    """The k terms of greatest tf * idf in each group; then greater tf, then the term. ``counts``: group, term, tf."""
    summed = counts.groupBy(group, "term").agg(F.sum("tf").alias("tf")).join(idf.select("term", "idf"), "term").withColumn("tfidf", F.round(F.col("tf") * F.col("idf"), 6))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("tfidf"), F.desc("tf"), "term"))
    return summed.withColumn("nth", nth).where(F.col("nth") <= k)


def cluster_keywords(counts: DataFrame, idf: DataFrame, assigned: DataFrame, key: str, k: int) -> DataFrame:
    """The k terms of greatest mean tf * idf over each cluster's documents (0 where a document lacks the term). ``counts``: key, term,
    tf; ``assigned``: key, cluster."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"))
    sums = counts.join(assigned, key).join(idf.select("term", "idf"), "term").groupBy("cluster", "term").agg(F.sum("tf").alias("tf"), F.max("idf").alias("idf"), F.count(F.lit(1)).alias("df"))
    mean = sums.join(sizes, "cluster").withColumn("mean_tfidf", F.round(F.col("tf") * F.col("idf") / F.col("n_docs"), 9))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mean_tfidf"), F.desc("df"), "term"))
    return mean.withColumn("nth", nth).where(F.col("nth") <= k)


def topic_rating(rows: DataFrame, term: str, rating: str) -> DataFrame:
    """Per term: documents, mean rating, share of high (4 and more) and low (2 and less), and their difference."""
    high, low = F.avg((F.col(rating) >= 4).cast("double")), F.avg((F.col(rating) <= 2).cast("double"))
    return rows.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rating), 6).alias("avg_rating"), F.round(high, 6).alias("high"), F.round(low, 6).alias("low"), F.round(high - low, 6).alias("strength"))


def latest_text(rows: DataFrame, group: str, order: list[Column], text: str, n: int, least: int = 1) -> DataFrame:
    """The latest n texts of each group in one string, latest first, for groups with at least ``least``."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= n)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", text))), lambda x: x[text]), " ")
    return kept.groupBy(group).agg(joined.alias("text"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= least)


def rating_bucket(rating: Column, positive: Column, negative: Column) -> Column:
    """mixed if both cues are there; else by rating, a high one only without a negative cue."""
    return F.when(positive & negative, "mixed").when(rating <= 2, "negative").when((rating >= 4) & ~negative, "positive").otherwise("mixed")


def evidence_score(length: Column, votes: Column, days: Column) -> Column:
    """Longer (up to 400 characters), voted for and recent texts say more."""
    return 0.5 * F.least(length / 400.0, F.lit(1.0)) + 0.3 * F.least(F.log1p(votes) / F.log1p(F.lit(20.0)), F.lit(1.0)) + 0.2 * F.exp(-days / 365.0)


def select_evidence(rows: DataFrame, group: str, quotas: dict[str, int], total: int) -> DataFrame:
    """The best of each bucket by quota, then the best left until ``total``. ``rows``: group, bucket, score, ts, id."""
    order = [F.desc("score"), F.desc_nulls_last("ts"), F.asc("id")]
    in_bucket = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order))
    quota = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(q)) for b, q in quotas.items()], F.lit(0))
    marked = rows.withColumn("seed", (in_bucket <= quota).cast("int"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("seed"), *order))
    return marked.withColumn("place", nth).where(F.col("place") <= total)


def evidence_payload(rows: DataFrame, group: str) -> DataFrame:
    """One JSON array per group, in the order of place."""
    items = F.sort_array(F.collect_list(F.struct("place", "bucket", "id")))
    return rows.groupBy(group).agg(F.to_json(items).alias("payload"))


def spam_score(text: Column) -> Column:
    """0 to 1: few letters, shouting, and links or sale words."""
    n = F.greatest(F.length(text), F.lit(1))
    alpha = F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / n
    shout = F.length(F.regexp_replace(text, r"[^A-Z]", "")) / n
    cue = F.when(F.lower(text).rlike(r"https?://|www\.|click here|promo code|free gift"), 1.0).otherwise(0.0)
    return F.least(0.4 * (1 - alpha) + 0.3 * shout + 0.5 * cue, F.lit(1.0))


def _like(a: Column, b: Column, limit: float) -> Column:
    """Whether the Jaccard similarity of two lists of different words is above ``limit``; it is 0 for two empty ones.

    It is the sizes' ratio at most, so lists that differ more in size are not intersected."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b), F.lit(1))
    shared = F.size(F.array_intersect(a, b))
    return F.when(least / most <= limit, F.lit(False)).otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)) > limit)


def diverse_subset(rows: DataFrame, group: str, most: int, limit: float) -> DataFrame:
    """Greedily by score, texts whose word sets are not too like (Jaccard above ``limit``) those taken before. ``rows``: group, id,
    score, words.

    Each round is one aggregation: of every group's rows that are unlike what is taken so far, the best one. No group is gathered,
    no row is left out of account; a row carries ``most`` word sets at most through its task."""
    rows = rows.select(group, "id", F.col("score").cast("double").alias("score"), F.array_distinct("words").alias("words"))
    row, order = F.struct("id", "score", "words"), F.struct((-F.col("score")).alias("s"), "id")
    taken = rows.groupBy(group).agg(F.array(F.min_by(row, order)).alias("taken"))
    for _ in range(most - 1):
        like = F.exists("taken", lambda x: (x["id"] == F.col("id")) | _like(F.col("words"), x["words"], limit))
        found = rows.join(taken, group).groupBy(group).agg(F.first("taken").alias("taken"), F.min_by(row, F.when(~like, order)).alias("best"))
        taken = found.select(group, F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("best"))).alias("taken"))
    return taken.select(group, F.explode("taken").alias("x")).select(group, "x.id", "x.score")


def rule_labels(text: Column, rules: dict[str, str]) -> Column:
    """The names of the rules whose pattern the text has, sorted."""
    return F.sort_array(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()])))


def relabel(rows: DataFrame, key: str, text: str, rules: dict[str, dict[str, float]], parents: dict[str, str], conflicts: list[tuple[str, str]], least: float) -> DataFrame:
    """A second- and first-level label by weighted term patterns: ``rules``: label -> {pattern: weight}; ``parents``: label -> its
    first-level one; ``conflicts``: (winner, loser) pairs, of which the loser's score counts nothing where both have one.

    The best score of at least ``least`` wins, equal ones in the rules' order; without one, both labels are "other"."""
    score = {}
    for label, patterns in rules.items():
        total = F.lit(0.0)
        for pattern, weight in patterns.items():
            total = total + F.when(F.lower(F.col(text)).rlike(pattern), F.lit(float(weight))).otherwise(0.0)
        score[label] = total
    settled = dict(score)
    for winner, loser in conflicts:
        settled[loser] = F.when(score[winner] > 0, F.lit(0.0)).otherwise(settled[loser])
    cells = F.array(*[F.struct((-c).alias("minus"), F.lit(i).alias("at"), F.lit(n).alias("label")) for i, (n, c) in enumerate(settled.items())])
    best = rows.select(key, F.array_min(cells).alias("b"))
    label = F.when(F.col("b.minus") <= -least, F.col("b.label")).otherwise("other")
    first = F.coalesce(*[F.when(F.col("label") == n, F.lit(p)) for n, p in parents.items()], F.lit("other"))
    return best.select(key, label.alias("label"), F.round(-F.col("b.minus"), 6).alias("score")).withColumn("first_level", first)


def item_snippets(pairs: DataFrame, reviews: DataFrame, words: dict[str, float], top: int, chars: int = 120) -> DataFrame:
    """For each (user, item), the ``top`` best snippets of the item's reviews from before the user's cutoff, joined into one text.
    ``pairs``: user_id, item_id, cutoff; ``reviews``: item_id, ts, text. Equal snippets count once."""
    short = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, chars)
    seen = pairs.join(reviews.withColumn("snippet", short).where(F.col("snippet") != ""), "item_id").where(F.col("ts") < F.col("cutoff"))
    score = F.round(10 * keyword_score(F.col("snippet"), words) + F.when(F.length("snippet") >= 80, 1.0).otherwise(0.0), 6)
    once = seen.groupBy("user_id", "item_id", "snippet").agg(F.max("ts").alias("ts")).withColumn("score", score)
    nth = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy(F.desc("score"), F.desc("ts"), "snippet"))
    best = once.withColumn("nth", nth).where(F.col("nth") <= top)
    return best.groupBy("user_id", "item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "snippet"))), lambda x: x["snippet"]), " || ").alias("evidence"), F.count(F.lit(1)).alias("n_snippets"))


def bounded_material(rows: DataFrame, key: str, latest: int, useful: int) -> DataFrame:
    """Each key's latest and most voted-for rows, once each. ``rows``: key, id, ts, votes."""
    own = Window.partitionBy(key)
    marked = rows.withColumns({"by_time": F.row_number().over(own.orderBy(F.desc("ts"), "id")), "by_votes": F.row_number().over(own.orderBy(F.desc("votes"), F.desc("ts"), "id"))})
    return marked.where((F.col("by_time") <= latest) | (F.col("by_votes") <= useful))


def best_anchors(history: DataFrame, groups: DataFrame, group: str, k: int) -> DataFrame:
    """Each user's best event of each group of items, then its k best: by rating, then the nearest to the test event, then the item."""
    order = [F.desc("hist_rating"), F.asc("days_to_test"), F.asc("item_id")]
    rows = history.join(groups, "item_id")
    firsts = rows.withColumn("g", F.row_number().over(Window.partitionBy("user_id", group).orderBy(*order))).where("g = 1")
    return firsts.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("nth") <= k)


def keyword_score(text: Column, words: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for word, weight in words.items():
        out = out + F.when(F.lower(text).contains(word), F.lit(weight)).otherwise(0.0)
    return out


def clusters(vectors: DataFrame, k: int, seed: int = 7):
    """K-means on an array column ``vector``; adds ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows).drop("features")


def merge_small(assigned: DataFrame, least: int, fallback: str = "other") -> DataFrame:
    """Clusters of fewer than ``least`` rows become one."""
    sizes = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    return assigned.withColumn("merged", F.when(sizes < least, F.lit(fallback)).otherwise(F.col("cluster").cast("string")))
