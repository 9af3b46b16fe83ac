"""Tie-breaks, empty groups and single rows by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import features, fusion, metrics, ranking, rescue, routes, sampling, serving, split, text


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, ts string, rating double, review_id string").withColumn("ts", F.to_timestamp("ts"))


def test_leave_two_out_breaks_ties_by_review_and_keeps_only_active_users(spark):
    rows = events(spark, [(1, 10, "2024-01-01", 5.0, "a"), (1, 11, "2024-01-02", 4.0, "b"), (1, 12, "2024-01-02", 3.0, "c"), (2, 10, "2024-01-01", 1.0, "d")])
    got = {(r.user_id, r.item_id): r.part for r in split.leave_two_out(rows, 3).collect()}
    assert got == {(1, 12): "test", (1, 11): "valid", (1, 10): "train"}


def test_history_drops_the_test_day_and_keeps_the_latest(spark):
    train = events(spark, [(1, 10, "2024-01-01", 5.0, "a"), (1, 10, "2024-01-03", 2.0, "b"), (1, 11, "2024-01-09", 4.0, "c")])
    test = events(spark, [(1, 12, "2024-01-09", 3.0, "z")])
    got = split.train_history(train, test).collect()
    assert [(r.item_id, r.hist_rating, r.days_to_test) for r in got] == [(10, 2.0, 6)]


def test_index_ids_orders_by_count_then_text(spark):
    rows = spark.createDataFrame([("b",), ("b",), ("10",), ("9",), ("a",)], "k string")
    assert {r.k: r.idx for r in split.index_ids(rows, "k").collect()} == {"b": 0, "10": 1, "9": 2, "a": 3}


def test_global_top_has_ranks_and_breaks_ties_by_id(spark):
    counts = spark.createDataFrame([(1, 5), (2, 7), (3, 5)], "item_id long, item_train_pop_count long")
    got = [(r.item_id, r.source_rank) for r in routes.global_top(counts, 2, "item_train_pop_count", "item_id").collect()]
    assert got == [(2, 1), (1, 2)]


@pytest.mark.parametrize("name", ["min_max", "rank_pct", "z_sigmoid"])
def test_flat_and_single_groups_are_defined(spark, name):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, 0.7)], "user_id long, item_id long, v double")
    got = {(r.user_id, r.item_id): r.x for r in rows.withColumn("x", getattr(features, name)(F.col("v"))).collect()}
    expected = {"min_max": (0.0, 0.0), "rank_pct": (0.5, 0.0), "z_sigmoid": (0.5, 0.5)}[name]
    assert got[(1, 1)] == expected[0] and got[(2, 3)] == expected[1]


def test_layered_cut_front_rows_use_quota_and_safety_rows_stay(spark):
    rows = [(1, i, i, "heavy", None, None, i if i in (5, 6) else None, 1.0, 1.0, 1.0) for i in range(1, 9)]
    rows.append((1, 9, 9, "heavy", 2, None, None, 0.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "user_id long, item_id long, pre_rank int, user_segment string, als_rank int, cluster_rank int, profile_rank int, nonpopular_source_count double, profile_cluster_source_count double, source_count double")
    layers = fusion.Layers(front=2, rescue=0, rescue_max_rank=0, l1=1, l2=0, l3=1, l1_ranks=(1, 10, 10), l2_ranks=(1, 1, 1))
    got = fusion.layered_cut(df, layers, fusion.FusionPolicy(keep={"light": 4, "mid": 4, "heavy": 4})).orderBy("pre_rank").collect()
    # Seeds: 1 and 2 (front), 5 (best of L1), and L3's first, which is 1. The rest (3, then the others) fill up to 4.
    assert [r.item_id for r in got] == [1, 2, 5, 3]


def test_metrics_count_missing_truth_as_a_miss(spark):
    truth = spark.createDataFrame([(1, 10), (2, 20)], "user_id long, item_id long")
    ranked = spark.createDataFrame([(1, 10, 1), (2, 21, 1)], "user_id long, item_id long, rank int")
    row = metrics.ranking_metrics(metrics.rank_of_truth(truth, ranked), 10).collect()[0]
    assert (row.n_users, row.recall_at_k, row.ndcg_at_k) == (2, 0.5, 0.5)


def test_rescue_leaves_the_top_ten_alone_without_bonus(spark):
    rows = spark.createDataFrame([(1, i, i, 1.0 / i, 0.9 if i == 12 else None) for i in range(1, 15)], "user_id long, item_id long, base_rank int, base_score double, sidecar_score double")
    got = {r.item_id: r.rescue_bonus for r in rescue.rescue_fusion(rows).collect()}
    assert all(v == 0 for v in got.values())  # one sidecar score alone is a flat group


def test_pairs_are_never_inverted(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0.5, 1), (1, 2, 1, 0.9, 0), (1, 3, 9, 0.1, 0), (1, 4, 7, 0.2, 0)], "user_id long, item_id long, rank int, score double, label int")
    assert [r.rejected for r in sampling.preference_pairs(rows, 5).orderBy("nth").collect()] == [3, 4]


def test_serving_falls_back_when_any_score_is_missing(spark):
    rows = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3), (1, 2, 0.2, 0.1, None), (2, 1, 0.5, 0.6, 0.7)], "user_id long, item_id long, baseline_score double, xgboost_score double, reward_score double")
    got = {(r.user_id, r.item_id): (r.used, r.served_rank) for r in serving.serve(rows, "reward_rerank", 5).collect()}
    assert got == {(1, 1): ("xgboost", 1), (1, 2): ("xgboost", 2), (2, 1): ("reward", 1)}


def test_diverse_subset_is_greedy_by_score(spark):
    rows = spark.createDataFrame([("a", 1, 3.0, ["x", "y"]), ("a", 2, 2.0, ["x", "y"]), ("a", 3, 1.0, ["z"])], "g string, id long, score double, words array<string>")
    assert sorted(r.id for r in text.diverse_subset(rows, "g", 5, 0.5).collect()) == [1, 3]


def test_tower_features_cover_every_ranked_candidate(spark):
    from gristmill.plans import registry
    from gristmill.plans.base import Base
    from tests.conftest import DATA

    ranked = {(r.user_id, r.item_id) for r in Base(spark, DATA).ranked.select("user_id", "item_id").collect()}
    got = registry.QUERIES["c11_tower_features"](spark, DATA).collect()
    assert {(r.user_id, r.item_id) for r in got} == ranked and len(got) == len(ranked) and max(r.tower_rank for r in got) > 20


def test_tag_route_equals_brute_force(spark):
    """All users against all items, with negative weights, ties and users without weight."""
    import random

    r = random.Random(2)
    tags = [("a", str(i)) for i in range(4)] + [("b", str(i)) for i in range(3)]
    item_rows = [(i, *t, r.choice([1.0, 0.5])) for i in range(60) for t in r.sample(tags, 2)]
    user_rows = [(u, *t, r.choice([0.25, 0.5, -0.25, 1.0])) for u in range(25) for t in r.sample(tags, 3)] + [(99, "a", "0", 0.0)]
    users = spark.createDataFrame([(u,) for u in [*range(25), 99, 100]], "user_id long")
    got = {}
    for x in routes.tag_route(users, spark.createDataFrame(user_rows, "user_id long, tag_type string, tag string, weight double"), spark.createDataFrame(item_rows, "item_id long, tag_type string, tag string, weight double"), 7).collect():
        got.setdefault(x.user_id, []).append((x.source_rank, x.item_id, x.source_score))
    expected = {}
    for u in range(25):
        own = {t[1:3]: t[3] for t in user_rows if t[0] == u}
        total = sum(map(abs, own.values()))
        scores = {}
        for i, kind, tag, w in item_rows:
            if (kind, tag) in own:
                scores[i] = scores.get(i, 0) + own[(kind, tag)] * w
        best = sorted(((-round(x / total, 9), i) for i, x in scores.items() if round(x / total, 9) > 0))[:7]
        if best:
            expected[u] = [(n + 1, i, -x) for n, (x, i) in enumerate(best)]
    assert {u: sorted(x) for u, x in got.items()} == expected


def test_blocked_scores_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    u, v = r.integers(-2, 3, (9, 3)).astype(float), r.integers(-2, 3, (40, 3)).astype(float)
    users = spark.createDataFrame([(i * 7, 1.0, x.tolist()) for i, x in enumerate(u)], "user_id long, confidence double, u array<double>")
    items = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    got = {}
    for x in routes.blocked_best(users, items, routes._dot, 5, 0.5, "s", block=16).collect():
        got.setdefault(x.user_id, []).append((x.source_rank, x.item_id, x.source_score))
    expected = {}
    for i, a in enumerate(u):
        best = sorted((-float(a @ b), 3 * j) for j, b in enumerate(v) if a @ b >= 0.5)[:5]
        if best:
            expected[7 * i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {k: sorted(x) for k, x in got.items()} == expected
    assert routes.blocked_best(users.limit(0), items, routes._dot, 5, 0.5, "s").count() == 0


def test_buckets_take_what_earlier_ones_left(spark):
    from gristmill.operators.selection import Bucket, in_buckets

    rows = spark.createDataFrame([(1, i, i % 2) for i in range(1, 9)] + [(2, 1, None)], "k int, i int, odd int")
    buckets = [Bucket("odd", F.col("odd") == 1, [F.col("i")], 2), Bucket("big", F.col("i") > 3, [F.desc("i")], 2), Bucket("fill", F.lit(True), [F.col("i")], 9)]
    got = sorted((x.k, x.pick_order, x.i, x.bucket) for x in in_buckets(rows, ["k"], buckets, 6).collect())
    assert got == [(1, 1, 1, "odd"), (1, 2, 3, "odd"), (1, 3, 8, "big"), (1, 4, 7, "big"), (1, 5, 2, "fill"), (1, 6, 4, "fill"), (2, 1, 1, "fill")]


def test_pairs_of_several_positives_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    ranks = r.sample(range(1, 60), 40)
    rows = [(i % 2, i, ranks[i], float(-ranks[i]), int(i % 9 == 0)) for i in range(40)]
    got = {(x.user_id, x.nth): (x.rank_gap, x.rejected, x.chosen) for x in sampling.preference_pairs(spark.createDataFrame(rows, "user_id long, item_id long, rank int, score double, label int"), 6).collect()}
    for u in (0, 1):
        every = sorted((-(n[2] - p[2]), n[1], p[1]) for p in rows for n in rows if p[0] == n[0] == u and p[4] == 1 and n[4] == 0 and p[2] < n[2])[:6]
        assert [got[(u, k + 1)] for k in range(len(every))] == [(-g, n, p) for g, n, p in every]


def test_cohorts_and_shifts(spark):
    from gristmill.operators import assets, cohorts

    rows = spark.createDataFrame([(1, 1), (1, 40), (2, 2)], "user_id long, pre_rank int")
    none, one = rows.select("user_id").limit(0), spark.createDataFrame([(2,), (2,)], "user_id long")
    assert cohorts.cohort_filter(rows, None).count() == 3 and cohorts.cohort_filter(rows, none).count() == 0
    assert [r.user_id for r in cohorts.eval_cohort(rows, one, none, 30).collect()] == [2] and cohorts.eval_cohort(rows, None, None, 30).count() == 2
    lists = [([], ["a"]), (["a"], []), (["a"], ["a"]), (["a"], ["a", "b"]), (["a"], ["b"])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lists)], "i int, stable array<string>, recent array<string>")
    assert [r.s for r in df.select("i", assets.recent_shift(F.col("stable"), F.col("recent")).alias("s")).orderBy("i").collect()] == ["broadening", "unknown", "stable", "broadening", "switching"]


def test_readers_and_writers(spark, tmp_path):
    from gristmill.sources import tables

    rows = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"x')], "k long, v string")
    want = sorted(map(str, rows.collect()))
    path = f"file://{tmp_path}"
    tables.write_csv(rows.limit(1), f"{path}/t.csv")
    tables.write_csv(rows.where("k > 1"), f"{path}/t.csv", append=True)
    assert sorted(map(str, tables.read_any(spark, f"{path}/t.csv", "k long, v string").collect())) == want
    tables.write_hashed(rows, f"{path}/h", "k", 3)
    assert sorted(map(str, tables.read_any(spark, f"{path}/h").drop("bucket").collect())) == want
    assert tables.latest_run(spark, f"{path}/none", "_x") is None
    tables.write_pointer(spark, f"{path}/p", "runs/7")
    assert tables.pointed_run(spark, f"{path}/p") == "runs/7"
    tables.write_audit(rows, f"{path}/audit", {"stage": "x"})
    assert {r.name: r.value for r in spark.read.json(f"{path}/audit/meta").collect()} == {"stage": "x", "rows": "3"}


def test_shares_are_rounded_as_duckdb_rounds_them(spark):
    import duckdb

    from gristmill.functions.scalars import scaled_round

    values = [i / 1000 for i in range(1, 1001)] + [i / 37 for i in range(1, 38)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.text for r in rows.select("v", scaled_round(F.col("v"), 2).cast("string").alias("text")).collect()}
    assert got == dict(duckdb.execute("SELECT v, round(v, 2)::VARCHAR FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall())
    assert got[0.575] == "0.57"


def test_users_of_one_vector_are_scored_once(spark, monkeypatch):
    """A block pair gets a vector once, however many users have it; each of them gets its list, with its own confidence."""
    seen = []
    whole = routes.blocked_best
    monkeypatch.setattr(routes, "blocked_best", lambda users, *a: seen.append(users.count()) or whole(users, *a))
    vectors = [[1.0, 0.0], [0.0, 2.0], [3.0, 3.0]]
    users = spark.createDataFrame([(u, vectors[u % 3], 0.2 + u % 7 / 10) for u in range(5000)], "user_id long, vector array<double>, confidence double")
    items = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "item_id long, vector array<double>")
    got = {}
    for x in routes.vector_route(users.select("user_id"), users, items, 4).collect():
        got.setdefault(x.user_id, []).append((x.source_rank, x.item_id, x.source_score, x.source_confidence))
    assert seen == [3]
    assert set(got) == {u for u in range(5000) if 0.2 + u % 7 / 10 >= 0.3}
    for u, rows in got.items():
        v = np.array(vectors[u % 3]) / np.linalg.norm(vectors[u % 3])
        best = sorted((-round(float(np.round(v @ [np.cos(i), np.sin(i)], 6)), 6), i) for i in range(40))[:4]
        assert [(n, i, s) for n, i, s, _ in sorted(rows)] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)] and {c for *_, c in rows} == {0.2 + u % 7 / 10}


@pytest.mark.parametrize(("n_items", "k"), [(400, 7), (5, 7), (0, 7)])
def test_context_best_is_the_best_of_all_pairs(n_items, k):
    import pyarrow as pa

    r = np.random.default_rng(4)
    users = {"user_id": np.arange(50), "a": r.random(50), "b": r.random(50), "lat": 29.9 + r.random(50) * 0.4, "lon": -90.1 + r.random(50) * 0.4}
    items = {"item_id": r.permutation(n_items), "a": r.integers(0, 4, n_items) / 3.0, "b": r.integers(0, 4, n_items) / 3.0, "lat": 29.9 + r.integers(0, 6, n_items) / 15, "lon": -90.1 + r.integers(0, 6, n_items) / 15, "support": r.integers(0, 80, n_items)}
    got = routes._context_best(["a", "b"], k, 0.05, block=16)(pa.table(users), pa.table(items)).to_pylist()
    expected = []
    for u in range(50):
        rows = []
        for i in range(n_items):
            x, y = (np.array([t["a"][n], t["b"][n]]) for t, n in ((users, u), (items, i)))
            cos = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if y.any() else 0.0
            p, q = (np.radians([t["lat"][n], t["lon"][n]]) for t, n in ((users, u), (items, i)))
            h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
            near = np.exp(-6371.0 * 2 * np.arcsin(np.sqrt(h)) / 8)
            rows.append((-float(np.round((0.6 * cos + 0.4 * near) * (0.82 + 0.18 * min(np.log1p(items["support"][i]) / np.log(51), 1)), 6)), int(items["item_id"][i])))
        expected += [{"user_id": u, "item_id": i, "source_score": -s} for s, i in sorted(rows)[:k] if -s >= 0.05]
    assert got == expected


def test_likeness_by_sizes_is_jaccard(spark):
    r = np.random.default_rng(8)
    lists = [[str(x) for x in r.permutation(12)[: r.integers(0, 12)]] for _ in range(400)]
    rows = spark.createDataFrame(list(zip(lists[::2], lists[1::2], strict=True)), "a array<string>, b array<string>")
    for limit in (0.0, 0.4, 0.5):
        for x in rows.select("a", "b", text._like(F.col("a"), F.col("b"), limit).alias("like")).collect():
            a, b = set(x.a), set(x.b)
            assert x.like == (len(a & b) / max(len(a | b), 1) > limit)


def test_weighed_rows_stand_for_all(spark):
    """a fit read every candidate, however often it stood."""
    rows = spark.createDataFrame([(float((i * 7) % 10 < i % 5), float(i % 5)) for i in range(400)], "label double, x double")
    few = ranking.weighed(rows, "label", "x")
    assert few.count() <= 10
    assert few.agg(F.sum("n")).first()[0] == 400
    bins = []
    for part, weight in ((rows, None), (few, "n")):
        scored = ranking.positive_probability(ranking.fit_logistic(part, ["x"], weight=weight).transform(part), "score")
        bins.append(sorted(map(tuple, metrics.calibration_bins(scored, weight=weight).collect())))
    assert [b[:2] for b in bins[0]] == [b[:2] for b in bins[1]]
    assert np.allclose(bins[0], bins[1], atol=1e-4)


@pytest.mark.parametrize(("n_items", "whole"), [(700, True), (700, False), (5, True), (0, True)])
def test_product_best_is_the_best_of_all_pairs(n_items, whole):
    """with ties, users and items of length nought, and negative scores."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    u, v = (r.integers(-2, 3, (n, 3)).astype(np.float32) if whole else r.standard_normal((n, 3)).astype(np.float32) for n in (60, n_items))
    u[7] = 0
    ids = r.permutation(n_items)
    lists = lambda x: pa.array(list(x), pa.list_(pa.float32()))
    got = routes._product_best(7, block=16, wide=32)(pa.table({"user_id": np.arange(60), "u": lists(u)}), pa.table({"item_id": ids, "v": lists(v)})).to_pylist()
    scores = sum(u[:, None, c].astype(float) * v[None, :, c] for c in range(3))
    expected = [{"user_id": j, "best": [{"order": -s, "item_id": i} for s, i in sorted(zip(scores[j].tolist(), ids.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:7]]} for j in range(60)]
    assert got == (expected if n_items else [])


def test_product_best_leaves_items_that_are_too_short(monkeypatch):
    """every pair was scored."""
    import pyarrow as pa

    r = np.random.default_rng(7)
    u, v = np.abs(r.standard_normal((64, 4))).astype(np.float32), np.abs(r.standard_normal((4096, 4))).astype(np.float32)
    v[64:] /= 1000
    lists = lambda x: pa.array(list(x), pa.list_(pa.float32()))
    seen = []
    whole = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: seen.append(x.size if x.ndim == 2 else 0) or whole(x))
    routes._product_best(5, wide=64)(pa.table({"user_id": np.arange(64), "u": lists(u)}), pa.table({"item_id": np.arange(4096), "v": lists(v)}))
    assert sum(seen) == 64 * 64


def test_als_route_has_the_scores_of_all_pairs_with_equal_ones_by_id(spark, monkeypatch):
    """the factorisation's own search scored every user with every item, and left ties open."""
    from pyspark.ml.recommendation import ALSModel

    found = {}

    def searched(model, *a):
        raise AssertionError("every pair is scored")

    monkeypatch.setattr(ALSModel, "recommendForUserSubset", searched)
    lists = routes.product_lists

    def kept(users, items, k):
        found.update(u=users.collect(), v=items.collect())
        return lists(users, items, k, users_a_task=9, items_a_task=11)

    monkeypatch.setattr(routes, "product_lists", kept)
    # Items 3 * n and 3 * n + 90 have the same users, so the same factors.
    events = [(u, 3 * i + more) for u in range(30) for i in range(30) if (u * 7 + i * 11 + u * i) % 5 == 0 for more in (0, 90)]
    train = spark.createDataFrame(events, "user_id long, item_id long")
    users = spark.createDataFrame([(u,) for u in [*range(0, 30, 2), 999]], "user_id long")
    got = {}
    for x in routes.als_route(users, train, 6, rank=4, iterations=2).collect():
        got.setdefault(x.user_id, []).append((x.source_rank, x.item_id, x.source_score, x.source, x.source_confidence))
    assert set(got) == {u for u, _ in events if u % 2 == 0} == {x.user_id for x in found["u"]}
    for x in found["u"]:
        every = []
        for y in found["v"]:
            total = 0.0
            for a, b in zip(x.u, y.v, strict=True):
                total += a * b
            every.append((-total, y.item_id))
        assert sorted(got[x.user_id]) == [(n + 1, i, -s, "als", 1.0) for n, (s, i) in enumerate(sorted(every)[:6])]


def test_rank_in_lists_is_the_rank_of_truth(spark):
    """lists were expanded and dealt anew by user and item."""
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "user_id long, item_id long")
    lists = spark.createDataFrame([(1, [(-0.9, 11), (-0.5, 10)]), (2, [(-0.7, 20)]), (3, [(-0.7, 10)])], "user_id long, best array<struct<order:double,item_id:long>>")
    got = metrics.rank_in_lists(truth, lists)
    ranked = lists.selectExpr("user_id", "posexplode(best) as (pos, x)").selectExpr("user_id", "x.item_id", "pos + 1 as rank")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, metrics.rank_of_truth(truth, ranked).select("user_id", "item_id", "hit_rank").collect()), key=str)
    assert {r.user_id: r.hit_rank for r in got.collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_shares_add_weights_in_the_order_of_their_ranks(spark):
    import duckdb

    from gristmill.operators.profiles import preference_profile
    from gristmill.plans import registry
    from gristmill.plans.sql import CTES

    # The first of five labels has 3/8 of the total: its share, to two places, hangs on the last bit of the total.
    rng = np.random.default_rng(7)
    users = [[3 * m, *rng.multinomial(5 * m, [0.25] * 4)] for m in rng.integers(1_000, 10_000, 300)]
    weights = [(u, label, int(n) / 1e9) for u, parts in enumerate(users) for label, n in zip("pqrst", parts)]
    rows = spark.createDataFrame(weights, "user_id long, p_type string, weight double")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE intent_sums AS SELECT unnest(?::BIGINT[]) AS user_id, unnest(?::VARCHAR[]) AS p_type, unnest(?::DOUBLE[]) AS weight", [list(c) for c in zip(*weights)])
    expected = dict(duck.execute(f"SELECT user_id, share FROM ({CTES['intent_ranks']}) WHERE nth = 1").fetchall())
    assert "k11_user_prompt" in registry.QUERIES and {s >= 0.375 for s in expected.values()} == {True, False}
    for order in (F.asc("p_type"), F.desc("p_type")):
        got = preference_profile(rows.orderBy("user_id", order), "user_id", "p_type", F.col("weight"), 1)
        assert {r.user_id: r.share for r in got.collect()} == expected
