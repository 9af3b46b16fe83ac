"""The relations that the queries share: interactions, split, routes and fused candidates over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import fusion, routes, split
from gristmill.sources.tables import table

MIN_EVENTS = 7
#: Lists of items that all users share are broadcast up to so many rows, by count.
FEW_ROWS = 50_000
_LATEST: list[DataFrame] = []


class Base:
    """Each relation is a lazy plan; nothing runs until a query's result does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._split: DataFrame | None = None
        self._kept: dict[str, DataFrame] = {}
        #: Whether ``tagged`` also holds what a match of items and users reads.
        self.wide = False

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def interactions(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        li = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
        pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
        joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), F.least(F.ceil(F.col("l_quantity") / 10), F.lit(5)).cast("double").alias("rating"), F.concat(pad("l_orderkey", 12), pad("l_linenumber", 4), pad("l_partkey", 12), pad("l_suppkey", 12), F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0")).alias("review_id"))

    @property
    def split(self) -> DataFrame:
        """Persisted while this is the latest query, since up to eight branches of its plan read it; the next query's releases it.

        It holds 8 bytes for the 68 of a review_id: minus rn, by which a user's events have the same order. Until they are ranked, a
        review_id goes as half a byte a digit, in an order-preserving code of its signs and digits."""
        if self._split is None:
            while _LATEST:
                _LATEST.pop().unpersist()
            digits = F.unhex(F.rpad(F.translate("review_id", "+-0123456789", "0123456789ab"), 64, "0"))
            events = self.by_user(self.interactions.withColumn("review_id", digits))
            self._split = split.leave_two_out(events, MIN_EVENTS).withColumn("review_id", -F.col("rn")).persist()
            _LATEST.append(self._split)
        return self._split

    def by_user(self, rows: DataFrame) -> DataFrame:
        """Dealt by user_id in a fixed number of partitions, so that rows dealt so are joined, grouped and ranked by user where they are."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "user_id")

    def keep(self, name: str, make) -> DataFrame:
        """Persisted like the split, and released with it."""
        if name not in self._kept:
            _ = self.split
            self._kept[name] = make().persist()
            _LATEST.append(self._kept[name])
        return self._kept[name]

    def few(self, rows: DataFrame) -> bool:
        return rows.count() <= FEW_ROWS

    def side(self, rows: DataFrame) -> DataFrame:
        """``rows``, which are kept, as a side to broadcast if they are few."""
        return F.broadcast(rows) if self.few(rows) else rows

    def part(self, name: str) -> DataFrame:
        return self.split.where(F.col("part") == name).drop("part", "rn")

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def truth(self) -> DataFrame:
        return self.part("test").select("user_id", "item_id")

    @property
    def users(self) -> DataFrame:
        return self.truth.select("user_id")

    @property
    def segments(self) -> DataFrame:
        return split.user_segments(self.train)

    @property
    def popularity(self) -> DataFrame:
        return split.item_popularity(self.train)

    @property
    def history(self) -> DataFrame:
        return split.train_history(self.train, self.part("test"))

    @property
    def clusters(self) -> DataFrame:
        return self.t("part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("cluster_id"))

    @property
    def items(self) -> DataFrame:
        return self.keep("items", lambda: self.train.groupBy("item_id").agg(F.round(F.avg("rating"), 6).alias("stars"), F.count(F.lit(1)).alias("review_count")).withColumn("item_train_pop_count", F.col("review_count")))

    @property
    def item_tags(self) -> DataFrame:
        p = self.t("part")
        kind = p.select(F.col("p_partkey").alias("item_id"), F.lit("category").alias("tag_type"), F.col("p_type").alias("tag"), F.lit(1.0).alias("weight"))
        return kind.union(p.select("p_partkey", F.lit("size"), (F.floor(F.col("p_size") / 10)).cast("string"), F.lit(0.5)))

    @property
    def tagged(self) -> DataFrame:
        """Train events with their item's brand, type and size; joined once by item and dealt by user again."""
        more = (["item_id", "rating"], ["p_retailprice"]) if self.wide else ([], [])
        p = self.t("part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_type", "p_size", *more[1])
        events = self.train.select(*dict.fromkeys(["user_id", "item_id", *more[0]])).join(p, "item_id")
        return self.keep("wide" if self.wide else "tagged", lambda: self.by_user(events.select("user_id", *more[0], "p_brand", "p_type", "p_size", *more[1])))

    @property
    def user_tags(self) -> DataFrame:
        tag = lambda name, value: F.struct(F.lit(name).alias("tag_type"), value.alias("tag"))
        both = F.array(tag("category", F.col("p_type")), tag("size", F.floor(F.col("p_size") / 10).cast("string")))
        used = self.tagged.select("user_id", F.inline(both)).groupBy("user_id", "tag_type", "tag").agg(F.count(F.lit(1)).alias("n"))
        total = self.train.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
        return used.join(total, "user_id").select("user_id", "tag_type", "tag", (F.col("n") / F.col("total")).alias("weight"))

    @property
    def popular_items(self) -> DataFrame:
        return self.keep("popular", lambda: routes.global_top(self.items.select("item_id", "item_train_pop_count"), 50, "item_train_pop_count", "item_id"))

    @property
    def cluster_items(self) -> DataFrame:
        return self.keep("cluster", lambda: routes.cluster_items(self.items.select("item_id", F.col("review_count").alias("n")), self.clusters, 80))

    @property
    def signatures(self) -> DataFrame:
        return self.keep("signatures", lambda: routes.weight_signatures(self.item_tags, ["tag_type", "tag"], 80))

    @property
    def popular(self) -> DataFrame:
        return routes.popular_lists(self.users, self.popular_items)

    @property
    def cluster(self) -> DataFrame:
        return routes.cluster_lists(self.users, self.tagged.withColumnRenamed("p_brand", "cluster_id"), self.side(self.cluster_items), 80, 3)

    @property
    def profile(self) -> DataFrame:
        return routes.tag_lists(self.users, self.user_tags, self.signatures, 80, small=self.few(self.signatures))

    @property
    def listed(self) -> DataFrame:
        """Every item that a route may bring: what candidates are joined with need hold no others."""
        ids = self.popular_items.select("item_id").union(self.cluster_items.select("item_id")).union(self.signatures.select(F.explode("items")))
        return self.keep("listed", lambda: ids.distinct())

    @property
    def listed_items(self) -> DataFrame:
        return self.side(self.keep("listed_items", lambda: self.items.join(self.side(self.listed), "item_id", "left_semi")))

    @property
    def listed_parts(self) -> DataFrame:
        """The rows of part of the listed items, with item_id."""
        return self.side(self.keep("listed_parts", lambda: self.t("part").withColumn("item_id", F.col("p_partkey")).join(self.side(self.listed), "item_id", "left_semi")))

    @property
    def candidates(self) -> DataFrame:
        return self.popular.unionByName(self.cluster).unionByName(self.profile)

    @property
    def fused(self) -> DataFrame:
        scored = fusion.score_sources(self.candidates, self.segments, self.listed_items)
        return fusion.source_flags(fusion.fuse(scored))

    @property
    def ranked(self) -> DataFrame:
        """Fused candidates with pre_score and pre_rank (by head score)."""
        headed = fusion.head_score(fusion.pre_score(self.fused, fusion.FusionPolicy()))
        return fusion.rank_candidates(headed, F.desc("head_score"), F.desc("pre_score"))
