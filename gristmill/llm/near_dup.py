"""MinHash near-duplicate detection by a multi-index Hamming join over b-bit minwise signatures.

A text's signature has ``values`` 14-bit minwise values; the distance of two signatures is the number of values that differ.
The values are split into bands of ``BAND``, and a pair is a candidate when a band of it has one error at most. That error is
enumerated by masking each value of each band in turn, so equal keys find *all* such pairs. ``Plan`` derives, from the similarity
threshold and a miss probability, the number of bands and a distance threshold over all values, so that pairs at the similarity
threshold have no such band or exceed that distance with the miss probability at most, both together.

Pairs are never expanded inside a bucket. Buckets are linked to a few hubs each, then only across the neighbourhoods that are
still apart, and what is within the distance threshold (and the size ratio a link needs) joins a
neighbourhood. Texts of a neighbourhood are compared exactly on their full shingle sets, in blocks of bounded size, each pair of
blocks in a task of its own; a task returns a spanning forest of the links that it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._components import connected_components
from gristmill.llm._shared import write_table
from gristmill.llm._words import chunks, constants, mix64, shingle_hashes

BAND = 5
EXTRA = 64
#: Salts of the hubs that a bucket's texts are held against; the first two are its least and its largest id.
HUB_SALTS = (0, -1, 0x2B7E151628AED2A6, 0x5851F42D4C957F2D)
BLOCK_TEXTS, BLOCK_BYTES = 384, 3 << 20


def _tail(n: int, p: float, miss: float) -> int:
    """The least r with P(Binomial(n, p) > r) <= miss."""
    rest = 1.0
    for r in range(n + 1):
        rest -= math.comb(n, r) * p**r * (1 - p) ** (n - r)
        if rest <= miss:
            return r
    return n


@dataclass(frozen=True)
class Plan:
    """``percent``: a link has ``100 * intersection >= percent * union``; ``shingle``: words a shingle has."""

    shingle: int = 5
    percent: int = 80
    miss: float = 1e-6

    @property
    def _spoilt(self) -> float:
        """Probability that a band of a pair at the threshold has two errors or more."""
        s = self.percent / 100
        return max(1 - (s**BAND + BAND * s ** (BAND - 1) * (1 - s)), 1e-9)

    @property
    def bands(self) -> int:
        return max(2, math.ceil(math.log(self.miss) / math.log(self._spoilt) / 2) * 2)

    @property
    def values(self) -> int:
        return self.bands * BAND

    @property
    def distance(self) -> int:
        """Of all values, the extra 6-bit ones included; the bands have used up a part of ``miss``."""
        return _tail(self.values + EXTRA, 1 - self.percent / 100, self.miss - self._spoilt**self.bands)

    @property
    def wide_words(self) -> int:
        return math.ceil(self.values / 4)


def _sketch(plan: Plan):
    """mapInArrow body: doc_id, text -> doc_id, n_shingles, d1, d2, sig, keys."""
    total = plan.values + EXTRA
    multiply, flip = constants(total, 1), constants(total, 2)
    band_by, band_salt = constants(BAND, 3), constants(plan.values, 4)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("n_bytes", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def digests(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, one, two = (np.zeros(len(counts), t) for t in (np.int64, np.uint64, np.uint64))
        at = 0
        for i, c in enumerate(counts.tolist()):
            if c:
                own = np.sort(flat[at : at + c])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))] if c > 1 else own
                n[i], one[i], two[i] = len(own), own.sum(dtype=np.uint64), mix64(own).sum(dtype=np.uint64)
                at += c
        return n, mix64(one + n.astype(np.uint64)), two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, end, buf, offsets in chunks(batch.column("text")):
                flat, counts = shingle_hashes(buf, offsets, plan.shingle)
                n, one, two = digests(flat, counts)
                has = np.flatnonzero(counts)
                low = np.zeros((len(has), total), np.uint64)
                if len(has):
                    begin = (np.cumsum(counts) - counts)[has]
                    for k in range(total):
                        low[:, k] = np.minimum.reduceat((flat ^ flip[k]) * multiply[k], begin)
                low = mix64(low)
                wide = np.zeros((len(has), plan.wide_words * 4), np.uint16)
                wide[:, : plan.values] = low[:, : plan.values] >> np.uint64(50)
                extra = np.ascontiguousarray((low[:, plan.values :] >> np.uint64(58)).astype(np.uint8))
                sig = np.hstack([wide.view(np.int64), extra.view(np.int64)])
                parts = wide[:, : plan.values].astype(np.uint64).reshape(len(has), plan.bands, BAND) * band_by + band_by[::-1]
                parts = mix64(parts)
                keys = mix64((parts.sum(axis=2, dtype=np.uint64)[:, :, None] - parts).reshape(len(has), plan.values) + band_salt)
                size = np.zeros(end - first, np.int64)

                def lists(rows: np.ndarray, size: np.ndarray = size, has: np.ndarray = has) -> pa.Array:
                    size[:] = 0
                    size[has] = rows.shape[1]
                    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(rows.reshape(-1)))

                columns = [ids.slice(first, end - first), pa.array(n), pa.array(np.diff(offsets)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists(sig), lists(keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


SKETCH = "doc_id long, n_shingles long, n_bytes long, d1 long, d2 long, sig array<long>, keys array<long>"


def _unequal(x: Column, bits: int) -> Column:
    """How many lanes of ``bits`` bits of a long are not zero. A lane's two upper bits are always clear, so that adding all ones
    to the others sets the lower of the two just where a lane is not zero, and nothing overflows."""
    lanes = range(0, 64, bits)
    ones, flag = (1 << (bits - 2)) - 1, 1 << (bits - 2)
    return F.bit_count((x + F.lit(sum(ones << at for at in lanes))).bitwiseAND(F.lit(sum(flag << at for at in lanes))))


def _close(a: Column, b: Column, plan: Plan) -> Column:
    """Within the distance of all values. The signature's own values have no bound of their own: a shared key is all they must have."""
    total = sum((_unequal(a[i].bitwiseXOR(b[i]), 16) for i in range(1, plan.wide_words)), _unequal(a[0].bitwiseXOR(b[0]), 16))
    extra = [_unequal(a[i].bitwiseXOR(b[i]), 8) for i in range(plan.wide_words, plan.wide_words + EXTRA // 8)]
    return sum(extra, total) <= plan.distance


def _sizes_fit(a: Column, b: Column, plan: Plan) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * plan.percent


def _links(plan: Plan):
    """applyInPandas body: the texts of a pair of blocks -> a spanning forest of their links."""

    def find(up: list[int], x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "text"])
        sets = []
        for _, _, buf, offsets in chunks(pa.array(rows["text"].tolist(), pa.string())):
            flat, counts = shingle_hashes(buf, offsets, plan.shingle)
            sets += [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])]
        size = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(size, kind="stable")
        sets, size, nodes = [sets[i] for i in order], size[order], rows["node"].to_numpy()[order]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, column = np.unique(flat, return_inverse=True)
        often = np.bincount(column)
        number = np.cumsum(often > 1) - 1
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(sets)), size)
        use = often[column] > 1
        row, column = row[use], number[column[use]]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width, last = 2048, int(column[-1]) + 1 if len(column) else 0
        for left in range(0, last, width):
            i, j = np.searchsorted(column, (left, left + width))
            dense = np.zeros((len(sets), min(width, last - left)), np.float32)
            dense[row[i:j], column[i:j] - left] = 1
            common += dense @ dense.T
        del ends
        union = size[:, None] + size[None, :] - common
        a, b = np.nonzero(np.triu(100 * common >= plan.percent * union, 1))
        up, kept = list(range(len(sets))), []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(up, x), find(up, y)
            if rx != ry:
                up[max(rx, ry)] = min(rx, ry)
                kept.append((nodes[x], nodes[y]))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return run


def _neighbourhoods(sets: DataFrame, plan: Plan) -> DataFrame:
    """(node, component) of the graph of all pairs of sets whose signatures are close; sets in none have no row."""
    slim = sets.select("node", "n_shingles", "sig")
    keyed = sets.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.col("node").bitwiseXOR(F.lit(s))).bitwiseXOR(F.lit(s)).alias(f"h{i}") for i, s in enumerate(HUB_SALTS)])
    hubs = hubs.where("n > 1").select("key", F.array_distinct(F.array(*[f"h{i}" for i in range(len(HUB_SALTS))])).alias("hubs"))
    shared = write_table(keyed.join(hubs, "key"), "buckets")
    spokes = shared.select("node", F.explode("hubs").alias("hub")).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def side(x: str) -> DataFrame:
        return slim.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    def near(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        return joined.where(_sizes_fit(F.col("n_a"), F.col("n_b"), plan) & _close(F.col("sig_a"), F.col("sig_b"), plan)).select("a", "b")

    near_hubs = write_table(near(spokes), "near")
    first = write_table(connected_components(near_hubs), "areas")
    placed = shared.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("area"))
    mixed = placed.groupBy("key").agg(F.min("area").alias("low"), F.max("area").alias("high")).where("low < high").select("key")
    apart = write_table(placed.join(mixed, "key").join(slim, "node"), "mixed")

    def ends(x: str) -> DataFrame:
        return apart.select("key", F.col("node").alias(x), F.col("area").alias(f"area_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    l, r = ends("a"), ends("b")  # noqa: E741
    across = l.join(r, (l["key"] == r["key"]) & (F.col("a") < F.col("b")) & (F.col("area_a") != F.col("area_b")) & _sizes_fit(F.col("n_a"), F.col("n_b"), plan) & _close(F.col("sig_a"), F.col("sig_b"), plan))
    return connected_components(near_hubs.union(across.select("a", "b")))


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, n_bytes: the component of each row of ``docs`` (doc_id, text) under links of at least
    ``plan.percent`` % Jaccard similarity of word-shingle sets, named by its smallest doc_id, itself included.

    Null or empty texts and texts without words have no shingles and are linked with nothing. Rows that share a doc_id are one
    document, linked if any of its texts is; each keeps its row. A row without doc_id is linked as its set is, but names no
    component (component_id is null if it has no other). Other columns are ignored. Empty input gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = write_table(docs.mapInArrow(_sketch(plan), SKETCH), "sketch")
    same = ["d1", "d2", "n_shingles"]
    reps = sketch.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node")).where("node is not null")
    reps = write_table(reps, "sets")
    firsts = sketch.where("doc_id is not null").withColumnRenamed("doc_id", "node").join(reps.hint("merge"), [*same, "node"], "left_semi")
    sets = firsts.select("node", "n_shingles", "sig", "keys")
    areas = _neighbourhoods(sets, plan).withColumnRenamed("component", "area")
    areas = write_table(areas.join(firsts.select("node", "n_bytes"), "node"), "areas")
    blocks = areas.groupBy("area").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    dealt = areas.join(blocks, "area").select("node", "area", "blocks", own.alias("block")).distinct()
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("block", i).alias("i"), F.greatest("block", i).alias("j")))
    # Both sides of these joins grow with the input, so neither is ever broadcast: the plan is the same at every size.
    texts = docs.withColumnRenamed("doc_id", "node").join(dealt.hint("merge"), "node")
    pairs = texts.select("node", "text", "area", F.explode(meets).alias("at")).select("node", "text", "area", "at.i", "at.j")
    links = pairs.groupBy("area", "i", "j").applyInPandas(_links(plan), "a long, b long")
    # Sets in several pieces under one doc_id meet through their node.
    joined = connected_components(links.union(sketch.join(reps, same).where("doc_id <> node").select("doc_id", "node")))
    least = joined.withColumnRenamed("component", "component_id")
    named = reps.join(least, "node", "left").select(*same, F.coalesce("component_id", "node").alias("component_id"))
    out = sketch.select("doc_id", "n_bytes", *same).join(named.hint("merge"), same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_bytes")
