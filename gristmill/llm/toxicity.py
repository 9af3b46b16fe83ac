"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their first ``PREFIX`` bytes, hashed to ``2**bits`` ids. A score is the sigmoid of a bias, a weight
for each term of the text and, for each pair of its terms, the product of their factor vectors, so that pairs (an insult and the
mention of a group, say) count beyond what their terms add up to. Terms are present or not; only the ``terms`` that tell most
about the label in the fitted sample have parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import bounded_share, write_table
from gristmill.llm._words import SIGNS, chunks, owners, span_hashes, word_bounds

PREFIX = 5


@dataclass(frozen=True)
class Machine:
    """``sample_rows``: labelled rows that the machine is fitted on, at most (about); ``positive_weight``: what a row of label 1, of
    which there are few, weighs in training."""

    sample_rows: int = 20_000
    bits: int = 24
    terms: int = 4096
    factors: int = 4
    epochs: int = 30
    rate: float = 0.1
    decay: float = 1e-4
    positive_weight: float = 4.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    ids: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    bits: int


def _terms(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Term ids and the text of each, words first and then prefixes."""
    starts, ends = word_bounds(buf, offsets, SIGNS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = owners(starts, offsets)
    words, heads = span_hashes(buf, [(starts, ends), (starts, np.minimum(ends, starts + PREFIX))])
    shift = np.uint64(64 - bits)
    return np.concatenate([words >> shift, (heads * np.uint64(0x9E3779B97F4A7C15)) >> shift]).astype(np.int64), np.concatenate([by, by])


def _collect_terms(bits: int):
    schema = pa.schema([("label", pa.int32()), ("terms", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").cast(pa.int32())
            for first, end, buf, offsets in chunks(batch.column("text")):
                ids, by = _terms(buf, offsets, bits)
                pairs = np.unique(by * (1 << bits) + ids)
                sizes = np.bincount(pairs >> bits, minlength=end - first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([label.slice(first, end - first), lists], schema=schema)

    return run


def _g(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)


def _telling(rows: DataFrame, n: int, positive: int, most: int) -> np.ndarray:
    """The ids whose presence tells most about the label by the G statistic (10.8: p of about 0.001). ``rows``: label, terms."""
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("label").cast("double").alias("h"))
    a, h, lot, some = F.col("a"), F.col("h"), F.lit(float(n)), F.lit(float(positive))
    g = _g(h, a * some / lot) + _g(a - h, a * (lot - some) / lot) + _g(some - h, (lot - a) * some / lot) + _g(lot - a - some + h, (lot - a) * (lot - some) / lot)
    best = counts.withColumn("g", F.round(g, 6)).where("a > 1 and g > 10.8").orderBy(F.desc("g"), "term").limit(most)
    return np.sort(np.array([r["term"] for r in best.select("term").collect()], np.int64))


def _known_terms(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t[np.isin(t, known)].astype(np.int32) for t in batch.column("terms").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(kept, pa.list_(pa.int32()))], names=["label", "terms"])

    return run


def _train(known: np.ndarray, terms: list[np.ndarray], label: np.ndarray, how: Machine) -> Model:
    positive = label.sum()
    bias = float(np.log((positive + 1) / (len(label) - positive + 1)))
    if not len(known):
        return Model(known, bias, np.zeros(0), np.zeros((0, how.factors)), how.bits)
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    column = np.searchsorted(known, np.concatenate(terms))
    sizes = np.bincount(rows, minlength=len(terms))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    random = np.random.default_rng(how.seed)
    w, v = np.zeros(len(known)), random.normal(0, 0.01, (len(known), how.factors))
    gw, gv, gb = np.full(len(known), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(how.epochs):
        order = random.permutation(len(terms))
        for batch in np.array_split(order, max(1, len(order) // 256)):
            take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            own, col = np.repeat(np.arange(len(batch)), sizes[batch]), column[take]
            sums = np.zeros((len(batch), how.factors))
            squares = np.zeros(len(batch))
            linear = np.bincount(own, weights=w[col], minlength=len(batch))
            for f in range(how.factors):
                x = v[col, f]
                sums[:, f] = np.bincount(own, weights=x, minlength=len(batch))
                squares += np.bincount(own, weights=x * x, minlength=len(batch))
            z = bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]) * np.where(label[batch] > 0, how.positive_weight, 1) / len(batch) * 16
            step = error.sum()
            gb += step * step
            bias -= how.rate * step / np.sqrt(gb)
            touched, inside = np.unique(col, return_inverse=True)
            d = np.bincount(inside, weights=error[own]) + how.decay * w[touched]
            gw[touched] += d * d
            w[touched] -= how.rate * d / np.sqrt(gw[touched])
            for f in range(how.factors):
                d = np.bincount(inside, weights=error[own] * (sums[own, f] - v[col, f])) + how.decay * v[touched, f]
                gv[touched, f] += d * d
                v[touched, f] -= how.rate * 0.3 * d / np.sqrt(gv[touched, f])
    return Model(known, bias, w, v, how.bits)


def fit(docs: DataFrame, labels: DataFrame, how: Machine = Machine()) -> Model:  # noqa: B008
    """Learn from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs`` (doc_id, text). Null labels are left out, of several
    labels of a doc_id the largest counts. The labelled sample is bounded, so it is broadcast to the texts."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = bounded_share(known, F.col("doc_id"), how.sample_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    seen = write_table(rows.mapInArrow(_collect_terms(how.bits), "label int, terms array<int>"), "terms")
    about = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive")).collect()[0]
    known = _telling(seen, about["n"], about["positive"], how.terms) if 0 < about["positive"] < about["n"] else np.zeros(0, np.int64)
    found = seen.mapInArrow(_known_terms(known), "label int, terms array<int>").toPandas()
    # In an order of their own, so that the model doesn't depend on how rows were dealt out.
    terms = [np.asarray(x, np.int64) for x in found["terms"]]
    order = sorted(range(len(terms)), key=lambda i: (len(terms[i]), terms[i].tobytes(), found["label"][i]))
    return _train(known, [terms[i] for i in order], found["label"].to_numpy(np.float64)[order], how)


def _score(model: Model):
    seen = np.zeros(1 << 16, bool)
    seen[model.ids & 0xFFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried, out = batch.column("carried"), []
            for first, end, buf, offsets in chunks(carried.field("text")):
                ids, by = _terms(buf, offsets, model.bits)
                z = np.full(end - first, model.bias)
                if len(model.ids):
                    maybe = seen[ids & 0xFFFF]
                    ids, by = ids[maybe], by[maybe]
                    at = np.minimum(np.searchsorted(model.ids, ids), len(model.ids) - 1)
                    use = model.ids[at] == ids
                    pairs = np.unique(by[use] * len(model.ids) + at[use])
                    by, at = pairs // len(model.ids), pairs % len(model.ids)
                    z += np.bincount(by, weights=model.weights[at], minlength=len(z))
                    for f in range(model.vectors.shape[1]):
                        x = model.vectors[at, f]
                        z += 0.5 * (np.bincount(by, weights=x, minlength=len(z)) ** 2 - np.bincount(by, weights=x * x, minlength=len(z)))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([carried, pa.array(np.concatenate([*out, np.zeros(0)]))], names=["carried", "score"])

    return run


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """carried (a struct of the row's columns, text among them), score (0 to 1) per row of ``docs``.

    Null and empty texts have no terms and score the bias alone. Only the text is read; repeated rows score alike; empty input
    gives no rows."""
    rows = docs.select(F.struct(*[docs[c] if c != "text" else docs[c].cast("string").alias(c) for c in docs.columns]).alias("carried"))
    return rows.mapInArrow(_score(model), f"carried {rows.schema['carried'].dataType.simpleString()}, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score per row of ``docs`` (doc_id, text), as ``score_rows``."""
    return score_rows(docs.select("doc_id", "text"), model).select("carried.doc_id", "score")
