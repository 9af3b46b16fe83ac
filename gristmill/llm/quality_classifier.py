"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document's statistics are standardised and mapped to ``features`` random Fourier features, whose dot products approximate a
Gaussian kernel. Each partition of the labelled sample sums its part of the normal equations, by fold; the sums (of a size that
doesn't depend on the input) are added fold by fold on the executors, and one sum a fold is solved on the driver for ridge weights. The calibration is fitted to predictions of
models that have not seen the row's fold, by pooling adjacent violators.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import bounded_share, write_table

STATISTICS = (
    "log_words", "log_lines", "word_length", "distinct_share", "top_word_share", "echo_share", "same_line_share", "upper_share",
    "digit_share", "sign_share", "mark_share", "stop_share", "bang_share", "pipe_share", "ascii_share", "line_words",
)
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>@^~_={}[]\\/+")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?'\"()-")] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True


@dataclass(frozen=True)
class Kernel:
    """``sample_rows``: labelled rows that the model is fitted on, at most (about); ``width``: of the Gaussian, in standard deviations."""

    sample_rows: int = 20_000
    features: int = 256
    width: float = 3.0
    ridge: float = 1.0
    folds: int = 5
    partitions: int = 8
    seed: int = 11


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # of the calibration's steps: raw score, calibrated share
    share: np.ndarray
    how: Kernel


def statistics(text: str) -> list[float]:
    """The statistics of one text, all finite; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(counts.sum()) - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    lines = [x for x in text.split("\n") if x]
    often = Counter(words)
    upper, letters = counts[_UPPER].sum(), counts[65:91].sum() + counts[97:123].sum()
    return [
        math.log1p(n), math.log1p(len(lines)), math.log(size / n), len(often) / n, max(often.values()) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), upper / max(1, letters), counts[_DIGIT].sum() / size, counts[_SIGNS].sum() / size, counts[_MARKS].sum() / size,
        counts[46] / n, counts[33] / n, counts[124] / n, counts[:128].sum() / counts.sum(), math.log1p(n / max(1, len(lines))),
    ]


def _table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


def _fourier(x: np.ndarray, how: Kernel) -> np.ndarray:
    """Random Fourier features and a constant."""
    random = np.random.default_rng(how.seed)
    along = random.normal(0, 1 / how.width, (x.shape[1], how.features))
    phase = random.uniform(0, 2 * np.pi, how.features)
    return np.hstack([math.sqrt(2 / how.features) * np.cos(x @ along + phase), np.ones((len(x), 1))])


def _statistics_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = pd.DataFrame(_table(rows["text"]), columns=STATISTICS)
        yield made.assign(label=rows["label"].to_numpy(np.float64), fold=rows["fold"].to_numpy(np.int64))


def _equations(mean: np.ndarray, scale: np.ndarray, how: Kernel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = how.features + 1
        sums = np.zeros((how.folds, d, d + 1))
        for rows in batches:
            z = _fourier((rows[list(STATISTICS)].to_numpy(np.float64) - mean) / scale, how)
            y, fold = rows["label"].to_numpy(np.float64), rows["fold"].to_numpy(np.int64)
            for k in range(how.folds):
                own = z[fold == k]
                sums[k] += own.T @ np.hstack([own, y[fold == k][:, None]])
        yield pd.DataFrame({"fold": range(how.folds), "sums": [x.tobytes() for x in sums]})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    parts = sorted(map(bytes, rows["sums"]))  # an order of their own, so that the last bits don't depend on how rows arrive
    total = sum(np.frombuffer(x, np.float64) for x in parts)
    return pd.DataFrame({"fold": rows["fold"].iloc[:1], "sums": [total.tobytes()]})


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising steps: the mean raw score and the mean label of each pool, pools in rising order."""
    pools: list[list[float]] = []  # labels, weight, raw scores
    order = np.lexsort((label, raw))
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        pools.append([y, 1.0, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            for i in range(3):
                pools[-1][i] += last[i]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, how: Kernel = Kernel()) -> Model:  # noqa: B008
    """Learn from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``. Null labels are left out, of several labels of a
    doc_id the largest counts. Without labels every score is 0.5. The labelled sample is bounded, so it is broadcast to the texts."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    sample = bounded_share(known, F.col("doc_id"), how.sample_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(how.folds)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label", "fold")
    schema = ", ".join(f"{c} double" for c in (*STATISTICS, "label")) + ", fold long"
    seen = write_table(rows.mapInPandas(_statistics_rows, schema), "statistics")
    about = seen.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in STATISTICS for f in (F.avg, F.stddev_pop)]).collect()[0]
    if not about["n"]:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(how.features + 1), np.zeros(1), np.full(1, 0.5), how)
    mean, scale = (np.array([about[f"{f}_{c}"] for c in STATISTICS], np.float64) for f in ("avg", "stddev_pop"))
    scale = np.where(scale > 1e-9, scale, 1.0)
    # A few partitions of the bounded sample, whatever the number of shuffle partitions, so that what they send has a fixed size.
    dealt = seen.coalesce(how.partitions).sortWithinPartitions(*STATISTICS)
    d = how.features + 1
    sums = np.zeros((how.folds, d, d + 1))
    parts = dealt.mapInPandas(_equations(mean, scale, how), "fold int, sums binary")
    for r in parts.groupBy("fold").applyInPandas(_added, "fold int, sums binary").collect():
        sums[r["fold"]] = np.frombuffer(r["sums"], np.float64).reshape(d, d + 1)

    def solve(part: np.ndarray) -> np.ndarray:
        return np.linalg.solve(part[:, :d] + how.ridge * np.eye(d), part[:, d])

    total = sums.sum(axis=0)
    unseen = [solve(total - sums[k]) for k in range(how.folds)]
    # The bounded sample, in an order of its own.
    held = seen.toPandas().sort_values([*STATISTICS, "label", "fold"], ignore_index=True)
    z = _fourier((held[list(STATISTICS)].to_numpy(np.float64) - mean) / scale, how)
    raw = np.einsum("ij,ij->i", z, np.array(unseen)[held["fold"].to_numpy(np.int64)])
    return Model(mean, scale, solve(total), *isotonic(raw, held["label"].to_numpy(np.float64)), how)


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            raw = _fourier((_table(rows["text"]) - model.mean) / model.scale, model.how) @ model.weights
            # Inside a step the raw score decides, by a thousandth at most.
            share = np.interp(raw, model.raw, model.share) * 0.999 + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": np.clip(share, 0, 1)})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) per row of ``docs``. A null text is scored as an empty one. Only doc_id and text are read; repeated
    rows score alike; empty input gives no rows."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_score(model), "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
