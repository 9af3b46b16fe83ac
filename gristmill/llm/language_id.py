"""Language identification by language-bitmask n-gram filters.

Each language's typical character n-grams go into one bit-sliced Bloom filter: an array of language masks, of which an n-gram sets
its language's bit in ``PROBES`` places. One look-up (the AND of those places) returns all languages that contain an n-gram. A
text's masks are counted language by language, the counts are corrected for the filter's false positives, and the language with
the largest share of the text's n-grams decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import hash_limit, sample_hash, write_table
from gristmill.llm._words import mix64

PROBES = 3
CHUNK = 1 << 19
UNKNOWN = "und"


@dataclass(frozen=True)
class Filters:
    """``sample_rows``: rows of each language that the n-grams are learned from, at most (about); ``grams``: n-grams a language
    keeps; ``slots``: places of the filter, a power of two; ``lift``: how much likelier than on average over the languages an
    n-gram must be in one to be typical of it."""

    sizes: tuple[int, ...] = (1, 2, 3, 4)
    sample_rows: int = 3000
    grams: int = 6000
    slots: int = 1 << 18
    lift: float = 1.2


def _gram_hashes(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts and how many each has. Words are runs of letters, lower-cased, with an edge at either end;
    n-grams stay inside a word and its edges."""
    codes, bounds = [], [0]
    for t in texts:
        codes.append(f" {t.lower()} ")
        bounds.append(bounds[-1] + len(codes[-1]))
    flat = np.frombuffer(("".join(codes)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(flat)
    flat = np.where(letter, flat, 32).astype(np.uint64)
    # White space after white space belongs to no n-gram.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))[keep]
    flat, letter = flat[keep], letter[keep]
    hashes, owners = [], []
    rolled = np.zeros(len(flat), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(flat) < n:
            break
        rolled = rolled[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n not in sizes:
            continue
        ok = owner[: len(rolled)] == owner[n - 1 :]
        for j in range(1, n - 1):  # an edge only comes first or last
            ok &= letter[j : j + len(rolled)]
        ok &= (letter[: len(rolled)] | letter[n - 1 :]) if n > 1 else letter
        hashes.append(mix64(rolled[ok] * np.uint64(8) + np.uint64(n)))
        owners.append(owner[: len(rolled)][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    return hashes[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(texts))


_LETTER: dict[str, np.ndarray] = {}


def _letters(codes: np.ndarray) -> np.ndarray:
    """Letters, and the first two combining marks after one, which are parts of words."""
    if not _LETTER:
        _LETTER["bmp"] = np.array([chr(c).isalpha() for c in range(0x10000)])
        _LETTER["mark"] = np.array([category(chr(c))[0] == "M" for c in range(0x10000)])
    small = codes < 0x10000
    low = np.where(small, codes, 0)
    out = _LETTER["bmp"][low]
    for i in np.flatnonzero(~small):
        out[i] = chr(int(codes[i])).isalpha()
    mark = _LETTER["mark"][low]
    if mark.any():
        mark[1:] &= out[:-1] | (mark[:-1] & np.concatenate(([False], out[:-2])) if len(out) > 2 else out[:-1])
        mark[:1] = False
        out |= mark
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _count(how: Filters):
    """lang, text -> lang, gram, n per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lang, own in rows.groupby("lang"):
                texts = own["text"].tolist()
                for a, b in _pieces(texts):
                    grams, n = np.unique(_gram_hashes(texts[a:b], how.sizes)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    return run


def _places(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    how: Filters


def fit(docs: DataFrame, how: Filters = Filters()) -> Model:  # noqa: B008
    """Learn from ``docs`` (doc_id, text, lang); rows without text or lang are left out. At most 64 languages."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(number)
    if len(langs) > 64:
        raise ValueError(f"a mask has 64 bits, and there are {len(langs)} languages")
    if not langs:
        return Model([], np.zeros(how.slots, np.uint64), np.zeros(0), how)
    limits = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(hash_limit(how.sample_rows, number[lang])))])
    sample = rows.where(sample_hash(F.col("doc_id")) <= limits[F.col("lang")])
    counts = sample.select("lang", "text").mapInPandas(_count(how), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # Rates of an n-gram by language, side by side: the mean over all languages counts those that lack it as 0.
    rated = counts.where("n > 1").join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    means = rated.groupBy("gram").agg((F.sum("rate") / len(langs)).alias("mean"))
    typical = rated.join(means, "gram").where(F.col("rate") >= how.lift * F.col("mean") if len(langs) > 1 else F.lit(True))
    masks = np.zeros(how.slots, np.uint64)
    for bit, lang in enumerate(langs):
        best = typical.where(F.col("lang") == lang).orderBy(F.desc("rate"), "gram").limit(how.grams).select("gram").toPandas()
        for place in _places(best["gram"].to_numpy(np.int64).view(np.uint64), how.slots):
            masks[np.unique(place)] |= np.uint64(1 << bit)
    filled = np.array([((masks >> np.uint64(bit)) & np.uint64(1)).mean() for bit in range(len(langs))])
    return Model(langs, masks, filled**PROBES, how)


def _predict(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            best, score = [], []
            for a, b in _pieces(texts):
                hashes, counts = _gram_hashes(texts[a:b], model.how.sizes)
                one, *rest = _places(hashes, model.how.slots)
                mask = model.masks[one]
                for place in rest:
                    mask &= model.masks[place]
                ends = np.cumsum(counts)
                held = np.zeros((b - a, len(model.langs)))
                for bit in range(len(model.langs)):
                    total = np.concatenate(([0], np.cumsum((mask >> np.uint64(bit)) & np.uint64(1))))
                    held[:, bit] = total[ends] - total[ends - counts]
                some = counts > 0
                n = np.maximum(counts, 1)[:, None]
                # Of n look-ups, n * rate would be positive by chance.
                fixed = np.clip((held - n * model.false_rate) / (1 - model.false_rate), 0, None) / n
                top = fixed.argmax(axis=1) if len(model.langs) else np.zeros(b - a, np.int64)
                # Each language's distance to the best one in standard errors of the difference of two counts.
                counted = fixed * n
                lead = counted.max(axis=1, initial=0, keepdims=True)
                share = 1 / np.maximum(np.exp((counted - lead) / np.sqrt(counted + lead + 1)).sum(axis=1), 1)
                best += [model.langs[t] if ok and model.langs else UNKNOWN for t, ok in zip(top.tolist(), some.tolist(), strict=True)]
                score += np.where(some, share, 0.0).tolist()
            yield pd.DataFrame({"doc_id": rows["doc_id"], "lang_pred": best, "score": np.array(score, np.float64)})

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row of ``docs``; ``und`` and 0 for a text that is
    null or has no letter. The score is near 1 when the best language's corrected count is standard errors above the others', and the
    even share when all are equal. A text whose n-grams no filter holds gets the first language with an even share. Only doc_id and text
    are read. Ties go to the language that sorts first; empty input gives no rows."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_predict(model), "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))

