"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits into one sequence. The covering program (least number of configurations
that hold every length as often as it occurs) is solved by multiplicative weights: each length has a price that grows with how
well it is covered so far, and an unbounded-knapsack dynamic program over the capacity finds the configurations of best value,
one around each length. They are taken in whole numbers until every length's demand is reached, full ones as long as there are
any, then those of least empty places. What full ones don't hold is also packed best-fit by decreasing length, and the plan of
fewest sequences stays. The driver sees only the histogram, which has as many entries as the capacity however much the input
grows; pieces are laid into their places by rank within their length, which is counted in two levels so that no length is
gathered.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._shared import write_table

CACHE_WORDS, CACHE_CHARS = 100_000, 64
Pattern = tuple[tuple[int, int], ...]  # (length, count), lengths falling


@dataclass(frozen=True)
class Packing:
    """``step``, ``rate``: of the multiplicative weights: the share of the scarcest length's demand that each configuration takes,
    and how fast prices fall with coverage; ``lot``: about how many pieces of one length are ranked together."""

    tokenizer: str
    capacity: int = 2048
    end_id: int = 0
    step: float = 0.5
    rate: float = 3.0
    lot: int = 1_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others are numbered from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


#: Lower-cased pieces of words that the tokenizer keeps whole: Latin letters below U+0250, or ASCII signs. Apostrophes (which begin
#: contractions), digits, "<" and all else go through the whole tokenizer.
_SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+|[!-&(-/:;=-@\\[-`{-~]+")


#: What a tokenizer file must say for words to be encoded one by one: white space always ends a word, letters are lower-cased.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _by_words(tokenizer) -> bool:
    """Whether a tokenizer is of the kind that ``encoder`` takes apart word by word. Its parts are asked one by one, since the whole
    file is megabytes of vocabulary."""
    from tokenizers import models, normalizers, pre_tokenizers

    model, normalizer, parts = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
    if not (isinstance(model, models.BPE) and isinstance(normalizer, normalizers.Sequence) and isinstance(parts, pre_tokenizers.Sequence)):
        return False
    plain = not any((model.dropout, model.unk_token, model.continuing_subword_prefix, model.fuse_unk, model.byte_fallback, model.ignore_merges))
    marked = all("<" in t.content and not t.lstrip and not t.rstrip for t in tokenizer.get_added_tokens_decoder().values())
    said = [json.loads(x.__getstate__()) for x in (normalizer, parts)]
    return plain and marked and said[0].get("normalizers") == _NORMALIZER and said[1].get("pretokenizers") == [_SPLIT, _BYTES]


def encoder(path: str):
    """text -> its ids as little-endian uint32 bytes.

    Where the file says that white space always ends a word, words are encoded once each and remembered: a word of simple pieces
    piece by piece by the merges alone, any other by the whole tokenizer. Either memory is emptied when it has ``CACHE_WORDS``
    entries, none of over ``CACHE_CHARS`` characters. Texts go whole through any other tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    if not _by_words(tokenizer):
        return whole
    merge = tokenizer.model.tokenize
    letters = _byte_letters()
    known: dict[str, bytes] = {"": b""}
    parts: dict[str, bytes] = {}

    def part(p: str) -> bytes:
        out = parts.get(p)
        if out is None:
            if len(parts) >= CACHE_WORDS:
                parts.clear()
            spelled = p if p.isascii() else "".join([letters[b] for b in p.encode()])
            out = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in merge(spelled)]) else b""
            if len(p) <= CACHE_CHARS:
                parts[p] = out
        return out

    def word(w: str) -> bytes:
        low = w.lower()
        found = _SIMPLE.findall(low)
        if sum(map(len, found)) == len(low):
            out = b"".join([part(p) for p in found])
        else:
            out = whole(w)
        if len(known) >= CACHE_WORDS:
            known.clear()
            known[""] = b""
        if len(w) <= CACHE_CHARS:
            known[w] = out
        return out

    def encode(text: str) -> bytes:
        get = known.get
        return b"".join([word(w) if (ids := get(w)) is None else ids for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")])

    return encode


def _pieces(how: Packing):
    end, size = np.array([how.end_id], "<u4").tobytes(), how.capacity * 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(how.tokenizer)
        for rows in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                data = encode(text or "") + end
                for k, at in enumerate(range(0, len(data), size)):
                    part = data[at : at + size]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": ids, "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)})

    return run


def token_pieces(docs: DataFrame, how: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut where they exceed the capacity."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_pieces(how), "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over a histogram: pattern -> how often. A bin takes the longest length left that fits, again and again,
    and the same bin is filled as often as the histogram holds it."""
    left = {x: n for x, n in left.items() if n > 0}
    lengths = np.array(sorted(left), np.int64)
    counts = np.array([left[x] for x in lengths.tolist()], np.int64)
    out: Counter = Counter()
    while len(lengths):
        room, held = capacity, {}
        top = len(lengths) - 1
        while top >= 0:
            i = min(top, int(np.searchsorted(lengths, room, side="right")) - 1)
            while i >= 0 and counts[i] - held.get(i, 0) <= 0:
                i -= 1
            if i < 0:
                break
            n = min(int(counts[i]) - held.get(i, 0), room // int(lengths[i]))
            held[i] = held.get(i, 0) + n
            room -= n * int(lengths[i])
            top = i
        times = min(int(counts[i]) // n for i, n in held.items())
        out[tuple((int(lengths[i]), n) for i, n in held.items())] += times
        for i, n in held.items():
            counts[i] -= n * times
        if (counts == 0).any():
            keep = counts > 0
            lengths, counts = lengths[keep], counts[keep]
    return out


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The greatest value of each room up to ``capacity``, and the index of the length that it takes first (-1: leaves one place empty)."""
    best, take = np.zeros(capacity + 1), [-1] * (capacity + 1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        n, value = ends[room], best[room - 1]
        if n:
            values = best[room - lengths[:n]] + prices[:n]
            i = n - 1 - int(values[::-1].argmax())  # of equal ones the longest, as the short ones fill gaps later
            if values[i] > value:
                value, take[room] = values[i], i
        best[room] = value
    return best, take


def _trace(first: int, lengths: list[int], take: list[int], left: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """index -> count of the best configuration around the length ``first``, with no more of any length than is left, and its
    empty places. Where the program's choice is used up, the longest length left that fits takes its place."""
    held, room, empty = {first: 1}, capacity - lengths[first], 0
    while room > 0:
        i = take[room]
        if i >= 0 and held.get(i, 0) >= left[i]:
            room, empty = room + empty, 0
            i = bisect_right(lengths, room) - 1
            while i >= 0 and held.get(i, 0) >= left[i]:
                i -= 1
            if i < 0:
                return held, room
        if i < 0:
            room, empty = room - 1, empty + 1
            continue
        held[i] = held.get(i, 0) + 1
        room -= lengths[i]
    return held, empty


def configurations(histogram: dict[int, int], how: Packing) -> tuple[Counter, dict[int, int], Counter]:
    """Full priced configurations, pattern -> how often; what of the histogram they don't hold; the configurations that do."""
    left_of, chosen, slack, full = {x: n for x, n in histogram.items() if n > 0}, Counter(), 0, None
    while left_of:
        # Lengths whose demand is reached are out; the others' prices fall with the share that is covered.
        sizes = sorted(left_of)
        lengths, left = np.array(sizes, np.int64), [left_of[x] for x in sizes]
        need = [histogram[x] for x in sizes]
        lag = 1 - np.array(left, np.float64) / np.array(need, np.float64)
        prices = lengths * np.exp(-how.rate * (lag - lag.min()))
        best, take = _knapsack(lengths, prices, how.capacity)
        values = prices + best[how.capacity - lengths]
        taken, least = False, how.capacity
        for first in np.lexsort((-lengths, -np.round(values / values.max(), 3))).tolist():
            if left[first] <= 0:
                continue
            held, room = _trace(first, sizes, take, left, how.capacity)
            least = min(least, room)
            if room > slack:
                continue
            times = min(left[i] // n for i, n in held.items())
            times = min(times, max(1, int(how.step * min(need[i] / n for i, n in held.items()))))
            chosen[tuple((sizes[i], held[i]) for i in sorted(held, reverse=True))] += times
            for i, n in held.items():
                left[i] -= n * times
            taken = True
        left_of = {x: n for x, n in zip(sizes, left, strict=True) if n > 0}
        if not taken:
            full = full or (chosen, left_of)
            chosen, slack = Counter() if full[0] is chosen else chosen, least
    return (*full, chosen) if full else (chosen, {}, Counter())


def solve(histogram: dict[int, int], how: Packing) -> list[tuple[Pattern, int]]:
    """(pattern, times) that hold the histogram exactly, in a fixed order."""
    full = histogram.get(how.capacity, 0)
    pieces = {x: n for x, n in histogram.items() if n > 0 and x != how.capacity}
    chosen, left, rest = configurations(pieces, how)
    bound = -(-sum(x * n for x, n in pieces.items()) // how.capacity)
    plans = [chosen + rest, chosen + best_fit(left, how.capacity)]
    order = list(chosen.items())
    # Among few pieces full configurations can use up what the rest would need, so fewer of them are tried too.
    for quarters in (3, 2, 1, 0):
        if min(p.total() for p in plans) <= bound:
            break
        first, over = Counter(dict(order[: len(order) * quarters // 4])), dict(pieces)
        for pattern, times in first.items():
            for x, n in pattern:
                over[x] -= n * times
        plans.append(first + best_fit(over, how.capacity))
    chosen = min(plans, key=Counter.total)
    out = sorted((p, n) for p, n in chosen.items() if n)
    return [(((how.capacity, 1),), full)] * bool(full) + out


def _slots(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in the pattern, first sequence, offset of the first copy)."""
    ranks: Counter = Counter()
    out, first = [], 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern:
            out.append((length, ranks[length], ranks[length] + n * times, n, first, offset))
            ranks[length] += n * times
            offset += n * length
        first += times
    return out


SLOTS = T.StructType([T.StructField(x, T.LongType()) for x in ("length", "first", "end", "copies", "sequence", "place")])


def pack(docs: DataFrame, how: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of each row of ``docs`` (doc_id, text).

    Null and empty texts are one piece of the end id alone. Rows that share a doc_id, and rows without one, are pieces of their own.
    Other columns are ignored; empty input gives no rows. The slot table, which is joined by length and rank, grows with the number
    of lengths, not with the input: a pattern takes half of a length's demand, or a whole sequence where that is less.
    """
    spark = docs.sparkSession
    # The number is written with the pieces, so that equal ones are told apart and a task that runs again ranks them alike.
    pieces = write_table(token_pieces(docs, how).withColumn("number", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(solve(histogram, how))
    # A length is ranked in as many lots as it needs, however often it occurs. One row a length, so at most ``capacity`` are broadcast.
    dealt = spark.createDataFrame([(x, -(-n // how.lot)) for x, n in histogram.items()], "length long, lots long")
    pieces = pieces.join(F.broadcast(dealt), "length").withColumn("lot", F.pmod(F.xxhash64("number"), F.col("lots")))
    sizes = pieces.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = sizes.select("length", "lot", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "lot").orderBy("number")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(lots, ["length", "lot"]).withColumn("rank", F.col("before") + F.col("nth"))
    table = spark.createDataFrame(slots, SLOTS)
    # Per length its slots in rank order; a piece finds its own by the number of slots that begin at or before its rank.
    per_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "copies", "sequence", "place"))).alias("slots"))
    placed = ranked.join(F.broadcast(per_length), "length")
    own = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1)
    placed = placed.withColumn("slot", own).withColumn("turn", F.col("rank") - F.col("slot.first"))
    sequence = F.col("slot.sequence") + F.floor(F.col("turn") / F.col("slot.copies"))
    offset = F.col("slot.place") + F.pmod(F.col("turn"), F.col("slot.copies")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
