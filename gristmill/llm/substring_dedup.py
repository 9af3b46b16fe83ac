"""Substring dedup: units of lines are normalised and hashed, and only the earliest ranked occurrence of each stays.

A unit is a line, or a piece of a line that ends at a sentence end; pieces of under ``unit_words`` words join the next one (at the
end of a line, the one before), so that a passage is found again wherever in a line it was put. Units are lower-cased, their
white space is folded, and a 64-bit digest is taken (the odds of a collision among n units are about n * n / 2**65). Of each
digest, the document of the least doc_id keeps its first occurrence. Repeated lines of ``unit_words`` words or more are removed
everywhere else. Pieces of lines are removed in runs of consecutive repeated units of ``min_words`` words together; shorter ones
are chance or set phrases and stay. Lines of under ``unit_words`` words say nothing alone, so they are held together with their
neighbours: windows of units of ``min_words`` words that have such a line in them are hashed too, and repeated ones are removed.
With ``Limits(1, 1)`` nothing is too short: every unit that is repeated is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import write_table



@dataclass(frozen=True)
class Limits:
    """``unit_words``: words of a unit that counts alone; ``min_words``: words of a run of pieces, and of a window of short lines."""

    unit_words: int = 4
    min_words: int = 10


_CUT = re.compile(r"[.!?]+[ \t\r\f\v]+|[ \t\r\f\v]*\n[ \t\r\f\v\n]*")


def _digest(data: bytes, person: bytes = b"") -> int:
    return int.from_bytes(blake2b(data, digest_size=8, person=person).digest(), "little", signed=True)


def units(text: str, unit_words: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(start, end, start of the next unit, words, digest) of each unit; (first unit, unit after the last) of each line."""
    out: list[tuple[int, int, int, int, int]] = []
    lines: list[tuple[int, int]] = []
    start, line_first, end_of_text = 0, 0, len(text)

    def add(end: int, after: int, closes: bool) -> None:
        nonlocal start, line_first
        words = text[start:end].lower().split()
        if len(words) < unit_words:
            if not closes:
                return
            if len(out) > line_first:  # joins the unit before it in its line
                start = out.pop()[0]
                words = text[start:end].lower().split()
        if words:
            out.append((start, end, after, len(words), _digest(" ".join(words).encode("utf-8", "surrogatepass"))))
        start = after
        if closes:
            if len(out) > line_first:
                lines.append((line_first, len(out)))
            line_first = len(out)

    for m in _CUT.finditer(text):
        found = m.group()
        if "\n" in found:
            add(m.start(), m.end(), True)
        else:
            add(m.start() + len(found.rstrip()), m.end(), False)
    if start < end_of_text:
        add(end_of_text, end_of_text, True)
    elif len(out) > line_first:
        lines.append((line_first, len(out)))
    return out, lines


def passages(text: str, limits: Limits) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, bool]]]:
    """The units, and (first unit, unit after the last, digest, whether it goes wherever it is repeated) of each unit of
    ``unit_words`` words or more, of each line of several units, and of each window with a short line in it.

    The windows are the least ones of ``min_words`` words that begin at a unit, and those that end at a short line. Any repeated
    passage of ``min_words`` words has one of them around each of its short lines."""
    found, lines = units(text, limits.unit_words)
    whole = {i for i, j in lines if j == i + 1}
    out = [(i, i + 1, u[4], i in whole) for i, u in enumerate(found) if u[3] >= limits.unit_words]
    packed = [u[4].to_bytes(8, "little", signed=True) for u in found]
    out += [(i, j, _digest(b"".join(packed[i:j]), b"line"), True) for i, j in lines if j > i + 1]
    short = [i for i, u in enumerate(found) if u[3] < limits.unit_words]
    if short:
        ends = np.cumsum([0, *(u[3] for u in found)])
        before = np.cumsum([0, *(u[3] < limits.unit_words for u in found)])
        at = np.arange(len(found))
        after = np.searchsorted(ends, ends[:-1] + limits.min_words)
        back = np.searchsorted(ends, ends[1:] - limits.min_words, side="right") - 1
        windows = {(i, j) for i, j in zip(at.tolist(), after.tolist(), strict=True) if j <= len(found) and before[j] > before[i]}
        windows |= {(int(back[i]), i + 1) for i in short if back[i] >= 0}
        out += [(i, j, _digest(b"".join(packed[i:j]), b"window"), True) for i, j in sorted(windows)]
    return found, out


def _digests(limits: Limits):
    """mapInPandas body: doc_id, text -> doc_id, digest, n: each digest of a text once, with its number there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, all_digests, numbers = [], [], []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                if not text:
                    continue
                digests, n = np.unique(np.array([p[2] for p in passages(text, limits)[1]], np.int64), return_counts=True)
                ids.append(np.full(len(digests), int(doc_id), np.int64))
                all_digests.append(digests)
                numbers.append(n)
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "digest": np.concatenate(all_digests), "n": np.concatenate(numbers)})

    return run


def cut(text: str, repeated: dict[int, bool], limits: Limits) -> tuple[str, list[tuple[int, int]], int]:
    """The text without its repeated lines and runs, their (start, end) in ``text`` with the separator behind them, and the words
    removed. The text without those spans is the returned one, character for character.

    ``repeated``: digest -> whether this document keeps the first occurrence."""
    found, parts = passages(text, limits)
    kept_to: dict[int, int] = {}
    again, goes = [False] * len(found), [False] * len(found)
    for i, j, digest, alone in parts:
        if digest not in repeated:
            continue
        first = i
        if repeated[digest]:
            first = max(i, kept_to.setdefault(digest, j))
        for k in range(first, j):
            again[k] = True
            goes[k] = goes[k] or alone
    at = 0
    while at < len(found):
        end = at
        while end < len(found) and again[end]:
            end += 1
        if sum(u[3] for u in found[at:end]) >= limits.min_words:
            goes[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    spans, removed = [], 0
    for k, u in enumerate(found):
        if goes[k]:
            removed += u[3]
            if k and goes[k - 1]:
                spans[-1] = (spans[-1][0], u[2])
            else:
                spans.append((u[0], u[2]))
    kept, at = [], 0
    for start, after in spans:
        kept.append(text[at:start])
        at = after
    return "".join([*kept, text[at:]]), spans, removed


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


#: Rows whose cut texts are held at a time.
SLICE = 256


def _clean(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                rows = batch.slice(first, SLICE)
                carried, repeated, out = rows.column("carried"), rows.column("repeated"), []
                cells = repeated.flatten()
                digests, firsts = (cells.field(x).to_numpy(zero_copy_only=False) for x in ("digest", "first"))
                at = 0
                for text, n in zip(carried.field("text"), pc.fill_null(pc.list_value_length(repeated), 0).to_pylist(), strict=True):
                    text = text.as_py()
                    owned = dict(zip(digests[at : at + n].tolist(), firsts[at : at + n].tolist(), strict=True))
                    out.append(cut(text, owned, limits) if text and owned else (text, [], 0))
                    at += n
                spans = pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in out], _SPANS)
                yield pa.RecordBatch.from_arrays([carried, pa.array([x[0] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64()), spans], names=["carried", "clean", "removed_words", "spans"])

    return run


def clean_rows(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """carried (a struct of the row's columns), clean (its text without repeats), removed_words, spans (of the original text: start,
    end in code points; ``clean`` is the text without them) per row of ``docs`` (doc_id, text and others).

    Null texts stay null, empty ones empty. Rows that share a doc_id are one document: all keep what that document keeps, so that
    a repeated row is not cut for its twin; which of them comes first doesn't matter, as each is cut by itself: of what the document
    owns, each row keeps its first occurrence. A row without doc_id neither owns nor loses a unit. Empty input gives no rows.
    """
    ids, text = docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")
    read = docs.select(ids, text)
    found = write_table(read.where("doc_id is not null").mapInPandas(_digests(limits), "doc_id long, digest long, n long"), "units")
    owners = found.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.sum("n").alias("total")).where("total > 1").select("digest", "owner")
    hits = found.join(owners.hint("merge"), "digest").where("doc_id <> owner or n > 1")
    lists = hits.groupBy("doc_id").agg(F.collect_set(F.struct("digest", (F.col("doc_id") == F.col("owner")).alias("first"))).alias("repeated"))
    whole = docs.select(ids, F.struct(*[docs[c] if c != "text" else text for c in docs.columns]).alias("carried"))
    # Both sides grow with the input, so neither is broadcast.
    dealt = whole.join(lists.hint("merge"), "doc_id", "left").select("carried", "repeated")
    kind = whole.schema["carried"].dataType.simpleString()
    return dealt.mapInArrow(_clean(limits), f"carried {kind}, clean string, removed_words long, spans array<struct<start:int,end:int>>")


def dedup_substrings(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, text (without repeats), removed_words, spans per row of ``docs``, as ``clean_rows``; other columns are ignored."""
    cleaned = clean_rows(docs.select("doc_id", "text"), limits)
    return cleaned.select(F.col("carried.doc_id").cast("long").alias("doc_id"), F.col("clean").alias("text"), "removed_words", "spans")
