"""Quality rules: a linear-chain conditional random field marks each line of a text as content or boilerplate.

Base counts over whole texts decide some documents at once. For the others, Viterbi decoding finds the likeliest labelling of the
line sequence, and the share of words that stand in content lines decides. No line has a label; what the field learns from are
documents that are marked good or bad as wholes. Lines of good ones are content. Lines of bad ones begin as boilerplate and are then
decoded with the field learned so far, so that the good lines which bad documents also hold become content; a bad document keeps its
likeliest boilerplate line at least. The field is trained by gradient ascent on the conditional likelihood of these marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import bounded_share, release, write_table
from gristmill.llm._words import SAME, SPACE, chunks, constants, mix64, owners, span_hashes, word_bounds

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91], _LETTER[97:123] = True, True
_BANG = np.zeros(256, bool)
_BANG[33] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEAD = np.arange(256) & 0xC0 != 0x80  # the first byte of a code point
#: Words that begin licence, rights and navigation lines, as hashed spans.
_NOTICE = [b"licensed", b"licence", b"license", b"copyright", b"rights", b"reserved.", b"cookies", b"privacy", b"subscribe", b"terms", b"login"]
FEATURES = ("bias", "symbols", "upper", "bangs", "digits", "echoes", "again", "short", "notice")
CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class Rules:
    """``content``: share of a document's words that must stand in content lines. The field is trained on about ``sample_rows``
    marked documents of either kind at most, and of their lines, in sequences of ``sequence`` lines, on about ``sample_sequences``."""

    least_words: int = 50
    most_repeated_percent: int = 50
    content: float = 0.5
    sample_rows: int = 2000
    sequence: int = 32
    sample_sequences: int = 4000
    rounds: int = 2
    steps: int = 100
    rate: float = 0.05
    decay: float = 1e-4


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # feature x label
    move: np.ndarray  # label x label


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags)))


def _per(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _first_of_equal(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its equals."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    return first


def _notice_hashes() -> np.ndarray:
    text = b" ".join(_NOTICE)
    buf = np.frombuffer(text, np.uint8)
    bounds = word_bounds(buf, np.array([0, len(buf)]))
    return np.sort(span_hashes(buf, [bounds])[0])


def measure(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts by text; and of each line with a word: its text, its words, its features."""
    n = len(offsets) - 1
    starts, ends = word_bounds(buf, offsets)
    owner = owners(starts, offsets)
    words = np.bincount(owner, minlength=n)
    base = {"n_words": words}
    if not len(starts):
        zero = np.zeros(n, np.int64)
        return base | dict.fromkeys(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zero), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
    heads, symbols = _sums(_HEAD[buf] & ~SPACE[buf]), _sums(_SYMBOL[buf])
    base["word_chars"] = heads[offsets[1:]] - heads[offsets[:-1]]
    base["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    same = span_hashes(buf, [(starts, ends)], SAME)[0]
    low = span_hashes(buf, [(starts, ends)])[0]

    # Three-word windows inside a text, found twice or more.
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        by = constants(4, 9)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        window = mix64(same[inside] * by[0] + same[inside + 1] * by[1] + same[inside + 2] * by[2] + owner[inside].astype(np.uint64) * by[3])
        order = np.argsort(window)
        twin = np.zeros(len(window), bool)
        equal = window[order[1:]] == window[order[:-1]]
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
        for j in range(3):
            repeated[inside[twin] + j] = True
    base["n_repeat_words"] = np.bincount(owner[repeated], minlength=n)

    # Lines with a word: from after a line feed (or the text's start) to the next one (or its end).
    feeds = np.flatnonzero(buf == 10)
    cuts = np.unique(np.concatenate([offsets, feeds, feeds + 1]))
    begin, end = cuts[:-1], cuts[1:]
    use = ~((end - begin == 1) & (buf[np.minimum(begin, len(buf) - 1)] == 10)) & (begin < end)
    begin, end = begin[use], end[use]
    line_of_word = np.searchsorted(begin, starts, side="right") - 1
    line_words = np.bincount(line_of_word, minlength=len(begin))
    full = line_words > 0
    number = np.cumsum(full) - 1
    line_of_word, begin, end, line_words = number[line_of_word], begin[full], end[full], line_words[full]
    line_owner = owners(begin, offsets)
    key = mix64(span_hashes(buf, [(begin, end)], SAME)[0] ^ mix64(line_owner.astype(np.uint64) + np.uint64(1)))
    again = ~_first_of_equal(key)
    base["n_dup_lines"] = np.bincount(line_owner[again], minlength=n)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = _sums(flags[buf])
        return (total[end] - total[begin]) / np.maximum(of, 1)

    letters = _sums(_LETTER[buf])
    letters = letters[end] - letters[begin]
    echo = np.zeros(len(starts), bool)
    echo[1:] = (same[1:] == same[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    known = _notice_hashes()
    at = np.minimum(np.searchsorted(known, low), len(known) - 1)
    notice = _per(line_of_word, known[at] == low, len(begin)) > 0
    upper = np.where(letters >= 8, share(_UPPER, letters), 0)
    features = np.stack(
        [
            np.ones(len(begin)), np.minimum(share(_SYMBOL, line_words), 1), upper, np.minimum(share(_BANG, line_words), 1), np.minimum(share(_DIGIT, line_words), 2) / 2,
            _per(line_of_word, echo, len(begin)) / line_words, again.astype(float), (line_words <= 3).astype(float), notice.astype(float) * (line_words <= 20),
        ],
        axis=1,
    )
    return base, line_owner, line_words, features


def train(documents: list[tuple[np.ndarray, np.ndarray]], rules: Rules) -> Field:
    """Gradient ascent on the mean log-likelihood of (features, marks) sequences; sequences are padded to run side by side, features
    are brought to one scale, and each weight has a step of its own."""
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    documents = [(x, y) for x, y in documents if len(x)]
    if not documents:
        return Field(emit, move)
    length = np.array([len(x) for x, _ in documents])
    deep = int(length.max())
    x = np.zeros((len(documents), deep, len(FEATURES)))
    y = np.zeros((len(documents), deep), np.int64)
    for i, (a, b) in enumerate(documents):
        x[i, : len(a)], y[i, : len(b)] = a, b
    real = np.arange(deep)[None, :] < length[:, None]
    spread = x[real].std(axis=0)
    spread = np.where(spread > 1e-6, spread, 1.0)
    x /= spread
    emit_steps, move_steps = np.full(emit.shape, 1e-8), np.full(move.shape, 1e-8)
    pair = real[:, 1:]
    total = real.sum()
    truth = np.eye(2)[y] * real[..., None]
    pairs = np.einsum("ntj,ntk->jk", truth[:, :-1] * pair[..., None], truth[:, 1:])
    for _ in range(rules.steps):
        score = x @ emit
        up = np.zeros_like(score)
        up[:, 0] = score[:, 0]
        for t in range(1, deep):
            new = score[:, t] + np.logaddexp(up[:, t - 1, :1] + move[0], up[:, t - 1, 1:] + move[1])
            up[:, t] = np.where(real[:, t, None], new, up[:, t - 1])
        down = np.zeros_like(score)
        for t in range(deep - 2, -1, -1):
            after = score[:, t + 1] + down[:, t + 1]
            new = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
            down[:, t] = np.where(real[:, t + 1, None], new, 0)
        whole = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
        single = np.exp(up + down - whole[:, None, None]) * real[..., None]
        joint = np.exp(up[:, :-1, :, None] + move + (score + down)[:, 1:, None, :] - whole[:, None, None, None]) * pair[..., None, None]
        emit_up = np.einsum("ntf,ntk->fk", x, truth - single) / total - rules.decay * emit
        move_up = (pairs - joint.sum(axis=(0, 1))) / total - rules.decay * move
        emit_steps, move_steps = 0.9 * emit_steps + 0.1 * emit_up**2, 0.9 * move_steps + 0.1 * move_up**2
        emit += rules.rate * emit_up / np.sqrt(emit_steps)
        move += rules.rate * move_up / np.sqrt(move_steps)
    return Field(emit / spread[:, None], move)


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The likeliest label sequence; a tie goes to content."""
    (m00, m01), (m10, m11) = move.tolist()
    back, (a, b) = [], scores[0].tolist()
    for e0, e1 in scores[1:].tolist():
        from_a, from_b = a + m00 < b + m10, a + m01 < b + m11
        back.append((int(from_a), int(from_b)))
        a, b = (b + m10 if from_a else a + m00) + e0, (b + m11 if from_b else a + m01) + e1
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def learn(sequences: list[tuple[np.ndarray, bool]], rules: Rules) -> Field:
    """The field of (features, whether the document is good) sequences."""
    bad = [i for i, (_, good) in enumerate(sequences) if not good]
    marks = [np.full(len(x), CONTENT if good else BOILERPLATE) for x, good in sequences]
    field = train([(x, y) for (x, _), y in zip(sequences, marks, strict=True)], rules)
    for _ in range(rules.rounds - 1 if bad else 0):
        for i in bad:
            scores = sequences[i][0] @ field.emit
            marks[i] = np.array(viterbi(scores, field.move))
            marks[i][(scores[:, BOILERPLATE] - scores[:, CONTENT]).argmax()] = BOILERPLATE
        field = train([(x, y) for (x, _), y in zip(sequences, marks, strict=True)], rules)
    return field


def _sequences(most: int):
    """label, text -> the features of each document's lines, cut into sequences of ``most`` lines, all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            labels, out = rows["label"].tolist(), []
            for first, _, buf, offsets in chunks(pa.array(rows["text"].tolist(), pa.string())):
                _, owner, _, features = measure(buf, offsets)
                for i in np.unique(owner).tolist():
                    own = features[owner == i].astype(np.float32)
                    out += [(labels[first + i], own[k : k + most].tobytes()) for k in range(0, len(own), most)]
            yield pd.DataFrame(out, columns=["label", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Field:  # noqa: B008
    """Learn from ``labels`` (doc_id, label: 1 good, 0 bad) and the texts of ``docs`` (doc_id, text).

    Null labels are left out, of several labels of a doc_id the largest counts; without labels every line is content. The sampled
    labels are bounded, so they are broadcast to the texts, and so are the sequences that come to the driver: at most about
    ``sample_sequences * sequence * 36`` bytes, however long the texts are. Null and empty texts teach nothing."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = F.broadcast(bounded_share(known, F.col("doc_id"), rules.sample_rows))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("label", "text")
    cut = write_table(rows.mapInPandas(_sequences(rules.sequence), "label int, features binary"), "sequences")
    found = bounded_share(cut, F.col("features"), rules.sample_sequences).toPandas()
    release(cut)
    tables = [(np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)).astype(np.float64), good) for b, good in sorted(zip(map(bytes, found["features"]), found["label"] == 1, strict=True))]
    return learn(tables, rules)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _judge(field: Field, rules: Rules):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in chunks(batch.column("text")):
                base, owner, words, features = measure(buf, offsets)
                scores = features @ field.emit
                bounds = np.searchsorted(owner, np.arange(end - first + 1))
                content = np.zeros(end - first)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if a < b:
                        good = np.array(viterbi(scores[a:b], field.move)) == CONTENT
                        content[i] = words[a:b][good].sum() / base["n_words"][i]
                failed = (base["n_words"] < rules.least_words) | (100 * base["n_repeat_words"] > rules.most_repeated_percent * base["n_words"])
                columns = [batch.column("doc_id").slice(first, end - first), *[pa.array(base[x].astype(np.int64)) for x in names], pa.array(failed), pa.array(content), pa.array(~failed & (content >= rules.content))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])

    return run


def judge(docs: DataFrame, field: Field, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """doc_id, the base counts, base_failed, content_share and kept per row of ``docs``.

    A null text is an empty one: it has no words and fails. Only doc_id and text are read, each row by itself, so repeated rows are
    judged alike; empty input gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judge(field, rules), COLUMNS)
