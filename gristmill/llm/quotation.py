"""Quotation linking for chat formatting, in DataFrame functions only.

Leading ``>`` marks give each line its quote level. Quoted passages (runs of lines of one level without an empty line) and their
single lines are normalised and hashed, and joined to the latest earlier message of the conversation that has them as its own. The
message that most of a level's words come from is what it quotes, passages counting double; it must have half of them. Level 1 names
the parent; deeper levels are linked in the same way. Roots and depths are found by pointer doubling, and every message gets its
position in its thread, in which a reply stands after what it answers. No conversation is gathered: threads are numbered in spans of
turns, and ``build_conversations`` renders them in pieces of a bounded number of messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import release, write_table

#: Turns that one window sorts; what comes before them is carried over.
SPAN = 1024
_MARKS = r"^(?:[ \t]*>)+"
_ATTRIBUTION = r"(?i)^[ \t]*(?:on|le|am|el)\b.{1,200}\b(?:wrote|a écrit|schrieb.{0,80}|escribió)[ \t]*:[ \t]*$"


@dataclass(frozen=True)
class Links:
    """``share``: of a level's quoted words, what the quoted message must have; ``sure_words``: a shorter unit that several earlier
    messages have ("Thanks") says nothing."""

    share: float = 0.5
    sure_words: int = 3


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"\s+", " ")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without the lines that announce a quotation."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: (quote_level(x) == 0) & ~(x.rlike(_ATTRIBUTION) & (quote_level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind ("line" or "passage"), key, words, n of each line and each passage of several lines. Windows and
    groups are over one text."""
    one = ["conv_id", "turn", "part"]
    texts = messages.select("conv_id", "turn", "text").distinct().withColumn("part", F.xxhash64("text"))
    lines = texts.select(*one, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(*one, "pos", quote_level(F.col("line")).alias("level"), normalised(F.col("line")).alias("body"))
    blank = (F.col("body") == "") | F.col("body").rlike(_ATTRIBUTION)
    ordered = Window.partitionBy(*one).orderBy("pos")
    lines = lines.withColumn("blank", blank)
    starts = F.lag("blank", 1, True).over(ordered) | (F.lag("level", 1, -1).over(ordered) != F.col("level"))
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(ordered)).where(~F.col("blank"))
    passages = runs.groupBy(*one, "level", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("body"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = runs.select("conv_id", "turn", "level", "body", F.lit("line").alias("kind"), F.lit(1).alias("n")).union(passages.select("conv_id", "turn", "level", "body", F.lit("passage"), "n"))
    words = F.size(F.split("body", r"\s+"))
    return both.select("conv_id", "turn", "level", "kind", F.md5(F.concat_ws(":", "kind", "body").cast("binary")).alias("key"), words.alias("words"), "n")


def quote_links(messages: DataFrame, how: Links = Links()) -> DataFrame:  # noqa: B008
    """conv_id, turn, level, quoted_turn, n_lines: for each quote level of a message, the message that it quotes."""
    units = write_table(_units(messages.where("conv_id is not null and turn is not null")), "units")
    quoted = units.where("level > 0").groupBy("conv_id", "turn", "level", "kind", "key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    unit = ["conv_id", "key"]
    # Own units count only where the conversation quotes them.
    own = units.where("level = 0").join(quoted.select(*unit).distinct(), unit, "left_semi").select(*unit, "turn").distinct()
    both = quoted.select(*unit, "turn", "level", "kind", "words", "n", F.lit(None).cast("long").alias("own")).union(own.select(*unit, "turn", F.lit(0), F.lit(""), F.lit(0), F.lit(0).cast("long"), F.col("turn").alias("own")))
    both = both.withColumn("span", F.floor(F.col("turn") / SPAN))
    carried = both.groupBy(*unit, "span").agg(F.max("own").alias("last_own"), F.count("own").alias("owns"))
    ahead = Window.partitionBy(*unit).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*unit, "span", F.max("last_own").over(ahead).alias("before"), F.coalesce(F.sum("owns").over(ahead), F.lit(0)).alias("owns_before"))
    inside = Window.partitionBy(*unit, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumns({"inside": F.max("own").over(inside), "owns": F.count("own").over(inside)}).where("level > 0").join(carried, [*unit, "span"])
    found = found.select("conv_id", "turn", "level", "kind", "words", "n", F.coalesce("inside", "before").alias("quoted_turn"), (F.col("owns") + F.col("owns_before")).alias("owns"))
    found = found.where(F.col("quoted_turn").isNotNull() & ((F.col("words") >= how.sure_words) | (F.col("owns") == 1)))
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0))
    size = F.col("words") * F.col("n")
    votes = found.groupBy("conv_id", "turn", "level", "quoted_turn").agg(of("line", size).alias("by_line"), of("passage", size).alias("by_passage"), of("line", F.col("n")).alias("n_lines"))
    best = votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct((F.col("by_line") + 2 * F.col("by_passage")).alias("weight"), "quoted_turn", "by_line", "by_passage", "n_lines")).alias("best"))
    total = quoted.where("kind = 'line'").groupBy("conv_id", "turn", "level").agg(F.sum(F.col("words") * F.col("n")).alias("all_words"))
    held = best.join(total, ["conv_id", "turn", "level"]).where(F.greatest("best.by_line", "best.by_passage") >= how.share * F.col("all_words"))
    out = write_table(held.select("conv_id", "turn", "level", F.col("best.quoted_turn").alias("quoted_turn"), F.col("best.n_lines").alias("n_lines")), "links")
    release(units)
    return out


def _roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of each message that has a parent. ``parents``: conv_id, turn, up."""
    # Each round doubles how far up a row has looked; rows stay as small as they are.
    state = write_table(parents.select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")), "roots")
    while not state.where("not done").isEmpty():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = state.join(above, ["conv_id", "up"], "left")
        new = write_table(step.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNull().alias("done")), "roots")
        release(state)
        state = new
    return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def _positions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position (from 0 in its thread, by turn). ``turns``: conv_id, root_turn, turn, each once."""
    spans = turns.withColumn("span", F.floor(F.col("turn") / SPAN))
    sizes = spans.groupBy("conv_id", "root_turn", "span").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id", "root_turn").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "root_turn", "span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "root_turn", "span").orderBy("turn")
    numbered = spans.withColumn("nth", F.row_number().over(inside) - 1).join(sizes, ["conv_id", "root_turn", "span"])
    return numbered.select("conv_id", "turn", (F.col("before") + F.col("nth")).alias("position"))


def link_quotations(messages: DataFrame, how: Links = Links()) -> DataFrame:  # noqa: B008
    """conv_id, turn, role, text (without quotations), parent_turn, root_turn, depth, position, quoted_lines, linked_lines, rendered
    per row of ``messages`` (conv_id, turn, role, text). A conversation in reply order is sorted by (root_turn, position).

    A null text is empty; a null role renders as "user". Rows without conv_id or turn neither quote nor are quoted, and have no
    position. Rows that share conv_id and turn are one message to quote, to be quoted by and to be numbered; each keeps its row. Of
    equally good matches the latest turn counts. Only earlier turns can be quoted, so links have no cycle. Other columns are
    ignored; empty input gives no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quoting = rows.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()
    links = quote_links(rows.join(quoting, "conv_id", "left_semi"), how)
    roots = _roots(links.where("level = 1").select("conv_id", "turn", F.col("quoted_turn").alias("up")))
    linked = links.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("quoted_turn"))).alias("parent_turn"), F.sum("n_lines").alias("linked_lines"))
    turns = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct().join(roots, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
    turns = turns.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    turns = write_table(turns, "turns")
    turns = turns.join(_positions(turns.select("conv_id", "root_turn", "turn")), ["conv_id", "turn"])
    quoted = F.size(F.filter(F.split("text", "\n"), lambda x: (quote_level(x) > 0) & (normalised(x) != ""))).cast("long")
    clean = own_text(F.col("text"))
    out = rows.withColumns({"quoted_lines": quoted, "own": clean}).join(turns, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("position").cast("long").alias("position"), "quoted_lines", F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "own", F.lit("\n")).alias("rendered"),
    )


def build_conversations(linked: DataFrame, most: int = 64) -> DataFrame:
    """conv_id, root_turn, piece, n_messages, text: each thread rendered in reply order, ``most`` messages a piece, so that a thread
    of any length is gathered nowhere. Of rows that share conv_id and turn the one whose rendering sorts first is taken."""
    once = linked.where("position is not null").groupBy("conv_id", "root_turn", "position").agg(F.min("rendered").alias("rendered"))
    pieces = once.groupBy("conv_id", "root_turn", F.floor(F.col("position") / most).alias("piece"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "rendered"))), lambda x: x["rendered"])
    return pieces.agg(F.count(F.lit(1)).alias("n_messages"), F.array_join(ordered, "").alias("text"))
