"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Names, numbers and units become typed placeholders, so that a question asked again with other values has the same template. A name is
a run of capitalised words, of whatever number; of a benchmark item's words that open a sentence, and may be names or not, both
readings are kept. Windows of ``window`` template words are hashed and joined with those of the benchmark. A document holds an item
if enough of the item's windows stand in one alignment, and what it has in the item's slots is consistent with it both ways: one value
for each value. Only the hashes of a document's windows are made for all documents; the words in slots are read where a join hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import release, write_table

# Private-use characters, which no letter or number class holds: the placeholders, and what holds a name's words, and a number and its unit, together.
NAME, NUMBER, UNIT, JOIN, HOLD = "\ue001", "\ue002", "\ue003", "\ue006", "\ue007"
SLOT = f"[{NAME}{NUMBER}{UNIT}]"
UNITS = (
    "km|kilometers?|kilometres?|meters?|metres?|m|cm|centimeters?|mm|miles?|mi|feet|foot|ft|inches|inch|yards?|kg|kilograms?|grams?|g|mg|pounds?|lbs?|ounces?|oz|tons?|tonnes?|liters?|litres?|l|ml|gallons?"
    "|seconds?|sec|s|minutes?|min|hours?|hrs?|h|days?|weeks?|months?|years?|dollars?|usd|cents?|euros?|eur|mph|kmh|degrees?|watts?|kw|volts?|percent|%"
)
#: Numbers in words; "one" is left out, being a pronoun as often as not.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    " thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
SPACE = r"[\s\p{Z}]+"
_CAPITALISED = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}{HOLD}]\p{{Lu}})" + r"['’\p{Lu}]*\p{Ll}[\p{L}\p{M}'’]*"
# Repeated groups are possessive: Java matches others by recursion, a frame a repetition, and long lists overflow the stack. Nothing
# that may follow a number or name can begin inside it, so they match the same. A number starts at its first figure only, or a list
# without a unit would be read again from each of its figures.
_NUMBER = r"(?<!\p{N})(?<!\p{N}[.,:/])\p{N}++(?:[.,:/]\p{N}++)*+"
_UNIT = rf"(?:{UNITS})(?![\p{{L}}\p{{N}}])"


@dataclass(frozen=True)
class Rules:
    """``coverage``: share of an item's windows that a document must hold; ``consistent``: share of the item's slot values,
    and of the document's, that must stand for one value each; ``said``: words of a window that must not be slots. The hashes of benchmarks
    of up to ``broadcast_windows`` windows (8 bytes each) are broadcast, larger ones joined by shuffle."""

    window: int = 5
    coverage: float = 0.6
    consistent: float = 0.8
    said: int = 2
    broadcast_windows: int = 1_000_000


def _stripped(marked: Column) -> Column:
    return F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{M}}{NAME}{NUMBER}{UNIT}\s\p{{Z}}]+", "")


def _words(stripped: Column) -> Column:
    """Its words; an empty first one where it begins with white space."""
    return F.split(stripped, SPACE)


def _number_words(word: Column) -> Column:
    return F.when(word.isin(NUMBER_WORDS), NUMBER).otherwise(word)


def template(text: Column) -> Column:
    """The template words of a text."""
    units = F.regexp_replace(text, rf"(?i){_NUMBER}[ ]?{_UNIT}", NUMBER + UNIT)
    named = F.regexp_replace(units, rf"{_CAPITALISED}(?:{SPACE}{_CAPITALISED})*+", NAME)
    stripped = _stripped(F.regexp_replace(named, _NUMBER, NUMBER))
    return F.filter(_words(stripped), lambda w: w != "")


def tokens(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys``, pos, word (of the template, as ``template`` has it), raw (what stands there) of each word of each text, and whether
    it may open a sentence."""
    held = F.regexp_replace(F.col("text"), rf"(?i)({_NUMBER})[ ](?={_UNIT})", f"$1{HOLD}")
    held = F.regexp_replace(held, rf"({_CAPITALISED}){SPACE}(?={_CAPITALISED})", f"$1{JOIN}")
    marked = F.regexp_replace(F.col("held"), rf"(?i){_NUMBER}{HOLD}?{_UNIT}", NUMBER + UNIT)
    marked = F.regexp_replace(marked, rf"{_CAPITALISED}(?:{JOIN}{_CAPITALISED})*+", NAME)
    marked = F.regexp_replace(marked, _NUMBER, NUMBER)
    both = texts.select(*keys, held.alias("held")).select(*keys, "held", marked.alias("marked"))
    zipped = F.arrays_zip(F.split("held", SPACE).alias("raw"), F.split("marked", SPACE).alias("marked"))
    both = both.select(*keys, zipped.alias("z")).select(*keys, F.transform("z", lambda p, i: F.struct(_stripped(p["marked"]).alias("word"), p["raw"].alias("raw"), F.coalesce(F.get("z", i - 1)["raw"], F.lit("")).alias("before"))).alias("z"))
    found = both.select(*keys, F.posexplode(F.filter("z", lambda p: p["word"] != "")).alias("pos", "p"))
    opens = (F.col("p.before") == "") | F.col("p.before").rlike(r"[.!?:\"'”’»)]$") | F.col("p.raw").rlike(r"^[\"'“‘«(\[{]")
    return found.select(*keys, "pos", _number_words(F.col("p.word")).alias("word"), F.translate("p.raw", JOIN + HOLD, "  ").alias("raw"), opens.alias("opens"))


def _clean(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")


def window_hashes(texts: DataFrame, width: int, *keys: str) -> DataFrame:
    """``keys``, at (0-based), hash of each window of each text. Words are hashed once, windows from their words' hashes."""
    hashed = texts.select(*keys, F.transform(template(F.col("text")), lambda w: F.xxhash64(_number_words(w))).alias("h"))
    starts = F.when(F.size("h") >= width, F.sequence(F.lit(0), F.size("h") - width)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(width)]))
    return hashed.select(*keys, F.posexplode(windows).alias("at", "hash"))


def _literal(text: Column) -> Column:
    """A text word for word: lower-cased, without signs, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\s\p{Z}]+", ""), SPACE, " "))


def _item_windows(items: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(variant, at, hash) of the windows that say something, under both readings; (variant, pos, word, ours, opens) of the words.

    The benchmark's own windows are gathered by window functions over a variant, that is over one item's text."""
    words = tokens(items, "variant").withColumn("plain", F.when(F.col("opens") & (F.col("word") == NAME) & ~F.col("raw").contains(" "), _stripped(F.col("raw"))).otherwise(F.col("word")))
    ahead = Window.partitionBy("variant").orderBy("pos").rowsBetween(0, rules.window - 1)
    full = F.count(F.lit(1)).over(ahead) == rules.window
    said = F.sum((~F.col("word").rlike(SLOT)).cast("int")).over(ahead)
    hashes = lambda c: F.xxhash64(*[F.lead(F.xxhash64(c), j).over(Window.partitionBy("variant").orderBy("pos")) for j in range(rules.window)])
    made = words.withColumns({"full": full, "said": said, "named": hashes("word"), "read": hashes("plain")}).where(F.col("full") & (F.col("said") >= rules.said))
    found = made.select("variant", F.col("pos").alias("at"), F.explode(F.array_distinct(F.array("named", "read"))).alias("hash"))
    return found, words.select("variant", "pos", "word", _clean(F.col("raw")).alias("ours"), "opens")


def contamination(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per pair of a document and a benchmark item that it covers: doc_id, item_id, coverage, n_slots, consistent,
    contaminated.

    Items that have no window with ``rules.said`` words beside slots (short ones, or all numbers) are found where they are a whole
    line of a document, word for word. Null and empty texts, and rows without doc_id or item_id, are in no pair. Each text of rows
    that share an id is read by itself, and the best counts. Other columns are ignored; empty tables give no rows."""
    kind = benchmark.schema["item_id"].dataType
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).where("trim(text) <> ''").distinct()
    items = write_table(items.withColumn("variant", F.xxhash64(F.col("item_id").cast("string"), "text")), "items")
    windows, words = _item_windows(items, rules)
    windows, words = write_table(windows, "bench"), write_table(words, "words")
    totals = windows.groupBy("variant").agg(F.countDistinct("at").alias("n_windows"))
    hashes = windows.select("hash").distinct()
    hashes = F.broadcast(hashes) if windows.count() <= rules.broadcast_windows else hashes.hint("merge")

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("part", F.xxhash64("text"))
    hits = write_table(window_hashes(keyed, rules.window, "doc_id", "part").join(hashes, "hash", "left_semi").distinct(), "hits")
    # A pair that has the share of an item's n windows has one of any n - share * n + 1 of them: the rarest ones bring the candidates.
    common = windows.groupBy("hash").agg(F.countDistinct("variant").alias("sharing"))
    each = windows.join(common, "hash").groupBy("variant", "at").agg(F.max("sharing").alias("sharing"))
    nth = F.row_number().over(Window.partitionBy("variant").orderBy("sharing", "at"))
    needed = F.col("n_windows") - F.ceil(F.col("n_windows") * rules.coverage - 1e-9) + 1
    anchors = each.withColumn("nth", nth).join(totals, "variant").where(F.col("nth") <= needed).join(windows, ["variant", "at"]).select("variant", "hash").distinct()
    pairs = hits.join(anchors, "hash").select("doc_id", "part", "variant").distinct()
    met = hits.join(pairs, ["doc_id", "part"]).join(windows.withColumnRenamed("at", "item_at"), ["hash", "variant"]).join(totals, "variant")
    # Alignments within half an item's length of each other share one of two rows of buckets, so that a few more or fewer words do
    # no harm, and fragments from all over a long text don't add up.
    span = F.col("n_windows") + rules.window - 1
    bucket = F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda p: F.struct(p.alias("row"), F.floor((F.col("at") - F.col("item_at") + p * span / 2) / span).alias("place")))).alias("bucket")
    met = write_table(met.select("doc_id", "part", "variant", "at", "item_at", "n_windows", bucket), "met")
    cover = met.groupBy("doc_id", "part", "variant", "bucket").agg((F.countDistinct("item_at") / F.max("n_windows")).alias("coverage"))
    best = cover.groupBy("doc_id", "part", "variant").agg(F.max("coverage").alias("coverage"), F.max_by("bucket", F.struct("coverage", "bucket")).alias("bucket"))
    best = write_table(best.where(F.col("coverage") >= rules.coverage - 1e-9), "best")

    # What stands in the slots, in that alignment.
    steps = F.explode(F.sequence(F.lit(0), F.lit(rules.window - 1))).alias("step")
    places = met.join(best, ["doc_id", "part", "variant", "bucket"]).select("doc_id", "part", "variant", "at", "item_at", steps)
    places = places.select("doc_id", "part", "variant", (F.col("at") + F.col("step")).alias("pos"), (F.col("item_at") + F.col("step")).alias("item_pos")).distinct()
    slots = words.where(F.col("word").rlike(SLOT)).withColumnsRenamed({"pos": "item_pos", "word": "kind"})
    places = places.join(slots, ["variant", "item_pos"])
    read = keyed.join(best.select("doc_id", "part").distinct(), ["doc_id", "part"], "left_semi").distinct()
    theirs = tokens(read, "doc_id", "part").select("doc_id", "part", "pos", _clean(F.col("raw")).alias("theirs"))
    values = places.join(theirs, ["doc_id", "part", "pos"]).groupBy("doc_id", "part", "variant", "kind", "ours", "theirs").agg(F.bool_and("opens").alias("opens"))
    pair = ["doc_id", "part", "variant"]
    # A word that only opens sentences and is never changed is no slot.
    once = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*pair, "kind", c)) == 1
    values = values.withColumns({"one": once("ours"), "other": once("theirs")}).where(~(F.col("opens") & (F.col("ours") == F.col("theirs")) & F.col("one")))
    each_way = lambda c, flag: F.struct(F.col(c).alias("value"), F.col("kind"), F.col(flag).alias("one"), F.lit(c).alias("side"))
    sides = values.select(*pair, F.explode(F.array(each_way("ours", "one"), each_way("theirs", "other"))).alias("v")).distinct()
    agreed = sides.groupBy(*pair, "v.side").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v.one").cast("double")).alias("share"))
    agreed = agreed.groupBy(*pair).agg(F.max(F.when(F.col("side") == "ours", F.col("n"))).alias("n_slots"), F.min("share").alias("consistent"))
    found = best.join(agreed, pair, "left").join(items.select("variant", "item_id"), "variant")
    found = found.select("doc_id", "item_id", "coverage", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("consistent", F.lit(1.0)).alias("consistent"))
    found = found.withColumn("contaminated", F.col("consistent") >= rules.consistent)

    # Items without such a window.
    bare = write_table(items.join(totals, "variant", "left_anti").select("item_id", F.xxhash64(_literal(F.col("text"))).alias("line"), _literal(F.col("text")).alias("said")).where("said <> ''").select("item_id", "line").distinct(), "bare")
    if not bare.isEmpty():
        lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.xxhash64(_literal(F.col("line"))).alias("line"))
        whole = lines.join(bare, "line").select("doc_id", "item_id").distinct()
        found = found.union(whole.select("doc_id", "item_id", F.lit(1.0), F.lit(0).cast("long"), F.lit(1.0), F.lit(True)))
    best_of = F.max(F.struct("contaminated", "coverage", "consistent", "n_slots")).alias("b")
    out = write_table(found.groupBy("doc_id", "item_id").agg(best_of), "leaks")
    release(hits, met, best, windows, words, items, bare)
    return out.select("doc_id", F.col("item_id").cast(kind).alias("item_id"), "b.coverage", "b.n_slots", "b.consistent", "b.contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """doc_id, contaminated, items (sorted ids), coverage (the largest, 0 where no item is covered) per row of ``docs``. Nulls, empty
    texts and repeated rows as in ``contamination``; each row of ``docs`` keeps its row."""
    pairs = contamination(docs, benchmark, rules)
    found = pairs.groupBy("doc_id").agg(F.max("contaminated").alias("contaminated"), F.sort_array(F.collect_set(F.when(F.col("contaminated"), F.col("item_id")))).alias("items"), F.max("coverage").alias("coverage"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    none = F.array().cast(found.schema["items"].dataType)
    return out.select("doc_id", F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
