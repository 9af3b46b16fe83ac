"""Each operator against brute force or an exact round trip on small fixtures, and its edge cases: nulls in any column, empty and
very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import _shared, decontaminate, language_id, near_dup, packing, quality_classifier, quality_rules, quotation, substring_dedup, toxicity, warc
from gristmill.llm._components import connected_components
from gristmill.llm._shared import fold

DOCS = "doc_id long, text string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "rd", "st", "x", "lla", "ve", "", "ng")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward(spark):
    """Rows that every document operator must take: clashing extra columns, nulls, empties, repeats, one long text."""
    rows = [(1, "a b c. d e f", 0.5, "x"), (1, "a b c. d e f", 0.5, "x"), (2, None, None, None), (3, "", 0.1, "y"), (None, "some words here", 0.2, "z"), (4, "  \n\t ", 0.3, ""), (5, prose(1, 20_000), 0.9, "q"), (6, "solo", 0.0, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, carried string")


def empty(spark):
    return awkward(spark).limit(0)


def test_samples_are_bounded_at_any_size(spark):
    for n in (10, 3_000, 3_000_000_000, 10**15):
        limit = _shared.hash_limit(3_000, n)
        assert abs((limit + 2**63) / 2**64 * n - min(n, 3_000)) < 1 and -(2**63) < limit < 2**63
    kept = _shared.bounded_share(spark.range(20_000), F.col("id"), 1_000).count()
    assert 850 < kept < 1_150


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame([*chain, *star, (200, 200), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(edges.limit(0)).count() == 0


def near_brute(rows, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("plan", [near_dup.Plan(3, 85), near_dup.Plan(5, 80)])
def test_near_duplicates_equal_brute_force(spark, plan):
    r = random.Random(plan.shingle)
    rows = [(i, prose(i, r.randint(3, 60))) for i in range(40)]
    base = prose(999, 120).split()
    for i in range(40, 100):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(len(own))] = r.choice(WORDS)
        rows.append((i, " ".join(own).upper() if i % 7 == 0 else " ".join(own)))
    rows += [(200, "One"), (201, "one"), (202, ""), (203, None), (204, rows[3][1])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), plan).collect()}
    assert got == near_brute(rows, plan.shingle, plan.percent)


@pytest.mark.parametrize("plan", [near_dup.Plan(3, 85), near_dup.Plan(5, 80)])
def test_pairs_at_the_threshold_are_missed_with_the_stated_probability(spark, plan):
    def missed(limit):
        """No band with one error at most, or over ``limit`` errors in the values, or more than the distance in all values."""
        p = 1 - plan.percent / 100
        pmf = lambda n: [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        ways = {(0, False): 1.0}
        for _ in range(plan.bands):
            more = Counter()
            for (errors, hit), chance in ways.items():
                for k, q in enumerate(pmf(near_dup.BAND)):
                    more[(errors + k, hit or k < 2)] += chance * q
            ways = more
        extra = pmf(near_dup.EXTRA)
        return sum(c * (1 if not hit or e > limit else sum(extra[max(0, plan.distance + 1 - e) :])) for (e, hit), c in ways.items())

    # _close must take every signature that is within the distance in all values, however these are spread.
    words = plan.wide_words + near_dup.EXTRA // 8
    rows = [(n, [0] * words, [sum(1 << (16 * i) for i in range(4) if 4 * w + i < n) for w in range(plan.wide_words)] + [0] * (words - plan.wide_words)) for n in range(plan.values + 1)]
    table = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    limit = table.where(near_dup._close(F.col("a"), F.col("b"), plan)).agg(F.max("n")).first()[0]
    assert missed(limit) <= plan.miss


def test_near_duplicates_of_awkward_rows(spark):
    got = near_dup.near_duplicates(awkward(spark)).collect()
    assert len(got) == 8 and {x.component_id for x in got if x.doc_id is not None} == {1, 2, 3, 4, 5, 6}
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_substring_dedup_cuts_a_passage_anywhere_in_a_line(spark):
    passage = ". ".join(prose(50 + i, 9).capitalize() for i in range(7)) + "."
    rows = [(1, f"{prose(1, 30)}\n{passage}\n{prose(2, 30)}."), (2, f"{prose(3, 30)} {passage} {prose(4, 30)}."), (3, prose(5, 60)), (4, f"{prose(6, 12)}.\n{prose(6, 12)}.")]
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    text = dict(rows)
    assert got[1].text == text[1] and got[3].text == text[3] and not got[3].spans
    # The first sentence hangs on the words before it; the other six go.
    assert 45 <= got[2].removed_words <= 63 and prose(3, 30) in got[2].text and prose(4, 30) in got[2].text
    assert got[4].text.count(prose(6, 12)) == 1
    for i in (2, 4):
        (span,) = got[i].spans
        assert text[i][: span.start] + text[i][span.end :] == got[i].text


def test_substring_dedup_cuts_short_lines_and_passages_of_them(spark):
    line = "Six words stand in this line"
    verse = "\n".join(prose(70 + i, 3) for i in range(20))
    mixed = "\n".join(prose(90 + i, 6 if i % 2 else 2) for i in range(12))
    two = "One short piece here. Another short piece here."
    parts = [line, verse, mixed, two]
    rows = [(i, "\n".join(x for k, p in enumerate(parts) for x in (prose(1000 * i + k, 30), p)) + f"\n{prose(1000 * i + 9, 30)}\n{verse.split(chr(10))[4]}") for i in (1, 2, 3)]
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1] and not got[1].spans
    for i in (2, 3):
        # A line of under four words that stands alone stays.
        expected = "\n".join([*(prose(1000 * i + k, 30) for k in range(4)), prose(1000 * i + 9, 30), verse.split("\n")[4]])
        assert got[i].text == expected and got[i].removed_words == 6 + 60 + 48 + 8


def test_windows_around_short_lines_cover_any_passage():
    r = random.Random(4)
    for _ in range(200):
        own = [prose(r.random(), r.choice([1, 2, 3, 5, 9, 12])) for _ in range(r.randint(1, 9))]
        if len(" ".join(own).split()) < 10:
            continue
        inside = "\n".join(own)
        owned = {p[2]: False for p in substring_dedup.passages(f"{prose(1, 11)}\n{inside}\n{prose(2, 11)}", substring_dedup.Limits())[1]}
        assert substring_dedup.cut(f"{prose(3, 2)}\n{inside}\n{prose(4, 2)}", owned, substring_dedup.Limits())[0] == f"{prose(3, 2)}\n{prose(4, 2)}"


@pytest.mark.parametrize("limits", [substring_dedup.Limits(), substring_dedup.Limits(1, 1)])
def test_substring_dedup_equals_brute_force(spark, limits):
    """Random lines out of a small pool: each stays in the first document that has it, once. With no least length, sentences too."""
    r = random.Random(17)
    exact = limits.unit_words == 1
    pool = [prose(500 + i, r.randint(1, 12) if exact else r.randint(4, 12)) for i in range(60)]
    if exact:
        pool = [f"{a.capitalize()}. {b}!" if r.random() < 0.4 else a for a, b in zip(pool, pool[1:] + pool[:1], strict=True)]
    rows = [(i, r.choice(["", "\n"]) + "".join(r.choice(pool).upper() + r.choice(["\n", "\n\n", " \n"]) if r.random() < 0.2 else r.choice(pool) + "\n" for _ in range(r.randint(1, 6)))) for i in range(50)]
    seen, expected = set(), {}
    for i, text in rows:
        kept, at = [], 0
        for m in re.finditer(r"[.!?]+[ \t]+|\s*\n\s*|$", text):
            unit = text[at : m.start()] + m.group().rstrip()
            key = " ".join(unit.lower().split())
            if key not in seen or not key:
                kept.append(text[at : m.end()])
            seen.add(key)
            at = m.end()
        expected[i] = "".join(kept)
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS), limits).collect()}
    for i, text in rows:
        rest, at = [], 0
        for s in got[i].spans:
            rest.append(text[at : s.start])
            at = s.end
        assert "".join([*rest, text[at:]]) == got[i].text
        assert got[i].text.split() == expected[i].split(), (i, text, got[i].text, expected[i])


def test_substring_dedup_of_awkward_rows(spark):
    got = substring_dedup.dedup_substrings(awkward(spark)).collect()
    by = [(x.doc_id, x.text) for x in got]
    assert len(got) == 8 and by.count((1, "a b c. d e f")) == 2 and (2, None) in by and (3, "") in by
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_decontamination_sees_changed_values_and_checks_slots(spark):
    bench = spark.createDataFrame([(9, "Yesterday we heard that John Smith had 5 apples and that John Smith ate 3 of the apples", "x"), (8, None, None), (None, "x y z u v w", "")], "item_id long, text string, doc_id string")
    rows = [(1, "Well, yesterday we heard that Mary Jones had 7 apples and that Mary Jones ate 4 of the apples!"), (2, "yesterday we heard that Mary Jones had 7 apples and that Bob Brown ate 4 of the apples"), (3, prose(1, 200)), (4, None), (5, "")]
    got = {x.doc_id: x for x in decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got[1].contaminated and got[1].items == [9]
    assert not got[2].contaminated and not got[3].contaminated and got[3].coverage == 0 and not got[4].contaminated
    assert decontaminate.decontaminate(awkward(spark), bench).count() == 8
    assert decontaminate.decontaminate(awkward(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    # A benchmark beyond the broadcast bound is joined by shuffle, with the same result.
    small = decontaminate.Rules(broadcast_windows=0)
    again = {x.doc_id: x.contaminated for x in decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), bench, small).collect()}
    assert again == {i: x.contaminated for i, x in got.items()}


def test_decontamination_reads_names_numbers_and_alignments(spark):
    bench = [
        ("a", "Tom has 3 apples. Tom buys 5 more. How many does Tom have?"),
        ("b", "The train from Mary O'Brien to McDonald ran 5 km and then Mary O'Brien saw it stop"),
        ("c", "2 + 2 = 4"), ("d", "What now?"), ("e", " ".join(prose(31, 40).split())),
    ]
    far = lambda n: f" {prose(n, 90)} "
    rows = [
        (1, "Ann has 4 apples. Ann buys 7 more. How many does Ann have?"), (2, 'Well: "Ann has 4 apples. Ann buys 7 more. How many does Ann have?"'),
        (3, "Ann has 4 apples. Bob buys 7 more. How many does Eve have?"), (4, "Tom has 3 apples. Tom buys 5 more. How many does Tom have?"),
        (5, "Ann has 4 pears. Ann sold 7 more. How often does Ann run?"),
        # Names of other lengths, a number in digits, a unit without a space.
        (6, f"{prose(7, 20)} the train from Zoe to Ann Mary D'Arc ran 12km and then Zoe saw it stop {prose(8, 20)}"),
        # Two names of the item may not share one of the document.
        (7, f"{prose(7, 20)} the train from Zoe to Zoe ran 12km and then Zoe saw it stop {prose(8, 20)}"),
        (8, f"{prose(9, 5)}\n2 + 2 = 4\n"), (9, "2 + 3 = 5"), (10, "what NOW"), (11, "what now is it"),
        (12, far(3) + bench[4][1] + far(4)),
        # The same windows, but scattered over a long text.
        (13, far(5) + far(6).join(" ".join(bench[4][1].split()[i : i + 8]) for i in range(0, 40, 8)) + far(7)),
    ]
    got = {x.doc_id: x.items for x in decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id string, text string")).collect()}
    assert got == {1: ["a"], 2: ["a"], 3: [], 4: ["a"], 5: [], 6: ["b"], 7: [], 8: ["c"], 9: [], 10: ["d"], 11: [], 12: ["e"], 13: []}


TEMPLATE_TEXTS = [
    "Tom has 3 apples. Tom buys 5 km more. How many does Mary Ann O'Brien have?", "  lead \n\nMcDonald's ran 5km, 7 % of iPhone USA NASA Usa  two  Three", "", "a b \u2014 c",
    'John\nSmith went (Home) 12:30 3.5kg "Well Done"', "\u00e9 \u00df \u00c9b\u00e8ne \u00c9COLE x1y 5-year-old", "one two  twenty-two 3 Miles", ". . .",
]


def template_brute(text):
    """The template words by plain Python: (word, kind of slot) in order."""
    import regex

    cap = r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})['\u2019\p{Lu}]*\p{Ll}[\p{L}\p{M}'\u2019]*"
    gap = r"[\s\p{Z}]+"
    text = regex.sub(rf"(?i)\p{{N}}+(?:[.,:/]\p{{N}}+)*[ ]?(?:{decontaminate.UNITS})(?![\p{{L}}\p{{N}}])", decontaminate.NUMBER + decontaminate.UNIT, text)
    text = regex.sub(rf"{cap}(?:{gap}{cap})*", decontaminate.NAME, text)
    text = regex.sub(r"\p{N}+(?:[.,:/]\p{N}+)*", decontaminate.NUMBER, text)
    words = regex.split(gap, text.lower())
    words = [regex.sub(rf"[^\p{{L}}\p{{M}}{decontaminate.NAME}{decontaminate.NUMBER}{decontaminate.UNIT}]+", "", w) for w in words]
    return [decontaminate.NUMBER if w in decontaminate.NUMBER_WORDS else w for w in words if w]


def test_templates_equal_brute_force_and_keep_their_words_places(spark):
    r = random.Random(12)
    bits = ["Tom", "Ann", "O'Brien", "has", "5", "km", "3.5kg", "two", "The", "apples.", "\u2014", "\n", '"Well', "NASA", "1,000", "x"]
    texts = TEMPLATE_TEXTS + [r.choice([" ", "  ", "\n"]).join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    fast = {x.k: x.w for x in df.select("k", F.transform(decontaminate.template(F.col("text")), decontaminate._number_words).alias("w")).collect()}
    slow = {}
    for x in decontaminate.tokens(df, "k").orderBy("k", "pos").collect():
        slow.setdefault(x.k, []).append(x.word)
    for k, t in enumerate(texts):
        assert fast[k] == slow.get(k, []) == template_brute(t), t


def test_long_lists_of_numbers_and_names_are_read_to_their_end(spark):
    """Java's stack would hold a frame for each repetition of a group, and overflow."""
    texts = {1: "1," * 100_000 + "1", 2: "1." * 100_000 + "5 km", 3: "Ann " * 100_000 + "ran", 4: "7" * 100_000}
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    both = {1: [decontaminate.NUMBER], 2: [decontaminate.NUMBER + decontaminate.UNIT], 3: [decontaminate.NAME, "ran"], 4: [decontaminate.NUMBER]}
    assert {x.k: x.w for x in df.select("k", decontaminate.template(F.col("text")).alias("w")).collect()} == both
    found = {}
    for x in decontaminate.tokens(df, "k").orderBy("k", "pos").collect():
        found.setdefault(x.k, []).append(x.word)
    assert found == both


def test_decontamination_equals_brute_force(spark):
    """Copies of items with words changed at random: covered as an enumeration of all alignments says."""
    r = random.Random(21)
    rules = decontaminate.Rules()
    bench = [(i, prose(300 + i, r.randint(8, 30))) for i in range(12)]
    rows = []
    for d in range(90):
        own = r.choice(bench)[1].split()
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = r.choice(WORDS)
        rows.append((d, " ".join([prose(d, 20), *own, prose(d + 99, 20)])))
    width, expected = rules.window, set()
    for d, t in rows:
        words = t.split()
        at = {}
        for k in range(len(words) - width + 1):
            at.setdefault(tuple(words[k : k + width]), []).append(k)
        for i, text in bench:
            own = text.split()
            n, span = len(own) - width + 1, len(own)
            for p in (0, 1):
                places = {}
                for k in range(n):
                    for a in at.get(tuple(own[k : k + width]), []):
                        places.setdefault(math.floor((a - k + p * span / 2) / span), set()).add(k)
                if any(len(x) >= rules.coverage * n - 1e-9 for x in places.values()):
                    expected.add((d, i))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == expected and len(got) > 20


def test_language_id_held_out(spark):
    r = random.Random(3)
    words = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "über", "schön"], "fr": ["le", "être", "où", "ça"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == k and 0 <= got[i][1] <= 1 for i, _, k in rows)
    odd = language_id.predict(awkward(spark), model).collect()
    assert len(odd) == 8 and {x.lang_pred for x in odd if x.doc_id in (2, 3, 4)} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {x.lang_pred for x in language_id.predict(docs, nothing).collect()} == {"und"}


def labelled(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        w = [r.choice(WORDS) for _ in range(40)]
        rows.append((i, " ".join(f"{x}%%%" if bad else x for x in w) if i % 2 else " ".join(x.upper() + "!!" if bad else x for x in w), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_quality_classifier_held_out(spark):
    docs = labelled(spark)
    seen = docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "label")
    model = quality_classifier.fit(docs.select("doc_id", "text"), seen)
    got = quality_classifier.score(docs, model).join(docs.select("doc_id", "label"), "doc_id").where(fold(F.col("doc_id"), 4) == 2).collect()
    assert got and sum((x.score >= 0.7) == (x.label == 1) for x in got) / len(got) > 0.95
    odd = quality_classifier.score(awkward(spark), model).collect()
    assert len(odd) == 8 and all(0 <= x.score <= 1 for x in odd)
    assert quality_classifier.score(empty(spark), model).count() == 0
    assert {x.score for x in quality_classifier.score(docs.limit(3), quality_classifier.fit(docs, seen.limit(0))).collect()} == {0.4995 + 0.001 / (1 + np.exp(2))}


def test_isotonic_pools_violators():
    raw, share = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert share.tolist() == [0.0, 0.5, 1.0] and raw.tolist() == [1.0, 2.5, 4.0]


def test_quality_rules_base_counts_equal_brute_force(spark):
    rows = [(1, "a b c a b c x"), (2, "l one\n\nl one\nl two \n l two"), (3, "é ß # | x"), (4, None), (5, ""), (6, "\n\n"), (7, " ".join(["word"] * 60)), (8, prose(3, 80))]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(8, 1), (7, 0), (3, None), (None, 1)], "doc_id long, label int")
    field = quality_rules.fit(docs, marks)
    got = {x.doc_id: x for x in quality_rules.judge(docs, field).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == expected
        assert x.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (x.base_failed and x.kept)
    assert got[8].kept
    assert quality_rules.judge(awkward(spark), quality_rules.fit(awkward(spark), marks)).count() == 8
    assert quality_rules.judge(empty(spark), quality_rules.fit(empty(spark), marks.limit(0))).count() == 0


def mixed_lines(seed, kinds):
    """Lines of prose, and junk lines whose signals are each too weak for a plain threshold: some signs, some capitals, some digits."""
    r = random.Random(seed)
    out = []
    for junk in kinds:
        words = [r.choice(WORDS) for _ in range(r.randint(9, 14))]
        if junk:
            words = [w.upper() if r.random() < 0.45 else w + r.choice("#%|") if r.random() < 0.25 else w + r.choice("!7") if r.random() < 0.4 else w for w in words]
        out.append(" ".join(words))
    return "\n".join(out)


def thresholds(features):
    """Plain rules on the same features, for comparison."""
    f = dict(zip(quality_rules.FEATURES, features.T, strict=True))
    return (f["symbols"] > 0.25) | (f["upper"] > 0.7) | (f["bangs"] > 0.5) | (f["echoes"] > 0.4) | (f["again"] > 0) | (f["notice"] > 0)


def test_quality_verdict_equals_enumeration_and_beats_thresholds(spark):
    r = random.Random(41)
    rows = []
    for i in range(160):
        bad = i % 2 == 1
        rows.append((i, mixed_lines(i, [r.random() < (0.8 if bad else 0.05) for _ in range(r.randint(8, 14))]), int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    field = quality_rules.fit(docs, docs.where("doc_id < 100").select("doc_id", "label"))
    got = {x.doc_id: x for x in quality_rules.judge(docs, field).collect()}
    right = plain = 0
    for i, text, label in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, words, features = quality_rules.measure(data, np.array([0, len(data)]))
        scores = features @ field.emit
        best, many = None, len(scores)
        # Every labelling of up to 14 lines.
        labelling = (np.arange(2**many)[:, None] >> np.arange(many)) & 1
        value = scores[np.arange(many), labelling].sum(axis=1) + field.move[labelling[:, :-1], labelling[:, 1:]].sum(axis=1)
        best = labelling[value.argmax()]
        share = words[best == quality_rules.CONTENT].sum() / words.sum()
        assert abs(share - got[i].content_share) < 1e-9 and got[i].kept == (not got[i].base_failed and share >= 0.5)
        if i >= 100:
            right += got[i].kept == (label == 1)
            plain += (words[~thresholds(features)].sum() / words.sum() >= 0.5) == (label == 1)
    assert right >= 0.95 * 60 and right - plain >= 10, (right, plain)


def test_long_texts_teach_to_their_last_line(spark):
    """The junk of the bad documents stands after hundreds of good lines."""
    rows = [(i, mixed_lines(i, [False] * 420 + [i % 2 == 1] * 400), (i + 1) % 2) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    field = quality_rules.fit(docs, docs.select("doc_id", "label"), quality_rules.Rules(rounds=3))
    junk = spark.createDataFrame([(1, mixed_lines(99, [True] * 40)), (2, mixed_lines(98, [False] * 40))], DOCS)
    share = {x.doc_id: x.content_share for x in quality_rules.judge(junk, field).collect()}
    assert share[1] < 0.5 < share[2]


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores, move = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(2**n)]
        value = lambda p: sum(scores[t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1))  # noqa: E731, B023
        assert quality_rules.viterbi(scores, move) == max(paths, key=value)


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    for t in ["", "a b", "It's 12 ...!  'll", "x\x1cy", "é ́", "İI ß ﬁ Ǆ µ ª", "<|endoftext|> a<b", "日本 語 😀", "ΣΣ AΣ", "a\x0bb\x85c　d", "ÀÉÎ ſtraße __a-b__ ~~~", prose(1, 300)]:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_other_tokenizers_take_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    assert packing._by_words(Tokenizer.from_file(TOKENIZER))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    whole, encode = Tokenizer.from_file(str(tmp_path / "t.json")), packing.encoder(str(tmp_path / "t.json"))
    assert not packing._by_words(whole)
    for t in ["", "A b  C", "It's 12\n...!"]:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_ranks_a_hot_length_in_many_lots(spark):
    rows = [(None, "a b")] * 300 + [(7, prose(1, 30))] * 100
    got = packing.pack(spark.createDataFrame(rows, DOCS), packing.Packing(TOKENIZER, capacity=64, lot=16)).toPandas()
    assert len(got) >= 400
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64


def test_packing_is_gapless_and_near_the_bound(spark):
    rows = [(i, prose(i, random.Random(i).randint(0, 1500))) for i in range(120)] + [(500, None), (501, ""), (501, ""), (None, "x"), (502, prose(9, 6000))]
    how = packing.Packing(TOKENIZER)
    got = packing.pack(spark.createDataFrame(rows, DOCS), how).toPandas()
    encode = packing.encoder(TOKENIZER)
    expected = Counter()
    for i, t in rows:
        data = encode(t or "") + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(data), 8192)):
            expected[(i, k, at // 4, len(data[at : at + 8192]) // 4, zlib.crc32(data[at : at + 8192]))] += 1
    assert Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()) == expected
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2
    assert packing.pack(empty(spark), how).count() == 0


def test_solver_holds_the_histogram():
    histogram = {2048: 3, 1500: 7, 700: 9, 548: 5, 31: 40, 1: 2}
    plan = packing.solve(histogram, packing.Packing(""))
    held = Counter()
    for pattern, times in plan:
        assert sum(a * n for a, n in pattern) <= 2048
        for a, n in pattern:
            held[a] += n * times
    assert held == histogram and packing.solve({}, packing.Packing("")) == []


def test_configurations_hold_nearly_all_of_many_lengths():
    r = random.Random(6)
    how = packing.Packing("")
    for n, share in ((10_000, 0.95), (60_000, 0.99)):
        histogram = Counter(int(r.lognormvariate(5.6, 1.2)) % 2047 + 1 for _ in range(n))
        full, left, rest = packing.configurations(histogram, how)
        held = Counter()
        for pattern, times in (full + rest).items():
            held.update({a: k * times for a, k in pattern})
        assert held == histogram and all(sum(a * k for a, k in p) == 2048 for p in full)
        assert sum(full.values()) * 2048 >= share * sum(a * k for a, k in histogram.items())
    # Nothing fills a sequence: the covering goes on with what is left empty.
    full, left, rest = packing.configurations({1500: 4, 500: 3, 900: 5}, how)
    assert not full and left == {1500: 4, 500: 3, 900: 5} and rest.total() == 4 + 3
    assert sum(n for _, n in packing.solve({1500: 4, 500: 3, 900: 5}, how)) == 7


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u\r\nX: y", "WARC/1.0\r\n\r\nWARC"), (5, "u", ""), (None, "n", "same"), (6, "u", "ä" * 70_000), (7, "u", "tw"), (7, "u", "tw")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {(x.page_id, x.record_type): x for x in got}
    assert by[(1, "revisit")].refers_to == 2 and by[(3, "revisit")].refers_to == 5 and (2, "response") in by and (5, "response") in by
    assert bytes(by[(4, "response")].payload) == b"WARC/1.0\r\n\r\nWARC" and bytes(by[(6, "response")].payload).decode() == "ä" * 70_000
    assert by[(6, "response")].payload_bytes == 140_000 and sum(x.page_id == 7 and x.record_type == "response" for x in got) == 2
    assert warc.archive_round_trip(pages, warc.Archive(min_revisit_bytes=5)).where("record_type = 'revisit'").count() == 0
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    # Small archives hold the same records.
    path = f"{_shared.shared_dir(spark)}/small-archives"
    warc.write_archives(pages.coalesce(1), path, warc.Archive(archive_bytes=40_000))
    assert spark.read.format("binaryFile").load(path).count() > 3
    assert sorted(map(repr, warc.read_archives(spark, path).drop("payload").collect())) == sorted(map(repr, warc.archive_round_trip(pages).drop("payload").collect()))


def test_warc_parser_takes_members_and_checks_lengths():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse_records(record[:-5]))


def test_toxicity_held_out(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(30)]
        if i % 5 == 0:
            w[3], w[9] = "Moron,", "clown"
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(docs, docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "label"))
    got = toxicity.score(docs, model).join(docs.select("doc_id", "label"), "doc_id").where(fold(F.col("doc_id"), 5) == 0).collect()
    assert got and all((x.score >= 0.5) == (x.label == 1) for x in got)
    odd = toxicity.score_rows(awkward(spark), model).collect()
    assert len(odd) == 8 and all(0 <= x.score <= 1 for x in odd) and odd[0].carried.carried is not None
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "label").limit(0))).count() == 400


def test_pairs_count_beyond_their_terms(spark):
    """Neither word alone is toxic, only both together: additive weights can't tell."""
    rows = []
    for i in range(600):
        r = random.Random(i)
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append((i, " ".join(["insultword"] * a + ["groupword"] * b + [r.choice(WORDS[:6])]), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    scored = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "label"))).join(docs.select("doc_id", "label"), "doc_id").collect()
    assert all((x.score >= 0.5) == (x.label == 1) for x in scored)


MESSAGES = "conv_id long, turn long, role string, text string"


def test_quotations_are_linked_in_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there friend\nHow are you?"), (1, 1, "assistant", "On Monday X wrote:\n> hello  there friend\nI am fine"),
        (1, 2, "user", "> On Monday X wrote:\n>> Hello there friend\n> I am fine\nGreat"), (1, 3, "user", "> hello there friend\nLate answer"), (1, 4, "user", "> unknown\nhm"),
        (2, 0, "user", None), (None, 1, None, "> x"), (3, 0, None, ""), (3, 0, None, ""), (3, None, "user", "z"),
    ]
    messages = spark.createDataFrame([(*r, 1) for r in rows], f"{MESSAGES}, depth int")
    linked = quotation.link_quotations(messages)
    got = {(x.conv_id, x.turn): x for x in linked.collect()}
    assert linked.count() == len(rows)
    parents = {0: None, 1: 0, 2: 1, 3: 0, 4: None}
    assert {t: got[(1, t)].parent_turn for t in parents} == parents
    assert [(got[(1, t)].root_turn, got[(1, t)].depth, got[(1, t)].position) for t in range(5)] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 1, 3), (4, 0, 0)]
    assert got[(1, 2)].text == "Great" and got[(1, 1)].text == "I am fine" and got[(1, 2)].quoted_lines == 3 and got[(1, 2)].linked_lines == 2
    assert got[(None, 1)].position is None and got[(3, None)].position is None
    texts = {(x.conv_id, x.root_turn, x.piece): (x.n_messages, x.text) for x in quotation.build_conversations(linked, 2).collect()}
    assert texts[(1, 0, 0)] == (2, "<|user|>\nHello there friend\nHow are you?\n<|assistant|>\nI am fine\n") and texts[(1, 0, 1)][1] == "<|user|>\nGreat\n<|user|>\nLate answer\n"
    assert texts[(3, 0, 0)] == (1, "<|user|>\n\n")
    assert quotation.link_quotations(messages.limit(0)).count() == 0 and quotation.build_conversations(linked.limit(0)).count() == 0


def test_common_lines_link_nothing_by_chance(spark):
    rows = [
        (1, 0, "user", "The budget is forty euros a month\nThanks"), (1, 1, "user", "Another matter for the week\nThanks"), (1, 2, "user", "> Thanks\nfor what?"),
        (1, 3, "user", "> The budget is forty euros a month\n> Thanks\nToo much"), (1, 4, "user", "> Thanks\n> these other words are nobody's at all\nhm"), (2, 0, "user", "Thanks"), (2, 1, "user", "> Thanks\nwelcome"),
    ]
    got = {(x.conv_id, x.turn): x.parent_turn for x in quotation.link_quotations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): None, (1, 3): 0, (1, 4): None, (2, 0): None, (2, 1): 0}


def links_brute(messages, how):
    """(turn, level) -> quoted turn of one conversation's {turn: text}, message by message."""
    def units(text):
        out, run, last = [], [], None
        for line in [*text.split("\n"), None]:
            level = None if line is None else re.match(r"(?:[ \t]*>)*", line).group().count(">")
            body = "" if line is None else " ".join(re.sub(r"^(?:[ \t]*>)+", "", line).split()).lower()
            if run and (line is None or not body or level != last):
                out += [(last, "line", x) for x in run] + ([(last, "passage", "\n".join(run))] if len(run) > 1 else [])
                run = []
            if body:
                run.append(body)
            last = level
        return out

    own = {t: {(k, b) for level, k, b in units(x) if level == 0} for t, x in messages.items()}
    links = {}
    for turn, text in messages.items():
        for level in {u[0] for u in units(text)} - {0}:
            votes, total = {}, 0
            for _, kind, body in [u for u in units(text) if u[0] == level]:
                words = len(body.split())
                total += words if kind == "line" else 0
                having = [t for t in messages if t < turn and (kind, body) in own[t]]
                if having and (words >= how.sure_words or len(having) == 1):
                    votes.setdefault(max(having), Counter())[kind] += words
            if votes:
                best = max(votes, key=lambda t: (votes[t]["line"] + 2 * votes[t]["passage"], t))
                if max(votes[best].values()) >= how.share * total:
                    links[(turn, level)] = best
    return links


def test_quotations_equal_brute_force(spark):
    """Threads in which messages quote earlier ones, in whole or in part, over several levels, with stray and common lines."""
    rows, texts = [], {}
    for conv in range(12):
        r, messages = random.Random(conv), {}
        for turn in range(0, 3000, 100) if conv == 0 else range(14):
            own = [prose(r.random(), r.randint(1, 7)) for _ in range(r.randint(1, 3))] + ["ok thanks"] * (r.random() < 0.3)
            quoted = []
            if messages and r.random() < 0.8:
                source = messages[r.choice(list(messages))].split("\n")
                kept = source if r.random() < 0.6 else [x for x in source if r.random() < 0.6]
                quoted = [("> " if not x.startswith(">") else ">") + x.replace(" ", "  ", 1) for x in kept] + ["> " + prose(r.random(), 4)] * (r.random() < 0.2)
            body = [*quoted, *([""] if r.random() < 0.3 else []), *own]
            messages[turn] = "\n".join(body)
            rows.append((conv, turn, "user", messages[turn]))
        texts[conv] = messages
    how = quotation.Links()
    expected = {(c, t, level): q for c, m in texts.items() for (t, level), q in links_brute(m, how).items()}
    got = {(x.conv_id, x.turn, x.level): x.quoted_turn for x in quotation.quote_links(spark.createDataFrame(rows, MESSAGES), how).collect()}
    assert got == expected and len(got) > 80 and max(k[2] for k in got) > 1
    out = {(x.conv_id, x.turn): x for x in quotation.link_quotations(spark.createDataFrame(rows, MESSAGES)).collect()}
    for (conv, turn), x in out.items():
        up, depth = turn, 0
        while (conv, up, 1) in expected:
            up, depth = expected[(conv, up, 1)], depth + 1
        assert (x.root_turn, x.depth) == (up, depth)
    for conv in texts:
        for root in {x.root_turn for k, x in out.items() if k[0] == conv}:
            thread = sorted(t for (c, t), x in out.items() if c == conv and x.root_turn == root)
            assert [out[(conv, t)].position for t in thread] == list(range(len(thread)))


def test_long_reply_chains_end(spark):
    rows = [(1, 0, "user", "this is line 0")] + [(1, i, "user", f"> this is line {i - 1}\nthis is line {i}") for i in range(1, 40)]
    got = {x.turn: x for x in quotation.link_quotations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert all((got[i].root_turn, got[i].depth, got[i].position) == (0, i, i) for i in range(40))


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_table(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[2] < counts[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns with names that operators use themselves."""
    copy = prose(7, 60)
    rows = [
        (1, copy, "en", "a", 1, 0.5, "x"), (2, copy, None, None, None, None, None), (2, "another text " + prose(8, 40), "de", "b", 3, 0.1, "y"), (2, "another text " + prose(8, 40), "de", "b", 3, 0.1, "y"),
        (3, None, "en", "a", 0, 0.2, "z"), (4, "", "en", "a", 0, 0.2, "z"), (None, copy, "en", "a", 5, 0.3, "n"), (None, None, None, None, None, None, None), (5, prose(9, 20_000), "en", "c", 7, 0.9, "l"), (6, " \n ", "en", "a", 3, 0.0, "w"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, carried string").selectExpr("*", "source as item_id", "n_chars as digest", "lang as component_id", "score as label", "doc_id as node", "text as clean")


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_take_odd_documents(spark, number):
    from tests.conftest import DATA

    docs = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, DATA)
    assert stage(spark, docs.limit(0), DATA).count() == 0
    rows = got.collect()
    if name == "pack":
        assert Counter(r.doc_id for r in rows if r.piece == 0) == {1: 1, 2: 3, 3: 1, 4: 1, None: 2, 5: 1, 6: 1}
        return
    assert got.columns == docs.columns
    ids = Counter(r.doc_id for r in rows)
    if name == "near_dup":
        # The row of 2 whose text sorts first; 1 and 2 are no copies as wholes, and the rows without an id all stay.
        assert ids[None] == 2 and set(ids) >= {1, 3, 4, 5, 6} and all(ids[i] == 1 for i in ids if i is not None)
        assert [r.text for r in rows if r.doc_id == 2] in ([], [r.text for r in docs.collect() if r.doc_id == 2 and r.text.startswith("another")][:1])
    else:
        assert ids[None] == 2 and {r.text for r in rows if r.doc_id in (3, 4)} == {None, ""}


def test_gram_masks_equal_a_recount(spark):
    """The model's predictions against plain sets of character n-grams, counted anew from the words."""
    r = random.Random(33)
    words = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "über", "schön", "ding"], "fr": ["le", "être", "où", "ça", "autre"]}
    rows = [(i, " ".join(r.choice(words[k] + words["en"][:1]) for _ in range(r.randint(2, 12))) + r.choice(["", "!", " 12"]), k) for i, k in enumerate(list(words) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    how = language_id.Filters(slots=1 << 22)

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out.update(w)
            padded = f" {w} "
            out.update(padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1) if padded[i : i + n].strip())
        return out

    counts = {k: Counter() for k in words}
    for _, t, k in rows:
        counts[k].update(grams(t))
    total = {k: sum(c.values()) for k, c in counts.items()}
    rate = {k: {g: n / total[k] for g, n in c.items() if n > 1} for k, c in counts.items()}
    mean = Counter()
    for c in rate.values():
        for g, x in c.items():
            mean[g] += x / len(words)
    typical = {k: {g for g, x in c.items() if x >= how.lift * mean[g]} for k, c in rate.items()}
    got = {x.doc_id: x.lang_pred for x in language_id.predict(docs, language_id.fit(docs, how)).collect()}
    for i, t, _ in rows:
        held = {k: sum(n for g, n in grams(t).items() if g in typical[k]) for k in sorted(words)}
        best = max(held.values())
        assert got[i] in [k for k, n in held.items() if n == best], (t, held, got[i])


def test_combining_marks_stay_in_their_words():
    assert language_id._gram_hashes(["e\u0301t"], (4,))[1].tolist() == [2] and language_id._gram_hashes(["\u0301\u0301 1"], (1,))[1].tolist() == [0]


def test_normal_equations_equal_a_direct_solution(spark):
    docs = labelled(spark)
    how = quality_classifier.Kernel(features=24, folds=3, partitions=3)
    model = quality_classifier.fit(docs.select("doc_id", "text"), docs.select("doc_id", "label"), how)
    rows = docs.collect()
    x = np.array([quality_classifier.statistics(r.text) for r in rows])
    z = quality_classifier._fourier((x - model.mean) / model.scale, how)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.weights, np.linalg.solve(z.T @ z + how.ridge * np.eye(25), z.T @ np.array([r.label for r in rows], float)))


def test_factorization_machine_equals_its_formula(spark):
    r = np.random.default_rng(4)
    words = ["moron", "clown", "group", "fine", "day"]
    data = " ".join(words).encode()
    ids = np.unique(toxicity._terms(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 24)[0])
    model = toxicity.Model(ids, -0.3, r.normal(size=len(ids)), r.normal(size=(len(ids), 3)), 24)
    texts = ["moron clown", "Clown, clown day!", "nothing here", "", None, "group moron fine"]
    got = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    for i, t in enumerate(texts):
        own = (t or "").encode()
        terms = sorted(set(toxicity._terms(np.frombuffer(own, np.uint8), np.array([0, len(own)]), 24)[0].tolist()) & set(ids.tolist())) if own else []
        at = [int(np.flatnonzero(ids == x)[0]) for x in terms]
        z = model.bias + sum(model.weights[a] for a in at) + sum(float(model.vectors[a] @ model.vectors[c]) for k, a in enumerate(at) for c in at[k + 1 :])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_warc_digest_is_hashed_once(spark):
    """F op7_warc: each letter of a digest named its hash anew, which took 460 CPU seconds a GB."""
    texts = ["", "x", "äö", *(f"page {i}" for i in range(200))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    assert {r.t: r.d for r in rows.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
