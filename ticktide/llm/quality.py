"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a rejecting condition over the text's measures. Before a run, each rule is run over
a small sample of rows, REPEATS times in one job whose time, less that of a job without a rule, is
its cost; a first round warms the code up. The share of the sample that it rejects is its
selectivity, and rules are then tried in order of rejections per second. A rejected text doesn't
reach the next rule: the cascade is a CASE expression, whose later branches aren't evaluated. The
order changes the cost, never the verdict, since a text is kept only if no rule rejects it. The
words, which all rules need, are split once a text.

Measures (words are runs outside `[\\x20\\x09-\\x0D]`; lengths in code points):
n_words, word_chars, n_symbols (characters of `[#*$%&|<>]`), n_dup_lines (lines with a word that
equal an earlier line), n_repeat_words (words in windows of WINDOW words that occur twice or more,
the first occurrence included; windows are told apart by a 64-bit hash inside a text).

Defined results: a null or empty text has no words and fails the base rules; a very long text is
measured whole; repeated rows get equal verdicts; an empty table gives an empty table; other columns
pass through, but those called as a measure or verdict, in any case, which `measured` replaces.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import WHITE, col, fresh, others, text_or_empty

WINDOW = 8
#: Rows that the cost and selectivity of the rules are estimated on, and the share they are drawn with.
SAMPLE_ROWS, SAMPLE_SHARE = 200, 0.05
#: Times that a rule is run over the sample, to be measured.
REPEATS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once: a one-element array and its transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def n_words(text: Column, words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column, words: Column) -> Column:
    return F.char_length(F.regexp_replace(text, WHITE, "")).cast("long")


def n_symbols(text: Column, words: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column, words: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(text: Column, words: Column) -> Column:
    """Words covered by repeated windows.

    Where the windows' hashes are all distinct there are none. Else equal windows are neighbours
    among the sorted (window, place) pairs; the places of those that have an equal neighbour, in
    order, each add the words up to the next place, WINDOW at most.
    """
    codes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice(c, i, WINDOW)))
    pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        twin = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        )
        return step["n"]

    repeats = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs(h), lambda p: covered(places(p))))
    found = F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(codes, lambda c: let(windows(c), repeats)))
    return found.cast("long")


#: Each takes a text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where `condition` holds; it gets the measures it names, in that order."""

    name: str
    measures: tuple[str, ...]
    condition: Callable[..., Column]


BASE = [
    Rule("too few words", ("n_words",), lambda n: n < 20),
    Rule("repeated windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
]
RULES = [
    *BASE,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 16 * n)),
    Rule("repeated lines", ("n_dup_lines", "n_words"), lambda d, n: (d >= 3) & (25 * d > n)),
]


def ordered(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> list[Rule]:
    """`rules` by rejections per second on a sample; ties and unread rules in the given order."""
    sample = docs.select(text_or_empty(text_col).alias("text")).sample(SAMPLE_SHARE, seed=11).limit(SAMPLE_ROWS)
    texts = sample.select("text", words_of(F.col("text")).alias("words")).cache()
    try:
        total = texts.count()

        def taken(hit: Column, times: int) -> tuple[float, int]:
            many = texts.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(times))))
            began = time.perf_counter()
            found = many.agg(F.sum(F.when(hit, 1).otherwise(0))).first()[0]
            return time.perf_counter() - began, (found or 0) // times

        hits = [rule.condition(*[MEASURES[m](F.col("text"), F.col("words")) for m in rule.measures]) for rule in rules]
        for hit in [F.col("turn") < 0, *hits]:
            taken(hit, 1)
        idle = taken(F.col("turn") < 0, REPEATS)[0]
        rates = []
        for hit in hits:
            seconds, found = taken(hit, REPEATS)
            rates.append(found / max(total, 1) / max(seconds - idle, 1e-4))
    finally:
        texts.unpersist()
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rates[k], k))]


def rejected(measure: Callable[[str], Column], rules: list[Rule]) -> Column:
    """True at the first rule that rejects; later rules are not evaluated."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.condition(*[measure(m) for m in rule.measures]), F.lit(False)), True).otherwise(verdict)
    return verdict


def measured(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with every measure, base_failed and kept (replacing columns of these names)."""
    made = [*MEASURES, "base_failed", "kept"]
    kept, all_ = others(docs, made), fresh(docs, "measures")
    text = text_or_empty(text_col)
    found = let(words_of(text), lambda w: F.struct(*[f(text, w).alias(m) for m, f in MEASURES.items()]))
    cascade = ordered(docs, rules, text_col)
    rows = docs.select(*[col(c) for c in kept], found.alias(all_))
    of = lambda m: F.col(f"{all_}.{m}")
    return rows.select(*[col(c) for c in kept], *[of(m).alias(m) for m in MEASURES], rejected(of, BASE).alias("base_failed"), (~rejected(of, cascade)).alias("kept"))


def quality_filter(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects; a measure is taken only where the cascade gets to it."""
    cascade, text = ordered(docs, rules, text_col), text_or_empty(text_col)
    return docs.filter(~let(words_of(text), lambda w: rejected(lambda m: MEASURES[m](text, w), cascade)))
