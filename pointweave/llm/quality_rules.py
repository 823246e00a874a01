"""Quality rules as a short-circuit cascade, in built-in functions only.

Measures of a text are Spark expressions over its whole words.  A rule is a named condition on the text that rejects.
``order_rules`` times each rule on a sample of about ``SAMPLE_ROWS`` rows and counts what it rejects there; rules then
run by rejections per second, inside one ``CASE`` that stops at the first rule that rejects.  The sample settles only
the order, and so the speed: whether a document is kept does not depend on it.  ``order_rules`` runs small jobs when it is called.

Defined results
    * null or blank text: no words, all measures 0, so that the rule for short texts rejects it.
    * a condition that is null does not reject.
    * repeated rows: judged one by one.  Empty input: no rows.
    * extra columns stay; a column named like a measure is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, bind, fresh, word_count, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window whose repetition counts.
WINDOW = 5
#: Rows on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for texts to reject."""

    name: str
    fails: Column


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(_text(text), SEPARATORS, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), SYMBOLS, ""))).cast("long")


def upper_count(text: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), UPPER, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(_text(text), "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(text_words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes within one text.  Only texts with an equal pair are sorted.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(placed, lambda p: F.transform(F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        steps = bind(F.array_sort(twice), lambda s: F.transform(s, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    none = F.lit(0).cast("long")
    return bind(text_words, lambda w: F.when(F.size(w) <= window, none).otherwise(bind(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.col(text_col)
    both = bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    m = fresh(docs, "__m")
    out = docs.withColumn(m, both)
    out = out.withColumns({"n_words": F.col(f"{m}.n"), "word_chars": word_chars(text), "n_symbols": symbol_count(text), "n_dup_lines": duplicate_lines(text), "n_repeat_words": F.col(f"{m}.r")}).drop(m)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def further_rules(text: Column, n: Column) -> list[Rule]:
    """The rules beyond the base, on the text and the number of its words."""
    return [
        Rule("symbols", 10 * symbol_count(text) > 3 * n),
        Rule("long_words", word_chars(text) > 25 * n),
        Rule("short_words", word_chars(text) < 2 * n),
        Rule("shouting", 2 * upper_count(text) > word_chars(text)),
        Rule("repeated_lines", 4 * duplicate_lines(text) > n),
    ]


def text_rules(text_col: str = "text") -> list[Rule]:
    """The base and the further rules, each on the text itself, for use where no measure is kept."""
    text = F.col(text_col)
    n = word_count(text)
    return [
        Rule("few_words", n < 10),
        Rule("repeated_words", bind(words(text), lambda w: 100 * repeated_words(w) > 20 * F.size(w))),
        *further_rules(text, n),
    ]


def sampled(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About so many rows, each drawn by itself whatever its text; all of a small table."""
    known = docs.count()
    return docs if known <= rows else docs.where(F.rand(seed) < rows / known)


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds a row) and selectivity (share rejected), best rejection per cost first."""
    sample = sampled(docs, sample_rows).persist()
    try:
        rows = sample.count()

        def timed(condition: Column) -> tuple[float, int]:
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(condition)).first()[0]
            return time.perf_counter() - began, rejected

        timed(F.lit(False))
        idle = timed(F.lit(False))[0]
        known = []
        for rule in rules:
            seconds, rejected = timed(F.coalesce(rule.fails, F.lit(False)))
            known.append((rule, max(seconds - idle, 1e-4) / max(rows, 1), rejected / max(rows, 1)))
    finally:
        sample.unpersist()
    return sorted(known, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null for a text to keep; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails, F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept``: of what the base keeps, the further rules read the text in turn."""
    rules = further_rules(F.col(text_col), F.col("n_words"))
    counted = docs.withColumn("n_words", word_count(F.col(text_col)))  # the sample's words only are counted for it
    ordered = [rule for rule, _, _ in order_rules(counted, rules, sample_rows)]
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered).isNull())
    return measures(docs, text_col).withColumn("kept", verdict)


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their columns unchanged."""
    ordered = [rule for rule, _, _ in order_rules(docs, text_rules(text_col), sample_rows)]
    return docs.where(cascade(ordered).isNull())
