"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule has a rejecting condition, and may state its work.  On a sample of about
``SAMPLE_ROWS`` rows, written once, the operator measures how often each rule rejects and how
long its condition takes (beyond a query of no condition; a stated work is taken instead),
orders the rules by rejections per unit of cost, and builds one CASE expression in that order: a row
that an early rule rejects skips the later rules' conditions.  The order decides the cost and
which rule is named as the reason, never whether a row is kept.

Null texts count as empty.  A text of no words is rejected by the word-count rule.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.words import materialise

#: Rows of the sample that decides the order.
SAMPLE_ROWS = 2000
BLANKS = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _pairs(h: Column, gap: int) -> Column:
    """Hash of each value with the value ``gap`` further on."""
    return let(h, lambda x: F.transform(F.slice(x, 1, F.greatest(F.size(x) - gap, F.lit(0))),
                                        lambda v, i: F.xxhash64(v, F.get(x, i + gap))))


def n_repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows found twice or more in the text.  Windows are
    64-bit hashes, sorted with their places; equal neighbours are repeats."""
    h8 = _pairs(_pairs(_pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
                (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, F.when(j > 0, j - 1))["h"]), x["i"])), lambda i: i.isNotNull()))

        def length(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("till")),
                               lambda a, i: F.struct((a["n"] + (i + 8) - F.greatest(i, a["till"])).alias("n"), (i + 8).alias("till")),
                               lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(placed, places), length))

    return let(h8, covered).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects``: condition over the frame's columns; ``work``: units its evaluation costs for a row, measured if not stated."""
    name: str
    rejects: Column
    work: Column | None = None


def standard_rules(text: str = "text") -> list[Rule]:
    """Published web-corpus heuristics: length, symbols, repeated lines, word length, shouting, repetition."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = words_of(t)
    chars = F.length(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    upper = chars - F.length(F.regexp_replace(t, r"\p{Lu}", ""))
    letters = chars - F.length(F.regexp_replace(t, r"\p{L}", ""))
    return [
        Rule("few_words", F.size(w) < 20),
        Rule("symbols", n_symbols(t) * 5 > F.size(w)),
        Rule("repeated_lines", let(lines, lambda x: n_of(x) * 10 > F.size(x) * 3)),
        Rule("word_length", let(w, lambda x: (word_chars(x) < 3 * F.size(x)) | (word_chars(x) > 10 * F.size(x)))),
        Rule("shouting", upper * 2 > letters),
        Rule("repetition", let(w, lambda x: n_repeat_words(x) * 100 > F.size(x) * 30)),
    ]


def n_of(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


def sampled(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of the frame, drawn by a fixed seed from all of it."""
    n = df.count()
    return df if n <= rows else df.sample(rows / n, seed=7)


def _seconds(query: DataFrame) -> float:
    """The shorter of two runs: the first one may compile."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        query.collect()
        took.append(time.perf_counter() - began)
    return min(took)


def plan_order(sample: DataFrame, rules: list[Rule]) -> list[dict]:
    """Rules by rejections per unit of cost on the rows of ``sample``; ties by name.  Only the order depends on it."""
    sample = materialise(sample, "quality-sample")
    seen = sample.select(*[F.coalesce(r.rejects, F.lit(False)).cast("double").alias(f"r{k}") for k, r in enumerate(rules)],
                         *[r.work.cast("double").alias(f"w{k}") for k, r in enumerate(rules) if r.work is not None])
    row = seen.agg(*[F.avg(c).alias(c) for c in seen.columns]).first()
    nothing = None
    stats = []
    for k, r in enumerate(rules):
        if r.work is not None:
            cost = row[f"w{k}"] or 0.0
        else:
            nothing = _seconds(sample.agg(F.count(F.lit(1)))) if nothing is None else nothing
            cost = _seconds(sample.agg(F.count(F.when(r.rejects, 1)))) - nothing
        stats.append({"rule": r.name, "rejects": row[f"r{k}"] or 0.0, "work": max(cost, 1e-3 if r.work is None else 1e-9)})
    return sorted(stats, key=lambda s: (-s["rejects"] / s["work"], s["rule"]))


def cascade(df: DataFrame, rules: list[Rule] | None = None, *, text: str = "text", sample: DataFrame | None = None,
            reason: str = "rejected_by") -> DataFrame:
    """``df`` with ``reason``: the first rule in measured order that rejects the row, null if none does.
    ``sample``: rows with the columns that rules look at, to measure on; else it is drawn from ``df``."""
    rules = rules or standard_rules(text)
    by_name = {r.name: r for r in rules}
    case = None
    for s in plan_order(sampled(df) if sample is None else sample, rules):
        cond = F.coalesce(by_name[s["rule"]].rejects, F.lit(False))
        case = F.when(cond, F.lit(s["rule"])) if case is None else case.when(cond, F.lit(s["rule"]))
    return df.withColumn(reason, case)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of its texts (longs)."""
    t = F.col(text)
    both = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"),
                                              n_repeat_words(w).alias("n_repeat_words")))
    df = df.withColumn("_tl_words", both)
    return df.withColumns({"n_words": F.col("_tl_words.n_words"), "word_chars": F.col("_tl_words.word_chars"), "n_symbols": n_symbols(t),
                           "n_dup_lines": n_dup_lines(t), "n_repeat_words": F.col("_tl_words.n_repeat_words")}).drop("_tl_words")


def measured_rules() -> list[Rule]:
    """The standard rules over the columns that ``features`` makes, which then cost nothing to look up again."""
    n, chars, text = F.col("n_words"), F.col("word_chars"), F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    shout = [r for r in standard_rules() if r.name == "shouting"]
    return [
        Rule("few_words", n < 20),
        Rule("symbols", F.col("n_symbols") * 5 > n),
        Rule("repeated_lines", (F.col("n_dup_lines") > 0) & (F.col("n_dup_lines") * 10 > F.size(lines) * 3)),
        Rule("word_length", (chars < 3 * n) | (chars > 10 * n)),
        Rule("repetition", F.col("n_repeat_words") * 100 > n * 30),
        *shout,
    ]
