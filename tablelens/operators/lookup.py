"""Fuzzy name lookup as a join between a table of search terms and a table
of names (the reference matches one typed term against the catalog).

Rule per term: the first name (lowest ``name_order``) where one string
contains the other wins; otherwise the best partial score above
``threshold``, ties to the lowest order.  Partial score =
100 (1 - d / |s|) with d the smallest Levenshtein distance between the
shorter string s and any window of the longer string of the same length.

Candidate pairs come from equi-joins on what a match must share (rare
bigrams, segments, masked windows; see ``_candidates``) instead of a cross
join; the filtering is exact for the score threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_THRESHOLD = 60.0


def _grams(s: Column, q: int) -> Column:
    n = F.length(s) - q + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, q))).otherwise(
        F.array().cast("array<string>"))


def partial_score(a: Column, b: Column) -> Column:
    """Levenshtein partial ratio in [0, 100] of two lower-cased strings."""
    la, lb = F.length(a), F.length(b)
    s = F.when(la <= lb, a).otherwise(b)
    t = F.when(la <= lb, b).otherwise(a)
    ls, lt = F.length(s), F.length(t)
    best = F.array_min(F.transform(F.sequence(F.lit(1), lt - ls + 1),
                                   lambda i: F.levenshtein(s, F.substring(t, i, ls))))
    return F.when(ls == 0, F.lit(0.0)).otherwise(F.round(100.0 * (1 - best / ls), 2))


def _max_edits(length: Column, threshold: float) -> Column:
    """Largest Levenshtein distance d with 100 (1 - d / L) > threshold."""
    return F.greatest(F.ceil(F.lit(1 - threshold / 100.0) * length) - 1, F.lit(0))


def _explode(df: DataFrame, keys: Column) -> DataFrame:
    return df.select("*", F.explode(F.array_distinct(keys)).alias("g"))


def _segments(s: Column, parts: Column) -> Column:
    """The first two characters of each of ``parts`` segments that ``s`` is cut into."""
    size = F.floor(F.length(s) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(s, (i * size + 1).cast("int"), F.lit(2)))


def _masked(s: Column) -> Column:
    """Every window of three characters with each of them left out (its number stands in front)."""
    window = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    return F.flatten(F.transform(window, lambda w: F.array(F.concat(F.lit("0"), F.substring(w, 2, 2)), F.concat(F.lit("1"), F.substring(w, 1, 1), F.substring(w, 3, 1)),
                                                           F.concat(F.lit("2"), F.substring(w, 1, 2)))))


def _candidates(T: DataFrame, N: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs that miss no match, by what the shorter string s of a pair with at most d edits
    must share with its partner (a window as long as s):

    * bigrams: those of s not touched by an edit number at least |B(s)| - 2 d and all occur in the partner.
      Where that is positive, one of s's 2 d + 1 globally rarest bigrams is among the
      partner's: s joins on that short prefix only, so hot bigrams rarely meet;
    * segments, where it isn't (few distinct bigrams): of d + 1 segments one is untouched, so its first
      two characters occur in the partner;
    * three characters and one edit: as long as its window, the edit replaces a character, so s and the window agree when
      that character is left out of both;
    * one character: no edit is left, so one string contains it.  Among such partners the lowest
      order wins, and only that one is kept for each character before anything is joined.

    Thresholds so low that a segment has one character only join on characters."""
    def edits(col):
        return _max_edits(F.length(F.col(col)), threshold).cast("int")

    tg, ng = _explode(T, _grams(F.col("tl"), 2)), _explode(N, _grams(F.col("nl"), 2))
    freq = tg.select("g").unionByName(ng.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def kind(col):
        """Which of the ways above a string goes."""
        L, d = F.length(F.col(col)), edits(col)
        bound = F.size(F.array_distinct(_grams(F.col(col), 2))) - 2 * d
        return (F.when(L == 1, "one").when(bound >= 1, "prefix").when(L >= 2 * (d + 1), "segment").when((L == 3) & (d == 1), "three").otherwise("characters"))

    def prefix(df, col, key, g):
        # rank a string's bigrams by (global frequency, gram); keep the rarest
        lst = g.join(freq, "g").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("gs"))
        rare = F.transform(F.slice("gs", 1, 2 * edits(col) + 1), lambda x: x["g"])
        return df.filter(kind(col) == "prefix").join(lst, key).select(*df.columns, F.explode(rare).alias("g"))

    tcols, ncols = ["t", "tl"], ["n", "o", "nl"]
    lt, ln = F.length("tl"), F.length("nl")
    out = []

    def meet(short, long, longer):
        out.append(short.join(long, "g").filter(longer).select(*tcols, *ncols))

    for df, col, key, grams, other, other_col, other_grams, longer in ((T, "tl", "t", tg, N, "nl", ng, lt <= ln), (N, "nl", "o", ng, T, "tl", tg, ln < lt)):
        of = lambda name: df.filter(kind(col) == name)  # noqa: B023, E731
        meet(prefix(df, col, key, grams), other_grams, longer)
        meet(_explode(of("segment"), _segments(F.col(col), edits(col) + 1)), other_grams, longer)
        meet(_explode(of("three"), _masked(F.col(col))), _explode(other.filter(F.length(other_col) >= 3), _masked(F.col(other_col))), longer)
        if threshold < SCORE_THRESHOLD:  # else no string goes this way
            meet(_explode(of("characters"), _grams(F.col(col), 1)), _explode(other, _grams(F.col(other_col), 1)), longer)
    # one character: the first name that has it, and the first name that is it
    first = lambda df: df.groupBy("g").agg(F.min(F.struct("o", "n", "nl")).alias("x")).select("g", "x.*")
    has = first(_explode(N, _grams(F.col("nl"), 1)))
    out.append(T.filter(lt == 1).join(has, F.col("tl") == F.col("g")).select(*tcols, *ncols))
    out.append(_explode(T.filter(lt > 1), _grams(F.col("tl"), 1)).join(first(N.filter(ln == 1).withColumn("g", F.col("nl"))), "g").select(*tcols, *ncols))
    return reduce(DataFrame.unionByName, out).dropDuplicates(["t", "n", "o"])


def fuzzy_lookup(terms: DataFrame, names: DataFrame, term: str = "term", name: str = "name",
                 name_order: str = "name_order", threshold: float = SCORE_THRESHOLD,
                 strip_extension: bool = True) -> DataFrame:
    """``(term, name, name_order, score, method)`` - one row per term;
    ``method`` is ``contains`` or ``fuzzy``; unmatched terms have nulls.
    ``name_order`` must identify a name row (it ranks ties)."""
    tl = F.lower(F.col(term))
    nl = F.regexp_replace(F.col(name), r"\.[^.]*$", "") if strip_extension else F.col(name)
    T = terms.select(F.col(term).alias("t"), tl.alias("tl")).filter(F.length("tl") > 0).dropDuplicates(["t"])
    N = names.select(F.col(name).alias("n"), F.col(name_order).alias("o"), F.lower(nl).alias("nl"))
    pairs = _candidates(T, N, threshold)
    contained = (F.instr(F.col("nl"), F.col("tl")) > 0) | (F.instr(F.col("tl"), F.col("nl")) > 0)
    scored = pairs.select("t", "n", "o", contained.alias("c"), partial_score(F.col("tl"), F.col("nl")).alias("s"))
    scored = scored.filter(F.col("c") | (F.col("s") > threshold))
    w = Window.partitionBy("t").orderBy(F.col("c").desc(), F.when(F.col("c"), F.col("o")),
                                        F.col("s").desc(), F.col("o"))
    best = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
    out = best.select(F.col("t").alias(term), F.col("n").alias(name), F.col("o").alias(name_order),
                      F.when(F.col("c"), F.lit(100.0)).otherwise(F.col("s")).alias("score"),
                      F.when(F.col("c"), F.lit("contains")).otherwise(F.lit("fuzzy")).alias("method"))
    return terms.select(F.col(term)).distinct().join(out, term, "left")
