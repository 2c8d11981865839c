"""Exact quantiles (linear interpolation, as pandas / ``quantile_cont``)
for many columns and optional groups, by distributed radix selection.

Every value has an order-preserving 64-bit code (``order_code``).  A pass
counts, in one scan with map-side combine, the values under each ``BITS``-bit
continuation of the code prefixes that still hold a wanted rank (the first
pass has the empty prefix), and finds the continuation that holds it.  A
rank whose cell has one value only is settled; a cell of at most ``2**BITS``
values is next counted by whole codes, and after 64 / ``BITS`` = 4 passes every
cell is a single code.  So there are at most 4 scans, at most
``2**BITS`` counters per (group, column, wanted prefix) and pass, and no
sketch, sort or task whose input grows with the number of distinct values:
neither a near-unique column nor a value held by a third of all rows is
special.  Between passes, what is wanted is at most two cells per
probability, column and group.  A cell is an interval of values, so later scans
drop all rows outside by comparing values before any code is computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import as_number
from tablelens.session import written

#: Code bits that one pass settles.
BITS = 16


def order_code(df: DataFrame) -> DataFrame:
    """Adds ``code``: the IEEE bits of the double ``v`` as a long that sorts like it.

    Exponent and mantissa are taken by exact arithmetic (powers of two), so
    the expression stays in whole-stage codegen.  -0.0 has the code of 0.0."""
    keep = [f"`{c}`" for c in df.columns]
    # the logarithm may be off by one at a power of two; 2**1074 is no double, so subnormals are scaled in two steps
    power = "CASE WHEN __a < __p THEN __p / 2 WHEN __a >= __p * 2 THEN __p * 2 ELSE __p END"
    exponent = "CASE WHEN __a < __p THEN __e - 1 WHEN __a >= __p * 2 THEN __e + 1 ELSE __e END"
    half = "power(2D, 537)"
    bits = f"""CASE WHEN __a < power(2D, -1022) THEN cast(__a * {half} * {half} AS long)
                    WHEN __a = double('inf') THEN {2047 << 52}L
                    ELSE cast(({exponent}) + 1023 AS long) * {1 << 52}L + cast((__a / ({power}) - 1) * power(2D, 52) AS long) END"""
    return (df.selectExpr(*keep, "abs(v) AS __a").selectExpr("*", "cast(least(floor(log2(__a)), 1023) AS int) AS __e")
            .selectExpr("*", "power(2D, __e) AS __p").selectExpr(*keep, f"{bits} AS __b")
            .selectExpr(*keep, "CASE WHEN v < 0 THEN ~__b ELSE __b END AS code"))


def cell_counts(long: DataFrame, keys: list[str], shift: str) -> DataFrame:
    """``(keys..., cell, cnt, lo, hi)``: values per code prefix, and the least and greatest of them."""
    coded = order_code(long).selectExpr(*keys, "v", f"shiftright(code, {shift}) AS cell")
    return coded.groupBy(*keys, "cell").agg(F.expr("count(1) AS cnt"), F.expr("min(v) AS lo"), F.expr("max(v) AS hi"))


def _wanted(n: str, probs: list[float]) -> str:
    """Ranks (from 1) below and above every probability's position, as an array of structs."""
    out = []
    for i, p in enumerate(probs):
        pos = f"({p!r}D * ({n} - 1))"
        for upper, r in (("false", "floor"), ("true", "ceil")):
            out.append(f"named_struct('pi', {i}, 'upper', {upper}, 'frac', {pos} - floor({pos}), 'r', cast({r}({pos}) + 1 AS long))")
    return f"array({', '.join(out)})"


def _in_ranges(value: str, ranges: list[tuple]) -> str:
    """(prev, shift) of the first of the ranges (lo, hi, prev, shift) that holds the value, else null."""
    cases = " ".join(f"WHEN {value} BETWEEN double('{lo!r}') AND double('{hi!r}') THEN named_struct('prev', {prev}L, 'shift', {shift})"
                     for lo, hi, prev, shift in ranges)
    return f"CASE {cases} END" if ranges else "cast(null AS struct<prev:bigint,shift:int>)"


def _passes(long, groups: list[str], probs: list[float], bits: int, few: bool):
    """Cells that hold wanted ranks, pass by pass: rows with ``lo = hi`` are settled.

    ``long(ranges)`` gives the rows (groups..., col, v), those within ``ranges`` (by column) with the range's prev and shift if given.
    ``few``: there are at most ``2**bits`` rows, so whole codes are counted at once.  Without groups the
    cells pass the driver (at most two rows per probability and column), else they are a written table."""
    group = [*groups, "col"]
    shift, wanted, last = 64, None, few
    while True:
        shift = 0 if last else max(0, shift - bits)
        if wanted is None:
            cells = cell_counts(long(), group, str(shift)).selectExpr("*", f"sum(cnt) OVER (PARTITION BY {', '.join(group)}) AS n")
            cells = cells.selectExpr(*group, "cell", "cnt", "lo", "hi", f"{_wanted('n', probs)} AS wants")
            within = group
        else:
            within = [*group, "prev"]
            if groups:
                wants = (wanted.withColumnRenamed("cell", "prev").groupBy(*within, "cnt", "lo", "hi")
                         .agg(F.expr("collect_list(struct(pi, upper, frac, r)) AS wants")))
                ranges = wants.selectExpr(*within, f"if(cnt <= {1 << bits}, 0, {shift}) AS shift", "lo AS lo_v", "hi AS hi_v")
                # cells are disjoint, so a value is in one range at most
                held = long().join(ranges, group).filter("v BETWEEN lo_v AND hi_v").drop("lo_v", "hi_v")
                cells = cell_counts(held, within, "shift").join(wants.select(*within, "wants"), within)
            else:
                ranges, lists = {}, {}
                for r in wanted:
                    ranges.setdefault(r["col"], {})[r["cell"]] = (r["lo"], r["hi"], r["cell"], 0 if r["cnt"] <= 1 << bits else shift)
                    lists.setdefault((r["col"], r["cell"]), []).append(
                        f"named_struct('pi', {r['pi']}, 'upper', {str(r['upper']).lower()}, 'frac', {r['frac']!r}D, 'r', {r['r']}L)")
                held = long({c: sorted(x.values()) for c, x in ranges.items()})
                cases = " ".join(f"WHEN col = {c} AND prev = {cell}L THEN array({', '.join(x)})" for (c, cell), x in lists.items())
                cells = cell_counts(held, within, "shift").selectExpr("*", f"CASE {cases} END AS wants")
        cells = cells.selectExpr("*", f"sum(cnt) OVER (PARTITION BY {', '.join(within)} ORDER BY lo ROWS UNBOUNDED PRECEDING) - cnt AS before")
        found = cells.selectExpr(*group, "cell", "cnt", "before", "lo", "hi", "explode(filter(wants, x -> x.r > before AND x.r <= before + cnt)) AS w")
        state = found.selectExpr(*group, "cell", "cnt", "w.pi", "w.upper", "w.frac", "w.r - before AS r", "lo", "hi")
        if not groups:
            rows = state.collect()
            yield rows
            left = [r for r in rows if r["lo"] < r["hi"]]
            most = max((r["cnt"] for r in left), default=None)
            wanted = left
        elif last or shift == 0:
            yield state
            return
        else:
            state = written(state, "quantile-cells")
            yield state.filter("lo = hi")
            wanted = state.filter("lo < hi")
            most = wanted.agg(F.expr("max(cnt)")).first()[0]
        if most is None:
            return
        last = most <= 1 << bits


def quantile_table(df: DataFrame, columns: list[str], probs, by: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """``(by..., column, q)`` where ``q`` is the array of quantiles at
    ``probs`` (null for a column/group without values)."""
    by = list(by or [])
    probs = [float(p) for p in probs]
    spark = df.sparkSession
    groups = [f"g{i}" for i in range(len(by))]
    num = {c: as_number(df, c) for c in columns}
    named = [F.col(b).alias(g) for b, g in zip(by, groups, strict=True)]

    def long(ranges: dict | None = None) -> DataFrame:
        # unpivoted before coded: one small loop body instead of an expression per column
        wide = df.select(*named, *[F.when(~F.isnan(num[c]), num[c]).alias(f"v{i}") for i, c in enumerate(columns)])
        if ranges is None:
            rows = ", ".join(f"struct({i} AS col, v{i} AS v)" for i in range(len(columns)))
            return wide.selectExpr(*groups, f"inline(array({rows}))").filter("v IS NOT NULL")
        rows = ", ".join(f"struct({i} AS col, v{i} AS v, {_in_ranges(f'v{i}', ranges[i])} AS held)" for i in sorted(ranges))
        return wide.selectExpr(f"inline(array({rows}))").filter("held IS NOT NULL").selectExpr("col", "v", "held.prev", "held.shift")

    few = not df.select(F.lit(1)).offset(1 << bits).take(1)  # reads as many rows as it takes to tell
    parts = _passes(long, groups, probs, bits, few)
    if not by:
        return spark.createDataFrame(_settled(list(parts), columns, len(probs)), "column string, q array<double>")
    settled = reduce(DataFrame.unionByName, parts)
    per = settled.groupBy(*groups, "col", "pi").agg(F.expr("max(if(upper, null, lo)) AS lo"), F.expr("max(if(upper, lo, null)) AS hi"), F.expr("first(frac) AS frac"))
    out = per.groupBy(*groups, "col").agg(F.expr("transform(sort_array(collect_list(struct(pi, if(lo = hi, lo, lo + (hi - lo) * frac) AS val))), x -> x.val) AS q"))
    # groups without values have a null q
    every = df.select(*named).distinct().select(*groups, F.inline(F.array(*[
        F.struct(F.lit(i).alias("col"), F.lit(c).alias("column")) for i, c in enumerate(columns)])))
    out = every.join(out, [*groups, "col"], "left")
    return out.select(*[F.col(g).alias(b) for b, g in zip(by, groups, strict=True)], "column", "q")


def _settled(passes: list[list], columns: list[str], n: int) -> list[tuple]:
    """(column, quantiles) of the settled ranks of all passes."""
    ends = {(r["col"], r["pi"], r["upper"]): (r["lo"], r["frac"]) for rows in passes for r in rows if r["lo"] == r["hi"]}
    out = []
    for c, name in enumerate(columns):
        q = []
        for i in range(n if (c, 0, False) in ends else 0):
            (lo, frac), (hi, _) = ends[c, i, False], ends[c, i, True]
            q.append(lo if lo == hi else lo + (hi - lo) * frac)
        out.append((name, q or None))
    return out


def quantiles(df: DataFrame, columns: list[str], probs, by: list[str] | None = None,
              method: str = "exact") -> DataFrame:
    """Exact (or ``approx``) quantiles ``(by..., column, q)``; a group or
    column without values has a null ``q``, rows without a group drop out
    (as pandas' groupby).

    Exact ones always come from :func:`quantile_table`; ``approx`` uses
    ``percentile_approx``."""
    by = list(by or [])
    df = df.dropna("any", subset=by) if by else df
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, q array<double>")
    if method != "approx":
        return quantile_table(df, columns, probs, by)
    num = {c: as_number(df, c) for c in columns}
    arr = F.array(*[F.lit(float(p)) for p in probs])
    g = df.groupBy(*by) if by else df
    row = g.agg(*[F.percentile_approx(num[c], arr, 10000).alias(f"q{i}") for i, c in enumerate(columns)])
    return row.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)])))
