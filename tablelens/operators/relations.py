"""Relations between columns: Pearson correlation, one-way ANOVA, crosstab,
chi-square independence, and the combined relationship report.

Every statistic for every column pair comes out of ONE scan: blocks of products
for correlations, grouping sets for ANOVA, counts by sets of columns for chi-square
cells.  The reference re-scans the frame once per pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import numeric_columns, skips_nan, stat_categorical_columns, validate
from tablelens.functions.special import chi2_pvalue, f_pvalue
from tablelens.session import ship_package, written

# Thresholds of the relationship rules.
STRONG_CORRELATION = 0.7
SIGNIFICANCE = 0.05
MAX_INSIGHTS = 5
# Description template and suggestion text per relation type.
DESCRIPTIONS = {
    "numerical-numerical": "Strong %s correlation between %s and %s",
    "categorical-numerical": "Significant difference in %s across groups of %s",
    "categorical-categorical": "Significant association between %s and %s",
}
SUGGESTIONS = {
    "numerical-numerical": "Consider creating a scatter plot to visualize this relationship",
    "categorical-numerical": "Consider creating a box plot or violin plot to visualize the differences",
    "categorical-categorical": "Consider creating a stacked bar chart or mosaic plot to visualize this relationship",
}
#: Bytes of rows that one step multiplies, and columns on one side of a block of products.
GRAM_BYTES, GRAM_BLOCK = 32 << 20, 256
#: Cells that a set of columns may have to be counted at once for its pairs.
SUPERSET_CELLS = 50_000


def _gram(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(a, b, n, sa, sb, saa, sbb, sab)`` for columns a <= b (by position): count, sums and sums of products of their
    shifted values over the rows that have both.

    One scan for the shifts (means; of a constant column its value, so that its spread is exactly 0), and one for all
    products whatever the number of columns: each task multiplies its rows block by block of columns, and the blocks'
    entries are summed by (a, b) with map-side combine."""
    k = len(cols)
    num = [F.col(c).cast("double") for c in cols]
    first = df.agg(*[f(x).alias(f"{name}{j}") for j, x in enumerate(num) for f, name in ((F.avg, "m"), (F.min, "lo"), (F.max, "hi"))]).first()
    shift = np.array([0.0 if first[f"m{j}"] is None else first[f"lo{j}"] if first[f"lo{j}"] == first[f"hi{j}"] else first[f"m{j}"] for j in range(k)])
    most = max(4096, GRAM_BYTES // (8 * k))

    def blocks(X):
        M = (~np.isnan(X)).astype("float64")
        with np.errstate(invalid="ignore"):  # infinite values leave NaN sums, whose correlation is null
            X = np.where(M > 0, X - shift, 0.0)
        X2 = X * X
        for s in range(0, k, GRAM_BLOCK):
            left = slice(s, s + GRAM_BLOCK)
            n, sab = M[:, left].T @ M[:, s:], X[:, left].T @ X[:, s:]
            sa, sb = X[:, left].T @ M[:, s:], M[:, left].T @ X[:, s:]
            saa, sbb = X2[:, left].T @ M[:, s:], M[:, left].T @ X2[:, s:]
            a, b = np.nonzero(np.arange(n.shape[0])[:, None] <= np.arange(n.shape[1])[None, :])
            yield pa.RecordBatch.from_arrays([pa.array((a + s).astype("int32")), pa.array((b + s).astype("int32")), pa.array(n[a, b].astype("int64")),
                                              *[pa.array(x[a, b]) for x in (sa, sb, saa, sbb, sab)]], ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns], axis=1))
            rows += batch.num_rows
            if rows >= most:
                yield from blocks(np.concatenate(held))
                held, rows = [], 0
        if rows:
            yield from blocks(np.concatenate(held))

    part = df.select(*[x.alias(f"x{j}") for j, x in enumerate(num)]).mapInArrow(
        run, "a int, b int, n long, sa double, sb double, saa double, sbb double, sab double")
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def _correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(a, b, corr, n)`` for columns a <= b; null where a side is constant (Spark's ``corr`` raises
    DIVIDE_BY_ZERO under ANSI there)."""
    g = _gram(df, cols)
    n = F.col("n").cast("double")
    mean = lambda x, y: F.col(x) * F.col(y) / n
    va, vb, cov = F.col("saa") - mean("sa", "sa"), F.col("sbb") - mean("sb", "sb"), F.col("sab") - mean("sa", "sb")
    g = g.filter("n > 0").select("a", "b", "n", va.alias("va"), vb.alias("vb"), cov.alias("cov"), "saa", "sbb")
    # what is left of equal sums by rounding is no spread
    spread = (F.col("n") > 1) & (F.col("va") > F.col("saa") * 1e-14) & (F.col("vb") > F.col("sbb") * 1e-14)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))))
    spread = spread & ~F.isnan(F.col("va") + F.col("vb") + F.col("cov"))  # NaN counts as greater than any number
    return g.select("a", "b", F.when(spread, F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(r)).alias("corr"), "n")


def _named(df: DataFrame, cols: list[str], pairs: DataFrame, *keep) -> DataFrame:
    """All pairs a <= b, also those without a common row, with their columns' names."""
    k = len(cols)
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(k - 1))).alias("b"))
    name = lambda c: F.array(*[F.lit(x) for x in cols])[F.col(c)]
    return every.join(pairs, ["a", "b"], "left").select("a", "b", name("a").alias("col1"), name("b").alias("col2"), *keep)


@skips_nan
def corr_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per unordered pair ``(col1, col2, corr, n)``, col1 before col2 in frame order, pairwise-complete."""
    cols = columns or numeric_columns(df)
    validate(df, *cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, corr double, n long")
    ship_package(df.sparkSession)
    out = _named(df, cols, _correlations(df, cols), "corr", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.filter("a < b").drop("a", "b")


@skips_nan
def corr_matrix(df: DataFrame, columns: list[str] | None = None,
                ndigits: int | None = 4) -> DataFrame:
    """Pearson matrix in long form ``(col1, col2, corr)``, both orders plus
    the diagonal (1.0, or null for a constant column), pairwise-complete,
    from blocks of products of shifted values."""
    cols = columns or numeric_columns(df)
    validate(df, *cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, corr double")
    ship_package(df.sparkSession)
    corr = F.col("corr") if ndigits is None else F.round("corr", ndigits)
    half = _named(df, cols, _correlations(df, cols), corr.alias("corr"))
    ways = F.when(F.col("a") < F.col("b"), F.array(F.struct("col1", "col2"), F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"))))
    both = half.select(F.explode(F.coalesce(ways, F.array(F.struct("col1", "col2")))).alias("p"), "corr")
    return both.select("p.col1", "p.col2", "corr")


def strong_correlations(df: DataFrame, columns: list[str] | None = None,
                        threshold: float = STRONG_CORRELATION) -> DataFrame:
    """Pairs with |r| > threshold, one row per unordered pair, signed."""
    p = corr_pairs(df, columns).filter(F.abs("corr") > threshold)
    return (p.select(
        F.lit("numerical-numerical").alias("type"), "col1", "col2",
        F.round(F.abs("corr"), 2).alias("strength"),
        F.round("corr", 4).alias("corr"),
        F.when(F.col("corr") > 0, "positive").otherwise("negative").alias("direction"))
        .orderBy(F.col("strength").desc(), "col1", "col2"))


@skips_nan
def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long-form contingency table ``(a, b, count)``; nulls dropped."""
    validate(df, a, b)
    return (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).count())


def _grouped_stats(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """Per (categorical column, value): count, mean, variance of every numeric
    column, from one grouping-sets scan.  Long form:
    ``(cat_col, cat_value, num_col, n, mean, var)``."""
    base = df.select(*cats, *[F.col(n).cast("double").alias(n) for n in nums])
    aggs = []
    for j, n in enumerate(nums):
        aggs += [F.count(n).alias(f"n{j}"), F.avg(n).alias(f"m{j}"), F.var_samp(n).alias(f"v{j}")]
    g = base.groupingSets([[c] for c in cats], *cats).agg(
        F.grouping_id().alias("gid"), *aggs)
    k = len(cats)
    # grouping_id bit for cats[i] is (k-1-i); the grouped column has bit 0.
    cat_col = F.lit(None).cast("string")
    cat_val = F.lit(None).cast("string")
    for i, c in enumerate(cats):
        gid_i = ((1 << k) - 1) ^ (1 << (k - 1 - i))
        cat_col = F.when(F.col("gid") == gid_i, F.lit(c)).otherwise(cat_col)
        cat_val = F.when(F.col("gid") == gid_i, F.col(c).cast("string")).otherwise(cat_val)
    g = g.select(cat_col.alias("cat_col"), cat_val.alias("cat_value"), "*")
    g = g.filter(F.col("cat_value").isNotNull())  # pandas drops null keys
    return g.select("cat_col", "cat_value", F.inline(F.array(*[
        F.struct(F.lit(n).alias("num_col"), F.col(f"n{j}").alias("n"),
                 F.col(f"m{j}").alias("mean"), F.col(f"v{j}").alias("var"))
        for j, n in enumerate(nums)])))


@skips_nan
def anova(df: DataFrame, cat_cols: list[str] | None = None,
          num_cols: list[str] | None = None) -> DataFrame:
    """One-way ANOVA F for every (categorical, numeric) pair.

    Groups need more than one non-null value; at least two groups.  F comes
    from per-group count/mean/variance: SSB = sum n (m - M)^2,
    SSW = sum (n - 1) s^2.  Output ``(cat_col, num_col, f_stat, df_between,
    df_within, n_groups, n)``; :func:`with_pvalues` adds the p-value.
    """
    cats = cat_cols if cat_cols is not None else stat_categorical_columns(df)
    nums = num_cols if num_cols is not None else numeric_columns(df)
    validate(df, *cats, *nums)
    if not cats or not nums:
        return df.sparkSession.createDataFrame(
            [], "cat_col string, num_col string, f_stat double, df_between long, "
                "df_within long, n_groups long, n long")
    # one row per (column, group): materialised once in the shared
    # checkpoint folder so both uses below read it instead of rescanning
    g = written(_grouped_stats(df, cats, nums).filter(F.col("n") > 1), "anova-groups")
    tot = g.groupBy("cat_col", "num_col").agg(
        F.sum("n").alias("tot_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"),
        F.count("*").alias("tot_groups"))
    j = g.join(tot, ["cat_col", "num_col"])
    res = j.groupBy("cat_col", "num_col").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand_mean")) ** 2).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"),
        F.first("tot_groups").alias("n_groups"), F.first("tot_n").alias("n"))
    res = res.filter(F.col("n_groups") >= 2)
    dfb = F.col("n_groups") - 1
    dfw = F.col("n") - F.col("n_groups")
    # groups without spread that differ are perfectly separated
    f = (F.when((F.col("ssw") > 0) & (dfw > 0), (F.col("ssb") / dfb) / (F.col("ssw") / dfw))
         .when((F.col("ssb") > 0) & (dfw > 0), F.lit(float("inf"))))
    return res.select("cat_col", "num_col", f.alias("f_stat"),
                      dfb.cast("long").alias("df_between"), dfw.cast("long").alias("df_within"),
                      F.col("n_groups").cast("long").alias("n_groups"), F.col("n").cast("long").alias("n"))


def supersets(sizes: list[int], most: int = SUPERSET_CELLS) -> list[tuple[int, ...]]:
    """Sets of columns (by position) that cover every pair: each a pair, or more columns whose ``sizes`` (distinct
    values) multiply to at most ``most`` cells."""
    left = set(combinations(range(len(sizes)), 2))
    out = []
    for pair in sorted(left, key=lambda p: (sizes[p[0]] * sizes[p[1]], p)):
        if pair not in left:
            continue
        chosen, cells = set(pair), sizes[pair[0]] * sizes[pair[1]]
        for c in sorted(set(range(len(sizes))) - chosen, key=lambda c: (sizes[c], c)):
            new = {tuple(sorted((c, x))) for x in chosen} & left
            if cells * sizes[c] <= most and new:
                chosen.add(c)
                cells *= sizes[c]
        left -= set(combinations(sorted(chosen), 2))
        out.append(tuple(sorted(chosen)))
    return out


def _superset_counts(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """``(s, v0, v1, ..., w)``: rows per value combination of superset ``s``, from one scan with map-side combine, and the supersets."""
    base = df.select(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)])
    row = base.agg(*[F.approx_count_distinct(f"v{i}").alias(f"d{i}") for i in range(len(cols))]).first()
    sets = supersets([row[f"d{i}"] + 1 for i in range(len(cols))])  # null is a value here
    keys = [f"v{i}" for i in range(len(cols))]
    part = lambda s: F.struct(F.lit(s).alias("s"), *[(F.col(k) if i in sets[s] else F.lit(None).cast("string")).alias(k) for i, k in enumerate(keys)])
    rows = base.select(F.inline(F.array(*[part(s) for s in range(len(sets))])))
    return rows.groupBy("s", *keys).agg(F.count(F.lit(1)).alias("w")), sets


def _pair_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(col1, col2, a, b, O)`` (written): cells of all pairs of columns, nulls dropped.

    Rows are counted by few sets of columns with few cells each, and each pair comes from the smallest set that has it; only
    pairs too large for any set are counted from the rows themselves.  So what is shuffled is bounded by the
    sets' cells per task, never by joint combinations of all columns."""
    counts, sets = _superset_counts(df, cols)
    counts = written(counts, "chi-square-sets")
    of = {p: min((s for s, x in enumerate(sets) if set(p) <= set(x)), key=lambda s: len(sets[s])) for p in combinations(range(len(cols)), 2)}
    cell = lambda p: F.struct(F.lit(cols[p[0]]).alias("col1"), F.lit(cols[p[1]]).alias("col2"), F.col(f"v{p[0]}").alias("a"), F.col(f"v{p[1]}").alias("b"))
    choice = F
    for s in range(len(sets)):
        choice = choice.when(F.col("s") == s, F.array(*[cell(p) for p, x in of.items() if x == s]))
    rows = counts.select("w", F.inline(choice)).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return written(rows.groupBy("col1", "col2", "a", "b").agg(F.sum("w").alias("O")), "chi-square-cells")


@skips_nan
def chi_square(df: DataFrame, columns: list[str] | None = None,
               correction: bool = True) -> DataFrame:
    """Chi-square independence statistic for every pair of categorical
    columns, from observed cells only: chi2 = N (sum O^2/(R C) - 1).  With one
    degree of freedom the Yates correction is applied on the dense 2x2 table.
    Output ``(col1, col2, chi2, dof, n, yates)``."""
    cols = columns if columns is not None else stat_categorical_columns(df)
    validate(df, *cols)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "col1 string, col2 string, chi2 double, dof long, n long, yates boolean")
    cells = _pair_cells(df, cols)
    rows = cells.groupBy("col1", "col2", "a").agg(F.sum("O").alias("R"))
    colt = cells.groupBy("col1", "col2", "b").agg(F.sum("O").alias("C"))
    tot = rows.groupBy("col1", "col2").agg(F.sum("R").alias("N"), F.count("*").alias("r"))
    ctot = colt.groupBy("col1", "col2").agg(F.count("*").alias("c"))
    shape = tot.join(ctot, ["col1", "col2"]).withColumn(
        "dof", (F.col("r") - 1) * (F.col("c") - 1))
    obs = (cells.join(rows, ["col1", "col2", "a"]).join(colt, ["col1", "col2", "b"])
           .groupBy("col1", "col2").agg(F.sum(F.col("O") * F.col("O") / (F.col("R") * F.col("C"))).alias("s")))
    plain = shape.join(obs, ["col1", "col2"]).select(
        "col1", "col2", (F.col("N") * F.col("s") - F.col("N")).alias("chi2_plain"), "dof", "N")
    if correction:
        # dense 2x2 cells: at most 2 x 2 per pair since dof = 1 means r = c = 2
        two = shape.filter(F.col("dof") == 1).select("col1", "col2", "N")
        dense = (rows.join(two, ["col1", "col2"]).join(colt, ["col1", "col2"])
                 .join(cells, ["col1", "col2", "a", "b"], "left")
                 .select("col1", "col2", F.coalesce("O", F.lit(0)).alias("O"),
                         (F.col("R") * F.col("C") / F.col("N")).alias("E")))
        d = F.abs(F.col("O") - F.col("E"))
        yates = dense.groupBy("col1", "col2").agg(
            F.sum((d - F.least(F.lit(0.5), d)) ** 2 / F.col("E")).alias("chi2_yates"))
        plain = plain.join(yates, ["col1", "col2"], "left")
    else:
        plain = plain.withColumn("chi2_yates", F.lit(None).cast("double"))
    use_y = F.col("chi2_yates").isNotNull()
    return plain.select(
        "col1", "col2",
        F.when(use_y, F.col("chi2_yates")).otherwise(F.greatest(F.col("chi2_plain"), F.lit(0.0))).alias("chi2"),
        F.col("dof").cast("long").alias("dof"), F.col("N").cast("long").alias("n"),
        use_y.alias("yates"))


def with_f_pvalue(anova_df: DataFrame) -> DataFrame:
    ship_package(anova_df.sparkSession)
    return anova_df.withColumn("p_value", f_pvalue("f_stat", F.col("df_between").cast("double"),
                                                   F.col("df_within").cast("double")))


def with_chi2_pvalue(chi_df: DataFrame) -> DataFrame:
    ship_package(chi_df.sparkSession)
    return chi_df.withColumn("p_value", chi2_pvalue("chi2", F.col("dof").cast("double")))


RELATION_SCHEMA = ("kind int, type string, col1 string, col2 string, strength double, "
                   "statistic double, p_value double, n long, description string, suggestion string")


def relationships(df: DataFrame, max_insights: int | None = MAX_INSIGHTS) -> DataFrame:
    """Strong correlations, then significant ANOVA, then significant
    chi-square; first ``max_insights`` rows."""
    corr = strong_correlations(df).select(
        F.lit(1).alias("kind"), "type", "col1", "col2", "strength",
        F.col("corr").alias("statistic"), F.lit(None).cast("double").alias("p_value"),
        F.lit(None).cast("long").alias("n"),
        F.format_string(DESCRIPTIONS["numerical-numerical"], "direction", "col1", "col2").alias("description"),
        F.lit(SUGGESTIONS["numerical-numerical"]).alias("suggestion"))
    an = with_f_pvalue(anova(df)).filter(F.col("p_value") < SIGNIFICANCE).select(
        F.lit(2).alias("kind"), F.lit("categorical-numerical").alias("type"),
        F.col("cat_col").alias("col1"), F.col("num_col").alias("col2"),
        F.col("f_stat").alias("strength"), F.col("f_stat").alias("statistic"), "p_value", "n",
        F.format_string(DESCRIPTIONS["categorical-numerical"], "num_col", "cat_col").alias("description"),
        F.lit(SUGGESTIONS["categorical-numerical"]).alias("suggestion"))
    ch = with_chi2_pvalue(chi_square(df)).filter(F.col("p_value") < SIGNIFICANCE).select(
        F.lit(3).alias("kind"), F.lit("categorical-categorical").alias("type"), "col1", "col2",
        F.lit(None).cast("double").alias("strength"), F.col("chi2").alias("statistic"), "p_value", "n",
        F.format_string(DESCRIPTIONS["categorical-categorical"], "col1", "col2").alias("description"),
        F.lit(SUGGESTIONS["categorical-categorical"]).alias("suggestion"))
    out = corr.unionByName(an).unionByName(ch)
    # reference order: correlations by strength, then ANOVA and chi-square
    # in column order
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    order = [F.col("kind"), F.when(F.col("kind") == 1, -F.col("strength")).otherwise(F.lit(0.0)),
             pos[F.col("col1")], pos[F.col("col2")]]
    out = out.orderBy(*order)
    return out.limit(max_insights) if max_insights else out
