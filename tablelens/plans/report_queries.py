"""Registered queries of reports, sinks and dispatch, with their DuckDB SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators import charts, chat, profile, relations
from tablelens.operators.chart_pack import chart_pack
from tablelens.plans.fixtures import Tables
from tablelens.plans.registry import _FILL, _LOG_SQL, _bin_sql, _corr_sql, _probit_sql, _union, register
from tablelens.session import scratch_path
from tablelens.sources import files, sinks

# ------------------------------------------------------------- relationships

#: Orders with a column that follows the price, and price bands.
_BANDED = """SELECT *, o_totalprice * 1.1 + o_orderkey % 7 AS gross,
       CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS band FROM orders"""
_NUM, _CAT = ["o_orderkey", "o_custkey", "o_totalprice", "gross"], ["o_orderstatus", "o_orderpriority", "band"]


def _banded(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select("*", (price * 1.1 + F.col("o_orderkey") % 7).alias("gross"),
                           F.when(price < 100000, "low").when(price < 250000, "mid").otherwise("high").alias("band"))


def _near(x: str, digits: int) -> str:
    """``x`` rounded in a way that both engines share, also just beside a tie."""
    return f"floor({x} * {10 ** digits} + 0.50001) / {10 ** digits}"


def _report_sql() -> str:
    """All relations, p-values by the closed forms that even degrees of freedom have (3 or 5 groups, 4 or 8 cells)."""
    corr = [f"SELECT '{a}' AS col1, '{b}' AS col2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM f" for a, b in combinations(_NUM, 2)]
    anova = [f"""SELECT '{c}' AS col1, '{x}' AS col2, sum(n) AS n, count(*) - 1 AS d1, sum(n) - count(*) AS d2,
       (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS fs
FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS gm
      FROM (SELECT count({x}) AS n, avg({x}) AS m, var_samp({x}) AS v FROM f WHERE {c} IS NOT NULL GROUP BY {c} HAVING count({x}) > 1))"""
             for c in _CAT for x in _NUM]
    chi = [f"""SELECT '{a}' AS col1, '{b}' AS col2, any_value(n) AS n, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof,
       any_value(n) * (sum(CAST(o AS DOUBLE) * o / (CAST(ra AS DOUBLE) * cb)) - 1) AS x
FROM (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n
      FROM (SELECT {a} AS a, {b} AS b, count(*) AS o FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))""" for a, b in combinations(_CAT, 2)]
    tail = "exp(-x / 2) * (" + " + ".join(f"CASE WHEN dof > {2 * i} THEN power(x / 2, {i}) / {f} ELSE 0 END" for i, f in enumerate((1, 1, 2, 6))) + ")"
    return f"""
WITH f AS ({_BANDED}),
c AS ({_union(corr)}), a AS ({_union(anova)}), k AS ({_union(chi)}),
ap AS (SELECT *, power(d2 / (d2 + d1 * fs), d2 / 2.0) * (CASE WHEN d1 = 4 THEN 1 + d2 / 2.0 * (1 - d2 / (d2 + d1 * fs)) ELSE 1 END) AS p FROM a),
kp AS (SELECT *, {tail} AS p FROM k),
report AS (
SELECT 1 AS kind, 'numerical-numerical' AS type, col1, col2, round(abs(r), 2) AS strength, round(r, 4) AS statistic, CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS BIGINT) AS n,
       'Strong ' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ' correlation between ' || col1 || ' and ' || col2 AS description,
       '{relations.SUGGESTIONS['numerical-numerical']}' AS suggestion FROM c WHERE abs(r) > 0.7
UNION ALL SELECT 2, 'categorical-numerical', col1, col2, {_near('fs', 3)}, {_near('fs', 3)}, {_near('p', 6)}, CAST(n AS BIGINT),
       'Significant difference in ' || col2 || ' across groups of ' || col1, '{relations.SUGGESTIONS['categorical-numerical']}' FROM ap WHERE p < 0.05
UNION ALL SELECT 3, 'categorical-categorical', col1, col2, NULL, {_near('x', 3)}, {_near('p', 6)}, CAST(n AS BIGINT),
       'Significant association between ' || col1 || ' and ' || col2, '{relations.SUGGESTIONS['categorical-categorical']}' FROM kp WHERE p < 0.05)"""


@register("relationship_report", _report_sql() + "\nSELECT * FROM report")
def _relationship_report(t: Tables):
    """R7 without a limit: every strong correlation and every significant ANOVA and chi-square, with p-values."""
    out = relations.relationships(_banded(t), None)
    near = {c: F.when(F.col("kind") == 1, F.col(c)).otherwise(F.expr(_near(c, 3))) for c in ("strength", "statistic")}
    return out.withColumns({**near, "p_value": F.expr(_near("p_value", 6))})


@register("p_values", _report_sql() + """
SELECT 'anova' AS test, col1, col2, """ + _near("p", 6) + """ AS p_value FROM ap UNION ALL SELECT 'chi-square', col1, col2, """ + _near("p", 6) + """ FROM kp""")
def _p_values(t: Tables):
    """F and chi-square upper tails of every pair of columns."""
    f = _banded(t)
    a = relations.with_f_pvalue(relations.anova(f, _CAT, _NUM)).select(F.lit("anova").alias("test"), F.col("cat_col").alias("col1"), F.col("num_col").alias("col2"), "p_value")
    c = relations.with_chi2_pvalue(relations.chi_square(f, _CAT)).select(F.lit("chi-square").alias("test"), "col1", "col2", "p_value")
    return a.unionByName(c).withColumn("p_value", F.expr(_near("p_value", 6)))


@register("insight_counts", _report_sql() + """
SELECT * FROM (VALUES ('columns', 8), ('dtype:bigint', 2), ('dtype:double', 2), ('dtype:string', 3), ('dtype:timestamp_ntz', 1)) v(metric, value)
UNION ALL SELECT 'rows', count(*) FROM f UNION ALL SELECT 'relationships', count(*) FROM report
UNION ALL SELECT 'missing_columns', """ + " + ".join(f"CAST(count(*) > count({c}) AS BIGINT)" for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                                                                                      "o_orderpriority", "gross", "band"]) + """ FROM f
UNION ALL SELECT 'recommendations', 5 + CAST(count(*) > count(o_custkey) AS BIGINT) - 1 FROM f""")
def _insight_counts(t: Tables):
    """P8 over orders with price bands: every rule but the one for more than ten columns (and, without gaps, the one for missing values)."""
    return profile.insight_digest(_banded(t))


# ------------------------------------------------------------------ chart pack

def _pack_sql() -> str:
    nums, cats = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    row = lambda chart, c1, c2, key, x, value, count: (f"SELECT '{chart}' AS chart, {c1} AS \"column\", {c2} AS column2, CAST({key} AS VARCHAR) AS key, "  # noqa: E731
                                                       f"CAST({x} AS DOUBLE) AS x, CAST({value} AS DOUBLE) AS value, CAST({count} AS BIGINT) AS count")
    bounds = "b AS (SELECT " + ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in nums) + " FROM orders)"
    bin_of = lambda c, n: _bin_sql(f"CAST({c} AS DOUBLE)", f"lo_{c}", f"hi_{c}", n)
    parts = []
    for c in nums:
        parts.append(row("histogram", f"'{c}'", "NULL", "k", "NULL", "NULL", "count(*)") + f" FROM (SELECT {bin_of(c, 50)} AS k FROM orders, b) GROUP BY k")
        parts += [row("box", f"'{c}'", "NULL", f"'{name}'", "NULL", f"quantile_cont(CAST({c} AS DOUBLE), {p})", "NULL") + " FROM orders"
                  for name, p in (("min", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1))]
        ranked = (f"(SELECT v, min(rank) AS rank, count(*) AS cnt, any_value(n) AS n FROM (SELECT CAST({c} AS DOUBLE) AS v, "
                  f"row_number() OVER (ORDER BY CAST({c} AS DOUBLE)) AS rank, count(*) OVER () AS n FROM orders) GROUP BY v)")
        parts.append(row("qq", f"'{c}'", "NULL", "rank", f"round({_probit_sql('prob')}, 6)", "v", "cnt") + f" FROM (SELECT *, {_FILL} AS prob FROM {ranked})")
        parts.append(row("line", "'o_orderdate'", f"'{c}'", "d", "NULL", f"avg(CAST({c} AS DOUBLE))", f"count({c})")
                     + f" FROM (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d, {c} FROM orders WHERE o_orderdate IS NOT NULL) GROUP BY d")
    for a, c in combinations(nums, 2):
        parts.append(row("pairplot", f"'{a}'", f"'{c}'", "k", "NULL", "NULL", "count(*)")
                     + f" FROM (SELECT {bin_of(a, 20)} || ',' || {bin_of(c, 20)} AS k FROM orders, b) GROUP BY k")
    for c in cats:
        top = f"(SELECT {c} AS k, count(*) AS cnt FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, k LIMIT 10)"
        parts.append(row("bar", f"'{c}'", "NULL", "k", "NULL", "NULL", "cnt") + f" FROM {top}")
        parts.append(row("pie", f"'{c}'", "NULL", "k", "NULL", "NULL", "cnt") + f" FROM {top} WHERE (SELECT count(DISTINCT {c}) FROM orders) <= 20")
    parts.append(row("heatmap", "col1", "col2", "NULL", "NULL", "corr", "NULL") + " FROM ("
                 + _corr_sql("(SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in nums) + " FROM orders)", nums, 2) + ")")
    # ties of means over few rows must fall the same way whatever the last bits of the sums are
    return f"WITH {bounds}\nSELECT * REPLACE ({_near("value", 4)} AS value) FROM ({_union(parts)})"


@register("chart_pack", _pack_sql())
def _chart_pack(t: Tables):
    """The data of every chart of orders."""
    return chart_pack(t.orders).withColumn("value", F.expr(_near("value", 4)))


#: Both vocabularies of chart kinds, with arguments over customer.
_DISPATCH = {
    "histogram": {"column": "c_acctbal"}, "scatterplot": {"x_col": "c_acctbal", "y_col": "c_nationkey"}, "scatter": {"x_col": "c_acctbal", "y_col": "c_nationkey"},
    "boxplot": {"column": "c_acctbal", "by_col": "c_mktsegment"}, "box": {"column": "c_acctbal", "by_col": "c_mktsegment"},
    "barplot": {"x_col": "c_mktsegment", "y_col": "c_acctbal", "top_n": 3}, "bar": {"x_col": "c_mktsegment", "top_n": 0},
    "heatmap": {}, "pairplot": {"columns": ["c_acctbal", "c_nationkey"]}, "lineplot": {"x_col": "c_nationkey", "y_col": "c_acctbal"},
    "line": {"x_col": "c_nationkey", "y_col": "c_acctbal", "hue_col": "c_mktsegment"}, "violinplot": {"column": "c_acctbal"}, "violin": {"column": "c_acctbal", "by_col": "c_mktsegment"},
    "piechart": {"column": "c_mktsegment", "top_n": 2}, "pie": {"column": "c_mktsegment"}, "qqplot": {"column": "c_nationkey"}, "qq": {"column": "c_acctbal"}, "treemap": {"column": "c_acctbal"},
}


def _dispatch_sql() -> str:
    hist = (f"(SELECT count(DISTINCT {_bin_sql('c_acctbal', 'lo', 'hi', 50)}) FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer))")
    pair = (f"(SELECT count(DISTINCT {_bin_sql('c_acctbal', 'lo', 'hi', 20)} * 100 + {_bin_sql('CAST(c_nationkey AS DOUBLE)', 'l2', 'h2', 20)}) FROM customer, "
            "(SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(min(c_nationkey) AS DOUBLE) AS l2, CAST(max(c_nationkey) AS DOUBLE) AS h2 FROM customer))")
    n = lambda e: f"(SELECT count(DISTINCT {e}) FROM customer)"
    segments = n("c_mktsegment")
    rows = {"histogram": hist, "scatterplot": "1", "scatter": "1", "boxplot": segments, "box": segments, "barplot": f"least(3, {segments})", "bar": segments, "heatmap": "9",
            "pairplot": pair, "lineplot": n("c_nationkey"), "line": n("c_nationkey * 1000 + hash(c_mktsegment) % 1000"), "violinplot": "512", "violin": f"512 * {segments}",
            "piechart": f"least(2, {segments})", "pie": f"least(10, {segments})", "qqplot": n("c_nationkey"), "qq": n("c_acctbal"), "treemap": "NULL"}
    rows["line"] = "(SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer))"
    return _union([f"SELECT '{k}' AS kind, CAST({e} AS BIGINT) AS rows" for k, e in rows.items()])


@register("chart_dispatch", _dispatch_sql())
def _chart_dispatch(t: Tables):
    """Rows of each chart that the kinds of both vocabularies name; an unknown kind has none."""
    out = None
    for kind, args in _DISPATCH.items():
        data = charts.chart(t.customer, kind, **args)
        rows = t.spark.range(1).select(F.lit(None).cast("long").alias("rows")) if data is None else data.agg(F.count(F.lit(1)).alias("rows"))
        rows = rows.select(F.lit(kind).alias("kind"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------ sinks and sources

def _profiles_sql() -> str:
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    parts = []
    for i, (c, kind) in enumerate(types.items()):
        x = f"CAST({c} AS DOUBLE)" if kind in ("bigint", "double") else "CAST(NULL AS DOUBLE)"
        top = f"(SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" if kind == "string" else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS rows, 6 AS columns, count(DISTINCT {c}) AS distinct_count, "
                     f"count(*) - count({c}) AS missing_count, round(avg({x}), 4) AS mean, round(quantile_cont({x}, 0.5), 4) AS p50, {top} AS top_value FROM orders")
    return _union(parts)


@register("write_profiles", _profiles_sql())
def _write_profiles(t: Tables):
    """The whole profile of orders written, read back and put together by column."""
    path = sinks.write_profiles(t.orders, "orders")
    parts = sinks.read_profiles(t.spark, path)
    top = parts["top_values"].filter("rank = 1").select("column", F.col("value").alias("top_value"))
    return (parts["schema"].join(parts["summary"].select("column", "distinct_count", "missing_count"), "column")
            .join(parts["describe"].select("column", "mean", "p50"), "column", "left").join(top, "column", "left"))


@register("chat_append", _LOG_SQL)
def _chat_append(t: Tables):
    """The log appended in two batches that overlap, the second one twice, and loaded."""
    log = chat.chat_log_from_turns(t.conversations)
    path = f"{scratch_path(t.spark, 'chat-log')}/log"
    chat.append_messages(log.filter(F.col("conv_id") % 2 == 0), path)
    for _ in range(2):
        chat.append_messages(log, path)
    return chat.load_history(chat.read_log(t.spark, path))


@register("load_by_suffix", """
SELECT 'csv' AS suffix, p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part
UNION ALL SELECT 'xlsx', p_partkey, p_name, CAST(p_size AS BIGINT), p_retailprice FROM part
UNION ALL SELECT 'json', NULL, 'unsupported file type ''json''; expected one of (''csv'', ''xlsx'')', NULL, NULL""")
def _load_by_suffix(t: Tables):
    """Part written as CSV and as workbooks, each loaded by its suffix; another suffix is an error."""
    from tablelens.sources.xlsx_writer import write_xlsx

    cols = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    part = t.part.select(cols)
    csv = files.write_csv(part, f"{scratch_path(t.spark, 'load-csv')}/part.csv")
    books = write_xlsx(part.repartition(max(2, t.spark.sparkContext.defaultParallelism)), f"{scratch_path(t.spark, 'load-xlsx')}/part.xlsx")
    out = files.load(t.spark, csv).select(F.lit("csv").alias("suffix"), *cols).unionByName(files.load(t.spark, books).select(F.lit("xlsx").alias("suffix"), *cols))
    try:
        files.load(t.spark, csv.replace(".csv", ".json"))
    except files.SourceError as error:
        text = str(error)
    return out.unionByName(t.spark.range(1).select(F.lit("json").alias("suffix"), F.lit(None).cast("long").alias("p_partkey"), F.lit(text).alias("p_name"),
                                                   F.lit(None).cast("long").alias("p_size"), F.lit(None).cast("double").alias("p_retailprice")))
