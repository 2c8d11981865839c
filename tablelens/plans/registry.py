"""Registered queries: one per operator of the inventory.  Each takes
``(spark, sf_dir)``, reads whole tables (or inputs Spark derives from them)
and returns a DataFrame.  ``ORACLE`` holds the equivalent DuckDB SQL; keys
without SQL are checked by unit tests instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.operators import charts, query, relations
from tablelens.plans import fixtures as fx
from tablelens.plans.fixtures import Tables, with_derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _run(fn, spark, sf_dir):
    from tablelens.session import ship_package
    ship_package(spark)  # Python workers (Arrow UDFs) must import the package
    return fn(Tables(spark, sf_dir))


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        QUERIES[key].__name__ = key
        QUERIES[key].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- query (Q)

@register("sql_query", """
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 30""")
def _sql_query(t: Tables):
    """Q1: ad-hoc SQL over the frame, capped at 30 rows."""
    return query.query(t.spark, t.orders,
                       "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total "
                       "FROM {df} GROUP BY o_custkey ORDER BY total DESC, o_custkey")


@register("head_n", """
SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10""")
def _head_n(t: Tables):
    return query.head(t.lineitem, 10, ["l_orderkey", "l_linenumber"])


@register("tail_n", """
SELECT * FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 10""")
def _tail_n(t: Tables):
    return query.tail(t.lineitem, 10, ["l_orderkey", "l_linenumber"])


@register("sample_n")
def _sample_n(t: Tables):
    """Q4 sample: exactly 20 repeatable rows (hash order, no SQL twin)."""
    return query.sample(t.orders, 20, "o_orderkey", seed=42)


@register("filter_project", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity > 45 AND l_returnflag = 'R'""")
def _filter_project(t: Tables):
    return query.filter_project(t.lineitem, (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"),
                                ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


@register("groupby_mean", """
SELECT event_type, round(avg(value), 4) AS mean_value FROM events
WHERE event_type IS NOT NULL GROUP BY event_type""")
def _groupby_mean(t: Tables):
    g = query.groupby_agg(t.events, "event_type", "value", "mean", "mean_value")
    return g.withColumn("mean_value", F.round("mean_value", 4))


@register("top_n", """
SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 10""")
def _top_n(t: Tables):
    return query.top_n(t.lineitem, "l_partkey", F.col("l_extendedprice") * (1 - F.col("l_discount")),
                       10, "sum", "revenue")


@register("value_counts", """
SELECT o_orderpriority, count(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def _value_counts(t: Tables):
    return query.value_counts(t.orders, "o_orderpriority")


@register("rename_columns", """
SELECT o_orderkey, o_custkey AS customer_id, o_orderstatus, o_totalprice,
       o_orderdate AS order_date, o_orderpriority FROM orders""")
def _rename_columns(t: Tables):
    return query.rename_columns(t.orders, {"o_custkey": "customer_id", "o_orderdate": "order_date",
                                           "strange_col1": "customer_id"})


# ------------------------------------------------------------ relations (R)

_CORR_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(table: str, cols: list[str], ndigits: int) -> str:
    pairs, diag = [], []
    for a in cols:
        diag.append(f"SELECT '{a}' AS col1, '{a}' AS col2, CASE WHEN var_samp({a}) > 0 THEN 1.0 END AS corr FROM {table}")
        for b in cols:
            if a != b:
                pairs.append(
                    f"SELECT '{a}' AS col1, '{b}' AS col2, CASE WHEN var_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 "
                    f"AND var_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN greatest(-1.0, least(1.0, corr({a}, {b}))) END AS corr FROM {table}")
    body = "\nUNION ALL\n".join(pairs + diag)
    return f"SELECT col1, col2, round(corr, {ndigits}) AS corr FROM (\n{body}\n)"


@register("corr_matrix", _corr_sql("lineitem", _CORR_COLS, 4))
def _corr_matrix(t: Tables):
    return relations.corr_matrix(t.lineitem, _CORR_COLS)


@register("strong_correlations", with_derived("""
SELECT * FROM (
  SELECT 'numerical-numerical' AS type, col1, col2, round(abs(r), 2) AS strength, round(r, 4) AS corr,
         CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
  FROM (SELECT 'l_extendedprice' AS col1, 'net' AS col2, corr(l_extendedprice, net) AS r FROM line_net
        UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_extendedprice, l_quantity) FROM line_net
        UNION ALL SELECT 'net', 'l_quantity', corr(net, l_quantity) FROM line_net)
) WHERE strength > 0.7 OR abs(corr) > 0.7""", "line_net"))
def _strong_correlations(t: Tables):
    return relations.strong_correlations(fx.line_net(t))


@register("crosstab", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
GROUP BY o_orderstatus, o_orderpriority""")
def _crosstab(t: Tables):
    return relations.crosstab(t.orders, "o_orderstatus", "o_orderpriority")


_ANOVA_SQL = """
{name}_g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v
             FROM {name} WHERE event_type IS NOT NULL GROUP BY event_type HAVING count(value) > 1),
{name}_t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS mm, count(*) AS gg FROM {name}_g),
{name}_r AS (SELECT '{name}' AS dataset, 'event_type' AS cat_col, 'value' AS num_col,
        round((sum(n * (m - mm) * (m - mm)) / (gg - 1)) / (sum((n - 1) * v) / (nn - gg)), 4) AS f_stat,
        CAST(gg - 1 AS BIGINT) AS df_between, CAST(nn - gg AS BIGINT) AS df_within,
        CAST(gg AS BIGINT) AS n_groups, CAST(nn AS BIGINT) AS n
     FROM {name}_g, {name}_t GROUP BY gg, nn)"""


@register("anova_f", (
    "WITH events_plain AS (" + fx.DERIVED_SQL["events_plain"] + "),\n"
    "events_shift AS (" + fx.DERIVED_SQL["events_shift"] + "),"
    + _ANOVA_SQL.format(name="events_plain") + "," + _ANOVA_SQL.format(name="events_shift")
    + "\nSELECT * FROM events_plain_r UNION ALL SELECT * FROM events_shift_r"))
def _anova_f(t: Tables):
    """F statistic and degrees of freedom (p-value is unit-tested)."""
    out = None
    for name, frame in (("events_plain", fx.events_plain(t)), ("events_shift", fx.events_shift(t))):
        a = relations.anova(frame).select(F.lit(name).alias("dataset"), "cat_col", "num_col",
                                          F.round("f_stat", 4).alias("f_stat"), "df_between",
                                          "df_within", "n_groups", "n")
        out = a if out is None else out.unionByName(a)
    return out


def _chi_sql(name: str, a: str, b: str) -> str:
    return f"""
{name}_c AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {name}
             WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
{name}_r AS (SELECT a, sum(o) AS r FROM {name}_c GROUP BY a),
{name}_k AS (SELECT b, sum(o) AS c FROM {name}_c GROUP BY b),
{name}_n AS (SELECT sum(o) AS n, (SELECT count(*) FROM {name}_r) AS nr, (SELECT count(*) FROM {name}_k) AS nc FROM {name}_c),
{name}_d AS (SELECT {name}_r.a, {name}_k.b, coalesce({name}_c.o, 0) AS o, r * c / n AS e
             FROM {name}_r CROSS JOIN {name}_k CROSS JOIN {name}_n
             LEFT JOIN {name}_c ON {name}_c.a = {name}_r.a AND {name}_c.b = {name}_k.b),
{name}_x AS (SELECT '{name}' AS dataset, '{a}' AS col1, '{b}' AS col2,
        round(CASE WHEN (nr - 1) * (nc - 1) = 1
              THEN (SELECT sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) FROM {name}_d)
              ELSE greatest(0.0, (SELECT sum(o * o / e) FROM {name}_d) - n) END, 6) AS chi2,
        CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
        (nr - 1) * (nc - 1) = 1 AS yates FROM {name}_n)"""


@register("chi2_stat", "WITH flags AS (" + fx.DERIVED_SQL["flags"] + "),\nstatus_2x2 AS ("
          + fx.DERIVED_SQL["status_2x2"] + ")," + _chi_sql("flags", "l_returnflag", "l_linestatus") + ","
          + _chi_sql("status_2x2", "is_pending", "is_urgent")
          + "\nSELECT * FROM flags_x UNION ALL SELECT * FROM status_2x2_x")
def _chi2_stat(t: Tables):
    """Chi-square statistic and dof (p-value is unit-tested)."""
    out = None
    for name, frame in (("flags", fx.flags(t)), ("status_2x2", fx.status_2x2(t))):
        c = relations.chi_square(frame).select(F.lit(name).alias("dataset"), "col1", "col2",
                                               F.round("chi2", 6).alias("chi2"), "dof", "n", "yates")
        out = c if out is None else out.unionByName(c)
    return out


@register("relationships")
def _relationships(t: Tables):
    """Report over lineitem plus its net price: correlations, ANOVA,
    chi-square, first 5 (rows-only: p-values have no SQL twin)."""
    li = t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return relations.relationships(li)


# --------------------------------------------------------------- charts (G)

def _bin_sql(v: str, lo: str, hi: str, bins: int) -> str:
    return (f"CASE WHEN {hi} > {lo} THEN least(CAST(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}) AS INTEGER), {bins - 1}) "
            f"ELSE 0 END")


@register("histogram", f"""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT {_bin_sql('l_extendedprice', 'lo', 'hi', 50)} AS bin, lo, hi FROM lineitem, b
      WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 50), 4) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 50), 4) AS bin_hi,
       count(*) AS count FROM h GROUP BY bin, lo, hi""")
def _histogram(t: Tables):
    return charts.histogram(t.lineitem, "l_extendedprice")


@register("scatter_trend", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 4) AS r2,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def _scatter_trend(t: Tables):
    return charts.scatter_trend(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@register("scatter_bins", f"""
WITH b AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
                  min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem)
SELECT {_bin_sql('l_quantity', 'xl', 'xh', 50)} AS x_bin, {_bin_sql('l_extendedprice', 'yl', 'yh', 50)} AS y_bin,
       count(*) AS count
FROM lineitem, b WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1, 2""")
def _scatter_bins(t: Tables):
    return charts.scatter_bins(t.lineitem, "l_quantity", "l_extendedprice")


@register("box_stats", """
WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                  quantile_cont(o_totalprice, 0.75) AS q3, count(o_totalprice) AS n,
                  min(o_totalprice) AS mn, max(o_totalprice) AS mx
           FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderstatus),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.o_orderstatus, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
       round(lf, 4) AS lower_fence, round(uf, 4) AS upper_fence,
       round(min(CASE WHEN o_totalprice BETWEEN lf AND uf THEN o_totalprice END), 4) AS whisker_low,
       round(max(CASE WHEN o_totalprice BETWEEN lf AND uf THEN o_totalprice END), 4) AS whisker_high,
       round(mn, 4) AS min, round(mx, 4) AS max, n,
       count(CASE WHEN NOT (o_totalprice BETWEEN lf AND uf) THEN 1 END) AS n_outliers
FROM f JOIN orders o ON o.o_orderstatus = f.o_orderstatus AND o.o_totalprice IS NOT NULL
GROUP BY f.o_orderstatus, q1, median, q3, iqr, lf, uf, mn, mx, n""")
def _box_stats(t: Tables):
    return charts.box_stats(t.orders, "o_totalprice", "o_orderstatus")


@register("bar_topn_mean", """
SELECT l_partkey, round(avg(l_extendedprice), 4) AS mean_y, round(sum(l_extendedprice), 2) AS sum_y,
       count(l_extendedprice) AS count
FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey HAVING count(l_extendedprice) > 0
ORDER BY mean_y DESC, l_partkey LIMIT 10""")
def _bar_topn_mean(t: Tables):
    """The minimum slice: top 10 parts by mean price."""
    return charts.bar_top_n(t.lineitem, "l_partkey", "l_extendedprice", 10)


@register("bar_topn_count", """
SELECT o_custkey, count(*) AS count FROM orders WHERE o_custkey IS NOT NULL
GROUP BY o_custkey ORDER BY count DESC, o_custkey LIMIT 10""")
def _bar_topn_count(t: Tables):
    return charts.bar_top_n(t.orders, "o_custkey", None, 10)


@register("topn_restrict", """
WITH top AS (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey
             HAVING count(l_extendedprice) > 0
             ORDER BY round(avg(l_extendedprice), 4) DESC, l_partkey LIMIT 10)
SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM top)""")
def _topn_restrict(t: Tables):
    return charts.restrict_to_top(t.lineitem, "l_partkey", "l_extendedprice", 10)


@register("heatmap", _corr_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], 2))
def _heatmap(t: Tables):
    return charts.heatmap(t.customer)


_PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair_sql() -> str:
    b = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(_PAIR_COLS))
    parts = []
    for i, a in enumerate(_PAIR_COLS):
        for j, c in enumerate(_PAIR_COLS):
            if j > i:
                parts.append(
                    f"SELECT '{a}' AS x_col, '{c}' AS y_col, {_bin_sql(a, f'lo{i}', f'hi{i}', 20)} AS x_bin, "
                    f"{_bin_sql(c, f'lo{j}', f'hi{j}', 20)} AS y_bin FROM lineitem, b "
                    f"WHERE {a} IS NOT NULL AND {c} IS NOT NULL")
    return (f"WITH b AS (SELECT {b} FROM lineitem)\nSELECT x_col, y_col, x_bin, y_bin, count(*) AS count FROM (\n"
            + "\nUNION ALL\n".join(parts) + "\n) GROUP BY 1, 2, 3, 4")


@register("pair_bins", _pair_sql())
def _pair_bins(t: Tables):
    return charts.pair_bins(t.lineitem, _PAIR_COLS, 20)


@register("line_series", """
SELECT date_trunc('day', ts) AS ts, event_type, round(avg(value), 4) AS mean_y, min(value) AS min_y,
       max(value) AS max_y, count(value) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def _line_series(t: Tables):
    return charts.line_series(t.events, "ts", "value", "event_type", "day")


@register("pie_topn", """
WITH v AS (SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL
           GROUP BY 1 ORDER BY count DESC, o_orderpriority LIMIT 3)
SELECT o_orderpriority, count, round(count / sum(count) OVER (), 4) AS share FROM v""")
def _pie_topn(t: Tables):
    return charts.pie_top_n(t.orders, "o_orderpriority", 3)


@register("violin_density", """
WITH v AS (SELECT event_type, value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
s AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM v GROUP BY 1),
s2 AS (SELECT *, 0.9 * (CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END) * power(CAST(n AS DOUBLE), -0.2) AS bw FROM s),
c AS (SELECT v.event_type, CASE WHEN hi - lo > 0 THEN least(CAST(floor((value - lo) / (hi - lo) * 512) AS INTEGER), 511) ELSE 0 END AS cell,
             count(*) AS cnt FROM v JOIN s2 USING (event_type) GROUP BY 1, 2),
cc AS (SELECT c.*, lo + (cell + 0.5) * (hi - lo) / 512 AS center, n, lo, hi, bw FROM c JOIN s2 USING (event_type)),
g AS (SELECT event_type, CAST(j AS INTEGER) AS grid_point, lo + j * ((hi - lo) / 511) AS x, n, bw
      FROM s2, range(512) r(j))
SELECT g.event_type, grid_point, round(x, 6) AS x,
       round(sum(cnt * exp(-0.5 * ((x - center) / g.bw) * ((x - center) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())), 8) AS density
FROM g JOIN cc ON g.event_type = cc.event_type GROUP BY g.event_type, grid_point, x, g.n, g.bw""")
def _violin_density(t: Tables):
    return charts.violin_density(t.events, "value", "event_type")


# ------------------------------------------------------------- profile (P)

from tablelens.functions.text import NON_WORD_NON_SPACE, NUMBER_RE, WS_RUN  # noqa: E402
from tablelens.operators import cleaning, profile, temporal  # noqa: E402

_LI_NUM = _CORR_COLS


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("describe", _union([
    f"SELECT '{c}' AS column, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, "
    f"round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(min(CAST({c} AS DOUBLE)), 4) AS min, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, round(max(CAST({c} AS DOUBLE)), 4) AS max FROM lineitem"
    for c in _LI_NUM]))
def _describe(t: Tables):
    """P1, the flagship: describe() of every numeric column of lineitem."""
    return profile.describe(t.lineitem)


# DuckDB type names and the Spark names the schema listing uses.
_SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
               "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "FLOAT": "float", "DATE": "date"}


@register("schema_profile", """
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column",
       CASE data_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SPARK_TYPE.items()) + """ END AS dtype,
       (SELECT count(*) FROM orders) AS rows,
       CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders') AS INTEGER) AS columns
FROM information_schema.columns WHERE table_name = 'orders'""")
def _schema_profile(t: Tables):
    return profile.schema_profile(t.orders)


def _summary_sql() -> str:
    cols = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
            ("o_orderdate", "ts"), ("o_orderpriority", "str")]
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    parts = []
    for c, k in cols:
        num = [f"round(min(CAST({c} AS DOUBLE)), 4)", f"round(max(CAST({c} AS DOUBLE)), 4)",
               f"round(avg(CAST({c} AS DOUBLE)), 4)", f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4)"] \
            if k == "num" else ["CAST(NULL AS DOUBLE)"] * 4
        us = f"CAST(epoch_us({c}) AS DOUBLE)"
        ts = [f"make_timestamp(CAST(floor(min({us})) AS BIGINT))", f"make_timestamp(CAST(floor(max({us})) AS BIGINT))",
              f"make_timestamp(CAST(floor(avg({us})) AS BIGINT))",
              f"make_timestamp(CAST(floor(quantile_cont({us}, 0.5)) AS BIGINT))"] \
            if k == "ts" else ["CAST(NULL AS TIMESTAMP)"] * 4
        parts.append(
            f"SELECT '{c}' AS column, '{types[c]}' AS dtype, count(DISTINCT {c}) AS distinct_count, "
            f"count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, "
            f"{num[0]} AS min_value, {num[1]} AS max_value, {num[2]} AS mean_value, {num[3]} AS median_value, "
            f"{ts[0]} AS min_time, {ts[1]} AS max_time, {ts[2]} AS mean_time, {ts[3]} AS median_time FROM orders")
    return _union(parts)


@register("column_summary", _summary_sql())
def _column_summary(t: Tables):
    return profile.column_summary(t.orders)


@register("write_profile", _summary_sql())
def _write_profile(t: Tables):
    """The column summary written as parquet to the shared folder and
    read back."""
    from tablelens.sources.sinks import write_profile
    path = write_profile(profile.column_summary(t.orders), "orders")
    return t.spark.read.parquet(path)


@register("top_values", """
WITH long AS (SELECT 'p_name' AS column, p_name AS value FROM part UNION ALL
              SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part),
vc AS (SELECT "column", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank
               FROM vc) WHERE rank <= 10""")
def _top_values(t: Tables):
    return profile.top_values(t.part)


_GAP_MID_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("missing_report", with_derived(_union([
    f"SELECT '{c}' AS column, count(*) - count({c}) AS missing_count FROM part_gap_mid HAVING count(*) - count({c}) > 0"
    for c in _GAP_MID_COLS]), "part_gap_mid"))
def _missing_report(t: Tables):
    return profile.missing_report(fx.part_gap_mid(t))


def _profile_numeric_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        q = lambda p: f"quantile_cont({x}, {p})"
        parts.append(
            f"SELECT '{c}' AS column, count({x}) AS count, count(*) - count({x}) AS missing, round(avg({x}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS std, round(var_samp({x}), 4) AS variance, round(sum({x}), 4) AS sum, "
            f"round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(max({x}) - min({x}), 4) AS range, "
            f"round({q(0.05)}, 4) AS p5, round({q(0.25)}, 4) AS p25, round({q(0.5)}, 4) AS p50, round({q(0.75)}, 4) AS p75, "
            f"round({q(0.95)}, 4) AS p95, round({q(0.75)} - {q(0.25)}, 4) AS iqr, "
            f"round(CASE WHEN avg({x}) <> 0 THEN stddev_samp({x}) / avg({x}) END, 4) AS cv, "
            f"round(CASE WHEN count({x}) >= 3 THEN skewness({x}) END, 4) AS skewness, "
            f"round(CASE WHEN count({x}) >= 4 THEN kurtosis({x}) END, 4) AS kurtosis, "
            f"count(CASE WHEN {x} = 0 THEN 1 END) AS zeros, count(CASE WHEN {x} < 0 THEN 1 END) AS negatives, "
            f"count(DISTINCT {x}) AS distinct, round(count(DISTINCT {x}) * 100.0 / count({x}), 2) AS distinct_pct, "
            f"count(DISTINCT {x}) = count({x}) AND count({x}) > 0 AS is_unique FROM {table}")
    return _union(parts)


@register("profile_numeric", _profile_numeric_sql("lineitem", _LI_NUM))
def _profile_numeric(t: Tables):
    return profile.profile_numeric(t.lineitem)


@register("profile_string", _union([
    f"SELECT '{c}' AS column, count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct, "
    f"round(count(DISTINCT {c}) * 100.0 / count({c}), 2) AS distinct_pct, "
    f"count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AS is_unique, CAST(min(length({c})) AS INTEGER) AS min_length, "
    f"round(avg(length({c})), 4) AS mean_length, CAST(max(length({c})) AS INTEGER) AS max_length FROM part"
    for c in ["p_name", "p_brand", "p_type"]]))
def _profile_string(t: Tables):
    return profile.profile_string(t.part)


def _alerts_sql() -> str:
    src = "(SELECT *, 2.0 AS constant_col FROM part_gap_mid)"
    kinds = {"p_partkey": "num", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "num",
             "p_retailprice": "num", "constant_col": "num"}
    parts = []
    for c, k in kinds.items():
        base = (f"SELECT '{c}' AS column, count(*) AS rows_, count({c}) AS n, count(DISTINCT {c}) AS d"
                + (f", count(CASE WHEN {c} = 0 THEN 1 END) AS z, CASE WHEN count({c}) >= 3 THEN skewness(CAST({c} AS DOUBLE)) END AS sk"
                   if k == "num" else ", NULL AS z, NULL AS sk") + f" FROM {src}")
        rules = [("CONSTANT", "d = 1", "CAST(d AS DOUBLE)"),
                 ("UNIQUE", "d = n AND n > 1", "CAST(d AS DOUBLE)"),
                 ("MISSING", "(rows_ - n) * 1.0 / rows_ > 0 AND (rows_ - n) * 1.0 / rows_ <= 0.5", "(rows_ - n) * 1.0 / rows_"),
                 ("MOSTLY_MISSING", "(rows_ - n) * 1.0 / rows_ > 0.5", "(rows_ - n) * 1.0 / rows_")]
        if k == "num":
            rules += [("ZEROS", "z * 1.0 / n > 0.05", "z * 1.0 / n"), ("SKEWED", "abs(sk) > 20", "sk")]
        else:
            rules.append(("HIGH_CARDINALITY", "d > 50", "CAST(d AS DOUBLE)"))
        for a, cond, val in rules:
            parts.append(f"SELECT \"column\", '{a}' AS alert, round({val}, 4) AS value FROM ({base}) WHERE coalesce({cond}, false)")
    return with_derived(_union(parts), "part_gap_mid")


@register("quality_alerts", _alerts_sql())
def _quality_alerts(t: Tables):
    return profile.quality_alerts(fx.part_gap_mid(t).withColumn("constant_col", F.lit(2.0)))


@register("duplicate_rows", with_derived("""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM doc_dedupe)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM doc_dedupe)) AS duplicate_rows
FROM doc_dedupe""", "doc_dedupe"))
def _duplicate_rows(t: Tables):
    return profile.duplicate_rows(fx.doc_dedupe(t))


@register("outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT events.* FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _outliers_iqr(t: Tables):
    return profile.outliers_iqr(t.events, "value")


@register("outliers_zscore", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT events.* FROM events, s WHERE abs(value - m) / sd > 3""")
def _outliers_zscore(t: Tables):
    return profile.outliers_zscore(t.events, "value")


def _recommendations_sql() -> str:
    r = {no: (kind, prio, desc, sug) for no, kind, prio, desc, sug in profile.RECOMMENDATION_RULES}
    q = lambda x: x.replace("'", "''")
    fill = {"cat": "p_name", "num": "p_partkey"}
    miss = " + ".join(f"(count(*) - count({c}) > 0)::INT" for c in _GAP_MID_COLS)
    d1 = q(r[1][2]).replace("{n}", "' || CAST(m AS VARCHAR) || '")
    parts = [f"SELECT 1 AS rule_no, '{r[1][0]}' AS type, '{r[1][1]}' AS priority, '{d1}' AS description, "
             f"'{q(r[1][3])}' AS suggestion FROM (SELECT {miss} AS m FROM part_gap_mid) WHERE m > 0"]
    for no in (2, 3, 4):  # 6 numeric+string columns, no date/time name, not > 10 columns
        kind, prio, desc, sug = r[no]
        parts.append(f"SELECT {no}, '{kind}', '{prio}', '{q(desc)}', '{q(sug.format(**fill))}'")
    return with_derived("SELECT * FROM (\n" + "\nUNION ALL ".join(parts) + "\n)", "part_gap_mid")


@register("recommendations", _recommendations_sql())
def _recommendations(t: Tables):
    return profile.recommendations(fx.part_gap_mid(t))


@register("insight_digest")
def _insight_digest(t: Tables):
    """P8 over lineitem (rows-only: the relationship count needs p-values)."""
    return profile.insight_digest(t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))))


# ------------------------------------------------------------ temporal (T)

_PARSE_SQL = ("CAST(coalesce(try_strptime(trim({c}), '%Y-%m-%d %H:%M:%S'), try_strptime(trim({c}), '%Y-%m-%dT%H:%M:%S'), "
              "try_strptime(trim({c}), '%Y-%m-%d %H:%M'), try_strptime(trim({c}), '%Y-%m-%d'), "
              "try_strptime(trim({c}), '%Y/%m/%d'), try_strptime(trim({c}), '%m/%d/%Y')) AS TIMESTAMP)")


@register("to_datetime", with_derived(f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_PARSE_SQL.format(c='o_orderdate')} AS o_orderdate,
       o_orderpriority FROM orders_dirty_date""", "orders_dirty_date"))
def _to_datetime(t: Tables):
    return temporal.to_datetime(fx.orders_dirty_date(t), "o_orderdate", "coerce")


@register("datetime_features", """
SELECT event_id, ts, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
       CAST(day(ts) AS INTEGER) AS ts_day, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute,
       CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek, CAST(dayofyear(ts) AS INTEGER) AS ts_dayofyear,
       CAST(weekofyear(ts) AS INTEGER) AS ts_weekofyear, CAST(quarter(ts) AS INTEGER) AS ts_quarter FROM events""")
def _datetime_features(t: Tables):
    return temporal.extract_datetime_features(t.events.select("event_id", "ts"), "ts")


# ------------------------------------------------------------ cleaning (C)

def _strategy_sql(name: str, cols: list[str]) -> str:
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return (f"SELECT '{name}' AS dataset, CAST({miss} AS BIGINT) AS missing_cells, CAST(count(*) * {len(cols)} AS BIGINT) AS total_cells, "
            f"round(({miss}) * 1.0 / (count(*) * {len(cols)}), 6) AS missing_share, "
            f"CASE WHEN ({miss}) * 1.0 / (count(*) * {len(cols)}) < 0.05 THEN 'drop' "
            f"WHEN ({miss}) * 1.0 / (count(*) * {len(cols)}) < 0.3 THEN 'knn' ELSE 'median' END AS strategy FROM {name}")


@register("missing_strategy", with_derived(_union([
    _strategy_sql("part_gap_low", _GAP_MID_COLS), _strategy_sql("part_gap_mid", _GAP_MID_COLS),
    _strategy_sql("part_gap_high", ["p_partkey", "p_size", "p_retailprice"])]),
    "part_gap_low", "part_gap_mid", "part_gap_high"))
def _missing_strategy(t: Tables):
    out = None
    for name, frame in (("part_gap_low", fx.part_gap_low(t)), ("part_gap_mid", fx.part_gap_mid(t)),
                        ("part_gap_high", fx.part_gap_high(t))):
        s = cleaning.missing_strategy(frame).select(F.lit(name).alias("dataset"), "*")
        out = s if out is None else out.unionByName(s)
    return out


@register("impute_drop", with_derived("""
SELECT * FROM part_gap_low WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_brand IS NOT NULL
  AND p_type IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL""", "part_gap_low"))
def _impute_drop(t: Tables):
    return cleaning.impute_drop(fx.part_gap_low(t))


def _simple_sql(stat: str) -> str:
    def s(c):
        if stat == "mean":
            return f"(SELECT avg(CAST({c} AS DOUBLE)) FROM part_gap_high)"
        if stat == "median":
            return f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM part_gap_high)"
        return (f"(SELECT CAST({c} AS DOUBLE) FROM part_gap_high WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) DESC, {c} LIMIT 1)")
    cols = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), {s(c)}), 4) AS {c}"
                     for c in ["p_partkey", "p_size", "p_retailprice"])
    return with_derived(f"SELECT {cols} FROM part_gap_high", "part_gap_high")


def _rounded(df: DataFrame, cols: list[str], nd: int = 4) -> DataFrame:
    return df.select(*[F.round(c, nd).alias(c) if c in cols else F.col(c) for c in df.columns])


for _stat in ("mean", "median", "mode"):
    def _mk(stat):
        @register(f"impute_{stat}", _simple_sql(stat))
        def _f(t: Tables):
            out = cleaning.impute_simple(fx.part_gap_high(t), stat)
            return _rounded(out, ["p_partkey", "p_size", "p_retailprice"])
        return _f
    _mk(_stat)


@register("impute_constant", with_derived("""
SELECT p_partkey, p_name, p_brand, p_type, coalesce(p_size, 0) AS p_size, p_retailprice FROM part_gap_low""",
                                          "part_gap_low"))
def _impute_constant(t: Tables):
    return cleaning.impute_constant(fx.part_gap_low(t), 0)


@register("dedupe", with_derived("SELECT DISTINCT text, lang FROM doc_dedupe", "doc_dedupe"))
def _dedupe(t: Tables):
    return cleaning.remove_duplicates(fx.doc_dedupe(t))


_NUM_SQL = "CASE WHEN regexp_matches({c}, '" + NUMBER_RE.replace("\\", "\\") + "') THEN CAST(trim({c}) AS DOUBLE) END"


@register("coerce_numeric", with_derived(f"""
SELECT p_partkey, p_name, p_brand, p_type, {_NUM_SQL.format(c='p_size')} AS p_size, p_retailprice
FROM part_dirty_num""", "part_dirty_num"))
def _coerce_numeric(t: Tables):
    return cleaning.coerce_numeric(fx.part_dirty_num(t))


@register("coerce_datetime", with_derived(f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_PARSE_SQL.format(c='o_orderdate')} AS o_orderdate,
       o_orderpriority FROM orders_dirty_date""", "orders_dirty_date"))
def _coerce_datetime(t: Tables):
    return cleaning.coerce_datetime(fx.orders_dirty_date(t))


@register("correct_types", with_derived(f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_PARSE_SQL.format(c='o_orderdate')} AS o_orderdate,
       o_orderpriority FROM orders_dirty_date""", "orders_dirty_date"))
def _correct_types(t: Tables):
    return cleaning.correct_data_types(fx.orders_dirty_date(t))


def _type_changes_sql() -> str:
    parts = []
    for c in ["p_name", "p_brand", "p_type", "p_size"]:
        num = f"count(CASE WHEN regexp_matches({c}, '{NUMBER_RE}') THEN 1 END)"
        dt = f"count({_PARSE_SQL.format(c=c)})"
        parts.append(
            f"SELECT '{c}' AS column, CASE WHEN {num} > 0 THEN 'numeric' WHEN {dt} > 0 THEN 'datetime' "
            f"WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.5 THEN 'category' END AS change FROM part_dirty_num")
    return with_derived(f"SELECT * FROM ({_union(parts)}) WHERE change IS NOT NULL", "part_dirty_num")


@register("type_changes", _type_changes_sql())
def _type_changes(t: Tables):
    return cleaning.type_changes(fx.part_dirty_num(t))


@register("category_columns", _union([
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_count, count(*) AS rows, "
    f"round(count(DISTINCT {c}) * 1.0 / count(*), 6) AS ratio, count(DISTINCT {c}) * 1.0 / count(*) < 0.5 AS is_category FROM part"
    for c in ["p_name", "p_brand", "p_type"]]))
def _category_columns(t: Tables):
    return cleaning.category_columns(t.part)


def _collapse_sql() -> str:
    def coll(c):
        return (f"CASE WHEN {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM part_rare) <= 100 "
                f"AND count(*) OVER (PARTITION BY {c}) * 1.0 / count(*) OVER () < 0.05 THEN 'Other' ELSE {c} END AS {c}")
    return with_derived(f"SELECT p_partkey, {coll('p_name')}, {coll('p_brand')}, {coll('p_type')}, p_size, p_retailprice "
                        f"FROM part_rare", "part_rare")


@register("collapse_rare", _collapse_sql())
def _collapse_rare(t: Tables):
    return cleaning.collapse_rare(fx.part_rare(t))


def _clean_sql(c: str) -> str:
    return (f"lower(trim(regexp_replace(regexp_replace({c}, '{NON_WORD_NON_SPACE}', '', 'g'), "
            f"'{WS_RUN}', ' ', 'g')))")


@register("clean_text", f"""
SELECT doc_id, {_clean_sql('text')} AS text, {_clean_sql('lang')} AS lang,
       {_clean_sql('source')} AS source, n_chars FROM documents""")
def _clean_text(t: Tables):
    return cleaning.clean_text(t.documents)


@register("auto_clean", f"""
SELECT doc_id, {_clean_sql('text')} AS text, lang, source, n_chars FROM documents""")
def _auto_clean(t: Tables):
    """C13 on documents: no gaps -> drop; no duplicates; lang and source
    become categories (so their text is kept); text is normalised."""
    return cleaning.auto_clean(t.documents, key="doc_id")


# ------------------------------------------------------ catalog and chat

import datetime as _dt  # noqa: E402

from tablelens.operators import chat  # noqa: E402
from tablelens.sources import catalog as cat  # noqa: E402

_FIRST_BATCH = ["region", "nation", "customer", "supplier", "part"]
_T0, _T1 = _dt.datetime(2024, 1, 1), _dt.datetime(2024, 1, 2)
_NCOLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
          "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


def _catalog_candidates(t: Tables, names: list[str]) -> DataFrame:
    out = None
    for n in names:
        d = cat.describe_file(getattr(t, n), f"{n}.parquet", f"table {n}")
        out = d if out is None else out.unionByName(d)
    return out


def _catalog(t: Tables) -> DataFrame:
    """Catalog of the fixture tables: five recorded first, then all
    fourteen (the five already present keep their ids)."""
    cand = _catalog_candidates(t, list(fx.TABLES)).cache()  # 14 metadata rows
    first = cand.filter(F.col("file_name").isin([f"{n}.parquet" for n in _FIRST_BATCH]))
    c0 = cat.record_datasets(cat.empty_catalog(t.spark), first, _T0)
    return cat.record_datasets(c0, cand, _T1)


def _catalog_sql() -> str:
    parts = [f"SELECT '{n}.parquet' AS file_name, (SELECT count(*) FROM {n}) AS rows, {_NCOLS[n]} AS columns, "
             f"'table {n}' AS description, {1 if n in _FIRST_BATCH else 2} AS batch" for n in fx.TABLES]
    return ("WITH t AS (" + _union(parts) + "),\ncatalog AS (SELECT CAST(row_number() OVER (PARTITION BY batch ORDER BY file_name) "
            "+ CASE WHEN batch = 1 THEN 0 ELSE 5 END AS BIGINT) AS dataset_id, file_name, "
            "CASE WHEN batch = 1 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS upload_time, "
            "CAST(rows AS BIGINT) AS rows, CAST(columns AS INTEGER) AS columns, description FROM t)\n")


@register("catalog_record", _catalog_sql() + "SELECT * FROM catalog")
def _catalog_record(t: Tables):
    return _catalog(t)


@register("catalog_history", _catalog_sql() + "SELECT * FROM catalog ORDER BY dataset_id")
def _catalog_history(t: Tables):
    return cat.history(_catalog(t))


@register("catalog_by_id", _catalog_sql() + "SELECT * FROM catalog WHERE dataset_id = 3")
def _catalog_by_id(t: Tables):
    return cat.by_id(_catalog(t), 3)


@register("recall_like", _catalog_sql()
          + "SELECT * FROM catalog WHERE contains(lower(file_name), 'line') ORDER BY dataset_id LIMIT 1")
def _recall_like(t: Tables):
    return cat.recall(_catalog(t), file_name="line")


@register("dataset_listing", _catalog_sql()
          + "SELECT dataset_id, regexp_replace(file_name, '\\.[^.]*$', '') AS name, rows, columns, "
            "dataset_id = 12 AS is_current FROM catalog")
def _dataset_listing(t: Tables):
    return cat.listing(_catalog(t), current_id=12)


_LOG_SQL = ("SELECT conv_id, turn AS id, role, text AS content, "
            "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn) AS timestamp FROM conversations")


@register("chat_load", _LOG_SQL)
def _chat_load(t: Tables):
    return chat.load_history(chat.chat_log_from_turns(t.conversations))


@register("last_n_messages", f"""
SELECT conv_id, id, role, content, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY timestamp DESC, id DESC) AS rn FROM ({_LOG_SQL}))
WHERE rn <= 3""")
def _last_n_messages(t: Tables):
    return chat.last_n_messages(chat.chat_log_from_turns(t.conversations), 3)


@register("dialogue_messages", f"""
SELECT conv_id, id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS role, content, timestamp
FROM ({_LOG_SQL}) WHERE role IN ('user', 'assistant')""")
def _dialogue_messages(t: Tables):
    return chat.dialogue_messages(chat.chat_log_from_turns(t.conversations))


# Prompts that reach every intent, added to the conversation messages because
# the fixture text is invented words.
EXAMPLE_PROMPTS = (
    "please list datasets", "switch to harvest data", "could you use the rainfall table", "/profile", " /insights ", "/help", "/reset",
    "which columns move together?", "a histogram of heights, please", "draw a pie of the regions",
    "Switch to orchard data and count the trees", "use old notes then switch to sales", "go to the last dataset",
    "work with  soil.csv", "because of the paragraph", "open my file and then load wells", "show datasets and plot the newest",
)


def _messages(t: Tables) -> DataFrame:
    log = chat.chat_log_from_turns(t.conversations)
    ex = t.spark.createDataFrame([(-1, i, "user", p) for i, p in enumerate(EXAMPLE_PROMPTS)],
                                 "conv_id long, turn long, role string, text string")
    return log.unionByName(chat.chat_log_from_turns(ex))


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _intents_sql() -> str:
    ex = _union([f"SELECT -1 AS conv_id, {i} AS turn, 'user' AS role, '{p.replace(chr(39), chr(39) * 2)}' AS text"
                 for i, p in enumerate(EXAMPLE_PROMPTS)])
    msgs = (f"SELECT conv_id, CAST(turn AS BIGINT) AS id, role, text AS content, "
            f"TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn) AS timestamp FROM "
            f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL {ex})")
    low = "lower(content)"
    # the eight phrases one after another: the word after the phrase, unless it is a stop word
    tries = [f"regexp_extract({low}, '(?:^|[^\\p{{L}}\\p{{N}}_]){p} (.+?)(?:[ \\t\\n]|$)', 1)"
             for p in ("switch to", "use", "load", "change to", "open", "analyze", "work with", "go to")]
    stop = "('the', 'my', 'dataset', 'data', 'file', 'table', 'previous', 'old', 'new', 'last', '')"
    target = "coalesce(" + ", ".join(f"CASE WHEN trim({e}) NOT IN {stop} THEN trim({e}) END" for e in tries) + ")"
    follow = f"trim(regexp_extract({low}, '{chat.FOLLOW_RE}', 1))"
    has = f"regexp_matches({low}, '{chat.SWITCH_RE}')"
    listing = " OR ".join(f"contains({low}, '{p}')" for p in chat.LIST_PHRASES)
    return (f"SELECT conv_id, id, role, content, timestamp, "
            f"CASE WHEN list_contains({_sql_list(chat.COMMANDS)}, trim({low})) THEN trim({low}) END AS command, "
            f"{target} AS switch_target, "
            f"CASE WHEN {has} AND length({follow}) > 3 THEN {follow} END AS follow_up, "
            f"({listing}) AS list_intent, regexp_matches({low}, '{chat.PLOT_RE}') AS plot_intent "
            f"FROM ({msgs})")


@register("chat_intents", _intents_sql())
def _chat_intents(t: Tables):
    return chat.message_intents(_messages(t))


# ------------------------------------------------------------------- KNN

from tablelens.operators.knn import impute_knn  # noqa: E402

_KNN_SQL = with_derived("""
, d AS (SELECT p_partkey AS k, CAST(p_partkey AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2
        FROM part_gap_mid),
pairs AS (
  SELECT r.k AS rk, o.k AS dk, r.x1 IS NULL AS m1, r.x2 IS NULL AS m2, o.x1 AS v1, o.x2 AS v2,
    CASE WHEN c > 0 THEN sq * 3 / c END AS d2
  FROM (SELECT r.k AS rk0, o.k AS dk0,
          (coalesce((r.x0 - o.x0) * (r.x0 - o.x0), 0) + coalesce((r.x1 - o.x1) * (r.x1 - o.x1), 0))
            + coalesce((r.x2 - o.x2) * (r.x2 - o.x2), 0) AS sq,
          (r.x0 IS NOT NULL AND o.x0 IS NOT NULL)::INT + (r.x1 IS NOT NULL AND o.x1 IS NOT NULL)::INT
            + (r.x2 IS NOT NULL AND o.x2 IS NOT NULL)::INT AS c
        FROM d r, d o WHERE (r.x1 IS NULL OR r.x2 IS NULL)) p
  JOIN d r ON r.k = p.rk0 JOIN d o ON o.k = p.dk0),
c1 AS (SELECT rk, v1 AS v, d2, row_number() OVER (PARTITION BY rk ORDER BY d2 NULLS LAST, dk) AS rn
       FROM pairs WHERE m1 AND v1 IS NOT NULL),
c2 AS (SELECT rk, v2 AS v, d2, row_number() OVER (PARTITION BY rk ORDER BY d2 NULLS LAST, dk) AS rn
       FROM pairs WHERE m2 AND v2 IS NOT NULL),
i1 AS (SELECT rk, CASE WHEN min(d2) IS NULL THEN (SELECT avg(x1) FROM d) ELSE avg(v) END AS v FROM c1 WHERE rn <= 5 GROUP BY rk),
i2 AS (SELECT rk, CASE WHEN min(d2) IS NULL THEN (SELECT avg(x2) FROM d) ELSE avg(v) END AS v FROM c2 WHERE rn <= 5 GROUP BY rk)
SELECT CAST(p.p_partkey AS DOUBLE) AS p_partkey, p.p_name, p.p_brand, p.p_type,
       round(coalesce(CAST(p.p_size AS DOUBLE), i1.v), 4) AS p_size,
       round(coalesce(p.p_retailprice, i2.v), 4) AS p_retailprice
FROM part_gap_mid p LEFT JOIN i1 ON i1.rk = p.p_partkey LEFT JOIN i2 ON i2.rk = p.p_partkey""", "part_gap_mid")
_KNN_SQL = _KNN_SQL.replace(")\n\n, d AS", "),\nd AS").replace(")\n, d AS", "),\nd AS")


@register("impute_knn", _KNN_SQL)
def _impute_knn(t: Tables):
    out = impute_knn(fx.part_gap_mid(t), key="p_partkey", k=5)
    return _rounded(out, ["p_size", "p_retailprice"])


# ------------------------------------------------------ Q-Q (G10) and vectors

from tablelens.functions import special  # noqa: E402
from tablelens.operators import qq as qqmod  # noqa: E402
from tablelens.operators import retrieval  # noqa: E402


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}) * {x} + ({c!r})"
    return acc


def _probit_sql(p: str) -> str:
    ql = f"sqrt(-2.0 * ln({p}))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    lower = f"({_horner_sql(special.ACKLAM_C, ql)}) / (({_horner_sql(special.ACKLAM_D, ql)}) * {ql} + 1.0)"
    upper = f"-({_horner_sql(special.ACKLAM_C, qh)}) / (({_horner_sql(special.ACKLAM_D, qh)}) * {qh} + 1.0)"
    central = f"({_horner_sql(special.ACKLAM_A, r)}) * {q} / (({_horner_sql(special.ACKLAM_B, r)}) * {r} + 1.0)"
    return (f"CASE WHEN {p} < {special.ACKLAM_LOW} THEN {lower} WHEN {p} > {1.0 - special.ACKLAM_LOW} THEN {upper} "
            f"ELSE {central} END")


_FILL = ("CASE WHEN rank = n THEN power(0.5, 1.0 / n) WHEN rank = 1 THEN 1.0 - power(0.5, 1.0 / n) "
         "ELSE (rank - 0.3175) / (n + 0.365) END")
_QQ_RANKED = """
WITH v AS (SELECT CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT value, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () AS n FROM v),
p AS (SELECT *, """ + _FILL + """ AS prob FROM r)"""


@register("qq_positions", _QQ_RANKED + """,
f AS (SELECT value, min(rank) AS rank, count(*) AS count FROM p GROUP BY value)
SELECT CAST(f.rank AS BIGINT) AS rank, f.count, f.value, round(prob, 8) AS prob,
       round(""" + _probit_sql("prob") + """, 6) AS theoretical
FROM f JOIN p ON p.rank = f.rank""")
def _qq_positions(t: Tables):
    return qqmod.qq_positions(t.events, "value")


@register("qq_fit", _QQ_RANKED + """
SELECT count(*) AS n, round(regr_slope(value, x), 4) AS slope, round(regr_intercept(value, x), 4) AS intercept,
       round(corr(x, value), 4) AS r
FROM (SELECT value, """ + _probit_sql("prob") + """ AS x FROM p)""")
def _qq_fit(t: Tables):
    return qqmod.qq_fit(t.events, "value")


@register("vector_topk", """
WITH c AS (SELECT label, list(m ORDER BY i) AS q FROM (
             SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i)
             WHERE i <= len(embedding) GROUP BY label, i) GROUP BY label),
s AS (SELECT CAST(c.label AS BIGINT) AS qid, e.vec_id,
             list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.q) AS score FROM c, embeddings e)
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def _vector_topk(t: Tables):
    """For each label's centroid, the 5 most similar embeddings."""
    emb = t.embeddings
    cent = retrieval.label_centroids(emb).withColumnRenamed("label", "qid")
    hits = retrieval.top_k(emb, cent, k=5)
    return hits.withColumn("score", F.round("score", 4))


@register("vector_topk_rows", """
WITH s AS (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
           FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def _vector_topk_rows(t: Tables):
    """Every row whose id is divisible by 100, against all rows."""
    emb = t.embeddings
    asked = emb.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return retrieval.top_k(emb, asked, k=10).withColumn("score", F.round("score", 4))


# -------------------------------------------------------------- sources

from tablelens.session import scratch_path  # noqa: E402
from tablelens.sources import files  # noqa: E402
from tablelens.sources.xlsx_writer import write_xlsx  # noqa: E402


@register("scan_csv", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""")
def _scan_csv(t: Tables):
    """Part written as CSV to the shared folder, scanned back with
    pandas-like typing (integers become bigint)."""
    path = files.write_csv(t.part, scratch_path(t.spark, "csv-part") + "/part.csv")
    return files.read_csv(t.spark, path)


@register("scan_csv_latin1", "SELECT conv_id, turn, role, text FROM conversations")
def _scan_csv_latin1(t: Tables):
    """Conversations written as latin1 CSV; the scanner sees invalid
    UTF-8 and re-reads as latin1, so accented text survives."""
    path = files.write_csv(t.conversations, scratch_path(t.spark, "csv-latin1") + "/conv.csv",
                           encoding="ISO-8859-1")
    return files.read_csv(t.spark, path, multiline=True)


@register("scan_csv_na", with_derived("""
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part_gap_mid""",
                                      "part_gap_mid"))
def _scan_csv_na(t: Tables):
    """S3: gaps written as the tokens NA / n/a; read back as nulls."""
    src = fx.part_gap_mid(t)
    tok = src.select("p_partkey", "p_name", "p_brand", "p_type",
                     F.coalesce(F.col("p_size").cast("string"), F.lit("NA")).alias("p_size"),
                     F.coalesce(F.col("p_retailprice").cast("string"), F.lit("n/a")).alias("p_retailprice"))
    path = files.write_csv(tok, scratch_path(t.spark, "csv-na") + "/gaps.csv")
    return files.read_csv(t.spark, path)


@register("scan_xlsx", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""")
def _scan_xlsx(t: Tables):
    """Part written as .xlsx workbooks (of bounded size, by every core) and scanned
    back through the binaryFile source, typed like a CSV scan."""
    tasks = max(4, t.spark.sparkContext.defaultParallelism)
    folder = write_xlsx(t.part.repartition(tasks), scratch_path(t.spark, "xlsx-part"))
    return files.read_excel(t.spark, folder)


# ---------------------------------------------------------- fuzzy lookup (L2)

from tablelens.operators.lookup import fuzzy_lookup  # noqa: E402


def _lookup_inputs(t: Tables):
    terms = (t.customer.select(F.col("c_mktsegment").alias("term"))
             .unionByName(t.part.select(F.col("p_type").alias("term")))
             .unionByName(t.nation.select(F.col("n_name").alias("term")))
             .unionByName(t.region.select(F.col("r_name").alias("term"))).distinct())
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("name_order"))
    return terms, names


@register("fuzzy_lookup", """
WITH terms AS (SELECT DISTINCT term FROM (SELECT c_mktsegment AS term FROM customer UNION ALL SELECT p_type FROM part
               UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)),
names AS (SELECT p_name AS name, min(p_partkey) AS name_order FROM part GROUP BY p_name),
p AS (SELECT term, name, name_order, lower(term) AS tl, lower(regexp_replace(name, '\\.[^.]*$', '')) AS nl
      FROM terms, names WHERE length(term) > 0),
q AS (SELECT *, CASE WHEN length(tl) <= length(nl) THEN tl ELSE nl END AS s,
                CASE WHEN length(tl) <= length(nl) THEN nl ELSE tl END AS t FROM p),
sc AS (SELECT term, name, name_order, contains(nl, tl) OR contains(tl, nl) AS c,
              CASE WHEN length(s) = 0 THEN 0.0 ELSE round(100.0 * (1 - list_min(list_transform(range(1, length(t) - length(s) + 2),
                   lambda i: levenshtein(s, substr(t, i, length(s))))) / length(s)), 2) END AS sc
       FROM q),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY c DESC,
                 CASE WHEN c THEN name_order END NULLS LAST, sc DESC, name_order) AS rn
                 FROM sc WHERE c OR sc > 60) WHERE rn = 1)
SELECT terms.term, best.name, best.name_order, CASE WHEN c THEN 100.0 ELSE sc END AS score,
       CASE WHEN c THEN 'contains' WHEN c IS NULL THEN NULL ELSE 'fuzzy' END AS method
FROM terms LEFT JOIN best ON best.term = terms.term""")
def _fuzzy_lookup(t: Tables):
    terms, names = _lookup_inputs(t)
    return fuzzy_lookup(terms, names)


# ------------------------------------------------------------ chart pack

from tablelens.operators.chart_pack import chart_pack_plan  # noqa: E402


@register("chart_pack_plan", """
SELECT * FROM (VALUES ('histogram', 'o_orderkey', NULL), ('box', 'o_orderkey', NULL), ('qq', 'o_orderkey', NULL),
  ('histogram', 'o_custkey', NULL), ('box', 'o_custkey', NULL), ('qq', 'o_custkey', NULL),
  ('histogram', 'o_totalprice', NULL), ('box', 'o_totalprice', NULL), ('qq', 'o_totalprice', NULL),
  ('bar', 'o_orderstatus', NULL), ('bar', 'o_orderpriority', NULL), ('heatmap', NULL, NULL), ('pairplot', NULL, NULL),
  ('line', 'o_orderdate', 'o_orderkey'), ('line', 'o_orderdate', 'o_custkey'), ('line', 'o_orderdate', 'o_totalprice'))
  AS v(chart, "column", column2)
UNION ALL SELECT 'pie', 'o_orderstatus', NULL WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders) <= 20
UNION ALL SELECT 'pie', 'o_orderpriority', NULL WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) <= 20""")
def _chart_pack_plan(t: Tables):
    return chart_pack_plan(t.orders)


# ------------------------------------------- missing values: NaN beside null

_NAN_NUM = ["value", "tax", "nothing"]


def _on_nan(sql: str) -> str:
    return with_derived(sql, "events_nan")


@register("describe_nan", _on_nan(_union([
    f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
    f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, "
    f"round(max({c}), 4) AS max FROM events_nan" for c in _NAN_NUM])))
def _describe_nan(t: Tables):
    return profile.describe(fx.events_nan(t))


@register("profile_numeric_nan", _on_nan(_profile_numeric_sql("events_nan", _NAN_NUM).replace("* 100.0 / count(", "* 100.0 / nullif(count(").replace("), 2) AS distinct_pct", "), 0), 2) AS distinct_pct")))
def _profile_numeric_nan(t: Tables):
    return profile.profile_numeric(fx.events_nan(t))


@register("corr_matrix_nan", _on_nan(_corr_sql("events_nan", _NAN_NUM, 4)))
def _corr_matrix_nan(t: Tables):
    return relations.corr_matrix(fx.events_nan(t))


@register("anova_nan", "WITH events_nan AS (" + fx.DERIVED_SQL["events_nan"] + ")," + _ANOVA_SQL.format(name="events_nan") + "\nSELECT * FROM events_nan_r")
def _anova_nan(t: Tables):
    return relations.anova(fx.events_nan(t).select("event_type", "value")).select(
        F.lit("events_nan").alias("dataset"), "cat_col", "num_col", F.round("f_stat", 4).alias("f_stat"), "df_between", "df_within", "n_groups", "n")


@register("groupby_mean_nan", _on_nan("SELECT event_type, round(avg(value), 4) AS mean_value FROM events_nan WHERE event_type IS NOT NULL GROUP BY event_type"))
def _groupby_mean_nan(t: Tables):
    out = query.groupby_agg(fx.events_nan(t), "event_type", "value")
    return out.select("event_type", F.round("mean_value", 4).alias("mean_value"))


@register("distinct_nan", _on_nan(_union([f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct FROM events_nan" for c in ["event_type", *_NAN_NUM]])))
def _distinct_nan(t: Tables):
    return query.nunique(fx.events_nan(t))


@register("outliers_iqr_nan", _on_nan("""SELECT event_type, value FROM events_nan, (
SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_nan)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""))
def _outliers_iqr_nan(t: Tables):
    return profile.outliers_iqr(fx.events_nan(t), "value").select("event_type", "value")


@register("histogram_nan", _on_nan(f"""
SELECT bin, round(lo + bin * ((hi - lo) / 50), 4) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 50), 4) AS bin_hi, count(*) AS count
FROM (SELECT {_bin_sql('value', 'lo', 'hi', 50)} AS bin, lo, hi FROM events_nan, (SELECT min(value) AS lo, max(value) AS hi FROM events_nan)
      WHERE value IS NOT NULL) GROUP BY bin, lo, hi"""))
def _histogram_nan(t: Tables):
    return charts.histogram(fx.events_nan(t), "value")


@register("bar_topn_nan", _on_nan("""
SELECT event_type, round(avg(value), 4) AS mean_y, round(sum(value), 2) AS sum_y, count(value) AS count
FROM events_nan WHERE event_type IS NOT NULL GROUP BY event_type HAVING count(value) > 0 ORDER BY mean_y DESC, event_type LIMIT 3"""))
def _bar_topn_nan(t: Tables):
    return charts.bar_top_n(fx.events_nan(t), "event_type", "value", 3)


@register("pie_all", """
SELECT o_custkey, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""")
def _pie_all(t: Tables):
    """G9 without a limit: every value's share."""
    return charts.pie_top_n(t.orders, "o_custkey", None)


@register("impute_knn_nokey", _KNN_SQL)
def _impute_knn_nokey(t: Tables):
    """C5 without a key: ties go to the earlier row."""
    return _rounded(impute_knn(fx.part_gap_mid(t).orderBy("p_partkey")), ["p_size", "p_retailprice"])


from tablelens.plans import report_queries  # noqa: E402,F401
