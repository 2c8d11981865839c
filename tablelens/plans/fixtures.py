"""Inputs of the registered queries: the given tables and the derived inputs
of FIXTURES.md, built the same way in Spark and (``DERIVED_SQL``) in the
oracle SQL.  Derived inputs are lazy projections of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"


def part_gap_low(t: Tables) -> DataFrame:
    p = t.part
    return p.withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))


def part_gap_mid(t: Tables) -> DataFrame:
    return part_gap_low(t).withColumn(
        "p_retailprice", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")))


def part_gap_high(t: Tables) -> DataFrame:
    p = t.part
    return p.select("p_partkey",
                    F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("p_size"),
                    F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("p_retailprice"))


def part_dirty_num(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    size = (F.when(k % 11 == 0, F.lit("x"))
            .when(k % 101 == 1, F.lit("1d"))
            .when(k % 101 == 2, F.lit("1_000"))
            .when(k % 101 == 3, F.lit(" 12 "))
            .otherwise(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", size.alias("p_size"),
                         "p_retailprice")


def orders_dirty_date(t: Tables) -> DataFrame:
    o = t.orders
    d = F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("n/a"))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    d.alias("o_orderdate"), "o_orderpriority")


def part_rare(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.withColumn(
        "p_type", F.when(k % 40 == 0, F.concat(F.lit("RARE_"), (k % 3).cast("string"))).otherwise(F.col("p_type")))


def doc_dedupe(t: Tables) -> DataFrame:
    return t.documents.select("text", "lang")


def line_net(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select("l_extendedprice",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                     "l_quantity")


def events_plain(t: Tables) -> DataFrame:
    return t.events.select("event_type", "value")


def events_shift(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.when(F.col("event_type") == "click", F.col("value") + 50)
                           .otherwise(F.col("value")).alias("value"))


def events_nan(t: Tables) -> DataFrame:
    """NaN beside null: NaN at every fifth event, null at every seventh; ``tax``
    follows ``value`` but for its own NaNs, ``nothing`` has no value at all."""
    k = F.col("event_id")
    nan = F.lit(float("nan"))
    value = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, nan).otherwise(F.col("value"))
    tax = F.when(k % 3 == 0, nan).otherwise(F.col("value") * 0.1 + k % 11)
    return t.events.select("event_type", value.alias("value"), tax.alias("tax"), F.when(k % 2 == 0, nan).alias("nothing"))


def flags(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus")


def status_2x2(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_orderstatus") == "P").alias("is_pending"),
                           (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"))


# The same derived inputs as SQL (DuckDB dialect), used as CTEs by the oracle.
DERIVED_SQL = {
    "part_gap_low": """SELECT p_partkey, p_name, p_brand, p_type,
        CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size, p_retailprice FROM part""",
    "part_gap_mid": """SELECT p_partkey, p_name, p_brand, p_type,
        CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size,
        CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS p_retailprice FROM part""",
    "part_gap_high": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size,
        CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS p_retailprice FROM part""",
    "part_dirty_num": """SELECT p_partkey, p_name, p_brand, p_type,
        CASE WHEN p_partkey % 11 = 0 THEN 'x' WHEN p_partkey % 101 = 1 THEN '1d'
             WHEN p_partkey % 101 = 2 THEN '1_000' WHEN p_partkey % 101 = 3 THEN ' 12 '
             ELSE CAST(p_size AS VARCHAR) END AS p_size, p_retailprice FROM part""",
    "orders_dirty_date": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS o_orderdate,
        o_orderpriority FROM orders""",
    "part_rare": """SELECT p_partkey, p_name, p_brand,
        CASE WHEN p_partkey % 40 = 0 THEN 'RARE_' || CAST(p_partkey % 3 AS VARCHAR) ELSE p_type END AS p_type,
        p_size, p_retailprice FROM part""",
    "doc_dedupe": "SELECT text, lang FROM documents",
    "line_net": """SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_quantity FROM lineitem""",
    "events_plain": "SELECT event_type, value FROM events",
    "events_shift": """SELECT event_type, CASE WHEN event_type = 'click' THEN value + 50 ELSE value END AS value FROM events""",
    # a missing value is one thing here: NaN above is NULL
    "events_nan": """SELECT event_type, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN value END AS value,
        CASE WHEN event_id % 3 <> 0 THEN value * 0.1 + event_id % 11 END AS tax, CAST(NULL AS DOUBLE) AS nothing FROM events""",
    "flags": "SELECT l_returnflag, l_linestatus FROM lineitem",
    "status_2x2": """SELECT o_orderstatus = 'P' AS is_pending, o_orderpriority = '1-URGENT' AS is_urgent FROM orders""",
}


def with_derived(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named derived inputs."""
    ctes = ",\n".join(f"{n} AS ({DERIVED_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
