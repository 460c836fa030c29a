"""Inputs derived from the given tables, once in Spark and once as SQL text.

``orders`` is the real table of most fidelity queries; its synthetic partner is
every order redrawn with the counter-based numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mockloom.functions.rng import u32, uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_u32(seed, table: str, column: str, row: str) -> str:
    return f"(('0x' || substr(md5('{seed}|{table}|{column}|' || ({row})), 1, 8))::BIGINT)"


def sql_uniform(seed, table: str, column: str, row: str) -> str:
    return f"({sql_u32(seed, table, column, row)} / 4294967296.0::DOUBLE)"


def sql_normal(seed, table: str, column: str, row: str) -> str:
    a, b = sql_u32(seed, table, column + "#a", row), sql_u32(seed, table, column + "#b", row)
    return f"(sqrt(-2.0::DOUBLE * ln(({a} + 1) / 4294967297.0::DOUBLE)) * cos(6.283185307179586::DOUBLE * {b} / 4294967296.0::DOUBLE))"


def sql_pick(words: list[str], seed, table: str, column: str, row: str) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"([{listed}])[({sql_u32(seed, table, column, row)} % {len(words)} + 1)::INT]"


# --- orders and their synthetic partner ----------------------------------------

STATUSES = ["F", "O", "P", "F"]


def real_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    )


def synth_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    draw = lambda c: uniform(7, "orders", c, key)
    fresh: Column = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (u32(7, "orders", "pick", key) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        (F.floor(F.col("o_custkey") * draw("cust"))).cast("bigint").alias("o_custkey"),
        F.when(draw("null") >= 0.1, F.round(F.col("o_totalprice") * (0.8 + 0.4 * draw("price")), 2)).alias("o_totalprice"),
        F.when(draw("keep") < 0.8, F.col("o_orderstatus")).otherwise(fresh).alias("o_orderstatus"),
        "o_orderpriority",
    )


def _d(column: str) -> str:
    return sql_uniform(7, "orders", column, "o_orderkey")


ORDERS_PAIR = f"""
real_t AS (
  SELECT o_custkey, o_totalprice, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders
), synth_t AS (
  SELECT floor(o_custkey * {_d('cust')})::BIGINT AS o_custkey,
         CASE WHEN {_d('null')} >= 0.1 THEN round(o_totalprice * (0.8::DOUBLE + 0.4::DOUBLE * {_d('price')}), 2) END AS o_totalprice,
         CASE WHEN {_d('keep')} < 0.8 THEN o_orderstatus ELSE {sql_pick(STATUSES, 7, 'orders', 'pick', 'o_orderkey')} END AS o_orderstatus,
         o_orderpriority
  FROM orders
)"""


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return real_orders(spark, sf_dir), synth_orders(spark, sf_dir)


# --- lineitem by line status -----------------------------------------------------

LINE_COLUMNS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linenumber",
]


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    pick = lambda status: lines.filter(F.col("l_linestatus") == status).select(*LINE_COLUMNS)
    return pick("O"), pick("F")


LINEITEM_PAIR = f"""
real_t AS (SELECT {', '.join(LINE_COLUMNS)} FROM lineitem WHERE l_linestatus = 'O'),
synth_t AS (SELECT {', '.join(LINE_COLUMNS)} FROM lineitem WHERE l_linestatus = 'F')"""


# --- customers and suppliers ------------------------------------------------------


def accounts_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    real = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    synth = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("BUILDING").alias("segment")
    )
    return real, synth


ACCOUNTS_PAIR = """
real_t AS (SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer),
synth_t AS (SELECT s_nationkey AS nation, s_acctbal AS balance, 'BUILDING' AS segment FROM supplier)"""
