"""The driver's tables as transfers, accounts, patterns and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import FORMATS
from ..operators.layouts import CURRENCIES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"), "ts", F.col("user_id").alias("src"), k.alias("dst"),
        (F.col("user_id") % 10).cast("string").alias("from_bank"), (k % 10).cast("string").alias("to_bank"),
        F.col("value").alias("amt_paid"), (F.col("value") * (1 - (F.col("event_id") % 5) / 100.0)).alias("amt_rec"),
        F.col("event_type").alias("fmt"), (F.col("event_id") % 3).cast("string").alias("cur_paid"), (F.col("event_id") % 4).cast("string").alias("cur_rec"),
        F.when((F.col("event_id") * 7919) % 100 < 3, 1).otherwise(0).alias("label"),
    )


def worded_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transfers with formats and currencies of the fixed vocabularies."""
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("row_id") % n + 1).cast("int"))
    new = {"fmt": pick(FORMATS, len(FORMATS)), "cur_rec": pick(CURRENCIES, len(CURRENCIES)), "cur_paid": pick(CURRENCIES, len(CURRENCIES) - 1)}
    return transfers(spark, sf_dir).withColumns(new)


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger graph: customers to suppliers by order line."""
    li, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("o_orderdate").alias("ts"), F.col("l_extendedprice").alias("amt_paid"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("acct"), F.col("c_nationkey").alias("entity_id"), F.concat("c_mktsegment", F.lit(" #"), F.col("c_nationkey").cast("string")).alias("entity_name"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("acct"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    score = (F.col("event_id") * 104729) % 1000 / F.lit(999.0)
    return e.select(F.col("event_id").alias("edge_id"), score.alias("score"), F.when((F.col("event_id") * 7919) % 100 < 3, 1).otherwise(0).alias("label"))
