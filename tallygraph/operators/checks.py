"""Structural checks of injected tables, graphs and event streams, as DataFrames of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def injection_failures(df: DataFrame, required: list[str]) -> DataFrame:
    """check, n for each failed check: missing columns, null scores, marked rows that aren't positive."""
    spark = df.sparkSession
    missing = [(f"missing {c}", 1) for c in required if c not in df.columns]
    found = spark.createDataFrame(missing, "check string, n long")
    if not missing:
        one = df.agg(F.count_if(F.col("RAT_score").isNull()).alias("null_score"), F.count_if((F.col("RAT_injected") == 1) & (F.col("label") != 1)).alias("injected_not_positive"))
        found = found.unionAll(one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in one.columns])).alias("r")).select("r.*"))
    return found.filter("n > 0")


def edge_failures(edges: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """check, n: ends outside the node table, null or non-finite features, labels other than 0 and 1, repeated edge ids."""
    ids = nodes.select(F.col("node_id").alias("_id"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_id")).join(ids, "_id", "left_anti").agg(F.count("*").alias("dangling"))
    bad = None
    for c in features:
        b = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        bad = b if bad is None else bad | b
    one = edges.agg(F.count_if(bad).alias("bad_features"), F.count_if(~F.col("label").isin(0, 1)).alias("bad_labels"), (F.count("*") - F.countDistinct("edge_id")).alias("repeated_ids")).crossJoin(ends)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in one.columns])).alias("r")).select("r.*").filter("n > 0")


def warnings(stats: DataFrame) -> DataFrame:
    """check for each rule that one row of graph statistics breaks: few positives, isolated nodes, self-loops."""
    rules = [("positives under 1 %", "pct_laundering < 1"), ("positives under 5 %", "pct_laundering < 5"), ("isolated nodes", "isolated > 0"), ("self-loops", "self_loops > 0")]
    return stats.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules]))).alias("check"))
