"""Intermediate tables in the folder that all executors share, and global order without a single-task sort."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only in local mode, where driver and executors are one process, if the session names no spark.checkpoint.dir.
LOCAL_WORK_DIR = "/tmp/checkpoints"


def work_path(spark: SparkSession, name: str) -> str:
    """The path of ``name`` in the folder that driver and executors share; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or LOCAL_WORK_DIR).rstrip('/')}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = work_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Vocabularies of at most so many values are broadcast, and of at most so many have a column each.
BROADCAST_ROWS, MOST_COLUMNS = 100_000, 10_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """The sorted distinct values of a column that become columns; an error if they are too many for that."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has over {MOST_COLUMNS} values")
    return sorted(found)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in range partitions of ``order``: _part counts up with the order, _place within a part. Rows are written once,
    so later passes see the same parts."""
    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    spread = spread.withColumn("_here", F.monotonically_increasing_id())
    return materialize(spread.select(*df.columns, F.shiftright("_here", 33).alias("_part"), F.col("_here").bitwiseAND((1 << 33) - 1).alias("_place")), "ranged")


def global_index(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with ``name``: 0, 1, 2, ... in the order of ``order`` (which should be unique). Only one row a part is in one task."""
    rows = ranged(df, *order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).select(*df.columns, name)


def running_totals(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df with below_<v> for each value: its sum over all rows of smaller ``order`` (which should be unique)."""
    rows = ranged(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_s_{v}") for v in values])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(starts), "_part")
    return rows.select(*df.columns, *[(F.col(f"_s_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"below_{v}") for v in values])


def quantiles_by(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """by, share, quantile: exact quantiles of each group's values that are not null, interpolated between the two ranks
    around each share. Equal values are counted before the shuffle, and no task holds more than a range part of a group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    parts = ranged(counts, by, "_v")
    sums = parts.groupBy("_part", by).agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(by)
    starts = sums.select("_part", by, F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_s").over(group).alias("_total"))
    within = Window.partitionBy("_part", by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_below", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, ["_part", by])
    placed = placed.withColumn("_below", F.col("_below") + F.col("_start")).withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    at = F.col("share") * (F.col("_total") - 1)
    holds = lambda rank: (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_n"))
    ends = placed.filter(holds(F.floor(at)) | holds(F.ceil(at))).groupBy(by, "share").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max(at - F.floor(at)).alias("_f"))
    return ends.select(by, "share", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * (1 - F.col("_f")) + F.col("_hi") * F.col("_f")).alias("quantile"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with the named exact quantiles of df's columns; null where there is no value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), c.cast("double").alias("_value")) for k, (c, _) in wanted.items()])).alias("_r")).select("_r.*")
    found = quantiles_by(long, "_name", "_value", sorted({q for _, q in wanted.values()}))
    return found.agg(*[F.max(F.when((F.col("_name") == k) & (F.col("share") == q), F.col("quantile"))).alias(k) for k, (_, q) in wanted.items()])
