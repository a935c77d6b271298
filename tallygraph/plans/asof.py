"""As-of values within a key without a task for each key: a hub's rows are cut into ranges of time.

A window runs over the rows of one key and one range; what is carried into a range (the last value, or the count, of the
key's earlier ranges) comes from one row a key and range, summed up before the shuffle. So half of all rows may belong
to one key. Rows that share one instant stay together. Where only the few latest rows matter, they are carried as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize

#: Ranges of equal length between the first and the last time.
RANGES = 512
#: A node with more rows than this is cut into as many ranges as it has times as many rows.
HUB_ROWS = 100_000
#: Up to so many nodes that are asked for are broadcast, to leave the others' events out.
FEW_NODES = 1_000_000
#: Node, range and time are packed into one number to sort by, if it stays below this.
MOST_AT = 2**62
_BEFORE = (Window.unboundedPreceding, -1)


def in_ranges(df: DataFrame, t: Column, times: DataFrame | None = None, at: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """df with _range, which counts up with t: from the least to the greatest ``at`` (or t) of times (or df); beyond them as at
    the ends, and -1 for null."""
    ends = (df if times is None else times).agg(F.min(t if at is None else at).alias("_lo"), F.max(t if at is None else at).alias("_hi"))
    number = F.floor((t - F.col("_lo")) * ranges / (F.col("_hi") - F.col("_lo") + 1))
    return df.crossJoin(F.broadcast(ends)).withColumn("_range", F.when(number.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(ranges - 1), number)))).drop("_lo", "_hi")


def _with_carried(df: DataFrame, sums: DataFrame, by: str, value: str) -> DataFrame:
    """df with _mark 1 and _value, and in front of the rows of each key and range one more, of _mark 0, whose _value is what
    sums(by, _range, _carry) carries in: one shuffle serves both, where a join would deal all rows out again."""
    return df.withColumns({"_mark": F.lit(1), "_value": F.col(value)}).unionByName(sums.select(by, "_range", F.lit(0).alias("_mark"), F.col("_carry").alias("_value")), allowMissingColumns=True)


def previous(df: DataFrame, by: str, order: list[str], value: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """df(_range, ...) with ``name``: value of the row before in the order of ``order`` among those of the same ``by``; null for
    the first. order begins with what _range counts up with; source: a narrower plan with the same rows."""
    last = (df if source is None else source).groupBy(by, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    sums = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(by).orderBy("_range")))
    within = Window.partitionBy(by, "_range").orderBy("_mark", *order)
    rows = _with_carried(df, sums, by, value).withColumn(name, F.lag("_value").over(within))
    return rows.filter("_mark = 1").drop("_mark", "_value")


def running(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """df(_range, ...) with ``name``: the sum of value over the rows of the same ``by`` up to each row in the order of ``order``;
    nulls count as 0."""
    sums = df.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_carry", F.sum("_sum").over(Window.partitionBy(by).orderBy("_range").rowsBetween(*_BEFORE)))
    within = Window.partitionBy(by, "_range").orderBy("_mark", *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_carried(df, sums, by, value).withColumn(name, F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return rows.filter("_mark = 1").drop("_mark", "_value")


def near_events(events: DataFrame, asks: DataFrame, k: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """events and asks (both with whole numbers node and t) with _range, such that of the events before an ask the k latest in the
    order of ``order`` (which begins with t) are all in its node's _range; and with _at, which counts up with node, _range and t where these
    fit into one number, to sort by first. _range is 0, but for nodes of over HUB_ROWS rows, whose ranges
    have equal lengths; there the k latest events before a range stand in it once more. Other rows are not repeated, so a node's size costs
    nothing. Events of nodes that are not asked for may be left out. Both are read several times: pass tables."""
    both = events.select("node", "t", F.lit(0).alias("_ask")).unionByName(asks.select("node", "t", F.lit(1).alias("_ask")))
    nodes = materialize(both.groupBy("node").agg(F.ceil(F.count("*") / HUB_ROWS).alias("_n"), F.max("_ask").alias("_ask"), F.min("t").alias("_lo"), F.max("t").alias("_hi")).filter("_ask = 1"), "nodes")
    # At most one row a HUB_ROWS rows, so it is small at any size.
    hubs = F.broadcast(nodes.filter("_n > 1").select("node", "_n", "_lo", "_hi"))
    ends = nodes.agg(F.count("*").alias("n"), *[f("node").cast("bigint").alias(name) for name, f in (("least", F.min), ("most", F.max))], F.max("_n").alias("ranges"), F.floor(F.min("_lo")).alias("lo"), F.floor(F.max("_hi")).alias("hi")).first()
    if 0 < ends["n"] <= FEW_NODES:
        events = events.join(F.broadcast(nodes.select("node")), "node", "left_semi")
    number = F.floor((F.col("t") - F.col("_lo")) * F.col("_n") / (F.col("_hi") - F.col("_lo") + 1)).cast("bigint")
    last = F.row_number().over(Window.partitionBy("node", "_range").orderBy(*[F.col(c).desc() for c in order]))
    tails = events.join(hubs, "node").withColumn("_range", number).withColumn("_last", last).filter(F.col("_last") <= k)
    # An event is among the k latest up to the range in which the k-th after it lies.
    until = F.coalesce(F.lead("_range", k).over(Window.partitionBy("node").orderBy(*order)), F.col("_n") - 1)
    tails = tails.withColumn("_until", until).filter("_until > _range").withColumn("_range", F.explode(F.sequence(F.col("_range") + 1, F.col("_until"))))
    at = F.col("node").cast("bigint")
    if ends["n"] and (ends["most"] - ends["least"] + 1) * ends["ranges"] * (ends["hi"] - ends["lo"] + 1) < MOST_AT:
        at = ((at - ends["least"]) * ends["ranges"] + F.col("_range")) * (ends["hi"] - ends["lo"] + 1) + F.floor("t") - ends["lo"]
    placed = lambda df: df.join(hubs, "node", "left").withColumn("_range", F.coalesce(number, F.lit(0).cast("bigint"))).drop("_n", "_lo", "_hi").withColumn("_at", at)
    return placed(events).unionByName(tails.select(*events.columns, "_range").withColumn("_at", at)), placed(asks)
