"""Temporal neighbours, inductive masks, negative samples and messages between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.asof import in_ranges, running
from .splits import sample


def adjacency(tx: DataFrame, *more: str) -> DataFrame:
    """node, nbr, edge_id, t and more columns for both directions of every transfer; a self-loop stands twice."""
    t = X.epoch(F.col("ts")).alias("t")
    one = lambda a, b: tx.select(F.col(a).alias("node"), F.col(b).alias("nbr"), F.col("row_id").alias("edge_id"), t, *more)
    return one("src", "dst").unionAll(one("dst", "src"))


def _histories(tx: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of probed nodes (node, at, nbr_t, edge_id, nbr), numbered from 1 in order of (t, edge_id, nbr), and for
    each of probes(node, t) the number n of events strictly before t."""
    adj = adjacency(tx)
    asked = probes.select("node", "t").distinct()
    # Events and probes of a node in one order of time: a probe sees the last events of smaller t.
    events = adj.join(asked.select("node").distinct(), "node", "left_semi").select("node", "t", F.lit(1).alias("kind"), "edge_id", "nbr")
    marks = asked.select("node", "t", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast(adj.schema["nbr"].dataType).alias("nbr"))
    both = in_ranges(events.unionByName(marks), F.col("t"), tx, X.epoch(F.col("ts")))
    rows = running(both, "node", ["t", "kind", "edge_id", "nbr"], "kind", "n")
    return rows.filter("kind = 1").select("node", F.col("n").alias("at"), F.col("t").alias("nbr_t"), "edge_id", "nbr"), rows.filter("kind = 0").select("node", "t", "n")


def neighbours(tx: DataFrame, probes: DataFrame, k: int, oldest_first: bool = False) -> DataFrame:
    """node, t, rank, nbr, edge_id, nbr_t: the k latest events of a node strictly before t, for each of probes(node, t).

    A running count numbers the node's own events, range of time by range of time (see plans.asof); nothing grows with
    the square of a node's degree, and no task holds all events of a node.
    """
    numbered, marks = _histories(tx, probes)
    wanted = marks.select("node", "t", "n", F.explode(F.expr(f"sequence(1, {k})")).alias("rank")).filter("rank <= n").withColumn("at", F.col("n") - F.col("rank") + 1)
    found = wanted.join(numbered, ["node", "at"])
    if oldest_first:
        found = found.withColumn("rank", F.least(F.col("n"), F.lit(k)) - F.col("rank") + 1)
    return found.select("node", "t", F.col("rank").cast("int").alias("rank"), "nbr", "edge_id", "nbr_t")


def uniform_neighbours(tx: DataFrame, probes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """node, t, rank, nbr, edge_id, nbr_t: k draws with replacement from a node's events strictly before t, in order of
    time; draws are integer arithmetic on node, t and the draw's number. Nodes are whole numbers."""
    numbered, marks = _histories(tx, probes)
    number = F.col("node") * 7_919 + F.col("t") * 31 + F.col("draw") * 104_729 + F.lit(seed)
    wanted = marks.filter("n > 0").select("node", "t", "n", F.explode(F.expr(f"sequence(1, {k})")).alias("draw")).withColumn("at", F.pmod(number, F.col("n")) + 1)
    rank = F.row_number().over(Window.partitionBy("node", "t").orderBy("at", "draw"))
    return wanted.join(numbered, ["node", "at"]).select("node", "t", rank.alias("rank"), "nbr", "edge_id", "nbr_t")


def unseen_nodes(tx: DataFrame, after: float, share: float = 0.1, seed: int = 0) -> DataFrame:
    """acct: as many accounts as ``share`` of all (rounded down), drawn by a fixed order from those with a transfer after
    epoch second ``after``. Accounts are whole numbers."""
    t = X.epoch(F.col("ts"))
    ends = tx.select(F.col("src").alias("acct"), t.alias("t")).unionAll(tx.select(F.col("dst").alias("acct"), t.alias("t")))
    n = int(share * ends.select("acct").distinct().count())
    return sample(ends.filter(F.col("t") > after).select("acct").distinct(), "acct", n, seed)


def padded_neighbours(tx: DataFrame, probes: DataFrame, k: int, pad_left: bool = True) -> DataFrame:
    """node, t and arrays of exactly k: neighbours, edges, times; padded with 0, oldest first where padded left."""
    found = neighbours(tx, probes, k, oldest_first=pad_left)
    lists = found.groupBy("node", "t").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr", "edge_id", "nbr_t"))).alias("l"))
    rows = probes.select("node", "t").distinct().join(lists, ["node", "t"], "left")

    def padded(field: str) -> object:
        got = F.coalesce(F.col(f"l.{field}").cast("array<bigint>"), F.array().cast("array<bigint>"))
        zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(k) - F.size(got))
        return (F.concat(zeros, got) if pad_left else F.concat(got, zeros)).alias(field)

    return rows.select("node", "t", padded("nbr"), padded("edge_id"), padded("nbr_t"))


def new_node_edges(tx: DataFrame, split: DataFrame) -> DataFrame:
    """Validation and test transfers with touches_new: whether an end never occurs in training."""
    rows = tx.select("row_id", "src", "dst").join(split.select("row_id", "split"), "row_id")
    train = rows.filter("split = 'train'")
    seen = train.select(F.col("src").alias("n")).unionAll(train.select(F.col("dst").alias("n"))).distinct().withColumn("_seen", F.lit(1))
    side = lambda k: seen.select(F.col("n").alias(k), F.col("_seen").alias(f"_{k}"))
    rest = rows.filter("split <> 'train'").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return rest.select("row_id", "split", (F.col("_src").isNull() | F.col("_dst").isNull()).cast("int").alias("touches_new"))


def negative_samples(tx: DataFrame, destinations: DataFrame, seed: int = 7) -> DataFrame:
    """row_id, neg_dst: one of destinations(acct, idx from 0 without gaps) for each transfer, by integer arithmetic on row_id."""
    n = destinations.agg(F.count("*").alias("_n"))
    at = F.pmod(F.col("row_id") * 48_271 + seed * 7_919, F.col("_n"))
    return tx.select("row_id").crossJoin(F.broadcast(n)).withColumn("idx", at).join(destinations, "idx").select("row_id", F.col("acct").alias("neg_dst"))


def messages(tx: DataFrame) -> DataFrame:
    """node, seq, t, msg: for both ends of a transfer, [amount paid, amount received, hour / 24]."""
    t = X.epoch(F.col("ts")).alias("t")
    msg = F.array(F.coalesce("amt_paid", F.lit(0.0)), F.coalesce("amt_rec", F.lit(0.0)), F.hour("ts") / 24.0).alias("msg")
    one = lambda k: tx.select(F.col(k).alias("node"), F.col("row_id").alias("seq"), t, msg)
    return one("src").unionAll(one("dst"))


def last_message(msgs: DataFrame) -> DataFrame:
    """The latest message of each node, by (t, seq)."""
    return msgs.groupBy("node").agg(F.max_by("msg", F.struct("t", "seq")).alias("msg"), F.max("t").alias("t"))


def mean_message(msgs: DataFrame, width: int = 3) -> DataFrame:
    """The element-wise mean of each node's messages, and its latest time."""
    return msgs.groupBy("node").agg(F.array(*[F.avg(F.col("msg")[k]) for k in range(width)]).alias("msg"), F.max("t").alias("t"))
