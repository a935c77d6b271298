"""Node memory as a stream: each micro-batch of events reads the state of the batch before, and leaves a state of its own.

State is two tables keyed by node: memory(node, memory, last_update) and the queue of messages that a node has not taken
in yet, queue(node, arrival, t, msg). Every batch writes both under its number, then a manifest; a batch without a manifest
does not count, one that has it is not applied again. So a restarted stream goes on where it was, and any version
that is kept can be read, or be the start of another replay (see NodeState.branch).

A lazy model first lets the nodes of a batch take in their queued messages, then queues the batch's own; an eager one
lets them take in the batch's own at once, senders first. All messages of a batch read memory from before them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.scoring import recurrent_cell
from ..plans.work import work_path

MEMORY = "node long, memory array<double>, last_update long"
ARRIVAL = "struct<batch:long,side:int,t:long,row_id:long>"


@dataclass(frozen=True)
class MemoryModel:
    """width: numbers a node's memory has; edge: columns of an event that go into its messages; time_dim: numbers of the time
    code in a message, 0 for none; aggregate: ``last`` message by arrival, or ``mean``; layers: (weights, bias) of the message
    function, none for the message itself; cell: ``gru`` or ``rnn`` with weights w_in, w_hid, b_in, b_hid, or ``decay``, which moves
    memory towards the message's mean by 1 - decay; together: an eager model takes both ends' messages as one group."""

    width: int
    edge: tuple[str, ...] = ()
    time_dim: int = 0
    aggregate: str = "last"
    layers: tuple[tuple[np.ndarray, np.ndarray], ...] = ()
    cell: str = "gru"
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    decay: float = 0.5
    eager: bool = False
    together: bool = False

    def __post_init__(self) -> None:
        if self.aggregate not in ("last", "mean") or self.cell not in ("gru", "rnn", "decay"):
            raise ValueError(f"no such aggregate or cell: {self.aggregate}, {self.cell}")
        taken = self.layers[-1][0].shape[1] if self.layers else self.message_width
        if self.cell != "decay" and (self.weights["w_in"].shape[0] != taken or self.weights["w_hid"].shape[0] != self.width):
            raise ValueError("the cell's weights do not fit the messages or the memory")

    @property
    def message_width(self) -> int:
        return 2 * self.width + len(self.edge) + self.time_dim


def raw_messages(events: DataFrame, memory: DataFrame, model: MemoryModel) -> DataFrame:
    """node, arrival, t, msg for both ends of events(batch, row_id, t, src, dst, edge columns): own memory, the other end's, the
    edge's numbers (null as 0) and a cosine code of the seconds since the own last update. A node without memory has zeros."""
    end = lambda side, node, other: F.struct(F.lit(side).alias("side"), F.col(node).alias("node"), F.col(other).alias("other"))
    ends = events.select("batch", "row_id", "t", *model.edge, F.explode(F.array(end(0, "src", "dst"), end(1, "dst", "src"))).alias("e")).select("batch", "row_id", "t", *model.edge, "e.*")
    zeros = F.array_repeat(F.lit(0.0), model.width)
    rows = ends.join(memory.select("node", F.col("memory").alias("own"), "last_update"), "node", "left").join(memory.select(F.col("node").alias("other"), F.col("memory").alias("theirs")), "other", "left")
    parts = [F.coalesce("own", zeros), F.coalesce("theirs", zeros), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.edge]).cast("array<double>")]
    if model.time_dim:
        parts.append(X.cosine_ladder((F.col("t") - F.coalesce("last_update", F.lit(0))).cast("double"), model.time_dim))
    return rows.select("node", F.struct("batch", "side", "t", "row_id").cast(ARRIVAL).alias("arrival"), "t", F.concat(*parts).alias("msg"))


def aggregated(msgs: DataFrame, model: MemoryModel, by_time: bool = False) -> DataFrame:
    """node, msg, t: each node's last message by arrival (or by time), or the mean of all; the time is the last one's. Groups are
    combined before the shuffle."""
    at = F.struct("arrival.t", "arrival.row_id", "arrival.side") if by_time else F.col("arrival")
    msg = F.max_by("msg", at) if model.aggregate == "last" else F.array(*[F.avg(F.col("msg")[k]) for k in range(model.message_width)])
    return msgs.groupBy("node").agg(msg.alias("msg"), F.max_by("t", at).alias("t"))


def advance(memory: DataFrame, taken: DataFrame, model: MemoryModel) -> DataFrame:
    """memory after each node of taken(node, msg, t) has taken in its message; other nodes stay, new ones start from zeros. A
    message from before its node's last update is an error."""
    rows = taken.join(memory, "node", "left")
    late = F.raise_error(F.lit("a message from before the last update")).cast("long")
    rows = rows.withColumn("t", F.when(F.col("t") < F.col("last_update"), late).otherwise(F.col("t")))
    old = F.coalesce("memory", F.array_repeat(F.lit(0.0), model.width))
    if model.cell == "decay":
        mean = F.aggregate("msg", F.lit(0.0), lambda a, v: a + v) / F.size("msg")
        new = rows.select("node", F.transform(old, lambda v: model.decay * v + (1 - model.decay) * mean).alias("memory"), F.col("t").alias("last_update"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x, h = np.stack(b["msg"]), np.stack(b["memory"])
                for k, (w, bias) in enumerate(model.layers):
                    x = (np.maximum(x, 0) if k else x) @ w + bias
                yield pd.DataFrame({"node": b["node"], "memory": list(recurrent_cell(x, h, **model.weights, kind=model.cell)), "last_update": b["t"]})

        new = rows.select("node", "msg", "t", old.alias("memory")).mapInPandas(run, MEMORY)
    return memory.join(taken.select("node"), "node", "left_anti").unionByName(new)


def time_gaps(events: DataFrame, memory: DataFrame, stats: DataFrame) -> DataFrame:
    """row_id, gap_src, gap_dst and, where events have neg_dst, gap_neg: seconds from a node's last update (0 without one) to the
    event, less the mean of the times between events and over their deviation. stats: one row mean_src, std_src, mean_dst,
    std_dst; destinations and drawn ones go by the second pair."""
    rows = events.crossJoin(F.broadcast(stats))
    out = []
    for side, kind in (("src", "src"), ("dst", "dst"), ("neg_dst", "dst")):
        if side in events.columns:
            name = "gap_neg" if side == "neg_dst" else f"gap_{side}"
            rows = rows.join(memory.select(F.col("node").alias(side), F.col("last_update").alias(f"_{side}")), side, "left")
            out.append(((F.col("t") - F.coalesce(f"_{side}", F.lit(0)) - F.col(f"mean_{kind}")) / F.col(f"std_{kind}")).alias(name))
    return rows.select("row_id", *out)


def seen_memory(memory: DataFrame, queue: DataFrame, model: MemoryModel) -> DataFrame:
    """The memory that an embedding sees: all queued messages taken in, without keeping that."""
    return memory if model.eager else advance(memory, aggregated(queue, model), model)


class NodeState:
    """Versions of memory and queue below one folder that driver and executors share; a version is a batch's number."""

    def __init__(self, spark: SparkSession, root: str | None = None, keep: int | None = None):
        self.spark, self.root, self.keep = spark, (root or work_path(spark, f"node-state-{uuid.uuid4().hex}")).rstrip("/"), keep

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the batches whose manifest is there, in order."""
        fs, top = self._fs(), self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._path(f"{self.root}/manifest/{n}/_SUCCESS")))

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifest/v={version}").first()[0])

    def at(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """memory and queue after a batch, the last one if none is named; both empty before any."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], MEMORY), self.spark.createDataFrame([], f"node long, arrival {ARRIVAL}, t long, msg array<double>")
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no state of batch {version}; there are {known}")
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={version}")
        return read("memory", MEMORY), read("queue", f"node long, arrival {ARRIVAL}, t long, msg array<double>")

    def put_memory(self, version: int, memory: DataFrame) -> DataFrame:
        memory.write.mode("overwrite").parquet(f"{self.root}/memory/v={version}")
        return self.spark.read.schema(MEMORY).parquet(f"{self.root}/memory/v={version}")

    def commit(self, version: int, queue: DataFrame, **more: object) -> None:
        """The queue and, last, the manifest of a batch whose memory is written; old versions beyond ``keep`` go."""
        queue.write.mode("overwrite").parquet(f"{self.root}/queue/v={version}")
        self.spark.createDataFrame([(json.dumps({"version": version, **more}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/v={version}")
        for old in self.versions()[: -self.keep] if self.keep else []:
            for name in ("manifest", "queue", "memory"):
                self._fs().delete(self._path(f"{self.root}/{name}/v={old}"), True)

    def start(self, memory: DataFrame | None = None) -> None:
        """Version -1, before any batch: memory(node, memory, last_update) that nodes begin with, or none, which is zeros and 0; an
        error if there are versions already."""
        if self.versions():
            raise ValueError("there is a state already")
        nothing, queue = self.at()
        self.put_memory(-1, nothing if memory is None else memory.select("node", "memory", "last_update"))
        self.commit(-1, queue)

    def branch(self, version: int, root: str | None = None) -> NodeState:
        """A state of its own that begins with a copy of this one's version."""
        memory, queue = self.at(version)
        new = NodeState(self.spark, root, self.keep)
        new.put_memory(version, memory)
        new.commit(version, queue, parent=self.root)
        return new

    def apply(self, events: DataFrame, number: int, model: MemoryModel) -> bool:
        """The state after one batch of events(row_id, t, src, dst, edge columns). False if that batch is applied already; an
        error if a later one is."""
        known = self.versions()
        if number in known:
            return False
        if known and number < known[-1]:
            raise ValueError(f"batch {number} comes after {known[-1]}")
        memory, queue = self.at()
        events = events.withColumn("batch", F.lit(number).cast("long"))
        nodes = events.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        if model.eager:
            msgs = raw_messages(events, memory, model)
            if model.together:
                new = advance(memory, aggregated(msgs, model, by_time=True), model)
            else:
                sent, got = (aggregated(msgs.filter(F.col("arrival.side") == k), model) for k in (0, 1))
                # A node that sent after it got does not go back in time.
                got = got.join(sent.select("node", F.col("t").alias("_t")), "node", "left").select("node", "msg", F.greatest("t", "_t").alias("t"))
                new = advance(advance(memory, sent, model), got, model)
            self.put_memory(number, new)
            self.commit(number, queue)
            return True
        due = aggregated(queue.join(nodes, "node", "left_semi"), model)
        memory = self.put_memory(number, advance(memory, due, model))
        rest = queue.join(nodes, "node", "left_anti")
        self.commit(number, rest.unionByName(raw_messages(events, memory, model)))
        return True

    def replay(self, stream: DataFrame, model: MemoryModel) -> None:
        """Applies every batch of a stream of events(batch, ...) that stored_batches() reads, until none is left; each
        micro-batch is one batch."""

        def step(events: DataFrame, _: int) -> None:
            r = events.agg(F.min("batch").alias("low"), F.max("batch").alias("high")).first()
            if r["low"] is None:
                return
            if r["low"] != r["high"]:
                raise ValueError("a micro-batch holds several batches")
            self.apply(events.drop("batch"), r["low"], model)

        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


#: Rows of a batch that one file, and so one task, holds.
ROWS_A_FILE = 250_000


def stored_batches(events: DataFrame, path: str | None = None) -> DataFrame:
    """A stream of events(batch, row_id, ...), one batch a micro-batch, in order of batch.

    Events are written once, every batch in the same number of files, which grows with the largest batch: files without
    rows fill up the smaller ones, so that a micro-batch takes so many files. The files' times tell the stream their
    order, so the shared folder must keep times that are set (NodeState.replay gives an error where it does not).
    """
    spark = events.sparkSession
    path = path or work_path(spark, f"event-batches-{uuid.uuid4().hex}")
    largest = events.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-largest // ROWS_A_FILE))
    spread = events.repartition("batch", F.pmod(F.xxhash64("row_id"), F.lit(files))) if files > 1 else events.repartition("batch")
    spread.write.partitionBy("batch").parquet(path)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    top = hadoop.Path(path)
    fs = top.getFileSystem(conf)
    if files > 1:
        events.drop("batch").limit(0).coalesce(1).write.parquet(f"{path}-none")
        none = next(f.getPath() for f in fs.listStatus(hadoop.Path(f"{path}-none")) if f.getPath().getName().startswith("part-"))
    for folder in fs.listStatus(top):
        name = folder.getPath().getName()
        if name.startswith("batch="):
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            for k in range(len(parts), files):
                parts.append(hadoop.Path(f"{path}/{name}/part-none-{k}.parquet"))
                hadoop.FileUtil.copy(fs, none, fs, parts[-1], False, conf)
            for part in parts:
                fs.setTimes(part, 1_000_000_000_000 + 1000 * int(name[6:]), -1)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").parquet(path)
