"""Embeddings of nodes at a time, and scores of events by them: temporal neighbour layers, attention over a batch of events,
event scores from embedding tables, and scores from saved weights. Neighbours and joins are plans, dense layers Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.asof import near_events
from ..plans.work import materialize
from . import scoring as S
from . import temporal as T

#: Saved weights are read on the driver; more numbers than this are an error.
MAX_WEIGHTS = 10_000_000
Layer = dict[str, np.ndarray]


def time_embedding(memory: DataFrame, gaps: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """row_id, z: a node's memory times 1 + weight * gap + bias, for gaps(row_id, node, gap) and memory(node, memory)."""
    rows = gaps.join(memory.select("node", "memory"), "node")
    return rows.select("row_id", F.array(*[F.col("memory")[k] * (1 + (F.col("gap") * float(w) + float(b))) for k, (w, b) in enumerate(zip(weight, bias))]).alias("z"))


def sum_layer(own: np.ndarray, nbr: np.ndarray, code: np.ndarray, edge: np.ndarray, pad: np.ndarray, layer: Layer) -> np.ndarray:
    """[relu(sum of (neighbour, code, edge) @ w1 + b1), own, code of 0] @ w2 + b2; padded neighbours count as they are."""
    seen = np.concatenate([nbr, code, edge], axis=2)
    total = np.maximum((seen.reshape(-1, seen.shape[2]) @ layer["w1"] + layer["b1"]).reshape(*seen.shape[:2], -1).sum(axis=1), 0)
    return np.concatenate([total, own, np.ones((len(own), code.shape[2]))], axis=1) @ layer["w2"] + layer["b2"]


def attention_layer(own: np.ndarray, nbr: np.ndarray, code: np.ndarray, edge: np.ndarray, pad: np.ndarray, layer: Layer) -> np.ndarray:
    """Attention of (own, code of 0) over (neighbour, edge, code) in layer["heads"] heads, then a merge layer with own. Padded
    neighbours get no weight; a row with no other has an attention of 0."""
    heads = int(layer["heads"])
    query = np.concatenate([own, np.ones((len(own), code.shape[2]))], axis=1) @ layer["wq"] + layer["bq"]
    keys = np.concatenate([nbr, edge, code], axis=2)
    split = lambda x: x.reshape(*x.shape[:-1], heads, -1)
    q, k, v = split(query), split(keys @ layer["wk"] + layer["bk"]), split(keys @ layer["wv"] + layer["bv"])
    s = np.einsum("bhd,bnhd->bhn", q, k) / np.sqrt(q.shape[-1])
    none = pad.all(axis=1)
    s = np.where(pad[:, None, :] & ~none[:, None, None], -np.inf, s)
    a = np.exp(s - s.max(axis=2, keepdims=True))
    out = np.einsum("bhn,bnhd->bhd", a / a.sum(axis=2, keepdims=True), v).reshape(len(own), -1) @ layer["wo"] + layer["bo"]
    out[none] = 0
    return np.maximum(np.concatenate([out, own], axis=1) @ layer["m1"] + layer["c1"], 0) @ layer["m2"] + layer["c2"]


LAYERS: dict[str, Callable[..., np.ndarray]] = {"sum": sum_layer, "attention": attention_layer}


def graph_embeddings(tx: DataFrame, probes: DataFrame, features: DataFrame, edges: DataFrame | None, layers: list[Layer], k: int, time_dim: int, kind: str = "sum", memory: DataFrame | None = None) -> DataFrame:
    """node, t, z for each of probes(node, t): ``len(layers)`` layers over the k latest neighbours before t.

    Layer 0 is features(node_id, x), plus memory(node, memory) if given. The next layer of a node at t takes the one before of the
    node and of its neighbours, all at t, a cosine code of the seconds since each neighbour's event, and
    edges(edge_id, e), or tx's own column e where edges is None. Nodes and edges count from 1; 0 pads where there are fewer
    than k (a neighbour that is null counts as none) and, unless the tables have it, is all zeros.

    Layer 0 does not depend on t, so it goes along with the events, and one pass over a node's events in order of time both finds
    neighbours and computes layer 1. Each layer more is one pass more: a probe asks for its neighbours at its time, which answer
    under a place in the probe's tree, so neither asks nor answers are joined. A tree has 1 + k + ... places, one level less than layers;
    what two probes ask alike is computed for both.
    """
    if kind not in LAYERS:
        raise ValueError(f"no such layer: {kind}")
    known = features.select(F.col("node_id").alias("node"), "x")
    if memory is not None:
        known = known.join(memory.select("node", "memory"), "node", "full")
    known = materialize(known, "features")
    width = _width(known, "x")
    zeros = lambda c, n: F.coalesce(c, F.array_repeat(F.lit(0.0), n))
    x = zeros(F.col("x"), width)
    if memory is not None:
        x = F.zip_with(x, zeros(F.col("memory"), width), lambda a, b: a + b)
    known = known.select("node", x.alias("x"))
    asked = probes.select("node", "t").distinct().join(known, "node", "left").withColumn("x", zeros(F.col("x"), width))
    if not layers:
        return asked.withColumnRenamed("x", "z")
    edge_width = _width(tx if edges is None else edges, "e")
    none = {"x": _first(known.filter("node = 0"), "x", width), "e": np.zeros(edge_width) if edges is None else _first(edges.filter("edge_id = 0"), "e", edge_width)}
    if edges is not None:
        tx = tx.select("row_id", "src", "dst", "ts").join(edges.select(F.col("edge_id").alias("row_id"), "e"), "row_id", "left")
    events = T.adjacency(tx, "e").filter("node is not null and t is not null").join(known.withColumnRenamed("node", "nbr"), "nbr", "left")
    # Arrays go as one column a number, which is what sorting and handing over to Python do fastest.
    numbers = lambda c, n, name: [F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(n)]
    kind_of = F.when(F.col("nbr").isNull(), F.lit(2)).otherwise(F.lit(1)).alias("kind")
    events = events.select(F.col("node").cast("bigint"), "t", kind_of, "edge_id", F.coalesce(F.col("nbr").cast("bigint"), F.lit(0)).alias("nbr"), *numbers(F.col("x"), width, "x"), *numbers(F.col("e"), edge_width, "e"))
    events = materialize(events, "events")
    size = _places(k, len(layers))
    asks = asked.filter("node is not null and t is not null").select((F.monotonically_increasing_id() * size).alias("id"), F.col("node").cast("bigint"), "t", *numbers(F.col("x"), width, "x"))
    asks = materialize(asks, "asks")
    shape, answers = (k, width, edge_width, time_dim), None
    for depth in range(len(layers)):
        more = depth + 1 < len(layers)
        rows, wide = _first_layer(events, asks, layers[0], none, shape, LAYERS[kind], more)
        rows = materialize(rows, "answers") if more else rows
        z = [f"z{i}" for i in range(wide)]
        got = rows.select("id", "node", "t", *z, "slots" if more else F.lit(None).cast("binary").alias("slots"))
        answers = got if answers is None else answers.unionAll(got)
        # Below place p of a tree are the places k * p + 1 to k * p + k.
        below = lambda j: (F.col("id") + (F.col("id") % size) * (k - 1) + j).alias("id")
        if more:
            children = [F.struct(below(j), F.col(f"nbr{j}").alias("node"), "t", *[F.col(f"x{j}_{i}").alias(f"x{i}") for i in range(width)]) for j in range(1, k + 1)]
            asks = rows.select(F.inline(F.array(*children)))
    if len(layers) > 1:
        answers, wide = _upper_layers(answers, layers[1:], wide, shape, LAYERS[kind])
    return answers.select(F.col("node").cast(probes.schema["node"].dataType), F.col("t").cast(probes.schema["t"].dataType), F.array(*[F.col(f"z{i}") for i in range(wide)]).alias("z"))


def _places(k: int, levels: int) -> int:
    """Places of a tree of so many levels."""
    return sum(k**d for d in range(levels))


def _width(df: DataFrame, column: str) -> int:
    row = df.select(column).filter(F.col(column).isNotNull()).first()
    return len(row[0]) if row else 0


def _first(df: DataFrame, column: str, width: int) -> np.ndarray:
    """The array of df's first row, or zeros."""
    row = df.select(column).first()
    return np.array(row[0]) if row and row[0] is not None else np.zeros(width)


def _wide(layer: Layer, width: int, shape: tuple[int, int, int, int], step: Callable[..., np.ndarray]) -> int:
    """How many numbers a layer returns for own and neighbours' embeddings of ``width``."""
    k, _, edge_width, time_dim = shape
    return step(np.zeros((1, width)), np.zeros((1, k, width)), np.zeros((1, k, time_dim)), np.zeros((1, k, edge_width)), np.ones((1, k), bool), layer).shape[1]


def _code(gap: np.ndarray, time_dim: int) -> np.ndarray:
    """As exprs.cosine_ladder, along a new last axis."""
    return np.cos(gap[..., None].astype(float) * np.array([10.0 ** (-9.0 * k / (time_dim - 1)) for k in range(time_dim)]))


def _matrix(columns: dict[str, np.ndarray], name: str, width: int) -> np.ndarray:
    return np.column_stack([columns[f"{name}{i}"] for i in range(width)]) if width else np.zeros((len(next(iter(columns.values()))), 0))


def _packed(numbers: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    offsets = np.arange(len(numbers) + 1, dtype=np.int32) * (8 * numbers.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers, dtype=float))])


def _unpacked(values: pa.Array, width: int) -> np.ndarray:
    """The reverse of _packed; null is a row of zeros."""
    out, there = np.zeros((len(values), width)), values.is_valid().to_numpy(zero_copy_only=False)
    out[there] = np.frombuffer(b"".join(values.drop_null().to_pylist())).reshape(-1, width)
    return out


def latest_rows(starts: np.ndarray, event: np.ndarray, k: int) -> np.ndarray:
    """For each row that is no event, where the k latest events above it in its group are, oldest first; -1 for lack of any.
    starts: whether a group begins at a row."""
    seen = np.cumsum(event)
    first = np.maximum.accumulate(np.where(starts, seen - event, 0))[~event]
    number = seen[~event][:, None] + np.arange(-k, 0)
    return np.where(number >= first[:, None], np.append(np.flatnonzero(event), -1)[np.maximum(number, 0)], -1)


def _first_layer(events: DataFrame, asks: DataFrame, layer: Layer, none: Layer, shape: tuple[int, int, int, int], step: Callable[..., np.ndarray], more: bool) -> tuple[DataFrame, int]:
    """id, node, t and z0, z1, ... (and how many) of asks(id, node, t, x0, ...), their first layer; if ``more``, also the k neighbours'
    nbr<j> and x<j>_<i>, and slots: their gaps, pads and edges for the layers above."""
    k, width, edge_width, time_dim = shape
    wide = _wide(layer, width, shape, step)
    events, asks = near_events(events, asks, k, ["t", "edge_id", "nbr"])
    blank = {"kind": F.lit(0), "edge_id": F.lit(None), "nbr": F.lit(0).cast("bigint")} | {f"e{i}": F.lit(0.0) for i in range(edge_width)}
    rows = events.withColumn("id", F.lit(0).cast("bigint")).unionByName(asks.withColumns(blank))
    # At one time asks come before events, which must be earlier to be seen.
    order = ["_at", "node", "_range", "t", F.col("kind") > 0, "edge_id", "nbr"]
    rows = rows.repartition("node", "_range").sortWithinPartitions(*order).drop("_at", "edge_id")
    t = "double" if rows.schema["t"].dataType.simpleString() == "double" else "bigint"
    schema = ["id bigint", "node bigint", f"t {t}", *[f"z{i} double" for i in range(wide)]]
    if more:
        schema += [f"nbr{j} bigint" for j in range(1, k + 1)] + [f"x{j}_{i} double" for j in range(1, k + 1) for i in range(width)] + ["slots binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {name: v.to_numpy(zero_copy_only=False) for name, v in zip(b.schema.names, b.columns)}
            if kept is not None:
                c = {name: np.concatenate([kept[name], v]) for name, v in c.items()}
            event = c["kind"] > 0
            starts = np.append(True, (np.diff(c["node"]) != 0) | (np.diff(c["_range"]) != 0))
            top = np.flatnonzero(starts)[-1]
            last = np.flatnonzero(event[top:])[-k:] + top
            kept = {name: v[last] for name, v in c.items()}
            found, ask = latest_rows(starts, event, k), {name: v[~event] for name, v in c.items()}
            if not len(found):
                continue
            lost = (found < 0) | (c["kind"][found] == 2)
            nbr = np.where(lost, 0, c["nbr"][found])
            gap = (ask["t"][:, None] - np.where(lost, 0, c["t"][found])).astype(float)
            x = np.where(lost[:, :, None], none["x"], _matrix(c, "x", width)[found])
            e = np.where(lost[:, :, None], none["e"], _matrix(c, "e", edge_width)[found])
            z = step(_matrix(ask, "x", width), x, _code(gap, time_dim), e, nbr == 0, layer)
            out = {name: pa.array(ask[name]) for name in ("id", "node", "t")} | {f"z{i}": pa.array(z[:, i]) for i in range(wide)}
            if more:
                out |= {f"nbr{j + 1}": pa.array(nbr[:, j]) for j in range(k)} | {f"x{j + 1}_{i}": pa.array(x[:, j, i]) for j in range(k) for i in range(width)}
                out["slots"] = _packed(np.concatenate([gap, nbr == 0, e.reshape(len(e), -1)], axis=1))
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, ", ".join(schema)), wide


def _upper_layers(answers: DataFrame, layers: list[Layer], width: int, shape: tuple[int, int, int, int], step: Callable[..., np.ndarray]) -> tuple[DataFrame, int]:
    """node, t and z0, z1, ... (and how many): the layers above the first of each probe, from answers(id, node, t, z0, ..., slots) of its
    whole tree, which has the same number of places for all; ids count them on."""
    k, _, edge_width, time_dim = shape
    size, inner, wide = _places(k, len(layers) + 1), _places(k, len(layers)), width
    for layer in layers:
        wide = _wide(layer, wide, shape, step)
    rows = answers.repartition(F.col("id") - F.col("id") % size).sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {name: b.column(name).to_numpy(zero_copy_only=False) for name in b.schema.names if name != "slots"}
            c["slots"] = _unpacked(b.column("slots"), k * (2 + edge_width))
            if kept is not None:
                c = {name: np.concatenate([kept[name], v]) for name, v in c.items()}
            n = len(c["id"]) // size
            kept, c = {name: v[n * size :] for name, v in c.items()}, {name: v[: n * size] for name, v in c.items()}
            if (c["id"] % size != np.tile(np.arange(size), n)).any():
                raise ValueError("a probe's tree lacks places")
            if not n:
                continue
            slots = c["slots"].reshape(n, size, -1)[:, :inner]
            code, pad, e = _code(slots[..., :k], time_dim), slots[..., k : 2 * k] > 0, slots[..., 2 * k :].reshape(n, inner, k, edge_width)
            z = _matrix(c, "z", width).reshape(n, size, -1)
            for done, layer in enumerate(layers, 1):
                own = _places(k, len(layers) + 1 - done)
                part = lambda v: v[:, :own].reshape(n * own, *v.shape[2:])  # noqa: B023, E731
                z = step(part(z), z[:, 1 : own * k + 1].reshape(n * own, k, -1), part(code), part(e), part(pad), layer).reshape(n, own, -1)
            yield pa.RecordBatch.from_pydict({"node": pa.array(c["node"][::size]), "t": pa.array(c["t"][::size])} | {f"z{i}": pa.array(z[:, 0, i]) for i in range(wide)})
        if kept is not None and len(kept["id"]):
            raise ValueError("a probe's tree lacks places")

    t = rows.schema["t"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join(["node bigint", f"t {t}", *[f"z{i} double" for i in range(wide)]])), wide


def _scaled_time(events: DataFrame) -> DataFrame:
    """events with _s: t from 0 for the least to 1 for the greatest; 0 for all where they are equal."""
    ends = events.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    s = F.coalesce(F.try_divide(F.col("t") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return events.crossJoin(F.broadcast(ends)).withColumn("_s", s.cast("double")).drop("_lo", "_hi")


def _with_ends(events: DataFrame, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """events joined twice with nodes(node_id, ...): each named column as <new>_src and <new>_dst."""
    for side in ("src", "dst"):
        events = events.join(nodes.select(F.col("node_id").alias(side), *[F.col(c).alias(f"{new}_{side}") for c, new in columns.items()]), side)
    return events


def attention_scores(events: DataFrame, nodes: DataFrame, columns: list[str], weights: Layer, heads: int, layers: int, time_dim: int) -> DataFrame:
    """edge_id, score: the probability of each of events(edge_id, src, dst, t, batch, columns) among those of its batch.

    Projected ends (nodes: node_id, x), the event's columns and a sine code of its time are projected to one vector;
    ``layers`` times every event of a batch attends to all, and the sum with what was there is normalised; then a
    two-layer classifier. weights: node, event, qkv0, out0, ..., hidden, last, each with a bias <name>_b, and norm, norm_b.
    A batch is one task's array, so batches have a bounded size. A node without features drops its events.
    """
    code = X.sinusoid(F.col("_s"), time_dim)
    rows = _with_ends(_scaled_time(events), nodes, {"x": "x"}).select("edge_id", "batch", F.col("x_src"), F.col("x_dst"), F.concat(F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>"), code).alias("own"))

    def affine(x: np.ndarray, name: str) -> np.ndarray:
        return x @ weights[name] + weights[f"{name}_b"]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("edge_id")
        h = affine(np.hstack([affine(np.stack(b["x_src"]), "node"), affine(np.stack(b["x_dst"]), "node"), np.stack(b["own"])]), "event")
        for k in range(layers):
            q, key, v = (x.reshape(len(b), heads, -1).transpose(1, 0, 2) for x in np.split(affine(h, f"qkv{k}"), 3, axis=1))
            s = q @ key.transpose(0, 2, 1) / np.sqrt(q.shape[2])
            a = np.exp(s - s.max(axis=2, keepdims=True))
            h = h + affine(((a / a.sum(axis=2, keepdims=True)) @ v).transpose(1, 0, 2).reshape(len(b), -1), f"out{k}")
            h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5) * weights["norm"] + weights["norm_b"]
        z = affine(np.maximum(affine(h, "hidden"), 0), "last").reshape(-1)
        return pd.DataFrame({"edge_id": b["edge_id"], "score": 1 / (1 + np.exp(-z))})

    return rows.groupBy("batch").applyInPandas(run, "edge_id long, score double")


def _affine(columns: list[Column], weights: np.ndarray, bias: np.ndarray) -> list[Column]:
    """columns @ weights + bias as expressions, for small widths."""
    out = []
    for k in range(weights.shape[1]):
        total = F.lit(float(bias[k]))
        for c, w in zip(columns, weights[:, k]):
            total = total + c * float(w)
        out.append(total)
    return out


def embedded_event_scores(events: DataFrame, nodes: DataFrame, node_table: DataFrame, type_table: DataFrame, columns: list[str], weights: Layer, time_dim: int) -> DataFrame:
    """edge_id, score of events(edge_id, src, dst, t, event_type, columns): ends are x @ node + bias of nodes(node_id, x) plus
    their row of node_table(node_id, v); with the event's columns, a sine code of its time and type_table(event_type, v)
    they go through two layers (hidden, last). Tables are joined by id, the small type table is broadcast; an event whose node
    or type is in no table is left out. All of it is expressions, for weights of small width."""
    known = nodes.join(node_table, "node_id")
    width, wide = weights["node"].shape
    h = [e + F.col("v")[k] for k, e in enumerate(_affine([F.col("x")[i] for i in range(width)], weights["node"], weights["node_b"]))]
    known = known.select("node_id", F.array(*h).alias("h"))
    types = type_table.select("event_type", F.col("v").alias("type_v"))
    kinds = weights["hidden"].shape[0] - 2 * wide - len(columns) - time_dim
    if kinds < 0:
        raise ValueError("the hidden layer takes fewer numbers than ends, columns and time have")
    rows = _with_ends(_scaled_time(events), known, {"h": "h"}).join(F.broadcast(types) if types.limit(10_001).count() <= 10_000 else types, "event_type")
    code = X.sinusoid(F.col("_s"), time_dim)
    parts = [F.col(f"h_{side}")[k] for side in ("src", "dst") for k in range(wide)] + [F.col(c).cast("double") for c in columns] + [code[k] for k in range(time_dim)] + [F.col("type_v")[k] for k in range(kinds)]
    (z,) = _affine([F.greatest(c, F.lit(0.0)) for c in _affine(parts, weights["hidden"], weights["hidden_b"])], weights["last"], weights["last_b"])
    return rows.select("edge_id", (1 / (1 + F.exp(-z))).alias("score"))


def save_weights(spark: SparkSession, path: str, weights: Layer, node_features: list[str], edge_features: list[str]) -> None:
    """One row an array (name, shape, numbers), and the names of the features that the model was fitted on."""
    rows = [(name, list(np.shape(w)), [float(v) for v in np.ravel(w)], None) for name, w in weights.items()]
    rows += [(name, [len(cols)], None, list(cols)) for name, cols in (("node_features", node_features), ("edge_features", edge_features))]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>, features array<string>").coalesce(1).write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> tuple[Layer, list[str], list[str]]:
    """weights, node features and edge features of a saved model; an error if they are too many to read on the driver."""
    table = spark.read.parquet(path)
    size = table.agg(F.sum(F.coalesce(F.size("numbers"), F.lit(0)))).first()[0] or 0
    if size > MAX_WEIGHTS:
        raise ValueError(f"{size} weights are more than {MAX_WEIGHTS}")
    rows = table.collect()
    lists = {r["name"]: r["features"] for r in rows if r["features"] is not None}
    return {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows if r["numbers"] is not None}, lists["node_features"], lists["edge_features"]


def check_weights(weights: Layer, node_features: list[str], edge_features: list[str], time_dim: int, nodes: DataFrame, edges: DataFrame) -> int:
    """How many neighbour layers the weights have; an error where a feature is not in the tables or a shape does not follow
    from the one before."""
    lost = [c for c in node_features if c not in nodes.columns] + [c for c in edge_features if c not in edges.columns]
    if lost:
        raise ValueError(f"the tables have no {lost}")
    width, depth = len(node_features), 0
    while f"self{depth}" in weights:
        wide = weights[f"self{depth}"].shape[1]
        for name, shape in ((f"self{depth}", (width, wide)), (f"nbr{depth}", (width, wide)), (f"bias{depth}", (wide,))):
            if name not in weights or weights[name].shape != shape:
                raise ValueError(f"{name} should have the shape {shape}")
        width, depth = wide, depth + 1
    taken = 2 * width + len(edge_features) + time_dim
    wide = weights["hidden"].shape[1] if "hidden" in weights else 0
    for name, shape in (("hidden", (taken, wide)), ("hidden_b", (wide,)), ("last", (wide,)), ("last_b", ())):
        if name not in weights or weights[name].shape != shape:
            raise ValueError(f"{name} should have the shape {shape}")
    return depth


def rescore(spark: SparkSession, path: str, edges: DataFrame, nodes: DataFrame, time_dim: int = 0) -> DataFrame:
    """edge_id, score of edges(edge_id, src, dst, t, features) by a saved model: mean neighbour layers with ReLU over
    nodes(node_id, features), then two layers on both ends, the edge's features and a sine code of its time."""
    weights, node_features, edge_features = load_weights(spark, path)
    depth = check_weights(weights, node_features, edge_features, time_dim, nodes, edges)
    columns, known = node_features, nodes
    for k in range(depth):
        h = materialize(S.sage_layer(edges, known, columns, weights[f"self{k}"], weights[f"nbr{k}"], weights[f"bias{k}"]), "hidden")
        columns = [f"h{i}" for i in range(weights[f"self{k}"].shape[1])]
        known = h.select("node_id", *[F.col("h")[i].alias(c) for i, c in enumerate(columns)])
    hidden = known.select("node_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("h"))
    more = edge_features
    if time_dim:
        edges = _scaled_time(edges)
        code = X.sinusoid(F.col("_s"), time_dim)
        edges = edges.select("*", *[code[k].alias(f"_code{k}") for k in range(time_dim)])
        more = edge_features + [f"_code{k}" for k in range(time_dim)]
    return S.edge_mlp(edges, hidden, more, weights["hidden"], weights["hidden_b"], weights["last"], float(weights["last_b"]))
