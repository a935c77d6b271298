"""Forward passes of graph models: neighbour aggregation in SQL, small dense layers in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def neighbour_aggregate(edges: DataFrame, nodes: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """node_id and, for each column, its ``mean`` or ``max`` over the sources of the node's incoming edges (0 without any)."""
    f = {"mean": F.avg, "max": F.max}[how]
    src = nodes.select(F.col("node_id").alias("src"), *[F.col(c).cast("double").alias(c) for c in columns])
    agg = edges.select("src", "dst").join(src, "src").groupBy(F.col("dst").alias("node_id")).agg(*[f(c).alias(f"{how}_{c}") for c in columns])
    return nodes.select("node_id").join(agg, "node_id", "left").select("node_id", *[F.coalesce(f"{how}_{c}", F.lit(0.0)).alias(f"{how}_{c}") for c in columns])


def mean_neighbours(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    return neighbour_aggregate(edges, nodes, columns)


def dense(df: DataFrame, columns: list[str], weights: np.ndarray, bias: np.ndarray, out: str, relu: bool = False) -> DataFrame:
    """df with array column ``out`` = columns @ weights + bias."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = b[columns].to_numpy(float) @ weights + bias
            b[out] = list(np.maximum(y, 0) if relu else y)
            yield b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` array<double>")


def perceptron(df: DataFrame, columns: list[str], layers: list[tuple[np.ndarray, np.ndarray]], out: str) -> DataFrame:
    """df with array column ``out``: the columns through dense layers (weights, bias) with ReLU between them. Two layers
    are a message function; 80, 10 and 1 units a decoder of node memories, whose sigmoid is the probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = b[columns].to_numpy(float)
            for k, (w, bias) in enumerate(layers):
                y = np.maximum(y, 0) @ w + bias if k else y @ w + bias
            b[out] = list(y)
            yield b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` array<double>")


def times_on_targets(edges: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """node_id and e0, e1, ...: sine codes of the days of edges(src, dst, t in seconds), averaged over a node's incoming
    edges; zeros without any."""
    codes = X.sinusoid(F.col("t") / 86400.0, dim)
    agg = edges.groupBy(F.col("dst").alias("node_id")).agg(*[F.avg(codes[k]).alias(f"e{k}") for k in range(dim)])
    return nodes.select("node_id").join(agg, "node_id", "left").select("node_id", *[F.coalesce(f"e{k}", F.lit(0.0)).alias(f"e{k}") for k in range(dim)])


def edge_probabilities(edges: DataFrame, negatives: DataFrame, hidden: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> DataFrame:
    """edge_id, pos, neg: probability of edges(edge_id, src, dst) and of the same source with the drawn target of
    negatives(edge_id, neg_dst), by one merge layer on hidden(node_id, h). A node without vector drops its edge."""
    h = lambda side: hidden.select(F.col("node_id").alias(side), F.col("h").alias(f"h_{side}"))
    rows = edges.select("edge_id", "src", "dst").join(negatives.select("edge_id", "neg_dst"), "edge_id")
    for side in ("src", "dst", "neg_dst"):
        rows = rows.join(h(side), side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                own = np.stack(b["h_src"])
                score = lambda to: _sigmoid(np.maximum(np.hstack([own, np.stack(b[to])]) @ w1 + b1, 0) @ w2 + b2)  # noqa: B023, E731
                yield pd.DataFrame({"edge_id": b["edge_id"], "pos": score("h_dst"), "neg": score("h_neg_dst")})

    return rows.mapInPandas(run, "edge_id long, pos double, neg double")


def sage_layer(edges: DataFrame, nodes: DataFrame, columns: list[str], w_self: np.ndarray, w_nbr: np.ndarray, bias: np.ndarray, how: str = "mean") -> DataFrame:
    """node_id, h: relu(x @ w_self + mean (or max) of in-neighbours @ w_nbr + bias)."""
    x = nodes.select("node_id", *[F.col(c).cast("double").alias(c) for c in columns]).join(neighbour_aggregate(edges, nodes, columns, how), "node_id")
    return dense(x, columns + [f"{how}_{c}" for c in columns], np.vstack([w_self, w_nbr]), bias, "h", relu=True).select("node_id", "h")


def edge_mlp(edges: DataFrame, hidden: DataFrame, columns: list[str], w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> DataFrame:
    """edge_id, score: sigmoid of a two-layer perceptron on [h_src, h_dst, edge columns]."""
    h = lambda side: hidden.select(F.col("node_id").alias(side), F.col("h").alias(f"h_{side}"))
    rows = edges.select("edge_id", "src", "dst", *[F.col(c).cast("double").alias(c) for c in columns]).join(h("src"), "src").join(h("dst"), "dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.hstack([np.stack(b["h_src"]), np.stack(b["h_dst"]), b[columns].to_numpy(float)])
                z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
                yield pd.DataFrame({"edge_id": b["edge_id"], "score": 1 / (1 + np.exp(-z))})

    return rows.mapInPandas(run, "edge_id long, score double")


def batch_attention(df: DataFrame, vector: str, batch: str, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray, heads: int) -> DataFrame:
    """Multi-head self-attention among the rows of each batch (a column; batches have a bounded size): edge_id, att."""
    dim = wq.shape[1] // heads

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows[vector])
        q, k, v = (np.stack(np.split(x @ w, heads, axis=1)) for w in (wq, wk, wv))
        s = q @ k.transpose(0, 2, 1) / np.sqrt(dim)
        s = np.exp(s - s.max(axis=-1, keepdims=True))
        out = np.concatenate(list((s / s.sum(axis=-1, keepdims=True)) @ v), axis=1)
        return pd.DataFrame({"edge_id": rows["edge_id"], "att": list(out)})

    return df.select("edge_id", vector, batch).groupBy(batch).applyInPandas(run, "edge_id long, att array<double>")


def neighbour_attention(padded: DataFrame, features: DataFrame, w: np.ndarray) -> DataFrame:
    """node, t, z: neighbours' vectors weighted by softmax of their product with the node's own; zeros without neighbours.

    padded holds (node, t, nbr); features (node_id, x).
    """
    rows = padded.select("node", "t", F.posexplode_outer("nbr").alias("k", "nbr_id")).filter("nbr_id > 0 or k = 0")
    own = features.select(F.col("node_id").alias("node"), F.col("x").alias("xq"))
    nbr = features.select(F.col("node_id").alias("nbr_id"), F.col("x").alias("xk"))
    rows = rows.join(own, "node").join(nbr, "nbr_id", "left").groupBy("node", "t", "xq").agg(F.collect_list("xk").alias("xs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = []
            for xq, xs in zip(b["xq"], b["xs"]):
                m = np.array([list(x) for x in xs]) if len(xs) else np.zeros((0, len(xq)))
                s = m @ w @ np.array(xq) if len(m) else np.zeros(0)
                a = np.exp(s - s.max()) if len(s) else s
                z.append((a / a.sum()) @ m if len(s) else np.zeros(len(xq)))
            yield pd.DataFrame({"node": b["node"], "t": b["t"], "z": z})

    return rows.mapInPandas(run, f"node {padded.schema['node'].dataType.simpleString()}, t {padded.schema['t'].dataType.simpleString()}, z array<double>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def recurrent_cell(x: np.ndarray, h: np.ndarray, w_in: np.ndarray, w_hid: np.ndarray, b_in: np.ndarray, b_hid: np.ndarray, kind: str = "gru") -> np.ndarray:
    """New memories of rows: a GRU cell (weights of reset, update and new gate side by side) or a tanh RNN cell."""
    a, b = x @ w_in + b_in, h @ w_hid + b_hid
    if kind == "rnn":
        return np.tanh(a + b)
    (ar, az, an), (br, bz, bn) = np.split(a, 3, axis=1), np.split(b, 3, axis=1)
    z = _sigmoid(az + bz)
    return (1 - z) * np.tanh(an + _sigmoid(ar + br) * bn) + z * h


def update_memory(memory: DataFrame, msgs: DataFrame, weights: dict[str, np.ndarray], kind: str = "gru") -> DataFrame:
    """memory(node, memory, last_update) after one message a node of msgs(node, msg, t); nodes without a message stay, new
    ones start from zeros. A message from before its node's last update is an error."""
    size = weights["w_hid"].shape[0]
    rows = memory.join(msgs.select("node", "msg", "t"), "node", "full")
    late = F.col("t") < F.col("last_update")
    rows = rows.withColumn("t", F.when(late, F.raise_error(F.lit("a message from before the last update")).cast(msgs.schema["t"].dataType)).otherwise(F.col("t")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.array([np.zeros(size) if m is None else np.asarray(m) for m in b["memory"]]).reshape(-1, size)
            has = np.array([m is not None for m in b["msg"]], bool)
            if has.any():
                h[has] = recurrent_cell(np.stack(b["msg"][has].to_list()), h[has], **weights, kind=kind)
            yield pd.DataFrame({"node": b["node"], "memory": list(h), "last_update": b["t"].where(b["t"].notna(), b["last_update"]).astype("int64")})

    return rows.mapInPandas(run, f"node {rows.schema['node'].dataType.simpleString()}, memory array<double>, last_update long")
