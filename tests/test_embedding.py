"""Embeddings and event scores against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.operators import embedding as E
from tallygraph.plans import asof
from tallygraph.plans import weights as V

from test_splits_metrics_temporal import at, transfers


def code(gap):
    return np.cos(gap * 10.0 ** (-9 * np.arange(2)))


def plain(adj, x, e, node, t, layers, k, kind):
    """The recursion as it reads: own and neighbours' embeddings of the layer below, all at t."""
    if not layers:
        return x.get(node, np.zeros(2))
    w, below = layers[-1], layers[:-1]
    own = plain(adj, x, e, node, t, below, k, kind)
    found = sorted((s, i, n) for m, n, i, s in adj if m == node and s < t)[-k:]
    slots = [(0, 0, 0)] * (k - len(found)) + found
    below_of = [plain(adj, x, e, n, t, below, k, kind) for _, _, n in slots]
    codes, edges = [code(t - s) for s, _, _ in slots], [e.get(i, np.zeros(1)) for _, i, _ in slots]
    if kind == "sum":
        total = sum(np.concatenate([z, c, f]) @ w["w1"] + w["b1"] for z, c, f in zip(below_of, codes, edges))
        return np.concatenate([np.maximum(total, 0), own, [1, 1]]) @ w["w2"] + w["b2"]
    att, q = np.zeros(4), np.concatenate([own, [1, 1]]) @ w["wq"] + w["bq"]
    real = [np.concatenate([z, f, c]) for z, c, f, (_, _, n) in zip(below_of, codes, edges, slots) if n]
    if real:
        for h in (slice(0, 2), slice(2, 4)):
            s = np.array([q[h] @ (r @ w["wk"] + w["bk"])[h] / np.sqrt(2) for r in real])
            a = np.exp(s) / np.exp(s).sum()
            att[h] = sum(p * (r @ w["wv"] + w["bv"])[h] for p, r in zip(a, real))
        att = att @ w["wo"] + w["bo"]
    return np.maximum(np.concatenate([att, own]) @ w["m1"] + w["c1"], 0) @ w["m2"] + w["c2"]


@pytest.mark.parametrize("kind,layers", [("sum", V.SUM_LAYERS), ("attention", [V.ATTENTION, V.ATTENTION])])
def test_two_layers_equal_a_plain_recursion(spark, kind, layers):
    tx = transfers(spark, 40, seed=5).withColumns({c: F.col(c) + 1 for c in ("src", "dst", "row_id")})
    rows = [(r["row_id"], r["src"], r["dst"], r["s"]) for r in tx.withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp"))).collect()]
    adj = [(s, d, i, t) for i, s, d, t in rows] + [(d, s, i, t) for i, s, d, t in rows]
    rng = np.random.default_rng(8)
    x, e = {n: rng.normal(size=2) for n in range(1, 7)}, {i: rng.normal(size=1) for i, *_ in rows if i % 4}
    memory = {n: rng.normal(size=2) for n in (1, 3)}
    seen = {n: v + memory.get(n, 0) for n, v in x.items()}
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in x.items()], "node_id long, x array<double>")
    edges = spark.createDataFrame([(i, v.tolist()) for i, v in e.items()], "edge_id long, e array<double>")
    mem = spark.createDataFrame([(n, v.tolist()) for n, v in memory.items()], "node long, memory array<double>")
    probes = spark.createDataFrame([(n, t) for n in range(1, 8) for t in (0, 7, 41)] + [(99, 41), (1, 7)], "node long, t long")
    got = E.graph_embeddings(tx, probes, nodes, edges, layers, 3, 2, kind, mem).collect()
    assert len(got) == 22
    for r in got:
        assert np.allclose(r["z"], plain(adj, seen, e, r["node"], r["t"], layers, 3, kind), atol=1e-9)


def by_step(adj, x, e, node, t, layers, k, kind):
    """As plain, by the layers' own functions, with a neighbour that is None as a pad."""
    if not layers:
        return x.get(node, np.zeros(2))
    found = sorted((s, i, n) for m, n, i, s in adj if m == node and s < t)[-k:]
    slots = [(0, 0, 0)] * (k - len(found)) + [(0, 0, 0) if f[2] is None else f for f in found]
    own, *below = [by_step(adj, x, e, n, t, layers[:-1], k, kind) for n in (node, *(n for _, _, n in slots))]
    codes, edges = [code(t - s) for s, _, _ in slots], [e.get(i, np.zeros(1)) for _, i, _ in slots]
    return E.LAYERS[kind](own[None], np.array([below]), np.array([codes]), np.array([edges]), np.array([[n == 0 for _, _, n in slots]]), layers[-1])[0]


@pytest.mark.parametrize("hub_rows,few_nodes,width", [(4, 0, 2**62), (4, 10**6, 2**62), (10**6, 10**6, 1)])
def test_cut_histories_lost_neighbours_and_three_layers(spark, monkeypatch, hub_rows, few_nodes, width):
    """Hubs in ranges and in batches of a few rows; a neighbour that is null is a pad, a probe without node or time is left out."""
    monkeypatch.setattr(asof, "HUB_ROWS", hub_rows)
    monkeypatch.setattr(asof, "FEW_NODES", few_nodes)
    monkeypatch.setattr(asof, "MOST_AT", width)
    r = np.random.default_rng(3)
    rows = [(i, 1 if i % 2 else int(r.integers(1, 7)), None if i % 9 == 4 else int(r.integers(1, 7)), int(r.integers(0, 50)), [float(r.normal())]) for i in range(1, 90)]
    tx = spark.createDataFrame([(i, at(t), s, d, e) for i, s, d, t, e in rows], "row_id long, ts timestamp_ntz, src long, dst long, e array<double>")
    adj = [(s, d, i, t) for i, s, d, t, _ in rows] + [(d, s, i, t) for i, s, d, t, _ in rows]
    x, e = {n: r.normal(size=2) for n in range(1, 6)}, {i: np.array(v) for i, *_, v in rows}
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in x.items()], "node_id long, x array<double>")
    probes = [(n, t) for n in range(1, 8) for t in (0, 9, 25, 26, 60)]
    layers = [*V.SUM_LAYERS, V.SUM_LAYERS[0]]
    for kind, used in (("sum", layers), ("attention", [V.ATTENTION, V.ATTENTION])):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        try:
            got = E.graph_embeddings(tx, spark.createDataFrame([*probes, (None, 9), (1, None)], "node long, t long"), nodes, None, used, 3, 2, kind).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((g["node"], g["t"]) for g in got) == sorted(probes)
        for g in got:
            assert np.allclose(g["z"], by_step(adj, x, e, g["node"], g["t"], used, 3, kind), atol=1e-9)


def test_layer_0_is_not_asked_for(spark, monkeypatch):
    """Two layers over three neighbours write a row for each event's end, and each probe asks for its neighbours once: no table of nodes
    at times for layer 0, which does not depend on time, and none of what was asked before."""
    written, write = {}, E.materialize

    def counted(df, name):
        table = write(df, name)
        written[name] = written.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(E, "materialize", counted)
    tx = transfers(spark, 60, seed=6).withColumns({c: F.col(c) + 1 for c in ("src", "dst", "row_id")})
    nodes = spark.createDataFrame([(n, [1.0, n / 7]) for n in range(1, 7)], "node_id long, x array<double>")
    edges = tx.select(F.col("row_id").alias("edge_id"), F.array(F.lit(0.5)).alias("e"))
    probes = spark.createDataFrame([(n, t) for n in range(1, 7) for t in range(4000, 4020)], "node long, t long")
    assert E.graph_embeddings(tx, probes, nodes, edges, V.SUM_LAYERS, 3, 2).count() == 120
    assert sum(written.values()) <= 2 * 60 + 6 + 2 * 120


def test_no_layer_and_unknown_kind(spark):
    tx = transfers(spark, 5)
    nodes = spark.createDataFrame([(1, [1.0, 2.0])], "node_id long, x array<double>")
    probes = spark.createDataFrame([(1, 3), (2, 3)], "node long, t long")
    got = {r["node"]: r["z"] for r in E.graph_embeddings(tx, probes, nodes, nodes, [], 3, 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0]}
    with pytest.raises(ValueError):
        E.graph_embeddings(tx, probes, nodes, nodes, [], 3, 2, "mean")


def sine_code(s, dim):
    w = np.exp(-np.log(10_000.0) * 2 * np.arange(dim // 2) / dim)
    return np.concatenate([np.sin(s * w), np.cos(s * w)])


def event_table(spark, n=17, seed=2):
    rng = np.random.default_rng(seed)
    x = {i: rng.normal(size=2) for i in range(5)}
    rows = [(i, int(rng.integers(0, 5)), int(rng.integers(0, 5)), int(rng.integers(0, 90)), int(i % 3), int(rng.integers(0, 2)), float(rng.normal())) for i in range(n)]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "node_id long, x array<double>")
    return x, rows, nodes, spark.createDataFrame(rows, "edge_id long, src long, dst long, t long, batch int, event_type int, amt double")


def test_attention_over_a_batch_equals_a_plain_loop(spark):
    w = V.EVENTS | V.draw(9, {"qkv1": (4, 12), "qkv1_b": (12,), "out1": (4, 4), "out1_b": (4,)})
    x, rows, nodes, events = event_table(spark)
    ts = [r[3] for r in rows]
    aff = lambda v, name: v @ w[name] + w[f"{name}_b"]
    want = {}
    for batch in range(3):
        mine = [r for r in rows if r[4] == batch]
        h = [aff(np.concatenate([aff(x[r[1]], "node"), aff(x[r[2]], "node"), [r[6]], sine_code((r[3] - min(ts)) / (max(ts) - min(ts)), 4)]), "event") for r in mine]
        for layer in range(2):
            qkv = [aff(v, f"qkv{layer}") for v in h]
            new = []
            for i in range(len(h)):
                out = np.zeros(4)
                for a in (slice(0, 2), slice(2, 4)):
                    s = np.array([qkv[i][:4][a] @ o[4:8][a] / np.sqrt(2) for o in qkv])
                    p = np.exp(s) / np.exp(s).sum()
                    out[a] = sum(c * o[8:][a] for c, o in zip(p, qkv))
                v = h[i] + aff(out, f"out{layer}")
                new.append((v - v.mean()) / np.sqrt(v.var() + 1e-5) * w["norm"] + w["norm_b"])
            h = new
        for r, v in zip(mine, h):
            want[r[0]] = 1 / (1 + np.exp(-aff(np.maximum(aff(v, "hidden"), 0), "last")[0]))
    got = {r["edge_id"]: r["score"] for r in E.attention_scores(events, nodes, ["amt"], w, 2, 2, 4).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_event_scores_from_tables(spark):
    x, rows, nodes, events = event_table(spark, seed=3)
    w, rng = V.EMBEDDED, np.random.default_rng(1)
    own, kind = {i: rng.normal(size=2) for i in range(4)}, {0: rng.normal(size=2), 1: rng.normal(size=2)}  # node 4 is in no table
    table = spark.createDataFrame([(i, v.tolist()) for i, v in own.items()], "node_id long, v array<double>")
    types = spark.createDataFrame([(i, v.tolist()) for i, v in kind.items()], "event_type int, v array<double>")
    ts, want = [r[3] for r in rows], {}
    for i, s, d, t, _, k, amt in rows:
        if 4 in (s, d):
            continue
        ends = [x[n] @ w["node"] + w["node_b"] + own[n] for n in (s, d)]
        v = np.concatenate([*ends, [amt], sine_code((t - min(ts)) / (max(ts) - min(ts)), 2), kind[k]])
        want[i] = 1 / (1 + np.exp(-(np.maximum(v @ w["hidden"] + w["hidden_b"], 0) @ w["last"] + w["last_b"])[0]))
    got = {r["edge_id"]: r["score"] for r in E.embedded_event_scores(events, nodes, table, types, ["amt"], w, 2).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_saved_weights_score_alike_and_are_checked(spark, tmp_path, monkeypatch):
    x, rows, nodes, events = event_table(spark, seed=4)
    wide = nodes.select("node_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    path = str(tmp_path / "model")
    E.save_weights(spark, path, V.SAVED, ["a", "b"], ["amt"])
    loaded, node_features, edge_features = E.load_weights(spark, path)
    assert set(loaded) == set(V.SAVED) and all(np.array_equal(loaded[k], V.SAVED[k]) for k in loaded) and (node_features, edge_features) == (["a", "b"], ["amt"])
    h = dict(x)
    for k in range(2):
        means = {n: np.mean([h[r[1]] for r in rows if r[2] == n], axis=0) if any(r[2] == n for r in rows) else 0 * h[n] for n in h}
        h = {n: np.maximum(v @ V.SAVED[f"self{k}"] + means[n] @ V.SAVED[f"nbr{k}"] + V.SAVED[f"bias{k}"], 0) for n, v in h.items()}
    ts = [r[3] for r in rows]
    got = {r["edge_id"]: r["score"] for r in E.rescore(spark, path, events, wide, 2).collect()}
    for r in rows:
        v = np.concatenate([h[r[1]], h[r[2]], [r[6]], sine_code((r[3] - min(ts)) / (max(ts) - min(ts)), 2)])
        assert abs(got[r[0]] - 1 / (1 + np.exp(-(np.maximum(v @ V.SAVED["hidden"] + V.SAVED["hidden_b"], 0) @ V.SAVED["last"] + V.SAVED["last_b"])))) < 1e-9
    with pytest.raises(ValueError, match="have no"):
        E.rescore(spark, path, events.drop("amt"), wide, 2)
    with pytest.raises(ValueError, match="hidden should"):
        E.rescore(spark, path, events, wide, 4)
    monkeypatch.setattr(E, "MAX_WEIGHTS", 3)
    with pytest.raises(ValueError, match="more than"):
        E.load_weights(spark, path)
