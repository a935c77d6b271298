"""Splits, ranking metrics, temporal neighbours, layers and state against brute force."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.operators import checks, graph, metrics, scoring, splits, temporal
from tallygraph.plans import work
from tallygraph.plans.work import global_index, running_totals
from tallygraph.sources import readers
from tallygraph.streaming import state


def at(seconds):
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)


def transfers(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, at(r.randint(0, 40)), r.randint(0, 6), r.randint(0, 6), float(r.randint(1, 9)), float(r.randint(1, 9)), int(r.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, ts timestamp_ntz, src long, dst long, amt_paid double, amt_rec double, label int")


@pytest.mark.parametrize("n,sizes", [(10, (6, 2, 2)), (11, (6, 2, 3)), (7, (4, 1, 2))])
def test_split_sizes(spark, n, sizes):
    tx = transfers(spark, n)
    got = {r["split"]: r["count"] for r in splits.chronological(tx).groupBy("split").count().collect()}
    assert tuple(got[k] for k in ("train", "val", "test")) == sizes


def test_stratified_split_keeps_shares(spark):
    tx = transfers(spark, 100)
    rows = splits.stratified(tx).groupBy("label", "split").count().collect()
    by = {(r["label"], r["split"]): r["count"] for r in rows}
    for y in (0, 1):
        n = sum(v for k, v in by.items() if k[0] == y)
        assert by[y, "train"] == int(n * 0.6)


def test_order_helpers(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"), F.lit(1).alias("v"))
    assert all(r["i"] == r["k"] for r in global_index(df, "i", "k").collect())
    assert all(r["below_v"] == r["k"] for r in running_totals(df, "k", ["v"]).collect())


def pred(spark, rows):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], "edge_id long, label int, score double")


def test_metrics_on_the_small_example(spark):
    p = pred(spark, list(zip([1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.8, 0.4, 0.3, 0.1])))
    r = metrics.ranking_metrics(p).first()
    assert r["roc_auc"] == pytest.approx(13 / 18) and r["average_precision"] == pytest.approx(0.7555556)
    c = metrics.confusion(p).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 1, 2)
    m = metrics.threshold_metrics(p).first()
    assert m["f1"] == pytest.approx(2 / 3) and m["mcc"] == pytest.approx(1 / 3) and m["kappa"] == pytest.approx(1 / 3)
    b = metrics.best_threshold(p).first()
    assert b["threshold"] == pytest.approx(0.1035679, abs=1e-6) and b["f1"] == pytest.approx(0.75)


def test_single_class(spark):
    p = pred(spark, [(0, 0.1), (0, 0.2)])
    assert metrics.ranking_metrics(p).first()["roc_auc"] is None
    c = metrics.confusion(p).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (0, 0, 0, 0)


def test_metrics_against_brute_force(spark):
    r = random.Random(4)
    rows = [(int(r.random() < 0.3), r.randint(0, 20) / 20) for _ in range(150)]
    got = metrics.ranking_metrics(pred(spark, rows)).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        said = [y for y, s in rows if s >= t]
        ap += (sum(said) / len(pos) - last) * sum(said) / len(said)
        last = sum(said) / len(pos)
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    grid = np.linspace(0.01, 0.99, 200)
    f1 = [2 * sum(y for y, s in rows if s >= t) / max(1, sum(s >= t for _, s in rows) + len(pos)) for t in grid]
    b = metrics.best_threshold(pred(spark, rows)).first()
    assert b["f1"] == pytest.approx(max(f1)) and b["threshold"] == pytest.approx(grid[int(np.argmax(f1))])


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_are_strictly_earlier(spark, k):
    tx = transfers(spark)
    adj = [(r["node"], r["nbr"], r["edge_id"], r["t"]) for r in temporal.adjacency(tx).collect()]
    probes = [(n, t) for n in range(7) for t in (0, 5, 17, 40)]
    got = temporal.neighbours(tx, spark.createDataFrame(probes, "node long, t long"), k).collect()
    want = set()
    for n, t in probes:
        best = sorted((e for e in adj if e[0] == n and e[3] < t), key=lambda e: (-e[3], -e[2], -e[1]))[:k]
        want |= {(n, t, i + 1, e[1], e[2], e[3]) for i, e in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_padding(spark):
    tx = spark.createDataFrame([(i, at(t), 1, 9, 1.0, 1.0, 0) for i, t in enumerate((1, 1, 3, 5), 1)], "row_id long, ts timestamp_ntz, src long, dst long, amt_paid double, amt_rec double, label int")
    probes = spark.createDataFrame([(1, 3), (1, 1)], "node long, t long")
    left = {r["t"]: r["edge_id"] for r in temporal.padded_neighbours(tx, probes, 3).collect()}
    right = {r["t"]: r["edge_id"] for r in temporal.padded_neighbours(tx, probes, 3, pad_left=False).collect()}
    assert left == {3: [0, 1, 2], 1: [0, 0, 0]} and right[3] == [2, 1, 0]


def test_messages(spark):
    tx = transfers(spark)
    m = temporal.messages(tx).toPandas()
    last = {r["node"]: list(r["msg"]) for r in temporal.last_message(temporal.messages(tx)).collect()}
    for node, g in m.groupby("node"):
        assert last[node] == list(g.sort_values(["t", "seq"]).iloc[-1]["msg"])


def test_mean_neighbours_and_dense(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "node_id long, x double")
    edges = spark.createDataFrame([(0, 0, 2), (1, 1, 2)], "edge_id long, src long, dst long")
    got = {r["node_id"]: r["mean_x"] for r in scoring.mean_neighbours(edges, nodes, ["x"]).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 2.0}
    h = scoring.sage_layer(edges, nodes, ["x"], np.array([[1.0]]), np.array([[-1.0]]), np.zeros(1))
    assert {r["node_id"]: r["h"] for r in h.collect()} == {0: [1.0], 1: [3.0], 2: [3.0]}
    s = scoring.edge_mlp(edges, h, [], np.ones((2, 1)), np.zeros(1), np.ones(1), 0.0).collect()
    assert {r["edge_id"]: round(r["score"], 6) for r in s} == {0: round(1 / (1 + np.exp(-4)), 6), 1: round(1 / (1 + np.exp(-6)), 6)}


def test_attention_layers(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 1)], "edge_id long, v array<double>, batch int")
    eye = np.eye(2)
    got = {r["edge_id"]: r["att"] for r in scoring.batch_attention(df, "v", "batch", eye, eye, eye, 1).collect()}
    w = np.exp(1 / np.sqrt(2))
    assert got[2] == [1.0, 1.0] and got[0] == pytest.approx([w / (w + 1), 1 / (w + 1)])
    padded = spark.createDataFrame([(1, 5, [2, 0]), (2, 5, [0, 0])], "node long, t long, nbr array<long>")
    feats = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0])], "node_id long, x array<double>")
    z = {r["node"]: r["z"] for r in scoring.neighbour_attention(padded, feats, eye).collect()}
    assert z == {1: [0.5, 2.0], 2: [0.0, 0.0]}


def test_checks(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0, 0), (0, 1, 9, float("nan"), 2)], "edge_id long, src long, dst long, f double, label int")
    nodes = spark.createDataFrame([(1,), (2,)], "node_id long")
    got = {r["check"]: r["n"] for r in checks.edge_failures(edges, nodes, ["f"]).collect()}
    assert got == {"dangling": 1, "bad_features": 1, "bad_labels": 1, "repeated_ids": 1}
    assert checks.injection_failures(edges, ["RAT_score"]).count() == 1


def test_memory_replay(spark):
    tx = transfers(spark, 30)
    got = {r["node"]: (r["memory"], r["last_update"]) for r in state.replay_memory(tx, 10).collect()}
    rows = sorted(tx.collect(), key=lambda r: (r["ts"], r["row_id"]))
    mem, seen = {}, {}
    t = lambda r: int((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds())
    for b in sorted({t(r) // 10 for r in rows}):
        msgs = {}
        for r in (r for r in rows if t(r) // 10 == b):
            m = (mem.get(r["src"], 0) + mem.get(r["dst"], 0) + r["amt_paid"]) / 3
            msgs[r["src"]] = msgs[r["dst"]] = m
            seen[r["src"]] = seen[r["dst"]] = t(r)
        mem |= {n: 0.5 * mem.get(n, 0) + 0.5 * m for n, m in msgs.items()}
    assert {n: (pytest.approx(m), seen[n]) for n, m in mem.items()} == got


def test_stream_gaps_equal_batch_gaps(spark, tmp_path):
    tx = transfers(spark, 40).select("row_id", "src", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")).toPandas().sort_values(["t", "row_id"])
    for k in range(4):  # four files, in order of time
        part = tx.iloc[k * 10 : k * 10 + 10]
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({c: int(v) for c, v in r.items()}) for r in part.to_dict("records")))
        import os

        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("src long, row_id long, t long").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = state.stream_gaps(stream).writeStream.format("memory").queryName("gaps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["row_id"]: r["gap"] for r in spark.table("gaps").collect()}
    want = tx["t"] - tx.groupby("src")["t"].shift(1)
    assert got == dict(zip(tx["row_id"], want.fillna(0).astype(int)))


def test_ablations(spark):
    df = spark.range(1).select(F.col("id").alias("row_id"), *[F.lit(k).alias(c) for k, c in enumerate(splits.FULL_FEATURES)])
    assert len(splits.FULL_FEATURES) == 58 and len(splits.TOP20_FEATURES) == 20
    for group, gone in splits.ABLATION_GROUPS.items():
        assert set(gone) < set(splits.FULL_FEATURES)
        assert splits.ablate(df, group).columns == ["row_id", *[c for c in splits.FULL_FEATURES if c not in gone]]
    assert splits.keep_columns(df, splits.TOP20_FEATURES).columns == ["row_id", *splits.TOP20_FEATURES]
    with pytest.raises(ValueError):
        splits.ablate(df.drop("hour_of_day"), "no_temp")
    with pytest.raises(ValueError):
        splits.keep_columns(df, ["x"])


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(0, 9, 300), rng.normal(0, 1, 200)]).astype(float)
    rows = [("a" if k % 3 else "hub", float(v) if k % 50 else None) for k, v in enumerate(values)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["share"]): r["quantile"] for r in work.quantiles_by(df, "g", "v", [0.0, 0.37, 0.95, 1.0]).collect()}
    for g in ("a", "hub", "one"):
        mine = [v for k, v in rows if k == g and v is not None]
        for q in (0.0, 0.37, 0.95, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(mine, q))
    assert ("none", 0.37) not in got
    row = work.quantile_row(df, {"x": (F.col("v"), 0.5), "y": (-F.col("v"), 0.9)}).first()
    every = [v for _, v in rows if v is not None]
    assert (row["x"], row["y"]) == (pytest.approx(np.quantile(every, 0.5)), pytest.approx(np.quantile([-v for v in every], 0.9)))
    assert work.quantile_row(df.limit(0), {"x": (F.col("v"), 0.5)}).first()["x"] is None


def test_early_stop_follows_the_rule(spark):
    def brute(values, rounds, higher):
        best, at, waited = None, 0, 0
        for k, v in enumerate(values):
            v = v if higher else -v
            if best is None or (v - best) / abs(best) > 1e-10:
                best, at, waited = v, k, 0
            else:
                waited += 1
            if waited >= rounds:
                return at, k
        return at, None

    rng = random.Random(3)
    for higher in (True, False):
        for _ in range(4):
            values = [round(rng.uniform(0.1, 1), 2) for _ in range(rng.randint(1, 14))]
            log = spark.createDataFrame(list(enumerate(values)), "epoch long, v double")
            r = metrics.early_stop(log, "v", 3, higher).first()
            assert (r["best_epoch"], r["stop_epoch"]) == brute(values, 3, higher)


def test_memory_cells(spark):
    rng = np.random.default_rng(2)
    w = {"w_in": rng.normal(size=(2, 9)), "w_hid": rng.normal(size=(3, 9)), "b_in": rng.normal(size=9), "b_hid": rng.normal(size=9)}
    x, h = rng.normal(size=2), rng.normal(size=3)
    memory = spark.createDataFrame([(1, h.tolist(), 5), (2, h.tolist(), 6)], "node long, memory array<double>, last_update long")
    msgs = spark.createDataFrame([(1, x.tolist(), 7), (3, x.tolist(), 8)], "node long, msg array<double>, t long")
    got = {r["node"]: (r["memory"], r["last_update"]) for r in scoring.update_memory(memory, msgs, w).collect()}

    def gru(h):
        s = lambda v: 1 / (1 + np.exp(-v))
        a, b = x @ w["w_in"] + w["b_in"], h @ w["w_hid"] + w["b_hid"]
        r, z = s(a[:3] + b[:3]), s(a[3:6] + b[3:6])
        return (1 - z) * np.tanh(a[6:] + r * b[6:]) + z * h

    assert got[1] == (pytest.approx(gru(h)), 7) and got[2] == (pytest.approx(h), 6) and got[3] == (pytest.approx(gru(np.zeros(3))), 8)
    rnn = {"w_in": w["w_in"][:, :3], "w_hid": w["w_hid"][:, :3], "b_in": w["b_in"][:3], "b_hid": w["b_hid"][:3]}
    got = {r["node"]: r["memory"] for r in scoring.update_memory(memory, msgs, rnn, "rnn").collect()}
    assert got[1] == pytest.approx(np.tanh(x @ rnn["w_in"] + rnn["b_in"] + h @ rnn["w_hid"] + rnn["b_hid"]))
    with pytest.raises(Exception, match="before the last update"):
        scoring.update_memory(memory, msgs.withColumn("t", F.lit(1).cast("long")), w).collect()


def test_reindex_and_timestamps(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (1, 0, 2)], "u long, i long, idx long")
    assert sorted(map(tuple, graph.reindex(df).collect())) == [(1, 3, 1), (2, 3, 3), (2, 4, 2)]
    assert sorted(map(tuple, graph.reindex(df, bipartite=False).collect())) == [(1, 1, 1), (2, 1, 3), (2, 2, 2)]
    with pytest.raises(ValueError):
        graph.reindex(df.withColumn("i", F.col("i") * 3))
    tx = readers.with_timestamps(spark.range(3).withColumnRenamed("id", "row_id"))
    assert [r["ts"] for r in tx.orderBy("row_id").collect()] == [at(0), at(60), at(120)]
    assert readers.with_timestamps(tx) is tx


def test_samples(spark):
    tx = transfers(spark, 100)
    assert splits.sample(tx, "row_id", 10).count() == 10
    rows = splits.balanced_sample(tx, "row_id", "label", 10).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == {0: 5, 1: 5}


def test_theory_type_and_numeric_columns(spark):
    assert graph.theory_type(["a", "SLT_x", "motif_y"]) == ("SLT-injected", ("SLT_", "motif_"))
    with pytest.raises(ValueError):
        graph.theory_type(["motif_y"])
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert graph.numeric_columns(df) == ["a", "b"]


def test_engineered_takes_what_there_is(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "x", "x")], "row_id int, from_bank string, to_bank string")
    got = graph.engineered(df)
    assert got.columns == ["row_id", "from_bank", "to_bank", "same_bank"]
    assert [r["same_bank"] for r in got.orderBy("row_id").collect()] == [0, 1]


def test_decoder_of_three_layers(spark):
    rng = np.random.default_rng(3)
    layers = [(rng.normal(size=s), rng.normal(size=s[1])) for s in ((4, 80), (80, 10), (10, 1))]
    x = rng.normal(size=(7, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = {r["id"]: r["y"][0] for r in scoring.perceptron(df, ["a", "b", "c", "d"], layers, "y").collect()}
    for i, r in enumerate(x):
        h = np.maximum(r @ layers[0][0] + layers[0][1], 0)
        h = np.maximum(h @ layers[1][0] + layers[1][1], 0)
        assert abs(got[i] - (h @ layers[2][0] + layers[2][1])[0]) < 1e-9
