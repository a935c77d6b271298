"""Graph layouts on disk, settings, command lines, input checks and row numbers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph import __main__ as command
from tallygraph.functions import exprs as X
from tallygraph.operators import checks, layouts, metrics, splits
from tallygraph.operators import embedding as E
from tallygraph.sources import config, readers
from tallygraph.streaming.memory import NodeState

HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Sixty transfers in no order of time, accounts, and the settings of a small model."""
    r, top = random.Random(3), tmp_path_factory.mktemp("files")
    lines = [f"2022/09/{r.randint(1, 9):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d},0{r.randint(1, 3)},A{r.randint(0, 7)},01,A{r.randint(0, 7)},{r.random() * 90:.2f},{r.choice(layouts.CURRENCIES)},{r.random() * 90:.2f},Euro,{r.choice(X.FORMATS)},{i % 5 // 4}" for i in range(60)]
    (top / "trans.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    (top / "accounts.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n" + "".join(f"B,01,A{k},E{k // 2},{'Corporation' if k % 2 else 'Sole Proprietorship'} #{k}\n" for k in range(7)))
    (top / "patterns.txt").write_text("A1\nA2\n")
    base = {"experiment": {"seed": 4, "name": "s"}, "paths": {"root": "", "graphs_dir": "graphs", "tgat_graphs_dir": "graphs_tgat", "splits_dir": "splits", "tgat_splits_dir": "splits_tgat", "results_dir": "results", "logs_dir": "logs"}, "evaluation": {"threshold": 0.5}}
    model = {"model": {"name": "Graph SAGE", "time_dim": 2}, "training": {}, "loss": {}}
    data = {"dataset": {"theory": "baseline", "prefix": "HI", "requires_intensity": False}}
    for name, value in (("base", base), ("model", model), ("data", data)):
        (top / f"{name}.json").write_text(json.dumps(value))
    return top, base, model, data


def test_rows_are_numbered_by_file_and_place(spark, files):
    path = str(files[0] / "trans.csv")
    want = (files[0] / "trans.csv").read_text().splitlines()[1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "900b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.read_transfers(spark, path).orderBy("row_id").collect()
            assert [r["row_id"] for r in rows] == list(range(60))
            assert [(r["src"], r["dst"], r["fmt"]) for r in rows] == [tuple(np.array(w.split(","))[[2, 4, 9]]) for w in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_events_out_of_order_are_an_error(spark, files):
    tx = readers.read_transfers(spark, str(files[0] / "trans.csv"))
    accounts = readers.read_accounts(spark, str(files[0] / "accounts.csv"))
    with pytest.raises(ValueError, match="earlier than"):
        layouts.build(tx, "events_baseline", accounts)
    assert layouts.build(tx, "static_baseline", accounts).edges.count() == 60
    ordered = layouts.in_time_order(tx)
    layouts.check_order(ordered)
    assert ordered.orderBy("row_id").select("ts").collect() == tx.orderBy("ts", "row_id").select("ts").collect()
    with pytest.raises(ValueError, match="theory"):
        layouts.build(ordered, "events_theory", accounts)
    with pytest.raises(ValueError, match="accounts"):
        layouts.build(ordered, "typed_baseline")


def test_layout_columns_and_limits(spark, files):
    top = files[0]
    tx = layouts.in_time_order(readers.read_transfers(spark, str(top / "trans.csv")))
    accounts, rng = readers.read_accounts(spark, str(top / "accounts.csv")), np.random.default_rng(1)
    theory = spark.createDataFrame([(i, float(rng.normal()) if i % 7 else None, 5.0) for i in range(60)], "row_id long, RAT_a double, motif_b double").withColumn("RAT_injected", F.lit(1))
    got = layouts.build(tx, "events_theory", accounts, theory)
    assert len(got.edge_columns) == 34 and got.edge_columns[10:12] == ["cur_recv_Australian Dollar", "cur_recv_Bitcoin"] and got.edge_columns[-2:] == ["RAT_a", "motif_b"]
    assert got.node_columns == ["out_degree", "in_degree", "total_degree", "laundering_count"]
    ends = got.edges.agg(F.max("hour_of_day").alias("h"), F.max(F.abs("RAT_a")).alias("a"), F.max(F.abs("motif_b")).alias("b")).first()
    assert ends["h"] == 10.0 and 0 < ends["a"] <= 10 and ends["b"] == 0
    coded = layouts.build(tx, "static_theory", theory=theory)
    assert len(coded.edge_columns) == 14 and "pf_code" in coded.edge_columns and len(coded.node_columns) == 6
    typed = layouts.build(tx, "typed_theory", accounts, theory)
    assert "event_type" in typed.edges.columns and {"ent_Corporation", "ent_Sole Proprietorship", "ent_Unknown"} <= set(typed.node_columns)


def test_command_lines_end_to_end(spark, files):
    top = files[0]
    graph = f"{top}/graphs/HI"
    command.main(["graph", "--transfers", f"{top}/trans.csv", "--accounts", f"{top}/accounts.csv", "--graph_folder", graph, "--layout", "typed_baseline"], spark)
    g = layouts.read_graph(spark, graph)
    manifest = layouts.read_json(spark, f"{graph}/manifest")
    assert g.edges.count() == 60 and manifest["counts"] == {"edges": 60, "nodes": 8} and manifest["layout"] == "typed_baseline"
    stats = layouts.read_json(spark, f"{graph}/graph_stats")
    assert stats["num_edges"] == 60 and stats["violations"] == 0 and spark.read.json(f"{graph}/node_mapping").count() == 8
    assert spark.read.json(f"{graph}/feature_stats").count() == len(g.edge_columns)

    command.main(["split", "--graph_folder", graph], spark)
    assert layouts.read_json(spark, f"{graph}/splits/manifest")["sizes"] == {"train": 36, "val": 12, "test": 12}
    with pytest.raises(ValueError):
        command.main(["split", "--graph_folder", graph, "--train_ratio", "0.9", "--out_dir", f"{top}/other"], spark)

    rng = np.random.default_rng(5)
    w = {"self0": rng.normal(size=(2, 3)), "nbr0": rng.normal(size=(2, 3)), "bias0": rng.normal(size=3), "hidden": rng.normal(size=(10, 4)), "hidden_b": rng.normal(size=4), "last": rng.normal(size=4), "last_b": np.array(0.3)}
    E.save_weights(spark, f"{top}/weights", w, ["log_out_degree", "log_in_degree"], ["log_amt_paid", "hour_of_day"])
    command.main(["score", "--config", f"{top}/model.json", "--dataset", f"{top}/data.json", "--base_config", f"{top}/base.json", "--weights", f"{top}/weights", "--root", str(top)], spark)
    results = f"{top}/results/HI/seed4_s/graph_sage"
    assert spark.read.parquet(f"{results}/scores").count() == 60 and 0 <= layouts.read_json(spark, f"{results}/metrics")["roc_auc"] <= 1
    assert layouts.read_json(spark, f"{results}/experiment_config")["dataset_name"] == "HI"

    m = {"w_in": rng.normal(size=(6, 6)), "w_hid": rng.normal(size=(2, 6)), "b_in": rng.normal(size=6), "b_hid": rng.normal(size=6)}
    E.save_weights(spark, f"{top}/cell", m, [], ["log_amt_paid", "hour_of_day"])
    command.main(["memory", "--graph_folder", graph, "--weights", f"{top}/cell", "--state", f"{top}/state", "--bs", "25", "--memory_dim", "2", "--time_dim", "0"], spark)
    state = NodeState(spark, f"{top}/state")
    assert state.versions() == [1, 2] and state.at()[0].count() == 8

    spark.read.parquet(f"{graph}/edges").limit(59).write.parquet(f"{top}/cut/edges")
    g.nodes.write.parquet(f"{top}/cut/nodes")
    layouts.write_json(spark, manifest, f"{top}/cut/manifest")
    with pytest.raises(ValueError, match="row counts"):
        layouts.read_graph(spark, f"{top}/cut")


def test_importance_command(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), "x") for i in range(120)]
    (tmp_path / "t.csv").write_text("a,b,c,Is Laundering\n" + "".join(f"{x},{y},{s},{int(x > 0.6)}\n" for _, x, y, s in rows))
    command.main(["importance", "--csv_path", f"{tmp_path}/t.csv", "--top_k", "1", "--out_dir", f"{tmp_path}/out"], spark)
    assert layouts.read_json(spark, f"{tmp_path}/out/top_features") == ["a"]


def test_settings(files):
    _, base, model, data = files
    s = config.merge(base, model, data, root="/data/")
    assert s.dataset_name == "HI" and s.experiment == "seed4_s" and s.folders["results"] == "/data/results/HI/seed4_s/graph_sage" and s.folders["graph"] == "/data/graphs/HI"
    rat = {"dataset": {"theory": "RAT", "prefix": "M", "requires_intensity": True}}
    tgat = {**model, "model": {"name": "TGAT"}}
    assert config.merge(base, tgat, rat, "low").folders["split"] == "./splits_tgat/M_low"
    for bad in ((base, model, rat, None), (base, model, rat, "huge"), ({"paths": {}}, model, data, None), (base, {"model": {}}, data, None)):
        with pytest.raises(ValueError):
            config.merge(*bad)


def test_settings_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("paths:\n  graphs_dir: g  # a comment\nevaluation: {threshold: 0.5}\n")
    assert config.read_settings(spark, f"{tmp_path}/a.yaml") == {"paths": {"graphs_dir": "g"}, "evaluation": {"threshold": 0.5}}


def test_checked_predictions(spark):
    make = lambda rows, kind="double": spark.createDataFrame(rows, f"edge_id long, label int, score {kind}")
    got = metrics.checked(make([(1, 1, [0.2, 0.8]), (2, 0, [0.9, 0.1]), (3, 0, [1.5])], "array<double>")).orderBy("edge_id").collect()
    assert [r["score"] for r in got] == [0.8, 0.1, 1.0]
    for bad in (make([]), make([(1, 1, None)]), make([(1, 2, 0.5)]), make([(1, None, 0.5)]), make([(1, 1, [0.1, 0.2, 0.7])], "array<double>")):
        with pytest.raises(ValueError):
            metrics.checked(bad)
    with pytest.warns(UserWarning, match="one class"):
        metrics.checked(make([(1, 1, 0.5)]))


def test_alignment_by_id(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.7)], "edge_id long, score double")
    right = spark.createDataFrame([(3, 1), (2, 0)], "edge_id long, label int")
    assert {tuple(r) for r in metrics.align(left, right, trim=True).collect()} == {(2, 0.6, 0), (3, 0.7, 1)}
    with pytest.raises(ValueError, match="only left"):
        metrics.align(left, right)
    with pytest.raises(ValueError, match="repeats"):
        metrics.align(left, right.unionAll(right), trim=True)


def test_small_helpers(spark, tmp_path):
    df = spark.range(40).withColumnRenamed("id", "row_id")
    a, b = (dict(splits.epoch_batches(df, "row_id", 16, k).select("row_id", "batch").collect()) for k in (1, 2))
    assert a != b and sorted(a) == sorted(b) == list(range(40)) and sorted(a.values()) == [0] * 16 + [1] * 16 + [2] * 8
    noisy = splits.noise(df.withColumn("x", F.lit(5.0)), "row_id", ["x"]).collect()
    assert len({r["x"] for r in noisy}) > 30 and all(0 <= r["x"] < 1 for r in noisy)
    splits.disjoint(df, df.select((F.col("row_id") + 40).alias("row_id")), "row_id")
    with pytest.raises(ValueError):
        splits.disjoint(df, df.limit(1), "row_id")
    r = spark.range(1).select(X.from_epoch(F.lit(7200)).alias("t"), X.hours_since(F.lit(7200), F.lit(1800)).alias("h")).first()
    assert r["t"].hour == 2 and r["h"] == 1.5
    assert {x["check"] for x in checks.warnings(spark.createDataFrame([(0.5, 0, 2)], "pct_laundering double, isolated long, self_loops long")).collect()} == {"positives under 1 %", "positives under 5 %", "self-loops"}
    log = spark.createDataFrame([(e, 0.5 if e == 30 else 0.1) for e in range(1, 121)], "epoch int, aupr double")
    assert {(x["epoch"], x["mark"]) for x in readers.epochs_to_show(log).collect()} == {(30, "best"), (50, ""), (100, ""), (120, "stopped")}
    assert tuple(readers.expected_range(log).first()) == (0.475, 0.5)
    inter = spark.createDataFrame([(1, 2, 0.5, 0, 0, [0.1]), (1, 3, 0.7, 1, 1, [0.2])], "u long, i long, ts double, label int, idx long, feats array<double>")
    readers.write_preprocessed(inter, str(tmp_path / "pre"))
    rows, feats = readers.read_preprocessed(spark, str(tmp_path / "pre"))
    assert rows.count() == feats.count() == 2 and "feats" not in rows.columns and readers.first_rows(rows, 1).count() == 1
    feats.filter("idx = 0").write.parquet(str(tmp_path / "bad/features"))
    rows.write.parquet(str(tmp_path / "bad/interactions"))
    with pytest.raises(ValueError):
        readers.read_preprocessed(spark, str(tmp_path / "bad"))


def test_vocabularies_are_bounded(spark, monkeypatch):
    from tallygraph.plans import work

    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string")
    assert work.vocabulary(df, "v") == ["a", "b"]
    monkeypatch.setattr(work, "MOST_COLUMNS", 1)
    with pytest.raises(ValueError, match="over 1 values"):
        work.vocabulary(df, "v")
