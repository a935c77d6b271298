"""python -m tallygraph COMMAND: builds graph tables, splits them, ranks features, replays node memory and scores with saved weights."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import embedding as E
from .operators import graph as G
from .operators import layouts as B
from .operators import metrics as M
from .operators import models as L
from .operators import opportunity as R
from .operators import splits as P
from .plans.session import session
from .sources import config, readers


def graph(spark: SparkSession, a: argparse.Namespace) -> None:
    """Transfers and accounts to the tables of a layout."""
    tx = B.in_time_order(readers.read_transfers(spark, a.transfers))
    accounts = readers.read_accounts(spark, a.accounts)
    theory = R.opportunity(tx, accounts, readers.read_patterns(spark, a.patterns)) if B.LAYOUTS[a.layout].theory else None
    B.write_graph(B.build(tx, a.layout, accounts, theory), a.graph_folder, tx, layout=a.layout)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """A graph's edges to chronological (or, for static ones, label by label) parts, with the nodes that each part touches."""
    ratios = (a.train_ratio, a.val_ratio, a.test_ratio)
    if min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError(f"the ratios {ratios} should sum to 1")
    edges = B.read_graph(spark, a.graph_folder).edges
    tx = edges.select(F.col("edge_id").alias("row_id"), "ts", "label", "src", "dst")
    if a.by_label:
        parts = P.stratified(tx, a.train_ratio, a.val_ratio, a.seed)
    else:
        parts = P.chronological(tx, a.train_ratio, a.val_ratio)
    out = a.out_dir or f"{a.graph_folder}/splits"
    parts.select(F.col("row_id").alias("edge_id"), "split").write.partitionBy("split").parquet(f"{out}/edges")
    done = spark.read.parquet(f"{out}/edges").withColumnRenamed("edge_id", "row_id")
    P.node_masks(tx, done).write.parquet(f"{out}/nodes")
    sizes = {r["split"]: r["count"] for r in done.groupBy("split").count().collect()}
    B.write_json(spark, {"sizes": sizes, "ratios": ratios, "seed": a.seed, "by_label": a.by_label}, f"{out}/manifest")


def importance(spark: SparkSession, a: argparse.Namespace) -> None:
    """A table's numeric columns by their weight in a forest, and the first top_k of them."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(a.csv_path).withColumnRenamed(a.label_col, "label")
    columns = [c for c in G.numeric_columns(df) if c != "label"]
    ranked = L.forest_importance(df.select("label", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns)
    ranked.write.parquet(f"{a.out_dir}/importance")
    ranked = spark.read.parquet(f"{a.out_dir}/importance")
    top = [r[0] for r in ranked.orderBy(F.desc("importance"), "feature").select("feature").limit(a.top_k).collect()]
    B.write_json(spark, top, f"{a.out_dir}/top_features")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """A graph's edges by saved weights, with metrics, in the folders that the settings name."""
    s = config.load(spark, a.config, a.dataset, a.base_config, a.intensity, a.root)
    folder = s.folders["graph"] + (f"_{a.graph_suffix}" if a.graph_suffix else "")
    g = B.read_graph(spark, folder)
    scores = E.rescore(spark, a.weights, g.edges.withColumnRenamed("ts", "t"), g.nodes, int(s.model["model"].get("time_dim", 0)))
    scores.write.parquet(f"{s.folders['results']}/scores")
    scores = spark.read.parquet(f"{s.folders['results']}/scores")
    pred = M.checked(M.align(scores, g.edges.select("edge_id", "label")))
    row = M.evaluate(pred, float(s.base["evaluation"].get("threshold", 0.5))).first().asDict()
    B.write_json(spark, row, f"{s.folders['results']}/metrics")
    config.save(spark, s, weights=a.weights)


def memory(spark: SparkSession, a: argparse.Namespace) -> None:
    """Node memory of an event table, replayed by batches of time-ordered events; weights are saved ones."""
    from .streaming import memory as Y

    edges = B.read_graph(spark, a.graph_folder).edges
    weights, _, columns = E.load_weights(spark, a.weights)
    layers = []
    while f"message{len(layers)}" in weights:
        layers.append((weights[f"message{len(layers)}"], weights[f"message{len(layers)}_b"]))
    cell = {k: weights[k] for k in ("w_in", "w_hid", "b_in", "b_hid")}
    model = Y.MemoryModel(a.memory_dim, tuple(columns), a.time_dim, a.aggregator, tuple(layers), a.memory_updater, cell, eager=a.memory_update_at_end)
    events = edges.select(F.col("edge_id").alias("row_id"), F.col("ts").alias("t"), "src", "dst", *columns)
    state = Y.NodeState(spark, a.state, keep=a.keep)
    state.replay(Y.stored_batches(P.batches(events, a.bs, "t", "row_id")), model)
    B.write_json(spark, {"versions": state.versions(), "weights": a.weights}, f"{a.state}/run")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallygraph", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *needed: str, **given: object) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        for name, value in given.items():
            p.add_argument(f"--{name}", default=value, type=type(value) if value is not None else str)
        return p

    command(graph, "transfers", "accounts", "graph_folder", patterns=None).add_argument("--layout", choices=B.LAYOUTS, required=True)
    command(split, "graph_folder", out_dir=None, train_ratio=0.6, val_ratio=0.2, test_ratio=0.2, seed=42).add_argument("--by_label", action="store_true")
    command(importance, "csv_path", label_col="Is Laundering", top_k=20, out_dir="results/feature_importance")
    command(score, "config", "dataset", "weights", intensity=None, base_config="configs/base.yaml", graph_suffix=None, root=".")
    p = command(memory, "graph_folder", "weights", "state", bs=200, memory_dim=172, time_dim=100, keep=2)
    p.add_argument("--aggregator", choices=("last", "mean"), default="last")
    p.add_argument("--memory_updater", choices=("gru", "rnn"), default="gru")
    p.add_argument("--memory_update_at_end", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "graph" and B.LAYOUTS[a.layout].theory and not a.patterns:
        raise SystemExit("a theory layout needs --patterns")
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
