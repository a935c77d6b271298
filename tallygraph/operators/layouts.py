"""Complete graph tables in the layouts that models read: edges or events with all features, nodes, and JSON beside them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.work import global_index, materialize, vocabulary
from ..sources.readers import one_per_account
from . import graph as G

#: Receiving currencies of the fixed vocabulary; fixed values.
CURRENCIES = ("Australian Dollar", "Bitcoin", "Brazil Real", "Canadian Dollar", "Euro", "Mexican Peso", "Ruble", "Rupee", "Saudi Riyal", "Shekel", "Swiss Franc", "UK Pound", "US Dollar", "Yen", "Yuan")
_DEGREES = ("out_degree", "in_degree", "total_degree")
_LOGS = tuple(f"log_{c}" for c in _DEGREES)


@dataclass(frozen=True)
class Layout:
    """prefixes: of the format and currency columns, or None for one code each; currency_first: their order; theory: how theory
    columns are standardised (see exprs.standardise), None for a layout without them; limit: clip of all features; nodes:
    columns of the node table, with ``entity`` for one column a type; names: whose entity name counts, the account
    table's or the most frequent one in transfers; ordered: an event layout; typed: with event_type."""

    prefixes: tuple[str, str] | None = ("pf", "rc")
    currency_first: bool = False
    theory: str | None = None
    limit: float | None = None
    nodes: tuple[str, ...] = (*_DEGREES, *_LOGS, "entity")
    names: str = "accounts"
    ordered: bool = False
    typed: bool = False


LAYOUTS = {
    "static_baseline": Layout(),
    "static_theory": Layout(prefixes=None, theory="eps", nodes=(*_DEGREES, *_LOGS)),
    "events_baseline": Layout(prefixes=("fmt", "cur_recv"), currency_first=True, ordered=True),
    "events_theory": Layout(prefixes=("fmt", "cur_recv"), currency_first=True, theory="floor", limit=10.0, nodes=(*_DEGREES, "laundering_count"), ordered=True),
    "typed_baseline": Layout(ordered=True, typed=True),
    "typed_theory": Layout(theory="eps", names="transfers", ordered=True, typed=True),
}
KEYS = ("edge_id", "src", "dst", "ts", "label")


class Graph(NamedTuple):
    """edges(edge_id, src, dst, ts, label, event_type of typed layouts, features), nodes(node_id, acct, y_node, features)."""

    edges: DataFrame
    nodes: DataFrame
    edge_columns: list[str]
    node_columns: list[str]


def check_order(tx: DataFrame) -> None:
    """An error if a transfer is earlier than the one before it in the order of row_id."""
    steps = G.temporal_stats(tx).first()["violations"]
    if steps:
        raise ValueError(f"{steps} transfers are earlier than the one before")


def in_time_order(tx: DataFrame) -> DataFrame:
    """tx with row_id 0, 1, ... by (ts, row_id)."""
    rows = global_index(tx.withColumnRenamed("row_id", "_old"), "row_id", "ts", "_old")
    return materialize(rows.select(*tx.columns), "ordered-transfers")


def build(tx: DataFrame, layout: str, accounts: DataFrame | None = None, theory: DataFrame | None = None, formats: tuple[str, ...] = X.FORMATS, currencies: tuple[str, ...] = CURRENCIES, types: list[str] | None = None) -> Graph:
    """The tables of a layout. Event layouts want transfers in order of time by row_id (see in_time_order), else an error.

    theory holds row_id and the columns of graph.theory_columns; a theory layout without such columns is an error. Every
    feature is a number: null, NaN and infinite ones are 0. Without ``types`` the entity types that occur are used.
    """
    form = LAYOUTS[layout]
    if form.ordered:
        check_order(tx)
    code = form.prefixes is None
    edges = G.edge_features(tx, list(formats), list(currencies), "code" if code else "onehot", form.prefixes or ("pf", "rc"), 1e-9)
    if code:
        edges = edges.withColumnsRenamed({"fmt_code": "pf_code", "cur_code": "rc_code"})
    elif form.currency_first:
        fmt = [f"{form.prefixes[0]}_{v}" for v in formats]
        cur = [f"{form.prefixes[1]}_{v}" for v in currencies]
        edges = edges.select(*[F.col(f"`{c}`") for c in [c for c in edges.columns if c not in fmt + cur] + cur + fmt])
    if form.theory:
        if theory is None:
            raise ValueError("the layout needs theory columns")
        edges = G.theory_edges(edges, theory, form.theory)
    columns = [c for c in edges.columns if c != "row_id"]
    standard = {*G.theory_columns(theory)} if form.theory else {}  # finite and within the limit already
    whole = {c for c, t in edges.dtypes if t in ("int", "bigint")}

    def clean(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        if c in standard:
            return x.alias(c)
        x = F.coalesce(x, F.lit(0.0)) if c in whole else X.finite(x)
        return (F.least(F.greatest(x, F.lit(-form.limit)), F.lit(form.limit)) if form.limit else x).alias(c)

    features = edges.select("row_id", *[clean(c) for c in columns])
    nodes = node_table(tx, layout, accounts, types)
    table = (G.event_table if form.typed else G.edge_table)(tx, features)
    keys = [*KEYS, *(["event_type"] if form.typed else [])]
    node_columns = [c for c in nodes.columns if c not in ("node_id", "acct", "y_node")]
    return Graph(table.select(*keys, *[F.col(f"`{c}`") for c in columns]), nodes, columns, node_columns)


def node_table(tx: DataFrame, layout: str, accounts: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """node_id, acct, y_node (touches a positive transfer) and the layout's node columns."""
    form = LAYOUTS[layout]
    ids = G.node_ids(tx)
    deg = G.A.degree_stats(tx).select("acct", F.col("out_count").alias("out_degree"), F.col("in_count").alias("in_degree")).withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    rows = deg.withColumns({f"log_{k}": F.log1p(k) for k in _DEGREES}).join(G.node_labels(tx), "acct").join(ids, "acct")
    columns = [F.col(c).cast("double").alias(c) for c in form.nodes if c != "entity"]
    if "entity" in form.nodes:
        if accounts is None:
            raise ValueError("the layout needs accounts")
        if form.names == "accounts":
            kinds = G.entity_types(tx, accounts)
        else:
            dim = one_per_account(accounts).select("acct", F.col("entity_name").alias("name"))
            side = lambda k: tx.select(F.col(k).alias("acct")).join(dim, "acct")
            names = G.first_known_name(tx, side("src"), side("dst"))
            kinds = names.select("acct", X.entity_type(F.col("name")).alias("entity_type"))
        if types is None:
            types = vocabulary(kinds, "entity_type")
        rows = rows.join(kinds, "acct")
        columns += X.one_hot(F.col("entity_type"), types, "ent")
    return rows.select("node_id", "acct", F.col("y_node").cast("int").alias("y_node"), *columns)


def feature_summary(graph: Graph) -> DataFrame:
    """feature, mean, std, min, max, n_bad of every edge feature, in one pass."""
    return G.feature_stats(graph.edges.select(*[F.col(f"`{c}`") for c in graph.edge_columns]), graph.edge_columns)


def write_graph(graph: Graph, path: str, tx: DataFrame, **more: object) -> None:
    """edges and nodes as Parquet, the node mapping as JSON lines, and one-line JSON files: manifest (columns, counts and
    ``more``), feature_stats and graph_stats. The manifest comes last, so a folder with one is whole."""
    graph.edges.write.parquet(f"{path}/edges")
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.nodes.select("acct", "node_id").write.json(f"{path}/node_mapping")
    feature_summary(graph).coalesce(1).write.json(f"{path}/feature_stats")
    stats = G.graph_stats(tx).crossJoin(G.temporal_stats(tx).select("span_days", "violations")).crossJoin(graph.nodes.agg((100 * F.avg("y_node")).alias("pct_laundering_nodes")))
    stats.coalesce(1).write.json(f"{path}/graph_stats")
    spark = tx.sparkSession
    counts = {"edges": spark.read.parquet(f"{path}/edges").count(), "nodes": spark.read.parquet(f"{path}/nodes").count()}
    manifest = {"edge_columns": graph.edge_columns, "node_columns": graph.node_columns, "counts": counts, **more}
    write_json(spark, manifest, f"{path}/manifest")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small value as one line of JSON."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    """What write_json wrote, or any one JSON file of up to a few megabytes."""
    text = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(text) != 1:
        raise ValueError(f"{path} should hold one file")
    return json.loads(text[0][0])


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The tables that write_graph wrote; an error if the manifest names columns or rows that they don't have."""
    manifest = read_json(spark, f"{path}/manifest")
    edges, nodes = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")
    lost = [c for c in manifest["edge_columns"] if c not in edges.columns] + [c for c in manifest["node_columns"] if c not in nodes.columns]
    if lost:
        raise ValueError(f"the tables have no {lost}")
    if (edges.count(), nodes.count()) != (manifest["counts"]["edges"], manifest["counts"]["nodes"]):
        raise ValueError("the tables have other row counts than the manifest")
    return Graph(edges, nodes, manifest["edge_columns"], manifest["node_columns"])
