"""Node and edge tables of transfer graphs, in a static and an event-ordered layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..plans.work import global_index, materialize, small, vocabulary
from ..sources.readers import one_per_account
from . import accounts as A


def node_ids(tx: DataFrame) -> DataFrame:
    """acct, node_id: 0, 1, ... by first appearance, all senders in order of time before all receivers."""
    side = lambda c, k: tx.select(F.col(c).alias("acct"), F.lit(k).alias("side"), "ts", "row_id")
    first = side("src", 0).unionAll(side("dst", 1)).groupBy("acct").agg(F.min(F.struct("side", "ts", "row_id")).alias("f"))
    return global_index(first.select("acct", "f.side", "f.ts", "f.row_id"), "node_id", "side", "ts", "row_id").select("acct", "node_id")


def event_type_ids(tx: DataFrame) -> DataFrame:
    """fmt, event_type: 0, 1, ... by first appearance of the payment format (a small vocabulary)."""
    first = tx.groupBy("fmt").agg(F.min(F.struct("ts", "row_id")).alias("f"))
    return first.select("fmt", (F.row_number().over(Window.orderBy("f")) - 1).alias("event_type"))


def category_codes(tx: DataFrame, column: str) -> DataFrame:
    """column, code: rank among the sorted distinct values, -1 for null (a small vocabulary)."""
    found = tx.select(column).distinct()
    known = found.filter(F.col(column).isNotNull()).select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("code"))
    return known.unionAll(found.filter(F.col(column).isNull()).select(column, F.lit(-1).alias("code")))


def edge_features(tx: DataFrame, formats: list[str] | None = None, currencies: list[str] | None = None, encoding: str = "onehot", prefixes: tuple[str, str] = ("pf", "rc"), eps: float = 1e-10) -> DataFrame:
    """Ten numeric columns and the payment format and receiving currency, as one column a value or as codes.

    Without a vocabulary the observed values are used, sorted; that is one small driver-side list.
    """
    ends = tx.agg(F.min(X.epoch(F.col("ts"))).alias("_lo"), F.max(X.epoch(F.col("ts"))).alias("_hi"))
    rows = A.previous_times(tx).crossJoin(F.broadcast(ends))
    rows = rows.withColumns({f"_g{k[0]}": F.coalesce(F.col("_t") - F.col(f"_before_{k}"), F.lit(0)) for k in ("src", "dst")})
    c = F.col
    base = [
        X.log1p_safe(c("amt_rec")).alias("log_amt_rec"), X.log1p_safe(c("amt_paid")).alias("log_amt_paid"), X.same(c("from_bank"), c("to_bank")).alias("same_bank"), X.same(c("cur_rec"), c("cur_paid")).alias("same_currency"),
        F.hour("ts").alias("hour_of_day"), F.weekday("ts").alias("day_of_week"), X.weekend(c("ts")).alias("is_weekend"),
        ((c("_t") - c("_lo")) / (c("_hi") - c("_lo") + eps)).alias("ts_normalized"), X.log1p_safe(c("_gs")).alias("log_time_since_src"), X.log1p_safe(c("_gd")).alias("log_time_since_dst"),
    ]
    if encoding == "code":
        fmt = small(category_codes(tx, "fmt").select(F.col("fmt").alias("_f"), F.col("code").alias("fmt_code")))
        cur = small(category_codes(tx, "cur_rec").select(F.col("cur_rec").alias("_c"), F.col("code").alias("cur_code")))
        rows = rows.join(fmt, c("fmt").eqNullSafe(c("_f")), "left").join(cur, c("cur_rec").eqNullSafe(c("_c")), "left")
        return rows.select("row_id", *base, "fmt_code", "cur_code")
    values = lambda col, given: vocabulary(tx, col) if given is None else given
    hot = X.one_hot(c("fmt"), values("fmt", formats), prefixes[0]) + X.one_hot(c("cur_rec"), values("cur_rec", currencies), prefixes[1])
    return rows.select("row_id", *base, *hot)


def theory_columns(df: DataFrame, prefixes: tuple[str, ...] = ("RAT_", "motif_", "SLT_", "STRAIN_"), leave_out: tuple[str, ...] = ("RAT_injected", "RAT_intensity_level")) -> list[str]:
    """The theory features of df by prefix; an error where there is none."""
    found = [c for c in df.columns if c.startswith(prefixes) and c not in leave_out]
    if not found:
        raise ValueError("no theory columns: this is a baseline table")
    return found


def theory_edges(edges: DataFrame, theory: DataFrame, mode: str = "eps") -> DataFrame:
    """edges with the standardised theory columns of the same row_id."""
    cols = theory_columns(theory)
    return edges.join(X.standardise(theory.select("row_id", *cols), cols, mode), "row_id")


def edge_table(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Static layout: edge_id, src, dst (node ids), ts (epoch seconds), label and the features."""
    nodes = materialize(node_ids(tx), "nodes")
    rows = tx.select("row_id", F.col("src").alias("_s"), F.col("dst").alias("_d"), X.epoch(F.col("ts")).alias("ts"), "label")
    rows = rows.join(nodes.select(F.col("acct").alias("_s"), F.col("node_id").alias("src")), "_s").join(nodes.select(F.col("acct").alias("_d"), F.col("node_id").alias("dst")), "_d")
    return rows.join(features, "row_id").withColumnRenamed("row_id", "edge_id").drop("_s", "_d")


def event_table(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Event layout: as edge_table, with event_type by payment format. Order is by (ts, edge_id), which readers sort by."""
    kinds = tx.select(F.col("row_id").alias("edge_id"), "fmt").join(small(event_type_ids(tx)), "fmt").drop("fmt")
    return edge_table(tx, features).join(kinds, "edge_id")


def entity_types(tx: DataFrame, accounts: DataFrame, allow_fanout: bool = False) -> DataFrame:
    """acct, entity_type of every endpoint; Unknown where there is no account or name."""
    dim = accounts if allow_fanout else one_per_account(accounts)
    return A.endpoints(tx).join(dim.select("acct", X.entity_type(F.col("entity_name")).alias("entity_type")), "acct", "left").select("acct", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"))


def node_features(tx: DataFrame, accounts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Degrees, their logs and entity type columns of each account, and whether it touches a positive transfer."""
    deg = A.degree_stats(tx).select("acct", F.col("out_count").alias("out_degree"), F.col("in_count").alias("in_degree")).withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    rows = deg.withColumns({f"log_{k}": F.log1p(k) for k in ("out_degree", "in_degree", "total_degree")}).join(entity_types(tx, accounts), "acct").join(node_labels(tx), "acct")
    if types is None:
        types = vocabulary(rows, "entity_type")
    return rows.select(*[c for c in rows.columns if c != "entity_type"], *X.one_hot(F.col("entity_type"), types, "ent"))


def node_labels(tx: DataFrame) -> DataFrame:
    """acct, y_node (touches a positive transfer), laundering_count (how often; a self-loop counts twice)."""
    ends = tx.select(F.col("src").alias("acct"), "label").unionAll(tx.select(F.col("dst").alias("acct"), "label"))
    return ends.groupBy("acct").agg(F.max("label").alias("y_node"), F.sum("label").alias("laundering_count"))


def mode_entity_name(tx: DataFrame, names: DataFrame) -> DataFrame:
    """acct, name: most frequent name (the least of equals) among names(acct, name), Unknown without any."""
    found = names.groupBy("acct").agg(F.mode("name", True).alias("name"))
    return A.endpoints(tx).join(found, "acct", "left").select("acct", F.coalesce("name", F.lit("Unknown")).alias("name"))


def first_known_name(tx: DataFrame, src_names: DataFrame, dst_names: DataFrame) -> DataFrame:
    """acct, name: an account's most frequent name as a sender, else as a receiver, else Unknown. Names: (acct, name)."""
    mode = lambda names, to: names.groupBy("acct").agg(F.mode("name", True).alias(to))
    rows = A.endpoints(tx).select("acct").join(mode(src_names, "s"), "acct", "left").join(mode(dst_names, "d"), "acct", "left")
    return rows.select("acct", F.coalesce("s", "d", F.lit("Unknown")).alias("name"))


def theory_type(columns: list[str]) -> tuple[str, tuple[str, ...]]:
    """Which theory's columns a table carries, with the prefixes of its features; an error for a table without any."""
    for prefix in ("RAT_", "SLT_", "STRAIN_"):
        if any(c.startswith(prefix) for c in columns):
            return f"{prefix[:-1]}-injected", (prefix, "motif_")
    raise ValueError("no theory columns")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def engineered(df: DataFrame) -> DataFrame:
    """df with those of log_amt_rec, log_amt_paid, same_bank, same_currency, hour_of_day, day_of_week (0: Monday),
    is_weekend and ts_normalized (0 to 1) whose source columns it has. A null equals nothing; one time for all gives null."""
    has = lambda *cs: set(cs) <= set(df.columns)
    equal = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")
    new = {f"log_{c}": F.log1p(c) for c in ("amt_rec", "amt_paid") if has(c)}
    new |= {name: equal(*pair) for name, pair in {"same_bank": ("from_bank", "to_bank"), "same_currency": ("cur_rec", "cur_paid")}.items() if has(*pair)}
    if has("RAT_is_weekend"):
        new["is_weekend"] = F.col("RAT_is_weekend")
    if not has("ts"):
        return df.withColumns(new)
    new |= {"hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts")}
    t = X.epoch(F.col("ts"))
    ends = df.agg(F.min(t).alias("_t_low"), F.max(t).alias("_t_high"))
    new["ts_normalized"] = F.try_divide(t - F.col("_t_low"), F.col("_t_high") - F.col("_t_low"))
    return df.crossJoin(F.broadcast(ends)).withColumns(new).drop("_t_low", "_t_high")


def graph_stats(tx: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """One row about the graph of tx; isolated: accounts(acct) without any transfer, 0 if no accounts are given."""
    edges = tx.agg(F.count("*").alias("num_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.sum("label").alias("laundering_edges"))
    nodes = node_labels(tx).agg(F.count("*").alias("num_nodes"), F.sum("y_node").alias("laundering_nodes"))
    n, e = F.col("num_nodes"), F.col("num_edges")
    alone = F.lit(0).cast("bigint").alias("isolated")
    rows = edges.crossJoin(nodes)
    if accounts is not None:
        left = accounts.select("acct").distinct().join(A.endpoints(tx).select("acct"), "acct", "left_anti")
        rows, alone = rows.crossJoin(left.agg(F.count("*").alias("isolated"))), F.col("isolated")
    return rows.select("num_nodes", alone, "num_edges", "self_loops", "laundering_edges", "laundering_nodes", F.try_divide(e, n).alias("avg_degree"), F.coalesce(F.try_divide(e, n * (n - 1)), F.lit(0.0)).alias("density"), F.try_divide(100.0 * F.col("laundering_edges"), e).alias("pct_laundering"))


def temporal_stats(tx: DataFrame) -> DataFrame:
    """Range and gaps of the transfers in order of row_id: violations are steps back in time.

    Each range part sees its own rows and the last row of the part before.
    """
    from ..plans.work import ranged

    rows = ranged(tx.select("row_id", X.epoch(F.col("ts")).alias("t")), "row_id")
    last = rows.groupBy("_part").agg(F.max_by("t", "_place").alias("_last"))
    before = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    rows = rows.join(F.broadcast(before), "_part")
    gap = F.col("t") - F.coalesce(F.lag("t").over(Window.partitionBy("_part").orderBy("row_id")), F.col("_before"))
    rows = rows.withColumn("gap", gap)
    return rows.agg(F.min("t").alias("ts_min"), F.max("t").alias("ts_max"), ((F.max("t") - F.min("t")) / 86400.0).alias("span_days"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.count_if(F.col("gap") < 0).alias("violations"), F.countDistinct("t").alias("distinct_ts"), (1 - F.try_divide(F.countDistinct("t"), F.count("t"))).alias("duplicate_ratio"))


def feature_stats(features: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (population), min, max, n_bad of every column, from one aggregate."""
    aggs = [f for c in columns for f in (F.avg(c).alias(f"{c}|mean"), F.stddev_pop(c).alias(f"{c}|std"), F.min(c).cast("double").alias(f"{c}|min"), F.max(c).cast("double").alias(f"{c}|max"), F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}|bad"))]
    one = features.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{k}`").alias("n_bad" if k == "bad" else k) for k in ("mean", "std", "min", "max", "bad")]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def dataset_summary(tx: DataFrame) -> DataFrame:
    banks = tx.select(F.col("from_bank").alias("b")).unionAll(tx.select(F.col("to_bank").alias("b"))).agg(F.countDistinct("b").alias("banks"))
    accts = A.endpoints(tx).agg(F.count("*").alias("accounts"))
    return tx.agg(F.count("*").alias("transfers"), (100 * F.avg("label")).alias("pct_label")).crossJoin(banks).crossJoin(accts)


def degree_histogram(tx: DataFrame, bins: int = 50) -> DataFrame:
    """bin, low, n: how many accounts have an out-count within each of ``bins`` equal steps from the least to the largest
    (the last step includes it); bins without account are left out."""
    deg = A.degree_stats(tx).select(F.col("out_count").alias("d"))
    ends = deg.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("d") - F.col("lo")) / step), F.lit(bins - 1)))
    return deg.crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bin"), "lo", step.alias("step")).groupBy("bin", "lo", "step").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), "n")


def reindex(interactions: DataFrame, bipartite: bool = True) -> DataFrame:
    """interactions(u, i, idx, ...) with ids from 1 on, as row 0 stands for no node; items follow the users if bipartite.

    An error if the ids of either side have gaps then.
    """
    one = F.lit(1).cast("bigint")
    if not bipartite:
        return interactions.withColumns({c: F.col(c) + one for c in ("u", "i", "idx")})
    r = interactions.agg(F.max("u").alias("top"), *[(F.max(c) - F.min(c) + 1 == F.countDistinct(c)).alias(f"full_{c}") for c in ("u", "i")]).first()
    if r["top"] is not None and not (r["full_u"] and r["full_i"]):
        raise ValueError("user or item ids have gaps")
    return interactions.withColumns({"u": F.col("u") + one, "i": F.col("i") + F.lit((r["top"] or 0) + 2).cast("bigint"), "idx": F.col("idx") + one})
