"""One query for each operator, over the driver's tables. Computed doubles are rounded to six places."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import accounts as A
from ..operators import checks as C
from ..operators import embedding as E
from ..operators import graph as G
from ..operators import layouts as B
from ..operators import metrics as M
from ..operators import models as L
from ..operators import opportunity as R
from ..operators import scoring as S
from ..operators import splits as P
from ..operators import strain as N
from ..operators import temporal as T
from ..sources import fixtures as X0
from ..streaming import memory as Y
from ..streaming import state as K
from . import weights as V
from .work import materialize, work_path

QUERIES: dict = {}
EVENT_TYPES = ["click", "login", "purchase", "view"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers to bigint."""
    wide = [c for c, t in df.dtypes if t in ("double", "float")]
    if len(wide) > 12:
        # Most numbers of wide tables are whole, and rounding those is slow.
        df = X.each(df, wide, lambda x, _: F.when(x == F.rint(x), F.rint(x) + 0.0).otherwise(F.round(x, 6)))
        return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])
    kind = {"double": lambda c: F.round(c, 6), "float": lambda c: F.round(F.col(c).cast("double"), 6), "int": lambda c: F.col(c).cast("bigint")}
    return df.select(*[kind[t](f"`{c}`").alias(c) if t in kind else F.col(f"`{c}`") for c, t in df.dtypes])


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return X0.transfers(spark, d)


def _opp(spark: SparkSession, d: str) -> DataFrame:
    return R.opportunity(_tx(spark, d), X0.accounts(spark, d), X0.patterns(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return R.guardian_ranking(_tx(spark, d), X0.accounts(spark, d), X0.patterns(spark, d))


@query
def guardian_ranking(spark, d):
    return r6(flagship(spark, d))


@query
def acct_degree_stats(spark, d):
    return r6(A.degree_stats(_tx(spark, d)))


@query
def acct_amount_stats(spark, d):
    return r6(A.amount_stats(_tx(spark, d)))


@query
def acct_first_seen_age(spark, d):
    days = A.ages(_tx(spark, d))
    return days.select("row_id", *[F.round(F.col(f"{k}_age_days") * 86400).cast("bigint").alias(f"{k}_age_seconds") for k in ("src", "dst")])


@query
def acct_day_burst(spark, d):
    return r6(A.day_bursts(_tx(spark, d)))


@query
def time_flags(spark, d):
    return r6(A.time_flags(_tx(spark, d)))


@query
def bank_currency_flags(spark, d):
    return r6(A.bank_flags(_tx(spark, d)))


@query
def order_degree_stats(spark, d):
    """Degrees on the larger graph."""
    return r6(A.degree_stats(X0.order_transfers(spark, d)))


@query
def mutual_flow_pairs(spark, d):
    return R.mutual_pairs(_tx(spark, d))


@query
def mutual_flow_flag(spark, d):
    return r6(R.mutual_flag(_tx(spark, d)))


@query
def amount_zscore_pos(spark, d):
    return r6(_opp(spark, d).select("row_id", "RAT_src_amount_z_pos", "RAT_dst_amount_z_pos"))


@query
def quantile_normalised_structure(spark, d):
    return r6(_opp(spark, d).select("row_id", "RAT_src_out_deg_norm", "RAT_dst_in_deg_norm", "RAT_src_burst_norm", "RAT_dst_burst_norm", "RAT_combined_burst"))


@query
def entity_features(spark, d):
    return r6(_opp(spark, d).select("row_id", "RAT_same_entity", "RAT_src_entity_accounts", "RAT_dst_entity_accounts", "RAT_src_entity_acct_norm", "RAT_dst_entity_acct_norm"))


@query
def pattern_flags(spark, d):
    return r6(_opp(spark, d).select("row_id", "RAT_src_pattern_flag", "RAT_dst_pattern_flag"))


@query
def motif_scores(spark, d):
    return r6(_opp(spark, d).select("row_id", "motif_fanin", "motif_fanout", "motif_chain", "motif_cycle"))


@query
def opportunity_subscores(spark, d):
    return r6(_opp(spark, d).select("row_id", "RAT_offender_score", "RAT_target_score", "RAT_guardian_weakness_score"))


@query
def opportunity_score(spark, d):
    return r6(_opp(spark, d).select("row_id", "label", "RAT_score"))


@query
def intensity_thresholds(spark, d):
    return r6(R.thresholds(_opp(spark, d)))


@query
def intensity_labels(spark, d):
    return r6(R.intensity_labels(_opp(spark, d)).groupBy("intensity").agg(F.sum("RAT_injected").alias("injected"), F.max("RAT_intensity_level").alias("level"), F.count("*").alias("n")))


@query
def intensity_drift(spark, d):
    return r6(R.intensity_drift(R.intensity_labels(_opp(spark, d)), ["RAT_score", "motif_chain"]))


@query
def entity_type_onehot(spark, d):
    types = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = G.entity_types(_tx(spark, d), X0.accounts(spark, d))
    return r6(rows.select("acct", "entity_type", *X.one_hot(F.col("entity_type"), types, "ent")))


@query
def node_ids_first_seen(spark, d):
    return r6(G.node_ids(_tx(spark, d)))


@query
def event_type_ids(spark, d):
    return r6(G.event_type_ids(_tx(spark, d)))


@query
def category_codes(spark, d):
    return r6(G.category_codes(_tx(spark, d), "fmt"))


@query
def time_since_last_src_dst(spark, d):
    return r6(A.gaps(_tx(spark, d)))


@query
def edge_features_baseline(spark, d):
    return r6(G.edge_features(_tx(spark, d), formats=EVENT_TYPES, currencies=["0", "1", "2", "3"]))


@query
def edge_features_coded(spark, d):
    return r6(G.edge_features(_tx(spark, d), encoding="code").select("row_id", "log_amt_paid", "fmt_code", "cur_code"))


@query
def edge_features_standardised(spark, d):
    theory = _opp(spark, d)
    cols = G.theory_columns(theory)
    return r6(X.standardise(theory.select("row_id", *cols), cols))


def _graph_features(spark: SparkSession, d: str) -> DataFrame:
    edges = G.edge_features(_tx(spark, d), formats=EVENT_TYPES, currencies=["0", "1", "2", "3"])
    return G.theory_edges(edges, _opp(spark, d))


@query
def static_edge_table_theory(spark, d):
    return r6(G.edge_table(_tx(spark, d), _graph_features(spark, d)))


@query
def event_stream_table_theory(spark, d):
    return r6(G.event_table(_tx(spark, d), _graph_features(spark, d)))


@query
def degree_histogram(spark, d):
    return r6(G.degree_histogram(_tx(spark, d)))


@query
def amounts_describe(spark, d):
    return r6(M.describe(_tx(spark, d), ["amt_paid", "amt_rec"]))


@query
def format_frequencies(spark, d):
    return r6(M.frequencies(_tx(spark, d), "fmt"))


@query
def static_edge_table(spark, d):
    tx = _tx(spark, d)
    return r6(G.edge_table(tx, tx.select("row_id", X.log1p_safe(F.col("amt_paid")).alias("log_amt_paid"))))


@query
def event_stream_table(spark, d):
    tx = _tx(spark, d)
    return r6(G.event_table(tx, tx.select("row_id", X.log1p_safe(F.col("amt_paid")).alias("log_amt_paid"))))


@query
def node_features_degree_entity(spark, d):
    return r6(G.node_features(_tx(spark, d), X0.accounts(spark, d), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).drop("laundering_count"))


@query
def node_laundering_count(spark, d):
    return r6(G.node_labels(_tx(spark, d)))


@query
def mode_payment_format(spark, d):
    tx = _tx(spark, d)
    return G.mode_entity_name(tx, tx.select(F.col("src").alias("acct"), F.col("fmt").alias("name")))


@query
def graph_stats(spark, d):
    return r6(G.graph_stats(_tx(spark, d), X0.accounts(spark, d)))


@query
def temporal_stats(spark, d):
    return r6(G.temporal_stats(_tx(spark, d)))


@query
def feature_stats(spark, d):
    tx = _tx(spark, d).select("amt_paid", "amt_rec", X.log1p_safe(F.col("amt_paid")).alias("log_amt_paid"))
    return r6(G.feature_stats(tx, tx.columns))


@query
def dataset_summary(spark, d):
    return r6(G.dataset_summary(_tx(spark, d)))


@query
def split_chronological(spark, d):
    return r6(P.chronological(_tx(spark, d)))


@query
def split_stratified(spark, d):
    return r6(P.stratified(_tx(spark, d)))


@query
def split_time_quantile(spark, d):
    return P.time_quantile(_tx(spark, d))


@query
def split_node_masks(spark, d):
    tx = _tx(spark, d)
    return r6(P.node_masks(tx, P.time_quantile(tx)))


@query
def split_check(spark, d):
    tx = _tx(spark, d)
    return r6(P.split_check(tx, P.chronological(tx)))


@query
def label_drift_windows(spark, d):
    return r6(P.drift_windows(_tx(spark, d)))


@query
def sequential_batches(spark, d):
    return r6(P.batches(_tx(spark, d).select("ts", "row_id"), 200, "ts", "row_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id")))


@query
def uniform_sample(spark, d):
    return r6(P.sample(_tx(spark, d).select("row_id", "label"), "row_id", 100))


@query
def balanced_sample(spark, d):
    return r6(P.balanced_sample(_tx(spark, d).select("row_id", "label"), "row_id", "label", 20))




def _full(spark: SparkSession, d: str) -> DataFrame:
    values = lambda prefix: [c.removeprefix(prefix) for c in P.FULL_FEATURES if c.startswith(prefix)]
    return P.full_features(G.edge_features(X0.worded_transfers(spark, d), formats=values("pf_"), currencies=values("rc_")), _opp(spark, d))


def _ablation(group: str):
    QUERIES[f"ablation_{group}"] = lambda spark, d: r6(P.ablate(_full(spark, d), group))


for _group in P.ABLATION_GROUPS:
    _ablation(_group)


@query
def ablation_top20(spark, d):
    return r6(P.keep_columns(_full(spark, d), P.TOP20_FEATURES))


@query
def strain_account(spark, d):
    cols = ["acct", "TotalOut", "TotalIn", "OutDegree", "InDegree", "NetFlow_7d", "NetFlow_30d", "NetFlow_90d", "OutInRatio_30d", "IncomingVolatility_30d", "NetworkCentrality", "ChronicStrainScore"]
    return r6(N.account_strain(_tx(spark, d)).select(*cols)).withColumns({c: F.round(c, 4) for c in ("TotalOut", "TotalIn", "NetFlow_7d", "NetFlow_30d", "NetFlow_90d", "OutInRatio_30d")})


@query
def strain_liquidity_shocks(spark, d):
    return r6(N.liquidity_shocks(_tx(spark, d)))


@query
def strain_concentration(spark, d):
    return r6(N.account_strain(_tx(spark, d)).select("acct", "TopPartnerConcentration", "BankDependenceScore"))


@query
def strain_exposure(spark, d):
    tx = _tx(spark, d)
    return r6(N.exposure(tx, N.account_strain(tx)))


@query
def strain_transaction(spark, d):
    return r6(N.transfer_strain(_tx(spark, d)))


@query
def strain_accounts_joined(spark, d):
    strain = N.account_strain(_tx(spark, d)).select("acct", "OutDegree", "NetworkCentrality")
    return r6(N.accounts_with_strain(X0.accounts(spark, d), strain))


@query
def temporal_neighbors_k(spark, d):
    tx = _tx(spark, d)
    return r6(T.neighbours(tx, tx.filter("row_id % 50 = 0").select(F.col("src").alias("node"), X.epoch(F.col("ts")).alias("t")), 3))


@query
def temporal_neighbors_uniform(spark, d):
    tx = _tx(spark, d)
    return r6(T.uniform_neighbours(tx, tx.select(F.col("src").alias("node"), X.epoch(F.col("ts")).alias("t")), 3))


@query
def unseen_node_sample(spark, d):
    tx = _tx(spark, d)
    return r6(T.unseen_nodes(tx, tx.agg(F.avg(X.epoch(F.col("ts")))).first()[0]))


@query
def temporal_neighbors_padded(spark, d):
    tx = _tx(spark, d)
    rows = T.padded_neighbours(tx, tx.filter("row_id % 50 = 0").select(F.col("src").alias("node"), X.epoch(F.col("ts")).alias("t")), 4)
    return rows.select("node", "t", F.array_join(F.col("edge_id").cast("array<string>"), ",").alias("edges"), F.array_join(F.col("nbr").cast("array<string>"), ",").alias("nbrs"))


@query
def interevent_stats(spark, d):
    return A.interevent_stats(_tx(spark, d)).select(*[F.round(c, 2).alias(c) for c in ("mean_src", "std_src", "mean_dst", "std_dst")])


@query
def inductive_new_node_edges(spark, d):
    tx = _tx(spark, d)
    first = tx.withColumn("split", F.when(F.col("row_id") % 97 == 0, "train").otherwise("val"))
    return r6(T.new_node_edges(tx, first.select("row_id", "split")))


@query
def negative_samples(spark, d):
    tx = _tx(spark, d)
    dst = G.global_index(tx.select(F.col("dst").alias("acct")).distinct(), "idx", "acct")
    return T.negative_samples(tx, dst)


@query
def message_last(spark, d):
    return r6(T.last_message(T.messages(_tx(spark, d))).select("node", "t", F.col("msg")[0].alias("m0"), F.col("msg")[1].alias("m1"), F.col("msg")[2].alias("m2")))


@query
def message_mean(spark, d):
    return r6(T.mean_message(T.messages(_tx(spark, d))).select("node", "t", F.col("msg")[0].alias("m0"), F.col("msg")[1].alias("m1"), F.col("msg")[2].alias("m2")))


@query
def time_encoding_sinusoidal(spark, d):
    enc = X.sinusoid(X.epoch(F.col("ts")) % 86400 / 3600.0, 4)
    return r6(_tx(spark, d).select("row_id", *[enc[k].alias(f"e{k}") for k in range(4)]))


@query
def neighbor_mean_aggregate(spark, d):
    tx = _tx(spark, d)
    edges = tx.select("src", "dst")
    nodes = A.degree_stats(tx).select(F.col("acct").alias("node_id"), F.col("out_count").cast("double").alias("x"))
    return r6(S.mean_neighbours(edges, nodes, ["x"]))


@query
def neighbor_max_aggregate(spark, d):
    tx = _tx(spark, d)
    nodes = A.degree_stats(tx).select(F.col("acct").alias("node_id"), F.col("out_count").cast("double").alias("x"))
    return r6(S.neighbour_aggregate(tx.select("src", "dst"), nodes, ["x"], "max"))


@query
def memory_gru_update(spark, d):
    """One gated update of one-number memories by each node's last message."""
    tx = _tx(spark, d)
    msgs = T.last_message(T.messages(tx)).select("node", F.array(F.col("msg")[2]).alias("msg"), "t")
    memory = A.degree_stats(tx).filter("out_count > 0").select(F.col("acct").alias("node"), F.array(F.col("out_count") / 100.0).alias("memory"), F.lit(0).cast("long").alias("last_update"))
    weights = {"w_in": np.array([[0.5, -0.4, 0.9]]), "w_hid": np.array([[0.3, 0.2, -0.7]]), "b_in": np.array([0.1, 0.0, 0.2]), "b_hid": np.array([0.0, -0.1, 0.3])}
    return r6(S.update_memory(memory, msgs, weights).select("node", F.col("memory")[0].alias("memory"), "last_update"))


_GRU = Y.MemoryModel(
    1, edge=("amt",), time_dim=2,
    weights={"w_in": np.array([[0.5, -0.4, 0.9], [0.2, 0.3, -0.6], [0.1, -0.1, 0.2], [0.4, 0.2, 0.3], [-0.3, 0.1, 0.5]]), "w_hid": np.array([[0.3, 0.2, -0.7]]), "b_in": np.array([0.1, 0.0, 0.2]), "b_hid": np.array([0.0, -0.1, 0.3])},
)
_RNN = Y.MemoryModel(1, edge=("amt",), time_dim=2, aggregate="mean", cell="rnn", eager=True, weights={"w_in": np.array([[0.5], [0.2], [0.1], [0.4], [-0.3]]), "w_hid": np.array([[0.3]]), "b_in": np.array([0.1]), "b_hid": np.array([-0.2])})


def _thirds(spark: SparkSession, d: str) -> DataFrame:
    """All transfers as events of three batches of (nearly) equal size, in order of time."""
    tx = G.global_index(_tx(spark, d).select("row_id", "ts", "src", "dst", "amt_paid"), "position", "ts", "row_id")
    n = tx.agg(F.count("*").alias("n"))
    rows = tx.crossJoin(F.broadcast(n)).withColumn("batch", F.floor(3 * F.col("position") / F.col("n")))
    return rows.select("batch", "row_id", X.epoch(F.col("ts")).alias("t"), "src", "dst", X.log1p_safe(F.col("amt_paid")).alias("amt"))


def _replayed(spark: SparkSession, d: str, model: Y.MemoryModel) -> Y.NodeState:
    state = Y.NodeState(spark)
    state.replay(Y.stored_batches(_thirds(spark, d)), model)
    return state


def _memory(memory: DataFrame) -> DataFrame:
    return r6(memory.select("node", F.col("memory")[0].alias("memory"), "last_update"))


@query
def memory_lazy(spark, d):
    """Memories after three batches, each node taking in its queued message when it is next in a batch."""
    return _memory(_replayed(spark, d, _GRU).at()[0])


@query
def memory_seen(spark, d):
    """What an embedding sees then: the queued messages taken in as well."""
    return _memory(Y.seen_memory(*_replayed(spark, d, _GRU).at(), _GRU))


@query
def memory_queue(spark, d):
    """The messages that wait after three batches."""
    queue = _replayed(spark, d, _GRU).at()[1]
    return r6(queue.select("node", "arrival.batch", F.col("arrival.side").cast("bigint").alias("side"), "arrival.row_id", "t", *[F.col("msg")[k].alias(f"m{k}") for k in range(5)]))


@query
def memory_eager(spark, d):
    """Memories after three batches that nodes take in at once, by the mean of their messages."""
    return _memory(_replayed(spark, d, _RNN).at()[0])


@query
def memory_restored(spark, d):
    """Memories after the third batch, applied to a copy of the state after the second."""
    old = _replayed(spark, d, _GRU).branch(1)
    old.apply(_thirds(spark, d).filter("batch = 2").drop("batch"), 2, _GRU)
    return _memory(old.at()[0])


@query
def memory_time_gaps(spark, d):
    """Normalised times since the last update of both ends and a drawn target, for the third batch after two."""
    events = _thirds(spark, d).filter("batch = 2")
    targets = G.global_index(events.select(F.col("dst").alias("acct")).distinct(), "idx", "acct")
    events = events.join(T.negative_samples(events, targets), "row_id")
    stats = A.interevent_stats(_tx(spark, d)).select(*[F.round(c, 2).alias(c) for c in ("mean_src", "std_src", "mean_dst", "std_dst")])
    gaps = Y.time_gaps(events, _replayed(spark, d, _GRU).at(1)[0], stats)
    return gaps.select("row_id", *[F.round(c, 4).alias(c) for c in ("gap_src", "gap_dst", "gap_neg")])


@query
def message_mlp(spark, d):
    """Each node's last message through a two-layer message function."""
    rows = T.last_message(T.messages(_tx(spark, d))).select("node", F.log1p(F.col("msg")[0]).alias("m0"), F.log1p(F.col("msg")[1]).alias("m1"), F.col("msg")[2].alias("m2"))
    layers = [(np.array([[0.3], [-0.2], [0.5]]), np.array([-0.4])), (np.array([[0.7, -0.6]]), np.array([0.1, 0.2]))]
    return r6(S.perceptron(rows, ["m0", "m1", "m2"], layers, "msg").select("node", F.col("msg")[0].alias("x0"), F.col("msg")[1].alias("x1")))


@query
def time_codes_on_targets(spark, d):
    tx = _tx(spark, d)
    nodes = A.endpoints(tx).select(F.col("acct").alias("node_id"))
    return r6(S.times_on_targets(tx.select("src", "dst", X.epoch(F.col("ts")).alias("t")), nodes, 4))


@query
def edge_probabilities(spark, d):
    tx = _tx(spark, d)
    dst = G.global_index(tx.select(F.col("dst").alias("acct")).distinct(), "idx", "acct")
    negatives = T.negative_samples(tx, dst).withColumnRenamed("row_id", "edge_id")
    hidden = A.degree_stats(tx).select(F.col("acct").alias("node_id"), F.array(F.log1p("out_count")).alias("h"))
    edges = tx.select(F.col("row_id").alias("edge_id"), "src", "dst")
    return r6(S.edge_probabilities(edges, negatives, hidden, np.array([[0.5, -0.3], [-0.4, 0.6]]), np.array([0.1, 0.2]), np.array([0.8, -0.5]), 0.05))


@query
def first_known_name(spark, d):
    tx = _tx(spark, d)
    return G.first_known_name(tx, tx.select(F.col("src").alias("acct"), F.col("fmt").alias("name")), tx.select(F.col("dst").alias("acct"), F.col("fmt").alias("name")))


@query
def engineered_columns(spark, d):
    new = ["log_amt_rec", "log_amt_paid", "same_bank", "same_currency", "hour_of_day", "day_of_week", "ts_normalized"]
    return r6(G.engineered(_tx(spark, d)).select("row_id", *new))


@query
def first_edges(spark, d):
    return r6(P.first_edges(_tx(spark, d).select("row_id", "ts", "src", "dst"), 1000).drop("ts"))


@query
def bipartite_reindex(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select((F.col("l_suppkey") - 1).cast("bigint").alias("u"), (F.col("l_linenumber") - 1).cast("bigint").alias("i"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("idx"))
    return r6(G.reindex(rows))


def _pred(spark, d):
    return X0.predictions(spark, d)


@query
def metric_confusion(spark, d):
    return r6(M.confusion(_pred(spark, d)))


@query
def metric_threshold(spark, d):
    return r6(M.threshold_metrics(_pred(spark, d)))


@query
def metric_best_threshold(spark, d):
    return r6(M.best_threshold(_pred(spark, d)))


@query
def metric_ranking(spark, d):
    return r6(M.ranking_metrics(_pred(spark, d)))


@query
def metric_precision_at_k(spark, d):
    return r6(M.precision_at(_pred(spark, d), (10, 100, 500)))


@query
def metric_curves(spark, d):
    return r6(M.curve_points(_pred(spark, d)))


@query
def metric_batches(spark, d):
    return r6(M.batch_metrics(_pred(spark, d).withColumn("batch", F.col("edge_id") % 5)))


@query
def score_histogram(spark, d):
    return r6(M.histogram(_pred(spark, d), "score", 40, 0.0, 1.0))


@query
def score_cdf(spark, d):
    return r6(M.ecdf(_pred(spark, d), "score"))


@query
def feature_correlation(spark, d):
    return r6(M.correlation(_tx(spark, d).select("amt_paid", "amt_rec", F.hour("ts").alias("hour")), ["amt_paid", "amt_rec", "hour"]))


@query
def pos_weight(spark, d):
    return r6(M.pos_weight(_pred(spark, d)))


@query
def injection_checks(spark, d):
    """Failures of a table in which some scores are lost and some marked rows are not positive."""
    rows = R.intensity_labels(_opp(spark, d))
    broken = rows.withColumns({"RAT_score": F.when(F.col("row_id") % 101 != 0, F.col("RAT_score")), "RAT_injected": F.when(F.col("row_id") % 89 == 0, 1).otherwise(F.col("RAT_injected"))})
    return r6(C.injection_failures(broken, ["RAT_score", "RAT_injected", "label"]))


@query
def edge_checks(spark, d):
    """Failures of a table with lost amounts, odd labels, repeated ids and ends without a node."""
    tx, at = _tx(spark, d), F.col("row_id")
    edges = tx.select((at - F.when(at % 79 == 0, 1).otherwise(0)).alias("edge_id"), "src", "dst", F.when(at % 97 != 0, F.col("amt_paid")).alias("amt_paid"), F.when(at % 83 == 0, 2).otherwise(F.col("label")).alias("label"))
    return r6(C.edge_failures(edges, tx.select(F.col("src").alias("node_id")).distinct(), ["amt_paid"]))


@query
def graph_warnings(spark, d):
    return C.warnings(G.graph_stats(_tx(spark, d), X0.accounts(spark, d)))


@query
def metric_checked(spark, d):
    """The confusion matrix of scores that come as one number for each class."""
    return r6(M.confusion(M.checked(_pred(spark, d).withColumn("score", F.array(1 - F.col("score"), F.col("score"))))))


@query
def aligned_predictions(spark, d):
    """Scores with the labels of another table, by id."""
    labels = _tx(spark, d).select(F.col("row_id").alias("edge_id"), "label")
    return r6(M.align(_pred(spark, d).select("edge_id", "score"), labels))


@query
def early_stop_daily(spark, d):
    """When training would stop, were each day's mean amount an epoch's metric."""
    day = F.floor(X.epoch(F.col("ts")) / 86400)
    log = _tx(spark, d).groupBy(day.alias("epoch")).agg(F.round(F.avg("amt_paid"), 6).alias("v"))
    return r6(M.early_stop(log, "v"))


@query
def epoch_shuffle(spark, d):
    """Batches of two hundred transfers in the orders of two epochs."""
    rows = _tx(spark, d).select("row_id")
    both = [P.epoch_batches(rows, "row_id", 200, k).select(F.lit(k).alias("epoch"), "batch", "row_id") for k in (1, 2)]
    return r6(both[0].unionAll(both[1]))


@query
def noise_features(spark, d):
    return r6(P.noise(_tx(spark, d).select("row_id", "label"), "row_id", ["a", "b"]))


@query
def decoder_probabilities(spark, d):
    """A three-layer decoder's probability for each node."""
    nodes = A.degree_stats(_tx(spark, d)).select("acct", F.log1p("out_count").alias("a"), F.log1p("in_count").alias("b"))
    layers = [(V.DECODER[f"w{k}"], V.DECODER[f"b{k}"]) for k in range(3)]
    rows = S.perceptron(nodes, ["a", "b"], layers, "z")
    return r6(rows.select("acct", (1 / (1 + F.exp(-F.col("z")[0]))).alias("p")))


@query
def rf_feature_importance(spark, d):
    rows = _opp(spark, d)
    cols = ["RAT_src_out_deg_norm", "RAT_combined_burst", "motif_cycle", "RAT_mutual_flag", "RAT_is_weekend"]
    return L.forest_importance(rows.select("label", *cols), cols, trees=20, depth=5)


@query
def kmeans_quality(spark, d):
    cols = ["RAT_src_out_deg_norm", "RAT_combined_burst", "motif_cycle"]
    return L.cluster_quality(_opp(spark, d).select(*cols), cols)


@query
def state_memory_replay(spark, d):
    return r6(K.replay_memory(_tx(spark, d), 30 * 86400))


@query
def sage_edge_scores(spark, d):
    """Forward pass with fixed weights: one aggregation layer and an edge perceptron."""
    tx, rng = _tx(spark, d), np.random.default_rng(0)
    nodes = A.degree_stats(tx).select(F.col("acct").alias("node_id"), F.log1p("out_count").alias("a"), F.log1p("in_count").alias("b"))
    edges = tx.select(F.col("row_id").alias("edge_id"), "src", "dst", X.log1p_safe(F.col("amt_paid")).alias("w"))
    h = S.sage_layer(edges, nodes, ["a", "b"], rng.normal(size=(2, 4)), rng.normal(size=(2, 4)), np.zeros(4))
    return r6(S.edge_mlp(edges, h, ["w"], rng.normal(size=(9, 8)), np.zeros(8), rng.normal(size=8), 0.0))


def _degrees(tx: DataFrame) -> DataFrame:
    return A.degree_stats(tx).select(F.col("acct").alias("node_id"), F.array(F.log1p("out_count"), F.log1p("in_count")).alias("x"))


def _counted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transfers whose accounts and rows count from 1, their nodes' features (logs of degrees) and their edges' (log of the amount)."""
    tx = _tx(spark, d).withColumns({c: F.col(c) + 1 for c in ("src", "dst", "row_id")})
    return tx, _degrees(tx), tx.select(F.col("row_id").alias("edge_id"), F.array(X.log1p_safe(F.col("amt_paid"))).alias("e"))


def _pair(df: DataFrame, *keys: str) -> DataFrame:
    return r6(df.select(*keys, F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1")))


def _senders(tx: DataFrame) -> DataFrame:
    return tx.select(F.col("src").alias("node"), X.epoch(F.col("ts")).alias("t"))


def _embedded(spark: SparkSession, d: str, layers: list, kind: str) -> DataFrame:
    """Layers over the three latest neighbours, for every sender at each of its times. Transfers are parsed once and written with their edges' features."""
    tx = _counted(spark, d)[0].select("row_id", "ts", "src", "dst", F.array(X.log1p_safe(F.col("amt_paid"))).alias("e"))
    tx = materialize(tx, "transfers")
    return _pair(E.graph_embeddings(tx, _senders(tx), _degrees(tx), None, layers, 3, 2, kind), "node", "t")


@query
def embedding_time(spark, d):
    """Senders' degrees as memory, scaled by the normalised time since they last sent."""
    tx, nodes, _ = _counted(spark, d)
    stats = A.interevent_stats(tx)
    gap = (F.col("gap_src") - F.col("mean_src")) / F.col("std_src")
    gaps = A.gaps(tx).join(tx.select("row_id", F.col("src").alias("node")), "row_id").crossJoin(F.broadcast(stats)).select("row_id", "node", gap.alias("gap"))
    rows = E.time_embedding(nodes.select(F.col("node_id").alias("node"), F.col("x").alias("memory")), gaps, V.TIME["weight"], V.TIME["bias"])
    return rows.select("row_id", *[F.round(F.col("z")[k], 4).alias(f"z{k}") for k in range(2)])


@query
def embedding_graph_sum(spark, d):
    """Two summing layers over the three latest neighbours, for every sender at each of its times."""
    return _embedded(spark, d, V.SUM_LAYERS, "sum")


@query
def embedding_graph_attention(spark, d):
    """One attention layer of two heads over the three latest neighbours."""
    return _embedded(spark, d, [V.ATTENTION], "attention")


def _event_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tx, nodes, _ = _counted(spark, d)
    kinds = G.event_type_ids(tx)
    rows = tx.select("ts", F.col("row_id").alias("edge_id"), "src", "dst", X.epoch(F.col("ts")).alias("t"), X.log1p_safe(F.col("amt_paid")).alias("amt"), "fmt")
    return rows.join(F.broadcast(kinds), "fmt").drop("fmt"), nodes


@query
def event_attention_scores(spark, d):
    """Scores of events that attend to the hundred of their batch."""
    events, nodes = _event_rows(spark, d)
    batches = P.batches(events.select("ts", "edge_id"), 100, "ts", "edge_id").select("edge_id", "batch")
    return r6(E.attention_scores(events.join(batches, "edge_id"), nodes, ["amt"], V.EVENTS, 2, 1, 4))


@query
def embedded_event_scores(spark, d):
    """Scores of events by tables of node and type vectors."""
    events, nodes = _event_rows(spark, d)
    vector = lambda df, key, f: df.select(key, F.array(f(F.col(key) * 1.0), f(F.col(key) * 2.0)).alias("v"))
    return r6(E.embedded_event_scores(events, nodes, vector(nodes, "node_id", F.sin), vector(events.select("event_type").distinct(), "event_type", F.cos), ["amt"], V.EMBEDDED, 2))


@query
def rescored_edges(spark, d):
    """Scores of edges by weights that were saved and read back."""
    events, nodes = _event_rows(spark, d)
    path = work_path(spark, f"weights-{uuid.uuid4().hex}")
    E.save_weights(spark, path, V.SAVED, ["a", "b"], ["amt"])
    return r6(E.rescore(spark, path, events, nodes.select("node_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), 2))


@query
def batch_attention(spark, d):
    """Self-attention among the hundred events of a batch, two heads."""
    events, _ = _event_rows(spark, d)
    rows = P.batches(events, 100, "ts", "edge_id").select("edge_id", "batch", F.array(F.col("amt"), F.log1p("src"), F.log1p("dst"), F.col("event_type") * 1.0).alias("x"))
    wq, wk, wv = (V.EVENTS["qkv0"][:, 4 * k : 4 * k + 4] for k in range(3))
    return r6(S.batch_attention(rows, "x", "batch", wq, wk, wv, 2).select("edge_id", *[F.col("att")[k].alias(f"a{k}") for k in range(4)]))


_TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _built(spark: SparkSession, d: str, layout: str) -> B.Graph:
    tx = B.in_time_order(X0.worded_transfers(spark, d))
    theory = R.opportunity(tx, X0.accounts(spark, d), X0.patterns(spark, d)) if B.LAYOUTS[layout].theory else None
    return B.build(tx, layout, X0.accounts(spark, d), theory, types=_TYPES)


def _layout(name: str):
    QUERIES[f"graph_{name}"] = lambda spark, d: r6(_built(spark, d, name).edges)


def _node_layout(name: str):
    QUERIES[f"graph_{name}_nodes"] = lambda spark, d: r6(B.node_table(X0.worded_transfers(spark, d), name, X0.accounts(spark, d), _TYPES))


for _name in B.LAYOUTS:
    _layout(_name)
for _name in ("static_baseline", "static_theory", "events_theory", "typed_theory"):
    _node_layout(_name)


@query
def graph_written_and_read(spark, d):
    """Feature summaries of an event layout that was written with its manifest and read back."""
    tx = B.in_time_order(X0.worded_transfers(spark, d))
    path = work_path(spark, f"graph-{uuid.uuid4().hex}")
    B.write_graph(B.build(tx, "events_baseline", X0.accounts(spark, d)), path, tx)
    return r6(B.feature_summary(B.read_graph(spark, path)))
