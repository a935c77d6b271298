"""Splits, samples and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import global_index, quantile_row


def _by_place(place: Column, n: Column, train: float, val: float) -> Column:
    return F.when(place < F.floor(n * train), "train").when(place < F.floor(n * (train + val)), "val").otherwise("test")


def chronological(tx: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """row_id, position, split by place in (ts, row_id) order; sizes are floors, the rest is test."""
    rows = global_index(tx.select("ts", "row_id"), "position", "ts", "row_id")
    n = tx.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).select("row_id", "position", _by_place(F.col("position"), F.col("_n"), train, val).alias("split"))


def draw(key: str, seed: int = 0) -> Column:
    """A fixed pseudo-random number below 1,000,003 for each key, by integer arithmetic any engine can repeat."""
    return F.pmod(F.col(key) * 7_919 + seed * 104_729 + F.pmod(F.col(key) * 31 + seed, F.lit(997)) * 1_009, F.lit(1_000_003))


def stratified(tx: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42) -> DataFrame:
    """row_id, label, split: each label's rows in a fixed random order, cut at the floors of the shares.

    Order within a label comes from a global index, so no label is sorted in one task.
    """
    rows = global_index(tx.select("label", draw("row_id", seed).alias("_d"), "row_id"), "_i", "label", "_d", "row_id")
    sizes = tx.groupBy("label").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(F.broadcast(starts), "label")
    return rows.select("row_id", "label", _by_place(F.col("_i") - F.col("_from"), F.col("_n"), train, val).alias("split"))


def time_quantile(tx: DataFrame, low: float = 0.70, high: float = 0.85) -> DataFrame:
    """row_id, split by quantiles of time; a row on a boundary belongs to the earlier side."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    q = quantile_row(tx, {"_low": (t, low), "_high": (t, high)})
    return tx.crossJoin(F.broadcast(q)).select("row_id", F.when(t <= F.col("_low"), "train").when(t <= F.col("_high"), "val").otherwise("test").alias("split"))


def node_masks(tx: DataFrame, split: DataFrame) -> DataFrame:
    """acct, in_train, in_val, in_test: whether a transfer of that split touches the account."""
    rows = tx.select("row_id", "src", "dst").join(split.select("row_id", "split"), "row_id")
    ends = rows.select(F.col("src").alias("acct"), "split").unionAll(rows.select(F.col("dst").alias("acct"), "split"))
    return ends.groupBy("acct").agg(*[F.max((F.col("split") == s).cast("int")).alias(f"in_{s}") for s in ("train", "val", "test")])


def split_check(tx: DataFrame, split: DataFrame) -> DataFrame:
    """Size, time range and label rate of each split, and whether it starts before the one before it ends."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = tx.join(split.select("row_id", "split"), "row_id").groupBy("split").agg(F.count("*").alias("n"), F.min(t).alias("ts_min"), F.max(t).alias("ts_max"), F.sum("label").alias("positives"), (100 * F.avg("label")).alias("pct_positive"))
    rank = F.create_map(F.lit("train"), F.lit(0), F.lit("val"), F.lit(1), F.lit("test"), F.lit(2))[F.col("split")]
    before = F.lag("ts_max").over(Window.orderBy(rank))
    return rows.withColumn("overlaps", F.coalesce(F.col("ts_min") < before, F.lit(False)))


def drift_windows(tx: DataFrame, windows: int = 10) -> DataFrame:
    """Label rate of equal runs of rows in order of time; a remainder at the end is left out."""
    rows = global_index(tx.select("ts", "row_id", "label"), "_i", "ts", "row_id")
    size = tx.agg(F.floor(F.count("*") / windows).alias("_size"))
    w = F.floor(F.col("_i") / F.col("_size")).cast("int")
    return rows.crossJoin(F.broadcast(size)).select(w.alias("window"), "label").filter(F.col("window") < windows).groupBy("window").agg(F.count("*").alias("n"), F.avg("label").alias("rate"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a fixed random order."""
    return df.withColumn("_d", draw(key, seed)).orderBy("_d", key).limit(n).drop("_d")


def balanced_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n / 2 rows of each of the labels 0 and 1."""
    return sample(df.filter(F.col(label) == 0), key, n // 2, seed).unionByName(sample(df.filter(F.col(label) == 1), key, n // 2, seed))


def first_edges(tx: DataFrame, n: int) -> DataFrame:
    """The n earliest transfers: a small graph to look at."""
    return tx.orderBy("ts", "row_id").limit(n)


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """df with batch: runs of ``size`` rows in order."""
    return global_index(df, "_i", *order).withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def epoch_batches(df: DataFrame, key: str, size: int, epoch: int, seed: int = 42) -> DataFrame:
    """df with batch: runs of ``size`` rows in an order of their own for each epoch, by a draw for each key."""
    rows = df.withColumn("_d", draw(key, seed + epoch))
    return batches(rows, size, "_d", key).drop("_d")


def noise(df: DataFrame, key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """df with the columns as noise in [0, 1) that depends on the key alone: what a model learns without features."""
    return df.withColumns({c: draw(key, seed + k) / 1_000_003.0 for k, c in enumerate(columns)})


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if two tables share a key."""
    shared = a.select(key).intersect(b.select(key)).limit(1).collect()
    if shared:
        raise ValueError(f"both tables have {key} {shared[0][0]}")


#: All features of the ablation studies, in order; fixed values.
FULL_FEATURES = [
    "log_amt_rec", "log_amt_paid", "same_bank", "same_currency", "hour_of_day", "day_of_week", "is_weekend", "ts_normalized", "log_time_since_src", "log_time_since_dst",
    "pf_ACH", "pf_Bitcoin", "pf_Cash", "pf_Cheque", "pf_Credit Card", "pf_Reinvestment", "pf_Wire",
    "rc_Australian Dollar", "rc_Bitcoin", "rc_Brazil Real", "rc_Canadian Dollar", "rc_Euro", "rc_Mexican Peso", "rc_Ruble", "rc_Rupee", "rc_Saudi Riyal", "rc_Shekel", "rc_Swiss Franc", "rc_UK Pound", "rc_US Dollar", "rc_Yen", "rc_Yuan",
    "RAT_is_off_hours", "RAT_is_weekend", "RAT_is_cross_bank", "RAT_src_amount_z_pos", "RAT_dst_amount_z_pos", "RAT_src_out_deg_norm", "RAT_dst_in_deg_norm", "RAT_src_burst_norm", "RAT_dst_burst_norm", "RAT_combined_burst",
    "RAT_same_entity", "RAT_src_entity_accounts", "RAT_dst_entity_accounts", "RAT_src_entity_acct_norm", "RAT_dst_entity_acct_norm", "RAT_src_pattern_flag", "RAT_dst_pattern_flag", "RAT_mutual_flag",
    "motif_fanin", "motif_fanout", "motif_chain", "motif_cycle", "RAT_offender_score", "RAT_target_score", "RAT_guardian_weakness_score", "RAT_score",
]
#: What each ablation leaves out, in order; fixed values.
ABLATION_GROUPS = {
    "no_struct": ["RAT_src_out_deg_norm", "RAT_dst_in_deg_norm"],
    "no_temp": ["hour_of_day", "day_of_week", "is_weekend", "ts_normalized", "log_time_since_src", "log_time_since_dst", "RAT_is_off_hours", "RAT_is_weekend"],
    "no_amount": ["log_amt_rec", "log_amt_paid", "RAT_src_amount_z_pos", "RAT_dst_amount_z_pos"],
    "no_burst_pattern": ["RAT_src_burst_norm", "RAT_dst_burst_norm", "RAT_combined_burst", "RAT_src_pattern_flag", "RAT_dst_pattern_flag", "RAT_mutual_flag"],
    "no_entity": ["RAT_same_entity", "RAT_src_entity_accounts", "RAT_dst_entity_accounts", "RAT_src_entity_acct_norm", "RAT_dst_entity_acct_norm"],
    "no_rat_scores": ["RAT_offender_score", "RAT_target_score", "RAT_guardian_weakness_score", "RAT_score"],
    "no_motif": ["motif_fanin", "motif_fanout", "motif_chain", "motif_cycle"],
    "no_crossbank": ["RAT_is_cross_bank"],
}
#: The twenty features of the last study, in order; fixed values.
TOP20_FEATURES = [
    "pf_ACH", "pf_Cheque", "log_amt_paid", "log_amt_rec", "pf_Credit Card", "motif_cycle", "RAT_combined_burst", "ts_normalized", "RAT_src_burst_norm", "RAT_dst_in_deg_norm",
    "RAT_target_score", "motif_fanout", "motif_fanin", "RAT_dst_burst_norm", "RAT_src_out_deg_norm", "RAT_score", "motif_chain", "RAT_offender_score", "RAT_dst_entity_acct_norm", "RAT_guardian_weakness_score",
]


def full_features(edges: DataFrame, theory: DataFrame) -> DataFrame:
    """row_id and all features of the studies, in their order, from edge_features and opportunity tables; a format or
    currency that the edges have no column of is 0."""
    have = {*edges.columns, *theory.columns}
    other = [c for c in FULL_FEATURES if c not in have]
    if bad := [c for c in other if not c.startswith(("pf_", "rc_"))]:
        raise ValueError(f"no such columns: {bad}")
    rows = edges.join(theory.select("row_id", *[c for c in theory.columns if c in FULL_FEATURES]), "row_id")
    return rows.select("row_id", *[F.lit(0).alias(c) if c in other else F.col(f"`{c}`") for c in FULL_FEATURES])


def ablate(df: DataFrame, group: str) -> DataFrame:
    """df without a group's columns; an error if one is missing."""
    gone = ABLATION_GROUPS[group]
    missing = [c for c in gone if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone])


def keep_columns(df: DataFrame, keep: list[str], keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The keys and the named columns, in that order; an error if one is missing."""
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*keys, *[F.col(f"`{c}`") for c in keep])
