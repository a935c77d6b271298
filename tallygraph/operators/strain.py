"""Strain scores of accounts and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.asof import in_ranges, previous
from ..plans.work import materialize, quantile_row, quantiles_by
from .accounts import endpoints

EPS = 1e-6


def _concentration(tx: DataFrame, key: str, name: str) -> DataFrame:
    """Largest share of what an account pays that goes to one ``key``; 0 where the total isn't positive."""
    by = tx.groupBy(F.col("src").alias("acct"), key).agg(F.sum("amt_paid").alias("s"))
    return by.groupBy("acct").agg(F.when(F.sum("s") > 0, F.max("s") / F.sum("s")).otherwise(0.0).alias(name))


def liquidity_shocks(tx: DataFrame) -> DataFrame:
    """Transfers of each account above its own mean + 2 population deviations."""
    limit = tx.groupBy("src").agg((F.avg("amt_paid") + 2 * F.stddev_pop("amt_paid")).alias("_limit"))
    return tx.select("src", "amt_paid").join(limit, "src").groupBy(F.col("src").alias("acct")).agg(F.count_if(F.col("amt_paid") > F.col("_limit")).alias("LiquidityShockCount_30d"))


def account_strain(tx: DataFrame) -> DataFrame:
    """One row for each account that sends or receives; null amounts count as 0."""
    tx = tx.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("amt_paid", "amt_rec")})
    out = tx.groupBy(F.col("src").alias("acct")).agg(F.sum("amt_paid").alias("TotalOut"), F.count("*").alias("OutDegree"))
    into = tx.groupBy(F.col("dst").alias("acct")).agg(F.sum("amt_rec").alias("TotalIn"), F.count("*").alias("InDegree"), F.stddev_samp("amt_rec").alias("_vol"))
    rows = endpoints(tx).join(out, "acct", "left").join(into, "acct", "left").join(liquidity_shocks(tx), "acct", "left")
    rows = rows.join(_concentration(tx, "dst", "TopPartnerConcentration"), "acct", "left").join(_concentration(tx, "to_bank", "BankDependenceScore"), "acct", "left")
    rows = rows.select("acct", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("TotalOut", "TotalIn", "OutDegree", "InDegree", "LiquidityShockCount_30d", "TopPartnerConcentration", "BankDependenceScore")], F.coalesce("_vol", F.lit(0.0)).alias("IncomingVolatility_30d"))
    span = tx.agg(F.greatest(F.floor((X.epoch(F.max("ts")) - X.epoch(F.min("ts"))) / 86400), F.lit(1)).alias("_days"))
    rows = rows.crossJoin(F.broadcast(span)).withColumn("NetFlow_full", F.col("TotalIn") - F.col("TotalOut"))
    rows = rows.withColumns({f"NetFlow_{k}d": F.col("NetFlow_full") * F.least(F.lit(float(k)) / F.col("_days"), F.lit(1.0)) for k in (7, 30, 90)})
    rows = rows.withColumns({"OutInRatio_30d": F.col("TotalOut") / (F.col("TotalIn") + EPS), "_deficit": F.greatest(-F.col("NetFlow_90d"), F.lit(0.0)), "_deg": F.col("InDegree") + F.col("OutDegree")})
    ratio, vol = F.greatest("OutInRatio_30d", F.lit(0.0)), F.greatest("IncomingVolatility_30d", F.lit(0.0))
    rows = materialize(rows, "account-strain")
    one = rows.agg(F.max("_deg").alias("_max_deg"), F.max("_deficit").alias("_max_def"))
    rows = rows.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(quantile_row(rows, {"_q_ratio": (ratio, 0.99), "_q_vol": (vol, 0.99)})))
    chronic = (F.col("_deficit") / (F.col("_max_def") + EPS) + ratio / (F.col("_q_ratio") + EPS) + vol / (F.col("_q_vol") + EPS)) / 3.0
    rows = rows.withColumns({"NetworkCentrality": F.col("_deg") / F.greatest("_max_deg", F.lit(1)), "ChronicStrainScore": chronic})
    return rows.drop("_days", "_deficit", "_deg", "_max_deg", "_max_def", "_q_ratio", "_q_vol")


def exposure(tx: DataFrame, strain: DataFrame) -> DataFrame:
    """Mean chronic strain of an account's counterparties, counted as often as they deal; a self-loop counts twice."""
    pairs = tx.select("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    adj = pairs.select(F.col("src").alias("acct"), F.col("dst").alias("nbr"), "n").unionAll(pairs.select(F.col("dst").alias("acct"), F.col("src").alias("nbr"), "n"))
    score = strain.select(F.col("acct").alias("nbr"), F.col("ChronicStrainScore").alias("s"))
    return adj.join(score, "nbr").groupBy("acct").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("NetworkStrainExposure"))


def transfer_strain(tx: DataFrame) -> DataFrame:
    """Deviation, gap, size and payment-type strain of each transfer, and their situational score in [0, 1]."""
    tx = tx.withColumn("amt_paid", F.coalesce("amt_paid", F.lit(0.0)))
    stats = tx.groupBy("src").agg(F.avg("amt_paid").alias("_m"), F.coalesce(F.stddev_samp("amt_paid"), F.lit(0.0)).alias("_s"))
    high = quantiles_by(tx.select("src", "amt_paid"), "src", "amt_paid", [0.95]).select("src", F.col("quantile").alias("_p95"))
    timed = in_ranges(tx.withColumn("_t", X.epoch(F.col("ts"))), F.col("_t"))
    timed = previous(timed, "src", ["ts", "row_id"], "_t", "_before")
    gaps = materialize(timed.withColumn("_gap", (F.col("_t") - F.col("_before")) / 3600.0).drop("_t", "_before", "_range"), "transfer-gaps")
    rows = gaps.join(stats, "src", "left").join(high, "src", "left").crossJoin(F.broadcast(quantile_row(gaps, {"_median": (F.col("_gap"), 0.5)})))
    dev = F.coalesce((F.col("amt_paid") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))
    tgap: Column = 1.0 / (1.0 + F.greatest(F.coalesce("_gap", "_median", F.lit(24.0)), F.lit(0.0)))
    rows = rows.select("row_id", dev.alias("OutgoingDeviation"), tgap.alias("TimeGapStrain"), (F.col("amt_paid") >= F.col("_p95")).cast("int").alias("LargeOutflowFlag"), X.risk(F.col("fmt")).alias("PaymentTypeStrain"))
    total = (F.tanh(F.abs("OutgoingDeviation") / 3.0) + X.clip(F.col("TimeGapStrain"), 0, 1) + X.clip(F.col("PaymentTypeStrain"), 0, 1) + 0.5 * F.col("LargeOutflowFlag")) / 3.5
    return rows.withColumn("SituationalStrainScore", X.clip(total, 0.0, 1.0))


def accounts_with_strain(accounts: DataFrame, strain: DataFrame) -> DataFrame:
    """Accounts with their strain columns, 0 where they never deal."""
    cols = [c for c in strain.columns if c != "acct"]
    return accounts.join(strain, "acct", "left").select(*accounts.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])
