"""Per-account aggregates of transfers(row_id, ts, src, dst, amt_paid, amt_rec, from_bank, to_bank, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.asof import in_ranges, previous
from ..plans.work import quantiles_by


def endpoints(tx: DataFrame) -> DataFrame:
    """acct: every account that sends or receives, once."""
    return tx.select(F.col("src").alias("acct")).unionAll(tx.select(F.col("dst").alias("acct"))).distinct()


def degree_stats(tx: DataFrame) -> DataFrame:
    """Transfers out and in, and distinct counterparties, of each account."""
    out = tx.groupBy(F.col("src").alias("acct")).agg(F.count("*").alias("out_count"), F.countDistinct("dst").alias("out_degree"))
    into = tx.groupBy(F.col("dst").alias("acct")).agg(F.count("*").alias("in_count"), F.countDistinct("src").alias("in_degree"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("out_count", "out_degree", "in_count", "in_degree")]
    return out.join(into, "acct", "full").select("acct", *zero)


def amount_stats(tx: DataFrame) -> DataFrame:
    """Mean, sample deviation and 95 % quantile of what each account pays, and mean and deviation of what it receives."""
    out = tx.groupBy(F.col("src").alias("acct")).agg(F.avg("amt_paid").alias("paid_mean"), F.stddev_samp("amt_paid").alias("paid_std"))
    high = quantiles_by(tx.select(F.col("src").alias("acct"), "amt_paid"), "acct", "amt_paid", [0.95]).select("acct", F.col("quantile").alias("paid_p95"))
    into = tx.groupBy(F.col("dst").alias("acct")).agg(F.avg("amt_rec").alias("rec_mean"), F.stddev_samp("amt_rec").alias("rec_std"))
    return out.join(high, "acct", "left").join(into, "acct", "full")


def ages(tx: DataFrame) -> DataFrame:
    """Days since the sender first sent and the receiver first received, for each transfer."""
    src = tx.groupBy("src").agg(F.min("ts").alias("_s"))
    dst = tx.groupBy("dst").agg(F.min("ts").alias("_d"))
    rows = tx.select("row_id", "src", "dst", "ts").join(src, "src", "left").join(dst, "dst", "left")
    days = lambda since: (X.epoch(F.col("ts")) - X.epoch(F.col(since))) / 86400.0
    return rows.select("row_id", days("_s").alias("src_age_days"), days("_d").alias("dst_age_days"))


def day_bursts(tx: DataFrame) -> DataFrame:
    """Transfers with an amount of the sender, and of the receiver, on the day of each transfer."""
    day = F.to_date("ts").alias("day")
    src = tx.groupBy("src", day).agg(F.count("amt_paid").alias("src_day_count"))
    dst = tx.groupBy("dst", day).agg(F.count("amt_rec").alias("dst_day_count"))
    rows = tx.select("row_id", "src", "dst", day)
    return rows.join(src, ["src", "day"], "left").join(dst, ["dst", "day"], "left").select("row_id", "src_day_count", "dst_day_count")


def time_flags(tx: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return tx.select("row_id", F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), X.off_hours(ts).alias("off_hours"), X.weekend(ts).alias("is_weekend"))


def bank_flags(tx: DataFrame) -> DataFrame:
    c = F.col
    return tx.select("row_id", X.cross(c("from_bank"), c("to_bank")).alias("cross_bank"), X.same(c("from_bank"), c("to_bank")).alias("same_bank"), X.same(c("cur_rec"), c("cur_paid")).alias("same_currency"))


def previous_times(tx: DataFrame) -> DataFrame:
    """tx with _t (epoch seconds) and _before_src, _before_dst: the time of the account's previous transfer as sender, and as
    receiver; null for its first. No task holds all rows of one account (see plans.asof)."""
    rows = in_ranges(tx.withColumn("_t", X.epoch(F.col("ts"))), F.col("_t"))
    narrow = rows.select("ts", "row_id", "src", "dst", "_t", "_range")
    for k in ("src", "dst"):
        rows = previous(rows, k, ["ts", "row_id"], "_t", f"_before_{k}", narrow)
    return rows.drop("_range")


def gaps(tx: DataFrame) -> DataFrame:
    """Seconds since the account's previous transfer as sender, and as receiver; 0 for its first."""
    rows = previous_times(tx.select("row_id", "ts", "src", "dst"))
    return rows.select("row_id", *[F.coalesce(F.col("_t") - F.col(f"_before_{k}"), F.lit(0)).alias(f"gap_{k}") for k in ("src", "dst")])


def interevent_stats(tx: DataFrame) -> DataFrame:
    """Mean and population deviation of times between events of senders and receivers, each account's first counted from 0."""
    rows = previous_times(tx.select("row_id", "ts", "src", "dst"))
    rows = rows.select(*[(F.col("_t") - F.coalesce(f"_before_{k}", F.lit(0))).alias(k[0]) for k in ("src", "dst")])
    return rows.agg(F.avg("s").alias("mean_src"), F.stddev_pop("s").alias("std_src"), F.avg("d").alias("mean_dst"), F.stddev_pop("d").alias("std_dst"))
