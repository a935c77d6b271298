"""Queries that write the driver's tables in the file formats of transfers, accounts, patterns, interactions and logs, and
read them back with the library's readers; and streams over such files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import opportunity as R
from ..operators import splits as P
from ..sources import fixtures as X0
from ..sources import readers as I
from ..streaming import state as K
from .queries import r6
from .work import work_path

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _path(spark: SparkSession, name: str) -> str:
    return work_path(spark, f"{name}-{uuid.uuid4().hex}")


def _in_order(df: DataFrame, order: str, *ties: str) -> DataFrame:
    """df in files whose names and lines follow the order."""
    return df.repartitionByRange(order).sortWithinPartitions(order, *ties)


def _transfer_files(spark: SparkSession, d: str, stamp: Column | None = None) -> str:
    """Transfers as CSV files; some amounts are no numbers and some labels are empty."""
    at, path = F.col("row_id"), _path(spark, "transfer-files")
    stamp = F.date_format("ts", I.TIME_FORMAT) if stamp is None else stamp
    paid = F.when(at % 50 == 0, "x").otherwise(F.col("amt_paid").cast("string"))
    tx = _in_order(X0.transfers(spark, d), "row_id").select(stamp.alias("ts"), F.concat(F.lit("0"), "from_bank").alias("from_bank"), "src", F.concat(F.lit("0"), "to_bank").alias("to_bank"), "dst", "amt_rec", "cur_rec", paid.alias("amt_paid"), "cur_paid", "fmt", F.when(at % 70 != 0, F.col("label")).alias("label"))
    tx.write.option("header", True).csv(path)
    return path


@query
def transfers_from_csv(spark, d):
    rows = I.read_transfers(spark, _transfer_files(spark, d))
    return r6(rows.select("row_id", X.epoch(F.col("ts")).alias("t"), "from_bank", "src", "to_bank", "dst", "amt_rec", "amt_paid", "cur_rec", "fmt", "label"))


@query
def transfers_with_bad_times(spark, d):
    """Lenient reading: a time that is none is null."""
    stamp = F.when(F.col("row_id") % 60 == 0, "yesterday").otherwise(F.date_format("ts", I.TIME_FORMAT))
    rows = I.read_transfers(spark, _transfer_files(spark, d, stamp), strict=False)
    return r6(rows.select("row_id", X.epoch(F.col("ts")).alias("t")))


@query
def synthetic_timestamps(spark, d):
    return r6(I.with_timestamps(X0.transfers(spark, d).drop("ts")).select("row_id", X.epoch(F.col("ts")).alias("t")))


@query
def accounts_from_csv(spark, d):
    """Accounts of which each stands in the file twice, as one row each."""
    a, path = X0.accounts(spark, d), _path(spark, "account-files")
    row = lambda entity: a.select(F.lit("B").alias("bank_name"), F.lit("01").alias("bank_id"), "acct", entity.alias("entity_id"), "entity_name")
    row(F.col("entity_id").cast("string")).unionAll(row(F.concat(F.lit("Z"), "entity_id"))).write.option("header", True).csv(path)
    return I.one_per_account(I.read_accounts(spark, path))


@query
def patterns_from_text(spark, d):
    """Account ids from lines with spaces around them, blank lines and repeats."""
    p, path = X0.patterns(spark, d), _path(spark, "pattern-files")
    lines = p.select(F.concat(F.lit("  "), "acct", F.lit(" ")).alias("value")).unionAll(p.select(F.when(F.col("acct") % 2 == 0, " ").otherwise(F.col("acct").cast("string")).alias("value")))
    lines.write.text(path)
    return I.read_patterns(spark, path)


@query
def interactions_from_csv(spark, d):
    """Order lines as user, item, time, label and features."""
    li, path = spark.read.parquet(f"{d}/lineitem.parquet"), _path(spark, "interaction-files")
    line = F.concat_ws(",", "l_suppkey", "l_partkey", F.col("l_linenumber") * 1.5, F.when(F.col("l_returnflag") == "R", "1.0").otherwise("0.0"), F.col("l_quantity").cast("double"), F.when(F.col("l_linenumber") > 2, F.col("l_discount").cast("double").cast("string")))
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"]
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), line.alias("value"), *ties)
    head = spark.range(1).select((-F.lit(1)).alias("place"), F.lit("user,item,ts,label,features").alias("value"))
    _in_order(rows.unionByName(head, allowMissingColumns=True), "place", *ties).select("value").write.text(path)
    got = I.read_interactions(spark, path)
    return r6(got.select("idx", "u", "i", F.col("ts").alias("at"), "label", F.size("feats").alias("n"), F.get("feats", F.lit(0)).alias("f0"), F.get("feats", F.lit(1)).alias("f1")))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A training log with one epoch a day of transfers, whose numbers come from sums of their ids."""
    day = F.floor(X.epoch(F.col("ts")) / 86400)
    days = X0.transfers(spark, d).groupBy(day.alias("day")).agg(F.sum("row_id").alias("s"))
    first, path = days.agg(F.min("day").alias("first")), _path(spark, "log-files")
    digits = lambda k: F.lpad(((F.col("s") * k) % 1000).cast("string"), 3, "0")
    line = F.concat(F.lit("Epoch "), F.lpad((F.col("day") - F.col("first") + 1).cast("string"), 3, "0"), F.lit(" | train_loss=0."), digits(3), F.lit(" val_loss=0."), digits(7), F.lit(" P=0.5 R=0.25 F1=0.333 ROC-AUC=0.9 AUPR=0."), digits(11), F.lit(" time=1.5s"))
    days.crossJoin(F.broadcast(first)).select(line.alias("value")).unionAll(spark.range(1).select(F.lit("starting").alias("value"))).write.text(path)
    return I.parse_log(spark.read.text(path))


@query
def log_epochs_shown(spark, d):
    """The epochs of a log that a report shows: every fifth, the best and the last."""
    return r6(I.epochs_to_show(_log(spark, d), every=5).select("epoch", "train_loss", "val_loss", "f1", "aupr", "mark"))


@query
def log_best_epoch(spark, d):
    log = _log(spark, d)
    return r6(I.best_epoch(log).crossJoin(I.expected_range(log)))


@query
def cached_transfers(spark, d):
    """A table that is built where it is missing and read from then on; the second build would give no rows."""
    path, tx = _path(spark, "cached"), X0.transfers(spark, d)
    I.cached_parquet(spark, path, lambda: tx)
    return r6(I.cached_parquet(spark, path, lambda: tx.limit(0)).groupBy("fmt").agg(F.count("*").alias("n"), F.max("row_id").alias("last_id")))


@query
def intensity_csv_files(spark, d):
    """Injected tables as one folder of CSV files an intensity, read back by columns."""
    path = _path(spark, "intensity-files")
    rows = R.intensity_labels(R.opportunity(X0.transfers(spark, d), X0.accounts(spark, d), X0.patterns(spark, d)))
    I.write_table(rows.select("row_id", "RAT_injected", "RAT_intensity_level", "intensity"), path, "csv", ["intensity"])
    back = spark.read.schema("row_id long, RAT_injected int, RAT_intensity_level int, intensity string").option("header", True).csv(path)
    return r6(back.groupBy("intensity").agg(F.count("*").alias("n"), F.sum("RAT_injected").alias("injected"), F.max("RAT_intensity_level").alias("level"), F.max("row_id").alias("last_id")))


@query
def time_encoding_cosine(spark, d):
    """Cosine codes of the seconds since the first transfer."""
    tx = X0.transfers(spark, d).select("row_id", X.epoch(F.col("ts")).alias("t"))
    code = X.cosine_ladder((F.col("t") - F.col("first")).cast("double"), 4)
    return r6(tx.crossJoin(F.broadcast(tx.agg(F.min("t").alias("first")))).select("row_id", *[code[k].alias(f"e{k}") for k in range(4)]))


@query
def split_positions(spark, d):
    """A split of 70, 15 and 15 per cent by place in time."""
    return r6(P.chronological(X0.transfers(spark, d), 0.7, 0.15))


@query
def stream_time_gaps(spark, d):
    """Seconds since each sender's event before, from a stream over files with state by sender."""
    path, out = _path(spark, "gap-events"), _path(spark, "gap-results")
    tx = X0.transfers(spark, d).select("src", "row_id", X.epoch(F.col("ts")).alias("t"))
    tx.write.parquet(path)
    stream = K.stream_gaps(spark.readStream.schema(tx.schema).parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("src long, row_id long, gap long").parquet(out)
