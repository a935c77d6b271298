"""Readers and writers of the transfer, account, pattern, interaction and log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.work import global_index

#: Transfers as they stand in the files: ids are strings, so that leading zeros count.
TRANSFER_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("ts", "from_bank", "src", "to_bank", "dst", "amt_rec", "cur_rec", "amt_paid", "cur_paid", "fmt", "label")])
ACCOUNT_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("bank_name", "bank_id", "acct", "entity_id", "entity_name")])
TIME_FORMAT = "yyyy/MM/dd HH:mm"


def read_transfers(spark: SparkSession, path: str, time_format: str = TIME_FORMAT, strict: bool = True, header: bool = True) -> DataFrame:
    """Transfers with typed columns and row_id. strict: a bad timestamp is an error, else null. Bad amounts are null, a null label 0."""
    raw = spark.read.schema(TRANSFER_FILE).option("header", header).option("enforceSchema", True).csv(path)
    return type_transfers(numbered(raw, "row_id"), time_format, strict)


def numbered(raw: DataFrame, name: str) -> DataFrame:
    """Rows of files with ``name``: 0, 1, ... by file, then place in the file, however the files are cut; written once."""
    place = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return global_index(place, name, "_file", "_block", "_line").drop("_file", "_block", "_line")


def type_transfers(raw: DataFrame, time_format: str = TIME_FORMAT, strict: bool = True) -> DataFrame:
    parse = F.to_timestamp_ntz if strict else (lambda c, f: F.try_to_timestamp(c, f).cast("timestamp_ntz"))
    return raw.select(
        parse(F.col("ts"), F.lit(time_format)).alias("ts"), "from_bank", "src", "to_bank", "dst",
        F.expr("try_cast(amt_rec as double)").alias("amt_rec"), "cur_rec",
        F.expr("try_cast(amt_paid as double)").alias("amt_paid"), "cur_paid", "fmt",
        F.coalesce(F.expr("try_cast(label as int)"), F.lit(0)).alias("label"),
        F.col("row_id") if "row_id" in raw.columns else F.monotonically_increasing_id().alias("row_id"),
    )


def with_timestamps(tx: DataFrame) -> DataFrame:
    """tx as it is if it has a ts column; else with ts one minute a row_id from 1970 on."""
    if "ts" in tx.columns:
        return tx
    return tx.withColumn("ts", F.timestamp_seconds(F.col("row_id") * 60).cast("timestamp_ntz"))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCOUNT_FILE).option("header", True).csv(path)


def one_per_account(accounts: DataFrame) -> DataFrame:
    """The first row of each account, by entity id and name, so that joins don't multiply transfers."""
    return accounts.filter(F.col("acct").isNotNull()).groupBy("acct").agg(F.min_by(F.struct("entity_id", "entity_name"), F.struct("entity_id", "entity_name")).alias("e")).select("acct", "e.*")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed non-empty lines, each an account id."""
    return spark.read.text(path).select(F.trim("value").alias("acct")).filter("acct <> ''").distinct()


def cached_parquet(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; built, written with zstd and read back if it isn't there or was not written to its end."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """user, item, ts, label and a ragged tail of features: u, i, ts, label, idx, feats."""
    lines = numbered(spark.read.text(path), "idx").filter("not value like 'user%'").withColumn("idx", F.col("idx") - F.lit(1))
    parts = F.split("value", ",")
    return lines.select(
        parts[0].cast("bigint").alias("u"), parts[1].cast("bigint").alias("i"), parts[2].cast("double").alias("ts"), parts[3].cast("double").cast("int").alias("label"), "idx",
        F.transform(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), lambda x: x.cast("double")).alias("feats"),
    )


#: One training log line; fixed format.
LOG_LINE = r"Epoch\s+(\d+)\s*\|\s*train_loss=([\d.]+)\s+val_loss=([\d.]+)\s+P=([\d.]+)\s+R=([\d.]+)\s+F1=([\d.]+)\s+ROC-AUC=([\d.]+)\s+AUPR=([\d.]+)\s+time=([\d.]+)s"
LOG_FIELDS = ("epoch", "train_loss", "val_loss", "precision", "recall", "f1", "roc_auc", "aupr", "seconds")


def parse_log(lines: DataFrame) -> DataFrame:
    """One row for each epoch line of lines(value)."""
    rows = lines.filter(F.col("value").rlike(LOG_LINE))
    return rows.select(*[F.regexp_extract("value", LOG_LINE, k + 1).cast("int" if name == "epoch" else "double").alias(name) for k, name in enumerate(LOG_FIELDS)])


def best_epoch(log: DataFrame, metric: str = "aupr") -> DataFrame:
    """Best (first of equals) and last epoch of a parsed log, and the metric's gain over the first."""
    at = F.struct(F.col(metric), -F.col("epoch"))
    return log.agg(F.max_by("epoch", at).alias("best_epoch"), F.max(metric).alias("best"), F.max("epoch").alias("last_epoch"), (F.max(metric) - F.min_by(metric, "epoch")).alias("gain"))


def epochs_to_show(log: DataFrame, metric: str = "aupr", every: int = 50) -> DataFrame:
    """The epochs of a parsed log that a report shows: every 50th, the best (first of equals) and the last; with mark."""
    ends = log.agg(F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("_best"), F.max("epoch").alias("_last"))
    rows = log.crossJoin(F.broadcast(ends)).filter((F.col("epoch") % every == 0) | (F.col("epoch") == F.col("_best")) | (F.col("epoch") == F.col("_last")))
    return rows.withColumn("mark", F.when(F.col("epoch") == F.col("_best"), "best").when(F.col("epoch") == F.col("_last"), "stopped").otherwise("")).drop("_best", "_last")


def expected_range(log: DataFrame, metric: str = "aupr", share: float = 0.95) -> DataFrame:
    """low, high: what a test may give where the best validation value is high."""
    return log.agg((share * F.max(metric)).alias("low"), F.max(metric).alias("high"))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of files as they are read, for a look at them."""
    return df.limit(n)


def read_preprocessed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """interactions(u, i, ts, label, idx) and edge features(idx, feats) that write_preprocessed wrote; an error if the features
    don't have one row for each interaction."""
    rows, feats = spark.read.parquet(f"{folder}/interactions"), spark.read.parquet(f"{folder}/features")
    lost = rows.join(feats, "idx", "full").filter(F.col("u").isNull() | F.col("feats").isNull()).limit(1).count()
    if lost or rows.count() != feats.count():
        raise ValueError("interactions and features have other rows")
    return rows, feats


def write_preprocessed(interactions: DataFrame, folder: str) -> None:
    """interactions(u, i, ts, label, idx, feats) as two tables, so that a reader of ids need not read features."""
    interactions.select("idx", "feats").write.parquet(f"{folder}/features")
    interactions.drop("feats").write.parquet(f"{folder}/interactions")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition) if partition else w).format(fmt).save(path)


def table_kind(df: DataFrame) -> str:
    """'temporal' for an event stream, 'static' for a graph's edges; an error otherwise."""
    if {"src", "dst", "ts", "event_type"} <= set(df.columns) or {"src", "dst", "ts"} <= set(df.columns) and "edge_id" not in df.columns:
        return "temporal"
    if {"edge_id", "src", "dst"} <= set(df.columns):
        return "static"
    raise ValueError(f"neither a graph nor an event stream: {df.columns}")
