"""Labelled documents outside a held-out fold, and bounded samples of them for fitting classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: A longer text is not used for fitting (it is scored like any other), which bounds what the driver holds.
MAX_TRAIN_BYTES = 65_536


def all_labelled_ids(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id, y: every labelled id outside the held-out fold. Null ids and labels are left out; an id with both labels is too."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", modulus) != held_out))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")


def labelled_ids(labels: DataFrame, label: str, modulus: int, held_out: int, bound: int, seed: int = 29) -> DataFrame:
    """doc_id, y, rate: at most about ``bound`` of all_labelled_ids, half of either class where there are enough; ``rate`` is the
    share of the class that was taken."""
    rows = all_labelled_ids(labels, label, modulus, held_out)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    few = min(sizes.values(), default=0) if len(sizes) == 2 else 0
    take = {y: min(1.0, (bound - min(few, bound // 2) if n > few else min(few, bound // 2)) / n) for y, n in sizes.items()}
    rate = F.create_map(*[x for y, v in take.items() for x in (F.lit(y), F.lit(v))])[F.col("y")] if take else F.lit(1.0)
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.withColumn("rate", rate).filter(share < F.col("rate"))


def labelled_texts(docs: DataFrame, ids: DataFrame, max_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """The texts of bounded labelled ids, one row an id and text; ids hold no more rows than their bound, so they are broadcast."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    return texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy"]).drop("copy")


def to_driver(sample: DataFrame) -> pd.DataFrame:
    """A bounded sample as pandas, in an order that doesn't depend on the tasks."""
    return sample.toPandas().sort_values("doc_id", ignore_index=True)
