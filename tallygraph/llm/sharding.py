"""Sharding by a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn first, exactly as a uniform shuffle of all rows
would deal them: multivariate hypergeometric counts whose row sums are the partitions' sizes and whose column sums
are the shards' sizes. Then each partition permutes its rows and deals them out by its counts, rows are exchanged
once, and each shard permutes what it got. Shard sizes are exact, and no task holds more than one block.

A shard of more rows than one block is made of several blocks, each a target of its own, so that the last
permutation stays small however large a shard is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
ROWS_PER_BLOCK = 1_000_000


def even_sizes(n: int, parts: int) -> list[int]:
    """n in so many parts, at most one apart."""
    return [n // parts + (k < n % parts) for k in range(parts)]


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: tuple[int, ...]) -> np.ndarray:
    """Rows that each partition sends to each target, drawn partition by partition from what the targets still lack."""
    rng = np.random.default_rng(seed)
    left = np.array(sizes, np.int64)
    out = np.zeros((len(partition_rows), len(sizes)), np.int64)
    for p, rows in enumerate(partition_rows):
        if rows:
            out[p] = rng.multivariate_hypergeometric(left, rows, method="marginals")
            left -= out[p]
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 11, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of documents(doc_id, text), uniformly shuffled.

    Law ``rows``: shards hold equal counts, at most one apart; slots of a shard run from 0 without a gap. size is
    the text's UTF-8 bytes (none for null) plus 8; the crc of a null text is 0, that of no bytes. Repeated rows and
    null ids are rows like any other; other columns are left out; an empty table gives an empty result.

    The driver draws the matrix of partitions by shards only; each shard's own matrix, partitions by blocks, is drawn
    in a task of that shard. An input partition of more than ``rows_per_block`` rows counts as several.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    # Where a row stood is written with it, so that neither a retry nor another split of the files can change it.
    here = F.monotonically_increasing_id()
    part = F.shiftright(here, 33) * 16_384 + F.floor(here.bitwiseAND((1 << 33) - 1) / rows_per_block)
    rows = materialize(rows.withColumn("part", part.cast("long")), "shard-rows")
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    matrix = communication_matrix([n for _, n in counts], even_sizes(sum(n for _, n in counts), shards), (seed,))
    to_shards = spark.createDataFrame(
        pa.table({"part": np.repeat(np.array([p for p, _ in counts], np.int64), shards), "shard": np.tile(np.arange(shards, dtype=np.int32), len(counts)), "n": matrix.ravel()})
    )

    def to_blocks(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n = table.column("n").to_pylist()
        sizes = even_sizes(sum(n), max(1, -(-sum(n) // rows_per_block)))
        sends = communication_matrix(n, sizes, (seed, 1, key[0].as_py()))
        begin = np.cumsum([0, *sizes[:-1]])
        k = len(sizes)
        out = {"part": np.repeat(table.column("part").to_numpy(), k), "shard": np.full(len(n) * k, key[0].as_py(), np.int32), "begin": np.tile(begin, len(n)), "n": sends.ravel()}
        out = pa.table({c: pa.array(v, pa.int32() if c == "shard" else pa.int64()) for c, v in out.items()})
        return out.filter(pc.greater(out.column("n"), 0))

    plan = to_shards.groupBy("shard").applyInArrow(to_blocks, "part long, shard int, begin long, n long")

    def deal(key: tuple, table: pa.Table, sends: pa.Table) -> pa.Table:
        rng = np.random.default_rng((seed, 2, key[0].as_py()))
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "text_crc32", "size")])
        sends = sends.sort_by([("shard", "ascending"), ("begin", "ascending")])
        to = rng.permutation(np.repeat(np.arange(len(sends)), sends.column("n").to_numpy()))
        out = {c: table.column(c) for c in ("doc_id", "size", "text_crc32")}
        out |= {"shard": sends.column("shard").take(pa.array(to)), "begin": sends.column("begin").take(pa.array(to)), "draw": pa.array(rng.random(len(to)))}
        return pa.table(out)

    dealt = rows.groupBy("part").cogroup(plan.groupBy("part")).applyInArrow(deal, "doc_id long, size long, text_crc32 long, shard int, begin long, draw double")
    within = Window.partitionBy("shard", "begin").orderBy("draw", "doc_id", "text_crc32", "size")
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.row_number().over(within) - 1).alias("slot"))
