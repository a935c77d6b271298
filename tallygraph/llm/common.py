"""Shared helpers: work tables in the shared folder, label folds, and Arrow/numpy views of text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where driver and executors are one process, if the session names no spark.checkpoint.dir.
LOCAL_WORK_DIR = "/tmp/checkpoints"
#: Texts are handled in runs of whole documents of about this many bytes, which bounds a task's arrays.
CHUNK_BYTES = 1 << 19


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_WORK_DIR).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps neither recompute nor lose it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as df has such a column (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_LAST = (1 << 63) - 1
#: What names a row in joins; see with_row_key.
ROW_KEY = "struct<id:bigint,tie:bigint,copy:bigint>"


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs(doc_id, text, ...) with one more column: a key of id, tie, copy, which sort in this order.

    A row whose id no other row has gets ties of 0. Rows of one id are told apart by a hash of their texts. Null ids
    come last, by the same hash; as they name nothing, each such row also has a number of its own, written once.
    """
    number = F.col("doc_id").cast("long")
    code = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_LAST))
    zero = F.lit(0).cast("long")
    key = lambda i, tie, copy: F.struct(i.alias("id"), tie.alias("tie"), copy.alias("copy"))
    named = docs.filter(number.isNotNull())
    again = named.groupBy(number.alias(f"{name}_id")).agg(F.count("*").alias(f"{name}_n")).filter(F.col(f"{name}_n") > 1)
    if again.limit(1).count():
        named = named.join(small(again), number == F.col(f"{name}_id"), "left")
        named = named.withColumn(name, key(number, F.when(F.col(f"{name}_n").isNotNull(), code).otherwise(zero), zero)).select(*docs.columns, name)
    else:
        named = named.withColumn(name, key(number, zero, zero))
    nameless = docs.filter(number.isNull())
    if not nameless.limit(1).count():
        return named
    nameless = nameless.withColumn(name, key(F.lit(_LAST), code, F.monotonically_increasing_id() + 1))
    return named.unionByName(materialize(nameless, "null-ids"))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo: the split that decides which labels may be learned."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows of df, chosen by a hash of ``key`` (all rows where there are no more)."""
    n = df.count()
    if n <= bound:
        return df
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003))
    return df.filter(share < F.lit(int(1_000_003 * bound / n)))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose texts hold about ``limit`` bytes; a longer text is a run of its own."""
    for batch in batches:
        off = byte_view(batch.column(batch.schema.get_field_index(column)))[1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and each text's offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    if len(texts) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of word bytes; no word crosses two texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = word_byte[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < len(data)]] = False
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Words of the class [^\x20\x09-\x0D]+, by byte.
NON_SPACE = ~_WHITE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE64 = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash can serve."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike on every machine and in every run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.cumprod(np.full(int(lens.max()), _STEP | np.uint64(1), np.uint64))
    values = _BYTE64[data[pos + np.repeat(starts, lens)]] * powers[pos]
    return mix64(np.add.reduceat(values, first) + lens.astype(np.uint64))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries, in order (windows may cross rows; callers mask those)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * _STEP + hashes[j : j + m]
    return mix64(h)
