"""Substring dedup by seed and extend.

A window is ``length`` consecutive words. The winnowing rule picks in every window the seed of ``SEED`` words with the
least hash (the leftmost of equals), so equal windows hold equal seeds at equal places, and a text has few seeds.

1. Seeds are counted over the corpus; one that occurs once has no repeated window around it.
2. A shared seed is extended both ways as far as windows still choose it: its reach. Occurrences whose whole reaches
   are equal form a class, and all but the first of a class repeat everything in it.
3. Where a seed has several classes, their first occurrences are extended step by step: the windows around the seed
   are matched one by one with their earliest occurrence.
4. Steps that join up are maximal repeats; the words they cover are removed.

No pairs of occurrences are made: a group of any size costs its size. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, ROW_KEY, byte_view, materialize, mix64, text_slices, window_hashes, with_row_key, word_hashes, word_spans

LENGTH = 20
SEED = 5
#: Ids of at most so many documents are sent to all tasks to pick those documents; beyond that they are joined.
BROADCAST_IDS = 1_000_000
#: Places within a run of texts: an Arrow string holds less than 2^31 bytes, so no more than 2^30 words.
_POS = np.uint64((1 << 30) - 1)
_Q = 0xD1342543DE82EF95
_Q_INVERSE = np.uint64(pow(_Q, -1, 1 << 64))


def seeds(texts: pa.Array, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Every chosen seed of each text: row, lo and hi (first and last window start that choose it, counted within the
    text), h (the seed's hash), reach (hash of all words its windows cover, and where it stands among them)."""
    data, off = byte_view(texts)
    starts, ends, row = word_spans(data, off, NON_SPACE)
    words = word_hashes(data, starts, ends)
    empty = np.zeros(0, np.int64)
    if len(words) < length:
        return {"row": empty, "lo": empty, "hi": empty, "h": empty, "reach": empty}
    g = window_hashes(words, seed)
    least = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    span, width = length - seed + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = (least & _POS).astype(np.int64)
    valid = row[: len(at)] == row[length - 1 :][: len(at)]
    s = np.flatnonzero(valid)
    if not len(s):
        return {"row": empty, "lo": empty, "hi": empty, "h": empty, "reach": empty}
    new = np.concatenate(([True], (at[s][1:] != at[s][:-1]) | (s[1:] != s[:-1] + 1)))
    first = np.flatnonzero(new)
    lo, hi = s[first], s[np.append(first[1:], len(s)) - 1]
    p = at[lo]
    n = len(words)
    power, undo, total = np.full(n, _Q, np.uint64), np.full(n, _Q_INVERSE, np.uint64), np.zeros(n + 1, np.uint64)
    power[0] = undo[0] = 1
    power, undo = np.cumprod(power), np.cumprod(undo)
    total[1:] = np.cumsum(words * power)
    reach = (total[hi + length] - total[lo]) * undo[lo]
    reach = mix64(reach + mix64(((p - lo) * 64 + (hi - lo)).astype(np.uint64)))
    begin = np.searchsorted(row, np.arange(len(off) - 1))
    r = row[lo]
    return {"row": r, "lo": lo - begin[r], "hi": hi - begin[r], "h": g[p].view(np.int64), "reach": reach.view(np.int64)}


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, spans: for each document with repeated windows, the struct(lo, hi) of window starts that repeat an earlier window.

    docs has keys of with_row_key as doc_id. Earlier is a smaller key, or the same and a smaller start.
    """

    def seed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            h, n = np.unique(seeds(batch.column("text"), length)["h"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            s = seeds(batch.column("text"), length)
            cols = [batch.column("doc_id").take(pa.array(s["row"])), *(pa.array(s[c].astype(np.int32)) for c in ("lo", "hi")), pa.array(s["h"]), pa.array(s["reach"])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lo", "hi", "h", "reach"])

    shared = docs.select("text").mapInArrow(seed_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    found = docs.mapInArrow(occurrences, f"doc_id {ROW_KEY}, lo int, hi int, h long, reach long").join(shared, "h", "left_semi")
    found = materialize(found, "shared-seeds")

    classes = found.groupBy("h", "reach").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("first"), F.count("*").alias("n"))
    classes = materialize(classes, "reaches")
    many = classes.filter("n > 1").select("h", "reach", "first")
    later = found.join(many, ["h", "reach"]).filter(F.struct("doc_id", "lo") > F.struct("first.doc_id", "first.lo")).select("doc_id", "lo", "hi")

    several = classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    ladder = classes.join(several, "h", "left_semi").select("first.doc_id", "first.lo", "first.hi")
    ladder = materialize(ladder.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "ladders")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, off = byte_view(batch.column("text"))
            starts, ends, row = word_spans(data, off, NON_SPACE)
            w = window_hashes(word_hashes(data, starts, ends), length)
            begin = np.searchsorted(row, np.arange(len(off) - 1))
            spans = batch.column("spans")
            of = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            size = (hi - lo + 1).astype(np.int64)
            start = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            of = np.repeat(of, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(start.astype(np.int32)), pa.array(w[begin[of] + start].view(np.int64))], ["doc_id", "lo", "w"])

    picked = docs
    if ladder.count() <= BROADCAST_IDS:
        picked = docs.join(F.broadcast(ladder.select("doc_id")), "doc_id", "left_semi")
    steps = picked.join(ladder, "doc_id").select("doc_id", "text", "spans").mapInArrow(windows, f"doc_id {ROW_KEY}, lo int, w long")
    steps = materialize(steps, "ladder-steps")
    firsts = steps.groupBy("w").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = steps.join(firsts, "w").filter(F.struct("doc_id", "lo") > F.col("first")).select("doc_id", "lo", F.col("lo").alias("hi"))
    return later.unionAll(again).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for each row of documents(doc_id, text).

    Removed is each word covered by a window of ``length`` words whose sequence also starts earlier (a smaller doc_id,
    or the same document at a smaller start), as the input has them. kept holds the other words joined by one space;
    kept_sha256 is its SHA-256. A null or empty text, or one of white space, has no words; texts shorter than a window
    lose none. A null doc_id counts as the largest and names no document: several such rows are compared like rows of
    different ids, in an order by a hash of their texts. Rows with equal doc_id and text are the same document and
    never repeat each other; rows of one doc_id with different texts are compared in the order of that hash. Other
    columns are left out; an empty table gives an empty result.
    """
    docs = with_row_key(docs.select("doc_id", "text"), "key").select(F.col("key").alias("doc_id"), "text")
    spans = repeated_spans(docs, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, off = byte_view(batch.column("text"))
            starts, ends, row = word_spans(data, off, NON_SPACE)
            begin = np.searchsorted(row, np.arange(len(off)))
            n_words = np.diff(begin)
            spans = batch.column("spans")
            if spans.null_count:
                spans = spans.fill_null([])
            of = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            edge = np.zeros(len(starts) + 1, np.int64)
            # No span leaves its own row.
            np.add.at(edge, np.minimum(begin[of] + flat.field("lo").to_numpy(), begin[of + 1]), 1)
            np.add.at(edge, np.minimum(begin[of] + flat.field("hi").to_numpy() + length, begin[of + 1]), -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.bincount(row[gone], minlength=batch.num_rows)
            kept = []
            raw = data.tobytes()
            for k in range(batch.num_rows):
                b, e = int(begin[k]), int(begin[k + 1])
                if removed[k]:
                    kept.append(b" ".join([raw[starts[i] : ends[i]] for i in (b + np.flatnonzero(~gone[b:e])).tolist()]))
                else:
                    kept.append(b" ".join(raw[off[k] : off[k + 1]].split()))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            cols = [batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string()), pa.array([x.decode() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {ROW_KEY}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id.copy") == 0, F.col("doc_id.id")))
