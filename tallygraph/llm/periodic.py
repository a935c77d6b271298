"""Periodic run detection by heavy/light lag counting.

A run is a stretch of words whose every word equals the one a period earlier, as long as it can be, with no smaller
period, of at least ``LEAST_LENGTH`` words and ``LEAST_POWER`` periods.

1. For each lag, how many pairs of equal words are that far apart is counted exactly: for words that are frequent in
   their text by FFT autocorrelation of their places, for the others by differences of places.
2. A run of period p holds at least max(LEAST_LENGTH, LEAST_POWER * p) - p such pairs at lag p. Lags with fewer are done.
   Pairs within a known run of period q are taken off at the multiples of q: none of them is in a run of another period.
3. A lag that is left is looked at in every eighth of a period first; only where all samples of a long enough island
   agree is each word compared.

Texts are independent of each other, so nothing is shuffled; a task holds one run of texts (see CHUNK_BYTES) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, byte_view, text_slices, word_hashes, word_spans

LEAST_LENGTH = 6
LEAST_POWER = 4
#: A word of f places is counted by FFT of size N if f * f is over PAIR_BASE + PAIR_RATE * N * log2(N): about where pairs cost more.
PAIR_BASE, PAIR_RATE = 12_000, 0.3
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least_pairs(p: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> np.ndarray:
    """Pairs at lag p that the shortest run of period p has."""
    return np.maximum(least_length, least_power * p) - p


def word_codes(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word of each row (equal words of a row have one), the places sorted by row, word and place, and
    where each word's places begin and end in that order."""
    order = np.lexsort((words, row))
    r, w = row[order], words[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])))) if len(w) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(w)))
    codes = np.empty(len(w), np.int64)
    codes[order] = np.repeat(np.arange(len(new)), sizes)
    return codes, order, np.append(new, len(w))


def lag_counts(order: np.ndarray, bounds: np.ndarray, row: np.ndarray, begin: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal words at each lag from 0 to top[r] of every row r, rows behind each other, and where each row's begin."""
    base = np.concatenate(([0], np.cumsum(top + 1)))
    count = np.zeros(base[-1], np.int64)
    if not len(order):
        return count, base
    sizes = np.diff(bounds)
    owner = row[order[bounds[:-1]]]
    n = np.diff(begin)[owner]
    fft = 2.0 ** np.ceil(np.log2(np.maximum(2, n + top[owner] + 1)))
    heavy = (sizes.astype(float) ** 2 > PAIR_BASE + PAIR_RATE * fft * np.log2(fft)) & (top[owner] > 0)

    # Rare words: each place with its first, second, ... successor, as long as that is near enough.
    end = np.repeat(bounds[1:], sizes)
    left = np.flatnonzero(~np.repeat(heavy, sizes))
    step = 1
    while len(left):
        left = left[left + step < end[left]]
        gap = order[left + step] - order[left]
        near = gap <= top[row[order[left]]]
        left, gap = left[near], gap[near]
        np.add.at(count, base[row[order[left]]] + gap, 1)
        step += 1

    for r in np.unique(owner[heavy]).tolist():
        size = int(2 ** np.ceil(np.log2(begin[r + 1] - begin[r] + top[r] + 1)))
        power = np.zeros(size // 2 + 1)
        for k in np.flatnonzero(heavy & (owner == r)).tolist():
            places = np.zeros(size)
            places[order[bounds[k] : bounds[k + 1]] - begin[r]] = 1
            f = np.fft.rfft(places)
            power += f.real**2 + f.imag**2
        count[base[r] : base[r + 1]] += np.rint(np.fft.irfft(power, size)[: top[r] + 1]).astype(np.int64)
    return count, base


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of stretches of at least ``least`` true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    b, e = edge[::2], edge[1::2]
    keep = e - b >= least
    return b[keep], e[keep]


def islands(codes: np.ndarray, p: int, least: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) of at least ``least`` places i with codes[i] == codes[i + p] that neither side extends."""
    n, d = len(codes) - p, max(1, p // 8)
    if d == 1:
        return list(zip(*(x.tolist() for x in _stretches(codes[:n] == codes[p:], least))))
    at = np.arange(0, n, d)
    out = []
    for b, e in zip(*(x.tolist() for x in _stretches(codes[at] == codes[at + p], least // d))):
        lo, hi = (at[b - 1] + 1 if b else 0), (at[e] if e < len(at) else n)
        for s, t in zip(*(x.tolist() for x in _stretches(codes[lo:hi] == codes[lo + p : hi + p], least))):
            out.append((int(lo) + s, int(lo) + t))
    return out


def runs_of(codes: np.ndarray, count: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text, by start and period. count: its lag counts, which are used up."""
    need = least_pairs(np.arange(len(count)), least_length, least_power)
    found: dict[tuple[int, int], int] = {}
    for p in np.flatnonzero(count >= need).tolist():
        if p == 0 or count[p] < need[p]:
            continue
        for b, e in islands(codes, p, int(need[p])):
            run = (b, e - b + p)
            # A stretch whose smallest period is smaller is just the run of that period.
            if run not in found:
                found[run] = p
                multiples = np.arange(2 * p, min(len(count), run[1]), p)
                count[multiples] -= run[1] - multiples
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each row's words with one space between them, each word's begin there, and each row's."""
    lens = ends - starts
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    begin = np.cumsum(lens + ~first) - lens
    out = np.full(int(begin[-1] + lens[-1]) if len(lens) else 0, 32, np.uint8)
    within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(begin, lens) + within] = data[np.repeat(starts, lens) + within]
    heads = np.append(begin - ~first, len(out))
    return out, begin, heads[np.searchsorted(row, np.arange(rows + 1))]


def _analyse(texts: pa.Array, least_length: int, least_power: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    data, off = byte_view(texts)
    starts, ends, row = word_spans(data, off, NON_SPACE)
    rows = len(off) - 1
    begin = np.searchsorted(row, np.arange(rows + 1))
    top = np.diff(begin) // least_power
    codes, order, bounds = word_codes(word_hashes(data, starts, ends), row)
    count, base = lag_counts(order, bounds, row, begin, top)
    lag = np.arange(len(count)) - np.repeat(base[:-1], np.diff(base))
    hopeful = (count >= least_pairs(lag, least_length, least_power)) & (lag > 0)
    runs: list[list] = [[] for _ in range(rows)]
    dropped = np.zeros(len(starts) + 1, np.int64)
    for r in np.unique(np.searchsorted(base, np.flatnonzero(hopeful), "right") - 1).tolist():
        runs[r] = runs_of(codes[begin[r] : begin[r + 1]], count[base[r] : base[r + 1]], least_length, least_power)
        for s, n, p in runs[r]:
            dropped[begin[r] + s + p] += 1
            dropped[begin[r] + s + n] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    out, _, heads = joined(data, starts[kept], ends[kept], row[kept], rows)
    kind = pa.large_string() if len(out) > 2**31 - 1 else pa.string()
    text = pa.Array.from_buffers(kind, rows, [None, pa.py_buffer(heads.astype(np.int64 if kind == pa.large_string() else np.int32)), pa.py_buffer(out)])
    return pa.array(np.diff(begin), pa.int64()), pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in runs], _RUNS), text


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """doc_id, n_words, runs, collapsed for each row of documents(doc_id, text).

    runs is an array of (start, length, period) by start and period, in words [^\\x20\\x09-\\x0D]+ numbered from 0; runs of
    different periods may overlap. collapsed is the text without the words that any run holds after its first period,
    joined by one space. A null, empty or blank text has no words, no runs and an empty collapsed text. Rows with equal or
    null doc_id are each answered; other columns are left out; an empty table gives an empty result. Words are told
    apart by 64-bit hashes within their own text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_analyse(batch.column("text"), least_length, least_power)], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic tail in one text of ten: with h the crc32 of the id in decimals and g = h div 10,
    where h mod 10 is 0 each word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).

    Such a text comes back as its words, joined by spaces. A text without words and a row without id stay as they are.
    """
    number = F.col("doc_id").cast("long")
    h = F.crc32(number.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        ahead = F.slice(w, F.lit(1), a.cast("int"))
        rest = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda j: F.element_at(w, (a + j % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(ahead, rest), " ")).otherwise(F.col("text"))

    # The lambda binds the words once; otherwise each use would split the text again.
    planted = F.element_at(F.transform(F.array(words), tail), 1)
    return docs.select(number.alias("doc_id"), F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_report(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (least start, then period, of equals) and digests of runs and collapsed text."""
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("shorter"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    rows = runs.withColumn("best", best)
    length, period = -F.col("best.shorter"), F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * -best.shorter) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
