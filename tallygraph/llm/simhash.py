"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits are covered by a product of small perfect codes. Each code's word is an anchor, every point has
one nearest anchor, its home, at no more than the covering radius. A pair that differs in at most 2h bits has a
midpoint within h bits of both, and the midpoint's home is within the covering radius plus h of both. So each fingerprint is replicated to
the homes of all points within h bits of it (of the anchors within covering radius plus threshold these suffice), and
pairs are compared anchor by anchor.

Equal fingerprints are one class first. An anchor with over ``CROWDED`` classes is cut finer instead of compared pair by
pair: each of its points is an anchor of its own there (a code of radius 0), whose fingerprints all link, so one link
to the least of them is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, byte_view, materialize, small, text_slices, word_spans
from .components import components
from .periodic import joined

WIDTH = 3
SEED = 42
#: Anchors with more classes are cut finer.
CROWDED = 256
#: Shingles are hashed and counted in blocks of so many, which bounds what a long text takes.
BLOCK = 1 << 16


class LinearCode:
    """A linear code of short words, given by the parity pattern of each place; its cosets' lightest words correct to the
    nearest codeword."""

    def __init__(self, columns: list[int]):
        self.length, self.radius = len(columns), 0
        checks = max(columns).bit_length()
        leader = {0: 0}
        while len(leader) < 1 << checks:
            self.radius += 1
            for places in combinations(range(self.length), self.radius):
                s = e = 0
                for i in places:
                    s, e = s ^ columns[i], e | 1 << i
                leader.setdefault(s, e)
        self.leader = np.array([leader[s] for s in range(1 << checks)], np.uint64)
        # Parity of each byte's value at each byte place.
        bit = lambda v, i: columns[i] if i < self.length and v >> (i % 8) & 1 else 0
        self.parity = np.zeros((-(-self.length // 8), 256), np.int64)
        for place in range(len(self.parity)):
            for v in range(256):
                for i in range(8 * place, 8 * place + 8):
                    self.parity[place, v] ^= bit(v, i)

    def home(self, words: np.ndarray) -> np.ndarray:
        """The nearest codeword of each word (one of them, always the same, where several are)."""
        s = np.zeros(words.shape, np.int64)
        for place, table in enumerate(self.parity):
            s ^= table[((words >> np.uint64(8 * place)) & np.uint64(255)).astype(np.int64)]
        return words ^ self.leader[s]


def _remainders(length: int, generator: int) -> list[int]:
    """x^i modulo a generator polynomial, for i below length: parity patterns of a cyclic code."""
    out, r, top = [], 1, generator.bit_length() - 1
    for _ in range(length):
        out.append(r)
        r <<= 1
        if r >> top & 1:
            r ^= generator
    return out


#: Golay codes of 23 bits (radius 3), Hamming codes of 15 and 3 bits (radius 1): 64 bits, 2^36 anchors, covering radius 8.
GOLAY = LinearCode(_remainders(23, 0xC75))
CODES = [GOLAY, GOLAY, LinearCode(list(range(1, 16))), LinearCode([1, 2, 3])]


def homes(points: np.ndarray, codes: list[LinearCode] = CODES) -> np.ndarray:
    """The home anchor of each 64-bit point, itself a 64-bit number."""
    out, at = np.zeros(points.shape, np.uint64), 0
    for code in codes:
        out |= code.home((points >> np.uint64(at)) & np.uint64((1 << code.length) - 1)) << np.uint64(at)
        at += code.length
    return out


def flips(h: int) -> np.ndarray:
    """All patterns of at most h of 64 bits."""
    return np.array([sum(1 << i for i in places) for k in range(h + 1) for places in combinations(range(64), k)], np.uint64)


def fingerprints_of(texts: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text: bit j is 1 if it is in over half the XXH64 of the text's word shingles (ASCII letters
    lower-cased, repeats included; fewer words: the whole sequence); 0 for a text without words."""
    data, off = byte_view(texts)
    data = LOWER[data]
    starts, ends, row = word_spans(data, off, NON_SPACE)
    rows = len(off) - 1
    text, begin, _ = joined(data, starts, ends, row, rows)
    raw, stop = text.tobytes(), begin + (ends - starts)
    n = np.bincount(row, minlength=rows)
    number = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    head = np.flatnonzero((number + width <= n[row]) | (number == 0))
    tail = np.minimum(head + width, (np.cumsum(n))[row[head]]) - 1
    total = np.bincount(row[head], minlength=rows)
    ones = np.zeros((rows, 64), np.int64)
    for i in range(0, len(head), BLOCK):
        at = slice(i, i + BLOCK)
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(raw[b:e], seed) for b, e in zip(begin[head[at]].tolist(), stop[tail[at]].tolist())], np.uint64)
        owner = row[head[at]]
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[owner[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fp (64 bits as a signed number) for each row of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(batch.column("text"), width, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _replicas(classes: DataFrame, h: int) -> DataFrame:
    near = flips(h)
    step = max(1, (1 << 20) // len(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(every), step):
                fp = every[i : i + step]
                at = np.sort(homes(fp[:, None] ^ near[None, :]), axis=1)
                new = np.ones(at.shape, bool)
                new[:, 1:] = at[:, 1:] != at[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(at[new].view(np.int64)), pa.array(np.repeat(fp, new.sum(axis=1)).view(np.int64))], ["anchor", "fp"])

    return classes.select("fp").mapInArrow(run, "anchor long, fp long")


def _points(crowded: DataFrame, h: int) -> DataFrame:
    near = flips(h)
    step = max(1, (1 << 20) // len(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, every = (batch.column(c).to_numpy().view(np.uint64) for c in ("anchor", "fp"))
            for i in range(0, len(every), step):
                fp = every[i : i + step]
                points = fp[:, None] ^ near[None, :]
                here = homes(points) == anchors[i : i + step, None]
                yield pa.RecordBatch.from_arrays([pa.array(points[here].view(np.int64)), pa.array(np.repeat(fp, here.sum(axis=1)).view(np.int64))], ["point", "fp"])

    return crowded.select("anchor", "fp").mapInArrow(run, "point long, fp long")


def fingerprint_links(classes: DataFrame, bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """a < b: links between distinct fingerprints of classes(fp) that differ in at most ``bits`` bits: all of them where
    anchors are not crowded, and enough to connect the same components where they are."""
    if bits % 2:
        raise ValueError("bits must be even")
    postings = materialize(_replicas(classes, bits // 2), "anchor-postings")
    sizes = materialize(postings.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1"), "anchor-sizes")
    full = sizes.filter(F.col("c") > crowded).select("anchor")
    busy = full.limit(1).count() > 0
    rest = postings.join(small(full), "anchor", "left_anti") if busy else postings
    rest = rest.join(sizes.filter(F.col("c") <= crowded).select("anchor"), "anchor", "left_semi")
    pair = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits)
    links = rest.alias("x").join(rest.alias("y"), pair).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if busy:
        points = materialize(_points(postings.join(small(full), "anchor", "left_semi"), bits // 2), "anchor-points")
        least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("c")).filter("c > 1").select("point", "a")
        links = links.unionAll(points.join(least, "point").filter("a < fp").select("a", F.col("fp").alias("b")))
    return links.distinct()


def simhash_components(docs: DataFrame, bits: int = 2, width: int = WIDTH, seed: int = SEED, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of documents(doc_id, text).

    Rows link when their fingerprints differ in at most ``bits`` (even) bits; component_id is the least doc_id that links
    reach, the row's own included. A null, empty or blank text has the fingerprint zero, which links like any other. Rows
    that repeat a doc_id are each answered. A row without id links like any other and others may be reached through it; a
    component of such rows alone has a null component_id. Other columns are left out; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, width, seed), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    labels = components(materialize(fingerprint_links(classes, bits, crowded), "fingerprint-links"))
    placed = classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    found = placed.join(least, "label").select("fp", "component_id")
    return rows.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
