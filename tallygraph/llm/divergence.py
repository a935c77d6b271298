"""Quality rules by distribution divergence.

Each language gets two reference histograms over the whole corpus: character classes, and its most common words
with all other words as one class. A document is compared with them by Jensen-Shannon distance (base 2, so 0 to 1)
and kept if some language is near enough in both; either comparison is left out where the text is too short for it.
Fixed base rules come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import quantile_row
from .common import NON_SPACE, byte_view, materialize, mix64, text_slices, window_hashes, word_hashes, word_spans
from .labelled import all_labelled_ids

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Character classes by first byte: white space, lower, upper, digit, sentence marks, symbols, other ASCII, beyond ASCII; 8: not a first byte.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[:128] = 6
CLASSES[[0x20, 9, 10, 11, 12, 13]] = 0
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 1, 2, 3
CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 4
CLASSES[_SYMBOL] = 5
CLASSES[0x80:0xC0] = 8
N_CLASSES = 8


#: Limits are this quantile of clean labelled documents' distances, with this margin.
CLEAN_QUANTILE, MARGIN = 0.999, 1.05
#: How many clean labelled documents it takes to learn a limit.
MIN_CLEAN = 50


@dataclass(frozen=True)
class Limits:
    """Parameters of the verdict; the two distances hold where no labels tell better ones."""

    common_words: int = 50
    min_chars: int = 100
    min_words: int = 60
    max_class_distance: float = 0.33
    max_word_distance: float = 0.48


def _row_counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


class Text:
    """One run of texts as bytes, with its words."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.data, self.off = byte_view(texts)
        self.starts, self.ends, self.row = word_spans(self.data, self.off, NON_SPACE)
        self.n_words = _row_counts(self.row, self.n)
        self.byte_row = np.repeat(np.arange(self.n), np.diff(self.off))

    def _sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def word_chars(self) -> np.ndarray:
        return self._sums(NON_SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def symbols(self) -> np.ndarray:
        return self._sums(_SYMBOL[self.data])

    def class_counts(self) -> np.ndarray:
        cell = self.byte_row * (N_CLASSES + 1) + CLASSES[self.data]
        return np.bincount(cell, minlength=self.n * (N_CLASSES + 1)).reshape(self.n, -1)[:, :N_CLASSES]

    def repeat_words(self) -> np.ndarray:
        """Words in a window of three words whose sequence occurs twice or more in the text."""
        h = window_hashes(word_hashes(self.data, self.starts, self.ends), 3)
        if not len(h):
            return np.zeros(self.n, np.int64)
        at = np.flatnonzero(self.row[:-2] == self.row[2:])
        key = mix64(h[at] + self.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(self.row), bool)
        for k in range(3):
            hit[at[twice] + k] = True
        return _row_counts(self.row[hit], self.n)

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        line_byte = np.ones(256, bool)
        line_byte[10] = False
        starts, ends, row = word_spans(self.data, self.off, line_byte)
        if not len(starts):
            return np.zeros(self.n, np.int64)
        inked = np.concatenate(([0], np.cumsum(NON_SPACE[self.data])))
        some = inked[ends] > inked[starts]
        starts, ends, row = starts[some], ends[some], row[some]
        key = mix64(word_hashes(self.data, starts, ends) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = np.unique(key, return_index=True)[1]
        later = np.ones(len(key), bool)
        later[first] = False
        return _row_counts(row[later], self.n)


def _with_lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def learn_references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[list[float], dict[int, float]]]:
    """For each non-null ``lang`` of documents(text, lang): shares of the character classes, and shares of its
    ``common_words`` most frequent lower-cased words (by 64-bit hash). Counted over all rows; the result holds
    at most ``common_words`` + 8 numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 22):
            lang = np.array(batch.column("lang").to_pylist(), object)
            shape, words = Text(batch.column("text")), Text(_with_lower(batch.column("text")))
            classes, hashes = shape.class_counts(), word_hashes(words.data, words.starts, words.ends)
            for x in sorted(set(lang)):
                keys, n = np.unique(hashes[lang[words.row] == x], return_counts=True) if len(hashes) else (hashes, np.zeros(0, int))
                key = np.concatenate((np.full(N_CLASSES + 1, 0), keys.view(np.int64)))
                kind = np.concatenate((np.arange(N_CLASSES + 1), np.full(len(keys), 99)))
                total = np.concatenate((classes[lang == x].sum(axis=0), [n.sum()], n))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(key), pa.string()), "kind": kind.astype(np.int32), "key": key, "n": total.astype(np.int64)})

    rows = docs.select("text", "lang").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "references")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    words = counts.filter("kind = 99").withColumn("rank", rank).filter(F.col("rank") <= limits.common_words).drop("rank")
    out: dict[str, tuple[list[float], dict[int, float]]] = {}
    found = [*counts.filter("kind < 99").collect(), *words.collect()]
    for lang in sorted({r["lang"] for r in found}):
        mine = [r for r in found if r["lang"] == lang]
        classes = np.zeros(N_CLASSES + 1)
        for r in mine:
            if r["kind"] < 99:
                classes[r["kind"]] = r["n"]
        if classes[N_CLASSES] > 0:
            out[lang] = ((classes[:N_CLASSES] / classes[:N_CLASSES].sum()).tolist(), {r["key"]: r["n"] / classes[N_CLASSES] for r in mine if r["kind"] == 99})
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def distances(texts: pa.Array, references: dict[str, tuple[list[float], dict[int, float]]], limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """The base counts of one run of texts, whether each text is long enough for either comparison (class_long, word_long), and
    its two distances to each reference, languages in order, as arrays of a row a text."""
    t = Text(texts)
    n = t.n
    out = {"n_words": t.n_words, "word_chars": t.word_chars(), "n_symbols": t.symbols(), "n_dup_lines": t.dup_lines(), "n_repeat_words": t.repeat_words()}
    out["base_failed"] = (t.n_words < 50) | (100 * out["n_repeat_words"] > 50 * t.n_words)
    classes = t.class_counts()
    total = classes.sum(axis=1)
    w = Text(_with_lower(texts))
    hashes = word_hashes(w.data, w.starts, w.ends).view(np.int64)
    shares = classes / np.maximum(total, 1)[:, None]
    d_class, d_word = np.zeros((n, len(references))), np.zeros((n, len(references)))
    for j, lang in enumerate(sorted(references)):
        ref, words = references[lang]
        keys = np.array(sorted(words), np.int64)
        d_class[:, j] = js_distance(shares, np.array(ref))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        col = np.where(keys[at] == hashes, at, len(keys))
        hist = np.bincount(w.row * (len(keys) + 1) + col, minlength=n * (len(keys) + 1)).reshape(n, -1) / np.maximum(w.n_words, 1)[:, None]
        share = np.array([words[k] for k in keys])
        d_word[:, j] = js_distance(hist, np.append(share, max(0.0, 1 - share.sum())))
    return out | {"class_long": total >= limits.min_chars, "word_long": w.n_words >= limits.min_words, "class_distances": d_class, "word_distances": d_word}


def learn_limits(measured: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Limits:
    """limits with the two distances that the clean documents of labels(doc_id, quality) keep to: a high quantile with a margin.

    measured holds doc_id, base_failed, class_long, word_long, class_distance and word_distance. Documents whose fold by 4 is 2
    are held out; all others with a label of 1 count that pass the base rules and are long enough for the comparison.
    Quantiles are exact, by rank. Where too few documents are left, a distance stays as it is.
    """
    clean = all_labelled_ids(labels, "quality", 4, 2).filter("y = 1").select("doc_id")
    found = measured.filter("not base_failed").join(clean, "doc_id", "left_semi")
    found = found.select(*[F.when(F.col(f"{k}_long"), F.col(f"{k}_distance")).alias(k) for k in ("class", "word")])
    counts = found.agg(F.count("class").alias("class"), F.count("word").alias("word")).first()
    learned = [k for k in ("class", "word") if counts[k] >= MIN_CLEAN]
    if not learned:
        return limits
    row = quantile_row(found, {k: (F.col(k), CLEAN_QUANTILE) for k in learned}).first()
    return replace(limits, **{f"max_{k}_distance": row[k] * MARGIN for k in learned})


def judge(docs: DataFrame, limits: Limits = Limits(), labels: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and
    word_distance (to the nearest language) for each row of documents(doc_id, text, lang).

    A null text counts as empty; it has no word and so fails the base rules. A null lang is compared like any other
    document but adds to no reference. Without any reference only the base rules decide. Repeated rows are each
    answered; other columns are left out; an empty table gives an empty result. With labels(doc_id, quality) the
    two distance limits are learned from all clean documents outside the held-out fold. Texts are read once for the
    references and once for the distances, which are written: limits and verdicts come from those.
    """
    references = learn_references(docs, limits)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    flags = ["base_failed", "class_long", "word_long"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", " + ", ".join(f"{c} boolean" for c in flags) + ", class_distances array<double>, word_distances array<double>"
    names = ["doc_id", *longs, *flags]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = distances(batch.column("text"), references, limits)
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(references), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(found[c].ravel(), pa.float64())) for c in ("class_distances", "word_distances")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c]) for c in names[1:]), *lists], [*names, "class_distances", "word_distances"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, schema)
    pairs = F.transform("class_distances", lambda c, i: F.struct((c + F.get("word_distances", i)).alias("sum"), i.alias("i"), c.alias("c"), F.get("word_distances", i).alias("w")))
    # Where none is nearer than 2 in sum, or there is no reference, both distances are 1.
    rows = rows.withColumn("best", F.array_min(F.filter(pairs, lambda p: p["sum"] < 2)))
    rows = rows.select(*names, "class_distances", "word_distances", F.coalesce("best.c", F.lit(1.0)).alias("class_distance"), F.coalesce("best.w", F.lit(1.0)).alias("word_distance"))
    rows = materialize(rows, "distances")
    if labels is not None and references:
        limits = learn_limits(rows, labels, limits)
    near = F.lit(True)
    if references:
        fits = lambda c, w: ((c <= limits.max_class_distance) | ~F.col("class_long")) & ((w <= limits.max_word_distance) | ~F.col("word_long"))
        near = F.exists(F.zip_with("class_distances", "word_distances", fits), lambda ok: ok)
    return rows.select("doc_id", *longs, "base_failed", (near & ~F.col("base_failed")).alias("kept"), "class_distance", "word_distance")
