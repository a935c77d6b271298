"""Language ID by rank-order profiles.

A profile lists a language's most frequent character n-grams by rank. A document's own list is compared with
each profile: every n-gram costs the distance between its two ranks, or the profile's length where it is missing.
The language with the least sum is predicted.

N-grams are 1 to 4 characters of the lower-cased text with each run of other characters than letters and their marks
(by Unicode category) as one space. Ties in count go by length and code points, ties between languages by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, byte_view, fold, text_slices

PROFILE_SIZE = 400
#: Bound on the labelled documents that profiles are learned from.
MAX_TRAIN_DOCS = 20_000
UNDETERMINED = "und"
#: Limits of the pipeline: a text farther than MAX_DISTANCE from every profile is in none of the languages; beyond
#: DOUBTFUL its nearest profile must also lead the second by MIN_LEAD. Held-out documents of any length stay below them.
MAX_DISTANCE, DOUBTFUL, MIN_LEAD = 0.75, 0.65, 0.01
N_MAX = 4
#: By code point, eight to a byte: letters (categories L), and letters with their marks (M).
_CATEGORY = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
_LETTERS = np.packbits(np.array([c == "L" for c in _CATEGORY]))
_KEEP = np.packbits(np.array([c in "LM" for c in _CATEGORY]))
del _CATEGORY


def _is(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (table[points >> 3] >> (7 - (points & 7)).astype(np.uint8)) & 1 == 1


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and each text's offsets."""
    data, off = byte_view(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]


def _has_letter(texts: pa.Array) -> np.ndarray:
    points, off = _code_points(texts)
    seen = np.concatenate(([0], np.cumsum(_is(_LETTERS, points))))
    return seen[off[1:]] > seen[off[:-1]]


#: Bytes of texts that are counted and compared at a time: n-grams take some hundred times as much for a moment.
LEARN_BYTES, COMPARE_BYTES = 1 << 18, 1 << 17


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count of each distinct n-gram of each text, by row and n-gram; and the alphabet.

    An n-gram is a number whose digits, as many bits each as the last alphabet place needs, are places in the alphabet
    (0: none, then code points in order). Where row and digits are too many bits for one number, halves are numbered first.
    """
    empty = np.zeros(0, np.int64)
    points, off = _code_points(pc.utf8_lower(texts))
    if not len(points):
        return empty, empty, empty, empty
    keep = _is(_KEEP, points)
    body = np.where(keep, points, 32)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    wanted = keep.copy()  # of a run of other characters only the first is left
    wanted[1:] |= keep[:-1]
    wanted[off[:-1][off[:-1] < len(points)]] = True
    body, row = body[wanted], row[wanted]
    alphabet, digit = np.unique(body, return_inverse=True)
    if len(alphabet) >= 1 << 15:  # more letters than any language has: beyond U+3400 some share a place
        alphabet, digit = np.unique(np.where(body < 0x3400, body, 0x3400 + (body - 0x3400) % (1 << 14)), return_inverse=True)
    width = _bits(len(alphabet))
    digit = digit.astype(np.int64) + 1
    space = int(np.searchsorted(alphabet, 32)) + 1 if 32 in alphabet else 0
    rows, codes, code = [], [], np.zeros(len(body), np.int64)
    for n in range(1, N_MAX + 1):
        m = len(body) - n + 1
        if m <= 0:
            break
        code = (code[:m] << width) | digit[n - 1 :]
        ok = row[:m] == row[n - 1 :]
        if n == 1:
            ok &= code != space
        rows.append(row[:m][ok])
        codes.append(code[ok])
    rows, codes = np.concatenate(rows), np.concatenate(codes)
    if not len(codes):
        return empty, empty, empty, empty
    if N_MAX * width + _bits(len(off)) <= 63:
        keys = np.sort((rows << (N_MAX * width)) | codes)
        known = None
    else:
        known, place = np.unique(codes, return_inverse=True)
        keys = np.sort((rows << 32) | place)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count, keys = np.diff(np.append(at, len(keys))), keys[at]
    if known is None:
        return keys >> (N_MAX * width), keys & ((1 << (N_MAX * width)) - 1), count, alphabet
    return keys >> 32, known[keys & 0xFFFFFFFF], count, alphabet


def _spell(codes: np.ndarray, alphabet: np.ndarray) -> list[str]:
    """N-grams as text."""
    width = _bits(len(alphabet))
    digits = np.stack([(codes >> (width * k)) & ((1 << width) - 1) for k in reversed(range(N_MAX))], axis=1)
    points = np.where(digits > 0, alphabet[np.maximum(digits, 1) - 1], 0).astype(np.uint32)
    return ["".join(map(chr, filter(None, p))) for p in points.tolist()]


def learn_profiles(train: DataFrame, size: int = PROFILE_SIZE) -> dict[str, list[str]]:
    """N-grams by rank for each non-null ``lang`` of train(text, lang); at most ``size`` of them a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=LEARN_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            row, gram, n, alphabet = _grams(batch.column("text"))
            for lang in sorted(set(langs)):
                mine = langs[row] == lang if len(row) else np.zeros(0, bool)
                grams, at = np.unique(gram[mine], return_inverse=True)
                total = np.bincount(at, weights=n[mine], minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(_spell(grams, alphabet), pa.string()), "n": total})

    rows = train.select("text", "lang").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.char_length("gram"), "gram"))
    profiles: dict[str, list[str]] = {}
    for r in counts.withColumn("rank", top).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Classifier:
    """Compares texts with the profiles; small, so it goes to the tasks as it is."""

    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE_SIZE):
        self.size, self.langs = size, sorted(profiles)
        grams = sorted({g for p in profiles.values() for g in p})
        place = {g: k for k, g in enumerate(grams)}
        self.points = np.array([[0] * (N_MAX - len(g)) + list(map(ord, g)) for g in grams], np.int64).reshape(-1, N_MAX)
        self.ranks = np.full((len(grams) + 1, len(self.langs)), size, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[[place[g] for g in profiles[lang]], k] = np.arange(len(profiles[lang]))

    def _profile_codes(self, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The profiles' n-grams as numbers of this alphabet, sorted, and which of them each is; those with other letters are left out."""
        at = np.minimum(np.searchsorted(alphabet, self.points), len(alphabet) - 1)
        none = self.points == 0
        ok = (none | (alphabet[at] == self.points)).all(axis=1)
        digits = np.where(none, 0, at + 1)[ok]
        codes = np.zeros(len(digits), np.int64)
        for k in range(N_MAX):
            codes = (codes << _bits(len(alphabet))) | digits[:, k]
        order = np.argsort(codes)
        return codes[order], np.flatnonzero(ok)[order]

    def distances(self, texts: pa.Array) -> np.ndarray:
        """Mean out-of-place distance of each text to each language, as a share of the largest (1 where there is none)."""
        n, size = len(texts), self.size
        out = np.ones((n, len(self.langs)))
        row, gram, count, alphabet = _grams(texts)
        if not len(row) or not self.langs:
            return out
        begin = np.searchsorted(row, np.arange(n))
        # The most frequent first, then by n-gram, which is the order in which they stand.
        place, rare = np.arange(len(row)) - begin[row], count.max() - count
        low, mid = _bits(place.max()), _bits(rare.max())
        if _bits(n) + mid + low <= 63:
            key = np.sort((row << (mid + low)) | (rare << low) | place)
            place = key & ((1 << low) - 1)
        else:
            place = place[np.lexsort((place, rare, row))]
        rank = np.arange(len(row)) - begin[row]
        used = rank < size
        row, rank, gram = row[used], rank[used], gram[begin[row[used]] + place[used]]
        codes, which = self._profile_codes(alphabet)
        if not len(codes):
            return out
        at = np.minimum(np.searchsorted(codes, gram), len(codes) - 1)
        far = self.ranks[np.where(codes[at] == gram, which[at], len(self.points))]
        cost = np.where(far == size, size, np.abs(far - rank[:, None].astype(np.int32)))
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        total, held = np.add.reduceat(cost, first, axis=0), np.diff(np.append(first, len(row)))
        out[row[first]] = total / (held[:, None] * size)
        return out

    def predict(self, texts: pa.Array, distances: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the best language's share of all closeness."""
        near = 1 - (self.distances(texts) if distances is None else distances)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = near.argmax(axis=1)
        total = near.sum(axis=1)
        score = np.divide(near[np.arange(len(near)), best], total, out=np.zeros(len(near)), where=total > 0)
        has = _has_letter(texts)
        score[~has] = 0
        return [self.langs[b] if h else UNDETERMINED for b, h in zip(best, has)], score


def train_classifier(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Classifier:
    """Profiles from documents(doc_id, text, lang) whose fold by 4 is not 2, at most about ``max_train_docs`` of them."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2))
    return Classifier(learn_profiles(bounded_sample(rows, "doc_id", max_train_docs)))


def identify_language(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents(doc_id, text, lang); other columns are left out.

    A null text, an empty one or one without letters (Unicode category L) gets ``und`` and score 0; so does every text where no label
    could be learned. A null doc_id is never held out and never learned from; repeated rows are each answered.
    An empty table gives an empty result.
    """
    model = classifier or train_classifier(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=COMPARE_BYTES):
            langs, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.0, classifier: Classifier | None = None, max_distance: float = 1.0, doubtful: float = 1.0, min_lead: float = 0.0) -> DataFrame:
    """The rows of docs, all columns unchanged, whose language is determined with at least ``min_score``.

    A text farther than ``max_distance`` from all profiles goes, and so does one farther than ``doubtful`` whose
    nearest profile is not ``min_lead`` nearer than the second (where there is one). Where no label could be learned
    there is nothing to reject by, and every text with a letter stays.
    """
    model = classifier or train_classifier(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=COMPARE_BYTES):
            texts = batch.column("text")
            if model.langs:
                far = model.distances(texts)
                langs, score = model.predict(texts, far)
                ok = np.array([x != UNDETERMINED for x in langs], bool) & (score >= min_score)
                far = np.sort(far, axis=1)
                ok &= far[:, 0] <= max_distance
                if far.shape[1] > 1:
                    ok &= (far[:, 0] <= doubtful) | (far[:, 1] - far[:, 0] >= min_lead)
            else:
                ok = _has_letter(texts)
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
