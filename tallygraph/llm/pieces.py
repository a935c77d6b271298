"""SentencePiece encoding and decoding with N-best segmentations.

All ways to cut a text into vocabulary pieces form a lattice; a cut's score is the sum of its pieces' scores.
Forward Viterbi gives the best score of every prefix. Those are exact heuristics for an A-star search that walks
the lattice backwards from the end of the text, so complete cuts leave its agenda in order of score.

No piece holds a space mark after another character (checked when the vocabulary is loaded), so a text's lattice is
a chain of small lattices, one for each unit: spaces with the characters up to the next space. Prefix scores add up
along the chain; a unit's two best scores are found for many units at once, and A-star runs in those units alone
whose second best cut is near enough to be part of one of the text's N best.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import text_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
MARK = "▁"
_UNIT = re.compile(f"[{MARK}\n]| *[^ {MARK}\n]+| +")
#: Units of at most so many characters are cut many at once.
_SHORT = 40
#: Distinct units that a task remembers, and those of them with all their cuts.
_CACHE, _LISTS = 150_000, 20_000
_K = np.uint64(0x9E3779B97F4A7C15)
_WORST = -1e18


@dataclass
class Vocabulary:
    """Pieces that can stand in a lattice, with ids and scores; every other character costs ``unknown`` and becomes bytes."""

    ids: dict[str, int]
    scores: list[float]
    surface: list[bytes]
    first_byte: int
    unknown: float
    longest: int

    def __post_init__(self) -> None:
        names = list(self.ids)
        codes = np.array([_hash_text(p) for p in names], np.uint64)
        order = np.argsort(codes)
        self.codes, self.code_ids = codes[order], np.array([self.ids[p] for p in names], np.int32)[order]
        self.code_scores = np.array(self.scores)[self.code_ids]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.codes >> np.uint64(42)] = True


def _hash_text(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_K) + ord(c) + 1) & (2**64 - 1)
    return h


def load_vocabulary(model_path: str = MODEL_PATH) -> Vocabulary:
    """Read on the driver; the tasks get the pieces, not the file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(k) for k in range(n)]
    scores = [sp.get_score(k) for k in range(n)]
    ids = {p: k for k, p in enumerate(names) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))}
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in ids):
        raise ValueError("a piece spans two units")
    surface = [p.replace(MARK, " ").encode() if p in ids else b"" for p in names]
    first_byte = names.index("<0x00>")
    for b in range(256):
        surface[first_byte + b] = bytes([b])
    used = [s for p, s in zip(names, scores) if p in ids and s > -1e8]
    return Vocabulary(ids, scores, surface, first_byte, min(used) - 10.0, max(map(len, ids)))


def _edges(unit: str, v: Vocabulary) -> list[list[tuple[int, int, float]]]:
    """For each end position, the pieces that end there: start, id (0: unknown character), score."""
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
    for s in range(len(unit)):
        for e in range(s + 1, min(len(unit), s + v.longest) + 1):
            k = v.ids.get(unit[s:e])
            if k is not None:
                found[e].append((s, k, v.scores[k]))
            elif e == s + 1:
                found[e].append((s, 0, v.unknown))
    return found


def n_best(unit: str, v: Vocabulary, n: int) -> list[tuple[float, list[int]]]:
    """The n best cuts of a unit (its spaces as marks): score, ids with 0 for an unknown character. """
    edges = _edges(unit, v)
    forward = [0.0] + [_WORST] * len(unit)
    for e in range(1, len(unit) + 1):
        forward[e] = max(forward[s] + w for s, _, w in edges[e])
    # Of equal scores the cut nearest to its end goes on, so ties cost no more than the length of the text.
    agenda: list[tuple] = [(-forward[-1], len(unit), 0, 0.0, None)]
    out: list[tuple[float, list[int]]] = []
    pushed = 0
    while agenda and len(out) < n:
        _, at, _, behind, path = heapq.heappop(agenda)
        if at == 0:
            ids = []
            while path is not None:
                ids.append(path[0])
                path = path[1]
            out.append((behind, ids))
            continue
        for s, k, w in edges[at]:
            pushed += 1
            heapq.heappush(agenda, (-(behind + w + forward[s]), s, pushed, behind + w, (k, path)))
    return out


def _expand(unit: str, ids: list[int], v: Vocabulary) -> list[int]:
    """Unknown characters as the bytes of their UTF-8 form."""
    out, at = [], 0
    for k in ids:
        if k:
            out.append(k)
            at += len(v.surface[k].decode())
        else:
            out += [v.first_byte + b for b in unit[at].encode()]
            at += 1
    return out


def _cut_many(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0: unknown) in a row, how many each unit has, whether all are known, and best and second best score of units
    of one length, by Viterbi over all of them at once."""
    m, n = len(units), len(units[0])
    chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64) + np.uint64(1)
    best, second = np.full((n + 1, m), _WORST), np.full((n + 1, m), _WORST)
    back, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
    best[0] = 0

    def step(s: int, e: int, rows: np.ndarray, w: np.ndarray | float, ids: np.ndarray | int) -> None:
        a, b = best[s, rows] + w, second[s, rows] + w
        old = best[e, rows]
        up = a > old
        second[e, rows] = np.maximum(np.where(up, old, a), np.maximum(second[e, rows], b))
        r = rows[up]
        best[e, r], back[e, r] = a[up], s
        piece[e, r] = ids[up] if isinstance(ids, np.ndarray) else ids

    for s in range(n):
        h = np.zeros(m, np.uint64)
        for e in range(s + 1, min(n, s + v.longest) + 1):
            h = h * _K + chars[e - 1]
            rows = np.flatnonzero(v.maybe[h >> np.uint64(42)])
            at = np.minimum(np.searchsorted(v.codes, h[rows]), len(v.codes) - 1)
            sure = v.codes[at] == h[rows]
            rows, at = rows[sure], at[sure]
            if e == s + 1 and len(rows) < m:
                step(s, e, np.setdiff1d(np.arange(m), rows, assume_unique=True), v.unknown, 0)
            if len(rows):
                step(s, e, rows, v.code_scores[at], v.code_ids[at])
    ends = np.zeros((m, n + 1), bool)
    pos, rows = np.full(m, n), np.arange(m)
    while len(rows):
        ends[rows, pos[rows]] = True
        pos[rows] = back[pos[rows], rows]
        rows = rows[pos[rows] > 0]
    ids = piece.T[ends]
    count = ends.sum(axis=1)
    known = np.ones(m, bool)
    known[np.repeat(np.arange(m), count)[ids == 0]] = False
    return ids, count, known, best[n], second[n]


class Encoder:
    """Encodes texts; remembers units within one task."""

    def __init__(self, v: Vocabulary, n: int = N_BEST):
        self.v, self.n = v, n
        self.alike: list[bool] = []
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.lists: dict[int, list[tuple[float, np.ndarray, bool]]] = {}

    def _learn(self, new: list[str]) -> None:
        """Remember these units: their ids, best score and the loss of the second best cut."""
        v = self.v
        flat, count, best, gap = [self.flat], [self.count], [self.best], [self.gap]

        def add(units: list[str], ids: np.ndarray, n: np.ndarray, top: np.ndarray, loss: np.ndarray) -> None:
            self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
            for held, part in ((flat, ids), (count, n), (best, top), (gap, loss)):
                held.append(part)

        def add_one(unit: str, ids: list[int], top: float, loss: float) -> None:
            add([unit], np.array(ids, np.int32), np.array([len(ids)]), np.array([top]), np.array([loss]))

        groups: dict[int, list[str]] = {}
        for u in new:
            if u == MARK:
                add_one(u, [v.first_byte + b for b in u.encode()], v.unknown, np.inf)
            elif len(u) > _SHORT:
                marked = u.replace(" ", MARK)
                cuts = n_best(marked, v, 2)
                add_one(u, _expand(marked, cuts[0][1], v), cuts[0][0], cuts[0][0] - cuts[1][0] if len(cuts) > 1 else np.inf)
            else:
                groups.setdefault(len(u), []).append(u)
        for units in groups.values():
            marked = [u.replace(" ", MARK) for u in units]
            ids, n, known, top, second = _cut_many(marked, v)
            loss = np.where(second > _WORST / 2, top - second, np.inf)
            if not known.all():
                begin = np.cumsum(n) - n
                for k in np.flatnonzero(~known).tolist():
                    add_one(units[k], _expand(marked[k], ids[begin[k] : begin[k] + n[k]].tolist(), v), float(top[k]), float(loss[k]))
                ids, units = ids[np.repeat(known, n)], [u for u, ok in zip(units, known.tolist()) if ok]
                n, top, loss = n[known], top[known], loss[known]
            add(units, ids, n, top, loss)
        self.flat, self.count, self.best, self.gap = (np.concatenate(x) for x in (flat, count, best, gap))

    def _unit_cuts(self, unit: str, u: int, own: np.ndarray) -> list[tuple[float, np.ndarray, bool]]:
        """Loss and ids of a unit's N best cuts, and whether each decodes to the bytes of the first, which is ``own``, the one
        that is remembered."""
        if u not in self.lists:
            marked = unit.replace(" ", MARK)
            cuts = n_best(marked, self.v, self.n)
            found = [(cuts[0][0] - score, np.array(_expand(marked, ids, self.v), np.int32)) for score, ids in cuts]
            # Of cuts with equal scores the remembered one may come later, or not among N.
            same = [np.array_equal(ids, own) for _, ids in found]
            found.pop(same.index(True) if any(same) else -1)
            same_bytes = _bytes(own, self.v)
            self.lists[u] = [(0.0, own, True), *((loss, ids, _bytes(ids, self.v) == same_bytes) for loss, ids in found)]
        return self.lists[u]

    def _texts_best(self, units: list[str], order: np.ndarray, total: float, ids: np.ndarray) -> tuple[list[float], list[np.ndarray], bool]:
        """The N best scores of a text made of these units, the ids of all its N best cuts but the first, and whether all of them
        decode to what the first does."""
        gaps = self.gap[order]
        near = np.flatnonzero(np.isfinite(gaps))
        if len(near) > self.n - 1:
            near = near[np.argpartition(gaps[near], self.n - 2)[: self.n - 1]] if self.n > 1 else near[:0]
        end = np.cumsum(self.count[order])
        begin = end - self.count[order]
        cuts: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        lists = {}
        for k in sorted(near.tolist()):
            lists[k] = self._unit_cuts(units[k], int(order[k]), ids[begin[k] : end[k]])
            cuts = sorted(((a + loss, (*picks, (k, j)) if j else picks) for a, picks in cuts for j, (loss, *_) in enumerate(lists[k])), key=lambda c: c[0])[: self.n]
        # Of equal losses the sort leaves the remembered cut of every unit in front.
        others = []
        for _, picks in cuts[1:]:
            parts, at = [], 0
            for k, j in picks:
                parts += [ids[at : begin[k]], lists[k][j][1]]
                at = end[k]
            others.append(np.concatenate([*parts, ids[at:]]))
        return [total - loss for loss, _ in cuts], others, all(lists[k][j][2] for _, picks in cuts for k, j in picks)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[np.ndarray]]]:
        """Ids of all texts' best cuts in a row, each text's offsets, its N best scores, and the ids of its other cuts; ``alike``
        then tells of each text whether those decode to what the best does."""
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.at) > _CACHE:
            self._clear()
        if len(self.lists) > _LISTS:
            self.lists.clear()
        new = list(dict.fromkeys(u for units in split for u in units if u not in self.at))
        if new:
            self._learn(new)
        flat, count, best = self.flat, self.count, self.best
        start = np.cumsum(count) - count
        at = self.at
        orders = [np.array([at[u] for u in units], np.int64) for units in split]
        every = np.concatenate(orders) if orders else np.zeros(0, np.int64)
        c = count[every]
        ids = flat[np.repeat(start[every] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))] if len(every) else np.zeros(0, np.int32)
        off = np.concatenate(([0], np.cumsum([int(count[o].sum()) for o in orders]))).astype(np.int64)
        found = [self._texts_best(u, o, float(best[o].sum()), ids[off[k] : off[k + 1]]) if len(o) else ([0.0], [], True) for k, (u, o) in enumerate(zip(split, orders))]
        self.alike = [same for _, _, same in found]
        return ids, off, [scores for scores, _, _ in found], [others for _, others, _ in found]


def _bytes(ids: np.ndarray, v: Vocabulary) -> bytes:
    return b"".join(map(v.surface.__getitem__, ids.tolist()))


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of ids; undoes encode exactly."""
    return b"".join(map(v.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _all_decode(cuts: list[np.ndarray], text: str, v: Vocabulary) -> bool:
    """Whether every cut gives the text back."""
    return all(decode(ids.tolist(), v) == text for ids in cuts)


def _id_lists(cuts: list[list[np.ndarray]]) -> pa.Array:
    """Lists of id lists, one for each text."""
    flat = [ids for text in cuts for ids in text]
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cuts)]), pa.int32()), inner)


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, n: int = N_BEST, decoded: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens, nbest_scores, nbest_ids for each row of documents(doc_id, text); with ``decoded`` also that
    column, as decode_documents gives it, in the same pass.

    ids are those of the best cut; nbest_scores and nbest_ids hold the scores and ids of the ``n`` best cuts, best
    first (fewer where the lattice has fewer paths). A null or empty text has no ids and the one score 0. Characters
    outside the vocabulary, line ends and literal space marks become byte pieces, so decoding gives every text back.
    Repeated rows are each answered; other columns are left out; an empty table gives an empty result.
    """
    v = load_vocabulary(model_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(v, n)
        for batch in text_slices(batches):
            ids, off, scores, others = coder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            every = _id_lists([[ids[off[k] : off[k + 1]], *o] for k, o in enumerate(others)])
            cols, names = [batch.column("doc_id"), lists, pa.array(np.diff(off)), pa.array(scores, pa.list_(pa.float64())), every], ["doc_id", "ids", "n_tokens", "nbest_scores", "nbest_ids"]
            if decoded:
                cols.append(pa.array([decode(ids[a:b].tolist(), v) for a, b in zip(off[:-1], off[1:])], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, ids array<int>, n_tokens long, nbest_scores array<double>, nbest_ids array<array<int>>" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """The rows of encoded with one more column, ``decoded``: the text of the id list in column ``ids``.

    A null list gives null, an empty one an empty text (encode_documents has both null and empty texts so).
    """
    v = load_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else decode(x, v) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def encode_and_verify(docs: DataFrame, model_path: str = MODEL_PATH, n: int = N_BEST) -> DataFrame:
    """As encode_documents, with SHA-256 of the ids (as little-endian 32-bit numbers) of the best and of each of the
    ``n`` best cuts in place of the ids, and whether decoding every one of these cuts gave the text back."""
    v = load_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(v, n)
        for batch in text_slices(batches, limit=1 << 21):
            texts = batch.column("text").to_pylist()
            ids, off, scores, others = coder.encode(texts)
            sha, same = [], []
            for k, t in enumerate(texts):
                cuts = [ids[off[k] : off[k + 1]], *others[k]]
                sha.append([hashlib.sha256(c.astype("<i4", copy=False).tobytes()).hexdigest() for c in cuts])
                # A cut differs from the best one in a few units; where these give the same bytes, so does the cut.
                same.append(coder.alike[k] and _all_decode(cuts[:1], t or "", v))
            best = pa.array([x[0] for x in sha], pa.string())
            cols = [batch.column("doc_id"), pa.array(np.diff(off)), best, pa.array(scores, pa.list_(pa.float64())), pa.array(sha, pa.list_(pa.string())), pa.array(same)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "nbest_scores", "nbest_sha256", "round_trip"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, nbest_scores array<double>, nbest_sha256 array<string>, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
