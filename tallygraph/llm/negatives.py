"""Hard-negative mining with a vantage-point tree over norm-augmented vectors.

With every indexed vector x extended by sqrt(M - |x|^2), M the greatest squared norm, and a query q by 0, the squared
distance of the two is |q|^2 + M - 2 * <q, x>: a window of scores is an annulus around the query, and the highest score
in it is the nearest row beyond its inner edge.

* The upper tree is fitted on a bounded sample (``SAMPLE`` rows, ``DEPTH`` levels); every row is routed to one of its
  2^DEPTH cells, and each cell knows the least and greatest distance of its own rows to the vantage points above it.
* A cell is dealt in chunks of about ``CHUNK`` rows. The task of a chunk continues the tree down to blocks of ``BLOCK``
  rows, then streams the queries that ask for it.
* A query visits the nearest cell of its annulus first. Its k-th best score shrinks the annulus, and only cells
  that still meet it follow; within a chunk blocks are visited nearest first in the same way.

Bounds come from the triangle inequality with a small slack, scores are compared as they are: results are exact as long
as scores are whole numbers below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialize

DEPTH = 6
SAMPLE = 4096
CHUNK = 1 << 15
BLOCK = 256
#: Above so many queries a chunk is read by several tasks, each with its share of them.
QUERIES_A_TASK = 1 << 16
_SLACK = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, x of those rows(vec_id, label, x) that have all three and only finite components; of rows that repeat
    a vec_id the one with the least label, then vector."""
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = rows.filter(fine & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<double>").alias("x"))
    again = kept.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.limit(1).count():
        return kept
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def _matrix(xs: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in zeros."""
    xs = xs.combine_chunks() if isinstance(xs, pa.ChunkedArray) else xs
    off = xs.offsets.to_numpy()
    lens = np.diff(off)
    out = np.zeros((len(xs), dim))
    out[np.repeat(np.arange(len(xs)), lens), np.arange(int(lens.sum())) - np.repeat(off[:-1] - off[0], lens)] = xs.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return out


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """Of a few points the one whose distances to the others spread most, their median, and the distances."""
    tries = points[rng.choice(len(points), min(8, len(points)), replace=False)]
    d = _distances(points, tries)
    best = int(d.std(axis=0).argmax())
    return tries[best], float(np.median(d[:, best])), d[:, best]


class Upper:
    """The fitted levels: node k has the nodes 2k + 1 (near) and 2k + 2 (far) below it."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, n = depth, (1 << depth) - 1
        self.points, self.radius = np.zeros((n, sample.shape[1])), np.full(n, np.inf)
        held = {0: sample}
        for k in range(n):
            mine = held.pop(k, sample[:0])
            if not len(mine):
                continue
            self.points[k], self.radius[k], d = _vantage(mine, rng)
            held[2 * k + 1], held[2 * k + 2] = mine[d <= self.radius[k]], mine[d > self.radius[k]]

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distances to the vantage points on the way."""
        node, way = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            way[:, level] = np.sqrt(((x - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (way[:, level] > self.radius[node])
        return node - len(self.radius), way


class Cells:
    """Annuli of cells or blocks: for each the vantage points above it and its rows' least and greatest distance to them."""

    def __init__(self, points: np.ndarray, above: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.points, self.above, self.least, self.most = points, above, least, most

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest possible distance of each query to each cell's rows."""
        if not self.above.shape[1]:
            return np.zeros((len(q), len(self.above))), np.full((len(q), len(self.above)), np.inf)
        d = _distances(q, self.points)
        low, high = np.zeros((len(q), len(self.above))), np.full((len(q), len(self.above)), np.inf)
        for level in range(self.above.shape[1]):
            to = d[:, self.above[:, level]]
            low = np.maximum(low, np.maximum(self.least[:, level] - to, to - self.most[:, level]))
            high = np.minimum(high, to + self.most[:, level])
        return low, high


def _blocks(x: np.ndarray, seed: int = 13) -> tuple[list[np.ndarray], Cells]:
    """Row numbers of each block, in the lower tree over augmented rows x, and the blocks' annuli."""
    rng = np.random.default_rng(seed)
    points: list[np.ndarray] = []
    done: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []
    todo: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]] = [(np.arange(len(x)), [])]
    while todo:
        rows, way = todo.pop()
        if len(rows) > BLOCK:
            v, radius, d = _vantage(x[rows], rng)
            points.append(v)
            near = d <= radius
            if near.all():  # equal distances: cut in halves
                near = np.arange(len(rows)) < len(rows) // 2
            for side in (near, ~near):
                todo.append((rows[side], [(k, e[side]) for k, e in way] + [(len(points) - 1, d[side])]))
        else:
            done.append((np.sort(rows), [(k, float(e.min()), float(e.max())) for k, e in way]))
    deep = max((len(w) for _, w in done), default=0)
    filled = [w + [w[-1] if w else (0, 0.0, np.inf)] * (deep - len(w)) for _, w in done]
    part = lambda i: np.array([[e[i] for e in w] for w in filled]).reshape(len(done), deep)
    return [r for r, _ in done], Cells(np.array(points).reshape(len(points), x.shape[1]), part(0).astype(np.int64), part(1), part(2))


class Chunk:
    """The rows of one chunk, searched nearest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x, self.top = ids[order], labels[order], x[order], top
        self.blocks, self.cells = _blocks(augmented(self.x, top))

    def search(self, anchor: np.ndarray, label: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each query its k best rows (ids and scores; -inf where there are no more): those of the same or of another label
        with a score from ``low`` to ``high`` and not below ``floor``, highest first, then by id."""
        ids, best = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
        near, far = self.cells.bounds(np.hstack([q, np.zeros((len(q), 1))]))
        square = (q * q).sum(axis=1) + self.top
        slack = _SLACK * (np.sqrt(square) + 1)
        inner, outer = _radius(square, high) - slack, _radius(square, low) + slack
        order = np.argsort(near, axis=1, kind="stable")
        for turn in range(len(self.blocks)):
            block = order[:, turn]
            at = np.arange(len(q)), block
            limit = np.minimum(outer, _radius(square, np.maximum(floor, best[:, -1])) + slack)
            meets = (near[at] <= limit) & (far[at] >= inner)
            if not ((near[at] <= limit).any()):
                break
            for b in np.unique(block[meets]).tolist():
                who = np.flatnonzero(meets & (block == b))
                rows = self.blocks[b]
                s = q[who] @ self.x[rows].T
                fits = (self.labels[rows][None, :] == label[who][:, None]) == same
                s[~(fits & (s >= low[who][:, None]) & (s <= high[who][:, None]) & (self.ids[rows][None, :] != anchor[who][:, None]))] = -np.inf
                more_ids, more = [ids[who]], [best[who]]
                line = np.arange(len(who))
                for _ in range(min(k, len(rows))):  # rows are in order of id, so the first of equals is the one
                    c = s.argmax(axis=1)
                    more.append(s[line, c][:, None])
                    more_ids.append(self.ids[rows][c][:, None])
                    s[line, c] = -np.inf
                both, named = np.hstack(more), np.hstack(more_ids)
                first = np.lexsort((named, -both), axis=1)[:, :k]
                best[who], ids[who] = np.take_along_axis(both, first, 1), np.take_along_axis(named, first, 1)
        return ids, best


def _radius(square: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, square - 2 * score))


class Index:
    """Rows routed to cells in the shared folder, with what a task needs to know of the cells: 2^DEPTH of them at most."""

    def __init__(self, rows: DataFrame, depth: int = DEPTH, sample: int = SAMPLE, chunk: int = CHUNK):
        norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
        one = rows.agg(F.max(norm).alias("top"), F.max(F.size("x")).alias("dim")).first()
        self.top, self.dim, self.empty = one["top"] or 0.0, one["dim"] or 0, one["dim"] is None
        self.depth = depth
        top, dim = self.top, self.dim
        some = bounded_sample(rows, "vec_id", sample).select("vec_id", "x").toPandas().sort_values("vec_id")
        tree = self.tree = Upper(augmented(_matrix(pa.array(list(some["x"]), pa.list_(pa.float64())), dim), top) if len(some) else np.zeros((0, dim + 1)), depth)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, way = tree.route(augmented(_matrix(batch.column("x"), dim), top))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1) * way.shape[1], pa.int32()), pa.array(way.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), pa.array(cell.astype(np.int32)), lists], ["vec_id", "label", "x", "cell", "way"])

        self.rows = materialize(rows.mapInArrow(route, "vec_id long, label long, x array<double>, cell int, way array<double>"), "vp-rows")
        level = lambda f: F.array(*[f(F.col("way")[i]) for i in range(depth)])
        found = self.rows.groupBy("cell").agg(F.count("*").alias("n"), level(F.min).alias("least"), level(F.max).alias("most")).toPandas()
        self.chunks = np.zeros(1 << depth, np.int64)
        least, most = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
        for r in found.itertuples():
            self.chunks[r.cell], least[r.cell], most[r.cell] = -(-r.n // chunk), r.least, r.most
        nodes = np.arange(1 << depth) + (1 << depth) - 1
        above = np.zeros((1 << depth, depth), np.int64)
        for i in range(depth - 1, -1, -1):
            nodes = (nodes - 1) // 2
            above[:, i] = nodes
        self.cells = Cells(tree.points, above, least, most)

    def visits(self, queries: DataFrame, parts: int, first: bool) -> DataFrame:
        """One row for each chunk that a query asks for: of the nearest cell that meets its annulus, or of all other cells
        that still do with the floor known then."""
        cells, chunks, top, dim = self.cells, self.chunks, self.top, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 1024):
                    batch = whole.slice(i, 1024)
                    q = _matrix(batch.column("x"), dim)
                    low, high, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "floor"))
                    near, far = cells.bounds(np.hstack([q, np.zeros((len(q), 1))]))
                    square = (q * q).sum(axis=1) + top
                    slack = _SLACK * (np.sqrt(square) + 1)
                    there = (chunks > 0)[None, :] & (far >= (_radius(square, high) - slack)[:, None])
                    open_ = there & (near <= (_radius(square, low) + slack)[:, None])
                    home = np.where(open_, near, np.inf).argmin(axis=1)
                    at_home = np.zeros(near.shape, bool)
                    at_home[np.arange(len(q)), home] = True
                    wanted = open_ & at_home if first else open_ & ~at_home & (near <= (_radius(square, np.maximum(floor, low)) + slack)[:, None])
                    who, cell = np.nonzero(wanted)
                    n = chunks[cell]
                    who, cell, number = np.repeat(who, n), np.repeat(cell, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    out = batch.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(number.astype(np.int32)), *out.columns], ["cell", "chunk", *batch.schema.names])

        return queries.mapInArrow(run, "cell int, chunk int, vec_id long, place int, label long, x array<double>, low double, high double, floor double").withColumn("part", F.pmod(F.xxhash64("vec_id", "place"), F.lit(parts)).cast("int"))

    def _ask(self, queries: DataFrame, parts: int, k: int, same: bool, first: bool) -> DataFrame:
        """anchor_id, place, vec_id, score: for each query the best k of each chunk that it visits."""
        nothing = F.lit(None).cast("double")
        n = F.element_at(F.array(*[F.lit(int(c)) for c in self.chunks]), F.col("cell") + 1)
        rows = self.rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), n).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = rows.select("cell", "chunk", "part", F.lit(0).alias("kind"), "vec_id", F.lit(0).alias("place"), "label", "x", *[nothing.alias(c) for c in ("low", "high", "floor")])
        asked = self.visits(queries, parts, first).withColumn("kind", F.lit(1)).select(*rows.columns)
        top, dim = self.top, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, chunk = None, [], None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "chunk", "part", "kind")], axis=1)
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                    if b == e:
                        continue
                    mine = tuple(keys[b, :3].tolist())
                    if mine != key:
                        key, held, chunk = mine, [], None
                    part = batch.slice(b, e - b)
                    ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                    if keys[b, 3] == 0:
                        held.append((ids, labels, _matrix(part.column("x"), dim)))
                        continue
                    if chunk is None and held:
                        chunk, held = Chunk(*(np.concatenate(c) for c in zip(*held)), top), []
                    for i in range(0, len(ids) if chunk else 0, 1024):
                        at = slice(i, i + 1024)
                        low, high, floor = (part.column(c).to_numpy(zero_copy_only=False)[at] for c in ("low", "high", "floor"))
                        found, scores = chunk.search(ids[at], labels[at], _matrix(part.column("x").slice(i, 1024), dim), low, high, floor, k, same)
                        who, col = np.nonzero(scores > -np.inf)
                        place = part.column("place").to_numpy()[at]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at][who]), pa.array(place[who]), pa.array(found[who, col]), pa.array(scores[who, col])], ["anchor_id", "place", "vec_id", "score"])

        dealt = rows.unionByName(asked).repartition("cell", "chunk", "part").sortWithinPartitions("cell", "chunk", "part", "kind")
        return dealt.mapInArrow(run, "anchor_id long, place int, vec_id long, score double")

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_id, place, rank (from 1), vec_id, score: for each of queries(vec_id, place, label, x, low, high) the k rows of
        highest score, then least vec_id, with a score from low to high and the query's label, or another one."""
        if self.empty:
            return queries.sparkSession.createDataFrame([], "anchor_id long, place int, rank int, vec_id long, score double")
        queries = materialize(queries.select("vec_id", F.col("place").cast("int").alias("place"), "label", "x", "low", "high", F.lit(float("-inf")).alias("floor")), "vp-queries")
        parts = max(1, -(-queries.count() // QUERIES_A_TASK))
        rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
        near = materialize(self._ask(queries, parts, k, same, True).withColumn("rank", rank).filter(F.col("rank") <= k), "vp-near")
        kth = near.filter(F.col("rank") == k).select(F.col("anchor_id").alias("vec_id"), "place", F.col("score").alias("kth"))
        queries = queries.join(kth, ["vec_id", "place"], "left").withColumn("floor", F.coalesce("kth", "floor")).select(*queries.columns)
        rest = self._ask(queries, parts, k, same, False)
        both = near.drop("rank").unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k)
        return both.select("anchor_id", "place", "rank", "vec_id", "score")


def mine_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **shape: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows(vec_id, label, x).

    Anchors are the rows whose vec_id is divisible by ``every``. Scores are inner products; higher ones come first, equal
    ones by vec_id. An anchor's positives are its first rows of the same label, itself left out. For each of them, the
    first rows of another label whose score is from ``low`` to ``high`` per cent of the positive's are its negatives, ranked from 1. A
    negative positive score has no such rows. Rows without id, label or vector, or with a component that is null or not
    finite, take no part; of rows that repeat a vec_id one does (see usable). Shorter vectors end in zeros. Other columns
    are left out; an empty table gives an empty result.
    """
    rows = materialize(usable(rows.select("vec_id", "label", "x")), "vectors")
    index = Index(rows, **shape)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    free = anchors.withColumns({"place": F.lit(0), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    best = materialize(index.best(free, positives, True), "positives").select(F.col("anchor_id").alias("vec_id"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = anchors.join(best.filter("positive_score >= 0"), "vec_id").withColumns({"low": low * F.col("positive_score") / 100, "high": high * F.col("positive_score") / 100})
    found = index.best(windows, negatives, False).select(F.col("anchor_id").alias("vec_id"), "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = best.join(found, ["vec_id", "place"])
    return pairs.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
