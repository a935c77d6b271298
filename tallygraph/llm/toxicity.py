"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over words and word stems that the labels show to matter (chi-square). The labelled examples are kept in
an inverted index whose postings lie in blocks of examples, with the largest weight of each term in each block. A
block's bound is the sum of its terms' largest weights; blocks are scored in order of their bounds until the k-th
best cosine found is above all that is left, so the k nearest are exact. Their votes, weighted by cosine and by how
the classes were sampled, with the base rate as a small extra vote, give the score; the nearest are its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_view, fold, materialize, text_slices, word_hashes, word_spans
from .labelled import labelled_ids, labelled_texts, to_driver

#: Bound on the labelled documents that terms are chosen from, and on the examples in the index.
MAX_TERM_DOCS = 20_000
MAX_EXAMPLES = 4_000
#: A term is used if its chi-square with the label is at least this, and at most so many of the strongest are.
MIN_CHI_SQUARE = 8.0
MAX_TERMS = 4_096
#: Besides whole words, their first so many bytes are terms.
STEMS = (3, 4, 5, 6, 7, 8)
NEIGHBOURS = 15
BLOCK = 64
THRESHOLD = 0.5
#: Weight of the base rate among the votes.
PRIOR_VOTE = 0.4
#: A chosen term's toxic texts are at least so many for each other text. This and the numbers around it were compared by
#: leaving out one of the four learned folds at a time (see README); the held-out fold took no part in that.
LEAST_ODDS = 2.0
#: Weight of a constant term that every text has: a few weak terms then don't fill a text's vector, and a text
#: without any chosen term has neighbours too.
CONSTANT = 3.0
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and hash of each word of texts (letters and digits, ASCII letters lower-cased) and of its beginnings, as word stems."""
    data, off = byte_view(texts)
    data = LOWER[data]
    starts, ends, row = word_spans(data, off, _WORD)
    rows, hashes = [row], [word_hashes(data, starts, ends)]
    for k in STEMS:
        longer = ends - starts > k
        rows.append(row[longer])
        hashes.append(word_hashes(data, starts[longer], starts[longer] + k) ^ np.uint64(k))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64), len(off) - 1


def _pairs(row: np.ndarray, col: np.ndarray, n_cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, col) with counts, by row and col."""
    key, count = np.unique(row * np.int64(n_cols) + col, return_counts=True)
    return key // n_cols, key % n_cols, count


def choose_terms(sample: DataFrame, least: float = MIN_CHI_SQUARE, most: int = MAX_TERMS) -> list[tuple[int, float]]:
    """(hash, idf) of the terms whose presence goes with the label in sample(text, y, rate)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 22):
            y = np.array(batch.column("y").to_pylist())
            row, h, _ = _terms(batch.column("text"))
            terms, code = np.unique(h, return_inverse=True)
            if not len(terms):
                continue
            r, c, _ = _pairs(row, code, len(terms))
            n = [np.bincount(c[y[r] == k], minlength=len(terms)) for k in (0, 1)]
            yield pa.RecordBatch.from_pydict({"term": terms, "n0": n[0].astype(np.int64), "n1": n[1].astype(np.int64)})

    sizes = {r["y"]: (r["n"], r["rate"]) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.avg("rate").alias("rate")).collect()}
    (m0, rate0), (m1, rate1) = sizes.get(0, (0, 1.0)), sizes.get(1, (0, 1.0))
    if not (m0 and m1):
        return []
    terms = sample.select("text", "y").mapInArrow(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    n, df = float(m0 + m1), a + b
    chi = n * F.pow(a * (m0 - b) - b * (m1 - a), 2) / (float(m0) * float(m1) * df * F.greatest(n - df, F.lit(1.0)))
    # Only terms that speak for the label: their absence, not other words, speaks against it.
    top = terms.filter((a + b >= 5) & (a / rate1 > F.lit(LEAST_ODDS) * b / rate0)).select("term", "n0", "n1", chi.alias("chi")).filter(F.col("chi") >= least)
    return [(r["term"], float(np.log(n / (1 + r["n0"] + r["n1"]))) + 1) for r in top.orderBy(F.desc("chi"), "term").limit(most).collect()]


class ExampleIndex:
    """Block-max inverted index of the labelled examples."""

    def __init__(self, terms: list[tuple[int, float]], doc_ids: np.ndarray, texts: pa.Array, y: np.ndarray, rate: np.ndarray):
        terms = sorted(terms)
        self.n_terms = len(terms) + 1  # the last is the constant
        self.hashes = np.array([t for t, _ in terms], np.int64)
        self.idf = np.array([w for _, w in terms])
        weight = 1 / rate if len(rate) else rate
        self.base = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
        row, term, value = self.vectors(texts)
        # Examples with alike terms stand together, which keeps the blocks' bounds tight.
        lead, strongest = np.full(len(y), len(terms)), np.zeros(len(y))
        chosen = term < len(terms)
        np.maximum.at(strongest, row[chosen], value[chosen])
        leads = chosen & (value >= strongest[row])
        lead[row[leads]] = term[leads]
        order = np.lexsort((doc_ids, strongest, lead))
        place = np.empty(len(y), np.int64)
        place[order] = np.arange(len(y))
        self.doc_ids, self.y, self.weight = doc_ids[order], y[order], weight[order]
        self.blocks = -(-len(y) // BLOCK)
        at = place[row]
        o = np.lexsort((at, at // BLOCK, term))
        self.p_doc, self.p_value, term = at[o], value[o], term[o]
        cell = term * max(1, self.blocks) + self.p_doc // BLOCK
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, int)
        self.cell_begin = np.append(begin, len(cell))
        self.cell_block = cell[begin] % max(1, self.blocks)
        self.cell_top = np.maximum.reduceat(self.p_value, begin) if len(begin) else np.zeros(0)
        self.term_cells = np.searchsorted(cell[begin] // max(1, self.blocks), np.arange(self.n_terms + 1))

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors over the chosen terms and the constant: row, term, weight, by row and term."""
        row, h, n = _terms(texts)
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        row, term, tf = _pairs(np.concatenate((row[hit], np.arange(n))), np.concatenate((at[hit], np.full(n, self.n_terms - 1))), self.n_terms)
        value = np.where(term < self.n_terms - 1, (1 + np.log(tf)) * np.append(self.idf, 0)[term], CONSTANT)
        return row, term, value / np.sqrt(np.bincount(row, weights=value**2, minlength=n))[row]

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, exact; ties go by place."""
        cells = np.concatenate([np.arange(self.term_cells[t], self.term_cells[t + 1]) for t in terms])
        query = np.repeat(values, self.term_cells[terms + 1] - self.term_cells[terms])
        bound = np.bincount(self.cell_block[cells], weights=query * self.cell_top[cells], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(order), 4):
            if len(best) == k and bound[order[b]] < best[-1]:
                break
            some = np.isin(self.cell_block[cells], order[b : b + 4])
            c, q = cells[some], query[some]
            size = self.cell_begin[c + 1] - self.cell_begin[c]
            p = np.repeat(self.cell_begin[c] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            docs, where = np.unique(self.p_doc[p], return_inverse=True)
            cos = np.bincount(where, weights=np.repeat(q, size) * self.p_value[p])
            best_at, best = np.concatenate((best_at, docs)), np.concatenate((best, cos))
            top = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def score(self, texts: pa.Array, k: int = NEIGHBOURS) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        n = len(texts)
        out, ids, cosines = np.full(n, self.base), [[] for _ in range(n)], [[] for _ in range(n)]
        row, term, value = self.vectors(texts)
        begin = np.searchsorted(row, np.arange(n + 1))
        seen: dict[bytes, tuple] = {}
        for r in range(n if self.blocks else 0):
            t, v = term[begin[r] : begin[r + 1]], value[begin[r] : begin[r + 1]]
            key = t.tobytes() + v.tobytes()
            if key not in seen:
                at, cos = self.nearest(t, v, k)
                vote = cos * self.weight[at] / self.weight.mean()
                seen[key] = ((vote @ self.y[at] + PRIOR_VOTE * self.base) / (vote.sum() + PRIOR_VOTE), self.doc_ids[at][:3].tolist(), cos[:3].tolist())
            out[r], ids[r], cosines[r] = seen[key]
        return out, ids, cosines


def build_index(docs: DataFrame, labels: DataFrame, max_term_docs: int = MAX_TERM_DOCS, max_examples: int = MAX_EXAMPLES) -> ExampleIndex:
    """Learned from at most about ``max_term_docs`` labelled texts whose fold by 5 is not 0, ``max_examples`` of them as examples."""
    ids = materialize(labelled_ids(labels, "toxic", 5, 0, max_term_docs), "toxic-ids")
    sample = materialize(labelled_texts(docs, ids), "toxic-sample")
    terms = choose_terms(sample)
    share = min(1.0, max_examples / max(1, sample.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_003)) < F.lit(int(1_000_003 * share) + 1)
    held = to_driver(sample.filter(chosen))
    return ExampleIndex(terms, held["doc_id"].to_numpy(np.int64), pa.array(held["text"], pa.string()), held["y"].to_numpy(float), held["rate"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, index: ExampleIndex | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, evidence_cosine for each row of documents(doc_id, text).

    A text without any chosen term (a null or empty one too) has the examples without any as neighbours. Without labels every score is 0.
    evidence holds the doc_ids of up to three nearest examples. A null doc_id is never held out. Repeated rows are
    each answered; other columns are left out; an empty table gives an empty result.
    """
    model = index or build_index(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            s, ids, cos = model.score(batch.column("text"))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(ids, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence", "evidence_cosine"])

    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, evidence_cosine array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(score, schema)
