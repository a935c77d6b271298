"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded (a small learned vector a byte, and one channel that says whether the last eight bytes also
occur up to 24 bytes earlier). Filters of 16 bytes go over the whole text in steps of 8, so chunks overlap and none
is left out. Each filter's largest response anywhere in the text is kept, and a logistic layer combines those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, fold, text_slices
from .labelled import labelled_ids, labelled_texts, to_driver

#: Bound on the labelled documents that the network is fitted on.
MAX_TRAIN_DOCS = 3_000
THRESHOLD = 0.7
STEP, CHANNELS, FILTERS = 8, 8, 24
_PAD = 256


#: Bytes and blocks of long texts are worked on in pieces of so many, which bounds what one text takes.
PIECE = 1 << 18


def _repeats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 where the eight bytes that end here also end up to 24 bytes earlier in the same text. at: each byte's place in it."""
    out = np.zeros(len(data), np.float32)
    for i in range(0, len(data), PIECE):
        lo = max(0, i - 40)  # a piece begins with what its first bytes may repeat
        out[i : i + PIECE] = _repeats_of(data[lo : i + PIECE], at[lo : i + PIECE])[i - lo :]
    return out


def _repeats_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data), np.float32)
    if len(data) < 12:
        return out
    code = data[:-7].astype(np.uint64)
    for k in range(1, 8):
        code = (code << np.uint64(8)) | data[k : len(data) - 7 + k]
    hit = np.zeros(len(code), bool)
    start = at[7:] - 7  # where the eight bytes begin in their text; neither they nor what they repeat begin before it
    for lag in range(2, min(25, len(code))):
        hit[lag:] |= (code[lag:] == code[:-lag]) & (start[lag:] >= lag)
    out[7:] = hit
    return out


def _blocks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in blocks of STEP (padded at a text's end, one block at least), repeats alike, and each text's first block."""
    lens = np.diff(off)
    count = np.maximum(1, -(-lens // STEP))
    first = np.cumsum(count) - count
    within = np.arange(len(data)) - np.repeat(off[:-1], lens)
    at = within + np.repeat(first * STEP, lens)
    codes = np.full(int(count.sum()) * STEP, _PAD, np.int16)
    codes[at] = data
    again = np.zeros(len(codes), np.float32)
    again[at] = _repeats(data, within)
    return codes.reshape(-1, STEP), again.reshape(-1, STEP), first


class ByteConvNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (257, CHANNELS - 1)).astype(np.float32)
        self.emb[_PAD] = 0
        self.conv = rng.normal(0, 1 / np.sqrt(STEP * CHANNELS), (2, STEP * CHANNELS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def _inputs(self, codes: np.ndarray, again: np.ndarray) -> np.ndarray:
        x = np.empty((len(codes), STEP, CHANNELS), np.float32)
        x[..., :-1] = self.emb[codes]
        x[..., -1] = again
        return x.reshape(len(codes), -1)

    def _pooled(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all chunks and each text's largest ones."""
        both = x @ np.concatenate(self.conv, axis=1)
        resp = both[:, :FILTERS]
        resp[:-1] += both[1:, FILTERS:]
        ends = np.append(first[1:], len(x)) - 1
        ends = ends[:-1]  # the last chunk of a text has no second half
        resp[ends] -= both[ends + 1, FILTERS:]
        return resp, np.maximum.reduceat(resp, first, axis=0)

    def _top(self, codes: np.ndarray, again: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's largest response to each filter, as _pooled has it, over a running maximum of pieces."""
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
        top, weights = np.full((len(first), FILTERS), -np.inf, np.float32), np.concatenate(self.conv, axis=1)
        for i in range(0, len(codes), PIECE // STEP):
            j = min(len(codes), i + PIECE // STEP)
            k = min(len(codes), j + 1)
            both = self._inputs(codes[i:k], again[i:k]) @ weights
            resp = both[: j - i, :FILTERS]
            goes_on = np.flatnonzero(owner[i + 1 : k] == owner[i : k - 1])
            resp[goes_on] += both[goes_on + 1, FILTERS:]
            cut = np.flatnonzero(np.concatenate(([True], owner[i + 1 : j] != owner[i : j - 1])))
            rows = owner[i:j][cut]
            top[rows] = np.maximum(top[rows], np.maximum.reduceat(resp, cut, axis=0))
        return top

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) == 1:
            return np.zeros(0)
        codes, again, first = _blocks(data, off)
        top = np.maximum(self._top(codes, again, first) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip((top @ self.out + self.out_bias).astype(np.float64), -30, 30)))

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 4e-3, seed: int = 5) -> None:
        """Adam on the weighted log loss; only the chunks that won the pooling get a gradient."""
        rng = np.random.default_rng(seed)
        params = [self.emb, self.conv, self.bias, self.out, self.out_bias]
        mean, var, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        held = [_blocks(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in texts]
        cols = np.arange(FILTERS)
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
                codes, again = np.concatenate([held[i][0] for i in part]), np.concatenate([held[i][1] for i in part])
                sizes = np.array([len(held[i][0]) for i in part])
                first = np.cumsum(sizes) - sizes
                x = self._inputs(codes, again)
                resp, top = self._pooled(x, first)
                won = np.stack([first[i] + resp[first[i] : first[i] + sizes[i]].argmax(axis=0) for i in range(len(part))])
                act = np.maximum(top + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.out_bias, -30, 30)))
                err = ((p - y[part]) * weight[part] / weight[part].sum()).astype(np.float32)
                g_top = err[:, None] * self.out * (top + self.bias > 0)
                two = won + 1 < (first + sizes)[:, None]
                nxt = np.minimum(won + 1, len(x) - 1)
                g_conv = np.stack([np.einsum("bf,bfd->df", g_top, x[won]), np.einsum("bf,bfd->df", g_top * two, x[nxt])])
                g_emb = np.zeros_like(self.emb)
                for half, at, g in ((0, won, g_top), (1, nxt, g_top * two)):
                    dx = (g[..., None] * self.conv[half].T[None]).reshape(*g.shape, STEP, CHANNELS)[..., :-1]
                    np.add.at(g_emb, codes[at], dx)
                g_emb[_PAD] = 0
                grads = [g_emb, g_conv, g_top.sum(axis=0), act.T @ err + 1e-4 * self.out, np.array([err.sum()], np.float32)]
                t += 1
                step = rate * (1 if epoch < epochs * 2 // 3 else 0.25)
                for k, g in enumerate(grads):
                    mean[k] += 0.1 * (g - mean[k])
                    var[k] += 0.01 * (g * g - var[k])
                    params[k] -= (step * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def train_network(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> ByteConvNet:
    """Fitted on at most about ``max_train_docs`` labelled texts whose fold by 4 is not 2, weighted back to the classes' true shares."""
    sample = to_driver(labelled_texts(docs, labelled_ids(labels, "quality", 4, 2, max_train_docs)))
    net = ByteConvNet()
    if len(sample):
        net.fit([t.encode() for t in sample["text"]], sample["y"].to_numpy(np.float32), (1 / sample["rate"]).to_numpy(np.float32))
    return net


def score_quality(docs: DataFrame, labels: DataFrame | None = None, network: ByteConvNet | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents(doc_id, text).

    A null text is scored as an empty one; both get the network's answer to padding alone. Without any label all
    weights stay at their start values. A null doc_id is never held out. Repeated rows are each answered; other
    columns are left out; an empty table gives an empty result.
    """
    net = network or train_network(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            s = net.scores(*byte_view(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
