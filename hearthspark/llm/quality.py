"""A quality classifier: random-indexing word vectors pooled over a text, then a small two-layer network.

Tokens are runs of letters and digits, and runs of other marks; a word that repeats the one before it and a word in
capitals are tokens of their own kind. Tokens are hashed into a table of fixed size. Random indexing gives each slot
a sparse random index vector; its word vector is the sum of the index vectors of its neighbours (two on each side)
over all documents, summed in each partition and then by slot, so its size doesn't depend on the corpus. A text is the
mean of its tokens' unit vectors, with the mean's length and the log of its tokens. The network (numpy, tanh) is
trained on a bounded sample (``sample`` labelled rows of each label) and its probabilities are calibrated by one
temperature on a fifth of that sample that training doesn't see.

Defined results: null and empty texts pool to the zero vector and are scored like any other; without labels of both
classes every score is the share of label 1 (0.5 without labels); repeated rows give repeated results; empty tables
give no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import fold, labelled_sample

SLOTS, SIZE, NONZERO, REACH = 1 << 13, 48, 2, 2
_REPEAT, _CAPITALS, _FIRST = 0, 1, 2
_rng = np.random.default_rng(11)
_PLACE = _rng.integers(0, SIZE, (SLOTS, NONZERO))
_SIGN = _rng.choice([-1.0, 1.0], (SLOTS, NONZERO))
_CLASS = np.where(spans.ALNUM, 1, np.where(spans.NOT_SPACE, 2, 0)).astype(np.int8)
_UPPER = spans.byte_set(bytes(range(65, 91)))
_SMALL = spans.byte_set(bytes(range(97, 123)))


def tokens(c: spans.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each token of a chunk, and token offsets by text."""
    low = c.folded()
    kind = _CLASS[c.data]
    change = np.flatnonzero(np.diff(kind)) + 1
    s, e = np.concatenate([[0], change]), np.concatenate([change, [len(kind)]])
    held = kind[s] > 0
    s, e = s[held], e[held]
    at = low.offsets(s)
    h = low.hashes(s, e)
    slot = _FIRST + (h % np.uint64(SLOTS - _FIRST)).astype(np.int64)
    upper, small = (np.concatenate([[0], np.cumsum(of[c.data])]) for of in (_UPPER, _SMALL))
    slot[(upper[e] - upper[s] > 1) & (small[e] == small[s])] = _CAPITALS
    word = np.flatnonzero(kind[s] == 1)
    doc = np.searchsorted(at, word, "right")
    again = (h[word[1:]] == h[word[:-1]]) & (doc[1:] == doc[:-1])
    slot[word[1:][again]] = _REPEAT
    return slot, at


def context_sums(documents: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Word vectors of all slots, from all documents: SLOTS x SIZE."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * SIZE)
        for batch in batches:
            for c in spans.chunks(batch.column(0)):
                slot, at = tokens(c)
                doc = np.repeat(np.arange(c.n), np.diff(at))
                cells, signs = [], []
                for reach in range(1, REACH + 1):
                    near = np.flatnonzero(doc[reach:] == doc[:-reach]) if len(doc) > reach else np.empty(0, int)
                    a, b = slot[near], slot[near + reach]
                    for x, y in ((a, b), (b, a)):
                        for t in range(NONZERO):
                            cells.append(x * SIZE + _PLACE[y, t])
                            signs.append(_SIGN[y, t])
                if cells:
                    total += np.bincount(np.concatenate(cells), np.concatenate(signs), SLOTS * SIZE)
        table = total.reshape(SLOTS, SIZE).astype(np.float32)
        held = np.flatnonzero(table.any(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(held) * SIZE + 1, SIZE, dtype=np.int32)), pa.array(table[held].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), values], ["slot", "v"])

    parts = documents.select(F.col(text_col).alias("text")).mapInArrow(gather, "slot int, v array<float>")
    sums = parts.groupBy("slot").agg(*(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(SIZE))).toArrow()
    out = np.zeros((SLOTS, SIZE))
    out[sums["slot"].to_numpy()] = np.stack([sums[f"v{k}"].to_numpy() for k in range(SIZE)], 1)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean unit vector, its length, log of tokens, and the shares of repeats and capitals."""
    out = []
    for c in spans.chunks(column, 1 << 20):
        slot, at = tokens(c)
        n = np.diff(at)
        x = np.zeros((c.n, SIZE + 4))
        full = np.flatnonzero(n)
        if len(full):
            x[full, :SIZE] = np.add.reduceat(vectors[slot], at[:-1][full], axis=0) / n[full, None]
            for k, marker in ((2, _REPEAT), (3, _CAPITALS)):
                x[full, SIZE + k] = np.add.reduceat((slot == marker).astype(float), at[:-1][full]) / n[full]
        x[:, SIZE] = np.linalg.norm(x[:, :SIZE], axis=1)
        x[:, SIZE + 1] = np.log1p(n)
        out.append(x)
    return np.concatenate(out) if out else np.empty((0, SIZE + 4))


class Network:
    """Two layers: tanh units, then one logit, divided by the temperature."""

    def __init__(self, mean, scale, layers, temperature: float, share: float):
        self.mean, self.scale, self.layers, self.temperature, self.share = mean, scale, layers, temperature, share

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, *, units: int = 24, rounds: int = 400, rate: float = 0.02, l2: float = 1e-4, seed: int = 3) -> Network:
    """Full-batch Adam; a fifth of the rows picks the temperature."""
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return Network(None, None, None, 1.0, share)
    rng = np.random.default_rng(seed)
    order = np.lexsort(np.round(x, 6).T)  # the same rows in any order train the same network
    x, y = x[order], y[order]
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z, t = (x[used] - mean) / scale, y[used]
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), np.zeros(())]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for step in range(1, rounds + 1):
        a, b, c, d = layers
        hidden = np.tanh(z @ a + b)
        g = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - t) / len(t)
        back = np.outer(g, c) * (1 - hidden**2)
        for k, grad in enumerate((z.T @ back + l2 * a, back.sum(0), hidden.T @ g + l2 * c, np.asarray(g.sum()))):
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.999 * m[1] + 0.001 * grad**2
            layers[k] = layers[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, layers, 1.0, share)
    logit, truth = net.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        p = np.clip(logit / temperature, -30, 30)
        return float(np.mean(np.logaddexp(0, p) - truth * p))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def train(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = 8_000) -> Network:
    rows = labelled_sample(documents, labels, label, n=sample, id_col=id_col, text_col=text_col)
    sent = rows.sparkSession.sparkContext.broadcast(vectors)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(0), sent.value)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([values, batch.column(1)], ["x", "label"])

    out = rows.mapInArrow(each, "x array<double>, label int").toArrow()
    x = out["x"].combine_chunks().flatten().to_numpy() if out.num_rows else np.empty(0)
    return fit_network(x.reshape(-1, SIZE + 4), out["label"].to_numpy().astype(float))


def score(documents: DataFrame, vectors: np.ndarray, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted, one row per document."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = sent.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.probability(pooled(batch.column(1), v)))], ["doc_id", "score"])

    out = docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 0
