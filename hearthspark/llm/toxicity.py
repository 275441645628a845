"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Token scores are log-odds of the toxic class under Dirichlet priors in two levels: counts of a word and of its stem (first
four bytes) are both shrunk to the class shares, a stem's more strongly, and a word in fewer than three labelled texts is
scored by its stem; a constant margin makes the expected score of harmless
text negative. A linear-time scan finds every maximal-scoring segment of a whole text. Scores of chance segments
follow an extreme-value law: lambda comes from the background distribution of token scores, K from the best segments
of clean texts. A segment counts if its E-value is small; a text's score is a logistic function of the best segment's
surprise, the surprise of all significant ones and their number.

lambda, K and the logistic function are fitted to texts scored by counts of the other folds (``FOLDS``), so that no text
is judged by words it taught.

Words and stems are hashed into tables of fixed size, so what is sent to tasks doesn't grow with the corpus. Labels
come from a bounded sample (``sample`` rows of each label). Scores use the text alone.

Defined results: null, empty and word-less texts have no segments and get the score of a text without any; without
labels of both classes every score is the share of the toxic class (0 without labels); repeated rows give repeated
results; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import fold, labelled_sample

WORD_BITS, STEM_BITS, STEM_BYTES = 19, 15, 4
_WORDS, _STEMS = 1 << WORD_BITS, 1 << STEM_BITS
MARGIN = 1.8
FOLDS = 4
#: Segments with a smaller expected number of chance occurrences in their text are significant.
E_VALUE = 0.05


def slots(c: spans.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word slot, stem slot, start and end of each word of a chunk; word offsets by text."""
    low = c.folded()
    s, e = low.runs(spans.ALNUM[low.data])
    word = (low.hashes(s, e) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    stem = (low.hashes(s, np.minimum(e, s + STEM_BYTES)) >> np.uint64(64 - STEM_BITS)).astype(np.int64)
    return word, stem, s, e, low.offsets(s)


def segments(scores: np.ndarray, lo: int, hi: int, cum: np.ndarray, positive: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, score) of words lo to hi, in one scan over the positive scores.

    A stack holds disjoint candidates with the cumulative scores at their left and right ends; a new candidate joins
    everything back to the nearest one that starts lower, as long as that one also ends lower. Each candidate keeps a
    link to the nearest one before it that starts lower, so that what was passed over once isn't looked at again, and
    where none starts lower all before are final. Time grows with the number of words, whatever their scores.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[float, float, int, int, int]] = []  # left, right, start, stop, link
    for i in positive.tolist():
        left, right, start = cum[i], cum[i + 1], i
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0:
                done += [(a, b, r - l) for l, r, a, b, _ in stack[: _first_from(stack, start)]]
                stack = []
                break
            if stack[j][1] >= right:
                del stack[_first_from(stack, start) :]
                break
            left, start = stack[j][0], stack[j][2]
            j = stack[j][4]
        stack.append((left, right, start, i + 1, j))
    return done + [(a, b, r - l) for l, r, a, b, _ in stack]


def _first_from(stack: list[tuple[float, float, int, int, int]], start: int) -> int:
    """The place of the first candidate that starts at ``start`` or later: from there on, all are part of the new one."""
    k = len(stack)
    while k and stack[k - 1][2] >= start:
        k -= 1
    return k


class Model:
    def __init__(self, table: np.ndarray, stems: np.ndarray, rate: float, k: float, weights: np.ndarray, share: float):
        self.table, self.stems, self.rate, self.k, self.weights, self.share = table, stems, rate, k, weights, share

    def token_scores(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """A word that the sample has is scored by its own counts, any other by its stem's."""
        own = self.table[word]
        return np.where(np.isnan(own), self.stems[stem], own).astype(np.float64)

    def scan(self, c: spans.Chunk) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
        """For each text: its words, the byte offset of its first, and the segments as byte spans with their surprise.

        Surprise is lambda * score - ln(K * words): minus the log of the segment's E-value."""
        word, stem, s, e, at = slots(c)
        x = self.token_scores(word, stem)
        cum = np.concatenate([[0.0], np.cumsum(x)])
        positive = np.flatnonzero(x > 0)
        cut = np.searchsorted(positive, at)
        for i in range(c.n):
            n = int(at[i + 1] - at[i])
            found = segments(x, int(at[i]), int(at[i + 1]), cum, positive[cut[i] : cut[i + 1]]) if n else []
            yield n, int(c.start[i]), [(int(s[a]), int(e[b - 1]), self.rate * v - np.log(self.k * n)) for a, b, v in found]

    def features(self, column: pa.Array) -> np.ndarray:
        """Best surprise, log of the summed surprise of significant segments, their number, log of words."""
        out = []
        for c in spans.chunks(column):
            for n, _, found in self.scan(c):
                best = max((v for *_, v in found), default=-np.log(self.k * max(n, 1)))
                strong = [v for *_, v in found if v > -np.log(E_VALUE)]
                out.append((np.clip(best, -20, 30), np.log1p(sum(strong)), min(len(strong), 10), np.log1p(n)))
        return np.array(out, float).reshape(-1, 4)

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.features(column)
        if not len(self.weights):
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _fold() -> Column:
    return F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int")


def class_counts(sample: DataFrame) -> DataFrame:
    """fold, slot, clean, toxic: texts of each class that have the word slot (from 0) or stem slot (from 2**WORD_BITS), summed over partitions.

    Texts and not occurrences are counted, so that one text that repeats a word a hundred times doesn't mark it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _WORDS + _STEMS
        total = np.zeros((2, FOLDS * size), np.int32)
        for batch in batches:
            labels, fold = (np.array(batch.column(k).to_pylist(), int) for k in (1, 2))
            for c in spans.chunks(batch.column(0)):
                word, stem, _, _, at = slots(c)
                doc = np.repeat(np.arange(c.n), np.diff(at))
                held = np.unique(np.concatenate([doc * size + word, doc * size + _WORDS + stem]))
                row = c.lo + held // size
                for k in (0, 1):
                    of = labels[row] == k
                    place, times = np.unique(fold[row[of]] * size + held[of] % size, return_counts=True)
                    total[k, place] += times
        place = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array((place // size).astype(np.int32)), pa.array(place % size), pa.array(total[0, place].astype(np.int64)), pa.array(total[1, place].astype(np.int64))], ["fold", "slot", "clean", "toxic"])

    part = sample.select("text", "label", _fold()).mapInArrow(count, "fold int, slot long, clean long, toxic long")
    return part.groupBy("fold", "slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(clean: np.ndarray, toxic: np.ndarray, stem_weight: float = 50.0, word_weight: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Scores by word slot (NaN where the sample has no such word) and by stem slot, margin taken off.

    A word's prior is the class share; a rare word has no score of its own, and its stem's holds.
    """
    share = (toxic[:_WORDS].sum() + 1) / (toxic[:_WORDS].sum() + clean[:_WORDS].sum() + 2)
    base = np.log(share / (1 - share))
    p = (toxic + np.where(np.arange(len(toxic)) < _WORDS, word_weight, stem_weight) * share) / (toxic + clean + np.where(np.arange(len(toxic)) < _WORDS, word_weight, stem_weight))
    x = np.log(p / (1 - p)) - base - MARGIN
    words = x[:_WORDS].copy()
    words[(toxic + clean)[:_WORDS] < 3] = np.nan
    return words, x[_WORDS:]


def extreme_rate(values: np.ndarray, weight: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1 under the background distribution of token scores."""
    w = weight / weight.sum()
    if not (values > 0).any() or (w[values > 0].sum() == 0):
        return 1.0
    lo, hi = 1e-6, 1.0
    with np.errstate(over="ignore"):
        while (w * np.exp(hi * values)).sum() < 1 and hi < 64:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (w * np.exp(mid * values)).sum() < 1 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
    return w


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = 20_000, calibration: int = 4_000) -> Model:
    """Counts over the labelled sample in Spark; then lambda, K and the logistic from ``calibration`` texts of each label at most."""
    rows = labelled_sample(documents, labels, label, n=sample, id_col=id_col, text_col=text_col)
    counts = class_counts(rows).toArrow()
    each = np.zeros((2, FOLDS, _WORDS + _STEMS), np.float32)
    for k, name in enumerate(("clean", "toxic")):
        each[k, counts["fold"].to_numpy(), counts["slot"].to_numpy()] = counts[name].to_numpy()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def model_of(clean: np.ndarray, toxic: np.ndarray) -> Model:
        table, stems = log_odds(clean, toxic)
        known = ~np.isnan(table)
        rate = extreme_rate(table[known], clean[:_WORDS][known] + 1e-9) if len(sizes) == 2 and known.any() else 1.0
        return Model(table, stems, rate, 1.0, np.empty(0), share)

    clean, toxic = each.sum(1).astype(float)
    model = model_of(clean, toxic)
    if len(sizes) < 2:
        return model
    others = [model_of(clean - each[0, f], toxic - each[1, f]) for f in range(FOLDS)]
    keep = F.lit(False)
    for y, c in sizes.items():
        keep = keep | ((F.col("label") == y) & (F.xxhash64("text", F.lit("fit")).cast("double") / F.lit(2.0**64) + F.lit(0.5) <= min(1.0, calibration / c)))

    def features(models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
        sent = rows.sparkSession.sparkContext.broadcast(models)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold = np.array(batch.column(2).to_pylist(), int)
                for f, m in enumerate(sent.value):
                    part = batch.filter(pa.array(fold == f))
                    x = m.features(part.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)] + [part.column(1)], ["a", "b", "c", "d", "label"])

        out = rows.filter(keep).select("text", "label", _fold()).mapInArrow(scored, "a double, b double, c double, d double, label int").toArrow()
        return np.stack([out[k].to_numpy() for k in "abcd"], 1), out["label"].to_numpy()

    x, y = features(others)
    # Under K = 1 the best surprise of a clean text is lambda * score - ln(n), of mean ln(K) + Euler's constant.
    harmless = x[y == 0, 0]
    if len(harmless):
        k = float(np.exp(np.clip(np.median(harmless) + np.log(np.log(2)), -12, 12)))
        for m in (model, *others):
            m.k = k
    x, y = features(others)
    model.weights = logistic(x, y) if len(set(y.tolist())) == 2 else np.empty(0)
    return model


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted, one row per document."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], ["doc_id", "score"])

    out = docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def passages(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", e_value: float = E_VALUE) -> DataFrame:
    """Every significant passage: doc_id, start and stop (bytes of the UTF-8 text) and surprise (minus log of the E-value)."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cut = [], []
            for c in spans.chunks(batch.column(1)):
                for i, (_, begin, found) in enumerate(sent.value.scan(c)):
                    for a, b, v in found:
                        if v > -np.log(e_value):
                            row.append(c.lo + i)
                            cut.append((a - begin, b - begin, float(v)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array([x[k] for x in cut], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["doc_id", "start", "stop", "surprise"])

    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, stop long, surprise double")


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 0
