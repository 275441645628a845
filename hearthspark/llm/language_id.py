"""Language identification by a linear-chain conditional random field over the words of a text.

Words are runs of letters, lower-cased. Each word has affix features (first and last one to three bytes), character
n-grams (two and three bytes, word edges included) and a lexicon feature (the whole word, if the training sample has
it often enough); all are hashed into one weight table. Weights and transitions are learned together by gradient
ascent on the conditional likelihood of label sequences spliced from monolingual training texts, so that the model has
seen switches. Forward-backward gives each word its posterior; a text's language is the one with the largest mean
posterior, and that mean is its score.

The training sample is bounded: ``sample`` distinct texts a language at most, and ``span`` words of each from a place
in the whole text that a hash chooses. Prediction reads whole texts and only the texts.

Defined results: ``und`` and score 0 for null texts, texts without letters, and when nothing was learned; repeated
rows give repeated results; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import bounded_sample, fold

TABLE = 1 << 16
SEGMENT = 64
_AFFIX = [np.uint64(0xA0761D6478BD642F + 2 * k) for k in range(6)]


#: ASCII letters alone: a text with one has a letter whatever its other bytes are.
_ASCII_LETTER = spans.byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))


def normalised(c: spans.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with letters lower-cased (A-Z and the Latin-1 capitals) and all else blank, and each word's start and end; offsets by text."""
    data = spans.LOWER[c.data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = data + (capital.view(np.uint8) << 5)
    data[~spans.LETTER[data]] = 32
    s, e = c.runs(data != 32)
    return data, s, e, c.offsets(s)


def _slots(x: np.ndarray) -> np.ndarray:
    return (spans.mix(x) >> np.uint64(48)).astype(np.int32)


class Features:
    """Hashed features of the words of a chunk: n-gram slots by byte position, affix and lexicon slots by word."""

    def __init__(self, c: spans.Chunk):
        data, s, e, self.offsets = normalised(c)
        self.s, self.e = s, e
        wide = np.concatenate([[32], data, [32, 32]]).astype(np.uint64)  # wide[i + 1] is data[i]
        two = wide[:-2] | wide[1:-1] << np.uint64(8)
        self.two = _slots(two[:-1] + np.uint64(1 << 60))  # at i: bytes i - 1 and i
        three = two[:-1] | wide[2:-1] << np.uint64(16)
        self.three = _slots(three + np.uint64(1 << 61))  # at i: bytes i - 1 to i + 1
        plain = spans.Chunk(c.lo, data, c.start, c.end)
        self.affix = [_slots(plain.hashes(s, np.minimum(e, s + k)) ^ _AFFIX[k - 1]) for k in (1, 2, 3)]
        self.affix += [_slots(plain.hashes(np.maximum(s, e - k), e) ^ _AFFIX[k + 2]) for k in (1, 2, 3)]
        self.word = plain.hashes(s, e)

    def scores(self, weights: np.ndarray, lexicon: np.ndarray, lexicon_weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features, for each label."""
        k = weights.shape[1]
        out = np.empty((len(self.s), k), np.float32)
        at = np.searchsorted(lexicon, self.word)
        at[at == len(lexicon)] = 0
        known = lexicon[at] == self.word if len(lexicon) else np.zeros(len(at), bool)
        for y in range(k):
            w = weights[:, y]
            two, three = (np.concatenate([[0.0], np.cumsum(w[grams], dtype=np.float64)]) for grams in (self.two, self.three))
            total = two[self.e + 1] - two[self.s] + three[self.e] - three[self.s]  # up to the blank after the word, and not beyond
            total /= np.sqrt(self.e - self.s + 1)
            for a in self.affix:
                total += w[a]
            if len(lexicon):
                total += np.where(known, lexicon_weights[at, y], 0)
            out[:, y] = total
        return out


def forward_backward(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior of each word's label, texts being chains from offsets[k] to offsets[k + 1].

    Chains are cut into segments of equal length (8 to 64 words, about the mean length of a chain, so that short chains
    don't fill memory with blanks); each segment's product of transition matrices links its ends, so the
    Python loops run over a segment's length and a chain's segments while numpy runs over all segments at once.
    ``pairs``: also the expected number of each transition.
    """
    n, k = scores.shape
    move = np.exp(transitions - transitions.max())
    emit = np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64)) + 1e-30
    lengths = np.diff(offsets)
    width = int(np.clip(1 << int(np.ceil(np.log2(max(1, n) / max(1, len(lengths)) + 1))), 8, SEGMENT))
    per = -(-lengths // width)
    first_segment = np.concatenate([[0], np.cumsum(per)])
    total = int(first_segment[-1])
    chain = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(total) - first_segment[chain]
    place = np.arange(n) - np.repeat(offsets[:-1], lengths)
    row = np.repeat(first_segment[:-1], lengths) + place // width
    col = place % width
    e = np.ones((width, total, k))
    e[col, row] = emit
    size = np.minimum(width, lengths[chain] - rank * width)
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    lead = (rank == 0)[:, None, None]
    for t in range(width):
        live = size > t
        if not live.any():
            break
        step = (m.reshape(-1, k) @ move).reshape(total, k, k) if t else np.where(lead, m, (m.reshape(-1, k) @ move).reshape(total, k, k))
        step = step * e[t][:, None, :]
        m = np.where(live[:, None, None], step / step.max((1, 2), keepdims=True), m)
    into = np.ones((total, k)) / k  # alpha before a segment's first word
    after = np.ones((total, k))  # beta at a segment's last word
    order = np.argsort(-per, kind="stable")
    sorted_per = per[order]
    for r in range(1, int(per.max()) if len(per) else 0):
        on = order[: np.searchsorted(-sorted_per, -r, "left")]
        seg = first_segment[on] + r
        v = np.einsum("si,sij->sj", into[seg - 1], m[seg - 1])
        into[seg] = v / v.sum(1, keepdims=True)
    for r in range((int(per.max()) if len(per) else 0) - 2, -1, -1):
        on = order[: np.searchsorted(-sorted_per, -(r + 1), "left")]
        seg = first_segment[on] + r
        v = np.einsum("sij,sj->si", m[seg + 1], after[seg + 1])
        after[seg] = v / v.sum(1, keepdims=True)
    alpha = np.empty((width, total, k))
    a = into
    for t in range(width):
        a = np.where((rank == 0)[:, None], a, a @ move) * e[t] if t == 0 else (a @ move) * e[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    beta = np.empty((width, total, k))
    b = after
    for t in range(width - 1, -1, -1):
        b = np.where((size == t + 1)[:, None], after, b)
        beta[t] = b
        b = (b * e[t]) @ move.T
        b /= b.sum(1, keepdims=True)
    p = (alpha * beta)[col, row]
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p, None
    linked = np.flatnonzero(place > 0)
    right = (beta * e)[col[linked], row[linked]]
    left = alpha[col[linked - 1], row[linked - 1]]
    x = left[:, :, None] * move[None] * right[:, None, :]
    return p, (x / x.sum((1, 2), keepdims=True)).sum(0)


class Model:
    """What was learned: labels, the hashed weights, the lexicon and the transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: np.ndarray, lexicon_weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.lexicon, self.lexicon_weights, self.transitions = labels, weights, lexicon, lexicon_weights, transitions

    def word_posteriors(self, c: spans.Chunk) -> tuple[Features, np.ndarray]:
        f = Features(c)
        return f, forward_backward(f.scores(self.weights, self.lexicon, self.lexicon_weights), f.offsets, self.transitions)[0]


def spliced(texts: dict[str, list[str]], words: int, seed: int) -> tuple[list[str], list[list[int]]]:
    """Training chains and the label of each word: all words of all texts, ``words`` of a text a chain, with runs of other languages' words between them."""
    rng = np.random.default_rng(seed)
    labels = sorted(texts)
    cut = {y: [w for w in (t.split() for t in texts[y]) if w] for y in labels}
    chains, truth = [], []
    for own, y in enumerate(labels):
        for w in cut[y]:
            for at in range(0, len(w), words):
                block, out, given = w[at : at + words], [], []
                while block:
                    n = int(rng.geometric(1 / 25)) if len(labels) > 1 else len(block)
                    out += block[:n]
                    given += [own] * len(block[:n])
                    block = block[n:]
                    other = int(rng.integers(0, len(labels)))
                    if other != own and cut[labels[other]] and rng.random() < 0.5:
                        source = cut[labels[other]][int(rng.integers(0, len(cut[labels[other]])))]
                        start = int(rng.integers(0, max(1, len(source) - 25)))
                        run = source[start : start + int(rng.geometric(1 / 25))]
                        out += run
                        given += [other] * len(run)
                chains.append(" ".join(out))
                truth.append(given)
    return chains, truth


def fit(texts: dict[str, list[str]], *, words: int = 80, rounds: int = 60, rate: float = 0.15, l2: float = 1e-4, min_count: int = 3, seed: int = 1) -> Model:
    """Train on texts by label. Adam on the mean log-likelihood; deterministic."""
    labels = sorted(texts)
    if not labels:
        return Model([], np.zeros((TABLE, 0), np.float32), np.empty(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    k = len(labels)
    raw, given = spliced(texts, words, seed)
    fs, ys, offsets = [], [], [0]
    for c in spans.chunks(pa.array(raw, pa.large_string())):
        f = Features(c)
        # a token between spaces can hold several words, or none: each word takes the label of its token
        blank = spans.NOT_SPACE[c.data]
        ts, _ = c.runs(blank)
        token = np.searchsorted(ts, f.s, "right") - 1
        flat = np.array([y for g in given[c.lo : c.lo + c.n] for y in g])
        ys.append(flat[token])
        offsets += (offsets[-1] + f.offsets[1:]).tolist()
        fs.append(f)
    offsets = np.array(offsets)
    y = np.concatenate(ys)
    word = np.concatenate([f.word for f in fs])
    n = len(y)
    if not n:
        return Model(labels, np.zeros((TABLE, k), np.float32), np.empty(0, np.uint64), np.zeros((0, k), np.float32), np.zeros((k, k)))
    lexicon, where, count = np.unique(word, return_inverse=True, return_counts=True)
    often = count >= min_count
    place = np.where(often[where], np.cumsum(often)[where] - 1, -1)
    lexicon = lexicon[often]
    # (word, slot, value) of every feature
    rows, slots, values, base = [], [], [], 0
    for f in fs:
        m = len(f.s)
        for grams, span in ((f.two, f.e - f.s + 1), (f.three, f.e - f.s)):
            w = np.repeat(np.arange(m), span)
            at = np.arange(len(w)) - np.repeat(np.cumsum(span) - span, span) + np.repeat(f.s, span)
            rows.append(base + w)
            slots.append(grams[at])
            values.append(np.repeat(1 / np.sqrt(f.e - f.s + 1), span))
        for a in f.affix:
            rows.append(base + np.arange(m))
            slots.append(a)
            values.append(np.ones(m))
        base += m
    known = np.flatnonzero(place >= 0)
    rows, slots, values = np.concatenate([*rows, known]), np.concatenate([*slots, TABLE + place[known]]), np.concatenate([*values, np.ones(len(known))])
    size = TABLE + len(lexicon)
    truth = np.eye(k)[y]
    place_in = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    linked = np.flatnonzero(place_in > 0)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[linked - 1], y[linked]), 1)
    w, t = np.zeros((size, k)), np.zeros((k, k))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    for step in range(1, rounds + 1):
        scores = np.stack([np.bincount(rows, values * w[slots, j], n) for j in range(k)], 1)
        p, expected = forward_backward(scores, offsets, t, pairs=True)
        left = (truth - p)
        gw = np.stack([np.bincount(slots, values * left[rows, j], size) for j in range(k)], 1) / n - l2 * w
        gt = (seen - expected) / n - l2 * t
        for x, g, m in ((w, gw, moments[0]), (t, gt, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, w[:TABLE].astype(np.float32), lexicon, w[TABLE:].astype(np.float32), t)


def train(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", sample: int = 60, **how) -> Model:
    """Fit on at most ``sample`` distinct texts of each label, chosen by a hash of the text; they are read whole."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}")).select(F.xxhash64("text").alias("h"), "text", "label")
    texts: dict[str, list[str]] = {}
    for r in bounded_sample(rows, F.col("h"), sample, "label"):
        texts.setdefault(r["label"], []).append(r["text"])
    return fit(texts, **how)


def _mean_posteriors(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, mean posterior of each label and whether there is an ASCII letter, for each text."""
    count, mean, plain = [], [], []
    for c in spans.chunks(column):
        f, p = model.word_posteriors(c)
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
        n = np.diff(f.offsets)
        count.append(n)
        plain.append(c.sums(_ASCII_LETTER[c.data]) > 0)
        mean.append((total[f.offsets[1:]] - total[f.offsets[:-1]]) / np.maximum(n, 1)[:, None])
    return (np.concatenate(count), np.concatenate(mean), np.concatenate(plain)) if count else (np.empty(0, int), np.empty((0, len(model.labels))), np.empty(0, bool))


def verdicts(column: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(column), [0.0] * len(column)
    if model.labels:
        count, mean, plain = _mean_posteriors(column, model)
        best = mean.argmax(1)
        for i in np.flatnonzero(count).tolist():
            lang[i], score[i] = model.labels[best[i]], float(min(1.0, mean[i, best[i]]))
        # bytes beyond ASCII count as letters above: texts without any letter at all are und
        for i in np.flatnonzero((count > 0) & ~plain).tolist():
            if not any(ch.isalpha() for ch in column[i].as_py()):
                lang[i], score[i] = "und", 0.0
    return lang, score


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, one row per document."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lang, score = verdicts(part.column(1), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def label_words(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of code-switched text: doc_id, start and stop (bytes of the UTF-8 text), label and posterior."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in spans.chunks(batch.column(1), 1 << 18):
                f, p = sent.value.word_posteriors(c)
                if not sent.value.labels or not len(p):
                    continue
                doc = np.searchsorted(f.offsets, np.arange(len(p)), "right") - 1
                best = p.argmax(1)
                ids = batch.column(0).slice(c.lo, c.n).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(f.s - c.start[doc]), pa.array(f.e - c.start[doc]), pa.array([sent.value.labels[i] for i in best]), pa.array(p[np.arange(len(p)), best].astype(float))], ["doc_id", "start", "stop", "label", "posterior"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, stop long, label string, posterior double")


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 3) == 1


def keep_identified(documents: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose language is known with a mean posterior of ``least`` or more."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names, at = documents.columns, documents.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lang, score = verdicts(part.column(at), sent.value)
                keep = [y != "und" and s >= least for y, s in zip(lang, score)]
                yield pa.RecordBatch.from_arrays(part.columns, names).filter(pa.array(keep, pa.bool_()))
            spans.give_back()

    return documents.mapInArrow(scan, documents.schema)
