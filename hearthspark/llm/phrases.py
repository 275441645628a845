"""Phrase collocation mining by Toivonen's method: a sample proposes, a full pass counts proposals and negative border.

Texts are cut into pieces at marks and line ends, and pieces into words (A-Z lower-cased). A phrase is 2 to ``longest``
consecutive words of a piece; everything is counted by language. Steps:

1. One pass counts all words exactly: words with ``least`` occurrences, and each language's total.
2. A pass over a share of all pieces (chosen by a hash of document and place, so every document takes part) counts
   phrases of frequent words; those with ``sample_least`` occurrences in the sample are proposed.
3. A pass adds up pairs of frequent words by hash buckets; a pair whose bucket holds fewer than ``least`` can't be
   frequent, and neither can what has it inside: the border's bulk is ruled out without being named. (Beyond some
   10^10 words the buckets, whose number has a bound, rule out less and less, and the next pass shuffles more.)
4. The full pass counts every occurrence of a phrase whose first and last words (all but the last, all but the first)
   are both proposed: the proposals and their whole negative border. Counts are exact.
5. Frequent phrases of the border weren't proposed: the sample failed there. They are added, and a further pass counts
   what the border gains, until no new frequent phrase turns up; then no frequent phrase is missing.

Proposals go to the tasks as one bitmap of phrase hashes whose size has a bound. Hashes that clash propose too much,
which costs time and changes no count: counts are kept by the phrases themselves (in a task by exact numbers of words
and pairs). Each chunk and then each task adds up its own counts before anything is shuffled.

A candidate's score is the smallest floor(1000 * a * n / (l * r)) of its cuts, in exact decimal arithmetic; a candidate
goes if a longer one around it has ``percent`` percent of its occurrences (if any has, one longer by a word has).

Defined results: null and empty texts have no words; null languages are ``und`` (and count with a language of that
name); repeated rows count each; very long texts are whole; empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import discard, stage

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: The share of pieces in the sample is 1 / ``SAMPLE_PART``; how often the sample must have a phrase that it proposes.
SAMPLE_PART, SAMPLE_LEAST = 8, 4
#: Bits of the bitmap for each proposed phrase, and at most.
_BITS_EACH, _LEAST_BITS, _MOST_BITS = 16, 1 << 20, 1 << 28
_BUCKET_BITS = 32_768
#: Buckets in which pairs of words are counted, at most (one for each word of the corpus below that), and how many a task holds at once.
_MOST_BUCKETS, _PENDING = 1 << 28, 4_000_000
#: Languages whose totals are broadcast.
_FEW_LANGUAGES = 100_000
_CHUNK = 1 << 20
_KINDS = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: ends a piece
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Bitmap(NamedTuple):
    """A set of phrase hashes that may hold more than was put in."""

    words: np.ndarray
    bits: int

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether both bits of each hash are set."""
        return self.first(h) & self.first(h >> np.uint64(32))

    def first(self, h: np.ndarray) -> np.ndarray:
        """Whether the bit of each hash's low part is set."""
        at = h & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Words(NamedTuple):
    """The words of a chunk, in order."""

    text: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    data: np.ndarray
    at: np.ndarray
    hashes: np.ndarray


def words_of(c: spans.Chunk) -> Words:
    """Words with their text, their piece's number and its place in the text; ``data`` has each word and a blank, from ``at`` on."""
    data = spans.LOWER[c.data]
    kind = _KINDS[data]
    s, e = c.runs(kind == 0)
    text = np.searchsorted(c.start, s, "right") - 1
    stops = np.flatnonzero(kind == 2)
    piece = np.searchsorted(stops, s)
    start = np.where(piece > 0, stops[piece - 1] + 1 if len(stops) else 0, 0) - c.start[text]
    folded = spans.Chunk(c.lo, data, c.start, c.end)
    h = folded.hashes(s, e)
    kept = kind == 0
    kept[e] = True
    blank = data.copy()
    blank[e] = 32
    return Words(text, piece, start, blank[kept], np.concatenate([[0], np.cumsum(e - s + 1)]), h)


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of equal keys from 0 on in order of appearance, the first place of each, and how often it occurs."""
    if not len(keys):
        none = np.empty(0, np.int64)
        return none, none, none
    number = pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)
    count = np.bincount(number)
    first = np.empty(len(count), np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return number, first, count


def _phrases(w: Words, first: np.ndarray, k: int) -> pa.Array:
    """The ``k`` words from each of ``first`` on, with single blanks between them."""
    lo, n = w.at[first], w.at[first + k] - 1 - w.at[first]
    at = np.concatenate([[0], np.cumsum(n)])
    data = w.data[np.repeat(lo - at[:-1], n) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


class Part(NamedTuple):
    """A chunk's words; each word's number, its language's number, all languages' names, and its text's seed."""

    words: Words
    word: np.ndarray
    code: np.ndarray
    names: pa.Array
    seeds: np.ndarray


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The chunks of a table of seed, lang and text; hashes of words differ by language."""
    for batch in batches:
        lang = batch.column(1).dictionary_encode()
        codes, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary
        salt = spans.mix(np.array([hash_of(x) for x in names.to_pylist()], np.uint64))
        seeds = batch.column(0).to_numpy().view(np.uint64)
        for c in spans.chunks(batch.column(2), _CHUNK):
            w = words_of(c)
            if len(w.text):
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.text), [None, pa.py_buffer(w.at.astype(np.int64).tobytes()), pa.py_buffer(w.data.tobytes())])
                code = codes[c.lo : c.lo + c.n][w.text]
                yield Part(w._replace(hashes=w.hashes ^ salt[code]), raw.dictionary_encode().indices.to_numpy().astype(np.int64), code, names, seeds[c.lo : c.lo + c.n])


_COUNTED = "lang string, phrase string, n long"


def _counted(p: Part, first: np.ndarray, k: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([p.names.take(pa.array(p.code[first])), _phrases(p.words, first, k).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def hash_of(name: str) -> int:
    """A fixed number of a language's name."""
    out = 0
    for b in name.encode():
        out = (out * 257 + b + 1) % (1 << 64)
    return out


def _longer(h: np.ndarray, i: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each ``i`` on, from those of the first ``k - 1`` (``h``)."""
    return spans.mix(h * _STEP + words[i + k - 1])


def count_words(docs: DataFrame) -> DataFrame:
    """Every word's occurrences by language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches):
            _, first, n = _numbers(p.word * len(p.names) + p.code)
            yield _counted(p, first, 1, n)

    return docs.mapInArrow(scan, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def count_sample(docs: DataFrame, frequent, *, part: int, longest: int) -> DataFrame:
    """Hashes (h) and sample counts of phrases of frequent words in a share of all pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches):
            w = p.words
            number, first, _ = _numbers(p.word * len(p.names) + p.code)
            ok = frequent.value.has(w.hashes[first])[number]
            ok &= spans.mix(p.seeds[w.text] + w.start.astype(np.uint64)) % np.uint64(part) == 0
            i = np.flatnonzero(ok)
            h = w.hashes[i]
            for k in range(2, longest + 1):
                last = np.minimum(i + k - 1, len(ok) - 1)
                stay = (i + k - 1 < len(ok)) & ok[last] & (w.piece[last] == w.piece[i])
                i = i[stay]
                h = _longer(h[stay], i, w.hashes, k)
                told, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(told.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return docs.mapInArrow(scan, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _sparse(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by place, in order of place."""
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    lead = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    return at[lead], np.add.reduceat(n, lead) if len(lead) else n


_ENTRY = np.dtype([("place", "<u2"), ("n", "<u2")])


def _packed(at: np.ndarray, n: np.ndarray, part: int) -> pa.RecordBatch:
    """Counts by place as one row for each block of 65,536 places."""
    block = at >> 16
    cuts = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(at)) if len(at) else np.zeros(1, np.int64)
    rows = np.empty(len(at), _ENTRY)
    rows["place"], rows["n"] = at & 0xFFFF, np.minimum(n, 0xFFFF)
    data = [rows[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array(np.full(len(data), part, np.int32)), pa.array(data, pa.binary())], ["block", "part", "data"])


_BLOCKS = "block int, part int, data binary"


def hot_pairs(docs: DataFrame, frequent, *, buckets: int, least: int) -> Bitmap | None:
    """Buckets that pairs of frequent words fill ``least`` times in all texts: a pair in another bucket can't be frequent.

    Tasks add up their buckets and send them packed, one row a block of buckets; blocks are added up 64 tasks at a time.
    None where counts of two bytes can't tell.
    """
    if least > 0xFFFF:
        return None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, task = [], 0, TaskContext.get().partitionId()
        for p in _parts(batches):
            w = p.words
            number, first, _ = _numbers(p.word * len(p.names) + p.code)
            ok = frequent.value.has(w.hashes[first])[number]
            i = np.flatnonzero(ok[:-1] & ok[1:] & (w.piece[:-1] == w.piece[1:]))
            at = (_longer(w.hashes[i], i, w.hashes, 2) & np.uint64(buckets - 1)).astype(np.int64)
            held.append(np.unique(at, return_counts=True))
            size += len(held[-1][0])
            if size > _PENDING:
                held = [_sparse(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > _PENDING // 2:
                    yield _packed(*held[0], task)
                    held, size = [], 0
        if held:
            yield _packed(*_sparse(*map(np.concatenate, zip(*held, strict=True))), task)

    def added(t: pa.Table) -> np.ndarray:
        sums = np.zeros(1 << 16, np.int64)
        for data in t["data"].to_pylist():
            rows = np.frombuffer(data, _ENTRY)
            sums[rows["place"]] += rows["n"]  # places of one row are distinct
        return sums

    def add(key: tuple, t: pa.Table) -> pa.Table:
        sums = added(t)
        at = np.flatnonzero(sums)
        out = _packed(at + (key[0].as_py() << 16), sums[at], key[1].as_py())
        return pa.Table.from_batches([out])

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        bits = np.packbits(added(t) >= least, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([bits], pa.binary())})

    sums = docs.mapInArrow(scan, _BLOCKS)
    tasks = docs.rdd.getNumPartitions()
    while tasks > 64:
        sums = sums.groupBy("block", F.floor(F.col("part") / 64).cast("int").alias("part")).applyInArrow(add, _BLOCKS)
        tasks = -(-tasks // 64)
    words = np.zeros(max(buckets, 1 << 16) // 8, np.uint8)
    for r in sums.groupBy("block").applyInArrow(judge, "block int, data binary").collect():
        words[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["data"], np.uint8)
    return Bitmap(words, buckets)


def count_border(docs: DataFrame, proposed, hot=None, before=None, *, longest: int) -> DataFrame:
    """Phrases whose two parts are proposed, and weren't both ``before``: proposals and negative border with exact counts.

    Pairs of words outside ``hot`` are known not to be frequent: they and what has them inside aren't counted.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches):
            w, word = p.words, p.word
            number, first, _ = _numbers(word * len(p.names) + p.code)
            wide = int(word.max()) + 1
            h = w.hashes
            of = np.zeros((2, len(word)), bool)  # which phrases of k - 1 words are proposed, and were before
            of[0] = proposed.value.has(h[first])[number]
            if before is not None:
                of[1] = before.value.has(h[first])[number]
            i = np.arange(len(word))
            for k in range(2, longest + 1):
                next_one, last = np.minimum(i + 1, len(word) - 1), np.minimum(i + k - 1, len(word) - 1)
                counted = (i + k - 1 < len(word)) & (w.piece[last] == w.piece[i]) & of[0][i] & of[0][next_one]
                known = (of[1][i] & of[1][next_one])[counted]
                i, h, number = i[counted], h[counted], number[counted]
                h = _longer(h, i, w.hashes, k)
                if k == 2 and hot is not None:
                    fits = hot.value.first(h)
                    i, h, number, known = i[fits], h[fits], number[fits], known[fits]
                number, first, n = _numbers(number * wide + word[i + k - 1])
                new = ~known[first]
                if new.any():
                    yield _counted(p, i[first][new], k, n[new])
                of = np.zeros((2, len(word)), bool)
                of[0][i] = proposed.value.has(h[first])[number]
                if before is not None:
                    of[1][i] = before.value.has(h[first])[number] & known

    return docs.mapInArrow(scan, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def marked(found: DataFrame, proposed=None) -> DataFrame:
    """Phrases with their words (k), hash (h) and whether that is proposed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            salt = spans.mix(np.array([hash_of(x) for x in lang.dictionary.to_pylist()], np.uint64))[lang.indices.to_numpy()]
            for c in spans.chunks(batch.column(1), _CHUNK):
                w = words_of(c)
                k = np.bincount(w.text, minlength=c.n)
                at = np.cumsum(k) - k
                own = w.hashes ^ salt[c.lo : c.lo + c.n][w.text]
                h = own[at]
                for n in range(2, int(k.max()) + 1):
                    more = k >= n
                    h[more] = _longer(h[more], at[more], own, n)
                part = batch.slice(c.lo, c.n)
                known = np.ones(c.n, bool) if proposed is None else proposed.value.has(h)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(k, pa.int32()), pa.array(h.view(np.int64)), pa.array(known)], ["lang", "phrase", "n", "k", "h", "proposed"])

    return found.select("lang", "phrase", "n").mapInArrow(mark, _COUNTED + ", k int, h long, proposed boolean")


def bitmap_of(hashes: DataFrame, bits: int, start: Bitmap | None = None) -> Bitmap:
    """The bitmap of all ``h``, made by an aggregation to buckets of 4 KB, of which there are bits / 32,768 at most."""
    mask = bits - 1
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    rows = places.groupBy(F.floor(F.col("p") / _BUCKET_BITS).alias("b")).agg(F.bitmap_construct_agg((F.col("p") % _BUCKET_BITS).cast("long")).alias("m")).collect()
    words = np.zeros(bits // 8, np.uint8) if start is None else start.words.copy()
    for r in rows:
        at = int(r["b"]) * (_BUCKET_BITS // 8)
        words[at : at + _BUCKET_BITS // 8] |= np.frombuffer(r["m"], np.uint8)
    return Bitmap(words, bits)


def frequent_phrases(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, sample_part: int = SAMPLE_PART, sample_least: int = SAMPLE_LEAST) -> tuple[DataFrame, DataFrame, int]:
    """All phrases of 1 to ``longest`` words with ``least`` occurrences in a language (lang, phrase, k, n), each language's
    words (lang, total), and how many passes followed the first full one."""
    spark = documents.sparkSession
    docs = documents.select(F.xxhash64(id_col).alias("seed"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stage(count_words(docs), "words")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = stage(marked(words.filter(F.col("n") >= least)), "frequent-words")
    discard(words)
    send = spark.sparkContext.broadcast
    bits = lambda n, each, most: min(most, max(_LEAST_BITS, 1 << max(1, n * each - 1).bit_length()))
    only_words = send(bitmap_of(frequent, bits(frequent.count(), _BITS_EACH, _MOST_BITS)))
    pairs = hot_pairs(docs, only_words, buckets=bits(totals.agg(F.sum("total")).first()[0] or 0, 1, _MOST_BUCKETS), least=least)
    hot = None if pairs is None else send(pairs)
    proposals = stage(count_sample(docs, only_words, part=sample_part, longest=longest).filter(F.col("n") >= sample_least).select("h"), "proposals")
    both = frequent.select("h").unionByName(proposals)
    proposed = send(bitmap_of(both, bits(both.count(), _BITS_EACH, _MOST_BITS)))
    only_words.destroy()
    discard(proposals)
    counted = lambda now, old=None: stage(marked(count_border(docs, now, hot, old, longest=longest).filter(F.col("n") >= least), now), "phrases")
    found, passes, before = [counted(proposed)], 0, None
    while True:
        failed = found[-1].filter((~F.col("proposed")) & (F.col("k") < longest))
        if failed.isEmpty():
            break
        passes += 1
        if before is not None:
            before.destroy()
        before, proposed = proposed, send(bitmap_of(failed, proposed.value.bits, proposed.value))
        found.append(counted(proposed, before))
    out = frequent.select("lang", "phrase", "k", "n")
    for x in found:
        out = out.unionByName(x.select("lang", "phrase", "k", "n"))
    return out, totals, passes


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)) of long columns: products have up to 38 digits, the quotient fits a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a * 1000) * wide(n)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, sample_part: int = SAMPLE_PART, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    found, totals, _ = frequent_phrases(documents, id_col=id_col, text_col=text_col, lang_col=lang_col, least=least, longest=longest, sample_part=sample_part, sample_least=sample_least)
    known = found.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("n").alias("of_n"))
    candidates = found.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    # a phrase goes with one that is a word longer; both ends of that one are candidates too
    word = F.split("phrase", " ")
    ends = candidates.filter("k >= 3").select("lang", F.explode(F.array_distinct(F.array(F.array_join(F.slice(word, 1, F.col("k") - 1), " "), F.array_join(F.slice(word, 2, F.col("k") - 1), " ")))).alias("of"), "a")
    around = ends.groupBy(F.col("lang").alias("of_lang"), "of").agg(F.max("a").alias("around"))
    kept = candidates.join(around, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("of")), "left").filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(word, 1, F.col("cut")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    for side in ("left", "right"):
        cuts = cuts.join(known, (F.col("lang") == F.col("of_lang")) & (F.col(side) == F.col("of")))
        cuts = cuts.withColumn("l" if side == "left" else "r", F.col("of_n")).drop("of_lang", "of", "of_n")
    total = totals.select(F.col("lang").alias("of_lang"), F.col("total").alias("n"))
    cuts = cuts.join(F.broadcast(total) if totals.count() <= _FEW_LANGUAGES else total, F.col("lang") == F.col("of_lang"))
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("n").alias("n"))
    ranked = best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
