"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over document token windows.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters. A window is ``n`` consecutive words
of one item; an item with fewer words (but not none) is one window of its own length. Window hashes find candidates;
each hit is verified on the words themselves. A document word inside any occurrence of a window is hit.

Defined results: null or empty texts have no words and no hits; null or word-less items have no windows; repeated
items all count, each under its own id; repeated documents give repeated rows; empty tables give empty or clean
results. Other columns of the documents are never read, whatever their names.

The broadcast set is bounded: ``max_broadcast_windows`` windows at most are sent at once. A larger benchmark is split
by items into as many blocks as it takes, two of which are on the driver at a time. Every block scans the texts as they came, and each row carries what earlier
blocks found in it, so results don't depend on the number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import spans
from .common import stage

_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if spans.ALNUM[b] else 32 for b in range(256))
_BITS = 22


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode().translate(_TO_WORDS).split()


def _window_hashes(grams: list[tuple[bytes, ...]], n: int) -> np.ndarray:
    column = pa.array([b" ".join(g).decode() for g in grams], pa.large_string())
    out = []
    for c in spans.chunks(column):
        s, e = c.runs(spans.ALNUM[c.data])
        out.append(spans.windows(c.hashes(s, e), c.offsets(s), n)[0])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class WindowSet:
    """Windows by length: a bitmap over hash prefixes, and the items of each exact window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, w in items:
            k = min(n, len(w))
            for i in range(len(w) - k + 1 if w else 0):
                found.setdefault(k, {}).setdefault(tuple(w[i : i + k]), set()).add(item)
        self.by_length = {}
        for k, grams in found.items():
            keys = list(grams)
            h = _window_hashes(keys, k)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[h >> np.uint64(64 - _BITS)] = True
            self.by_length[k] = (bitmap, np.sort(h), {g: sorted(grams[g]) for g in keys})


def find(texts: pa.Array, known: WindowSet) -> Iterator[tuple[np.ndarray, np.ndarray, list[set[str]], list[list[tuple[int, int]]]]]:
    """For each chunk of texts: words, hit words, the items found, and the hit byte spans of each text."""
    for c in spans.chunks(texts):
        low = c.folded()
        s, e = low.runs(spans.ALNUM[low.data])
        at = low.offsets(s)
        h = low.hashes(s, e)
        hit = np.zeros(len(s) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(c.n)]
        for k, (bitmap, sorted_hashes, grams) in known.by_length.items():
            wh, first = spans.windows(h, at, k)
            near = np.flatnonzero(bitmap[wh >> np.uint64(64 - _BITS)])
            near = near[sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, wh[near]), len(sorted_hashes) - 1)] == wh[near]]
            for i in first[near].tolist():
                gram = tuple(low.data[a:b].tobytes() for a, b in zip(s[i : i + k], e[i : i + k]))
                if gram in grams:
                    hit[i] += 1
                    hit[i + k] -= 1
                    items[int(np.searchsorted(at, i, "right")) - 1].update(grams[gram])
        hit = np.cumsum(hit[:-1]) > 0
        covered = np.concatenate([[0], np.cumsum(hit)])
        cut: list[list[tuple[int, int]]] = [[] for _ in range(c.n)]
        a, b = c.runs(hit) if len(hit) else (np.empty(0, int), np.empty(0, int))
        for i, j in zip(a.tolist(), b.tolist()):
            while i < j:  # a run of hit words can go on in the next text
                d = int(np.searchsorted(at, i, "right")) - 1
                stop = min(j, int(at[d + 1]))
                cut[d].append((int(s[i] - c.start[d]), int(e[stop - 1] - c.start[d])))
                i = stop
        yield np.diff(at), covered[at[1:]] - covered[at[:-1]], items, cut


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with an id in blocks of at most ``limit`` windows (an item by itself may exceed it), read as they are used; at least one block."""
    rows = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator()
    block: list[tuple[str, list[bytes]]] = []
    size, any_yet = 0, False
    for item, text in rows:
        w = words(text)
        k = max(1, len(w) - n + 1)
        if size and size + k > limit:
            yield block
            block, size, any_yet = [], 0, True
        block.append((item, w))
        size += k
    if block or not any_yet:
        yield block


_FOUND = "__found struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _union(text: str, old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that cover what either covers, sorted; spans without a word between them are one."""
    data = text.encode().translate(_TO_WORDS)
    out: list[tuple[int, int]] = []
    for a, b in sorted(old + new):
        if out and not data[out[-1][1] : a].strip():
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _count_words(text: str, cut: list[tuple[int, int]]) -> int:
    """Words inside of the spans, which begin and end with whole words."""
    data = text.encode().translate(_TO_WORDS)
    return sum(len(data[a:b].split()) for a, b in cut)


Found = tuple[list[int], list[int], list[list[str]], list[list[tuple[int, int]]]]


def _scanned(docs: DataFrame, benchmark: DataFrame, finish: Callable[[list[pa.Array], Found], pa.RecordBatch], schema: StructType, *, text_col: str, item_col: str, item_text_col: str, n: int, limit: int) -> DataFrame:
    """What ``finish`` makes of some documents' columns and of their n_words, n_hit, items and spans.

    Every block scans the whole texts; what a row has from earlier blocks goes along with it and is united with the
    new block's, so neither ids nor the order of blocks matter. Tables between two blocks are staged. The last block's
    pass also does the finishing, so a task has one Python worker.
    """
    spark = docs.sparkSession
    names, at = docs.columns, docs.columns.index(text_col)
    out, wide = docs, StructType([*docs.schema.fields, *StructType.fromDDL(_FOUND).fields])
    blocks = _blocks(benchmark, item_col, item_text_col, n, limit)
    block = next(blocks)
    first = True
    while block is not None:
        following = next(blocks, None)
        last = following is None
        known = spark.sparkContext.broadcast(WindowSet(block, n))

        def scan(batches: Iterator[pa.RecordBatch], known=known, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    column = part.column(at)
                    total, hits, found, cuts = [], [], [], []
                    for w, k, i, x in find(column, known.value):
                        total += w.tolist()
                        hits += k.tolist()
                        found += [sorted(y) for y in i]
                        cuts += x
                    if not first:
                        for r, was in enumerate(part.column(len(names)).to_pylist()):
                            if not was["items"]:
                                continue
                            before = [(y["start"], y["end"]) for y in was["spans"]]
                            if not found[r]:
                                hits[r], found[r], cuts[r] = was["n_hit"], was["items"], before
                                continue
                            found[r] = sorted({*was["items"], *found[r]})
                            text = column[r].as_py()
                            cuts[r] = _union(text, before, cuts[r])
                            hits[r] = _count_words(text, cuts[r])
                    if last:
                        yield finish(part.columns[: len(names)], (total, hits, found, cuts))
                        continue
                    cut = pa.array([[{"start": a, "end": b} for a, b in x] for x in cuts], _SPANS)
                    both = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), cut], ["n_words", "n_hit", "items", "spans"])
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], both], [*names, "__found"])

        out = out.mapInArrow(scan, schema if last else wide)
        if not last:
            out, first = stage(out, "decontaminated"), False
        block = following
    return out


def occurrences(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (sorted array of item ids), spans (byte spans of hit words).

    ``benchmark`` is read through the driver in blocks: the windows of one block are all that is held or sent at a
    time. With more than one block, the documents are scanned once for each block.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def finish(columns: list[pa.Array], found: Found) -> pa.RecordBatch:
        total, hits, items, cuts = found
        cut = pa.array([[{"start": a, "end": b} for a, b in x] for x in cuts], _SPANS)
        return pa.RecordBatch.from_arrays([columns[0], pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), cut], ["id", "n_words", "n_hit", "items", "spans"])

    schema = StructType([docs.schema["id"], *StructType.fromDDL(_FOUND).fields[0].dataType.fields])
    return _scanned(docs, benchmark, finish, schema, text_col="text", item_col=item_col, item_text_col=item_text_col, n=n, limit=max_broadcast_windows)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, action: str = "spans", id_col: str = "doc_id", text_col: str = "text", max_hit_share: float = 0.5, n: int = 10, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """The documents with benchmark text taken out, all their columns as they are.

    ``action="documents"`` drops every document with a hit. ``action="spans"`` cuts the hit spans out of the text
    and drops a document only if more than ``max_hit_share`` of its words are hit, or nothing is left. Both judge a
    document once, by the hits of the whole benchmark in the text as it came.
    """
    names, at = documents.columns, documents.columns.index(text_col)

    def clean(columns: list[pa.Array], found: Found) -> pa.RecordBatch:
        keep, texts = [], []
        for text, total, hits, _, cuts in zip(columns[at], *found):
            text = text.as_py()
            if hits:
                data, left, last = text.encode(), [], 0
                for a, b in cuts:
                    left.append(data[last:a])
                    last = b
                text = b"".join([*left, data[last:]]).decode()
            keep.append(not hits or (action == "spans" and hits <= max_hit_share * total and bool(text.strip())))
            texts.append(text)
        columns = [*columns[:at], pa.array(texts, columns[at].type), *columns[at + 1 :]]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return _scanned(documents, benchmark, clean, documents.schema, text_col=text_col, item_col="item_id", item_text_col="text", n=n, limit=max_broadcast_windows)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``occurrences`` for a result table."""
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """Plain Python version of ``digest(occurrences(...))`` for small tests."""
    out = []
    for doc, text in documents:
        w, hit, seen = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    seen.add(str(item))
                    hit.update(range(i, i + k))
        out.append((doc, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return out
