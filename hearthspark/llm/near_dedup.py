"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A document's set is its distinct shingles of ``shingle`` lower-cased words (64-bit hashes of whole shingles). A
signature has 32 symbols of 16 bits, each cut from one minimum hash; two signatures' distance is the number of
differing symbols. Seven chunks of the signature allow 13 differing symbols only if some chunk has at most one, so
one key for each chunk and each symbol left out of it (32 keys a document) makes every pair of distance 13 or less meet under
some key. Pairs that meet are verified on the full sets.

Copies with equal sets are one class with one representative. A representative can link only if other candidates have
``percent`` of its shingles; those that can't are done. Under each key the rest are compared with one pivot, the one
with the smallest share of shingles of its own. Two that met the same pivot and aren't known to be connected are
compared with each other only if that can give a link: either what each has in common with the pivot is enough, or they
share a shingle that the pivot doesn't have, by which they are then joined. So a group of near copies costs about one
comparison a member, and no link that joins two components is left out. Sets are compared as 64-bit hashes of their
shingles; two different shingles of a pair have equal hashes with a chance of about one in 10^13 for texts of 1,000 words.

Defined results: null, empty and word-less texts have no shingles and stand alone; a text with fewer words than a
shingle is one shingle; ids identify documents, so repeated rows of one id share its component; rows without an id get
the component of the documents with an equal set and aren't kept beside them, and without such documents they stand
alone, kept, with a null component; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import spans
from .common import discard, stage

SYMBOLS, SYMBOL_BYTES = 32, 2
#: Symbols of each chunk; with MAX_DISTANCE differing symbols, one of the chunks has at most one of them.
CHUNKS = (5, 5, 5, 5, 4, 4, 4)
MAX_DISTANCE = 13
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, SYMBOLS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_DOC = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(c: spans.Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk's texts (not yet distinct), and the text of each; sorted by text."""
    low = c.folded()
    s, e = low.runs(spans.NOT_SPACE[low.data])
    at = low.offsets(s)
    h = low.hashes(s, e)
    out, first = spans.windows(h, at, shingle)
    doc = np.searchsorted(at, first, "right") - 1
    count = np.diff(at)
    few = np.flatnonzero((count > 0) & (count < shingle))
    if len(few):
        more = []
        for d in few.tolist():
            k = int(count[d])
            more.append(spans.windows(h[at[d] : at[d + 1]], np.array([0, k]), k)[0][0] ^ np.uint64(k))
        out, doc = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def _signatures(c: spans.Chunk, shingle: int) -> list[pa.Array]:
    h, doc = shingle_hashes(c, shingle)
    at = np.searchsorted(doc, np.arange(c.n + 1))
    first = np.zeros(len(h), bool)
    first[np.unique(spans.mix(h + doc.astype(np.uint64) * _DOC), return_index=True)[1]] = True
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(first, spans.mix(h ^ np.uint64(salt)), np.uint64(0)), dtype=np.uint64)])
        sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    n = np.concatenate([[0], np.cumsum(first)])
    n = n[at[1:]] - n[at[:-1]]
    full = np.flatnonzero(n)
    signature = np.zeros((c.n, SYMBOLS), np.uint16)
    if len(full):
        for k, a in enumerate(_FACTORS):
            signature[full, k] = spans.mix(np.minimum.reduceat(h * a, at[:-1][full])).astype(np.uint16)
    raw = signature.tobytes()
    width = SYMBOLS * SYMBOL_BYTES
    return [pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())]


def signatures(documents: DataFrame, *, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_a and set_b (128 bits that equal sets share) and signature (32 symbols of two bytes)."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in spans.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), *_signatures(c, shingle)], ["id", "n_shingles", "set_a", "set_b", "signature"])
            spans.give_back()

    return docs.mapInArrow(scan, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, set_a long, set_b long, signature binary")


def _variants(signature: str) -> list[Column]:
    """The parts of a signature that make its keys: each chunk without one of its symbols."""
    out, at = [], 0
    for size in CHUNKS:
        for gone in range(size):
            start = 1 + SYMBOL_BYTES * at
            before = F.substring(signature, start, SYMBOL_BYTES * gone)
            after = F.substring(signature, start + SYMBOL_BYTES * (gone + 1), SYMBOL_BYTES * (size - gone - 1))
            out.append(F.concat(before, after))
        at += size
    return out


def keys(signature: str = "signature") -> Column:
    """One key for each chunk of the signature and each symbol left out of it."""
    return F.array(*(F.xxhash64(F.lit(k), v) for k, v in enumerate(_variants(signature))))


def set_table(documents: DataFrame, *, shingle: int) -> DataFrame:
    """id, n and hashes (sorted 64-bit hashes of the distinct shingles, 8 bytes each) of ``documents`` (id, text)."""
    kind = documents.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in spans.chunks(batch.column(1), 1 << 20):
                h, doc = shingle_hashes(c, shingle)
                at = np.searchsorted(doc, np.arange(c.n + 1))
                found = [np.unique(h[at[i] : at[i + 1]]) for i in range(c.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "n", "hashes"])
            spans.give_back()

    return documents.select("id", "text").mapInArrow(scan, f"id {kind}, n long, hashes binary")


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def verify(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """a, b, n_a, n_b, both (size of the intersection of their full sets), linked (100 * intersection >= percent * union)
    and beside (hashes of the shingles of a that b doesn't have)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, left = [], [], []
            for x, y in zip(map(_set, batch.column(2)), map(_set, batch.column(3))):
                n_a.append(len(x))
                n_b.append(len(y))
                left.append(np.setdiff1d(x, y, assume_unique=True).tobytes())
            n_a, n_b, rest = (np.array(v, np.int64) for v in (n_a, n_b, [len(v) // 8 for v in left]))
            both = n_a - rest
            linked = (both > 0) & (100 * both >= percent * (n_a + n_b - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n_a, n_b, both, linked)), pa.array(left, pa.binary())], ["a", "b", "n_a", "n_b", "both", "linked", "beside"])
            spans.give_back()

    kind = pairs.schema["a"].dataType.simpleString()
    a, b = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"set_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, f"a {kind}, b {kind}, n_a long, n_b long, both long, linked boolean, beside binary")


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """A row for each hash of the binary ``column``, which gets that hash instead."""
    names = [c for c in rows.columns if c != column]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [_set(x) for x in part.column(len(names))]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns[:-1]), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))], [*names, column])
            spans.give_back()

    ordered = rows.select(*names, column)
    return ordered.mapInArrow(explode, StructType([*ordered.schema.fields[:-1], StructField(column, LongType())]))


def shared_sizes(sets: DataFrame) -> DataFrame:
    """id, n and c: how many of a document's distinct shingles another of these documents has as well."""
    each = exploded(sets.select("id", F.col("hashes").alias("h")), "h")
    alone = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other").groupBy("id").agg(F.count("*").alias("alone"))
    return sets.select("id", "n").join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """A staged table of ids, broadcast where a count shows that it is small, and joined by a shuffle beyond that."""
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, *, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """id and component (the smallest id reachable) of every end of an edge.

    Each round gives every node the smallest label around it, then the label of that label, until nothing changes; rounds are staged.
    """
    near = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    table = state = stage(near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "components")
    while True:
        known = _bounded(state, max_broadcast_ids)
        hooked = near.join(known.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        hooked = hooked.join(known.withColumnRenamed("component", "was"), "id").withColumn("m", F.least("m", "was"))
        up = known.select(F.col("id").alias("m"), F.col("component").alias("up"))
        after = stage(hooked.join(up, "m").select("id", F.least("m", "up").alias("component"), "was"), "components")
        settled = not after.filter("component < was").head(1)
        discard(table)
        table, state = after, after.select("id", "component")
        if settled:
            discard(near)
            return state


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per document.

    ``max_broadcast_ids`` bounds the ids that are broadcast to fetch sets and labels; larger tables are joined by a
    shuffle, with the same result.
    """
    found = stage(signatures(documents, shingle=shingle, id_col=id_col, text_col=text_col), "signatures")
    # rows without an id are members that never represent, so that no key or candidate is lost in joins on ids
    shingled = found.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = stage(shingled.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("id", "signature")).alias("x")).select("set_a", "set_b", "n_shingles", "x.*"), "classes")
    by_class = classes.select("set_a", "set_b", "n_shingles", "id")
    links = _class_links(classes, documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, percent, max_broadcast_ids)
    state = _bounded(components(links, max_broadcast_ids=max_broadcast_ids), max_broadcast_ids)
    by_class = by_class.join(state, "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component"))
    out = found.select("id", "n_shingles", "set_a", "set_b").join(by_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce("component", "id")  # null where only rows without an id have the set
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _class_links(classes: DataFrame, docs: DataFrame, shingle: int, percent: int, most: int) -> DataFrame:
    """a and b of enough links between representatives to connect all that any pair under one key connects."""
    keyed = classes.select("id", F.explode(keys()).alias("key"))
    # staged, so that the next join has a plain shuffle on either side and Spark can split a hot key
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "shared")
    members = stage(keyed.join(shared, "key").select("key", "id"), "members")
    discard(shared)
    nodes = stage(members.select("id").distinct(), "nodes")
    sets = stage(set_table(docs.join(_bounded(nodes, most), "id", "left_semi"), shingle=shingle), "sets")
    if sets.count() > nodes.count():  # repeated rows
        sets = stage(sets.dropDuplicates(["id"]), "sets")
    discard(nodes)
    # a link needs percent of a document's shingles in other documents
    live = stage(shared_sizes(sets).filter(100 * F.col("c") >= percent * F.col("n")), "live")
    members = stage(members.join(_bounded(live, most), "id"), "members")
    sets = sets.join(_bounded(live.select("id"), most), "id", "left_semi")
    # the pivot of a key is the member with the smallest share of shingles of its own: what it was copied from, or near it
    pivots = members.groupBy("key").agg(F.min(F.struct((1 - F.col("c") / F.col("n")).alias("own"), "id")).alias("x"), F.count("*").alias("m")).filter("m > 1")
    pivots = stage(pivots.select("key", F.col("x.id").alias("pivot")), "pivots")
    star = stage(members.join(pivots, "key").filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "star")
    star = stage(verify(star, sets, percent=percent), "compared")
    links = star.filter("linked").select("a", "b")
    # a label is a document's smallest pivot, or that one's: equal labels are connected, so such pairs need no comparison
    first = stage(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    first = _bounded(first, most)
    up = first.select(F.col("id").alias("label"), F.col("label").alias("up"))
    met = star.join(first.withColumnRenamed("id", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    met = met.join(up, "label", "left").join(_bounded(live.select(F.col("id").alias("a"), "c"), most), "a")
    # o: shingles that the pivot doesn't have and someone else has
    met = met.select("a", "b", F.col("n_a").alias("n"), F.col("both").alias("h"), (F.col("c") - F.col("both")).alias("o"), "linked", F.col("beside").alias("x"), F.coalesce("up", "label").alias("label"))
    # pivots with someone left who isn't linked, and someone to link with
    open_pivots = met.groupBy("b").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("out"), F.min("n").alias("least")).filter("m > 1 AND out > 0")
    open_pivots = stage(open_pivots.select("b", "least"), "open")
    if not open_pivots.head(1):
        return links
    met = stage(met.join(_bounded(open_pivots, most), "b"), "met")
    theirs = met.select("b", *(F.col(c).alias(d) for c, d in _OTHER.items()))
    # two that share only what the pivot has share at most the smaller of what each has in common with it
    limit = F.floor(100 * F.col("h") / percent) + F.col("h") - F.col("n")
    risky = met.filter(~F.col("linked") & (limit >= F.col("least")))
    pairs = risky.join(theirs, "b").filter(_apart(F.least("h", "h2"), percent)).select("a", "a2")
    # those that share something beside it meet there
    extra = stage(exploded(met.drop("least"), "x"), "beside")
    more = F.least("h", "h2") + F.least("o", "o2")
    other = extra.select("b", "x", *(F.col(c).alias(d) for c, d in _OTHER.items()))
    pairs = pairs.union(extra.join(other, ["b", "x"]).filter((F.col("a") < F.col("a2")) & _apart(more, percent)).select("a", "a2"))
    pairs = stage(pairs.select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b")).distinct(), "pairs")
    discard(met, extra)
    return links.union(stage(verify(pairs, sets, percent=percent).filter("linked").select("a", "b"), "links"))


_OTHER = {"a": "a2", "n": "n2", "h": "h2", "o": "o2", "linked": "linked2", "label": "label2"}


def _apart(shared: Column, percent: int) -> Column:
    """Two that met the same pivot, aren't known to be connected, and can be a link if they share at most ``shared``."""
    return (F.col("label") != F.col("label2")) & ~(F.col("linked") & F.col("linked2")) & (100 * shared >= percent * (F.col("n") + F.col("n2") - shared))


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", max_broadcast_ids: int = 1_000_000, **how) -> DataFrame:
    """The documents, all columns as they are, without those that another document of their group stands for.

    Of rows with one id, which is one document, one stays. Rows without an id go where a document has an equal set, and
    of those with equal sets one stays.
    """
    if documents.filter(F.col(id_col).isNull()).head(1):
        named, nameless = documents.filter(F.col(id_col).isNotNull()), documents.filter(F.col(id_col).isNull())
        left = drop_near_duplicates(named, id_col=id_col, max_broadcast_ids=max_broadcast_ids, **how)
        return left.unionByName(_nameless_left(named, nameless, id_col=id_col, **{k: v for k, v in how.items() if k in ("shingle", "text_col")}))
    verdicts = stage(near_duplicates(documents, id_col=id_col, max_broadcast_ids=max_broadcast_ids, **how).select(F.col("doc_id").alias(id_col), "kept"), "verdicts")
    gone = verdicts.filter(~F.col("kept")).select(id_col).distinct()
    out = documents.join(F.broadcast(gone) if gone.count() <= max_broadcast_ids else gone, id_col, "left_anti").select(documents.columns)
    repeated = verdicts.filter("kept").groupBy(id_col).agg(F.count("*").alias("rows")).filter("rows > 1").select(id_col)
    if not repeated.head(1):
        return out
    return out.join(repeated, id_col, "left_anti").select(documents.columns).unionByName(out.join(repeated, id_col, "left_semi").dropDuplicates([id_col]).select(documents.columns))


def _nameless_left(named: DataFrame, nameless: DataFrame, *, id_col: str, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """Of the rows without an id, one of each set that no document with an id has, and all that have no shingles."""
    sets = ["__n", "__a", "__b"]
    names, at = nameless.columns, nameless.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in spans.chunks(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, c.n).columns, *_signatures(c, shingle)[:3]], [*names, *sets])

    schema = StructType([*nameless.schema.fields, *(StructField(x, LongType()) for x in sets)])
    found = stage(nameless.mapInArrow(scan, schema), "nameless")
    known = signatures(named, shingle=shingle, id_col=id_col, text_col=text_col).select(F.col("n_shingles").alias("__n"), F.col("set_a").alias("__a"), F.col("set_b").alias("__b"))
    own = found.filter("__n > 0").dropDuplicates(sets).join(known, sets, "left_anti")
    return found.filter("__n = 0").select(names).unionByName(own.select(names))


def brute_force(documents: list[tuple], shingle: int, percent: int) -> list[tuple]:
    """All pairs in plain Python, for small tests."""
    sets = []
    for d, text in documents:
        w = [x.decode() for x in (text or "").encode().translate(bytes(spans.LOWER)).split()]
        k = min(shingle, len(w))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    up = {d: d for d, _ in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return [(d, len(x), top(d), top(d) == d) for d, x in sets]
