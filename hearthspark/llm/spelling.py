"""Spelling variants: the vocabulary's minimal acceptor composed with a one-edit transducer and the acceptor again.

Words are maximal runs of ASCII and Latin-1 letters, A-Z lower-cased; a run whose checksum with its document's id is
divisible by 31 loses the code point that the checksum chooses (noise that the contract asks for). Two words are near
if one edit (a code point inserted, deleted or replaced) makes one of the other.

One edit leaves either the first or the last half of a word as it is. Words are therefore dealt by initial states: the
state that the acceptor (or, for the other half, the acceptor of the reversed words) reaches after that half. A word of
length L has the band L // 2 and lies in four partitions: by its first and by its last half in its band, and so again
with the band next to it, where only insertions count. In each task the partitions' rests make one minimal acceptor
with an initial state each; its composition with the transducer and itself is enumerated breadth-first from all initial
states together. Acceptance gives the places of both words among the sorted rests (each state knows how many rests it
accepts), and a task passes on one row a word, not the pairs.

Partitions of more than ``most`` words are divided: by the state one letter further on for edits behind that letter,
and by all that follows the letter for edits of the letter itself (a partition of at most as many words as letters).
This goes on until none is too large, so no task holds a hot partition.

Forms have at least ten times the occurrences of their words, so chains are short; they are followed by joins.

Defined results: null texts have no words; a null id counts as an empty one in the checksum; repeated rows count each;
very long runs are words like others; empty tables give no words. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import stage

LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO, NOISE = 7, 2, 10, 31
#: Largest partition that one task composes.
MOST_WORDS = 100_000
#: Words, and bytes of padded rests, of the partitions that share an acceptor.
_BUFFER_WORDS, _BUFFER_BYTES = 60_000, 32 << 20
_STEP = 1 << 20
_LETTER = spans.byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))
_CHUNK = 2 << 20


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


# words


def _checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, carried on from ``first``: a byte of all spans at a time, and long spans one by one."""
    n = stop - start
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-n, kind="stable")
    order, far = order[n[order] <= 64], order[n[order] > 64]
    for i in far:
        out[i] = zlib.crc32(data[start[i] : stop[i]].tobytes(), int(first[i]))
    state, at, size = first[order] ^ np.uint32(0xFFFFFFFF), start[order], n[order]
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -j, "left"))
        s = state[:m]
        state[:m] = _CRC[(s ^ data[at[:m] + j]) & 255] ^ (s >> 8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(c: spans.Chunk, ids: list[str], *, least: int, noise: int) -> pa.Array:
    """Words of at least ``least`` code points of a chunk's texts, after noise, as Latin-1 bytes."""
    data = spans.LOWER[c.data]
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    s, e = c.runs(_LETTER[data] | lead | after)
    points = np.concatenate([[0], np.cumsum(~after)])
    n = points[e] - points[s]
    long = n >= least
    s, e, n = s[long], e[long], n[long]
    doc = np.searchsorted(c.start, s, "right") - 1
    h = _checksums(data, s, e, np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[doc])
    mask = np.zeros(len(data) + 1, np.int8)
    mask[s] = 1
    mask[e] -= 1
    kept = (np.cumsum(mask[:-1], dtype=np.int8) > 0) & ~lead
    latin = (data + (after * np.uint8(0x40)))[kept]
    at = np.concatenate([[0], np.cumsum(n)])
    hit = h % noise == 0
    keep = np.ones(len(latin), bool)
    keep[at[:-1][hit] + h[hit] % n[hit]] = False
    n = n - hit
    latin, at = latin[keep], np.concatenate([[0], np.cumsum(n)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(latin.tobytes())])
    return found.filter(pa.array(n >= least))


def to_latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of words as Latin-1, from UTF-8 strings of such letters."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(column) else np.empty(0, np.uint8)
    at = at - at[0]
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    points = np.concatenate([[0], np.cumsum(~lead)])
    return (data + after * np.uint8(0x40))[~lead], points[at]


def vocabulary(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """word and n of all words of all texts; counted in each chunk before anything is shuffled."""
    docs = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in spans.chunks(batch.column(1), _CHUNK):
                found = words_of(c, ids[c.lo : c.lo + c.n], least=least_length, noise=noise).dictionary_encode()
                counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.binary()), pa.array(counts, pa.int64())], ["latin", "n"])

    counted = docs.mapInArrow(scan, "latin binary, n long").groupBy("latin").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count).select(F.decode("latin", "ISO-8859-1").alias("word"), "n")


# partitions


def partitions(words: DataFrame) -> DataFrame:
    """Each word in its four partitions: part, rest (what follows the half that is kept), word, n, head, subst, base and twice.

    ``head`` is the first half where the last one is kept: two words with equal heads have met by their first halves.
    ``base`` is true in one of a word's rows.
    """
    size = F.char_length("word")
    own, odd = F.floor(size / 2).cast("int"), size % 2 == 1
    other = F.when(odd, own).otherwise(own - 1)  # lengths 2b + 1 and 2b + 2

    def row(name: str, band, kept, front: bool):
        key = F.substring("word", F.lit(1), kept) if front else F.right("word", kept)
        rest = F.right("word", size - kept) if front else F.reverse(F.left("word", size - kept))
        head = F.lit(None).cast("string") if front else F.left("word", band)
        return F.struct(F.concat(F.lit(name), band.cast("string"), F.lit(":"), key).alias("part"), rest.alias("rest"), head.alias("head"), F.lit(name[0] == "A").alias("subst"), F.lit(name == "Af").alias("base"), F.lit(False).alias("twice"))

    rows = [row("Af", own, own, True), row("Al", own, own, False), row("Bf", other, other, True), row("Bl", other, other + 2, False)]
    return words.select("word", "n", F.inline(F.array(*rows)))


def divide(parts: DataFrame, most: int) -> DataFrame:
    """The partitions with every one of more than ``most`` words divided by its next states, until none is too large."""
    settled: list[DataFrame] = []
    current = parts
    while True:
        sizes = current.groupBy("part").agg(F.count("*").alias("size"), F.max(F.char_length("rest")).alias("longest")).filter((F.col("size") > most) & (F.col("longest") > 0))
        hot = stage(sizes.select(F.col("part").alias("hot")), "hot-states")
        if hot.isEmpty():
            break
        marked = stage(current.join(hot, F.col("part") == F.col("hot"), "left"), "divided")
        settled.append(marked.filter("hot is null").drop("hot"))
        large = marked.filter("hot is not null").drop("hot")
        first, tail = F.left("rest", F.lit(1)), F.substring("rest", F.lit(2), F.char_length("rest"))
        further = large.filter("rest <> ''").withColumn("part", F.concat("part", F.lit("+"), first)).withColumn("rest", tail)
        ended = large.filter("rest = ''").withColumn("part", F.concat("part", F.lit("+")))
        here = large.withColumn("base", F.lit(False))
        changed = here.filter("rest <> ''").withColumn("twice", first == F.left(tail, F.lit(1))).withColumn("part", F.concat("part", F.lit("|"), tail)).withColumn("rest", first)
        shorter = here.withColumn("part", F.concat("part", F.lit("|"), F.col("rest"))).withColumn("rest", F.lit(""))
        settled += [changed, shorter]
        current = further.unionByName(ended)
    out = current
    for x in settled:
        out = out.unionByName(x)
    return out


# the acceptor


class Acceptor:
    """The minimal acyclic acceptor of sorted rests, with an initial state for each partition.

    States are numbered; ``first``, ``label`` and ``to`` are their edges in order of state and label; ``skip`` is how
    many rests of a state come before those of an edge; ``size`` is how many rests a state accepts.
    """

    def __init__(self, rests: np.ndarray, length: np.ndarray, part: np.ndarray):
        """``rests``: padded bytes, sorted by partition and rest; ``part``: their partitions' numbers, without gaps."""
        n, wide = rests.shape
        same = np.zeros(n, np.int64)  # letters shared with the row before, and -1 in a new partition
        same[0] = -1
        if n > 1:
            differs = np.concatenate([rests[1:] != rests[:-1], np.ones((n - 1, 1), bool)], axis=1)
            same[1:] = np.where(part[1:] == part[:-1], np.minimum(differs.argmax(axis=1), np.minimum(length[1:], length[:-1])), -1)
        # nodes of the tree, level by level: each has the first of its rows, and how far down the longest rest below it goes
        first_row, height, node_of = [], [], []
        for d in range(wide + 1):
            new = np.flatnonzero((length >= d) & (same < d))
            first_row.append(new)
            rows = np.flatnonzero(length >= d)
            at = np.searchsorted(new, rows, "right") - 1
            node_of.append((rows, at))
            height.append(np.maximum.reduceat(length[rows] - d, np.searchsorted(rows, new)) if len(new) else np.empty(0, np.int64))
        offset = np.cumsum([0] + [len(x) for x in first_row])
        level = np.repeat(np.arange(wide + 1), [len(x) for x in first_row])
        row, tall = np.concatenate(first_row), np.concatenate(height)
        total = len(row)
        parent, letter = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        for d in range(1, wide + 1):
            if len(first_row[d]):
                rows, at = node_of[d - 1]
                parent[offset[d] : offset[d + 1]] = offset[d - 1] + at[np.searchsorted(rows, first_row[d])]
                letter[offset[d] : offset[d + 1]] = rests[first_row[d], d - 1]
        final = length[row] == level
        children = np.flatnonzero(parent >= 0)
        children = children[np.lexsort((letter[children], parent[children]))]
        degree = np.bincount(parent[children], minlength=total)
        begin = np.concatenate([[0], np.cumsum(degree)])
        # equal states have equal heights: from the leaves up, each height's nodes are told apart by their edges
        state = np.full(total, -1, np.int64)
        chosen: list[np.ndarray] = []
        known = 0
        by_height = np.argsort(tall, kind="stable")
        edges_of_height = np.concatenate([[0], np.cumsum(np.bincount(tall, minlength=1))])
        for h in range(len(edges_of_height) - 1):
            nodes = by_height[edges_of_height[h] : edges_of_height[h + 1]]
            if not len(nodes):
                continue
            _, code = np.unique(degree[nodes] * 2 + final[nodes], return_inverse=True)
            for k in range(int(degree[nodes].max())):
                has = np.flatnonzero(degree[nodes] > k)
                child = children[begin[nodes[has]] + k]
                key = (code[has] * 256 + letter[child]) * (known + 1) + state[child]
                _, told = np.unique(key, return_inverse=True)
                code[has] = told + (k + 1) * len(nodes)  # nodes without a k-th edge keep codes below these
            _, pick, told = np.unique(code, return_index=True, return_inverse=True)
            state[nodes] = known + told
            chosen.append(nodes[pick])
            known += len(pick)
        rep = np.concatenate(chosen)
        self.n = known
        self.final = final[rep]
        self.degree = degree[rep]
        self.first = np.concatenate([[0], np.cumsum(self.degree)])
        edges = children[np.repeat(begin[rep], self.degree) + _ramp(self.degree)]
        self.label, self.to = letter[edges], state[edges]
        self.size = np.zeros(known, np.int64)
        self.skip = np.zeros(len(edges), np.int64)
        owner = np.repeat(np.arange(known), self.degree)
        at = 0
        for nodes in chosen:  # sizes of a height need those of lower ones
            lo, hi = at, at + len(nodes)
            a, b = self.first[lo], self.first[hi]
            below = np.concatenate([[0], np.cumsum(self.size[self.to[a:b]])])
            start = below[self.first[lo:hi] - a]
            self.skip[a:b] = below[:-1] - start[owner[a:b] - lo] + self.final[owner[a:b]]
            self.size[lo:hi] = below[self.first[lo + 1 : hi + 1] - a] - start + self.final[lo:hi]
            at = hi
        self.key = owner * 256 + self.label
        self.initial = state[: len(first_row[0])]
        self.initial_row = first_row[0]
        shared = np.zeros(known, np.uint64)
        np.bitwise_or.at(shared, owner, np.uint64(1) << (self.label % 63).astype(np.uint64))
        self.shared = shared | (self.final.astype(np.uint64) << np.uint64(63))

    def could_meet(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """False only if no rest is accepted from both states."""
        return (self.shared[p] & self.shared[q]) != 0


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _slices(weight: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose weights sum to about ``_STEP`` at most."""
    total = np.cumsum(weight)
    lo = 0
    while lo < len(weight):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _STEP, "right")))
        yield slice(lo, hi)
        lo = hi


def compose(a: Acceptor, replaces: np.ndarray) -> np.ndarray:
    """Pairs of rows (two columns, each pair once) that acceptor, one-edit transducer and acceptor accept together.

    ``replaces`` says for each initial state whether the transducer may replace a letter; it may always insert one.
    """
    found: list[np.ndarray] = []

    def follow(p, i, q, j, put=None) -> None:
        """After the edit both sides read the same letters. A letter that was put in isn't followed by the same one: the last place of a run counts."""
        while len(p):
            meet = a.could_meet(p, q)
            p, i, q, j, put = p[meet], i[meet], q[meet], j[meet], None if put is None else put[meet]
            both = a.final[p] & a.final[q]
            if both.any():
                found.append(np.stack([i[both], j[both]], axis=1))
            turn = a.degree[p] > a.degree[q]
            small, large = np.where(turn, q, p), np.where(turn, p, q)
            row = np.repeat(np.arange(len(p)), a.degree[small])
            e = a.first[small][row] + _ramp(a.degree[small])
            want = large[row] * 256 + a.label[e]
            g = np.minimum(np.searchsorted(a.key, want), max(0, len(a.key) - 1))
            ok = a.key[g] == want if len(e) else np.zeros(0, bool)
            if put is not None:
                ok &= a.label[e] != put[row]
                put = None
            row, e, g = row[ok], e[ok], g[ok]
            pe, qe = np.where(turn[row], g, e), np.where(turn[row], e, g)
            p, q, i, j = a.to[pe], a.to[qe], i[row] + a.skip[pe], j[row] + a.skip[qe]

    p, i, may = a.initial, a.initial_row, replaces
    while len(p):
        d = a.degree[p]
        for part in _slices(d * (d + 1) // 2 + 1):
            ps, ix, ds = p[part], i[part], d[part]
            row = np.repeat(np.arange(len(ps)), ds)
            e = a.first[ps][row] + _ramp(ds)
            meet = a.could_meet(ps[row], a.to[e])
            r, x = row[meet], e[meet]
            follow(ps[r], ix[r], a.to[x], ix[r] + a.skip[x], a.label[x])  # a letter is inserted
            later = np.where(may[part][row], ds[row] - 1 - _ramp(ds), 0)
            r, x = np.repeat(row, later), np.repeat(e, later)
            y = x + 1 + _ramp(later)
            meet = a.could_meet(a.to[x], a.to[y])
            r, x, y = r[meet], x[meet], y[meet]
            follow(a.to[x], ix[r] + a.skip[x], a.to[y], ix[r] + a.skip[y])  # a letter is replaced
        row = np.repeat(np.arange(len(p)), d)
        e = a.first[p][row] + _ramp(d)
        p, i, may = a.to[e], i[row] + a.skip[e], may[row]
    if not found:
        return np.empty((0, 2), np.int64)
    pairs = np.sort(np.concatenate(found), axis=1)
    wide = int(pairs.max()) + 1
    return np.stack(np.divmod(np.unique(pairs[:, 0] * wide + pairs[:, 1]), wide), axis=1)


def _padded(column: pa.Array, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bytes of ``before`` and the Latin-1 bytes of each string, padded with zeros; and the strings' lengths."""
    data, at = to_latin(column)
    n = np.diff(at)
    out = np.zeros((len(n), 4 + max(1, int(n.max()))), np.uint8)
    out[:, :4] = before.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[np.repeat(np.arange(len(n)), n), 4 + _ramp(n)] = data
    return out, n


def near_in(parts: pa.Table) -> pa.Table:
    """For each word of whole partitions: how many near ones it has there, and which of them has the largest n.

    Words that are alone in their partition are near to none there and stay out of the acceptor.
    """
    base = parts.filter(parts["base"])
    part = parts["part"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    met = np.bincount(part)[part] > 1
    none = pa.table({"word": base["word"], "n": base["n"], "n_near": pa.array(np.zeros(len(base), np.int64)), "best_n": pa.nulls(len(base), pa.int64()), "best": pa.nulls(len(base), pa.string())})
    if not met.any():
        return none
    parts, part = parts.filter(pa.array(met)), part[met]
    rest, length = _padded(parts["rest"].combine_chunks(), part)
    order = np.argsort(np.ascontiguousarray(rest).view(f"S{rest.shape[1]}").ravel(), kind="stable")
    parts, part, rest, length = parts.take(pa.array(order)), part[order], rest[order, 4:], length[order]
    new = np.concatenate([[True], part[1:] != part[:-1]])
    part = np.cumsum(new) - 1
    a = Acceptor(rest[:, : max(1, int(length.max()))], length, part)
    pairs = compose(a, parts["subst"].combine_chunks().to_numpy(zero_copy_only=False)[a.initial_row])
    head = parts["head"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    twice = parts["twice"].combine_chunks().to_numpy(zero_copy_only=False)
    x, y = pairs[:, 0], pairs[:, 1]
    longer = np.where(length[x] > length[y], x, y)
    keep = ((head[x] < 0) | (head[x] != head[y])) & ((length[x] == length[y]) | ~twice[longer])
    x, y = x[keep], y[keep]
    n = parts["n"].to_numpy()
    words, _ = _padded(parts["word"].combine_chunks(), np.zeros(len(n), np.int64))
    _, rank = np.unique(np.ascontiguousarray(words).view(f"S{words.shape[1]}").ravel(), return_inverse=True)
    one, two = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort((rank[two], -n[two], one))
    one, two = one[order], two[order]
    lead = np.concatenate([[True], one[1:] != one[:-1]]) if len(one) else np.zeros(0, bool)
    best = np.full(len(n), -1, np.int64)
    best[one[lead]] = two[lead]
    count = np.bincount(one, minlength=len(n))
    out = np.flatnonzero(count)
    took = pa.array(best[out])
    some = pa.table({"word": parts["word"].take(pa.array(out)), "n": parts["n"].take(pa.array(out)), "n_near": pa.array(count[out], pa.int64()), "best_n": parts["n"].take(took), "best": parts["word"].take(took)})
    return pa.concat_tables([none, some])


def near(words: DataFrame, *, most: int = MOST_WORDS, tasks: int | None = None) -> DataFrame:
    """word, n, n_near, best and best_n (the near word of largest n, the first in code-point order of several) of every word."""
    parts = divide(partitions(words), most)
    tasks = tasks or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole partitions
        last: list[pa.Table] = []  # the partition that may go on in the next batch
        rows, widest = 0, 0

        def add(t: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, widest
            if held and (rows + len(t) > _BUFFER_WORDS or (rows + len(t)) * max(widest, width) > _BUFFER_BYTES):
                yield from near_in(pa.concat_tables(held)).to_batches()
                held, rows, widest = [], 0, 0
            held.append(t)
            rows, widest = rows + len(t), max(widest, width)

        def width(t: pa.Table) -> int:
            return pc.max(pc.utf8_length(t["word"])).as_py() or 0

        for batch in batches:
            t, ids = pa.Table.from_batches([batch]), batch.column(0)
            cuts = [0, *(np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1), len(t)]
            if last and len(t) and last[-1]["part"][0] != ids[0]:
                cuts.insert(1, 0)
            if len(cuts) > 2:
                whole = pa.concat_tables([*last, t[: cuts[1]]])
                yield from add(whole, width(whole))
                last, between = [], t[cuts[1] : cuts[-2]]
                if len(between) * (wide := width(between)) <= _BUFFER_BYTES:
                    yield from add(between, wide)
                else:
                    for lo, hi in zip(cuts[1:-2], cuts[2:-1], strict=True):
                        yield from add(t[lo:hi], width(t[lo:hi]))
            last.append(t[cuts[-2] :])
        if last:
            whole = pa.concat_tables(last)
            yield from add(whole, width(whole))
        if rows:
            yield from near_in(pa.concat_tables(held)).to_batches()

    columns = ["part", "rest", "word", "n", "head", "subst", "base", "twice"]
    dealt = parts.select(columns).repartition(tasks, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(enumerate_pairs, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))))
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.w").alias("best"), (-F.col("b.k")).alias("best_n"))


# forms


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form: forms followed to the last. Reads ``forms`` (word, form) once a step."""
    links = forms.filter("form is not null").select("word", "form")
    known = links.select(F.col("word").alias("at_word"), F.col("form").alias("next"))
    at, out = links.select("word", F.col("form").alias("at")), None
    while True:
        step = stage(at.join(known, F.col("at") == F.col("at_word"), "left").select("word", "at", "next"), "roots")
        ended = step.filter("next is null").select("word", F.col("at").alias("root"))
        out = ended if out is None else out.unionByName(ended)
        at = step.filter("next is not null").select("word", F.col("next").alias("at"))
        if at.isEmpty():
            return out


def variants(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_ratio: int = LEAST_RATIO, most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = stage(vocabulary(documents, id_col=id_col, text_col=text_col), "vocabulary")
    formed = F.col("best_n") >= least_ratio * F.col("n")
    found = stage(near(words, most=most).select("word", F.when(formed, F.col("best")).alias("form"), "n", "n_near", F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    last = roots(found).withColumnRenamed("word", "of_word")
    return found.join(last, F.col("word") == F.col("of_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
