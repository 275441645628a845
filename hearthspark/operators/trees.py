"""Boosted quantile trees with monotone numbers, grown from histograms that Spark adds up.

Numbers are cut into bins and categories into levels once. Rows with equal codes have equal estimates, so they are
written as pieces: one row of codes with its responses in order and how often each occurs. Codes are bounded in number,
so in large tables trees run on far fewer pieces than rows. Pieces are dealt by ranges of codes and responses, which
splits frequent codes. A level of a tree is one Spark job: every task counts, for each quantile, node, feature and bin,
its rows and those at or below their present estimate, in numpy over Arrow batches; Spark adds the counts, and the
driver, which sees bounded tables of counts alone, chooses splits. Counts are whole numbers, so a tree doesn't depend on
how rows are dealt to tasks.

The loss is the pinball loss: a row's gradient is 1 - q if its response is at or below the estimate and -q if not. A
split on a rising number must not put the higher step on the left. A leaf's step is the q-quantile of its rows' residuals
(from a histogram of ``CELLS`` cells over the responses' range), held within bounds that come from the rising splits
above it: all leaves left of such a split are at most the mean of its two sides' steps, all right of it at least that. A
sum of such trees never falls when a rising number grows.

Defined results: rows without a response or a number are not trained on; a level that training has not seen has no level
at all; equal gains take the first feature and the lowest cut; an empty table has no trees.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoints, tasks

BINS, CELLS = 64, 4096
# Size of a leaf, regularisation, rounds, rate and depth of the published model.
MIN_LEAF, L2, ROUNDS, RATE, DEPTH = 10, 0.1, 150, 0.05, 6


@dataclass
class Tree:
    """A heap of nodes (children of k are 2k + 1 and 2k + 2): feature (-1: leaf), cut and step of each."""

    feature: np.ndarray
    cut: np.ndarray
    step: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, codes: np.ndarray, numbers: int) -> np.ndarray:
        """The node in which each row of codes ends."""
        at = np.zeros(len(codes), np.int64)
        start = np.arange(len(codes)) * codes.shape[1]
        flat, inner = codes.ravel(), self.feature >= 0
        while (going := inner[at]).any():
            f = self.feature[at]
            code, cut = flat[start + np.maximum(f, 0)], self.cut[at]
            at = np.where(going, 2 * at + 1 + np.where(f < numbers, code > cut, code == cut), at)
        return at


@dataclass
class Forest:
    """Quantile models on the same coded features."""

    quantiles: tuple[float, ...]
    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    bounds: list[np.ndarray]
    levels: list[list[str]]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)  # a list of rounds, each with a tree a quantile
    rows: int = 0

    def codes(self, columns: list) -> np.ndarray:
        """Bins of numbers (how many bounds lie below) and levels of categories (-1: unknown)."""
        out = [np.searchsorted(b, np.asarray(c, float), "left") for b, c in zip(self.bounds, columns, strict=False)]
        for names, c in zip(self.levels, columns[len(self.bounds) :], strict=True):
            out.append(pd.Categorical(c, categories=names).codes)
        return np.stack(out, axis=1).astype(np.int32) if out else np.empty((0, 0), np.int32)

    def add(self, estimate: np.ndarray, codes: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
        """Estimates (a column a quantile) with the steps of some rounds."""
        for trees in rounds:
            for k, tree in enumerate(trees):
                estimate[:, k] += tree.step[tree.nodes(codes, len(self.numbers))]
        return estimate

    def predict(self) -> Column:
        """An array with the estimate of each quantile, as fitted (they may cross)."""
        model = self

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                codes = model.codes(list(columns))
                yield pd.Series(list(model.add(np.repeat(model.start[None, :], len(codes), axis=0), codes, model.trees)))

        return run(*(F.col(c) for c in (*self.numbers, *self.categories)))


def _splits(n: np.ndarray, below: np.ndarray, q: float, sizes: list[int], numbers: int, least: int, l2: float, rising: tuple[bool, ...]) -> tuple[int, int] | None:
    """The best split of one node from its counts by feature and bin: (feature, cut), or None."""
    best, found, at = 1e-9, None, 0
    total_n, total_b = n[: sizes[0]].sum(), below[: sizes[0]].sum()
    side = lambda m, b: (b - q * m) / (m + l2)  # noqa: E731  mean gradient
    worth = lambda m, b: (b - q * m) ** 2 / (m + l2)
    for f, size in enumerate(sizes):
        m, b = n[at : at + size].astype(float), below[at : at + size].astype(float)
        at += size
        if f < numbers:
            left_n, left_b = np.cumsum(m)[:-1], np.cumsum(b)[:-1]
            right_n, right_b = total_n - left_n, total_b - left_b
        else:
            right_n, right_b = m, b
            left_n, left_b = total_n - m, total_b - b
        gain = worth(left_n, left_b) + worth(right_n, right_b) - worth(total_n, total_b)
        ok = (left_n >= least) & (right_n >= least)
        if f < numbers and rising[f]:
            ok &= side(left_n, left_b) >= side(right_n, right_b)  # steps go against gradients
        gain = np.where(ok, gain, -1.0)
        if len(gain) and gain.max() > best:
            best, found = float(gain.max()), (f, int(gain.argmax()))
    return found


Cells = tuple[np.ndarray, np.ndarray]  # cells of residuals and how many fell into each


def _quantile(cells: Cells, q: float, width: float) -> float:
    """The middle of the cell that holds the q-quantile of counted residuals."""
    at, n = cells
    if not len(at):
        return 0.0
    order = np.argsort(at, kind="stable")
    seen = np.cumsum(n[order])
    need = max(1, int(np.ceil(q * int(seen[-1]))))
    return (int(at[order][np.searchsorted(seen, need)]) + 0.5) * width


def _steps(tree: Tree, cells: dict[int, Cells], q: float, width: float, rate: float, numbers: int, rising: tuple[bool, ...]) -> None:
    """Steps of all leaves from their residuals, within the bounds of the rising splits above them."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64))

    def merged(k: int) -> Cells:
        if tree.feature[k] < 0:
            return cells.get(k, none)
        (a, n), (b, m) = merged(2 * k + 1), merged(2 * k + 2)
        return np.concatenate([a, b]), np.concatenate([n, m])

    def settle(k: int, low: float, high: float) -> None:
        f = tree.feature[k]
        if f < 0:
            tree.step[k] = rate * min(high, max(low, _quantile(cells.get(k, none), q, width)))
            return
        a, b = 2 * k + 1, 2 * k + 2
        if f < numbers and rising[f]:
            middle = sum(min(high, max(low, _quantile(merged(x), q, width))) for x in (a, b)) / 2
            settle(a, low, middle)
            settle(b, middle, high)
        else:
            settle(a, low, high)
            settle(b, low, high)

    settle(0, -np.inf, np.inf)


def _pieces(batches: Iterator[pa.RecordBatch], start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of equal codes in sorted rows (code, y, n) as one row each: codes, ys, ns and the first estimate."""
    for b in batches:
        if not len(b):
            continue
        wide = b.column(0).cast(pa.binary(b.column(0)[0].as_buffer().size))
        code = np.frombuffer(wide.buffers()[1], np.int32).reshape(-1, wide.type.byte_width // 4)[wide.offset : wide.offset + len(wide)]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(axis=1)])
        ends = pa.array(np.r_[first, len(b)], pa.int32())
        yield pa.RecordBatch.from_arrays([_lists(code[first]), pa.ListArray.from_arrays(ends, b.column(1)), pa.ListArray.from_arrays(ends, b.column(2)), _lists(np.repeat(start[None, :], len(first), axis=0))], ["codes", "ys", "ns", "estimate"])


def _added(at: tuple[np.ndarray, ...], n: tuple[np.ndarray, ...]) -> Cells:
    """Counts by place, each place once."""
    at, n = np.concatenate(at), np.concatenate(n)
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(n, first)


def _lists(matrix: np.ndarray) -> pa.Array:
    """A row of a matrix as a list."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(frame: DataFrame, *, y: str = "log_price", numbers: tuple[str, ...] = ("log_floor", "eff"), rising: tuple[bool, ...] = (True, True), categories: tuple[str, ...] = (), quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, bins: int = BINS, min_leaf: int = MIN_LEAF, l2: float = L2, settle_every: int = 25) -> Forest | None:
    """Boosted trees for each quantile; None without rows.

    The pieces with their present estimates are written every ``settle_every`` rounds, so that a task recomputes at
    most the trees since then and lost executors cost no more than that.
    """
    spark = frame.sparkSession
    pool = frame.select(F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in categories))
    for c in ("y", *numbers):
        pool = pool.filter(F.col(c).isNotNull() & ~F.isnan(c))
    marks = [k / bins for k in range(1, bins)]
    facts = pool.agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.percentile_approx("y", list(quantiles), 10_000).alias("start"), *(F.percentile_approx(c, marks, 10_000).alias(f"m_{c}") for c in numbers), *(F.array_sort(F.collect_set(c)).alias(f"l_{c}") for c in categories)).first()
    if not facts["n"]:
        return None
    model = Forest(tuple(quantiles), tuple(numbers), tuple(categories), [np.unique(np.array(facts[f"m_{c}"])) for c in numbers], [list(facts[f"l_{c}"]) for c in categories], np.array(facts["start"]), rows=facts["n"])
    sizes = [*(len(b) + 1 for b in model.bounds), *(len(x) for x in model.levels)]
    offset, total = np.cumsum([0, *sizes])[:-1], sum(sizes)
    width = max((facts["high"] - facts["low"]) / CELLS, 1e-12)
    folder = f"{shared_checkpoints(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    shape = "codes array<int>, ys array<double>, ns array<long>, estimate array<double>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                codes = np.ascontiguousarray(model.codes([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]))
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * codes.shape[1]), len(codes), [None, pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([whole.cast(pa.binary()), b.column(0)], ["code", "y"])

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(shape).parquet(f"{folder}/{name}")

    coded = pool.mapInArrow(code, "code binary, y double").groupBy("code", "y").agg(F.count("*").alias("n"))
    dealt = coded.repartitionByRange(tasks(pool), "code", "y").sortWithinPartitions("code", "y")
    first = model.start
    rows, pending = written(dealt.mapInArrow(lambda batches: _pieces(batches, first), shape), "0"), []
    current: list[Tree] = []

    def counted(level: int | None) -> list[np.ndarray]:
        """Counts of a level's nodes by feature and bin (None: counts of leaves by cell of the residual): a, b, n, below."""
        ready, growing, first = list(pending), list(current), (1 << level) - 1 if level is not None else 0

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[Cells]] = {}
            tables = np.zeros((len(quantiles), 2, (1 << level) * total), np.int64) if level is not None else None
            for b in batches:
                if not len(b):
                    continue
                codes, have, n = _matrix(b.column(0)), *(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                size = np.diff(b.column(1).offsets.to_numpy())
                begin = np.cumsum(size) - size
                rows_of = np.add.reduceat(n, begin)
                estimate = model.add(_matrix(b.column(3)).copy(), codes, ready)
                for k, tree in enumerate(growing):
                    node, line = tree.nodes(codes, len(numbers)), np.repeat(estimate[:, k], size)
                    if level is None:
                        cell = np.floor((have - line) / width).astype(np.int64)
                        held.setdefault(k, []).append(_added([(np.repeat(node, size) << 40) + (cell + (1 << 39))], [n]))
                        if len(held[k]) == 64:
                            held[k] = [_added(*zip(*held[k], strict=True))]
                        continue
                    inside, low = node >= first, np.add.reduceat(n * (have <= line), begin)
                    for f in range(len(sizes)):
                        ok = inside & (codes[:, f] >= 0)
                        at = (node[ok] - first) * total + offset[f] + codes[ok, f]
                        for side, m in enumerate((rows_of, low)):
                            # sums below 2**53 are exact
                            tables[k, side] += np.bincount(at, weights=m[ok], minlength=tables.shape[2]).astype(np.int64)
            if level is None:
                parts = [(k, *_added(*zip(*cells, strict=True))) for k, cells in held.items()]
                out = [np.concatenate(x) for x in zip(*(((k << 20) + (at >> 40), (at & (1 << 40) - 1) - (1 << 39), n, 0 * n) for k, at, n in parts), strict=True)]
            else:
                k, at = np.nonzero(tables[:, 0])
                out = [k, at, tables[k, 0, at], tables[k, 1, at]]
            if out and len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n", "below"])

        summed = rows.mapInArrow(count, "a long, b long, n long, below long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).toArrow()
        return [summed.column(c).to_numpy() for c in range(4)]

    for r in range(rounds):
        current = [Tree.empty(depth) for _ in quantiles]
        for level in range(depth):
            tables = np.zeros((len(quantiles), 2, 1 << level, total), np.int64)
            flat = tables.reshape(len(quantiles), 2, -1)
            a, b, n, below = counted(level)
            flat[a, 0, b], flat[a, 1, b] = n, below
            grown = False
            for k, tree in enumerate(current):
                for j in range(1 << level):
                    if tables[k, 0, j].any() and (split := _splits(tables[k, 0, j], tables[k, 1, j], quantiles[k], sizes, len(numbers), min_leaf, l2, rising)):
                        tree.feature[(1 << level) - 1 + j], tree.cut[(1 << level) - 1 + j] = split
                        grown = True
            if not grown:
                break
        a, b, n, _ = counted(None)
        cells: list[dict[int, Cells]] = [{} for _ in quantiles]
        for x in np.unique(a).tolist():
            cells[x >> 20][x & (1 << 20) - 1] = (b[a == x], n[a == x])
        for k, tree in enumerate(current):
            _steps(tree, cells[k], quantiles[k], width, rate, len(numbers), rising)
        model.trees.append(current)
        pending.append(current)
        if len(pending) == settle_every and r + 1 < rounds:
            ready = list(pending)

            def settle(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if len(b):
                        yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(model.add(_matrix(b.column(3)).copy(), _matrix(b.column(0)), ready))], b.schema.names)

            rows, pending = written(rows.mapInArrow(settle, shape), str(r + 1)), []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return model
