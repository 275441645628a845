"""Linear quantile models with an L1 penalty, fitted to a proven gap.

The objective is the mean pinball loss plus ``penalty`` times the absolute slopes and effects; the intercept is free.
The method is the primal-dual interior point of Portnoy and Koenker (1997). Each row carries its share ``a`` of the dual
(what is left of it to 1 is ``s``) and the parts ``z`` and ``w`` of its residual above and below the line; each
penalised coefficient is one more such row, of weight 1/2 on either side, and those few stay on the driver. The shares
are a feasible point of the dual all the way, so they bound the optimum from below, and a fit ends when objective and
bound are less than ``tolerance`` apart.

One step is an aggregation by category combination (sums of a bounded number of combinations reach the driver), a solve
of as many unknowns as there are coefficients, and an aggregation without keys that says how far the step may go. All
quantiles share these. The rows' state is persisted, and every ten steps checkpointed.

Tables of more than ``WHOLE`` rows don't take all their rows through these steps. A round sums every row into cells: by
category combination and side of each quantile's line, and near a line by bins of the numbers and of the residual, finest
at the line. A sum's pinball loss is at most that of its rows, and equal if they lie on one side. So a line fitted to the
cells, each taken as one row, bounds the optimum of all rows from below, and the next round's pass over all rows gives the
line's own objective, while its cells are made around that line. Rounds end when objective and bound, both of all rows,
are less than ``tolerance`` apart; lines that are left after ``ROUNDS`` go on with every row by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoints, staged

STEPS, CUT_EVERY, INSIDE = 200, 10, 0.9995
WHOLE, CELLS, ROUNDS = 2**19, 2**17, 12
_BINS, _RATIO = 8, 1.5  # of residuals, on each side of a line: how many, and each one's end to the end of the one before


@dataclass
class Line:
    """One fitted quantile: coefficients (intercept, numbers, levels), objective, proven gap and steps."""

    coefficients: np.ndarray
    objective: float
    gap: float
    steps: int


@dataclass
class Sums:
    """Over all rows: matrix and vectors over (intercept, numbers, levels), and scalars.

    ``matrix`` of the weights; ``pull`` of weight times residual and ``inward`` of weight times (1/s - 1/a); ``slope`` of the
    dual; ``slack`` z s + w a; ``loss`` and ``bound`` of the objective.
    """

    matrix: np.ndarray
    pull: np.ndarray
    inward: np.ndarray
    slope: np.ndarray
    slack: float
    loss: float
    bound: float


@dataclass
class Fit:
    """One quantile on its way; a, s, z and w here are those of the penalised coefficients, scaled by ``unit``."""

    share: float
    at: np.ndarray
    rows: int
    penalty: float
    tolerance: float
    spread: float
    reach: float
    start: float
    limit: int
    pairs: int
    centring: float = 0.1
    steps: int = 0
    done: bool = False
    best: tuple[float, np.ndarray] | None = None
    proven: float = -np.inf
    move: np.ndarray = field(default_factory=lambda: np.empty(0))
    target: float = 0.0

    def __post_init__(self) -> None:
        self.unit = 2 * self.penalty * self.rows
        r = -self.unit * self.at[1:]
        self.a, self.s = np.full(len(r), 0.5), np.full(len(r), 0.5)
        self.z, self.w = np.maximum(r, 0) + self.start, np.maximum(-r, 0) + self.start

    @property
    def gap(self) -> float:
        return self.best[0] - self.proven

    def aim(self, m: Sums) -> None:
        """Where to go from here: ``move`` of the coefficients and ``target`` of the products z s and w a."""
        objective = m.loss / self.rows + self.penalty * np.abs(self.at[1:]).sum()
        if self.best is None or objective < self.best[0]:
            self.best = (objective, self.at)
        # the optimum's slopes add up to best / penalty at most, and its intercept lies among the responses less what they add
        most = self.best[0] / self.penalty
        slope = m.slope / self.rows
        over = np.maximum(np.abs(slope[1:]) - self.penalty, 0.0).max(initial=0.0)
        self.proven = max(self.proven, m.bound / self.rows - most * over - (self.spread + most * self.reach) * abs(slope[0]))
        if self.gap <= self.tolerance or self.steps >= self.limit:
            self.done = True
            return
        slack = m.slack + float(self.z @ self.s + self.w @ self.a)
        self.target = self.centring * slack / (2 * (self.pairs + len(self.z)))
        weight = 1 / (self.z / self.s + self.w / self.a)
        inward = 1 / self.s - 1 / self.a
        matrix, right = m.matrix.copy(), m.pull - self.target * m.inward
        at = np.arange(1, len(matrix))
        matrix[at, at] += self.unit**2 * weight
        right[1:] += self.unit * weight * (self.z - self.w - self.target * inward)
        matrix += 1e-14 * matrix.diagonal().max() * np.eye(len(matrix))
        self.move = np.linalg.solve(matrix, right)
        da = weight * (self.z - self.w - self.target * inward - self.unit * self.move[1:])
        dz = self.target / self.s - self.z + self.z / self.s * da
        dw = self.target / self.a - self.w - self.w / self.a * da
        self.own = (da, dz, dw)

    def go(self, dual: float, primal: float) -> tuple[float, float]:
        """Step lengths of shares and of residuals, given the rows' largest relative falls."""
        da, dz, dw = self.own
        dual = max(dual, (-da / self.a).max(initial=0.0), (da / self.s).max(initial=0.0))
        primal = max(primal, (-dz / self.z).max(initial=0.0), (-dw / self.w).max(initial=0.0))
        f, g = min(1.0, INSIDE / max(dual, 1e-300)), min(1.0, INSIDE / max(primal, 1e-300))
        self.a, self.s, self.z, self.w = self.a + f * da, self.s - f * da, self.z + g * dz, self.w + g * dw
        self.at = self.at + g * self.move
        short = min(f, g)
        self.centring = min(0.5, 0.01 + (1 - short) ** 1.5)
        self.steps += 1
        return f, g


def _coded(frame: DataFrame, y: str, numbers: tuple[str, ...], levels: dict[str, list[str]]) -> DataFrame:
    """y, the numbers and each category as the position of its level (0: none)."""
    out = [F.col(y).cast("double").alias("y"), *(F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(numbers))]
    for i, (c, known) in enumerate(levels.items()):
        if known:
            places = F.create_map(*(F.lit(v) for k, name in enumerate(known) for v in (name, k + 1)))
            out.append(F.coalesce(F.try_element_at(places, F.col(c)), F.lit(0)).alias(f"c{i}"))
        else:
            out.append(F.lit(0).alias(f"c{i}"))
    return frame.select(*out)


def _along(b: np.ndarray, numbers: int, levels: dict[str, list[str]], count: str) -> str:
    """Each row's product with coefficients; ``count`` is how many rows it is the sum of. Expressions are text here: a step has hundreds of them."""
    times = "" if count == "1D" else f"{count} * "
    out = [times + _number(b[0]), *(f"x{i} * {_number(b[1 + i])}" for i in range(numbers))]
    k = 1 + numbers
    for i, known in enumerate(levels.values()):
        effects = ", ".join(["0D", *map(_number, b[k : k + len(known)])])
        out.append(f"{times}get(array({effects}), c{i})")
        k += len(known)
    return f"({' + '.join(out)})"


def _number(v: float) -> str:
    return f"({float(v)!r}D)"


def _gathered(state: DataFrame, fits: dict[int, Fit], numbers: int, levels: dict[str, list[str]], count: str) -> pd.DataFrame:
    """What ``Sums`` are put together from, by combination of levels."""
    keys = [f"c{i}" for i in range(len(levels))]
    parts, sums = [], []
    for k, fit in fits.items():
        parts += [f"1 / (z{k} / s{k} + w{k} / a{k}) AS q{k}", f"z{k} - w{k} AS r{k}", f"1 / s{k} - 1 / a{k} AS i{k}", f"a{k} - {_number(1 - fit.share)} AS d{k}"]
        sums += [f"sum(z{k} * s{k} + w{k} * a{k}) AS slack{k}", f"sum(greatest(r{k} * {_number(fit.share)}, r{k} * {_number(fit.share - 1)})) AS loss{k}", f"sum(d{k} * y) AS bound{k}"]
        for i in range(-1, numbers):
            x = count if i < 0 else f"x{i}"
            sums += [f"sum(q{k} * r{k} * {x}) AS pull{k}_{i + 1}", f"sum(q{k} * i{k} * {x}) AS inward{k}_{i + 1}", f"sum(d{k} * {x}) AS slope{k}_{i + 1}"]
            sums += [f"sum(q{k} * {x} * {count if j < 0 else f'x{j}'}) AS matrix{k}_{i + 1}_{j + 1}" for j in range(i, numbers)]
    return state.selectExpr("*", *parts).groupBy(*keys).agg(*map(F.expr, sums)).toPandas()


def _assembled(g: pd.DataFrame, k: int, numbers: int, levels: dict[str, list[str]]) -> Sums:
    marks = [np.eye(len(known) + 1)[g[f"c{i}"].to_numpy(int), 1:] for i, known in enumerate(levels.values())]
    marks = np.hstack([np.empty((len(g), 0)), *marks])
    head = 1 + numbers

    def vector(name: str) -> np.ndarray:
        first = g[f"{name}{k}_0"].to_numpy(float)
        return np.concatenate([[g[f"{name}{k}_{i}"].sum() for i in range(1 + numbers)], first @ marks])

    matrix = np.zeros((head + marks.shape[1],) * 2)
    for i in range(-1, numbers):
        for j in range(i, numbers):
            v = g[f"matrix{k}_{i + 1}_{j + 1}"].to_numpy(float)
            matrix[1 + i, 1 + j] = matrix[1 + j, 1 + i] = v.sum()
            if i < 0:
                matrix[1 + j, head:] = matrix[head:, 1 + j] = v @ marks
            if j < 0:
                matrix[head:, head:] = marks.T @ (marks * v[:, None])
    return Sums(matrix, vector("pull"), vector("inward"), vector("slope"), g[f"slack{k}"].sum(), g[f"loss{k}"].sum(), g[f"bound{k}"].sum())


def _moves(state: DataFrame, fits: dict[int, Fit], numbers: int, levels: dict[str, list[str]], count: str) -> DataFrame:
    """The state with each row's changes of a (da), z (dz) and w (dw)."""
    first, then = [], []
    for k, fit in fits.items():
        t = _number(fit.target)
        first.append(f"(z{k} - w{k} - (1 / s{k} - 1 / a{k}) * {t} - {_along(fit.move, numbers, levels, count)}) / (z{k} / s{k} + w{k} / a{k}) AS da{k}")
        then += [f"{t} / s{k} - z{k} + z{k} / s{k} * da{k} AS dz{k}", f"{t} / a{k} - w{k} - w{k} / a{k} * da{k} AS dw{k}"]
    return state.selectExpr("*", *first).selectExpr("*", *then)


def _interior(rows: DataFrame, fits: dict[int, Fit], numbers: int, levels: dict[str, list[str]], count: str) -> None:
    """Takes every fit from where it is to its tolerance or limit, over ``rows`` (y, numbers, categories)."""
    kept, held = StorageLevel.MEMORY_AND_DISK, rows.columns
    state = rows.selectExpr("*", *(f"y - {_along(f.at, numbers, levels, count)} AS r{k}" for k, f in fits.items()))
    parts = [c for k, f in fits.items() for c in (f"{_number(1 - f.share)} AS a{k}", f"{_number(f.share)} AS s{k}", f"greatest(r{k}, 0D) + {_number(f.start)} AS z{k}", f"greatest(-r{k}, 0D) + {_number(f.start)} AS w{k}")]
    state = state.selectExpr(*held, *parts).persist(kept)
    before, step = None, 0
    while True:
        left = {k: f for k, f in fits.items() if not f.done}
        groups = _gathered(state, left, numbers, levels, count)
        if before is not None:
            before.unpersist()
        for k, f in left.items():
            f.aim(_assembled(groups, k, numbers, levels))
        left = {k: f for k, f in left.items() if not f.done}
        if not left:
            break
        moved = _moves(state, left, numbers, levels, count)
        falls = [part for k in left for part in (f"max(greatest(-da{k} / a{k}, da{k} / s{k})) AS f{k}", f"max(greatest(-dz{k} / z{k}, -dw{k} / w{k})) AS g{k}")]
        far = moved.agg(*map(F.expr, falls)).first()
        parts = []
        for k, f in left.items():
            dual, primal = map(_number, f.go(far[f"f{k}"], far[f"g{k}"]))
            parts += [f"a{k} + da{k} * {dual} AS a{k}", f"s{k} - da{k} * {dual} AS s{k}", f"z{k} + dz{k} * {primal} AS z{k}", f"w{k} + dw{k} * {primal} AS w{k}"]
        before, state, step = state, moved.selectExpr(*held, *parts).persist(kept), step + 1
        if step % CUT_EVERY == 0:
            cached, state = state, state.checkpoint()
            cached.unpersist()
    state.unpersist()


def _cells(coded: DataFrame, lines: dict[int, tuple[float, np.ndarray, float]], edges: list[list[float]], levels: dict[str, list[str]]) -> DataFrame:
    """All rows' sums (n, y and the numbers) and losses by cell around ``lines`` (share, coefficients, how far from the line bins go)."""
    many, keys = len(edges), [f"c{i}" for i in range(len(levels))]
    first, bins, near = [], [], []
    for k, (_, at, reach) in lines.items():
        first.append(f"y - {_along(at, many, levels, '1D')} AS r{k}")
        least = _number(max(reach / _RATIO ** (_BINS - 1), 1e-12))
        place = f"least({_BINS}, cast(ceil(ln(greatest(abs(r{k}) / {least}, 1D)) / {_number(np.log(_RATIO))}) AS INT))"
        bins.append(f"if(r{k} < 0, -1 - {place}, {place}) AS b{k}")  # the line itself is an edge
        near.append(f"b{k} BETWEEN {-_BINS} AND {_BINS - 1}")
    parts = [f"if({' OR '.join(near)}, {' + '.join(['0', *(f'int(x{i} > {_number(e)})' for e in cuts)])}, -1) AS p{i}" for i, cuts in enumerate(edges)]
    placed = coded.selectExpr("*", *first).selectExpr("*", *bins).selectExpr("*", *parts)
    sums = ["count(*) AS n", "sum(y) AS y", *(f"sum(x{i}) AS x{i}" for i in range(many)), *(f"sum(greatest(r{k} * {_number(q)}, r{k} * {_number(q - 1)})) AS loss{k}" for k, (q, _, _) in lines.items())]
    cells = placed.groupBy(*keys, *(f"p{i}" for i in range(many)), *(f"b{k}" for k in lines)).agg(*map(F.expr, sums))
    return cells.select(*keys, F.col("n").cast("double").alias("n"), "y", *(f"x{i}" for i in range(many)), *(f"loss{k}" for k in lines))


def _by_cells(coded: DataFrame, quantiles: tuple[float, ...], start: np.ndarray, left: float, edges: list[list[float]], levels: dict[str, list[str]], made, *, rows: int, penalty: float, tolerance: float, steps: int) -> tuple[dict[int, Line], dict[int, Line]]:
    """Lines whose gap over all rows is closed or whose steps are used up, and those that are left after all rounds."""
    many, spark = len(edges), coded.sparkSession
    at, reach = dict.fromkeys(range(len(quantiles)), start), dict.fromkeys(range(len(quantiles)), 4 * left)
    best: dict[int, tuple[float, np.ndarray]] = {}
    bound, taken, done = dict.fromkeys(at, 0.0), dict.fromkeys(at, 0), {}
    for turn in range(ROUNDS + 1):
        open_ = [k for k in at if k not in done]
        cells = _cells(coded, {k: (quantiles[k], at[k], reach[k]) for k in open_}, edges, levels).repartition(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        facts = cells.agg(F.count("*").alias("cells"), *(F.sum(f"loss{k}").alias(f"loss{k}") for k in open_)).first()
        for k in open_:
            objective = facts[f"loss{k}"] / rows + penalty * np.abs(at[k][1:]).sum()
            if k not in best or objective < best[k][0]:
                best[k] = (objective, at[k])
            if best[k][0] - bound[k] <= tolerance or taken[k] >= steps:
                done[k] = Line(best[k][1], best[k][0], best[k][0] - bound[k], taken[k])
        open_ = [k for k in open_ if k not in done]
        if not open_ or turn == ROUNDS:
            cells.unpersist()
            break
        state = cells.drop(*(f"loss{k}" for k in at))
        size = state.agg(*(F.avg(F.abs(F.expr(f"y - {_along(at[k], many, levels, 'n')}"))).alias(f"left{k}") for k in open_)).first()
        # a round needn't be solved further than its cells are good for
        fits = {k: made(k, at[k], max(size[f"left{k}"], 1e-9), max(tolerance / 4, (best[k][0] - bound[k]) / 30), steps - taken[k], facts["cells"]) for k in open_}
        _interior(state, fits, many, levels, "n")
        far = state.agg(*(F.max(F.abs(F.expr(f"{_along(f.best[1] - at[k], many, levels, 'n')} / n"))).alias(f"far{k}") for k, f in fits.items())).first()
        for k, f in fits.items():
            bound[k], taken[k], at[k], reach[k] = max(bound[k], f.proven), taken[k] + f.steps, f.best[1], max(far[f"far{k}"], 1e-9)
        cells.unpersist()
    return done, {k: Line(best[k][1], best[k][0], best[k][0] - bound[k], taken[k]) for k in at if k not in done}


def fit(frame: DataFrame, quantiles: tuple[float, ...], start: np.ndarray, levels: dict[str, list[str]], *, y: str, numbers: tuple[str, ...], penalty: float = 1e-3, tolerance: float = 1e-6, steps: int = STEPS) -> dict[float, Line]:
    """Each quantile's coefficients from ``start`` (intercept, numbers, levels in order), with a gap of ``tolerance`` at most.

    Rows without response or numbers don't count. Levels that ``levels`` doesn't name, null included, have no effect. No
    rows: no lines. A fit that hasn't closed its gap after ``steps`` returns its best coefficients and the gap it has.
    """
    if penalty <= 0 or not all(0 < q < 1 for q in quantiles):
        raise ValueError("the penalty must be positive and quantiles lie between 0 and 1")
    shared_checkpoints(frame.sparkSession)
    many, codes = len(numbers), [f"c{i}" for i in range(len(levels))]
    coded = _coded(frame, y, numbers, levels).na.drop()
    one = coded.agg(F.count("*").alias("rows"), F.avg("y").alias("mean"), F.approx_count_distinct(F.struct(F.lit(0), *codes)).alias("combinations"), *(F.max(F.abs(F.col(f"x{i}"))).alias(f"m{i}") for i in range(many))).first()
    rows = one["rows"]
    if not rows:
        return {}
    centre = np.eye(len(start))[0] * float(one["mean"])
    at = np.asarray(start, float) - centre
    coded = coded.withColumn("y", F.col("y") - float(one["mean"]))
    if rows > WHOLE:
        coded = staged(coded)
    parts = int(min(8, max(2, (CELLS / (2 * _BINS * len(quantiles) * one["combinations"])) ** (1 / max(1, many)))))
    cuts = [F.percentile_approx(f"x{i}", [j / parts for j in range(1, parts)], 1000).alias(f"e{i}") for i in range(many)] if rows > WHOLE else []
    size = coded.withColumn("r", F.expr(f"y - {_along(at, many, levels, '1D')}")).agg(F.avg(F.abs("r")).alias("left"), F.max(F.abs("y")).alias("most"), *cuts).first()
    begin = max(float(size["left"]), 1e-9)
    reach = max([1.0, *(float(one[f"m{i}"]) for i in range(many))])

    def made(k: int, b: np.ndarray, first: float, near: float, limit: int, pairs: int) -> Fit:
        return Fit(quantiles[k], b, rows, penalty, near, float(size["most"]), reach, first, limit, pairs)

    lines, left = {}, dict.fromkeys(range(len(quantiles)))
    if rows > WHOLE:
        lines, left = _by_cells(coded, quantiles, at, begin, [list(size[f"e{i}"]) for i in range(many)], levels, made, rows=rows, penalty=penalty, tolerance=tolerance, steps=steps)
    if left:
        fits = {k: made(k, at if line is None else line.coefficients, begin, tolerance, steps if line is None else steps - line.steps, rows) for k, line in left.items()}
        _interior(coded, fits, many, levels, "1D")
        lines.update({k: Line(f.best[1], f.best[0], f.gap, f.steps + (left[k].steps if left[k] else 0)) for k, f in fits.items()})
    return {q: Line(lines[k].coefficients + centre, lines[k].objective, lines[k].gap, lines[k].steps) for k, q in enumerate(quantiles)}
