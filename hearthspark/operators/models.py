"""Hedonic price models: least squares and quantile regression from aggregated sums, boosted quantile trees (``trees``), and evaluation.

Rows never reach the driver. The design is categories and two numbers, so Spark sums rows by category combination
(a bounded number of groups) and the normal equations are put together from those sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import pinball, ranks, trees, valuation

CATEGORIES = ("property_type", "tenure", "area", "age_band")
MIN_ROWS, MIN_QUANTILE_ROWS, MIN_TREE_ROWS = 20, 30, 50


def training_frame(sales: DataFrame) -> tuple[DataFrame, dict[str, float]] | None:
    """log_price, log_floor and centred efficiency of sales with a price; None without any floor area.

    Missing floor areas become the median, missing efficiencies the mean, which is returned for predictions.
    """
    pool = sales.filter(F.col("price") > 0)
    x = pool.agg(F.median("floor_area_sqm").alias("floor"), F.avg("energy_efficiency").alias("efficiency")).first()
    if x["floor"] is None:
        return None
    mean = x["efficiency"] if x["efficiency"] is not None else 0.0
    floor = F.coalesce(F.col("floor_area_sqm"), F.lit(float(x["floor"])))
    out = pool.withColumn("__f", floor).filter("__f > 0").withColumns({"log_price": F.log(F.col("price").cast("double")), "log_floor": F.log("__f"), "eff": F.coalesce(F.col("energy_efficiency").cast("double"), F.lit(float(mean))) - float(mean)}).drop("__f")
    return out, {"floor": float(x["floor"]), "efficiency": float(mean)}


@dataclass
class Linear:
    """intercept + numbers . slopes + one effect a category level (unknown levels have none)."""

    numbers: tuple[str, ...]
    intercept: float
    slopes: dict[str, float]
    effects: dict[str, dict[str, float]] = field(default_factory=dict)
    rows: int = 0

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for n, b in self.slopes.items():
            out = out + F.col(n) * b
        for c, levels in self.effects.items():
            if levels:
                table = F.create_map(*(F.lit(v) for kv in levels.items() for v in kv))
                out = out + F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0))
        return out


def _sums(numbers: tuple[str, ...], y: str, weight: Column, shift: Column, tag: str = "") -> list[Column]:
    """What one model needs of each group: weight, weighted response, and their products with the numbers."""
    target = F.col(y) * weight + shift
    out = [F.sum(weight).alias(f"{tag}w"), F.sum(target).alias(f"{tag}y")]
    for i, a in enumerate(numbers):
        out += [F.sum(F.col(a) * weight).alias(f"{tag}s{i}"), F.sum(F.col(a) * target).alias(f"{tag}y{i}")]
        out += [F.sum(F.col(a) * F.col(numbers[j]) * weight).alias(f"{tag}s{i}_{j}") for j in range(i, len(numbers))]
    return out


def _solved(groups: list, numbers: tuple[str, ...], categories: tuple[str, ...], ridge: float = 0.0, tag: str = "") -> Linear | None:
    """Minimum-norm least squares from the sums of each combination of category levels."""
    rows = sum(g["rows"] for g in groups)
    if not rows:
        return None
    levels = [(c, v) for c in categories for v in sorted({g[c] for g in groups if g[c] is not None})]
    at = {lv: 1 + len(numbers) + k for k, lv in enumerate(levels)}
    size = 1 + len(numbers) + len(levels)
    gram, right = np.zeros((size, size)), np.zeros(size)
    for g in groups:
        ones = [0] + [at[c, g[c]] for c in categories if g[c] is not None]
        gram[np.ix_(ones, ones)] += g[f"{tag}w"]
        right[ones] += g[f"{tag}y"]
        for i in range(len(numbers)):
            gram[1 + i, ones] += g[f"{tag}s{i}"]
            gram[ones, 1 + i] += g[f"{tag}s{i}"]
            right[1 + i] += g[f"{tag}y{i}"]
            for j in range(i, len(numbers)):
                gram[1 + i, 1 + j] += g[f"{tag}s{i}_{j}"]
                if i != j:
                    gram[1 + j, 1 + i] += g[f"{tag}s{i}_{j}"]
    if ridge:
        gram[1:, 1:] += ridge * rows * np.eye(size - 1)
    b = np.linalg.lstsq(gram, right, rcond=1e-10)[0]
    effects = {c: {v: float(b[at[c, v]]) for cc, v in levels if cc == c} for c in categories}
    return Linear(numbers, float(b[0]), {n: float(b[1 + i]) for i, n in enumerate(numbers)}, effects, int(rows))


def fit_linear(frame: DataFrame, *, y: str = "log_price", numbers: tuple[str, ...] = ("log_floor", "eff"), categories: tuple[str, ...] = CATEGORIES) -> Linear | None:
    """Minimum-norm least squares from one aggregation; one row a combination of category levels reaches the driver."""
    groups = frame.groupBy(*categories).agg(F.count("*").alias("rows"), *_sums(numbers, y, F.lit(1.0), F.lit(0.0))).collect()
    return _solved(groups, numbers, categories)


def fit_by_segment(frame: DataFrame, segment: str = "area", *, numbers: tuple[str, ...] = ("log_floor", "eff"), categories: tuple[str, ...] = ("property_type", "tenure", "age_band"), min_rows: int = MIN_ROWS) -> DataFrame:
    """One least-squares model a segment: segment, rows, intercept, slopes and effects (maps; effects by "category=level").

    Spark sums rows by segment and category combination; each segment's few sums are solved in a task of their own.
    Segments under ``min_rows`` have no model.
    """
    groups = frame.groupBy(segment, *categories).agg(F.count("*").alias("rows"), *_sums(numbers, "log_price", F.lit(1.0), F.lit(0.0)))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.astype(object).where(part.notna(), None).to_dict("records")
        model = _solved(rows, numbers, categories)
        if model is None or model.rows < min_rows:
            return pd.DataFrame({"segment": part[segment][:0], "rows": np.empty(0, np.int64), "intercept": np.empty(0), "slopes": [], "effects": []})
        effects = {f"{c}={v}": b for c, levels in model.effects.items() for v, b in levels.items()}
        return pd.DataFrame({"segment": [rows[0][segment]], "rows": [model.rows], "intercept": [model.intercept], "slopes": [model.slopes], "effects": [effects]})

    kind = frame.schema[segment].dataType.simpleString()
    solved = groups.filter(F.col(segment).isNotNull()).groupBy(segment).applyInPandas(solve, f"segment {kind}, rows long, intercept double, slopes map<string,double>, effects map<string,double>")
    return solved.withColumnRenamed("segment", segment)


def predict_by_segment(rows: DataFrame, models: DataFrame, segment: str = "area", *, numbers: tuple[str, ...] = ("log_floor", "eff"), categories: tuple[str, ...] = ("property_type", "tenure", "age_band")) -> DataFrame:
    """Rows with log_estimate by their segment's model; null where the segment has none."""
    m = models.select(segment, F.struct("intercept", "slopes", "effects").alias("__m"))
    out = rows.join(m, segment, "left")
    fit = F.col("__m.intercept")
    for n in numbers:
        fit = fit + F.col(n) * F.try_element_at("__m.slopes", F.lit(n))
    for c in categories:
        fit = fit + F.coalesce(F.try_element_at("__m.effects", F.concat(F.lit(f"{c}="), F.col(c))), F.lit(0.0))
    return out.withColumn("log_estimate", fit).drop("__m")


@dataclass
class Hedonic:
    linear: Linear
    low: float
    high: float
    means: dict[str, float]


def fit_hedonic(sales: DataFrame, *, categories: tuple[str, ...] = CATEGORIES) -> Hedonic | None:
    """Mean model with a band from the residuals' quartiles (no band under four residuals); None under 20 rows."""
    made = training_frame(sales)
    if made is None:
        return None
    frame, means = made
    model = fit_linear(frame, categories=categories)
    if model is None or model.rows < MIN_ROWS:
        return None
    q = ranks.quantiles_of_few(frame.select((F.col("log_price") - model.predict()).alias("value")), [], [0.25, 0.75]).first()["q"] if model.rows >= 4 else [0.0, 0.0]
    return Hedonic(model, q[0], q[1], means)


def _features(rows: DataFrame, means: dict[str, float], *, compat: bool = False) -> DataFrame:
    """log_floor and eff of rows to predict; missing numbers are the training medians and means."""
    centre = 0.0 if compat else means["efficiency"]
    eff = F.coalesce(F.col("energy_efficiency").cast("double"), F.lit(means["efficiency"])) - centre
    return rows.withColumns({"log_floor": F.log(F.coalesce(F.when(F.col("floor_area_sqm") > 0, F.col("floor_area_sqm")), F.lit(means["floor"]))), "eff": eff})


def _priced(rows: DataFrame, low: Column, mid: Column, high: Column, size: int, methodology: str) -> DataFrame:
    pounds = lambda c: F.bround(c, 0).cast("long")
    confidence = "high" if size >= 50 else "medium" if size >= 20 else "low"
    basis = next((b for n, b in BASES if size >= n), "area_only")
    return rows.withColumns({
        "estimate_gbp": pounds(mid), "low_gbp": pounds(F.least(low, high)), "high_gbp": pounds(F.greatest(low, high)), "confidence": F.lit(confidence), "basis": F.lit(basis),
        "comparables_used": F.lit(size).cast("long"), "methodology": F.lit(methodology),
    }).drop("log_floor", "eff")


# The basis that stands for a training pool's size.
BASES = ((100, "postcode_type"), (50, "postcode_area"), (25, "area_type"))
# Names of methods in the methodology column.
MEAN, QUANTILE, TREES = "hedonic-log-price", "quantile-hedonic-log-price", "gbm-hedonic-log-price"


def predict_hedonic(rows: DataFrame, model: Hedonic, *, compat: bool = False) -> DataFrame:
    """estimate_gbp, low_gbp, high_gbp, confidence, basis, comparables_used and methodology; missing numbers are the training medians and means.

    ``compat`` leaves efficiencies uncentred, as historic predictions did.
    """
    fit = F.exp(model.linear.predict())
    return _priced(_features(rows, model.means, compat=compat), fit * math.exp(model.low), fit, fit * math.exp(model.high), model.linear.rows, f"{MEAN} (PPD+EPC)")


@dataclass
class Quantiles:
    models: dict[float, Linear]
    means: dict[str, float]
    gaps: dict[float, float] = field(default_factory=dict)


def fit_quantiles(sales: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), *, categories: tuple[str, ...] = CATEGORIES, rounds: int = pinball.STEPS, penalty: float = 1e-3, tolerance: float = 1e-6) -> Quantiles | None:
    """Linear quantile models with an L1 penalty (``pinball.fit``); None under 30 rows or without floor areas.

    ``gaps`` says how far each model's objective is from the optimum at most: ``tolerance``, unless ``rounds`` end it before.
    """
    made = training_frame(sales)
    if made is None:
        return None
    frame, means = made
    numbers = ("log_floor", "eff")
    start = fit_linear(frame, categories=categories)
    if start is None or start.rows < MIN_QUANTILE_ROWS:
        return None
    levels = {c: sorted(start.effects[c]) for c in categories}
    at = np.array([start.intercept, *(start.slopes[n] for n in numbers), *(start.effects[c][v] for c in categories for v in levels[c])])
    lines = pinball.fit(frame, quantiles, at, levels, y="log_price", numbers=numbers, penalty=penalty, tolerance=tolerance, steps=rounds)
    found = {}
    for q, line in lines.items():
        b = [float(v) for v in line.coefficients]
        effects = iter(b[1 + len(numbers) :])
        found[q] = Linear(numbers, b[0], dict(zip(numbers, b[1:], strict=False)), {c: {v: next(effects) for v in levels[c]} for c in categories}, start.rows)
    return Quantiles(found, means, {q: line.gap for q, line in lines.items()})


def predict_quantiles(rows: DataFrame, model: Quantiles) -> DataFrame:
    """The columns of ``predict_hedonic``, low, mid and high sorted so that they never cross."""
    p = F.array_sort(F.array(*(F.exp(m.predict()) for m in model.models.values())))
    low, mid, high = (F.get(p, F.lit(k)) for k in range(3))
    named = "/".join(f"{q:.2f}" for q in model.models)
    return _priced(_features(rows, model.means), low, mid, high, next(iter(model.models.values())).rows, f"{QUANTILE} (PPD+EPC, q={named})")


@dataclass
class Trees:
    model: trees.Forest
    means: dict[str, float]


def fit_trees(sales: DataFrame, quantiles: tuple[float, float, float] = (0.1, 0.5, 0.9), *, categories: tuple[str, ...] = CATEGORIES, iterations: int = trees.ROUNDS, rate: float | None = None, depth: int = trees.DEPTH) -> Trees | None:
    """Boosted trees for each quantile that never fall when floor area or efficiency grows; None under 50 rows.

    Without a ``rate``, fewer rounds take longer steps: the published rate times the published rounds over ``iterations``, a half at most.
    """
    made = training_frame(sales)
    if made is None:
        return None
    frame, means = made
    if frame.count() < MIN_TREE_ROWS:
        return None
    return Trees(trees.fit(frame, categories=categories, quantiles=quantiles, rounds=iterations, rate=rate or min(0.5, trees.RATE * trees.ROUNDS / max(1, iterations)), depth=depth), means)


def predict_trees(rows: DataFrame, fitted: Trees) -> DataFrame:
    """The columns of ``predict_hedonic``; low, mid and high are sorted, which keeps them from falling."""
    p = F.array_sort(F.transform("__p", F.exp))
    low, mid, high = (F.get(p, F.lit(k)) for k in range(3))
    named = "/".join(f"{q:.2f}" for q in fitted.model.quantiles)
    out = _features(rows, fitted.means).withColumn("__p", fitted.model.predict())
    return _priced(out, low, mid, high, fitted.model.rows, f"{TREES} (PPD+EPC, q={named})").select(*rows.columns, *ESTIMATE)


ESTIMATE = ("estimate_gbp", "low_gbp", "high_gbp", "confidence", "basis", "comparables_used", "methodology")


def rises(rows: DataFrame, fitted: Trees, *, factor: float = 1.1) -> DataFrame:
    """How many rows' estimates fall if their floor area grows by ``factor`` (none, if the trees are right)."""
    base = predict_trees(rows, fitted).select("transaction_id", F.col("estimate_gbp").alias("now"))
    more = predict_trees(rows.withColumn("floor_area_sqm", F.col("floor_area_sqm") * factor), fitted).select("transaction_id", F.col("estimate_gbp").alias("then"))
    return base.join(more, "transaction_id").agg(F.count("*").alias("rows"), F.count_if(F.col("then") < F.col("now")).alias("falls"))


def value(rows: DataFrame, sales: DataFrame, method: str = "mean", **how) -> DataFrame:
    """Fit on ``sales`` and value ``rows`` (postcode, property_type and the model's columns) in one go.

    ``method``: mean, quantile or trees. A model that has too few rows falls back to the mean model, and that to tiers of
    comparables; so does a row that the model can't value. The methodology column says what was used.
    """
    name = {"mean": MEAN, "quantile": QUANTILE, "trees": TREES}[method]
    made, model, middle = None, None, True
    if method == "quantile" and (model := fit_quantiles(sales, **how)) is not None:
        made, middle = predict_quantiles(rows, model), len(model.models) > 1
    elif method == "trees" and (model := fit_trees(sales, **how)) is not None:
        made, middle = predict_trees(rows, model), len(model.model.quantiles) > 1
    elif (model := fit_hedonic(sales)) is not None:
        made = predict_hedonic(rows, model)
        if method != "mean":
            made = made.withColumn("methodology", F.lit(f"{name} (PPD+EPC, degraded to mean hedonic)"))
    if made is not None and model.means["floor"] > 0 and middle:
        return made.select(*rows.columns, *ESTIMATE)  # a model with a middle values every row whose floor area is known or assumed
    pool = valuation.comparables(sales)
    degraded = F.lit(f"{name} (PPD+EPC, degraded to median baseline)")
    if made is None:
        return valuation.estimate(rows, pool).withColumn("methodology", degraded).select(*rows.columns, *ESTIMATE)
    left = valuation.estimate(made.filter("estimate_gbp is null").select(*rows.columns), pool).withColumn("methodology", degraded)
    return made.filter("estimate_gbp is not null").select(*rows.columns, *ESTIMATE).unionByName(left.select(*rows.columns, *ESTIMATE))


def temporal_split(sales: DataFrame, months: int, *, date: str = "transfer_date") -> tuple[DataFrame, DataFrame]:
    """Training and test sales: the last ``months`` blocks of 30 days are test; rows without a date go."""
    dated = sales.withColumn("__d", F.try_to_date(F.col(date).cast("string"), "y-M-d")).filter("__d is not null")
    cutoff = dated.agg(F.date_sub(F.max("__d"), 30 * months)).first()[0]
    if cutoff is None:
        return dated.drop("__d"), dated.drop("__d")
    return dated.filter(F.col("__d") < cutoff).drop("__d"), dated.filter(F.col("__d") >= cutoff).drop("__d")


def score(predicted: DataFrame) -> DataFrame:
    """Scored rows of (price, area, property_type, estimate_gbp, low_gbp, high_gbp): error, share of the price, inside the band."""
    ok = predicted.filter((F.col("price") > 0) & (F.col("estimate_gbp") > 0) & F.col("area").isNotNull())
    error = F.abs(F.col("estimate_gbp") - F.col("price"))
    return ok.withColumns({"abs_error": error, "ape": error / F.col("price"), "inside": F.col("price").between(F.col("low_gbp"), F.col("high_gbp"))})


def report(scored: DataFrame) -> DataFrame:
    """Headline (area and property_type null, level 3) and a row for each area and type (level 0)."""
    g = scored.groupingSets([["area", "property_type"], []], "area", "property_type")
    return g.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.median("ape").alias("median_ape"), F.avg("ape").alias("mean_ape"), F.bround(F.median("abs_error"), 0).cast("long").alias("median_abs_error"), F.avg(F.col("inside").cast("double")).alias("coverage"))


def compare(predictions: dict[str, DataFrame]) -> DataFrame:
    """The headline of ``report`` for each named table of predictions on the same rows: model, n, errors and coverage."""
    both = None
    for name, rows in predictions.items():
        one = score(rows).select(F.lit(name).alias("model"), "ape", "abs_error", "inside")
        both = one if both is None else both.unionByName(one)
    both = staged(both)
    named = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("ape", "abs_error")))
    q = ranks.quantiles_of_few(both.select("model", F.explode(named).alias("x")).select("model", "x.*"), ["model", "measure"], [0.5])
    medians = q.groupBy("model").agg(*(F.max(F.when(F.col("measure") == c, F.col("q")[0])).alias(c) for c in ("ape", "abs_error")))
    sums = both.groupBy("model").agg(F.count("*").alias("n"), F.avg("ape").alias("mean_ape"), F.avg(F.col("inside").cast("double")).alias("coverage"))
    return sums.join(medians, "model", "left").select("model", "n", F.col("ape").alias("median_ape"), "mean_ape", F.bround("abs_error", 0).cast("long").alias("median_abs_error"), "coverage")
