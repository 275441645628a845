"""Penalised quantile lines against a dense solver in plain numpy, and the gap that they prove."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthspark.operators import models, pinball

NUMBERS, LEVELS = ("x", "v"), {"c": ["a", "b", "c"], "d": ["k", "l"]}


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x, v, c, d = float(rng.normal(4, 0.4)), float(rng.normal(0, 9)), ["a", "b", "c", None, "other"][rng.integers(5)], ["k", "l", None][rng.integers(3)]
        y = 12 + 0.7 * x + 0.01 * v + {"a": 0.4, "b": -0.3}.get(c, 0.0) + (0.2 if d == "k" else 0.0) + float(rng.standard_t(3)) * 0.2
        rows.append((y, x, v, c, d))
    rows += rows[:40]  # repeated rows and ties
    return rows, spark.createDataFrame(rows, "y double, x double, v double, c string, d string")


def design(rows):
    return np.array([[1.0, x, v, *(float(c == k) for k in LEVELS["c"]), *(float(d == k) for k in LEVELS["d"])] for _, x, v, c, d in rows])


def objective(b, x, y, q, penalty):
    r = y - x @ b
    return np.maximum(q * r, (q - 1) * r).mean() + penalty * np.abs(b[1:]).sum()


def reference_optimum(x, y, q, penalty):
    """Alternating directions on the same objective, dense and long: an upper bound that is near the optimum."""
    n, p = x.shape
    a = np.vstack([x, np.eye(p)[1:]])
    t = np.concatenate([y, np.zeros(p - 1)])
    up, down = np.r_[np.full(n, q / n), np.full(p - 1, penalty)], np.r_[np.full(n, (1 - q) / n), np.full(p - 1, penalty)]
    best, solve = np.inf, np.linalg.pinv(a)
    rho = 0.02
    r, u = np.zeros(len(t)), np.zeros(len(t))
    for _ in range(60_000):
        b = solve @ (t - r - u)
        g = t - a @ b - u
        r = np.where(g > up / rho, g - up / rho, np.where(g < -down / rho, g + down / rho, 0.0))
        u = u + r - (t - a @ b)
        best = min(best, objective(b, x, y, q, penalty))
    return best


def test_objective_is_the_optimum(made):
    rows, df = made
    x, y = design(rows), np.array([r[0] for r in rows])
    start = np.linalg.lstsq(x, y, rcond=1e-10)[0]
    lines = pinball.fit(df, (0.1, 0.5, 0.9), start, LEVELS, y="y", numbers=NUMBERS)
    for q, line in lines.items():
        got = objective(line.coefficients, x, y, q, 1e-3)
        assert 0 <= line.gap <= 1e-6 and line.steps < 40
        assert abs(got - line.objective) < 1e-9
        want = reference_optimum(x, y, q, 1e-3)
        assert got <= want + 1e-6 and got >= want - 2e-5
        # subgradients of the optimum: as many rows below the line as the quantile says, but for those on it
        r = y - x @ line.coefficients
        assert abs((r < 0).mean() - q) <= (np.abs(r) < 1e-4).mean() + 0.01
    # all quantiles of one fit equal those fitted alone
    alone = pinball.fit(df, (0.9,), start, LEVELS, y="y", numbers=NUMBERS)[0.9]
    assert abs(alone.objective - lines[0.9].objective) < 2e-6


def test_penalty_and_edge_cases(made):
    rows, df = made
    start = np.zeros(8)
    strong = pinball.fit(df, (0.5,), start, LEVELS, y="y", numbers=NUMBERS, penalty=50.0)[0.5]
    assert np.abs(strong.coefficients[1:]).max() < 1e-4  # nothing but the intercept, which is a median
    ys = sorted(r[0] for r in rows)
    assert abs(strong.objective - np.abs(np.array(ys) - np.median(ys)).mean() / 2) < 1e-5
    assert pinball.fit(df.limit(0), (0.5,), start, LEVELS, y="y", numbers=NUMBERS) == {}
    holes = df.unionByName(df.limit(9).withColumn("y", F.lit(None).cast("double")))
    assert abs(pinball.fit(holes, (0.5,), start, LEVELS, y="y", numbers=NUMBERS)[0.5].objective - pinball.fit(df, (0.5,), start, LEVELS, y="y", numbers=NUMBERS)[0.5].objective) < 2e-6
    with pytest.raises(ValueError):
        pinball.fit(df, (0.5,), start, LEVELS, y="y", numbers=NUMBERS, penalty=0.0)
    short = pinball.fit(df, (0.5,), start, LEVELS, y="y", numbers=NUMBERS, steps=2)[0.5]
    assert short.steps == 2 and short.gap > 1e-6  # the gap that is left is told
    flat = pinball.fit(df.withColumn("y", F.lit(3.0)), (0.2, 0.8), start, LEVELS, y="y", numbers=NUMBERS)
    assert all(line.objective < 1e-6 and line.gap <= 1e-6 for line in flat.values())


def test_models_tell_their_gaps(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(200_000 * np.exp(rng.normal(0, 0.2))), float(60 + i % 50), 50 + i % 30, "DF"[i % 2], "F", "AB"[i % 2], "UNKNOWN") for i in range(60)]
    sales = spark.createDataFrame(rows, "id int, price long, floor_area_sqm double, energy_efficiency int, property_type string, tenure string, area string, age_band string")
    m = models.fit_quantiles(sales)
    assert set(m.gaps) == {0.1, 0.5, 0.9} and all(0 <= g <= 1e-6 for g in m.gaps.values())
    assert models.fit_quantiles(sales.limit(29)) is None


def test_large_tables_are_fitted_by_cells_and_proven_on_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 30_000
    x, v, c = rng.normal(4, 0.4, n), rng.normal(0, 9, n), rng.integers(0, 4, n)
    y = 12 + 0.7 * x + 0.01 * v + np.array([0.0, 0.4, -0.3, 0.1])[c] + rng.standard_t(3, n) * (0.1 + 0.05 * x)
    rows = [(float(a), float(b), float(w), [None, "a", "b", "c"][k], "k") for a, b, w, k in zip(y, x, v, c, strict=True)]
    df = spark.createDataFrame(rows, "y double, x double, v double, c string, d string").repartition(4).persist()
    design_, start = design(rows), np.zeros(8)
    taken, interior = [], pinball._interior
    monkeypatch.setattr(pinball, "_interior", lambda *a: (taken.append(a[0].count()), interior(*a)))
    monkeypatch.setattr(pinball, "WHOLE", 5_000)
    monkeypatch.setattr(pinball, "CELLS", 2_000)
    lines = pinball.fit(df, (0.1, 0.9), start, LEVELS, y="y", numbers=NUMBERS)
    assert taken and max(taken) < n / 5  # no step ran over the rows themselves
    for q, line in lines.items():
        got = objective(line.coefficients, design_, y, q, 1e-3)
        assert 0 <= line.gap <= 1e-6 and abs(got - line.objective) < 1e-9
        r = y - design_ @ line.coefficients
        assert abs((r < 0).mean() - q) < 0.01
    # few steps: the gap that is left is told, and is one of all rows
    short = pinball.fit(df, (0.9,), start, LEVELS, y="y", numbers=NUMBERS, steps=2)[0.9]
    assert short.steps == 2 and short.gap > 1e-6 and abs(objective(short.coefficients, design_, y, 0.9, 1e-3) - short.objective) < 1e-9
    assert short.objective - short.gap <= lines[0.9].objective
    # no rounds: every row by itself gives the same optimum
    monkeypatch.setattr(pinball, "ROUNDS", 0)
    whole = pinball.fit(df, (0.9,), start, LEVELS, y="y", numbers=NUMBERS)[0.9]
    assert taken[-1] == n and whole.gap <= 1e-6 and abs(whole.objective - lines[0.9].objective) < 1e-6
    df.unpersist()
