"""Boosted quantile trees against a builder in plain Python, and their promise never to fall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthspark.operators import models, trees


def market(n, seed, *, odd=False):
    """Sales whose prices fall for the largest dwellings where ``odd``."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        floor = rng.uniform(40, 150)
        area = rng.choice(["N", "SW", "E"])
        log_price = 10 + 0.8 * math.log(floor) + {"N": 0.3, "SW": 0.0, "E": -0.2}[area] + rng.gauss(0, 0.05 + 0.1 * (floor > 100))
        if odd and floor > 110:
            log_price -= 1.5 * (floor - 110) / 40
        out.append((str(k), int(math.exp(log_price)), floor if k % 17 else None, rng.choice([None, 40, 55, 70, 85]), rng.choice("DTF"), rng.choice(["FREEHOLD", "LEASEHOLD"]), area, "UNKNOWN", f"{area}1 1AA"))
    return out


SCHEMA = "transaction_id string, price long, floor_area_sqm double, energy_efficiency int, property_type string, tenure string, area string, age_band string, postcode string"


def plain_forest(rows, numbers, categories, quantiles, rounds, rate, depth, bounds, levels, start, width, rising):
    """The same model row by row: codes, gradients, splits, bounded steps."""
    codes = [[sum(b < r[c] for b in bs) for c, bs in zip(numbers, bounds, strict=True)] + [ls.index(r[c]) if r[c] in ls else -1 for c, ls in zip(categories, levels, strict=True)] for r in rows]
    out = []
    for q, s in zip(quantiles, start, strict=True):
        estimate = [s] * len(rows)
        for _ in range(rounds):
            def residual_quantile(ids, estimate=estimate, q=q):
                cells = sorted(math.floor((rows[i]["y"] - estimate[i]) / width) for i in ids)
                return (cells[max(1, math.ceil(q * len(cells))) - 1] + 0.5) * width

            def grow(ids, level, low, high, estimate=estimate, q=q, residual_quantile=residual_quantile):
                grad = {i: (rows[i]["y"] <= estimate[i]) - q for i in ids}
                worth = lambda g, n: g * g / (n + trees.L2)
                best, cut = 1e-9, None
                for f in range(len(numbers) + len(categories)):
                    values = range(len(bounds[f])) if f < len(numbers) else range(len(levels[f - len(numbers)]))
                    for v in values:
                        right = [i for i in ids if (codes[i][f] > v if f < len(numbers) else codes[i][f] == v)]
                        left = [i for i in ids if i not in set(right)]
                        if min(len(left), len(right)) < trees.MIN_LEAF:
                            continue
                        gl, gr = ((sum(rows[i]["y"] <= estimate[i] for i in x) - q * len(x)) for x in (left, right))
                        if f < len(numbers) and rising[f] and gl / (len(left) + trees.L2) < gr / (len(right) + trees.L2):
                            continue
                        gain = worth(gl, len(left)) + worth(gr, len(right)) - worth(sum(rows[i]["y"] <= estimate[i] for i in ids) - q * len(ids), len(ids))
                        if gain > best:
                            best, cut = gain, (f, left, right)
                if level == depth or cut is None:
                    step = rate * min(high, max(low, residual_quantile(ids)))
                    return dict.fromkeys(ids, step)
                f, left, right = cut
                middle = sum(min(high, max(low, residual_quantile(x))) for x in (left, right)) / 2
                a, b = ((low, middle), (middle, high)) if f < len(numbers) and rising[f] else ((low, high), (low, high))
                return grow(left, level + 1, *a) | grow(right, level + 1, *b)

            steps = grow(list(range(len(rows))), 0, -math.inf, math.inf)
            estimate = [e + steps[i] for i, e in enumerate(estimate)]
        out.append(estimate)
    return np.array(out).T


def test_trees_equal_a_plain_builder(spark):
    rng = random.Random(3)
    rows = [{"x": rng.uniform(0, 10), "z": rng.uniform(-1, 1), "c": rng.choice(["a", "b", None]), "d": rng.choice(["p", "q", "r"])} for _ in range(160)]
    for r in rows:
        r["y"] = math.sin(r["x"]) + 0.2 * r["x"] - r["z"] + {"a": 1.0, "b": -0.5, None: 0.0}[r["c"]] + rng.gauss(0, 0.3)
    df = spark.createDataFrame([(k, r["x"], r["z"], r["c"], r["d"], r["y"]) for k, r in enumerate(rows)], "k int, x double, z double, c string, d string, y double").repartition(5)
    quantiles, rounds, rate, depth = (0.1, 0.5, 0.9), 5, 0.3, 3
    for settle_every in (2, 100):
        m = trees.fit(df, y="y", numbers=("x", "z"), rising=(True, False), categories=("c", "d"), quantiles=quantiles, rounds=rounds, rate=rate, depth=depth, bins=16, settle_every=settle_every)
        got = {r["k"]: r["p"] for r in df.select("k", m.predict().alias("p")).collect()}
        y = [r["y"] for r in rows]
        want = plain_forest(rows, ("x", "z"), ("c", "d"), quantiles, rounds, rate, depth, m.bounds, m.levels, m.start, (max(y) - min(y)) / trees.CELLS, (True, False))
        assert np.allclose([got[k] for k in range(len(rows))], want, atol=1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_estimates_never_fall(spark, seed):
    sales = spark.createDataFrame(market(400, seed, odd=True), SCHEMA)
    fitted = models.fit_trees(sales, iterations=12, rate=0.3, depth=4)
    for factor in (1.02, 1.1, 1.7):
        assert models.rises(sales, fitted, factor=factor).first()["falls"] == 0
    ladder = spark.range(1).select(F.explode(F.sequence(F.lit(30), F.lit(200), F.lit(2))).alias("f"))
    some = ladder.selectExpr("cast(f as string) transaction_id", "1L price", "cast(f as double) floor_area_sqm", "60 energy_efficiency", "'D' property_type", "'FREEHOLD' tenure", "'N' area", "'UNKNOWN' age_band", "f")
    for column in ("estimate_gbp", "low_gbp", "high_gbp"):
        got = [r[column] for r in models.predict_trees(some, fitted).orderBy("f").collect()]
        assert got == sorted(got) and got[0] < got[-1]
    better = some.filter("f = 100").drop("energy_efficiency").join(spark.range(10, 100, 5).select(F.col("id").cast("int").alias("energy_efficiency")))
    got = [r["estimate_gbp"] for r in models.predict_trees(better, fitted).orderBy("energy_efficiency").collect()]
    assert got == sorted(got)


def test_bands_cover_and_follow_the_spread(spark):
    sales = spark.createDataFrame(market(1500, 9), SCHEMA)
    fitted = models.fit_trees(sales, iterations=25, rate=0.2, depth=4)
    got = models.predict_trees(sales, fitted).collect()
    assert 0.74 < sum(r["low_gbp"] <= r["price"] <= r["high_gbp"] for r in got) / len(got) < 0.88
    assert np.median([abs(r["estimate_gbp"] / r["price"] - 1) for r in got]) < 0.08
    share = lambda keep: np.median([(r["high_gbp"] - r["low_gbp"]) / r["estimate_gbp"] for r in got if r["floor_area_sqm"] and keep(r["floor_area_sqm"])])
    assert share(lambda f: f > 110) > 1.5 * share(lambda f: f < 90)  # one band for all could not do that


def test_few_rows_and_no_rows(spark):
    sales = spark.createDataFrame(market(49, 1), SCHEMA)
    assert models.fit_trees(sales) is None
    assert trees.fit(sales.limit(0).selectExpr("1D log_price", "1D log_floor", "1D eff")) is None
    same = spark.range(60).selectExpr("2D log_price", "1D log_floor", "cast(null as double) eff", "'x' c").withColumn("eff", F.lit(0.0))
    m = trees.fit(same, categories=("c",), rounds=2, depth=2)
    assert {tuple(r[0]) for r in same.select(m.predict()).collect()} and all(abs(v - 2) < 1e-6 for r in same.select(m.predict()).collect() for v in r[0])
