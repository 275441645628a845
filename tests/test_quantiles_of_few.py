"""Quantiles of a few large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthspark.operators import ranks


@pytest.mark.parametrize("values", [[1.5], [0.0, 0.0, -1.0, 2.0, 7.25], [random.Random(1).gauss(0, 1) for _ in range(500)], [float(k % 5) for k in range(37)]])
def test_quantiles_of_few_groups(spark, values):
    rows = spark.createDataFrame([(g, v * (g or 1)) for g in (None, 2) for v in values] + [(2, None)], "g int, value double")
    shares = [0.25, 0.5, 0.75]
    want = {r["g"]: (r["n"], r["q"]) for r in rows.groupBy("g").agg(F.count("value").alias("n"), F.percentile("value", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r["g"]: (r["n"], r["q"]) for r in ranks.quantiles_of_few(rows, ["g"], shares).collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and np.allclose(got[g][1], want[g][1], rtol=1e-12, atol=1e-12) for g in want)
