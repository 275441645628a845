"""Exact ranks of counted values, and search from many seeds at once, against plain Python."""

import collections
import random

import numpy as np
import pytest

from hearthspark.operators import ownership, ranks, valuation


def test_ranks_and_quantiles_equal_sorted_values(spark):
    rng = random.Random(4)
    rows = []
    for key in ("a", "b", None, "one", "same"):
        n = {"one": 1, "same": 50}.get(key, 400)
        rows += [(key, 7 if key == "same" else rng.choice([rng.randrange(1, 50), rng.randrange(100_000, 100_300), 10**rng.randrange(1, 12)]), 1 + (k % 3)) for k in range(n)]
    values = collections.defaultdict(list)
    for key, v, c in rows:
        values[key] += [v] * c
    df = spark.createDataFrame(rows, "key string, value long, count long").repartition(6)
    got = {r["key"]: r for r in ranks.values_at(df, ["key"], {"first": lambda n: n * 0, "middle": lambda n: (n / 2).cast("long"), "last": lambda n: n - 1, "beyond": lambda n: n}).collect()}
    for key, v in values.items():
        v.sort()
        assert (got[key]["n"], got[key]["first"], got[key]["middle"], got[key]["last"], got[key]["beyond"]) == (len(v), v[0], v[len(v) // 2], v[-1], None)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for r in ranks.quantiles(df, ["key"], shares).collect():
        assert np.allclose(r["q"], np.quantile(values[r["key"]], shares), rtol=1e-12)
    assert ranks.quantiles(df.limit(0), ["key"], shares).count() == 0


def test_price_blocks_of_ties_and_even_numbers(spark):
    df = spark.createDataFrame([("x", 1), ("x", 4), ("x", 2), ("x", 2), (None, 9), ("x", None), ("y", -1)], "k string, price long")
    assert sorted(map(tuple, valuation.price_block(df, "k").collect()), key=str) == [("x", 4, 2, 2, 1, 4), (None, 1, 9, 9, 9, 9)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_search_equals_breadth_first_search(spark, depth):
    rng = random.Random(depth)
    pairs = {(f"officer:{rng.randrange(150)}", f"company:{min(rng.randrange(90), rng.randrange(90))}") for _ in range(260)} | {(f"officer:{k}", "company:hub") for k in range(0, 150, 2)}
    same = {("company:5", "company:77"), ("company:hub", "company:8")}
    near, twin = collections.defaultdict(set), collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for a, b in same:
        twin[a].add(b)
    seeds = [f"officer:{k}" for k in range(150)] + ["company:3", "alone"]
    want = set()
    for seed in seeds:
        depth_of, front = {seed: 0}, [seed]
        for d in range(1, depth + 1):
            step = {y for x in front for y in near[x]}
            step |= {z for y in step for z in twin[y]}
            front = [y for y in step if y not in depth_of]
            depth_of |= dict.fromkeys(front, d)
        want |= {(seed, node, d) for node, d in depth_of.items()}
    edge_table = spark.createDataFrame(sorted(pairs), "source string, target string")
    found = ownership.search(edge_table, spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "seed string"), depth, same=spark.createDataFrame(sorted(same), "source string, target string"))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
