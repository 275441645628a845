"""The lenses, seeds and targets of the registered queries are whole tables, and queries on them agree with brute force."""

import inspect
from collections import defaultdict

from hearthspark.operators import models
from hearthspark.plans import place_queries
from hearthspark.plans.lens import view
from hearthspark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_lenses_keep_every_row(spark):
    lineitem, orders = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("lineitem", "orders"))
    assert view(spark, SMALL, "epc").count() == lineitem.count()
    pairs = {(r[0], r[1]) for r in lineitem.select("l_suppkey", "l_partkey").collect()}
    assert {(r["officer"], r["company"]) for r in view(spark, SMALL, "appointments").collect()} == pairs
    months = orders.selectExpr("substr(CAST(o_orderdate AS STRING), 1, 7) AS month").distinct().count()
    assert view(spark, SMALL, "hpi").select("month").distinct().count() == months


def test_ownership_starts_from_every_officer(spark):
    near = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        near[f"officer:{r[0]}"].add(f"company:{r[1]}")
        near[f"company:{r[1]}"].add(f"officer:{r[0]}")
    want = set()
    for seed in [n for n in near if n.startswith("officer:")]:
        depth = {seed: 0}
        for d in (1, 2):
            for n in [n for n, k in depth.items() if k == d - 1]:
                for b in near[n]:
                    depth.setdefault(b, d)
        want |= {(seed, n, d) for n, d in depth.items()}
    assert {(r["seed"], r["node"], r["depth"]) for r in QUERIES["ownership_search"](spark, SMALL).collect()} == want


def test_council_tax_takes_every_target(spark):
    # postcodes beginning with G are Scottish there and have no bands
    ids = {r[0] for r in view(spark, SMALL, "targets").filter("postcode <> 'N/A' AND lower(left(postcode, 1)) <> 'g' AND lower(left(postcode, 2)) NOT IN ('ka', 'pa', 'ia')").select("property_id").collect()}
    got = {r["property_id"] for r in QUERIES["council_tax_bands"](spark, SMALL).collect()}
    assert ids <= got and any(i % 10 for i in got)


def test_quantile_rounds_are_the_operators_own(spark, monkeypatch):
    seen = {}
    fit = models.fit_quantiles

    def watched(*args, **how):
        bound = inspect.signature(fit).bind(*args, **how)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return None

    monkeypatch.setattr(models, "fit_quantiles", watched)
    monkeypatch.setattr(models, "predict_quantiles", lambda rows, _: rows.selectExpr("transaction_id", "price", "price AS low_gbp", "price AS estimate_gbp", "price AS high_gbp"))
    place_queries.quantile_valuation(spark, SMALL)
    assert seen["rounds"] == inspect.signature(fit).parameters["rounds"].default
