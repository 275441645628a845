"""Links across stretches of time, from one sort."""

import random

from pyspark.sql import functions as F

from hearthspark.operators import linkage


def test_linkage_sorts_once_and_sends_only_a_stretchs_ends(spark):
    rng = random.Random(4)
    day = lambda: f"20{rng.randrange(10, 20)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    sales = spark.createDataFrame([(str(k), rng.choice("ab"), day()) for k in range(150)], "transaction_id string, address_key string, d string").withColumn("sale_date", F.to_date("d"))
    certs = spark.createDataFrame([(f"k{k % 90}", float(k % 7), "C", k % 5, rng.choice("ab"), day()) for k in range(60)], "lmk_key string, floor_area_sqm double, energy_rating string, energy_efficiency int, address_key string, d string").withColumn("inspection_date", F.to_date("d"))
    for days, prefer in ((30, True), (365, False), (1825, True)):
        out = linkage.nearest(sales, certs, "address_key", max_days=days, prefer_before_sale=prefer)
        s, c = [r.asDict() for r in sales.collect()], [r.asDict() for r in certs.collect()]
        want = {}
        for x in s:
            near = [(int(y["inspection_date"] > x["sale_date"]) if prefer else 0, abs((y["inspection_date"] - x["sale_date"]).days), y["inspection_date"] > x["sale_date"], y["lmk_key"]) for y in c if y["address_key"] == x["address_key"] and abs((y["inspection_date"] - x["sale_date"]).days) <= days]
            if near:
                want[x["transaction_id"]] = min(near)[1]
        found = {r["transaction_id"]: r["inspection_date"] for r in out.collect()}
        dates = {x["transaction_id"]: x["sale_date"] for x in s}
        assert {k: abs((v - dates[k]).days) for k, v in found.items()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
