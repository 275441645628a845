"""Edge cases of the property operators: borders, holes, repeated labels, small pools, null prices, versions of a table."""

import math

import pytest
from pyspark.sql import functions as F

from hearthspark.operators import geo, hazards, listings, models, places, registers, temporal, valuation
from hearthspark.sources import readers
from hearthspark.streaming import feeds


def test_radius_at_borders_equals_brute_force(spark):
    spots = [(i, float(lat), float(lng)) for i, (lat, lng) in enumerate([(0, 179.999), (0, -179.999), (89.9995, 10), (89.9995, -170), (-60, 180), (-60, -180), (51.5, -0.1), (51.5007, -0.1003), (75, 0), (75, 0.01)])]
    a = spark.createDataFrame(spots, "point_id int, lat double, lng double")
    b = a.select(F.col("point_id").alias("stop_id"), "lat", "lng")

    def metres(p, q):
        y1, x1, y2, x2 = (math.radians(v) for v in (p[1], p[2], q[1], q[2]))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))

    for radius in (100, 300, 20_000_000):
        got = {(r["point_id"], r["stop_id"]) for r in geo.within_radius(a, b, radius).collect()}
        assert got == {(p[0], q[0]) for p in spots for q in spots if metres(p, q) <= radius}, radius
    best = {(r["point_id"], r["stop_id"]) for r in geo.nearest(a, b, 2, other_id="stop_id").collect()}
    assert best == {(p[0], q[0]) for p in spots for q in sorted(spots, key=lambda q: (round(metres(p, q), 6), q[0]))[:2]}


def test_holes_and_squares(spark):
    text = '{"properties":{"name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]],[[1,1],[2,1],[2,2],[1,2]]]}}'
    area = readers.polygons(spark.createDataFrame([(text,)], "json string"))
    spots = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.0, 3.0), (4, 5.0, 5.0)], "point_id int, lat double, lng double")
    assert {r["point_id"] for r in geo.contains(spots, area).collect()} == {1, 3}
    near = spark.createDataFrame([(1, 4.05, 2.0), (2, 4.2, 2.0), (3, 2.0, -0.05), (4, -0.05, -0.05), (5, 2.0, 2.0)], "point_id int, lat double, lng double")
    assert {r["point_id"] for r in geo.meets(near, area, 0.1).collect()} == {1, 3, 4, 5}
    assert hazards.listed_buildings(near, area, 1.0).count() == 5


def test_registers_edges(spark):
    text = spark.createDataFrame([("Ward: A | Ward: B | x",), (None,)], "m string").select(registers.meta_text(F.col("m")).alias("m")).collect()
    assert text[0]["m"] == {"ward": "B"} and text[1]["m"] is None
    codes = spark.sql("SELECT array(named_struct('scheme', 'CPV', 'id', '45110000'), named_struct('scheme', 'X', 'id', '45100000')) AS c")
    one = codes.select(registers.has_code(F.col("c"), "45100000").alias("a"), registers.has_code(F.col("c"), "45110000").alias("b"), registers.has_code(F.col("c"), "451", prefix=True).alias("d")).first()
    assert tuple(one) == (False, True, True)
    notice = '{"id":"n","title":"T","cpvCodes":[{"code":"1"},{"id":"2"}],"Organisation":{"name":"B"},"valueHigh":9}'
    n = registers.notices(spark.createDataFrame([(notice,), ("junk",)], "json string")).collect()
    assert len(n) == 1 and [c["id"] for c in n[0]["classifications"]] == ["1", "2"] and (n[0]["buyer"], n[0]["amount_high"]) == ("B", 9.0)


def test_ladder_falls_through(spark):
    rows = [(i, f"LS{1 + i % 3} 1AA", "D", "FREEHOLD", "LS", "UNKNOWN", 100_000 + 1000 * i, 80.0 + i, 60) for i in range(40)]
    schema = "transaction_id int, postcode string, property_type string, tenure string, area string, age_band string, price long, floor_area_sqm double, energy_efficiency int"
    sales = spark.createDataFrame(rows, schema)
    for method, n, words in (("mean", 40, "hedonic-log-price (PPD+EPC)"), ("quantile", 40, "quantile-hedonic-log-price (PPD+EPC, q=0.10/0.50/0.90)"), ("quantile", 25, "degraded to mean hedonic"), ("trees", 40, "degraded to mean hedonic"), ("mean", 10, "degraded to median baseline"), ("quantile", 10, "degraded to median baseline")):
        got = models.value(sales, sales.filter(F.col("transaction_id") < n), method).collect()
        assert len(got) == 40 and all(words in r["methodology"] for r in got), (method, n)
        assert all(r["low_gbp"] <= r["estimate_gbp"] <= r["high_gbp"] for r in got)
    bare = models.value(sales, sales.withColumn("floor_area_sqm", F.lit(None).cast("double")), "mean").collect()
    assert {r["basis"] for r in bare} == {"postcode_type"}


def test_index_to_a_month(spark):
    index = spark.createDataFrame([("N", "2020-01", 100.0), ("N", "2020-06", 150.0), ("N", "2020-09", 300.0)], "region string, month string, value double")
    sold = spark.createDataFrame([("N", "2020-03-05", 100), ("N", "2020-10-01", 100), ("N", "2019-01-01", 100), ("X", "2020-03-05", 100), ("N", "", 100)], "region string, transfer_date string, price int")
    assert [r["adjusted_price"] for r in temporal.adjust(sold, index).collect()] == [300, 100, 100, 100, 100]
    assert [r["adjusted_price"] for r in temporal.adjust(sold, index, to="2020-07").collect()] == [150, 100, 100, 100, 100]
    with pytest.raises(Exception, match="negative price"):
        temporal.adjust(sold.withColumn("price", F.lit(-1)), index).collect()


def test_yields_without_valuation(spark):
    rows = spark.createDataFrame([(0, 500.0, None, "listing"), (120_000, 500.0, 0.25, "listing")], "estimate_gbp long, monthly_rent_gbp double, costs_pct double, rent_source string")
    got = valuation.rental_yield(rows).orderBy("estimate_gbp").collect()
    assert got[0]["gross_yield_pct"] is None and got[0]["methodology"] is None and (got[1]["gross_yield_pct"], got[1]["net_yield_pct"]) == (5.0, 3.75)


def test_kinds_of_change(spark):
    rows = [("s", 1, 1, 100, 3, "d", "a", "active"), ("s", 2, 2, 100, 4, "d", "a", "active"), ("s", 3, 3, 100, 2, "d", "a", "active"), ("s", 4, 4, 100, 2, "e", "a", "active"), ("s", 5, 5, 100, 2, "e", "b", "active"), ("s", 6, 6, 100, 2, "e", "b", "sold_stc"), ("s", 7, 7, 100, 2, "e", "b", "removed"), ("t", 1, 8, 1, 1, "d", "a", "active")]
    df = spark.createDataFrame(rows, "source_id string, captured_at int, event_id int, price_pence long, images int, description string, agent string, status string").withColumn("features", F.array().cast("array<string>"))
    got = listings.changes(df, deleted_before=F.lit(2)).orderBy("event_id", "kind").collect()
    assert [r["kind"] for r in got] == ["new", "photos_added", "photos_removed", "description_changed", "agent_changed", "sold_stc", "removed_sold_stc", "deleted", "new"]
    assert got[4]["field_changes"] == {"agent": got[4]["field_changes"]["agent"]} and tuple(got[4]["field_changes"]["agent"]) == ("a", "b")


def test_price_changes_of_null_prices(spark, tmp_path):
    rows = [(1, 1, 1, 100), (1, 2, 2, None), (1, 3, 3, 90), (None, 4, 4, 5)]
    spark.createDataFrame(rows, "source_id long, event_id long, captured_at long, price_pence long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id long, event_id long, captured_at long, price_pence long").parquet(str(tmp_path / "in"))
    got = feeds.run_once(feeds.price_changes(stream), None, mode="append").orderBy("event_id").collect()
    assert [(r["event_id"], r["previous_price"], r["kind"]) for r in got] == [(1, None, "new"), (3, 100, "price_reduced")]


def test_versions_merge_by_key(spark, tmp_path):
    schema = "k long, v long"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, rows in enumerate(([(1, 1), (2, 1)], [(2, 2), (3, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        feeds.upsert(stream, out, state, keys=["k"], mode="append").awaitTermination()
    assert {tuple(r) for r in feeds.current(spark, out).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_unknown_postcodes_are_null(spark):
    g = places.geography(spark.createDataFrame([("ls1 4ab", 53.8, -1.5), ("junk", 1.0, 1.0)], "postcode string, lat double, lng double"))
    asked = spark.createDataFrame([("LS1 4AB",), ("ZZ1 1ZZ",)], "postcode string")
    got = {r["postcode"]: r["n_stops"] for r in places.neighbourhood(asked, g, {"stops": spark.createDataFrame([], "postcode string, n_stops long")}).collect()}
    assert got == {"LS1 4AB": 0, "ZZ1 1ZZ": None}
    d = places.distances(spark.createDataFrame([("ls14ab", "LS1 4AB"), ("LS1 4AB", "ZZ1 1ZZ")], "postcode_a string, postcode_b string"), g).collect()
    assert [r["metres"] for r in d] == [0.0, None]
