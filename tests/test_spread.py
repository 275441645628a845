"""Work on small files is spread over tasks, and frequent keys are split."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthspark.functions import text
from hearthspark.operators import cover, geo, hazards, ownership, ranks, registers, valuation
from hearthspark.plans import field_queries

SMALL = "/root/testdata/sf0.001"


def _tasks_with_rows(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_bands_of_a_frequent_postcode_are_spread(spark):
    rows = spark.createDataFrame([(k, "sa1 1ab" if k % 2 else "SA1 1AB", "abc"[k % 3]) for k in range(60)] + [(90, "G1 1AA", "a"), (91, "N/A", "a"), (92, None, "a")], "property_id long, postcode string, band string").coalesce(1)
    out = registers.council_tax(rows.select("property_id", "postcode"), rows)
    assert sorted((r["property_id"], r["band"], r["band_property"]) for r in out.collect()) == sorted((k, "ABC"[j % 3], j) for k in range(60) for j in range(60))
    assert _tasks_with_rows(out) > 1


@pytest.mark.parametrize("query", [field_queries.fields_of_records, field_queries.fields_of_texts])
def test_fields_of_a_small_file_are_spread(spark, query):
    assert _tasks_with_rows(query(spark, SMALL)) > 1


def test_edges_are_dealt_by_edge_before_they_are_counted(spark):
    rows = spark.createDataFrame([(k % 3, k % 5, k % 2) for k in range(60)], "officer long, company long, active int").coalesce(1)
    out = ownership.edges(rows)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.select("source", "target", "active").collect()) == sorted((f"officer:{a}", f"company:{b}", 1) for a in range(3) for b in range(5))


def test_a_hubs_neighbours_are_split_into_lists(spark, monkeypatch):
    monkeypatch.setattr(ownership, "_LISTED", 7)
    e = ownership.edges(spark.createDataFrame([(k, 0, 1) for k in range(50)], "officer long, company long, active int"))
    found = ownership.search(e, e.select(F.col("source").alias("seed")), 2)
    assert found.count() == 50 * 51 == found.distinct().count()
    assert found.groupBy("depth").count().orderBy("depth").collect() == [(0, 50), (1, 50), (2, 50 * 49)]


def test_counts_come_from_cells_and_not_from_pairs(spark, monkeypatch):
    monkeypatch.setattr(geo, "within_radius", lambda *a, **k: pytest.fail("pairs are made"))
    draw = random.Random(3)
    spots = [(draw.uniform(50, 51), draw.uniform(-1, 1)) for _ in range(150)] + [(89.95, draw.uniform(-180, 180)) for _ in range(20)] + [(10 + draw.uniform(0, 0.3), draw.choice([-179.9, 179.9])) for _ in range(20)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots[::3])] + [(999, None, None)], "point_id int, lat double, lng double")
    stops = spark.createDataFrame([(k, *p, k % 3) for k, p in enumerate(spots)] + [(999, None, 1.0, 0)], "stop_id int, lat double, lng double, stop_type int")
    for radius in (300.0, 30_000.0):
        d = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("b"), F.col("l"))
        pairs = [(r["point_id"], r["stop_type"]) for r in points.crossJoin(stops.withColumnsRenamed({"lat": "b", "lng": "l"})).filter(d <= radius).collect()]
        found = {r["point_id"]: (r["n_0"], r["n_1"]) for r in geo.category_counts(points, stops, radius, [0, 1]).collect()}
        assert found == {k: (pairs.count((k, 0)), pairs.count((k, 1))) for k in [*range(len(spots[::3])), 999]}
        near = {r["point_id"]: r["n"] for r in geo.counts_within(points, stops, radius, "n").collect()}
        assert near == dict(Counter(k for k, _ in pairs))


def test_a_small_polygons_cover_is_fine_and_equal_rings_are_one(spark, monkeypatch):
    square = [{"x": x, "y": y} for x, y in ((0.1, 50.1), (1.1, 50.1), (1.1, 51.1), (0.1, 51.1))]
    cells = list(cover.cells_of(square, None))
    assert len(cells) >= 9 and len({c[:3] for c in cells}) == len(cells) and any(c[3] is None for c in cells)
    seen, plain = [], geo.contains
    monkeypatch.setattr(geo, "contains", lambda p, r: seen.append(r.count()) or plain(p, r))
    points = spark.createDataFrame([(k, 50.0 + k / 10, 0.5) for k in range(15)], "point_id int, lat double, lng double")
    rows = spark.createDataFrame([("green-belt", square)] * 3 + [("flood-risk-zone", square)], "dataset string, ring array<struct<x:double,y:double>>")
    found = {r["point_id"]: (r["green-belt"], r["flood-risk-zone"], r["conservation-area"]) for r in hazards.constraints(points, rows).collect()}
    assert found == {k: (3, 1, 0) if 50.1 <= 50.0 + k / 10 < 51.1 else (0, 0, 0) for k in range(15)} and seen == [2]


def test_ranks_are_dealt_by_bucket_in_one_shuffle(spark):
    rows = spark.createDataFrame([(k % 3, 100 + k % 50, 1) for k in range(600)], "key int, value long, count long").coalesce(1)
    out = ranks.quantiles(rows, ["key"], [0.25, 0.5])
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    want = {}
    for key in range(3):
        values = sorted(100 + k % 50 for k in range(600) if k % 3 == key)
        want[key] = (200, [statistics.quantiles(values, n=4, method="inclusive")[0], statistics.median(values)])
    assert {r["key"]: (r["n"], r["q"]) for r in out.collect()} == want


def test_tiers_are_summed_once(spark):
    sales = spark.createDataFrame([("AB1 2CD", "D", 100 + k % 7) for k in range(40)] + [("AB1 3CD", "S", 50)], "postcode string, property_type string, price long")
    out = valuation.pool_statistics(sales)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["g"], r["pc"] or "", r["type"] or "", r["n"]) for r in out.collect()) == sorted([(2, "AB12CD", "D", 40), (2, "AB13CD", "S", 1), (3, "AB12CD", "", 40), (3, "AB13CD", "", 1), (4, "", "D", 40), (4, "", "S", 1), (5, "", "", 41), (7, "", "", 41)])


def test_plain_addresses_take_the_short_way_and_odd_ones_the_general(spark):
    draw = random.Random(4)
    bits = ["12", "12a", "7B", "High", "St", "st.", "Rd", "Gdns.", " ", " ", "  ", "\t", "\r\n", "\x0b", ",", ", ", ".", ",.", "\u0085", " ", "É", "ß", "Rose", "CRES", "x"]
    odd = [("".join(draw.choice(bits) for _ in range(draw.randrange(0, 9))),) for _ in range(3000)] + [(None,), ("",), (" ",), (",",), (", ,x",)]
    # the marker (a tab that is stripped from both ends) sends the same text the general way
    both = spark.createDataFrame(odd, "a string").withColumn("general", F.concat(F.lit("\t"), "a"))
    for f in (text.paon_of_address, text.street_of_address, text.normalise_postcode):
        assert both.filter(~f(F.col("a")).eqNullSafe(f(F.col("general")))).limit(3).collect() == []
    shown = both.select(text.street_of_address(F.col("a")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert shown.index("CASE WHEN") < shown.index("transform(")  # words aren't looked up one by one unless the text needs it
