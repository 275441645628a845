"""Text functions, models and smaller operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthspark.functions import text as t
from hearthspark.operators import geo, linkage, listings, models, ownership, reference, registers, temporal, valuation


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (t.normalise_postcode, {"sw1a1aa": "SW1A 1AA", " m1 1ae ": "M1 1AE", "bad": None, "": None, None: None}),
        (t.postcode_area, {"SW1A 1AA": "SW", "m1": "M", "1": None}),
        (t.is_scottish, {"EH1 1AA": True, "G1 1AA": True, "GU1 1AA": True, "M1 1AE": False, "EH1": False, None: False}),
        (t.postcode_in_text, {"near SW1A 1AA now": "SW1A 1AA", "in N1 only": None}),
        (t.outcode_in_text, {"in N1 only": "N1", "none": None}),
        (t.normalise_street, {" high  st. ": "HIGH STREET", "Park Gdns": "PARK GARDENS", " ": None}),
        (t.normalise_paon, {" 12a,. ": "12A", "": None}),
        (t.paon_of_address, {"12A High St, Town": "12A", "Rose Cottage, Mill Ln": "ROSE COTTAGE"}),
        (t.street_of_address, {"12A High St, Town": "HIGH STREET", "Rose Cottage, Mill Ln": "MILL LANE", "12": "12"}),
        (t.parse_floor_area, {"1,020.5 m2": 1020.5, "80 sqm": 80.0, "0": None, "10001": None, "x": None, "75 square metres": 75.0}),
        (t.parse_int, {"72": 72, "72.5": None, " 7 ": 7, "": None}),
        (t.normalise_age_band, {"England and Wales: 1900-1929": "1900_1929", "before / pre 1900": "PRE_1900", "post-2002": "POST_2002", "2007 onwards": "POST_2002", "1850": "PRE_1900", "x": "UNKNOWN", None: "UNKNOWN"}),
        (t.price_pence, {"£1,234.50": 123450, "£250k": 25_000_000, "£1.2m": 120_000_000, "free": None}),
        (t.price_qualifier, {"Shared Ownership From £1": "shared_ownership_from", "Offers Over £2": "offers_over", "": "unknown"}),
        (t.sale_tenure_tag, {"share of freehold": "freehold"}),
        (t.tenure_in_text, {"share of freehold": "share_of_freehold"}),
        (t.month_key, {"2024-01": "2024-01", "2024-01-31": "2024-01", "2024-13": None, "2024": None}),
        (t.ons_month, {"01/02/2020": "2020-02", "2020-03": "2020-03"}),
        (t.sale_date, {"Wed, 14 Jan 2026": "2026-01-14", "14/01/2026": "2026-01-14", "2026-1-4": "2026-01-04", "soon": "soon"}),
        (t.council_tax_band, {"Band d": "D", "none": None}),
        (t.pollutant, {"PM2.5 daily": "pm25", "Benzene": "benzene", "ethyl benzene": "other", "Nitrogen dioxide (air)": "no2", "Particulate matter less than 10 micro m (aerosol)": "pm10"}),
        (t.canonical_url, {"http://a/b?c#d": "http://a/b"}),
        (t.council_slug, {" City of  York ": "city-of-york"}),
        (t.vacant_possession, {"Vacant": True, "let on AST": False, "x": None}),
    ],
)
def test_text(spark, f, cases):
    assert dict(zip(cases, column(spark, list(cases), f))) == cases


def test_guide_price(spark):
    got = column(spark, ["£100,000 - £120,000", "£50,000+", "TBA", "£9 - £8", None], t.guide_price)
    assert [tuple(x) if x else None for x in got] == [(10_000_000, 12_000_000, "guide_price"), (5_000_000, None, "offers_in_excess_of"), (None, None, "poa"), (900, None, "guide_price"), None]


def test_linkage_prefers_certificates_before_the_sale(spark):
    sale = spark.createDataFrame([("t", 100, "2020-06-15", "M1 1AE", "1", "A Rd"), ("u", 100, "2020-06-15", "M1 1AE", "9", "B Rd"), ("v", 1, None, "M1 1AE", "1", "A Rd")], "transaction_id string, price long, transfer_date string, postcode string, paon string, street string")
    rows = [("late", "1 A Road", "M1 1AE", "2020-06-16"), ("early", "1 A Road", "M1 1AE", "2017-01-01"), ("older", "1 A Road", "M1 1AE", "2016-01-01"), ("blank", "1 A Road", "M1 1AE", "")]
    epc = spark.createDataFrame([(*r, "80", "C", "72") for r in rows], "lmk_key string, address string, postcode string, inspection_date string, total_floor_area string, current_energy_rating string, current_energy_efficiency string")
    got = {r["transaction_id"]: (r["lmk_key"], r["match_quality"]) for r in linkage.enrich(sale, epc).collect()}
    assert got == {"t": ("early", "exact_address"), "u": (None, "none"), "v": (None, "none")}
    got = {r["transaction_id"]: (r["lmk_key"], r["match_quality"]) for r in linkage.enrich(sale, epc, prefer_before_sale=False, postcode_fallback=True).collect()}
    assert got["t"] == ("late", "exact_address") and got["u"] == ("late", "postcode_only")


def test_index(spark):
    index = spark.createDataFrame([("r", "2020-01", 100.0), ("r", "2020-03", 150.0), ("r", "2020-03", 1.0), ("r", "2020-05", -1.0), ("r", "x", 1.0), ("r", "2020-06", 200.0)], "region string, month string, value double")
    good, bad = temporal.validate_index(index)
    assert {r["month"] for r in good.collect()} == {"2020-01", "2020-06"} and sorted(r["reason"] for r in bad.collect()) == ["duplicate", "duplicate", "month", "value"]
    rows = spark.createDataFrame([(1, "r", "2020-02-10", 100), (2, "r", "2019-01-01", 100), (3, "r", "", 100), (4, "r", "2021-01-01", 100)], "id int, region string, transfer_date string, price long")
    assert {r["id"]: r["adjusted_price"] for r in temporal.adjust(rows, good).collect()} == {1: 200, 2: 100, 3: 100, 4: 100}


def test_valuation_without_sales(spark):
    targets = spark.createDataFrame([(1, "M1 1AE", "D"), (2, "bad", None)], "property_id int, postcode string, property_type string")
    pool = spark.createDataFrame([("M1 1AE", "D", 100)] * 2, "postcode string, property_type string, price long")
    got = {r["property_id"]: (r["estimate_gbp"], r["basis"], r["confidence"]) for r in valuation.estimate(targets, pool).collect()}
    assert got == {1: (0, "insufficient_data", "low"), 2: (0, "insufficient_data", "low")}


@pytest.fixture(scope="module")
def priced(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        kind, floor, eff = "DSTF"[i % 4], float(rng.uniform(40, 200)), float(rng.uniform(30, 95))
        y = 8 + 0.7 * np.log(floor) + 0.004 * (eff - 60) + {"D": 0.5, "S": 0.2, "T": 0.0, "F": -0.1}[kind] + rng.normal(0, 0.1)
        rows.append((i, int(np.exp(y)), floor, eff, kind, "FREEHOLD" if i % 3 else "LEASEHOLD", "AB"[i % 2], "UNKNOWN"))
    return spark.createDataFrame(rows, "id int, price long, floor_area_sqm double, energy_efficiency double, property_type string, tenure string, area string, age_band string").cache()


def test_least_squares_equals_numpy(priced):
    frame, _ = models.training_frame(priced)
    m = models.fit_linear(frame)
    got = {r["id"]: r["p"] for r in frame.select("id", m.predict().alias("p")).collect()}
    rows = frame.orderBy("id").collect()
    levels = [(c, v) for c in models.CATEGORIES for v in sorted({r[c] for r in rows})]
    x = np.array([[1, r["log_floor"], r["eff"], *(float(r[c] == v) for c, v in levels)] for r in rows])
    y = np.array([r["log_price"] for r in rows])
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([got[r["id"]] for r in rows], want, atol=1e-6)


def test_hedonic_band_and_quantiles(priced):
    m = models.fit_hedonic(priced)
    got = models.predict_hedonic(priced, m).collect()
    assert np.median([abs(r["estimate_gbp"] / r["price"] - 1) for r in got]) < 0.1 and all(r["low_gbp"] <= r["estimate_gbp"] <= r["high_gbp"] for r in got)
    assert 0.4 < np.mean([r["low_gbp"] <= r["price"] <= r["high_gbp"] for r in got]) < 0.6
    q = models.predict_quantiles(priced, models.fit_quantiles(priced, rounds=8)).collect()
    assert all(r["low_gbp"] <= r["estimate_gbp"] <= r["high_gbp"] for r in q)
    assert 0.04 < np.mean([r["price"] < r["low_gbp"] for r in q]) < 0.16 and 0.04 < np.mean([r["price"] > r["high_gbp"] for r in q]) < 0.16
    assert models.fit_hedonic(priced.limit(5)) is None and models.fit_hedonic(priced.withColumn("floor_area_sqm", F.lit(None).cast("double"))) is None


def test_trees(priced):
    rows = priced.withColumn("transaction_id", F.col("id"))
    trees = models.fit_trees(rows, iterations=5)
    got = models.predict_trees(rows, trees).collect()
    assert np.median([abs(r["estimate_gbp"] / r["price"] - 1) for r in got]) < 0.2
    assert 0.6 < np.mean([r["low_gbp"] <= r["price"] <= r["high_gbp"] for r in got]) < 0.95
    assert models.rises(rows, trees).first()["falls"] <= 0.1 * rows.count() and models.fit_trees(rows.limit(40)) is None


def test_geo(spark):
    pts = spark.createDataFrame([(1, 51.5, -0.1), (2, 60.0, -3.0)], "point_id int, lat double, lng double")
    others = spark.createDataFrame([(9, 51.501, -0.1), (8, 51.499, -0.1), (7, 55.0, 2.0)], "stop_id int, lat double, lng double")
    near = {(r["point_id"], r["stop_id"]) for r in geo.within_radius(pts, others, 200).collect()}
    assert near == {(1, 9), (1, 8)}
    got = geo.nearest(pts, others, 2, other_id="stop_id").collect()
    assert {(r["point_id"], r["rank"]) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert geo.grid_ring(spark.createDataFrame([(0, 0)], "row long, col long"), 0).count() == 0 and geo.grid_ring(spark.createDataFrame([(0, 0)], "row long, col long"), 1).count() == 8
    with pytest.raises(ValueError):
        geo.category_counts(pts, others, 10, [])


def test_registers(spark):
    r = '{"ocid":"o","date":"2024-01-02T00:00:00Z","buyer":{"id":"b","name":"x"},"parties":[{"id":"b","name":"Council","address":{"region":"UKX"}}],"tender":{"title":"T","status":"Active","value":{"amount":5},"classification":{"id":"45100000"},"documents":[{"documentType":"other","url":"u1"},{"documentType":"tenderNotice","url":"u2"}]},"awards":[{"suppliers":[{"id":"1","name":"A"},{"id":"1","name":"B"},{"name":"C"}]},{"value":{"amount":7}}]}'
    x = registers.tenders(spark.createDataFrame([(r,), ("{}",), ("junk",), (None,)], "json string")).collect()
    assert (x[0]["amount"], x[0]["buyer"], x[0]["url"], x[0]["status"], [s["name"] for s in x[0]["suppliers"]]) == (7.0, "Council", "u2", "open", ["A", "C"])
    assert column(spark, ["Ward: North | Decision : ok|junk"], registers.meta_text)[0] == {"ward": "North", "decision": "ok"}


def test_reference(spark):
    cube = spark.createDataFrame([("c", [1, 2, 3, 4, 5, 6])], "id string, observations array<int>")
    got = {(r["area"], r["sex"]): r["value"] for r in reference.decode_cube(cube, {"area": ["x", "y"], "sex": ["a", "b", "c"]}).collect()}
    assert got["x", "a"] == 1 and got["x", "c"] == 3 and got["y", "b"] == 5
    years = reference.year_columns(spark.createDataFrame([("a", "5", "x")], "code string, `2020` string, `2021` string"), "code").collect()
    assert [tuple(r) for r in years] == [("a", 2020, 5)]


def test_ownership_caps(spark):
    e = ownership.edges(spark.createDataFrame([(1, c, 1) for c in range(5)] + [(2, 0, 0)], "officer int, company int, active int"))
    found = ownership.search(e, spark.createDataFrame([("officer:1",)], "seed string"), 2)
    assert {r["node"]: r["depth"] for r in found.collect()} == {"officer:1": 0, "officer:2": 2, **{f"company:{c}": 1 for c in range(5)}}
    kept = ownership.search_capped(e, spark.createDataFrame([("officer:1",)], "seed string"), 2, {"company": 2}).collect()
    assert sum(r["kind"] == "company" for r in kept) == 2 and all(r["truncated"] for r in kept)
    assert ownership.retained_edges(e, found).count() == 6


def test_listing_changes(spark):
    rows = [("s", 1, 1, 100, ["a"], "active"), ("s", 2, 2, 90, ["a", "b"], "active"), ("s", 3, 3, 90, ["b"], "active"), ("s", 4, 4, 90, ["b"], "removed"), ("s", 5, 5, 90, ["b"], "active")]
    df = spark.createDataFrame(rows, "source_id string, captured_at int, event_id int, price_pence long, features array<string>, status string")
    assert [r["kind"] for r in listings.changes(df).orderBy("event_id").collect()] == ["new", "price_reduced", "feature_changed", "deleted", "back_on_market"]
