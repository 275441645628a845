"""Registered queries for hazards, postcode geography, bundles, registers, ownership and listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import geo, hazards, linkage, listings, models, ownership, places, profile, reference, registers, valuation
from ..session import shared_checkpoints
from .lens import LENSES, repeated, view, with_sql
from .place_queries import _HAV, _releases
from .queries import query

LENSES |= {
    "areas": """SELECT s_suppkey AS feature_id, s_name AS name, 50 + CAST((s_suppkey * 1373) % 8000 AS DOUBLE) / 1000 AS lat0, -6 + CAST((s_suppkey * 719) % 7500 AS DOUBLE) / 1000 AS lng0, 0.25 * (1 + s_suppkey % 4) AS side,
  CASE s_suppkey % 5 WHEN 0 THEN 'conservation-area' WHEN 1 THEN 'article-4-direction-area' WHEN 2 THEN 'flood-risk-zone' WHEN 3 THEN 'green-belt' ELSE 'tree-preservation-zone' END AS dataset,
  CAST(2030 + 40 * (s_suppkey % 2) AS INT) AS horizon, CASE s_suppkey % 3 WHEN 0 THEN 'Improbable' WHEN 1 THEN 'Possible' ELSE 'Probable' END AS class, CAST(s_nationkey % 2 AS INT) AS uplift FROM supplier""",
    "postcodes": f"""SELECT c_custkey, {LENSES["targets"].split("AS property_id, ")[1].split(" AS postcode")[0]} AS raw, 50 + CAST((c_custkey * 37) % 8000 AS DOUBLE) / 1000 AS lat, -6 + CAST((c_custkey * 91) % 7500 AS DOUBLE) / 1000 AS lng,
  CASE WHEN c_custkey % 9 <> 4 THEN 'E0100' || CAST(c_custkey % 50 AS STRING) END AS lsoa FROM customer""",
    "controllers": """SELECT DISTINCT 'p' || CAST(l_suppkey AS STRING) AS identity, CAST(l_partkey AS STRING) AS company, CASE WHEN l_returnflag = 'R' THEN '2020-01-01' END AS ceased_on, '2010-01-01' AS notified_on,
  CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_suppkey AS STRING) END AS company_number FROM lineitem""",
    "notices": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
    THEN '{"Id":"n' || CAST(o_orderkey AS STRING) || '","Title":"Works","Status":"' || CASE o_orderstatus WHEN 'F' THEN 'Awarded' WHEN 'O' THEN 'Open' ELSE 'odd' END || '","ValueLow":' || CAST(o_orderkey % 1000 AS STRING) || ',"ValueHigh":' || CAST(1000 + o_orderkey % 1000 AS STRING) || ',"CpvCodes":["45000000"],"Organisation":{"Name":" Council "},"Region":"UK' || CAST(o_custkey % 5 AS STRING) || '","NoticeType":"Contract"}'
    ELSE '{"id":"n' || CAST(o_orderkey AS STRING) || '","title":"Works","noticeStatus":"closed","awardedValue":' || CAST(o_orderkey % 1000 AS STRING) || ',"cpvCodes":"45100000 71000000","organisationName":"Board","regionText":"UK' || CAST(o_custkey % 5 AS STRING) || '","region":"X","noticeType":"Award"}' END AS json FROM orders""",
    "auction_records": """SELECT o_orderkey, '{"reference":"R' || CASE WHEN o_orderkey % 3 = 0 THEN '260430' ELSE '26' END || ' ' || CAST(o_orderkey AS STRING) || '","lot_status":"' || CASE o_orderstatus WHEN 'F' THEN 'Sold' WHEN 'O' THEN 'available' ELSE 'odd' END || '","lot_type":"residential","price":' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE CAST(o_orderkey AS STRING) END || ',"sort_price":' || CAST(o_custkey AS STRING) || ',"address1":"' || CAST(o_custkey AS STRING) || ' High St","town":"York","postcode":"YO1 7HH"}' AS json FROM orders""",
}


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "areas").withColumns({c: F.col(c).cast("double") for c in ("lat0", "lng0", "side")})
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("lng0"), F.col("lat0"), F.col("lng0") + F.col("side"), F.col("lat0") + F.col("side")
    return a.withColumn("ring", F.array(v(x0, y0), v(x1, y0), v(x1, y1), v(x0, y1)))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points")


_CENTRE = _HAV.replace("s.lat", "(s.lat0 + s.side / 2)").replace("s.lng", "(s.lng0 + s.side / 2)")
_IN_AREA = "p.lat >= s.lat0 AND p.lat < s.lat0 + s.side AND p.lng >= s.lng0 AND p.lng < s.lng0 + s.side"
_AREAS = ", sh AS (SELECT feature_id, name, dataset, horizon, class, uplift, CAST(lat0 AS DOUBLE) AS lat0, CAST(lng0 AS DOUBLE) AS lng0, CAST(side AS DOUBLE) AS side FROM areas)"


@query(with_sql("points", "areas") + _AREAS + f"""
, x AS (SELECT point_id, horizon, uplift, feature_id, {_CENTRE} AS d FROM points p, sh s WHERE {_CENTRE} <= 50000)
SELECT point_id, horizon, uplift, count(*) AS features, arg_min(feature_id, (d, feature_id)) AS feature_id, round(min(d), 3) AS distance_m FROM x GROUP BY point_id, horizon, uplift""")
def shoreline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest prediction by horizon and uplift."""
    features = _rings(spark, sf_dir).select("feature_id", "ring", "horizon", "uplift").withColumn("scenario", F.lit("shoreline-plan"))
    return hazards.shoreline_near(_points(spark, sf_dir), features, 50_000).select("point_id", "horizon", "uplift", "features", "feature_id", F.round("distance_m", 3).alias("distance_m"))


@query(with_sql("points", "areas") + _AREAS + f"""
, h AS (SELECT point_id, horizon, min(class) AS class FROM points p JOIN sh s ON {_IN_AREA} GROUP BY point_id, horizon)
SELECT p.point_id, CAST(a.horizon AS INT) AS horizon, coalesce(h.class, 'None') AS class FROM points p CROSS JOIN (VALUES (2030), (2070)) a(horizon) LEFT JOIN h ON h.point_id = p.point_id AND h.horizon = a.horizon""")
def shrink_swell_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18."""
    return hazards.shrink_swell(_points(spark, sf_dir), _rings(spark, sf_dir).select("horizon", "class", "ring"), (2030, 2070)).select("point_id", "horizon", "class")


@query(with_sql("points", "stops") + f"""
, x AS (SELECT point_id, stop_id, {_HAV} AS d FROM points p, stops s WHERE {_HAV} <= 60000), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, stop_id) AS rank, count(*) OVER (PARTITION BY point_id) AS total FROM x)
SELECT point_id, stop_id AS landslide_id, CAST(rank AS INT) AS rank, total, total > 3 AS truncated FROM r WHERE rank <= 3""")
def landslides_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest three, how many there are, and whether that left some out."""
    slides = view(spark, sf_dir, "stops").select(F.col("stop_id").alias("landslide_id"), "lat", "lng")
    return hazards.landslides_near(_points(spark, sf_dir), slides, 60_000, 3).select("point_id", "landslide_id", "rank", "total", "truncated")


@query(with_sql("points", "stops", "areas") + _AREAS + f"""
, w AS (SELECT point_id, bool_or(class IN ('Possible', 'Probable')) AS r FROM points p JOIN (SELECT * FROM sh) s ON {_IN_AREA} GROUP BY point_id),
k AS (SELECT point_id, horizon, min(class) AS class FROM points p JOIN sh s ON {_IN_AREA} GROUP BY point_id, horizon), kr AS (SELECT point_id, bool_or(class IN ('Possible', 'Probable')) AS r FROM k GROUP BY point_id),
l AS (SELECT point_id, count(*) AS n FROM points p, stops s WHERE {_HAV} <= 30000 GROUP BY point_id)
SELECT p.point_id, coalesce(l.n, 0) AS landslides, coalesce(kr.r, false) AS shrink_swell_risk, coalesce(l.n, 0) > 0 AS landslide_risk FROM points p LEFT JOIN kr USING (point_id) LEFT JOIN l USING (point_id)""")
def geohazard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20."""
    slides = view(spark, sf_dir, "stops").select(F.col("stop_id").alias("landslide_id"), "lat", "lng")
    return hazards.geohazards(_points(spark, sf_dir), _rings(spark, sf_dir).select("horizon", "class", "ring"), slides, (2030, 2070), 30_000)


_MEETS = "p.lat + {h} >= s.lat0 AND p.lat - {h} <= s.lat0 + s.side AND p.lng + {h} >= s.lng0 AND p.lng - {h} <= s.lng0 + s.side"


@query(with_sql("points", "areas") + _AREAS + f"""
SELECT point_id, dataset AS kind, CASE WHEN feature_id % 2 = 0 THEN name ELSE 'ref-' || CAST(feature_id AS VARCHAR) END AS name FROM points p JOIN sh s ON {_MEETS.format(h="0.0003")}""")
def designations_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that meet the small square around a point, named by the first property that is set."""
    named = F.create_map(F.lit("NAME"), F.when(F.col("feature_id") % 2 == 0, F.col("name")).otherwise(""), F.lit("REF_CODE"), F.concat(F.lit("ref-"), F.col("feature_id").cast("string")))
    areas = _rings(spark, sf_dir).select(F.col("dataset").alias("kind"), named.alias("properties"), "ring")
    return hazards.designations(_points(spark, sf_dir), areas, ("SSSI_NAME", "NAME", "REF_CODE"))


@query(with_sql("points", "areas") + _AREAS + """
SELECT p.point_id, """ + ", ".join(f"count(*) FILTER (WHERE dataset = '{d}') AS \"{d}\"" for d in hazards.LAYERS) + f" FROM points p LEFT JOIN sh s ON {_IN_AREA} GROUP BY p.point_id")
def planning_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, G23."""
    return hazards.constraints(_points(spark, sf_dir), _rings(spark, sf_dir).select("dataset", "ring"))


@query(with_sql("points", "areas") + _AREAS + f"""
SELECT p.point_id, count(s.feature_id) AS listed_buildings FROM points p LEFT JOIN sh s ON {_MEETS.format(h="(5000 / greatest(1.0, 111320 * cos(radians(p.lat))))")} GROUP BY p.point_id""")
def listed_building_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, P8."""
    return hazards.listed_buildings(_points(spark, sf_dir), _rings(spark, sf_dir).select("ring"), 5000.0)


@query(with_sql("points", "areas") + """
, g AS (SELECT CAST(round_even(lat0 / 0.25, 0) AS BIGINT) AS y, CAST(round_even(lng0 / 0.25, 0) AS BIGINT) AS x, max(feature_id) AS elevation FROM areas GROUP BY 1, 2)
SELECT point_id, CAST(g.elevation AS DOUBLE) AS elevation FROM points LEFT JOIN g ON y = CAST(round_even(lat / 0.25, 0) AS BIGINT) AND x = CAST(round_even(lng / 0.25, 0) AS BIGINT)""")
def elevations_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point, null off the grid."""
    snapped = lambda c: (F.bround(F.col(c).cast("double") / 0.25, 0) * 0.25)
    grid = view(spark, sf_dir, "areas").groupBy(snapped("lat0").alias("node_lat"), snapped("lng0").alias("node_lng")).agg(F.max("feature_id").cast("double").alias("elevation"))
    return geo.elevations(_points(spark, sf_dir), grid, 0.25).select("point_id", "elevation")


@query(with_sql("points", "stops") + f"""
SELECT point_id, arg_min(name, (d, stop_id)) AS station, round_even(min(d) / 1000, 3) AS station_km, count(*) FILTER (WHERE d <= 25000) AS stations FROM (SELECT point_id, stop_id, name, {_HAV} AS d FROM points p, stops s) GROUP BY point_id""")
def nearest_station_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    shared_checkpoints(spark)
    return geo.nearest_station(_points(spark, sf_dir), view(spark, sf_dir, "stops"), 25_000)


@query("""WITH o AS (SELECT o_custkey AS request, o_orderkey AS origin FROM orders), d AS (SELECT o_custkey AS request, o_orderkey AS destination FROM orders)
SELECT origin, destination, CASE WHEN (origin + destination) % 3 = 0 THEN origin % 1000 + destination % 100 END AS duration_s FROM o JOIN d USING (request)""")
def travel_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a request, with nulls where no route was found."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("origin"))
    d = o.withColumnRenamed("origin", "destination")
    found = o.join(d, "request").filter((F.col("origin") + F.col("destination")) % 3 == 0).select("origin", "destination", (F.col("origin") % 1000 + F.col("destination") % 100).alias("duration_s"))
    return geo.travel_matrix(o, d, found).select("origin", "destination", "duration_s")


@query(with_sql("points", "stops") + f"""
, x AS (SELECT point_id, stop_id, {_HAV} AS d FROM points p, stops s WHERE stop_type IN (1, 2) AND {_HAV} <= 70000)
SELECT point_id, sensor, CAST(rank AS INT) AS rank FROM (SELECT point_id, stop_id AS sensor, row_number() OVER (PARTITION BY point_id ORDER BY d, stop_id) AS rank FROM x) WHERE rank <= 2""")
def air_stations_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By radius, pollutants and a maximum."""
    stations = view(spark, sf_dir, "stops").select(F.col("stop_id").alias("sensor"), F.concat(F.lit("p"), F.col("stop_type").cast("string")).alias("pollutant"), "lat", "lng")
    return geo.stations_near(_points(spark, sf_dir), stations, 70_000, pollutants=("p1", "p2"), most=2).select("point_id", "sensor", "rank")


# postcode geography

_PCS = """, pc AS (SELECT left(replace(upper(trim(raw)), ' ', ''), -3) || ' ' || right(replace(upper(trim(raw)), ' ', ''), 3) AS postcode, c_custkey, lat, lng, lsoa FROM postcodes WHERE raw <> 'N/A'),
geo AS (SELECT postcode, x.lat AS lat, x.lng AS lng, x.lsoa AS lsoa FROM (SELECT postcode, arg_max({'lat': lat, 'lng': lng, 'lsoa': lsoa}, c_custkey) AS x FROM pc GROUP BY postcode))"""


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "postcodes")
    return places.geography(p.select(F.col("raw").alias("postcode"), "c_custkey", "lat", "lng", "lsoa"))


@query(with_sql("postcodes") + _PCS + """
SELECT split_part(postcode, ' ', 1) AS outcode, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS postcodes FROM geo GROUP BY 1""")
def outcode_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a postcode, then one an outcode."""
    return places.outcodes(_geography(spark, sf_dir)).select("outcode", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "postcodes")


@query(with_sql("postcodes") + _PCS + f"""
, w AS (SELECT c_custkey, raw AS a, CASE WHEN c_custkey % 4 = 0 THEN 'nowhere' ELSE upper(raw) END AS b, lead(raw) OVER (ORDER BY c_custkey) AS n FROM postcodes),
k AS (SELECT c_custkey, left(replace(upper(a), ' ', ''), -3) || ' ' || right(replace(upper(a), ' ', ''), 3) AS a, left(replace(upper(n), ' ', ''), -3) || ' ' || right(replace(upper(n), ' ', ''), 3) AS n, c_custkey % 4 = 0 AS lost FROM w),
d AS (SELECT c_custkey, CASE WHEN NOT lost AND p.lat IS NOT NULL AND s.lat IS NOT NULL THEN {_HAV} END AS m FROM k LEFT JOIN geo p ON p.postcode = k.a LEFT JOIN geo s ON s.postcode = k.n)
SELECT c_custkey, round_even(m, 1) AS metres, round_even(m / 1000, 3) AS kilometres, round_even(m / 1609.344, 3) AS miles FROM d""")
def postcode_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    p = view(spark, sf_dir, "postcodes")
    following = p.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("raw").alias("following"))  # keys are gapless
    pairs = p.join(following, "c_custkey", "left").select("c_custkey", F.col("raw").alias("postcode_a"), F.when(F.col("c_custkey") % 4 == 0, "nowhere").otherwise(F.col("following")).alias("postcode_b"))
    return places.distances(pairs, _geography(spark, sf_dir)).select("c_custkey", "metres", "kilometres", "miles")


@query(with_sql("postcodes", "stops") + _PCS + f"""
, x AS (SELECT p.stop_id AS place_id, s.postcode, {_HAV} AS d FROM stops p, geo s WHERE {_HAV} <= 15000), r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY d, postcode) AS rank FROM x)
SELECT place_id, postcode, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def postcodes_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    spots = view(spark, sf_dir, "stops").select(F.col("stop_id").alias("place_id"), "lat", "lng")
    return places.postcodes_of_places(spots, _geography(spark, sf_dir), radius_m=15_000).select("place_id", "postcode", "rank")


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known postcode, and some that aren't."""
    known = _geography(spark, sf_dir).select("postcode")
    return known.unionByName(view(spark, sf_dir, "stops").select(F.concat(F.lit("ZZ"), (F.col("stop_id") % 90 + 1).cast("string"), F.lit(" 1ZZ")).alias("postcode")).distinct())


_ASKED = ", asked AS (SELECT postcode FROM geo UNION SELECT 'ZZ' || CAST(stop_id % 90 + 1 AS VARCHAR) || ' 1ZZ' FROM stops)"


@query(with_sql("postcodes", "stops") + _PCS + _ASKED + f"""
, a AS (SELECT p.postcode, count(s.stop_id) AS n FROM geo p LEFT JOIN stops s ON {_HAV} <= 40000 GROUP BY p.postcode),
f AS (SELECT p.postcode, min(1 + s.stop_id % 4) AS worst FROM geo p JOIN stops s ON {_HAV} <= 20000 GROUP BY p.postcode)
SELECT asked.postcode, geo.lat, a.n AS n_stops, CAST(f.worst AS INT) AS worst_warning FROM asked LEFT JOIN geo USING (postcode) LEFT JOIN a USING (postcode) LEFT JOIN f USING (postcode)""")
def neighbourhood_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and nearest things around each postcode; an unknown postcode has nulls throughout."""
    g, stops = _geography(spark, sf_dir).select("postcode", "lat", "lng"), view(spark, sf_dir, "stops")
    near = geo.within_radius(g, stops.select("stop_id", "lat", "lng"), 40_000, id_col="postcode").groupBy("postcode").agg(F.count("*").alias("n_stops"))
    warned = geo.flood_warnings(g, stops.withColumn("severity", (1 + F.col("stop_id") % 4).cast("string")), 20_000, id_col="postcode").select("postcode", F.col("worst").alias("worst_warning"))
    return places.neighbourhood(_requested(spark, sf_dir), _geography(spark, sf_dir), {"stops": near, "flood": warned}).select("postcode", "lat", "n_stops", "worst_warning")


@query(with_sql("postcodes", "stops", "ppd") + _PCS + _ASKED + """
, s AS (SELECT left(replace(upper(trim(postcode)), ' ', ''), -3) || ' ' || right(replace(upper(trim(postcode)), ' ', ''), 3) AS postcode, price, transfer_date FROM ppd WHERE price > 0 AND postcode <> 'N/A'),
c AS (SELECT CAST(CAST(max(transfer_date) AS DATE) - 365 * 3 AS VARCHAR) AS cutoff FROM ppd), b AS (SELECT postcode, count(*) AS sales, median(price) AS m FROM s, c WHERE transfer_date >= cutoff GROUP BY postcode), q AS (SELECT postcode, count(*) AS sales FROM s GROUP BY postcode)
SELECT asked.postcode, CASE WHEN b.sales >= 3 THEN CAST(round_even(b.m, 0) AS BIGINT) END AS avm_gbp, q.sales AS ppd_sales, geo.lsoa,
  concat_ws(',', CASE WHEN geo.postcode IS NULL THEN 'location' END, CASE WHEN b.sales IS NULL OR b.sales < 3 THEN 'avm' END, CASE WHEN q.sales IS NULL THEN 'ppd' END, 'epc') AS missing
FROM asked LEFT JOIN geo USING (postcode) LEFT JOIN b USING (postcode) LEFT JOIN q USING (postcode)""")
def property_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a postcode of independent blocks, with the names of the missing ones (``epc`` has no source here)."""
    g = _geography(spark, sf_dir)
    ppd = view(spark, sf_dir, "ppd").withColumn("postcode", t.normalise_postcode(F.col("postcode"))).filter("price > 0 and postcode is not null")
    latest = ppd.agg(F.max(F.col("transfer_date").cast("date")).alias("d")).first()["d"]
    recent = ppd.filter(F.col("transfer_date") >= places.latest_year_cutoff(F.lit(latest), 3))
    avm = recent.groupBy("postcode").agg(F.count("*").alias("n"), F.bround(F.percentile("price", 0.5), 0).cast("long").alias("estimate")).filter(F.col("n") >= valuation.MIN_ROWS)
    blocks = {"location": g.select("postcode", "lat", "lng", "lsoa"), "avm": avm, "ppd": ppd.groupBy("postcode").agg(F.count("*").alias("sales")), "epc": None}
    out = places.bundle(_requested(spark, sf_dir), "postcode", blocks)
    return out.select("postcode", F.col("avm.estimate").alias("avm_gbp"), F.col("ppd.sales").alias("ppd_sales"), F.col("location.lsoa").alias("lsoa"), F.array_join("missing", ",").alias("missing"))


@query(with_sql("postcodes") + _PCS + """
, l AS (SELECT DISTINCT lsoa FROM geo WHERE lsoa IS NOT NULL), census AS (SELECT lsoa, CAST(substr(lsoa, 6) AS BIGINT) AS residents FROM l WHERE CAST(substr(lsoa, 6) AS BIGINT) % 2 = 0), imd AS (SELECT lsoa, CAST(substr(lsoa, 6) AS BIGINT) % 10 + 1 AS decile FROM l)
SELECT l.lsoa, census.residents, imd.decile, concat_ws(',', CASE WHEN census.lsoa IS NULL THEN 'census' END, 'nomis') AS missing FROM l LEFT JOIN census USING (lsoa) LEFT JOIN imd USING (lsoa)""")
def demographics_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected sources by area."""
    areas = _geography(spark, sf_dir).filter("lsoa is not null").select("lsoa").distinct()
    number = F.substring("lsoa", 6, 10).cast("long")
    sources = {"census": areas.filter(number % 2 == 0).select("lsoa", number.alias("residents")), "imd": areas.select("lsoa", (number % 10 + 1).alias("decile")), "nomis": None, "mhclg": areas.select("lsoa", F.lit(1).alias("homes"))}
    out = places.bundle(areas, "lsoa", sources, ["census", "imd", "nomis"])
    return out.select("lsoa", F.col("census.residents").alias("residents"), F.col("imd.decile").alias("decile"), F.array_join("missing", ",").alias("missing"))


@query(with_sql("points", "stops", "areas") + _AREAS + f"""
, f AS (SELECT point_id, count(*) AS n FROM points p, stops s WHERE {_HAV} <= 10000 GROUP BY point_id), l AS (SELECT point_id, count(*) AS n FROM points p, stops s WHERE {_HAV} <= 5000 GROUP BY point_id),
c AS (SELECT point_id, count(*) AS n FROM points p, sh s WHERE {_CENTRE} <= 5000 GROUP BY point_id), r AS (SELECT c_nationkey, sum(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) AS x FROM customer GROUP BY c_nationkey)
SELECT p.point_id, f.n AS flood, l.n AS landslide, c.n AS coastal, concat_ws(',', CASE WHEN f.n IS NULL THEN 'flood' END, CASE WHEN c.n IS NULL THEN 'coastal' END, CASE WHEN l.n IS NULL THEN 'landslide' END, 'radon') AS missing
FROM points p LEFT JOIN f USING (point_id) LEFT JOIN l USING (point_id) LEFT JOIN c USING (point_id)""")
def climate_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood within 10 km, shoreline and landslides within 5, by point."""
    p, stops = _points(spark, sf_dir), view(spark, sf_dir, "stops").select("stop_id", "lat", "lng")
    near = lambda others, m: geo.within_radius(p, others, m).groupBy("point_id").agg(F.count("*").alias("n"))
    coast = _rings(spark, sf_dir).withColumn("c", geo.centroid(F.col("ring"))).select("feature_id", F.col("c.lat").alias("lat"), F.col("c.lng").alias("lng"))
    out = places.bundle(p.select("point_id"), "point_id", {"flood": near(stops, 10_000), "coastal": near(coast, 5000), "landslide": near(stops, 5000), "radon": None})
    return out.select("point_id", F.col("flood.n").alias("flood"), F.col("landslide.n").alias("landslide"), F.col("coastal.n").alias("coastal"), F.array_join("missing", ",").alias("missing"))


# registers


@query(with_sql("notices") + """
SELECT 'n' || CAST(o.o_orderkey AS VARCHAR) AS ocid, CASE WHEN o.o_orderkey % 2 = 1 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'awarded' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'unknown' END AS status, CASE WHEN o.o_orderkey % 2 = 0 THEN 'Council' ELSE 'Board' END AS buyer,
  CASE WHEN o.o_orderkey % 2 = 1 THEN CAST(o.o_orderkey % 1000 AS DOUBLE) END AS amount, CASE WHEN o.o_orderkey % 2 = 0 THEN CAST(o.o_orderkey % 1000 AS DOUBLE) END AS amount_low, CAST(CASE WHEN o.o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS codes, 'UK' || CAST(o_custkey % 5 AS VARCHAR) AS region
FROM orders o""")
def contract_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of notices in one schema."""
    n = registers.notices(view(spark, sf_dir, "notices"))
    return n.select("ocid", "status", "buyer", "amount", "amount_low", F.size("classifications").alias("codes"), "region")


@query(with_sql("notices") + """
, r AS (SELECT 'find_a_tender' AS source, o_orderkey AS k, 'UK' || CAST(o_custkey % 5 AS VARCHAR) AS region FROM orders UNION ALL SELECT 'contracts_finder', o_orderkey, 'UK' || CAST(o_custkey % 5 AS VARCHAR) FROM orders)
SELECT source, region, count(*) AS n FROM r WHERE source = 'find_a_tender' OR (CASE WHEN k % 2 = 0 THEN 1000 + k % 1000 ELSE k % 1000 END) >= 400 GROUP BY source, region""")
def tenders_of_both_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union, searched by a lowest value that a range's top can meet."""
    both = registers.all_tenders(_releases(spark, sf_dir), view(spark, sf_dir, "notices").select("json"))
    one = registers.search_tenders(both.filter("source = 'contracts_finder'"), keyword="works", low=400, kinds=("Contract", "Award"))
    return both.filter("source = 'find_a_tender'").select("source", F.col("buyer_region").alias("region")).unionByName(one.select("source", "region")).groupBy("source", "region").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT 'UK' || CAST(o_custkey % 5 AS VARCHAR) AS region, CASE WHEN o_orderkey % 2 = 0 THEN 'Contract' ELSE 'Award' END AS kind, CASE WHEN o_orderkey % 2 = 1 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'awarded' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'unknown' END AS status FROM orders)
SELECT 'region' AS facet, region AS value, count(*) AS n FROM x GROUP BY region UNION ALL SELECT 'notice_type', kind, count(*) FROM x GROUP BY kind UNION ALL SELECT 'status', status, count(*) FROM x GROUP BY status""")
def tender_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return registers.facets(registers.notices(view(spark, sf_dir, "notices")))


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lat, lng = 50 + (F.col("o_orderkey") % 8000).cast("double") / 1000, -6 + (F.col("o_custkey") % 7500).cast("double") / 1000
    return o.select(F.col("o_orderkey").cast("string").alias("reference"), F.col("o_custkey").cast("string").alias("key_val"), F.col("o_clerk").alias("council") if "o_clerk" in o.columns else F.col("o_orderpriority").alias("council"), F.col("o_orderpriority").alias("address"), F.lit("").alias("description"), F.col("o_orderdate").alias("last_modified"), (F.col("o_orderstatus") != "P").alias("visible"), lat.alias("lat"), lng.alias("lng"))


@query("""SELECT o_orderpriority AS council, count(*) AS applications, CAST(max(o_orderdate) AS DATE) AS latest FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '1997-01-01' GROUP BY o_orderpriority""")
def applications_by_council(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, P9."""
    rows = _applications(spark, sf_dir).withColumn("council", F.col("address"))
    return registers.applications_by_council(rows, F.lit("1997-01-01").cast("timestamp_ntz")).withColumn("latest", F.col("latest").cast("date"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS reference FROM orders WHERE o_orderstatus <> 'P' AND 50 + CAST(o_orderkey % 8000 AS DOUBLE) / 1000 BETWEEN 50.2 AND 51.2 AND -6 + CAST(o_custkey % 7500 AS DOUBLE) / 1000 BETWEEN -5.99 AND -5.9""")
def applications_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    return registers.applications(_applications(spark, sf_dir), box=(50.2, -5.99, 51.2, -5.9)).select("reference")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS reference, CAST(o_custkey AS VARCHAR) AS key_val, o_orderstatus <> 'P' AS visible FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)""")
def applications_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: by key, visible or not."""
    wanted = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key_val"))
    return registers.application_by_key(_applications(spark, sf_dir), wanted, "key_val").select("reference", "key_val", "visible")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Granted' END AS status, CAST(o_orderdate AS DATE) AS received_on, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2026-01-14' WHEN o_orderkey % 3 = 1 THEN DATE '2026-02-03' END AS decided_on FROM orders""")
def application_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated labels keep their last value; the decision day is the first of three labels."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    meta = F.concat(F.lit("Status: Pending | Received: "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" | STATUS: "), F.when(k % 2 == 0, "Granted").otherwise("Unknown"), F.when(k % 3 == 0, " | Decision Made Date: Wed 14 Jan 2026 | Decision Date: 3 Feb 2026").when(k % 3 == 1, " | Decision date: 3 February 2026").otherwise(" | note"))
    return registers.application_details(o.select("o_orderkey", meta.alias("meta"))).select("o_orderkey", "status", "received_on", "decided_on")


@query(with_sql("auction_records") + """
SELECT lower('R' || CASE WHEN o_orderkey % 3 = 0 THEN '260430' ELSE '26' END || '-' || CAST(o_orderkey AS VARCHAR)) AS slug, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2026-04-30' END AS auction_on, CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'available' ELSE 'unknown' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN nullif(CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END * 100 AS BIGINT), 0) END AS sold_pence, CAST(o_custkey AS VARCHAR) || ' High St, York, YO1 7HH' AS address, 'YO1 7HH' AS postcode FROM orders""")
def auction_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17, U1, A42, A44, A62."""
    lots = registers.lots(view(spark, sf_dir, "auction_records"))
    return lots.select("slug", "auction_on", "status", "sold_pence", F.col("address.raw").alias("address"), F.col("address.postcode").alias("postcode"))


@query("""SELECT o_orderkey AS auction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'residential' ELSE 'commercial' END AS lot_type FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01'""")
def upcoming_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("auction_id"), F.col("o_orderdate").cast("date").alias("auction_on"))
    even = F.col("auction_id") % 2 == 0
    return registers.upcoming_auctions(o.filter(even), o.filter(~even), F.lit("1997-06-01").cast("date")).select("auction_id", "lot_type")


# ownership


@query(with_sql("appointments", "controllers") + """
, e AS (SELECT 'officer:' || CAST(officer AS VARCHAR) AS source, 'company:' || CAST(company AS VARCHAR) AS target, 'officer_of' AS relation, max(active) AS active FROM appointments GROUP BY officer, company
  UNION ALL SELECT 'psc:' || identity, 'company:' || company, 'psc_of', max(CASE WHEN ceased_on IS NULL THEN 1 ELSE 0 END) FROM controllers GROUP BY identity, company)
SELECT source, target, relation, CAST(active AS INT) AS active, CASE WHEN relation = 'psc_of' AND active = 0 THEN '2020-01-01' END AS until FROM e""")
def ownership_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officers and controllers, active ones first."""
    return ownership.edges(repeated(spark, sf_dir, "appointments"), repeated(spark, sf_dir, "controllers")).select("source", "target", "relation", "active", "until")


@query(with_sql("controllers") + """
SELECT 'company:' || CAST(p_partkey AS VARCHAR) AS node, 'company' AS kind, p_name AS label, CAST(1 AS INT) AS attributes FROM part
UNION ALL SELECT 'officer:' || CAST(s_suppkey AS VARCHAR), 'officer', CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INT) FROM supplier
UNION ALL SELECT DISTINCT 'psc:' || identity, 'psc', 'corporate', CAST(CASE WHEN company_number IS NULL THEN 0 ELSE 1 END AS INT) FROM controllers""")
def ownership_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with fallbacks, and the attributes that are set."""
    p, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "supplier"))
    company = p.select(F.col("p_partkey").alias("identifier"), F.col("p_name").alias("label"), F.col("p_size").alias("size"))
    officer = s.select(F.col("s_suppkey").alias("identifier"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("label"), F.when(F.col("s_suppkey") % 2 == 0, "director").alias("occupation"))
    psc = view(spark, sf_dir, "controllers").select(F.col("identity").alias("identifier"), F.lit("").alias("label"), F.lit("corporate").alias("other_label"), "company_number").distinct()
    return ownership.nodes(company=company, officer=officer, psc=psc).select("node", "kind", "label", F.size("data").alias("attributes"))


@query(with_sql("controllers").replace("WITH", "WITH RECURSIVE") + """
, e AS (SELECT DISTINCT 'psc:' || identity AS s, 'company:' || company AS t FROM controllers), n AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM e), z AS (SELECT DISTINCT 'psc:' || identity AS s, 'company:' || company_number AS t FROM controllers WHERE company_number IS NOT NULL),
r1 AS (SELECT DISTINCT e.s AS seed, e.t AS node FROM e), f1 AS (SELECT * FROM r1), r2 AS (SELECT f1.seed, n.b AS node FROM f1 JOIN n ON f1.node = n.a), r2z AS (SELECT * FROM r2 UNION SELECT r2.seed, z.t FROM r2 JOIN z ON r2.node = z.s),
d AS (SELECT seed, seed AS node, 0 AS depth FROM (SELECT DISTINCT s AS seed FROM e) UNION ALL SELECT seed, node, 1 FROM f1 UNION ALL SELECT seed, node, 2 FROM r2z), m AS (SELECT seed, node, min(depth) AS depth FROM d GROUP BY seed, node)
SELECT seed, node, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY seed ORDER BY depth, split_part(node, ':', 1), split_part(node, ':', 2)) AS INT) AS place FROM m""")
def ownership_of_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every controller, through the companies that corporate controllers are, in order of depth, kind and identifier."""
    shared_checkpoints(spark)
    c = repeated(spark, sf_dir, "controllers")
    e = ownership.edges(repeated(spark, sf_dir, "appointments").filter("false"), c)
    known = ownership.nodes(psc=c.select(F.col("identity").alias("identifier"), F.col("identity").alias("label")).distinct(), company=c.select(F.col("company").alias("identifier"), F.col("company").alias("label")).union(c.filter("company_number is not null").select("company_number", "company_number")).distinct())
    seeds = c.select(F.concat(F.lit("psc:"), "identity").alias("seed"))
    return ownership.search_ordered(e, seeds, 2, known, same=ownership.corporate_links(c)).select("seed", "node", "depth", "place")


# listings


@query(with_sql("snapshots") + """
, s AS (SELECT *, CAST(event_id % 3 AS INT) AS images, 'text ' || CAST(event_id % 2 AS VARCHAR) AS description, CASE WHEN event_id % 13 = 0 THEN 'sold_stc' ELSE status END AS st, CAST(floor(price_pence / 1000000) AS BIGINT) AS price FROM snapshots),
b AS (SELECT *, lag(price) OVER w AS pp, lag(st) OVER w AS ps, lag(images) OVER w AS pi, lag(description) OVER w AS pd, row_number() OVER w AS n, lead(event_id) OVER w IS NULL AS last FROM s WINDOW w AS (PARTITION BY source_id ORDER BY captured_at, event_id)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'new' WHEN st <> ps AND st = 'removed' AND ps = 'sold_stc' THEN 'removed_sold_stc' WHEN st <> ps AND st = 'removed' THEN 'deleted' WHEN st <> ps AND st = 'sold_stc' THEN 'sold_stc' WHEN st <> ps AND st = 'under_offer' THEN 'under_offer' WHEN st <> ps AND st = 'active' THEN 'back_on_market'
  WHEN price < pp THEN 'price_reduced' WHEN price > pp THEN 'price_increased' WHEN images > pi THEN 'photos_added' WHEN images < pi THEN 'photos_removed' WHEN description <> pd THEN 'description_changed' ELSE 'unchanged' END AS kind FROM b)
SELECT event_id, kind, images - pi AS image_delta, CAST(CASE WHEN n > 1 THEN (price IS DISTINCT FROM pp)::INT + (st IS DISTINCT FROM ps)::INT + (images IS DISTINCT FROM pi)::INT + (description IS DISTINCT FROM pd)::INT ELSE 0 END AS INT) AS fields FROM k
UNION ALL SELECT event_id, 'deleted', images - pi, CAST(CASE WHEN n > 1 THEN (price IS DISTINCT FROM pp)::INT + (st IS DISTINCT FROM ps)::INT + (images IS DISTINCT FROM pi)::INT + (description IS DISTINCT FROM pd)::INT ELSE 0 END AS INT) FROM k WHERE last AND captured_at < TIMESTAMP '2024-01-28'""")
def listing_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of change, with image deltas and the fields that changed."""
    s = view(spark, sf_dir, "snapshots")
    k = F.col("event_id")
    s = s.withColumns({"images": (k % 3).cast("int"), "description": F.concat(F.lit("text "), (k % 2).cast("string")), "status": F.when(k % 13 == 0, "sold_stc").otherwise(F.col("status")), "price_pence": F.floor(F.col("price_pence") / 1_000_000), "features": F.array().cast("array<string>")})
    return listings.changes(s, deleted_before=F.lit("2024-01-28").cast("timestamp_ntz")).select("event_id", "kind", "image_delta", F.size("field_changes").alias("fields"))


@query("""WITH e AS (SELECT user_id AS source_id, CASE event_type WHEN 'view' THEN 'listed' ELSE event_type END AS kind, CAST(ts AS DATE) AS occurred_on FROM events WHERE user_id % 2 = 0 OR event_type <> 'view'), a AS (SELECT s_suppkey AS source_id, DATE '2024-01-01' + CAST(s_suppkey % 20 AS INT) AS added_on FROM supplier)
SELECT source_id, kind, occurred_on, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT source_id, 'listed', added_on FROM a WHERE source_id NOT IN (SELECT source_id FROM e WHERE kind = 'listed')) GROUP BY ALL""")
def listed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listed event for each listing without one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter((F.col("user_id") % 2 == 0) | (F.col("event_type") != "view"))
    e = e.select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") == "view", "listed").otherwise(F.col("event_type")).alias("kind"), F.col("ts").cast("date").alias("occurred_on"), F.lit(None).cast("long").alias("price_pence"))
    added = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("source_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 20).cast("int")).alias("added_on"))
    return listings.with_listed_event(e, added).groupBy("source_id", "kind", "occurred_on").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%s%' AND p_partkey % 2 = 0 AND floor(p_retailprice * 100) BETWEEN 90000 AND 250000 AND p_size >= 5""")
def listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select("p_partkey", F.col("p_type").alias("address"), F.when(F.col("p_partkey") % 2 == 0, "sale").otherwise("rent").alias("transaction"), F.floor(F.col("p_retailprice") * 100).alias("price_pence"), F.col("p_size").alias("bedrooms"))
    return listings.search(rows, location="S", transaction="sale", price=(90_000, 250_000), beds=(5, None)).select("p_partkey")


@query("""WITH b AS (SELECT l_suppkey AS branch, count(*) FILTER (WHERE l_linenumber <= 2) AS sales, count(*) FILTER (WHERE l_linenumber = 3) AS rents, count(*) FILTER (WHERE l_linenumber = 4) AS shops FROM lineitem GROUP BY l_suppkey),
x AS (SELECT branch, CASE WHEN branch % 3 = 0 THEN 7 WHEN branch % 3 = 1 THEN sales ELSE sales END AS sale, rents AS rent, shops FROM b)
SELECT branch, CAST(sale + rent + shops AS BIGINT) AS total_live, CAST(sale AS BIGINT) AS for_sale, CAST(rent AS BIGINT) AS to_rent, CASE WHEN branch % 2 = 0 AND branch <> 0 THEN CAST(branch * 100 AS BIGINT) END AS median_price_pence FROM x WHERE sale + rent + shops > 0""")
def published_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published totals, else the listings there are; commercial ones count."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.col("l_linenumber")
    b = li.groupBy(F.col("l_suppkey").alias("branch")).agg(F.count_if(line <= 2).alias("sale_listings"), F.count_if(line == 3).alias("rent_listings"), F.count_if(line == 4).alias("commercial_sale"))
    n = F.col("branch")
    b = b.withColumns({"sale_total": F.when(n % 3 == 0, F.lit(7)).when(n % 3 == 1, F.lit(0)).cast("long"), "rent_total": F.lit(None).cast("long"), "commercial_rent": F.lit(None).cast("long"), "sale_average": F.when(n % 2 == 0, n).otherwise(0), "rent_average": F.lit(None).cast("long")})
    return valuation.published_stock(b).select("branch", "total_live", "for_sale", "to_rent", "median_price_pence")


# models


@query("""WITH f AS (SELECT 'a' || CAST(l_partkey % 40 AS VARCHAR) AS area, ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem), b AS (SELECT area, count(*) AS rows, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f GROUP BY area HAVING count(*) >= 20)
SELECT area, rows, round(i, 6) AS intercept, round(s, 6) AS slope FROM b""")
def area_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One least-squares model an area, held against SQL's own regression."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("a"), (F.col("l_partkey") % 40).cast("string")).alias("area"), F.log("l_extendedprice").alias("log_price"), F.log("l_quantity").alias("log_floor"))
    m = models.fit_by_segment(li, numbers=("log_floor",), categories=())
    return m.select("area", "rows", F.round("intercept", 6).alias("intercept"), F.round(F.try_element_at("slopes", F.lit("log_floor")), 6).alias("slope"))


_SCORED = """WITH x AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(floor(l_extendedprice * (1 + (l_partkey % 21 - 10) / 100.0)) AS BIGINT) AS e, 'a' || CAST(l_suppkey % 7 AS VARCHAR) AS area, l_returnflag AS ty, CAST(l_shipdate AS DATE) AS d FROM lineitem),
m AS (SELECT max(d) - 30 * 12 AS cutoff FROM x), t AS (SELECT * FROM x, m WHERE d >= cutoff AND price > 0 AND e > 0), s AS (SELECT *, abs(e - price) AS err, abs(e - price) / price::DOUBLE AS ape, (price BETWEEN floor(e * 0.95) AND floor(e * 1.05))::INT AS inside FROM t)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with an estimate that SQL can repeat, split in time: what evaluation needs of any model."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select(F.floor("l_extendedprice").alias("price"), F.floor(F.col("l_extendedprice") * (1 + (F.col("l_partkey") % 21 - 10) / F.lit(100.0))).alias("estimate_gbp"), F.concat(F.lit("a"), (F.col("l_suppkey") % 7).cast("string")).alias("area"), F.col("l_returnflag").alias("property_type"), F.col("l_shipdate").cast("date").alias("transfer_date"))
    rows = rows.withColumns({"low_gbp": F.floor(F.col("estimate_gbp") * 0.95), "high_gbp": F.floor(F.col("estimate_gbp") * 1.05)})
    return models.temporal_split(rows, 12)[1]


@query(_SCORED + """
SELECT area, ty AS property_type, count(*) AS n, round(median(ape), 9) AS median_ape, round(avg(ape), 9) AS mean_ape, CAST(round_even(median(err), 0) AS BIGINT) AS median_abs_error, round(avg(inside), 9) AS coverage FROM s GROUP BY GROUPING SETS ((area, ty), ())""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E3."""
    r = models.report(models.score(_scored(spark, sf_dir)))
    return r.select("area", "property_type", "n", F.round("median_ape", 9).alias("median_ape"), F.round("mean_ape", 9).alias("mean_ape"), "median_abs_error", F.round("coverage", 9).alias("coverage"))


@query(_SCORED + """
, z AS (SELECT 'as is' AS model, ape, err FROM s UNION ALL SELECT 'one tenth more', abs(floor(e * CAST(1.1 AS DOUBLE)) - price) / price::DOUBLE, abs(floor(e * CAST(1.1 AS DOUBLE)) - price) FROM s)
SELECT model, count(*) AS n, round(median(ape), 9) AS median_ape, CAST(round_even(median(err), 0) AS BIGINT) AS median_abs_error FROM z GROUP BY model""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any tables of predictions on the same rows."""
    rows = _scored(spark, sf_dir)
    out = models.compare({"as is": rows, "one tenth more": rows.withColumn("estimate_gbp", F.floor(F.col("estimate_gbp") * 1.1))})
    return out.select("model", "n", F.round("median_ape", 9).alias("median_ape"), "median_abs_error")


@query("""WITH l AS (SELECT l_returnflag AS region, l_linestatus AS scenario, CAST(l_linenumber AS INT) AS epoch, max(l_orderkey) AS k, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT o.n_name, o.region, l.scenario, l.epoch, l.k FROM (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'X' END AS region FROM nation) o LEFT JOIN l ON l.region = o.region AND l.scenario = 'F' AND l.epoch = 2""")
def climate_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of (region, scenario, epoch), looked up for one scenario and epoch."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("scenario"), F.col("l_linenumber").cast("int").alias("epoch"), F.col("l_orderkey").alias("k"))
    table = linkage.last_wins(li, ["region", "scenario", "epoch"], F.col("k")).filter((F.col("scenario") == "F") & (F.col("epoch") == 2))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.coalesce(*(F.when(F.col("n_nationkey") % 4 == i, v) for i, v in enumerate("ANRX"))).alias("region"))
    return n.join(table, "region", "left").select("n_name", "region", "scenario", "epoch", "k")


@query(with_sql("crime") + """
, m AS (SELECT substr(day, 1, 7) AS month, category FROM crime), k AS (SELECT DISTINCT month FROM m ORDER BY month DESC LIMIT 2)
SELECT month, category, count(*) AS n FROM m WHERE month IN (SELECT month FROM k) GROUP BY month, category UNION ALL SELECT NULL, category, count(*) FROM m WHERE month IN (SELECT month FROM k) GROUP BY category""")
def crime_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing months there are, by month and in all."""
    c = view(spark, sf_dir, "crime")
    return profile.trailing_crime(c, F.left("day", F.lit(7)), 2).select(F.col("period").alias("month"), "category", "n")


@query(with_sql("targets") + " SELECT property_id, postcode, 'postcode' AS reasons FROM targets WHERE postcode = 'N/A'")
def rejected_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the strict gate in front of valuations, which reports what it rejects."""
    bad = reference.split_valid(view(spark, sf_dir, "targets"), {"postcode": t.normalise_postcode(F.col("postcode")).isNotNull()})[1]
    return bad.select("property_id", "postcode", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT lower(regexp_replace(trim(url), '[?#].*$', '')) AS url_key, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1")
def pages_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page an address, without query, fragment or case."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("url is not null").select(t.url_key(F.col("url")).alias("url_key"), "page_id")
    return linkage.first_seen(p, ["url_key"], "page_id")


# functions that other queries don't run


@query(with_sql("points", "areas") + _AREAS + f"""
, h AS (SELECT point_id, horizon, min(class) AS class FROM points p JOIN sh s ON {_IN_AREA} GROUP BY point_id, horizon)
SELECT p.point_id, '2030:' || coalesce(a.class, 'None') || ',2070:' || coalesce(b.class, 'None') AS trajectory FROM points p LEFT JOIN h a ON a.point_id = p.point_id AND a.horizon = 2030 LEFT JOIN h b ON b.point_id = p.point_id AND b.horizon = 2070""")
def shrink_swell_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's classes by horizon."""
    classes = hazards.shrink_swell(_points(spark, sf_dir), _rings(spark, sf_dir).select("horizon", "class", "ring"), (2070, 2030))
    steps = F.transform("trajectory", lambda x: F.concat(x.getField("horizon").cast("string"), F.lit(":"), x.getField("class")))
    return hazards.trajectory(classes).select("point_id", F.array_join(steps, ",").alias("trajectory"))


@query("""WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 40 AS DOUBLE) / 8 AS x, 50 + CAST(s_suppkey % 24 AS DOUBLE) / 8 AS y FROM supplier)
SELECT k, CASE k % 6 WHEN 5 THEN NULL WHEN 0 THEN y WHEN 1 THEN y + 0.5 WHEN 2 THEN y + 1.0 ELSE y + 0.5 END AS lat, CASE k % 6 WHEN 5 THEN NULL WHEN 0 THEN x WHEN 1 THEN x + 1.0 WHEN 2 THEN x ELSE x + 0.25 END AS lng FROM s""")
def centres_of_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point, and the mean of the first line or outer ring, of each kind of geometry; none of others."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    x, y = (k % 40).cast("double") / 8, F.lit(50) + (k % 24).cast("double") / 8
    at = lambda dx, dy: F.format_string("[%s,%s]", (x + dx).cast("string"), (y + dy).cast("string"))
    listed = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    ring = listed(at(0.0, 0.0), at(0.5, 0.0), at(0.5, 1.0), at(0.0, 1.0))
    shapes = [("Point", at(0.0, 0.0)), ("LineString", listed(at(0.0, 0.0), at(2.0, 1.0))), ("MultiLineString", listed(listed(at(-1.0, 0.0), at(1.0, 2.0)), listed(at(9.0, 9.0)))), ("Polygon", listed(ring)), ("MultiPolygon", listed(listed(ring), listed(listed(at(7.0, 7.0)))))]
    kind, text = F.lit("GeometryCollection"), F.lit("[]")
    for n, (name, shape) in enumerate(shapes):
        kind, text = F.when(k % 6 == n, name).otherwise(kind), F.when(k % 6 == n, shape).otherwise(text)
    centre = geo.feature_centroid(kind, text)
    return s.select(k.alias("k"), centre.getField("lat").alias("lat"), centre.getField("lng").alias("lng"))


@query("""SELECT p_partkey AS lot, p_name AS title, p_size AS guide, CAST(NULL AS VARCHAR) AS venue FROM part UNION ALL SELECT s_suppkey, s_name, NULL, 'room ' || CAST(s_nationkey AS VARCHAR) FROM supplier""")
def lots_of_two_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues with other columns as one table."""
    one = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("lot"), F.col("p_name").alias("title"), F.col("p_size").alias("guide"))
    two = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("lot"), F.col("s_name").alias("title"), F.concat(F.lit("room "), F.col("s_nationkey").cast("string")).alias("venue"))
    return registers.union_schemas(one, two).select("lot", "title", "guide", "venue")


@query(with_sql("stock") + """
, p AS (SELECT branch, CASE WHEN branch % 5 = 0 THEN 'per_quarter' ELSE rent_period END AS period, CAST(price_pence AS DOUBLE) / 100 AS pounds FROM stock WHERE transaction = 'rent')
SELECT branch, period, count(*) AS n, round(max(CASE period WHEN 'per_week' THEN pounds * 52 / 12 WHEN 'per_year' THEN pounds / 12 WHEN 'per_day' THEN pounds * 365 / 12 WHEN 'per_quarter' THEN pounds / 3 ELSE pounds END), 6) AS most_pcm FROM p GROUP BY branch, period""")
def rents_in_pounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rents a calendar month in pounds, not rounded, of all periods."""
    s = view(spark, sf_dir, "stock").filter("transaction = 'rent'")
    period = F.when(F.col("branch") % 5 == 0, "per_quarter").otherwise(F.col("rent_period"))
    s = s.select("branch", period.alias("period"), t.rent_pcm_pounds(F.col("price_pence").cast("double") / 100, period).alias("pcm"))
    return s.groupBy("branch", "period").agg(F.count("*").alias("n"), F.round(F.max("pcm"), 6).alias("most_pcm"))
