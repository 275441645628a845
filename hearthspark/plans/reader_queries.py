"""Registered queries for the readers: files and JSON records are written from the given tables, read back, and compared.

Files go to the shared folder, one for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo, reference
from ..session import shared_checkpoints
from ..sources import features, readers
from .lens import LENSES, view, with_sql
from .queries import query


def _written(rows: DataFrame, label: str, **options: str) -> str:
    path = f"{shared_checkpoints(rows.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    rows.write.options(**options).csv(path)
    return path


LENSES |= {
    "feature_json": """SELECT s_suppkey AS k, '{"attributes":{"LS_ID":"' || CAST(s_suppkey AS STRING) || '","LANDSLIDE_NAME":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE s_name END || '","CLASS":"' || CASE s_suppkey % 3 WHEN 0 THEN 'possible' WHEN 1 THEN 'Probable' ELSE 'odd' END || '"},"geometry":{"y":' || CAST(50 + s_suppkey % 9 AS STRING) || ',"x":-1.5}}' AS landslide,
  '{"properties":{"frontageid":"f' || CAST(s_suppkey AS STRING) || '","smp2055_70":"' || CAST(s_suppkey % 40 AS STRING) || '","nfi2055_70":1,"mt_smp":"' || CASE s_suppkey % 3 WHEN 0 THEN 'Hold The Line' WHEN 1 THEN '' ELSE 'odd' END || '","smp_pu1":"a","smp_pu2":"a","smp_pu3":" ","smp_pu4":"b' || CAST(s_suppkey AS STRING) || '"}}' AS shore,
  '{"entity":"' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS STRING) ELSE 'x' END || '","geometry":"' || CASE WHEN s_suppkey % 4 = 0 THEN 'POINT(1 2)' ELSE '' END || '","organisation-entity":7,"entry-date":"2026-01-02"}' AS entity,
  CASE WHEN s_suppkey % 2 = 0 THEN '{"obs_value":{"value":' || CAST(s_suppkey AS STRING) || '},"geography":{"geogcode":"E1","description":"York"}}' ELSE '{"obs_value":' || CAST(s_suppkey AS STRING) || '}' END AS observation,
  CASE s_suppkey % 3 WHEN 0 THEN '{"id":"d","name":[{"value":"n' || CAST(s_suppkey AS STRING) || '"}]}' WHEN 1 THEN '{"id":"d","name":{"value":"n' || CAST(s_suppkey AS STRING) || '"},"description":""}' ELSE '{"id":"d","name":"n' || CAST(s_suppkey AS STRING) || '"}' END AS entry,
  '{"kind":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'corporate-entity' ELSE 'individual' END || '","name":"N' || CAST(s_suppkey AS STRING) || '","identification":{"registration_number":"0' || CAST(s_suppkey AS STRING) || '"}' || CASE WHEN s_suppkey % 5 = 0 THEN ',"links":{"self":"/company/1/persons-with-significant-control/x/p' || CAST(s_suppkey AS STRING) || '"}' ELSE '' END || '}' AS controller,
  '{"name":"N","officer_role":"director","links":{"officer":{"appointments":"' || CASE WHEN s_suppkey % 7 = 0 THEN '/other' ELSE '/officers/o' || CAST(s_suppkey AS STRING) || '/appointments' END || '"}}}' AS officer,
  '/property/' || CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE CAST(s_suppkey AS STRING) END AS link, 'Flat, LS1 4AB' AS address, CASE WHEN s_suppkey % 5 = 1 THEN ' ' ELSE ' c ' END AS band FROM supplier""",
}


@query(with_sql("feature_json") + """
SELECT k AS landslide_id, CASE WHEN k % 3 <> 0 THEN s_name END AS name, CAST(50 + k % 9 AS DOUBLE) AS lat, CASE k % 3 WHEN 0 THEN 'Possible' WHEN 1 THEN 'Probable' ELSE 'Unknown' END AS class FROM feature_json JOIN supplier ON s_suppkey = k""")
def read_hazard_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20."""
    rows = view(spark, sf_dir, "feature_json").select(F.col("landslide").alias("json"))
    slides = features.landslides(rows)
    classes = features.shrink_swell(rows.withColumn("key", F.get_json_object("json", "$.attributes.LS_ID")), keep=("key",))
    return slides.join(classes, slides["landslide_id"].cast("string") == classes["key"]).select("landslide_id", slides["name"], "lat", "class")


@query(with_sql("feature_json") + """
SELECT 'f' || CAST(k AS VARCHAR) AS frontage_id, CAST(k % 40 AS DOUBLE) AS predicted_m, CASE k % 3 WHEN 0 THEN 'Hold The Line' WHEN 2 THEN 'unknown' END AS medium_policy, 'a,b' || CAST(k AS VARCHAR) AS units FROM feature_json""")
def read_shoreline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W21."""
    s = features.shoreline(view(spark, sf_dir, "feature_json").select(F.col("shore").alias("json")), "smp", 2055, 70)
    return s.select("frontage_id", "predicted_m", "medium_policy", F.array_join("policy_units", ",").alias("units"))


@query(with_sql("feature_json") + """
SELECT CASE WHEN k % 2 = 0 THEN k END AS entity, CASE WHEN k % 4 = 0 THEN 'POINT(1 2)' END AS geometry, CAST(7 AS BIGINT) AS organisation_entity, DATE '2026-01-02' AS entry_date FROM feature_json""")
def read_planning_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W22."""
    return features.planning_entities(view(spark, sf_dir, "feature_json").select(F.col("entity").alias("json"))).select("entity", "geometry", "organisation_entity", "entry_date")


@query(with_sql("feature_json") + """
SELECT 'value' AS what, CAST(CAST(k AS DOUBLE) AS VARCHAR) AS text, CASE WHEN k % 2 = 0 THEN 'York' END AS note FROM feature_json UNION ALL SELECT 'name', 'n' || CAST(k AS VARCHAR), NULL FROM feature_json""")
def read_labour_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W23, W25."""
    j = view(spark, sf_dir, "feature_json")
    o = features.observations(j.select(F.col("observation").alias("json"))).select(F.lit("value").alias("what"), F.col("value").cast("string").alias("text"), F.col("area_name").alias("note"))
    return o.unionByName(features.data_sets(j.select(F.col("entry").alias("json"))).select(F.lit("name").alias("what"), F.col("name").alias("text"), F.col("description").alias("note")))


@query(with_sql("feature_json") + """
SELECT k AS company, CASE WHEN k % 5 = 0 THEN 'p' || CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN 'company:0' || CAST(k AS VARCHAR) ELSE 'fp:individual|n' || CAST(k AS VARCHAR) END AS identity, CASE WHEN k % 2 = 0 THEN '0' || CAST(k AS VARCHAR) END AS company_number, CASE WHEN k % 7 <> 0 THEN 'o' || CAST(k AS VARCHAR) END AS officer FROM feature_json""")
def read_company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W29, A52."""
    j = view(spark, sf_dir, "feature_json")
    c = features.controllers(j.select("k", F.col("controller").alias("json")), "k").select("company", "identity", "company_number")
    return c.join(features.officers(j.select("k", F.col("officer").alias("json")), "k").select("company", "officer"), "company", "left")


@query(with_sql("feature_json") + """
SELECT CAST(k AS VARCHAR) AS property_id, 'LS1 4AB' AS postcode, 'C' AS band FROM feature_json WHERE k % 6 <> 0 AND k % 5 <> 1""")
def read_council_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W30."""
    return features.council_tax(view(spark, sf_dir, "feature_json").withColumn("title", F.lit(""))).select("property_id", "postcode", "band")


@query(with_sql("ppd") + " SELECT transaction_id, price, transfer_date, postcode, property_type, tenure FROM ppd")
def read_price_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public file's sixteen columns, without a header."""
    p = view(spark, sf_dir, "ppd").withColumn("transfer_date", F.concat("transfer_date", F.lit(" 00:00")))
    path = _written(p.select(*(F.col(c).cast("string").alias(c) if c in p.columns else F.lit("N").alias(c) for c in readers.PPD_COLUMNS)), "ppd")
    return readers.price_paid(spark, path).select("transaction_id", "price", "transfer_date", "postcode", "property_type", "tenure")


@query(with_sql("hpi") + """
SELECT region, month, round(value, 1) AS value, '' AS reason FROM hpi WHERE substr(month, 7, 1) <> '5' UNION ALL SELECT region, month, CAST(-1 AS DOUBLE), 'value' FROM hpi WHERE substr(month, 7, 1) = '5'""")
def read_house_price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long file with bad values, split into valid and rejected rows."""
    h = view(spark, sf_dir, "hpi")
    bad = F.substring("month", 7, 1) == "5"
    shown = h.select(F.concat(F.lit("01/"), F.substring("month", 6, 2), F.lit("/"), F.left("month", F.lit(4))).alias("Date"), F.col("region").alias("RegionName"), F.when(bad, "-1").otherwise(F.col("value").cast("string")).alias("Index"))
    valid, rejected = readers.house_price_index(spark, _written(shown, "hpi", header="true"))
    both = valid.select("region", "month", "value", F.lit("").alias("reason")).unionByName(rejected.select("region", "month", "value", "reason"))
    return both.withColumn("value", F.round("value", 1))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query("""SELECT replace('LS' || CAST(c_custkey AS VARCHAR) || '1AA', ' ', '') AS postcode, 'LS' AS postcode_area, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 2 THEN 0.0 ELSE CAST(c_custkey AS DOUBLE) END AS speed, CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 100 AS DOUBLE) ELSE 0.0 END AS full_fibre FROM customer""")
def read_broadband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder with other column orders and columns that some lack; blanks and bad numbers are zero, repeated header rows go."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, F.concat(F.lit("ls"), _text("c_custkey"), F.lit(" 1aa")).alias("postcode"), F.lit("LS").alias("postcode area"), F.when(k % 4 == 0, F.lit("n/a")).otherwise(_text("c_custkey")).alias("Average speed"), (k % 100).cast("string").alias("FTTP"))
    orders = (["postcode", "postcode area", "Average speed"], ["FTTP", "postcode area", "Average speed", "postcode"], ["postcode area", "postcode"])
    path = f"{shared_checkpoints(spark).rstrip('/')}/broadband-{uuid.uuid4().hex}"
    for n, columns in enumerate(orders):
        rows = c.filter(k % 3 == n).select(columns)
        rows.unionByName(rows.limit(1).select(*(F.lit(x).alias(x) for x in columns))).write.mode("append").option("header", True).csv(path)
    return readers.broadband(spark, path, {"Average speed": "speed", "FTTP": "full_fibre"})


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS atco_code, CAST(50 + s_suppkey % 9 + 0.5 AS DOUBLE) AS lat, CASE s_suppkey % 3 WHEN 0 THEN 'rail_station' WHEN 1 THEN 'tram_stop' ELSE 'bus_stop' END AS stop_type FROM supplier""")
def read_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11, A49."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    shown = s.select(_text("s_suppkey").alias("ATCOCode"), F.col("s_name").alias("CommonName"), (50 + k % 9 + F.lit(0.5)).cast("string").alias("Latitude"), F.lit("-1.5").alias("Longitude"), F.when(k % 3 == 0, "RLY").when(k % 3 == 1, "TMU").otherwise("XXX").alias("StopType"))
    return readers.stops(spark, _written(shown, "stops", header="true")).select("atco_code", "lat", "stop_type")


@query("""SELECT n_name AS region, 'rcp85' AS scenario, CAST(2050 AS INT) AS epoch, CAST(n_nationkey + 0.5 AS DOUBLE) AS temp_change_c, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS sea_level_rise_cm, CAST(2000 + n_nationkey AS BIGINT) AS year FROM nation""")
def read_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate projections with a blank sea level, and the list of delivery-test results."""
    n, k = spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey")
    climate = n.select(F.col("n_name").alias("region"), F.lit("rcp85").alias("scenario"), F.lit("2050").alias("epoch"), (k + F.lit(0.5)).cast("string").alias("temp_change_c"), *(F.lit("1").alias(c) for c in ("precip_change_pct", "summer_precip_change_pct", "winter_precip_change_pct")), F.when(k % 2 == 0, k.cast("string")).alias("sea_level_rise_cm"))
    tests = n.select(F.col("n_name").alias("la_code"), F.col("n_name").alias("la_name"), (2000 + k).cast("string").alias("year"), *(F.lit("5").alias(c) for c in ("net_homes_required", "net_homes_delivered", "measurement")))
    delivered = readers.housing_delivery(spark, _written(tests, "delivery", header="true")).select(F.col("la_code").alias("region"), "year")
    return readers.climate_projections(spark, _written(climate, "climate", header="true")).join(delivered, "region").select("region", "scenario", "epoch", "temp_change_c", "sea_level_rise_cm", "year")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT 'E' || CAST(k AS VARCHAR) AS la_code, CAST(2020 AS INT) AS year, CAST(k AS BIGINT) AS households FROM c UNION ALL SELECT 'E' || CAST(k AS VARCHAR), 2021, CAST(k + 7 AS BIGINT) FROM c WHERE k % 5 <> 0 UNION ALL SELECT 'E' || CAST(k AS VARCHAR), 2030, CAST(2 * k AS BIGINT) FROM c WHERE k % 2 = 0""")
def read_household_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year columns of files that have other years; blanks and words are no value."""
    k = F.col("c_custkey")
    wide = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, F.concat(F.lit("E"), _text("c_custkey")).alias("la_code"), F.col("c_name").alias("la_name"), _text("c_custkey").alias("2020"), F.when(k % 10 == 0, F.lit("x")).when(k % 5 == 0, F.lit("")).otherwise((k + 7).cast("string")).alias("2021"), (2 * k).cast("string").alias("2030"))
    path = f"{shared_checkpoints(spark).rstrip('/')}/homes-{uuid.uuid4().hex}"
    wide.filter(k % 2 == 1).select("la_code", "la_name", "2020", "2021").write.option("header", True).csv(path)
    wide.filter(k % 2 == 0).select("2030", "la_code", "2021", "la_name", "2020").write.mode("append").option("header", True).csv(path)
    return readers.household_projections(spark, path, "la_code")


@query(with_sql("hpi") + " SELECT DISTINCT region FROM hpi")
def read_index_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that a long index file has valid months of."""
    shown = view(spark, sf_dir, "hpi").select(F.concat("month", F.lit("-01")).alias("Date"), F.col("region").alias("RegionName"), _text("value").alias("Index"))
    return readers.index_regions(readers.house_price_index(spark, _written(shown, "regions", header="true"))[0])


LENSES |= {
    "more_json": """SELECT s_suppkey AS k, '{"transactionId":"t' || CAST(s_suppkey AS STRING) || '","pricePaid":' || CAST(1000 + s_suppkey AS STRING) || ',"transactionDate":"Wed, 14 Jan 2026","propertyType":' || CASE s_suppkey % 3 WHEN 0 THEN '{"prefLabel":[{"_value":"Detached"}]}' WHEN 1 THEN '{"label":["Flat"]}' ELSE '"Terraced"' END || ',"propertyAddress":{"paon":"1","postcode":"LS1 4AB"}}' AS sale,
  '{"lmk-key":"c' || CAST(s_suppkey AS STRING) || '","postcode":"LS1 4AB","total-floor-area":"' || CAST(s_suppkey AS STRING) || '"}' AS certificate, '{"rows":[{"lmk-key":"r' || CAST(s_suppkey AS STRING) || '","postcode":"M1 1AE","total-floor-area":"7"},{"lmk-key":"q' || CAST(s_suppkey AS STRING) || '","postcode":"M1 1AE","total-floor-area":"8"}]}' AS envelope,
  '{"id":' || CAST(s_suppkey AS STRING) || ',"type":"node",' || CASE WHEN s_suppkey % 5 = 0 THEN '"center":{"lat":51.5,"lon":-0.5}' WHEN s_suppkey % 5 = 1 THEN '"x":1' ELSE '"lat":52.5,"lon":-1.5' END || ',"tags":{"name":"N","' || CASE s_suppkey % 3 WHEN 0 THEN 'amenity":"school' WHEN 1 THEN 'leisure":"park","amenity":"school' ELSE 'shop":"x' END || '"}}' AS element,
  CASE WHEN s_suppkey % 3 = 0 THEN '{"properties":{"NAME":"B' || CAST(s_suppkey AS STRING) || '"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4]]],[[[5,5],[6,5],[6,6]],[[5.2,5.1],[5.8,5.1],[5.8,5.7]]]]}}' WHEN s_suppkey % 3 = 1 THEN '{"properties":{"name":"A' || CAST(s_suppkey AS STRING) || '"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}' ELSE '{"properties":{"name":"C"},"geometry":null}' END AS polygon,
  '{"attributes":{"REFVAL":' || CASE WHEN s_suppkey % 4 = 0 THEN 'null' ELSE '"r' || CAST(s_suppkey AS STRING) || '"' END || ',"KEYVAL":"k","ADDRESS":"A","DATEMODIFIED":"1777503600000","STATUS":"Unknown","ISPAVISIBLE":"' || CAST(s_suppkey % 2 AS STRING) || '"},"geometry":{"x":-1.5,"y":53.5}}' AS application,
  '{"id":"' || CAST(s_suppkey AS STRING) || '","label":"Leeds Centre-Ozone (air)","station":{"geometry":{"coordinates":[' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '53.5,-1.5' END || ']}}}' AS series FROM supplier""",
}


@query(with_sql("more_json") + """
SELECT 't' || CAST(k AS VARCHAR) AS transaction_id, CAST(1000 + k AS BIGINT) AS price, '2026-01-14' AS transfer_date, CASE k % 3 WHEN 0 THEN 'Detached' WHEN 1 THEN 'Flat' ELSE 'Terraced' END AS property_type, 'LS1 4AB' AS postcode FROM more_json""")
def read_sale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a text, an object or a list of either."""
    return readers.price_paid_items(view(spark, sf_dir, "more_json").select(F.col("sale").alias("json"))).select("transaction_id", "price", "transfer_date", "property_type", "postcode")


@query(with_sql("more_json") + """
SELECT 'c' || CAST(k AS VARCHAR) AS lmk_key, 'LS1 4AB' AS postcode, CAST(k AS VARCHAR) AS total_floor_area FROM more_json UNION ALL SELECT 'r' || CAST(k AS VARCHAR), 'M1 1AE', '7' FROM more_json UNION ALL SELECT 'q' || CAST(k AS VARCHAR), 'M1 1AE', '8' FROM more_json""")
def read_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, flat and in envelopes."""
    j = view(spark, sf_dir, "more_json")
    path = f"{shared_checkpoints(spark).rstrip('/')}/certificates-{uuid.uuid4().hex}"
    j.select("certificate").union(j.select("envelope")).toDF("value").write.text(path)
    return readers.certificates(spark, path).select("lmk_key", "postcode", "total_floor_area")


@query(with_sql("hpi") + " SELECT month, max(value) AS value FROM hpi GROUP BY month")
def read_two_column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with one series."""
    shown = view(spark, sf_dir, "hpi").groupBy("month").agg(F.max("value").cast("string").alias("index"))
    return readers.two_column_index(spark, _written(shown, "index", header="true"))[0].select("month", "value")


@query("""SELECT 'E' || CAST(c_custkey AS VARCHAR) AS lsoa_code, CAST(c_custkey AS BIGINT) AS imd_rank, CAST(c_custkey % 10 + 1 AS BIGINT) AS imd_decile FROM customer""")
def read_deprivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with or without a suffix in brackets."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    cells = {"lsoa_code": F.concat(F.lit("E"), k.cast("string")), "imd_rank": k.cast("string"), "imd_decile": (k % 10 + 1).cast("string")}
    shown = c.select(*(cells.get(v, F.lit("1")).alias(f"{h} (where 1 is most deprived)" if v.endswith(("rank", "decile")) else h) for h, v in readers.IMD_COLUMNS.items()))
    return readers.deprivation(spark, _written(shown, "imd", header="true")).select("lsoa_code", "imd_rank", "imd_decile")


@query(with_sql("more_json") + """
SELECT k AS id, CASE WHEN k % 3 = 1 THEN 'park' ELSE 'school' END AS category, CASE WHEN k % 5 = 0 THEN 51.5 ELSE 52.5 END::DOUBLE AS lat FROM more_json WHERE k % 3 <> 2 AND k % 5 <> 1""")
def read_amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first category that fits wins; elements without a place or a category go."""
    e = view(spark, sf_dir, "more_json").select(F.col("element").alias("json"))
    return readers.amenities(e, {"park": ("leisure", "park"), "school": ("amenity", "school")}).select("id", "category", "lat")


@query(with_sql("more_json") + """
SELECT 'B' || CAST(k AS VARCHAR) AS name, CAST(3 AS INT) AS corners, CAST(0 AS INT) AS holes FROM more_json WHERE k % 3 = 0 UNION ALL SELECT 'B' || CAST(k AS VARCHAR), 3, 1 FROM more_json WHERE k % 3 = 0 UNION ALL SELECT 'A' || CAST(k AS VARCHAR), 3, 0 FROM more_json WHERE k % 3 = 1""")
def read_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a polygon, with its holes."""
    return readers.polygons(view(spark, sf_dir, "more_json").select(F.col("polygon").alias("json"))).select("name", F.size("ring").alias("corners"), F.size("holes").alias("holes"))


@query(with_sql("more_json") + """
SELECT 'r' || CAST(k AS VARCHAR) AS reference, 'leeds' AS council, CAST(NULL AS VARCHAR) AS status, k % 2 = 1 AS visible, CAST(53.5 AS DOUBLE) AS lat FROM more_json WHERE k % 4 <> 0""")
def read_planning_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16."""
    return readers.planning_features(view(spark, sf_dir, "more_json").select(F.col("application").alias("json")), "leeds").select("reference", "council", "status", "visible", "lat")


@query(with_sql("more_json") + """
SELECT CAST(k AS VARCHAR) AS id, 'Leeds Centre' AS site, 'o3' AS pollutant, CAST(53.5 AS DOUBLE) AS lat FROM more_json WHERE k % 4 <> 0""")
def read_air_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site split off the label."""
    return readers.air_stations(view(spark, sf_dir, "more_json").select(F.col("series").alias("json"))).select("id", "site", "pollutant", "lat")


@query("""WITH t AS (SELECT n_name AS id, 'TS001' AS topic, n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0) SELECT id, area, sex, CAST(100 * k + v AS INT) AS value FROM t, (VALUES ('x', 'a', 0), ('x', 'b', 1), ('x', 'c', 2), ('y', 'a', 3), ('y', 'b', 4), ('y', 'c', 5)) d(area, sex, v)""")
def decoded_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of one topic, decoded cell by cell."""
    n, k = spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey")
    cubes = n.select(F.col("n_name").alias("id"), F.when(k % 2 == 0, "TS001").otherwise("TS021").alias("topic"), F.array(*((100 * k + v).cast("int") for v in range(6))).alias("observations"))
    return reference.decode_cube(cubes.filter("topic = 'TS001'"), {"area": ["x", "y"], "sex": ["a", "b", "c"]}).select("id", "area", "sex", F.col("value").cast("int").alias("value"))


@query("SELECT n_nationkey, n_name FROM nation")
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON lines, read back."""
    path = f"{shared_checkpoints(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    readers.report(n, path)
    return spark.read.schema(n.schema).json(path)


@query(with_sql("points") + """
SELECT point_id, round(lat - degrees(5000 / 6371008.8), 9) AS lat0, round(lng + degrees(5000 / 6371008.8) / cos(radians(lat)), 9) AS lng1, lat BETWEEN 49.0 AND 61.0 AND lng BETWEEN -8.8 AND 2.1 AS inside FROM points""")
def boxes_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G15."""
    p = view(spark, sf_dir, "points")
    b = geo.bbox(F.col("lat"), F.col("lng"), 5000.0)
    return p.select("point_id", F.round(b.getField("lat0"), 9).alias("lat0"), F.round(b.getField("lng1"), 9).alias("lng1"), geo.in_box(F.col("lat"), F.col("lng")).alias("inside"))
