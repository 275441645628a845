"""Readers that give canonical tables from public files: explicit schemas, renamed headers, quality gates.

Everything is read as text and cast without raising; readers that must refuse bad input return (valid, rejected).
"""

from __future__ import annotations

import re
from csv import reader as csv_lines
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions import text as t
from ..operators import temporal
from ..operators.reference import split_valid, unpivot_categories, year_columns

# Columns of the public price-paid file, in file order.
PPD_COLUMNS = ("transaction_id", "price", "transfer_date", "postcode", "property_type", "new_build", "tenure", "paon", "saon", "street", "locality", "town", "district", "county", "category", "record_status")
# Energy certificate fields; the files write them with hyphens.
EPC_COLUMNS = ("lmk_key", "uprn", "address", "postcode", "current_energy_rating", "current_energy_efficiency", "co2_emissions_current", "total_floor_area", "property_type", "built_form", "inspection_date", "lodgement_date", "tenure", "construction_age_band")
# Headers of the deprivation file; a suffix in brackets after a rank or decile doesn't matter.
IMD_COLUMNS = {
    "LSOA code": "lsoa_code", "LSOA name": "lsoa_name", "Local Authority District code": "la_code", "Local Authority District name": "la_name",
    "Index of Multiple Deprivation (IMD) Rank": "imd_rank", "Index of Multiple Deprivation (IMD) Decile": "imd_decile", "Income Rank": "income_rank", "Employment Rank": "employment_rank",
    "Education, Skills and Training Rank": "education_rank", "Health Deprivation and Disability Rank": "health_rank", "Crime Rank": "crime_rank", "Barriers to Housing and Services Rank": "housing_rank", "Living Environment Rank": "living_environment_rank",
}
# Transport stop columns and their names here.
STOP_COLUMNS = {"ATCOCode": "atco_code", "CommonName": "name", "Latitude": "lat", "Longitude": "lng", "StopType": "stop_type_raw", "Indicator": "indicator", "LocalityName": "locality", "ParentLocalityName": "parent_locality"}
# Stop types by code; any other code is a bus stop.
STOP_TYPES = {"RSE": "rail_station", "RLY": "rail_station", "RPL": "rail_station", "BCE": "bus_stop", "BCT": "bus_stop", "BCS": "bus_stop", "TMU": "tram_stop", "MET": "tram_stop", "MQC": "metro_stop", "FTD": "ferry_terminal", "FBT": "ferry_terminal", "AIR": "airport", "GAT": "coach_station"}


def csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All columns as text; headers from each file (byte-order mark removed), or ``columns`` for files without.

    Files of one folder may have their columns in other orders or lack some: each is read by its own header, and a column
    that a file doesn't have is null there. The columns come in the order of the commonest header, others follow by name.
    A name that a header repeats counts where it comes first; files without a line give no rows.
    """
    if columns:
        return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    by_header = files_by_header(spark, path)
    if not by_header:
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = list(dict.fromkeys(by_header[0][0] + tuple(sorted(c for h, _ in by_header[1:] for c in h))))
    out = None
    for header, files in by_header:
        places = [f"__{k}" for k in range(len(header))]
        raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in places)).csv(files)
        own = raw.select(*((F.col(places[header.index(c)]) if c in header else F.lit(None).cast("string")).alias(c) for c in names))
        out = own if out is None else out.unionByName(own)
    return out


def files_by_header(spark: SparkSession, path: str) -> list[tuple[tuple[str, ...], list[str]]]:
    """The different headers of a folder's files and the files of each, the commonest first.

    One job finds each file's first line; what reaches the driver is a list of files, which it needs to read them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("line"))
    first = lines.filter((F.col("start") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).collect():
        header = tuple(c.strip() for c in next(csv_lines([row["header"].lstrip("\ufeff")])))
        found.setdefault(header, []).extend(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in row["files"])
    return sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))


def price_paid(spark: SparkSession, path: str) -> DataFrame:
    r = csv(spark, path, PPD_COLUMNS)
    return r.select("transaction_id", t.safe_price(F.col("price")).alias("price"), t.sale_date(F.split("transfer_date", " ")[0]).alias("transfer_date"), "postcode", "property_type", (F.col("new_build") == "Y").alias("new_build"), "tenure", "paon", "saon", "street", "locality", "town", "district", "county")


def price_paid_items(items: DataFrame, column: str = "json") -> DataFrame:
    """Linked-data sale records (JSON text) as flat rows; labels come as text, {_value} or lists of either."""
    v = F.parse_json(column)

    def label(path: str):
        return F.coalesce(F.try_variant_get(v, f"$.{path}.prefLabel[0]._value", "string"), F.try_variant_get(v, f"$.{path}.label[0]", "string"), F.when(F.try_variant_get(v, f"$.{path}", "string").startswith("{"), None).otherwise(F.try_variant_get(v, f"$.{path}", "string")))

    address = {c: F.try_variant_get(v, f"$.propertyAddress.{c}", "string").alias(c) for c in ("paon", "saon", "street", "locality", "town", "district", "county", "postcode")}
    return items.select(F.try_variant_get(v, "$.transactionId", "string").alias("transaction_id"), F.try_variant_get(v, "$.pricePaid", "long").alias("price"), t.sale_date(F.try_variant_get(v, "$.transactionDate", "string")).alias("transfer_date"), label("propertyType").alias("property_type"), label("estateType").alias("tenure"), *address.values())


def certificates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with hyphenated names, or one envelope {rows: [...]} per line."""
    fields = ", ".join(f"`{c.replace('_', '-')}`: string" for c in EPC_COLUMNS)
    raw = spark.read.schema(", ".join(f"`{c.replace('_', '-')}` string" for c in EPC_COLUMNS) + f", rows array<struct<{fields}>>").json(path)
    flat = raw.filter("rows is null").select(*(F.col(f"`{c.replace('_', '-')}`").alias(c) for c in EPC_COLUMNS))
    nested = raw.filter("rows is not null").select(F.explode("rows").alias("r")).select(*(F.col("r").getField(c.replace("_", "-")).alias(c) for c in EPC_COLUMNS))
    return flat.unionByName(nested)


def house_price_index(spark: SparkSession, path: str, *, region: str = "RegionName", date: str = "Date", value: str = "Index") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) monthly index of all regions of a long file; blank and non-numeric values are left out first."""
    r = csv(spark, path)
    missing = {region, date, value} - set(r.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    rows = r.select(F.col(region).alias("region"), F.col(date).alias("month"), t.coerce_float(F.col(value)).alias("value")).filter("value is not null")
    return temporal.validate_index(rows)


def two_column_index(spark: SparkSession, path: str, *, region: str = "national") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) index of a file with the columns month and index."""
    r = csv(spark, path)
    return temporal.validate_index(r.select(F.lit(region).alias("region"), F.col("month"), t.coerce_float(F.col("index")).alias("value")))


def index_regions(index: DataFrame) -> DataFrame:
    return index.select("region").distinct().orderBy("region")


def deprivation(spark: SparkSession, path: str) -> DataFrame:
    r = csv(spark, path)
    names = {c: v for c in r.columns for k, v in IMD_COLUMNS.items() if c == k or c.startswith(f"{k} (")}
    missing = set(IMD_COLUMNS.values()) - set(names.values())
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return r.select(*((t.parse_int(F.col(f"`{c}`")) if v.endswith(("rank", "decile")) else F.col(f"`{c}`")).alias(v) for c, v in names.items()))


def census(spark: SparkSession, path: str, table_id: str) -> DataFrame:
    r = csv(spark, path)
    return unpivot_categories(r, r.columns[0], r.columns[1]).toDF("code", "name", "category", "value").withColumn("table_id", F.lit(table_id))


def household_projections(spark: SparkSession, path: str, code: str) -> DataFrame:
    return year_columns(csv(spark, path), code)


def housing_delivery(spark: SparkSession, path: str) -> DataFrame:
    """Delivery-test results; whole numbers, null where they aren't."""
    r = csv(spark, path)
    return r.select("la_code", "la_name", *(t.parse_int(F.col(c)).alias(c) for c in ("year", "net_homes_required", "net_homes_delivered", "measurement")))


def climate_projections(spark: SparkSession, path: str) -> DataFrame:
    """Projections by region, scenario and epoch; the sea level may be blank."""
    numbers = ("temp_change_c", "precip_change_pct", "summer_precip_change_pct", "winter_precip_change_pct", "sea_level_rise_cm")
    r = csv(spark, path)
    return r.select("region", "scenario", t.parse_int(F.col("epoch")).cast("int").alias("epoch"), *(t.coerce_float(F.col(c)).alias(c) if c in r.columns else F.lit(None).cast("double").alias(c) for c in numbers))


def broadband(spark: SparkSession, path: str, numbers: dict[str, str], *, postcode: str = "postcode", area: str = "postcode area") -> DataFrame:
    """Many area files at once: ``numbers`` maps headers to columns; blanks, bad numbers and columns that a file lacks are 0, repeated header rows go."""
    r = csv(spark, path)
    missing = {postcode, area} - set(r.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    ok = t.null_if_blank(F.col(f"`{postcode}`")).isNotNull() & t.null_if_blank(F.col(f"`{area}`")).isNotNull() & (F.lower(F.col(f"`{postcode}`")) != postcode.lower())
    number = lambda c: F.coalesce(t.coerce_float(F.col(f"`{c}`")), F.lit(0.0)) if c in r.columns else F.lit(0.0)
    return r.filter(ok).select(t.compact_postcode(F.col(f"`{postcode}`")).alias("postcode"), F.col(f"`{area}`").alias("postcode_area"), *(number(c).alias(v) for c, v in numbers.items()))


def stops(spark: SparkSession, path: str) -> DataFrame:
    r = csv(spark, path)
    table = F.create_map(*(F.lit(x) for kv in STOP_TYPES.items() for x in kv))
    r = r.select(*(F.col(c).alias(v) for c, v in STOP_COLUMNS.items() if c in r.columns))
    return r.withColumns({"lat": t.coerce_float(F.col("lat")), "lng": t.coerce_float(F.col("lng")), "stop_type": F.coalesce(F.try_element_at(table, F.col("stop_type_raw")), F.lit("bus_stop"))}).drop("stop_type_raw")


def amenities(elements: DataFrame, categories: dict[str, tuple[str, str]], column: str = "json") -> DataFrame:
    """Map elements (JSON text) with a place and a category; ``categories`` maps names to (tag, value), the first that fits wins."""
    e = elements.withColumn("e", F.from_json(column, "id long, type string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"))
    category = F.coalesce(*(F.when(F.try_element_at("e.tags", F.lit(k)) == v, F.lit(name)) for name, (k, v) in categories.items()))
    out = e.select(F.col("e.id").alias("id"), F.col("e.type").alias("osm_type"), category.alias("category"), F.try_element_at("e.tags", F.lit("name")).alias("name"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lng"), F.col("e.tags").alias("tags"))
    return out.filter("lat is not null and lng is not null and category is not null")


def polygons(features: DataFrame, column: str = "json") -> DataFrame:
    """One row a polygon of each feature (JSON text): name, properties, ring (the outer one) and holes; features without geometry go."""
    f = features.withColumn("f", F.from_json(column, "properties map<string,string>, geometry struct<type:string,coordinates:string>")).filter("f.geometry is not null")
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))))
    return f.withColumn("rings", F.explode(rings)).select(F.coalesce(F.try_element_at("f.properties", F.lit("name")), F.try_element_at("f.properties", F.lit("NAME"))).alias("name"), F.col("f.properties").alias("properties"), F.get("rings", F.lit(0)).alias("ring"), F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))).alias("holes"))


def planning_features(features: DataFrame, council: str, column: str = "json") -> DataFrame:
    """Applications of a map service (JSON text of one feature a row); rows without a reference or key go."""
    f = features.withColumn("f", F.from_json(column, "attributes map<string,string>, geometry struct<x:double,y:double>"))
    a = lambda k: F.try_element_at("f.attributes", F.lit(k))
    out = f.select(F.lit(council).alias("council"), a("REFVAL").alias("reference"), a("KEYVAL").alias("key_val"), a("ADDRESS").alias("address"), a("DESCRIPTION").alias("description"), F.timestamp_millis(a("DATEMODIFIED").try_cast("long")).alias("last_modified"), t.placeholder_to_null(a("STATUS")).alias("status"), F.coalesce(a("ISPAVISIBLE") == "1", F.lit(True)).alias("visible"), F.col("f.geometry.y").alias("lat"), F.col("f.geometry.x").alias("lng"))
    return out.filter("reference is not null and key_val is not null")


def air_stations(series: DataFrame, column: str = "json") -> DataFrame:
    """Stations of a time-series list (JSON text); the first coordinate is the latitude, as the service gives it."""
    s = series.withColumn("s", F.from_json(column, "id string, label string, station struct<geometry:struct<coordinates:array<double>>>"))
    c, site = F.col("s.station.geometry.coordinates"), records.site_of_label(F.col("s.label"))
    out = s.select(F.col("s.id").alias("id"), F.col("s.label").alias("label"), site.getField("site").alias("site"), F.get(c, F.lit(0)).alias("lat"), F.get(c, F.lit(1)).alias("lng"), t.pollutant(F.coalesce(site.getField("pollutant"), F.col("s.label"))).alias("pollutant"))
    return out.filter("id is not null and label is not null and lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")


def checked(rows: DataFrame, **ranges: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): every named column within its range."""
    return split_valid(rows, {c: F.col(c).between(*r) for c, r in ranges.items()})


def report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, one file a task."""
    rows.write.mode("overwrite").json(path)
