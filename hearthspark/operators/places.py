"""Postcode geography and what is joined on it: distances, places, neighbourhood rows and bundles of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import geo, profile

METRES_A_MILE = 1609.344


def geography(records: DataFrame) -> DataFrame:
    """One row a postcode: the normalised postcode as key, its outcode, and all other columns; rows without a full postcode go, and the last of repeated ones stays."""
    keyed = records.withColumn("postcode", t.normalise_postcode(F.col("postcode"))).filter("postcode is not null")
    w = Window.partitionBy("postcode").orderBy(*(F.col(c).desc_nulls_last() for c in keyed.columns if c != "postcode"))
    return keyed.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn").withColumn("outcode", F.get(F.split("postcode", " "), F.lit(0)))


def outcodes(postcodes: DataFrame) -> DataFrame:
    """The mean point and the number of postcodes of each outcode."""
    return postcodes.groupBy("outcode").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("postcodes"))


def looked_up(rows: DataFrame, postcodes: DataFrame, *, column: str = "postcode") -> DataFrame:
    """Rows with the geography of their postcode in any spelling; nulls where it isn't known."""
    key = rows.withColumn("__key", t.normalise_postcode(F.col(column)))
    geography_ = postcodes.select(F.col("postcode").alias("__key"), *(c for c in postcodes.columns if c != "postcode" and c not in rows.columns))
    return key.join(geography_, "__key", "left").drop("__key")


def distances(pairs: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Metres (one decimal), kilometres and miles (three) between postcode_a and postcode_b; null if either isn't known."""
    out = pairs
    for end in "ab":
        side = postcodes.select(F.col("postcode").alias(f"__{end}"), F.col("lat").alias(f"__lat_{end}"), F.col("lng").alias(f"__lng_{end}"))
        out = out.withColumn(f"__{end}", t.normalise_postcode(F.col(f"postcode_{end}"))).join(side, f"__{end}", "left")
    m = geo.haversine_m(F.col("__lat_a"), F.col("__lng_a"), F.col("__lat_b"), F.col("__lng_b"))
    out = out.withColumns({"metres": F.bround(m, 1), "kilometres": F.bround(m / 1000, 3), "miles": F.bround(m / METRES_A_MILE, 3)})
    return out.select(*pairs.columns, "metres", "kilometres", "miles")


def postcodes_of_places(places: DataFrame, postcodes: DataFrame, *, radius_m: float = 1000.0, most: int = 5) -> DataFrame:
    """The nearest postcodes of each place (place_id, lat, lng) within the radius."""
    near = geo.within_radius(places, postcodes.select("postcode", "lat", "lng"), radius_m, id_col="place_id")
    w = Window.partitionBy("place_id").orderBy("distance_m", "postcode")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("place_id", "postcode", "rank", "distance_m")


def neighbourhood(rows: DataFrame, postcodes: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """One row a requested postcode with the columns of each block (one row a postcode; None if the source is absent).

    An absent source and an unknown postcode give nulls, never zeros; a known postcode that a counting block has no row
    for gets that block's zero if the block says so (columns named ``n_...``).
    """
    out = looked_up(rows.select("postcode"), postcodes.select("postcode", "lat", "lng"))
    known = F.col("lat").isNotNull()
    for block in blocks.values():
        values = [c for c in block.columns if c != "postcode"]
        out = out.join(block, "postcode", "left")
        out = out.withColumns({c: F.when(known, F.coalesce(F.col(c), F.lit(0)) if c.startswith("n_") else F.col(c)) for c in values})
    return out


def bundle(keys: DataFrame, key: str, sources: dict[str, DataFrame | None], selected: list[str] | None = None) -> DataFrame:
    """One struct a selected source for each key, null where the source has no row, and the names of the sources that are missing as a whole or for the key."""
    names = selected or list(sources)
    there = {n: sources[n] for n in names if sources.get(n) is not None}
    out = profile.assemble(keys, there, key)
    gone = [n for n in names if n not in there]
    return out.withColumn("missing", F.concat(F.col("missing"), F.array(*map(F.lit, gone)).cast("array<string>"))) if gone else out


def latest_year_cutoff(latest: Column, years: int) -> Column:
    """The ISO day ``365 * years`` days before ``latest``."""
    return F.date_format(F.date_sub(latest, 365 * years), "yyyy-MM-dd")
