"""Crime counts, histograms, and one profile row a place put together from independent blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories that count as violent.
VIOLENT = ("violent-crime", "robbery", "possession-of-weapons")


def crime_counts(crime: DataFrame, period: Column) -> DataFrame:
    """Crimes by category (period null) and by period and category, in one pass."""
    p = crime.withColumn("period", period)
    return p.groupingSets([["category"], ["period", "category"]], "period", "category").agg(F.count("*").alias("n")).select("period", "category", "n")


def available_months(crime: DataFrame, period: Column) -> DataFrame:
    """The months that have crimes, latest first in ``rank``."""
    months = crime.select(period.alias("period")).filter("period is not null").distinct()
    return months.withColumn("rank", F.row_number().over(Window.orderBy(F.col("period").desc())))  # a few hundred rows


def trailing_crime(crime: DataFrame, period: Column, months: int) -> DataFrame:
    """``crime_counts`` of the latest ``months`` months that have crimes."""
    kept = available_months(crime, period).filter(F.col("rank") <= months).select("period")
    return crime_counts(crime.withColumn("__p", period).join(kept, F.col("__p") == F.col("period"), "left_semi"), F.col("__p"))


def crime_totals(crime: DataFrame, key: str) -> DataFrame:
    """All, violent, and burglaries (null, not zero, where there are none), by place."""
    n = F.count_if(F.col("category") == "burglary")
    return crime.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("category").isin(*VIOLENT)).alias("violent"), F.when(n > 0, n).alias("burglary"))


def top_categories(crime: DataFrame, key: str, *, most: int = 5) -> DataFrame:
    """The most frequent categories of each place, ties by name."""
    counts = crime.groupBy(key, "category").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "category"))).filter(F.col("rank") <= most)


def rating_histogram(rows: DataFrame, key: str, rating: str) -> DataFrame:
    """A map from rating to count, sorted by rating; nulls don't count."""
    counts = rows.filter(F.col(rating).isNotNull()).groupBy(key, rating).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(rating), "n")))).alias("ratings"))


def assemble(places: DataFrame, blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """Each place with one struct a block (null where the block has no row for it) and the names of the missing blocks."""
    out = places
    for name, block in blocks.items():
        out = out.join(block.select(key, F.struct(*(c for c in block.columns if c != key)).alias(name)), key, "left")
    missing = F.filter(F.array(*(F.when(F.col(b).isNull(), F.lit(b)) for b in blocks)), lambda x: x.isNotNull())
    return out.withColumn("missing", missing)
