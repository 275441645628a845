"""House-price indexation: as-of lookups of a monthly index, and prices moved to another month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def validate_index(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) rows of (region, month, value): positive values, proper months, no month twice."""
    w = Window.partitionBy("region", "month")
    checked = index.withColumn("month", F.coalesce(t.ons_month(F.col("month")), F.lit("")))
    checked = checked.withColumn("reason", F.when(F.col("month") == "", "month").when(~(F.coalesce(F.col("value"), F.lit(0.0)) > 0), "value").when(F.count("*").over(w) > 1, "duplicate"))
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def ranges(index: DataFrame) -> DataFrame:
    """region, month, next_month (exclusive, null for the last) and value."""
    return index.withColumn("next_month", F.lead("month").over(Window.partitionBy("region").orderBy("month")))


def by_month(index: DataFrame, last: str | None = None) -> DataFrame:
    """region, month and the index value that holds in it: a row for every month from a region's first on, up to ``last`` or its own last month."""
    to_day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    r = ranges(index)
    end = F.coalesce(F.add_months(to_day(F.col("next_month")), -1), F.greatest(to_day(F.col("month")), to_day(F.lit(last))) if last else to_day(F.col("month")))
    months = F.explode(F.sequence(to_day(F.col("month")), end, F.expr("interval 1 month")))
    return r.select("region", months.alias("day"), "value").select("region", F.date_format("day", "yyyy-MM").alias("month"), "value")


def as_of(rows: DataFrame, index: DataFrame, month: str, *, out: str = "index_value") -> DataFrame:
    """``rows`` with the value of the latest index month on or before ``month``, in the same region; null before the first.

    The index is filled in month by month up to the latest month of the rows, so the join is an equality on region and
    month: a few hundred rows a region, which Spark broadcasts.
    """
    last = rows.agg(F.max(month)).first()[0]
    r = by_month(index, last).select("region", F.col("month").alias(month), F.col("value").alias(out))
    return rows.join(r, ["region", month], "left")


def support(index: DataFrame) -> DataFrame:
    """First and last month of each region, and how many."""
    return index.groupBy("region").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("months"))


def adjust(rows: DataFrame, index: DataFrame, *, price: str = "price", date: str = "transfer_date", to: str | None = None) -> DataFrame:
    """adjusted_price: the price times the index of month ``to`` (by default the latest) over that of its own month, half-even.

    Dates that are blank, unparseable or outside the index's months leave the price as it is, and so does a ``to`` before
    the region's first month; negative prices raise.
    """
    extent = index.groupBy("region").agg(F.max_by("value", "month").alias("__to"), F.max("month").alias("__last_month"))
    if to is not None:
        target = by_month(index, to).filter(F.col("month") == to).select("region", F.col("value").alias("__to"))
        extent = extent.drop("__to").join(target, "region", "left")
    dated = rows.withColumn("__month", t.month_key(F.col(date).cast("string")))
    at = as_of(dated, index, "__month", out="__index").join(F.broadcast(extent), "region", "left")  # one row a region
    own = F.when(F.col(price) < 0, F.raise_error(F.lit("negative price"))).otherwise(F.col(price))
    moved = F.bround(own * F.col("__to") / F.col("__index"), 0).cast("long")
    inside = F.col("__month") <= F.col("__last_month")
    return at.withColumn("adjusted_price", F.coalesce(F.when(inside, moved), own.cast("long"))).select(*rows.columns, "adjusted_price")
