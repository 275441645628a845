"""Reference tables: wide files to long rows, deciles, pivots and lookups by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECILE_SIZE = 3285


def domain_decile(rank: Column) -> Column:
    """Decile of a domain's rank, 1 the most deprived; not clamped."""
    return F.floor((rank - 1) / DECILE_SIZE).cast("long") + 1


def unpivot_categories(wide: DataFrame, code: str, name: str) -> DataFrame:
    """One row a code and category of a wide table (every further column is a category); non-numbers go."""
    categories = [c for c in wide.columns if c not in (code, name)]
    long = wide.select(code, name, *(F.col(c).cast("string").alias(c) for c in categories)).unpivot([code, name], categories, "category", "value")
    return long.withColumn("value", F.regexp_replace("value", ",", "").try_cast("double")).filter("value is not null")


def year_columns(wide: DataFrame, code: str) -> DataFrame:
    """One row a code and year of a table whose all-digit columns are years."""
    years = [c for c in wide.columns if c.isdigit()]
    return wide.select(code, *(F.col(y).cast("string").alias(y) for y in years)).unpivot([code], years, "year", "households").select(code, F.col("year").cast("int").alias("year"), F.col("households").try_cast("double").cast("long").alias("households")).filter("households is not null")


def measures(observations: DataFrame, key: str, wanted: dict[str, str], order: Column) -> DataFrame:
    """One row a key and one column a wanted measure (id to name): its last value by ``order``."""
    last = observations.groupBy(key).pivot("measure", list(wanted)).agg(F.max_by("value", order))
    return last.select(key, *(F.col(m).alias(n) for m, n in wanted.items()))


def population_by_age(rows: DataFrame, key: str) -> DataFrame:
    """Total over all rows, and a map of labels to the last count given (repeated labels still add to the total)."""
    last = rows.groupBy(key, "label").agg(F.max(F.struct("ordinal", "n")).alias("x"), F.sum("n").alias("t"))
    return last.groupBy(key).agg(F.sum("t").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.col("x.n").alias("n"))))).alias("by_age"))


def decode_cube(cube: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Flat observations of a cube (column ``observations``, last axis fastest) as one row a cell with its axis labels."""
    rows = cube.select(*(c for c in cube.columns if c != "observations"), F.posexplode("observations").alias("__i", "value"))
    stride, columns = 1, {}
    for name, labels in reversed(list(axes.items())):
        columns[name] = F.get(F.array(*map(F.lit, labels)), F.pmod(F.floor(F.col("__i") / stride), F.lit(len(labels))).cast("int"))
        stride *= len(labels)
    return rows.withColumns(columns).drop("__i")


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the reasons that apply); a rule that is null counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    checked = rows.withColumn("reasons", broken)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)
