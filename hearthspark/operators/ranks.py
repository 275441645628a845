"""Exact values at given ranks of large groups, without a group's values in one task.

Values are counted by group and value, and put in buckets by their logarithm (64 to a doubling, so a bucket of whole
numbers has a bounded number of them). Within a group only the buckets' sizes are added up in order, at most a few thousand rows; a rank
is then looked up in the one bucket that holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks

_PER_DOUBLING = 64


def values_at(counted: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], *, value: str = "value", count: str = "count") -> DataFrame:
    """``keys``, n (values of the group) and, for each named rank (from 0, given n), the value there.

    ``counted`` has a row for some occurrences (``count``) of a positive ``value`` of a group; equal rows add up. Keys may
    be null. A rank that isn't in the group is null.
    """
    bucket = F.floor(F.log2(F.col(value).cast("double")) * _PER_DOUBLING)
    # one deal by bucket serves both sums, and no task sums more than its share of the rows
    dealt = counted.withColumn("__b", bucket).repartition(tasks(counted), *keys, "__b")
    by_value = dealt.groupBy(*keys, "__b", value).agg(F.sum(count).alias("__c"))
    cells = by_value.groupBy(*keys, "__b").agg(F.sum("__c").alias("__m"), F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col("__c").alias("c")))).alias("__v"))
    group = Window.partitionBy(*keys)
    placed = cells.withColumn("__below", F.sum("__m").over(group.orderBy("__b")) - F.col("__m")).withColumn("__n", F.sum("__m").over(group))

    def at(rank: Column) -> Column:
        inside = rank - F.col("__below")
        kind = counted.schema[value].dataType.simpleString()
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(kind).alias("hit"))
        step = lambda s, x: F.struct((s.getField("seen") + x.getField("c")).alias("seen"), F.coalesce(s.getField("hit"), F.when(s.getField("seen") + x.getField("c") > inside, x.getField("v"))).alias("hit"))
        return F.when((inside >= 0) & (inside < F.col("__m")), F.aggregate("__v", start, step, lambda s: s.getField("hit")))

    return placed.groupBy(*keys).agg(F.max("__n").alias("n"), *(F.max(at(r(F.col("__n")))).alias(name) for name, r in ranks.items()))


def quantiles(counted: DataFrame, keys: list[str], shares: list[float], *, value: str = "value", count: str = "count") -> DataFrame:
    """``keys``, n and q: the interpolated quantile for each share, as ``percentile`` gives it."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for k, q in enumerate(shares):
        ranks[f"__low{k}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        ranks[f"__high{k}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    found = values_at(counted, keys, ranks, value=value, count=count)

    def between(k: int, q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(q)
        low, high = F.col(f"__low{k}").cast("double"), F.col(f"__high{k}").cast("double")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, "n", F.array(*(between(k, q) for k, q in enumerate(shares))).alias("q"))


def quantiles_of_few(rows: DataFrame, keys: list[str], shares: list[float], *, value: str = "value") -> DataFrame:
    """``keys``, n and q: interpolated quantiles of few groups of any size, of numbers of either sign; nulls don't count.

    Only sizes of buckets are added up in one task; then the buckets that hold a wanted rank are sorted. Rows are read twice.
    """
    v = F.col(value).cast("double")
    placed = rows.select(*keys, v.alias("__v"), F.floor(F.signum(v) * F.log1p(F.abs(v) * 2**20) * 256).alias("__b")).filter("__v is not null")
    group = Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, "__b").agg(F.count("*").alias("__m"))
    sizes = sizes.withColumns({"__below": F.sum("__m").over(group.orderBy("__b")) - F.col("__m"), "n": F.sum("__m").over(group)})
    at = [(F.col("n") - 1) * F.lit(q) for q in shares]
    ends = F.array(*(F.struct(F.lit(2 * k + up).alias("place"), (F.ceil(x) if up else F.floor(x)).alias("rank"), (x - F.floor(x)).alias("part")) for k, x in enumerate(at) for up in (0, 1)))
    wanted = sizes.select(*keys, "n", "__b", "__below", "__m", F.explode(ends).alias("__e")).filter("__e.rank >= __below and __e.rank < __below + __m")
    wanted = wanted.groupBy(*keys, "__b", "n").agg(F.collect_list(F.struct("__e.place", (F.col("__e.rank") - F.col("__below")).alias("inside"), "__e.part")).alias("__w"))  # two rows a share at most
    same = F.lit(True)
    for c in ("__b", *keys):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    held = placed.alias("l").join(F.broadcast(wanted).alias("r"), same).select(*(f"l.{c}" for c in keys), "n", "l.__b", "__v", "__w")
    sorted_ = held.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__v")) - 1)
    hits = sorted_.select(*keys, "n", "__v", "__rank", F.explode("__w").alias("__e")).filter("__rank = __e.inside")
    by_place = hits.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("__e.place", F.struct("__v", "__e.part")))).alias("__q"))

    def between(k: int) -> Column:
        low, high = (F.col("__q")[F.lit(2 * k + up)] for up in (0, 1))
        part = low.getField("part")
        return F.when(part == 0, low.getField("__v")).otherwise((1 - part) * low.getField("__v") + part * high.getField("__v"))

    return by_place.select(*keys, "n", F.array(*(between(k) for k in range(len(shares)))).alias("q"))
