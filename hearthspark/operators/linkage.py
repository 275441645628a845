"""Linking sales to energy certificates by address and nearest date, in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import staged

EPC_FIELDS = ("lmk_key", "floor_area_sqm", "energy_rating", "energy_efficiency", "inspection_date")


def prepare_sales(ppd: DataFrame) -> DataFrame:
    """Adds sale_date (date), postcode_norm and address_key to sales."""
    pc = t.normalise_postcode(F.col("postcode"))
    return ppd.withColumn("sale_date", F.try_to_date(F.col("transfer_date").cast("string"), "y-M-d")).withColumn("postcode_norm", pc).withColumn("address_key", t.address_key(pc, t.normalise_paon(F.col("paon")), t.normalise_street(F.col("street"))))


def prepare_certificates(epc: DataFrame) -> DataFrame:
    """Certificates with parsed numbers, inspection day, postcode_norm and address_key; rows without a day can't match and go."""
    pc = t.normalise_postcode(F.col("postcode"))
    day = F.try_to_date(F.col("inspection_date").cast("string"), "y-M-d")
    return epc.select(
        "lmk_key", t.parse_floor_area(F.col("total_floor_area")).alias("floor_area_sqm"), F.col("current_energy_rating").alias("energy_rating"),
        t.parse_int(F.col("current_energy_efficiency")).alias("energy_efficiency"), day.alias("inspection_date"), pc.alias("postcode_norm"),
        t.address_key(pc, t.paon_of_address(F.col("address")), t.street_of_address(F.col("address"))).alias("address_key"),
    ).filter(F.col("inspection_date").isNotNull())


def nearest(sales: DataFrame, certificates: DataFrame, key: str, *, max_days: int = 5 * 365, prefer_before_sale: bool = True) -> DataFrame:
    """One certificate for each transaction_id at most: same ``key``, inspected within ``max_days`` of the sale.

    Certificates before the sale rank before any after it (if preferred), then the nearest day, then the key.

    No pairs are made: certificates of one day are one row, and sales and certificates of a key lie in one sorted sequence
    in which each sale sees the last certificate before it and the first after it. Sequences are cut into stretches of
    ``max_days``, with the last certificate of the stretch before and the first of the one after, so that a frequent key is
    split by time.
    """
    width = max_days + 1
    stretch = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / width)
    x = F.struct(F.col("inspection_date"), F.col("c")).alias("x")
    right = _daily(certificates.filter(F.col(key).isNotNull()), key).select(key, stretch(F.col("inspection_date")).alias("b"), x)
    ends = right.groupBy(key, "b").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    beside = ends.select(key, F.explode(F.array(F.struct((F.col("b") - 1).alias("b"), F.col("first").alias("x")), F.struct((F.col("b") + 1).alias("b"), F.col("last").alias("x")))).alias("e")).select(key, "e.b", "e.x")
    right = right.unionByName(beside).select(key, "b", F.col("x.inspection_date").alias("day"), F.lit(0).alias("sale"), F.lit(None).cast(sales.schema["transaction_id"].dataType).alias("transaction_id"), "x")
    left = sales.filter(F.col(key).isNotNull() & F.col("sale_date").isNotNull())
    left = left.select(key, stretch(F.col("sale_date")).alias("b"), F.col("sale_date").alias("day"), F.lit(1).alias("sale"), "transaction_id", F.lit(None).cast(right.schema["x"].dataType).alias("x"))
    # one sort serves both directions; on the day of the sale itself a certificate is before the sale
    order = f"partition by `{key}`, b order by day, sale"
    both = left.unionByName(right).withColumns({"before": F.expr(f"lag(x) ignore nulls over ({order})"), "after": F.expr(f"lead(x) ignore nulls over ({order})")}).filter("sale = 1")

    def candidate(x: str, rank: int) -> Column:
        days = F.abs(F.datediff(F.col(f"{x}.inspection_date"), "day"))
        return F.when(days <= max_days, F.struct(F.lit(rank).alias("rank"), days.alias("days"), F.col(f"{x}.c").alias("c"), F.col(f"{x}.inspection_date").alias("inspection_date")))

    best = F.least(candidate("before", 0), candidate("after", 1 if prefer_before_sale else 0))
    out = both.select("transaction_id", best.alias("x")).filter("x is not null").groupBy("transaction_id").agg(F.min("x").alias("x"))
    return out.select("transaction_id", *((F.col("x.inspection_date") if c == "inspection_date" else F.col(f"x.c.{c}")).alias(c) for c in EPC_FIELDS))


def _daily(certificates: DataFrame, *keys: str) -> DataFrame:
    """One row a day of ``keys``: c, the first of its certificates by their fields."""
    fields = [c for c in EPC_FIELDS if c != "inspection_date"]
    return certificates.groupBy(*keys, "inspection_date").agg(F.min(F.struct(*fields)).alias("c"))


def enrich(ppd: DataFrame, epc: DataFrame, *, max_days: int = 5 * 365, prefer_before_sale: bool = True, postcode_fallback: bool = False) -> DataFrame:
    """Every sale with its certificate's fields and match_quality (exact_address, postcode_only or none).

    An ``ordinal`` column of the sales passes through, by which a sink can restore their order. With the fallback, the
    prepared sales, the first certificate of each address and day (with or without a key) and the address matches are
    staged, since both tiers read them.
    """
    sales, certificates = prepare_sales(ppd), prepare_certificates(epc)
    how = {"max_days": max_days, "prefer_before_sale": prefer_before_sale}
    if not postcode_fallback:
        hits = nearest(sales, certificates, "address_key", **how).withColumn("match_quality", F.lit("exact_address"))
    else:
        # a day's first certificate of a postcode is first at its address too
        daily = _daily(certificates.filter("postcode_norm is not null"), "postcode_norm", "address_key").select("postcode_norm", "address_key", "inspection_date", "c.*")
        sales, certificates = staged(sales), staged(daily)
        exact = staged(nearest(sales, certificates, "address_key", **how).withColumn("match_quality", F.lit("exact_address")))
        left = sales.join(exact.select("transaction_id"), "transaction_id", "left_anti")
        hits = exact.unionByName(nearest(left, certificates, "postcode_norm", **how).withColumn("match_quality", F.lit("postcode_only")))
    return sales.join(hits, "transaction_id", "left").withColumn("match_quality", F.coalesce("match_quality", F.lit("none")))


def overlay(cards: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Cards with every field that the detail row fills in replaced by it; maps are merged, the detail's entries winning."""
    types = dict(details.dtypes)
    d = details.select(F.col(key), *(F.col(c).alias(f"__d_{c}") for c in details.columns if c != key))
    out = cards.join(d, key, "left")

    def pick(c: str) -> Column:
        if c == key or c not in types:
            return F.col(c)
        own = F.col(f"__d_{c}")
        if types[c].startswith("map"):
            return F.when(own.isNull(), F.col(c)).when(F.col(c).isNull(), own).otherwise(F.map_concat(F.map_filter(F.col(c), lambda k, v: ~F.map_contains_key(own, k)), own)).alias(c)
        return F.when(t.populated(own, types[c]), own).otherwise(F.col(c)).alias(c)

    return out.select(*(pick(c) for c in cards.columns), *(F.col(f"__d_{c}").alias(c) for c in details.columns if c not in cards.columns))


def last_wins(table: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return table.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a reference table; Spark broadcasts it if its measured size allows."""
    return rows.join(table, keys, "left")


def first_seen(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
