"""Valuation from comparable sales in tiers, rental yields, and price statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import tasks
from . import ranks

MIN_ROWS, HIGH_ROWS, MEDIUM_ROWS = 3, 10, 5
#: Tiers from the closest to the widest. The second is the full postcode with any type, by its historic name.
TIERS = ("postcode_type", "postcode_area", "area_type", "area_only", "national")


def comparables(ppd: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Sales with a price, from ``cutoff`` (ISO text) on."""
    out = ppd.filter(F.col("price") > 0)
    return out.filter(F.col("transfer_date").cast("string") >= cutoff) if cutoff else out


def pool_statistics(pool: DataFrame) -> DataFrame:
    """Count and quartiles of the pool for each tier's groups (g tells the tier: a bit for each of pc, area and type that is left out).

    Sales are counted by postcode, type and price once; all tiers come from those counts.
    """
    p = pool.select(F.upper(F.regexp_replace("postcode", " ", "")).alias("pc"), t.postcode_area(F.col("postcode")).alias("area"), F.upper("property_type").alias("type"), F.col("price").cast("double").alias("value"))
    counted = p.repartition(tasks(p), "pc", "area", "type", "value").groupBy("pc", "area", "type", "value").agg(F.count("*").alias("count"))
    tiers = {2: ("pc", "type"), 3: ("pc",), 4: ("area", "type"), 5: ("area",), 7: ()}
    none = F.lit(None).cast("string")
    rows = F.explode(F.array(*(F.struct(*((F.col(c) if c in kept else none).alias(c) for c in ("pc", "area", "type")), F.lit(g).alias("g")) for g, kept in tiers.items())))
    sets = counted.select(rows.alias("x"), "value", "count").select("x.*", "value", "count")
    return ranks.quantiles(sets, ["pc", "area", "type", "g"], [0.25, 0.5, 0.75])


def _confidence(n: Column, basis: Column) -> Column:
    return F.when(basis.isin("insufficient_data", "national", "area_only"), "low").when((n >= HIGH_ROWS) & (basis == "postcode_type"), "high").when(n >= MEDIUM_ROWS, "medium").otherwise("low")


def estimate(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """Each target (postcode, property_type or null) with the estimate of its closest tier that has enough sales.

    Adds estimate_gbp, low_gbp, high_gbp (half-even), comparables_used, basis and confidence; zeros and
    ``insufficient_data`` without a tier, or if the postcode isn't one.
    """
    stats = pool_statistics(pool).filter(F.col("n") >= MIN_ROWS).checkpoint()  # read once a tier
    out = targets.withColumn("__pc", F.regexp_replace(t.normalise_postcode(F.col("postcode")), " ", "")).withColumn("__area", t.postcode_area(F.col("__pc"))).withColumn("__type", F.upper("property_type"))
    # grouping_id has a bit for each of (pc, area, type) that a row is summed over
    keys = {"postcode_type": (2, ["pc", "type"]), "postcode_area": (3, ["pc"]), "area_type": (4, ["area", "type"]), "area_only": (5, ["area"])}
    for k, (tier, (g, cols)) in enumerate(keys.items()):
        part = stats.filter((F.col("g") == g) & (F.col("n") >= MIN_ROWS))
        for c in cols:
            part = part.filter(F.col(c).isNotNull())
        part = part.select(*(F.col(c).alias(f"__{c}") for c in cols), F.struct(F.lit(k).alias("k"), "n", "q").alias(f"__t{k}"))
        out = out.join(part, [f"__{c}" for c in cols], "left")
    nation = stats.filter((F.col("g") == 7) & (F.col("n") >= MIN_ROWS)).select(F.struct(F.lit(4).alias("k"), "n", "q").alias("__t4"))
    out = out.join(F.broadcast(nation), F.col("__pc").isNotNull(), "left")  # one row at most
    best = F.coalesce(*(F.col(f"__t{k}") for k in range(5)))
    best = F.when(F.col("__pc").isNotNull(), best)
    out = out.withColumn("__b", best)
    basis = F.coalesce(F.get(F.array(*map(F.lit, TIERS)), F.col("__b.k")), F.lit("insufficient_data"))
    pounds = [F.coalesce(F.bround(F.get(F.col("__b.q"), F.lit(i)), 0).cast("long"), F.lit(0)) for i in (1, 0, 2)]
    n = F.coalesce(F.col("__b.n"), F.lit(0))
    return out.select(*targets.columns, *(p.alias(a) for p, a in zip(pounds, ("estimate_gbp", "low_gbp", "high_gbp"))), n.alias("comparables_used"), basis.alias("basis"), _confidence(n, basis).alias("confidence"))


# Labels of rent sources.
RENT_SOURCES = {"listing": "scraped listing", "voa_prms": "VOA PRMS median", "ons_benchmark": "ONS benchmark", "user_override": "user override", "unknown": "unspecified"}


def rental_yield(valued: DataFrame) -> DataFrame:
    """Yields of rows with estimate_gbp, monthly_rent_gbp, costs_pct (0 to 1 or null) and rent_source; nulls where there is no valuation."""
    annual = F.col("monthly_rent_gbp") * 12
    gross = annual / F.col("estimate_gbp") * 100
    label = F.coalesce(*(F.when(F.col("rent_source") == k, v) for k, v in RENT_SOURCES.items()))
    kind = F.when(F.col("costs_pct").isNotNull(), "gross+net (cost-adjusted) from ").otherwise("gross only from ")
    held = lambda c: F.when(F.col("estimate_gbp") > 0, c)
    return valued.withColumns({
        "annual_rent_gbp": held(annual), "gross_yield_pct": held(F.bround(gross, 3)), "net_yield_pct": held(F.bround(gross * (1 - F.col("costs_pct")), 3)),
        "payback_years": held(F.when(annual > 0, F.bround(F.col("estimate_gbp") / annual, 2))), "methodology": held(F.concat(kind, label)),
    })


def published_stock(branches: DataFrame) -> DataFrame:
    """Stock by the branch's own totals, or the number of its listings where a total is null or zero; commercial ones count too.

    Columns: sale_total, rent_total, sale_listings, rent_listings, commercial_sale, commercial_rent (numbers of listings),
    sale_average, rent_average (pounds). Branches without any stock go.
    """
    n = F.col
    sale, rent = (F.coalesce(F.nullif(F.col(f"{k}_total"), F.lit(0)), n(f"{k}_listings")) for k in ("sale", "rent"))
    total = F.coalesce(sale, F.lit(0)) + F.coalesce(rent, F.lit(0)) + F.coalesce(n("commercial_sale"), F.lit(0)) + F.coalesce(n("commercial_rent"), F.lit(0))
    pence = lambda c: F.when(F.col(c) != 0, F.col(c) * 100)
    return branches.withColumns({"total_live": total, "for_sale": sale, "to_rent": rent, "median_price_pence": pence("sale_average"), "median_rent_pence": pence("rent_average")}).filter("total_live > 0").select("branch", "total_live", "for_sale", "to_rent", "median_price_pence", "median_rent_pence")


def price_block(ppd: DataFrame, key: str) -> DataFrame:
    """Count, upper median, floored mean, min and max of positive prices, by ``key``."""
    counted = ppd.filter("price > 0").groupBy(key, "price").agg(F.count("*").alias("count"))
    middle = ranks.values_at(counted, [key], {"median_price": lambda n: F.floor(n / 2)}, value="price").select(F.col(key).alias("__key"), "median_price")
    rest = counted.groupBy(key).agg(F.sum("count").alias("sales"), F.floor(F.sum(F.col("price") * F.col("count")) / F.sum("count")).cast("long").alias("mean_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return rest.join(middle, F.col(key).eqNullSafe(F.col("__key"))).select(key, "sales", "median_price", "mean_price", "min_price", "max_price")


def recent_sales(ppd: DataFrame, key: str, *, limit: int = 5) -> DataFrame:
    """The ``limit`` latest sales of each ``key``, without those that lack a price or date."""
    w = Window.partitionBy(key).orderBy(F.col("transfer_date").desc_nulls_last(), "transaction_id")
    return ppd.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= limit) & F.col("price").isNotNull() & F.col("transfer_date").isNotNull()).select(key, "rank", "transaction_id", "transfer_date", "price")


def stock_summary(stock: DataFrame) -> DataFrame:
    """By branch: counts for sale and to rent, and floored medians of asking price and monthly rent (pence)."""
    sale, rent = F.col("transaction") == "sale", F.col("transaction") == "rent"
    pcm = t.rent_pcm_pence(F.col("price_pence"), F.col("rent_period"))
    return stock.groupBy("branch").agg(
        F.count_if(sale).alias("for_sale"), F.count_if(rent).alias("to_rent"), F.count("*").alias("total"),
        F.floor(F.percentile(F.when(sale, F.col("price_pence")), 0.5)).alias("median_price_pence"), F.floor(F.percentile(F.when(rent, pcm), 0.5)).alias("median_rent_pcm_pence"),
    )
