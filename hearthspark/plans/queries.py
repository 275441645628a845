"""Registered queries over the lens tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import linkage, temporal, valuation
from ..session import shared_checkpoints
from .lens import view, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PC = "CASE WHEN regexp_full_match(replace(upper(trim({0})), ' ', ''), '[A-Z]{{1,2}}[0-9][A-Z0-9]?[0-9][A-Z]{{2}}') THEN left(replace(upper(trim({0})), ' ', ''), -3) || ' ' || right(replace(upper(trim({0})), ' ', ''), 3) END".format("postcode")
_AREA = "nullif(regexp_extract(upper(trim(postcode)), '^([A-Z]{1,2})[0-9]', 1), '')"


@query(with_sql("ppd") + f"""
SELECT transaction_id, {_PC} AS postcode_norm, {_AREA} AS area, coalesce({_AREA}, 'UNKNOWN') AS area_safe, upper(replace(postcode, ' ', '')) AS compact,
  length(replace(postcode, ' ', '')) >= 5 AND (left(upper(postcode), 2) IN ('AB','DD','DG','EH','FK','HS','IV','KA','KW','KY','ML','PA','PH','TD','ZE') OR left(upper(postcode), 1) = 'G') AS scottish,
  CASE WHEN property_type IN ('D','S','T','F','O') THEN property_type ELSE 'UNKNOWN' END AS type_safe,
  CASE WHEN tenure = 'F' THEN 'FREEHOLD' WHEN tenure = 'L' THEN 'LEASEHOLD' ELSE 'UNKNOWN' END AS tenure_norm FROM ppd""")
def text_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A5, A16, A18."""
    pc = F.col("postcode")
    return view(spark, sf_dir, "ppd").select("transaction_id", t.normalise_postcode(pc).alias("postcode_norm"), t.postcode_area(pc).alias("area"), t.postcode_area(pc, "UNKNOWN").alias("area_safe"), t.compact_postcode(pc).alias("compact"), t.is_scottish(pc).alias("scottish"), t.property_type_safe(F.col("property_type")).alias("type_safe"), t.normalise_tenure(F.col("tenure")).alias("tenure_norm"))


_KEY_SALE = f"{_PC} || '|' || paon || '|' || replace(street, ' Rd', ' ROAD')"
_NUMBERED = "regexp_matches(address, '^[0-9]+ ')"
_KEY_EPC = f"{_PC} || '|' || CASE WHEN {_NUMBERED} THEN regexp_extract(address, '^([0-9]+) ', 1) ELSE upper(split_part(address, ',', 1)) END || '|' || CASE WHEN {_NUMBERED} THEN upper(regexp_extract(address, '^[0-9]+ ([^,]*),', 1)) ELSE 'TOWN' END"


@query(with_sql("epc") + f"""
SELECT lmk_key, {_KEY_EPC} AS address_key, CAST(replace(total_floor_area, ' m2', '') AS DOUBLE) AS floor_area, CAST(current_energy_efficiency AS BIGINT) AS efficiency FROM epc""")
def text_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7-A13."""
    a = F.col("address")
    key = t.address_key(t.normalise_postcode(F.col("postcode")), t.paon_of_address(a), t.street_of_address(a))
    return view(spark, sf_dir, "epc").select("lmk_key", key.alias("address_key"), t.parse_floor_area(F.col("total_floor_area")).alias("floor_area"), t.parse_int(F.col("current_energy_efficiency")).alias("efficiency"))


@query(with_sql("listing_text") + """
SELECT p_partkey, CAST(replace(replace(price_text, '£', ''), ',', '') AS BIGINT) * 100 AS pence,
  CASE p_partkey % 12 WHEN 0 THEN 'guide_price' WHEN 1 THEN 'offers_in_excess_of' WHEN 2 THEN 'offers_in_region' WHEN 3 THEN 'offers_over' WHEN 4 THEN 'offers_in_excess_of' WHEN 5 THEN 'offers_in_region' WHEN 6 THEN 'from' WHEN 7 THEN 'fixed_price'
    WHEN 8 THEN 'asking_price' WHEN 9 THEN 'poa' WHEN 10 THEN 'shared_ownership_from' ELSE 'unknown' END AS qualifier,
  CASE p_partkey % 8 WHEN 0 THEN 'per_month' WHEN 1 THEN 'per_week' WHEN 2 THEN 'per_year' WHEN 3 THEN 'per_month' WHEN 4 THEN 'per_week' WHEN 5 THEN 'per_day' WHEN 6 THEN 'per_week' ELSE 'unknown' END AS period,
  CASE p_partkey % 6 WHEN 0 THEN 'semi_detached' WHEN 1 THEN 'bungalow' WHEN 2 THEN 'end_of_terrace' WHEN 3 THEN 'flat' WHEN 4 THEN 'studio' ELSE 'other' END AS property_type,
  CASE p_partkey % 6 WHEN 4 THEN 'share_of_freehold' WHEN 5 THEN 'leasehold' ELSE 'unknown' END AS tenure,
  CASE p_partkey % 5 WHEN 0 THEN 'reduced,chain_free' WHEN 1 THEN 'new_home' WHEN 2 THEN 'auction,investment,tenanted_investment' WHEN 3 THEN 'virtual_tour' ELSE '' END AS features,
  CASE p_partkey % 7 WHEN 0 THEN 'gigabit' WHEN 1 THEN 'ultrafast' WHEN 2 THEN 'superfast' WHEN 3 THEN 'basic' ELSE CASE p_partkey % 4 WHEN 0 THEN 'ultrafast' WHEN 1 THEN 'superfast' WHEN 2 THEN 'basic' ELSE 'unknown' END END AS tier,
  CASE p_partkey % 6 WHEN 0 THEN 'enhanced' WHEN 1 THEN 'likely' WHEN 2 THEN 'limited' WHEN 3 THEN 'none' WHEN 4 THEN NULL ELSE 'unknown' END AS mobile FROM listing_text""")
def text_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27-A32, A34, A35."""
    c = F.col
    return view(spark, sf_dir, "listing_text").select("p_partkey", t.price_pence(c("price_text")).alias("pence"), t.price_qualifier(c("qualifier_text")).alias("qualifier"), t.rent_period(c("period_text")).alias("period"), t.property_type_in_text(c("title")).alias("property_type"), t.tenure_in_text(c("title")).alias("tenure"), F.array_join(t.features_in_text(c("blurb")), ",").alias("features"), t.broadband_tier(c("speed"), c("technology")).alias("tier"), t.mobile_level(c("mobile")).alias("mobile"))


_LINK = f""", s AS (SELECT *, {_PC} AS pc, {_KEY_SALE} AS k, CAST(transfer_date AS DATE) AS d FROM ppd),
e AS (SELECT lmk_key, {_PC} AS pc, {_KEY_EPC} AS k, CAST(inspection_date AS DATE) AS d, CAST(replace(total_floor_area, ' m2', '') AS DOUBLE) AS a, current_energy_rating AS r, CAST(current_energy_efficiency AS BIGINT) AS f FROM epc WHERE inspection_date <> ''),
x AS (SELECT transaction_id, lmk_key, a, r, f, row_number() OVER (PARTITION BY transaction_id ORDER BY CASE WHEN e.d > s.d THEN 1 ELSE 0 END, abs(date_diff('day', s.d, e.d)), lmk_key, e.d, a, r, f) AS rn FROM s JOIN e ON s.k = e.k WHERE abs(date_diff('day', s.d, e.d)) <= 365),
y AS (SELECT transaction_id, lmk_key, a, r, f, row_number() OVER (PARTITION BY transaction_id ORDER BY CASE WHEN e.d > s.d THEN 1 ELSE 0 END, abs(date_diff('day', s.d, e.d)), lmk_key, e.d, a, r, f) AS rn FROM s JOIN e ON s.pc = e.pc WHERE abs(date_diff('day', s.d, e.d)) <= 365 AND transaction_id NOT IN (SELECT transaction_id FROM x)),
m AS (SELECT *, 'exact_address' AS q FROM x WHERE rn = 1 UNION ALL SELECT *, 'postcode_only' AS q FROM y WHERE rn = 1)"""


@query(with_sql("ppd", "epc") + _LINK + """
SELECT s.transaction_id, s.price, m.lmk_key, m.a AS floor_area_sqm, m.r AS energy_rating, m.f AS energy_efficiency, coalesce(m.q, 'none') AS match_quality FROM s LEFT JOIN m USING (transaction_id)""")
def link_sales_to_epc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest certificate within a year by address, else by postcode."""
    shared_checkpoints(spark)
    out = linkage.enrich(view(spark, sf_dir, "ppd"), view(spark, sf_dir, "epc"), max_days=365, postcode_fallback=True)
    return out.select("transaction_id", "price", "lmk_key", "floor_area_sqm", "energy_rating", "energy_efficiency", "match_quality")


@query(with_sql("ppd", "hpi") + """
, r AS (SELECT *, lead(month) OVER (PARTITION BY region ORDER BY month) AS nxt FROM hpi), l AS (SELECT region, max(month) AS last_month, arg_max(value, month) AS last_value FROM hpi GROUP BY region)
SELECT p.transaction_id, p.price, CASE WHEN r.value IS NOT NULL AND substr(p.transfer_date, 1, 7) <= l.last_month THEN CAST(round_even(p.price * l.last_value / r.value, 0) AS BIGINT) ELSE p.price END AS adjusted_price
FROM ppd p LEFT JOIN r ON r.region = p.region AND substr(p.transfer_date, 1, 7) >= r.month AND (r.nxt IS NULL OR substr(p.transfer_date, 1, 7) < r.nxt) LEFT JOIN l ON l.region = p.region""")
def hpi_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, J5, H3-H6."""
    return temporal.adjust(view(spark, sf_dir, "ppd"), view(spark, sf_dir, "hpi")).select("transaction_id", "price", "adjusted_price")


@query(with_sql("hpi") + " SELECT region, min(month) AS first_month, max(month) AS last_month, count(*) AS months FROM hpi WHERE value > 0 GROUP BY region")
def hpi_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, H1, H2."""
    return temporal.support(temporal.validate_index(view(spark, sf_dir, "hpi"))[0])


_VALUE = f""", pool AS (SELECT price, property_type AS ty, upper(replace(postcode, ' ', '')) AS pc, {_AREA} AS area FROM ppd WHERE price > 0 AND transfer_date >= '1995-01-01'),
tg AS (SELECT property_id, property_type AS ty, replace({_PC}, ' ', '') AS pc, CASE WHEN {_PC} IS NOT NULL THEN {_AREA} END AS area FROM targets),
s1 AS (SELECT pc, ty, count(*) AS n, median(price) AS m, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM pool GROUP BY pc, ty HAVING count(*) >= 3),
s2 AS (SELECT pc, count(*) AS n, median(price) AS m, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM pool GROUP BY pc HAVING count(*) >= 3),
s3 AS (SELECT area, ty, count(*) AS n, median(price) AS m, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM pool WHERE area IS NOT NULL GROUP BY area, ty HAVING count(*) >= 3),
s4 AS (SELECT area, count(*) AS n, median(price) AS m, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM pool WHERE area IS NOT NULL GROUP BY area HAVING count(*) >= 3),
s5 AS (SELECT count(*) AS n, median(price) AS m, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM pool HAVING count(*) >= 3),
u AS (SELECT property_id, tg.pc,
  CASE WHEN s1.n IS NOT NULL THEN 'postcode_type' WHEN s2.n IS NOT NULL THEN 'postcode_area' WHEN s3.n IS NOT NULL THEN 'area_type' WHEN s4.n IS NOT NULL THEN 'area_only' WHEN s5.n IS NOT NULL AND tg.pc IS NOT NULL THEN 'national' ELSE 'insufficient_data' END AS basis,
  coalesce(s1.n, s2.n, s3.n, s4.n, CASE WHEN tg.pc IS NOT NULL THEN s5.n END, 0) AS n, coalesce(s1.m, s2.m, s3.m, s4.m, CASE WHEN tg.pc IS NOT NULL THEN s5.m END, 0) AS m,
  coalesce(s1.lo, s2.lo, s3.lo, s4.lo, CASE WHEN tg.pc IS NOT NULL THEN s5.lo END, 0) AS lo, coalesce(s1.hi, s2.hi, s3.hi, s4.hi, CASE WHEN tg.pc IS NOT NULL THEN s5.hi END, 0) AS hi
  FROM tg LEFT JOIN s1 ON tg.pc = s1.pc AND tg.ty = s1.ty LEFT JOIN s2 ON tg.pc = s2.pc LEFT JOIN s3 ON tg.area = s3.area AND tg.ty = s3.ty LEFT JOIN s4 ON tg.area = s4.area LEFT JOIN s5 ON true)"""


@query(with_sql("ppd", "targets") + _VALUE + """
SELECT property_id, CAST(round_even(m, 0) AS BIGINT) AS estimate_gbp, CAST(round_even(lo, 0) AS BIGINT) AS low_gbp, CAST(round_even(hi, 0) AS BIGINT) AS high_gbp, n AS comparables_used, basis,
  CASE WHEN basis IN ('insufficient_data', 'national', 'area_only') THEN 'low' WHEN n >= 10 AND basis = 'postcode_type' THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM u""")
def value_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V6: every target's value from its closest tier of comparables."""
    shared_checkpoints(spark)
    pool = valuation.comparables(view(spark, sf_dir, "ppd"), "1995-01-01")
    return valuation.estimate(view(spark, sf_dir, "targets"), pool).select("property_id", "estimate_gbp", "low_gbp", "high_gbp", "comparables_used", "basis", "confidence")


@query(with_sql("ppd", "targets") + _VALUE + """
, v AS (SELECT property_id, CASE WHEN m > 0 THEN round_even(m, 0) END AS e, 500.0 + property_id % 1000 AS rent, CASE WHEN property_id % 2 = 0 THEN 0.25 END AS costs FROM u)
SELECT property_id, round(rent * 12 / e * 100, 3) AS gross_yield_pct, round(rent * 12 / e * 100 * (1 - costs), 3) AS net_yield_pct, round(e / (rent * 12), 2) AS payback_years,
  CASE WHEN e IS NULL THEN NULL WHEN costs IS NULL THEN 'gross only from ' ELSE 'gross+net (cost-adjusted) from ' END || 'ONS benchmark' AS methodology FROM v""")
def rental_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7."""
    valued = value_properties(spark, sf_dir).withColumns({"monthly_rent_gbp": F.lit(500.0) + F.col("property_id") % 1000, "costs_pct": F.when(F.col("property_id") % 2 == 0, F.lit(0.25)), "rent_source": F.lit("ons_benchmark")})
    return valuation.rental_yield(valued).select("property_id", "gross_yield_pct", "net_yield_pct", "payback_years", "methodology")


@query(with_sql("ppd") + """
, r AS (SELECT postcode, price, row_number() OVER (PARTITION BY postcode ORDER BY price) AS rn, count(*) OVER (PARTITION BY postcode) AS n FROM ppd WHERE price > 0)
SELECT postcode, count(*) AS sales, max(CASE WHEN rn = n // 2 + 1 THEN price END) AS median_price, CAST(floor(sum(price) / count(*)) AS BIGINT) AS mean_price, min(price) AS min_price, max(price) AS max_price FROM r GROUP BY postcode""")
def price_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8."""
    return valuation.price_block(view(spark, sf_dir, "ppd"), "postcode")


@query(with_sql("ppd") + """
SELECT postcode, rank, transaction_id, transfer_date, price FROM (SELECT *, CAST(row_number() OVER (PARTITION BY postcode ORDER BY transfer_date DESC NULLS LAST, transaction_id) AS INT) AS rank FROM ppd) WHERE rank <= 5 AND price IS NOT NULL""")
def recent_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    return valuation.recent_sales(view(spark, sf_dir, "ppd"), "postcode")


@query(with_sql("stock") + """
, p AS (SELECT *, CASE rent_period WHEN 'per_week' THEN floor(price_pence * 52 / 12) WHEN 'per_year' THEN floor(price_pence / 12) WHEN 'per_day' THEN floor(price_pence * 365 / 12) ELSE price_pence END AS pcm FROM stock)
SELECT branch, count(*) FILTER (WHERE transaction = 'sale') AS for_sale, count(*) FILTER (WHERE transaction = 'rent') AS to_rent, count(*) AS total,
  CAST(floor(median(price_pence) FILTER (WHERE transaction = 'sale')) AS BIGINT) AS median_price_pence, CAST(floor(median(pcm) FILTER (WHERE transaction = 'rent')) AS BIGINT) AS median_rent_pcm_pence FROM p GROUP BY branch""")
def branch_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10, A33."""
    return valuation.stock_summary(view(spark, sf_dir, "stock"))
