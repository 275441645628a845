"""Property tables derived from the driver's star-schema tables, in SQL that Spark and DuckDB both run.

Each lens is a SELECT; ``view(spark, sf_dir, name)`` is its DataFrame, ``with_sql(names)`` the same as SQL for an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

_POSTCODE = """CASE WHEN c_custkey % 97 = 5 THEN 'N/A'
       WHEN c_custkey % 3 = 0 THEN lower(substr('BCDEGHIKLMNPRSTWABCDEGHIK', 1 + c_nationkey, 1) || 'A' || CAST(1 + c_custkey % 9 AS STRING) || CAST(c_custkey % 10 AS STRING) || 'AB')
       ELSE substr('BCDEGHIKLMNPRSTWABCDEGHIK', 1 + c_nationkey, 1) || 'A' || CAST(1 + c_custkey % 9 AS STRING) || ' ' || CAST(c_custkey % 10 AS STRING) || 'AB' END"""

LENSES: dict[str, str] = {
    "ppd": f"""SELECT CAST(o_orderkey AS STRING) AS transaction_id, CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS transfer_date,
  substr('DSTFO', CAST(1 + o_orderkey % 5 AS INT), 1) AS property_type, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'L' END AS tenure,
  CAST(1 + o_custkey % 90 AS STRING) AS paon, c_mktsegment || ' Rd' AS street, {_POSTCODE} AS postcode, r_name AS region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "epc": f"""SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS lmk_key,
  CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(1 + o_custkey % 90 AS STRING) || ' ' END || c_mktsegment || ' Road, TOWN' AS address, {_POSTCODE} AS postcode,
  CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS inspection_date,
  CAST(CAST(30 + 2 * l_quantity AS INT) AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN ' m2' ELSE '' END AS total_floor_area,
  l_returnflag AS current_energy_rating, CAST(CAST(round(100 * (1 - l_discount)) AS INT) AS STRING) AS current_energy_efficiency
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "targets": f"""SELECT c_custkey AS property_id, {_POSTCODE} AS postcode, CASE WHEN c_custkey % 7 <> 0 THEN substr('DSTFO', CAST(1 + c_custkey % 5 AS INT), 1) END AS property_type FROM customer""",
    "hpi": """SELECT r_name AS region, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS month, round(avg(o_totalprice), 4) AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)""",
    "points": "SELECT c_custkey AS point_id, 50 + CAST((c_custkey * 37) % 8000 AS DOUBLE) / 1000 AS lat, -6 + CAST((c_custkey * 91) % 7500 AS DOUBLE) / 1000 AS lng FROM customer",
    "stops": "SELECT s_suppkey AS stop_id, s_name AS name, 50 + CAST((s_suppkey * 1373) % 8000 AS DOUBLE) / 1000 AS lat, -6 + CAST((s_suppkey * 719) % 7500 AS DOUBLE) / 1000 AS lng, s_nationkey % 7 AS stop_type FROM supplier",
    "zones": "SELECT n_nationkey AS zone_id, n_name AS name, 50 + (n_nationkey % 5) * 1.5 AS lat0, -6 + (n_nationkey / 5) * 1.4 AS lng0 FROM (SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation) z".replace("(n_nationkey / 5)", "floor(n_nationkey / 5)"),
    "crime": "SELECT event_id, CASE event_type WHEN 'error' THEN 'burglary' WHEN 'click' THEN 'violent-crime' WHEN 'purchase' THEN 'robbery' ELSE 'other-' || event_type END AS category, substr(CAST(ts AS STRING), 1, 10) AS day, user_id AS place FROM events",
    "snapshots": "SELECT event_id, user_id AS source_id, ts AS captured_at, CAST(floor(value * 100) AS BIGINT) AS price_pence, event_type AS feature, CASE WHEN event_id % 11 = 0 THEN 'removed' WHEN event_id % 7 = 0 THEN 'under_offer' ELSE 'active' END AS status FROM events",
    "appointments": "SELECT DISTINCT l_suppkey AS officer, l_partkey AS company, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS active FROM lineitem",
    "stock": "SELECT l_suppkey AS branch, CASE WHEN l_linenumber % 3 = 0 THEN 'rent' ELSE 'sale' END AS transaction, CASE l_linenumber % 4 WHEN 0 THEN 'per_week' WHEN 1 THEN 'per_month' WHEN 2 THEN 'per_year' ELSE 'per_day' END AS rent_period, CAST(floor(l_extendedprice * 100) AS BIGINT) AS price_pence FROM lineitem",
    "listing_text": """SELECT p_partkey, '£' || CAST(CAST(floor(p_retailprice) AS INT) AS STRING) || ',000' AS price_text,
  CASE p_partkey % 12 WHEN 0 THEN 'Guide Price' WHEN 1 THEN 'Offers in excess of' WHEN 2 THEN 'Offers in the region of' WHEN 3 THEN 'Offers over' WHEN 4 THEN 'OIEO' WHEN 5 THEN 'OIRO' WHEN 6 THEN 'From' WHEN 7 THEN 'Fixed price'
    WHEN 8 THEN 'Asking price' WHEN 9 THEN 'POA' WHEN 10 THEN 'Shared ownership from' ELSE 'plain' END AS qualifier_text,
  CASE p_partkey % 8 WHEN 0 THEN 'pcm' WHEN 1 THEN 'per week' WHEN 2 THEN 'per annum' WHEN 3 THEN 'a month' WHEN 4 THEN 'pw' WHEN 5 THEN 'per day' WHEN 6 THEN '/ week' ELSE 'once' END AS period_text,
  CASE p_partkey % 6 WHEN 0 THEN 'Semi-detached house' WHEN 1 THEN 'Detached bungalow' WHEN 2 THEN 'End of terrace' WHEN 3 THEN 'Top floor flat' WHEN 4 THEN 'Share of freehold studio' ELSE 'Leasehold ' || lower(p_type) END AS title,
  CASE p_partkey % 5 WHEN 0 THEN 'Reduced, no chain' WHEN 1 THEN 'NEW BUILD new home' WHEN 2 THEN 'auction of tenanted investment' WHEN 3 THEN 'virtual tour and 3D tour' ELSE '' END AS blurb,
  CASE p_partkey % 7 WHEN 0 THEN '1000 Mbps' WHEN 1 THEN '320Mbps' WHEN 2 THEN '30 mbps' WHEN 3 THEN '8 Mbps' ELSE '' END AS speed, CASE p_partkey % 4 WHEN 0 THEN 'FTTP' WHEN 1 THEN 'FTTC' WHEN 2 THEN 'ADSL' END AS technology,
  CASE p_partkey % 6 WHEN 0 THEN 'Good' WHEN 1 THEN 'Likely' WHEN 2 THEN 'patchy' WHEN 3 THEN 'No signal' WHEN 4 THEN 'Ask agent' ELSE 'eh' END AS mobile, p_size FROM part""",
}


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = BASE) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(LENSES[name])


def repeated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lens with its repeated rows, for operators that take each once themselves."""
    register(spark, sf_dir)
    return spark.sql(LENSES[name].replace("SELECT DISTINCT", "SELECT", 1))


def with_sql(*names: str) -> str:
    """WITH clause that defines the lenses for DuckDB; more common table expressions can follow after a comma."""
    return "WITH " + ",\n".join(f"{n} AS ({LENSES[n]})" for n in names)
