"""Registered queries over fields of records: texts with a known reading, dealt to the rows of ``part``.

Each field has texts in many spellings; row k gets the text k modulo their number, with ``{k}`` replaced by its key, and
the SQL says what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions import text as t
from ..session import tasks
from .queries import query

Field = tuple[Callable[[Column], Column], list[tuple[str | None, str | None]]]


def flat(c: Column, *fields: str) -> Column:
    """A struct as one text, its nulls as hyphens; null if the struct is."""
    text = lambda x: F.when(x.isNotNull(), F.concat_ws("|", *(F.coalesce(x.getField(f).cast("string"), F.lit("-")) for f in fields)))
    return t.once(c, text)


def as_map(c: Column) -> Column:
    return F.str_to_map(c, F.lit(";"), F.lit("="))


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''").replace("{k}", "' || CAST(p_partkey AS STRING) || '") + "'"


def _dealt(fields: dict[str, Field], which: int) -> str:
    cases = (f"CASE p_partkey % {len(rows)} " + " ".join(f"WHEN {i} THEN {_literal(row[which])}" for i, row in enumerate(rows)) + f" END AS {name}" for name, (_, rows) in fields.items())
    return "SELECT p_partkey, " + ",\n  ".join(cases) + " FROM part"


def _run(spark: SparkSession, sf_dir: str, fields: dict[str, Field]) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    # the work is in the fields and not in the bytes, so a small file isn't one long task
    part.repartition(tasks(part)).createOrReplaceTempView("part")
    texts = spark.sql(_dealt(fields, 0).replace("\\", "\\\\"))
    return texts.select("p_partkey", *(f(F.col(name)).cast("string").alias(name) for name, (f, _) in fields.items()))


_SCALARS: dict[str, Field] = {
    "postcode": (t.postcode_in_text, [("Flat 2, 1 High St, London sw1a 1aa", "SW1A 1AA"), ("near M1 1AE, Leeds", "M1 1AE"), ("no code here", None), (None, None)]),
    "outcode": (t.outcode_in_text, [("area LS6 only", "LS6"), ("EC1A 1BB", "EC1A"), ("none", None)]),
    "price": (t.safe_price, [("12.9", "12"), ("-4", "0"), ("junk", "0"), ("{k}", "{k}"), (None, "0")]),
    "whole": (t.safe_int, [("3", "3"), ("4.0", "4"), ("x", None), (None, None)]),
    "age": (t.normalise_age_band, [("England and Wales: 1900-1929", "1900_1929"), ("pre-1919", "PRE_1900"), ("1930-1949", "1930_1949"), ("2007 onwards", "POST_2002"), ("1978", "1976_1982"), ("", "UNKNOWN"), (None, "UNKNOWN")]),
    "sold_on": (t.sale_date, [("Wed, 14 Jan 2026", "2026-01-14"), ("14/01/2026", "2026-01-14"), ("2026-01-14", "2026-01-14"), ("soon", "soon")]),
    "planned_on": (t.planning_date, [("Wed 14 Jan 2026", "2026-01-14"), ("3 February 2026", "2026-02-03"), ("Unknown", None), ("N/A", None), ("14/01/2026", "2026-01-14")]),
    "number": (t.coerce_float, [("1,234.5", "1234.5"), (" 7 ", "7.0"), ("x", None)]),
    "clean": (t.placeholder_to_null, [("Unknown", None), ("n/a", None), ("Not Available", None), ("Granted {k}", "Granted {k}"), ("", None)]),
    "event_on": (t.timeline_date, [("13 February 2026", "2026-02-13"), ("February 2026", "2026-02-01"), ("later", None)]),
    "plan": (t.is_floor_plan, [("https://x.example/a_FLP_1.jpg", "true"), ("https://x.example/floor-plan/{k}", "true"), ("https://x.example/photo{k}.jpg", "false"), (None, "false")]),
    "url": (t.url_key, [("HTTPS://X.example/A?b=1#c", "https://x.example/a"), (" https://x.example/{k}#top ", "https://x.example/{k}")]),
    "guide": (lambda c: flat(t.guide_price(c), "low", "high", "qualifier"), [("£100,000 - £120,000", "10000000|12000000|guide_price"), ("£250,000+", "25000000|-|offers_in_excess_of"), ("TBA", "-|-|poa"), ("£90,000 - £80,000", "9000000|-|guide_price")]),
    "vacant": (t.vacant_possession, [("Vacant possession", "true"), ("Let on an assured shorthold tenancy", "false"), ("A house", None)]),
    "band": (t.council_tax_band, [("Council tax band: D", None), ("Band C, council {k}", "C"), ("band h", "H"), ("none", None)]),
    "epc": (lambda c: t.epc_band(F.split(c, ";")), [("Garden;EPC rating: C", "C"), ("EPC D;EPC A", "D"), ("Garage", None)]),
    "slug": (t.council_slug, [("City of York", "city-of-york"), ("  St. Helens ", "st-helens")]),
    "reference": (t.reference_slug, [("R260430 098", "r260430-098"), ("Lot {k}", "lot-{k}")]),
    "company": (t.company_number, [("/company/0{k}/officers", "0{k}"), ("/officers/1", None)]),
    "officer": (t.officer_id, [("/officers/o{k}/appointments", "o{k}"), ("/company/1", None)]),
    "pollutant": (t.pollutant, [("Particulate matter less than 10 micro m (aerosol)", "pm10"), ("Particulate matter less than 2.5 micro m (aerosol)", "pm25"), ("Nitrogen dioxide (air)", "no2"), ("Nitrogen oxides (air)", "nox"), ("Benzene (air)", "benzene"), ("Ethyl benzene (air)", "other"), ("Sulfur dioxide", "so2"), (None, "other")]),
}


def _scalar_sql() -> str:
    return _dealt(_SCALARS, 1)


@query(_scalar_sql())
def fields_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A14, A15, A17, A19, A20, A22, A23, A37, A39-A41, A43, A45, A49 (slugs), A51, A54-A57."""
    return _run(spark, sf_dir, _SCALARS)


def _tags(c: Column) -> Column:
    """Tags "css:text;css:text" as structs."""
    return F.transform(F.split(c, ";"), lambda x: F.struct(F.get(F.split(x, ":"), F.lit(0)).alias("css"), F.get(F.split(x, ":"), F.lit(1)).alias("text")))


def _lease(c: Column) -> Column:
    return flat(t.once(as_map(c), records.lease_terms), "years_remaining", "length_years", "ground_rent_pence", "service_charge_pence", "review_years", "review_pct")


def _costs(c: Column) -> Column:
    at = lambda i: F.get(F.split(c, ","), F.lit(i)).try_cast("double")
    return flat(records.lease_of_costs(at(0), at(1), at(2), at(3)), "years_remaining", "ground_rent_pence", "service_charge_pence", "review_years")


def _controller(c: Column) -> Column:
    at = lambda i: F.nullif(F.get(F.split(c, ","), F.lit(i)), F.lit("-"))
    return records.controller_identity(at(0), at(1), at(2), at(3))


def _listing_price(c: Column) -> Column:
    at = lambda i: F.nullif(F.get(F.split(c, ";"), F.lit(i)), F.lit("-"))
    return flat(records.price_of_listing(at(0), at(1), t.price_pence(at(0)), at(2)), "is_rent", "amount_pence", "qualifier", "period")


_RECORDS: dict[str, Field] = {
    "lease": (_lease, [
        ("lease_length=115 years remaining;ground_rent=£450 per annum;service_charge=£3,039 per annum;review_date=Every 10 years", "115|-|45000|303900|10|-"),
        ("lease_length=999 years;lease_review_percentage=2.5%", "-|999|-|-|-|2.5"), ("other=1", None), ("ground_rent=£250", "-|-|25000|-|-|-"),
    ]),
    "costs": (_costs, [("90,250,1200.5,10", "90|25000|120050|10"), ("0,0,0,5", None), ("99,,,", "99|-|-|-")]),
    "rows": (lambda c: flat(t.once(as_map(c), records.lease_of_rows), "tenure", "years_remaining", "ground_rent_pence", "service_charge_pence", "review_years"), [
        ("Tenure=Leasehold  |  115 yrs left;Ground rent=£100 per annum (review period: every 5 years)", "leasehold|115|10000|-|5"), ("Tenure=Freehold", None), ("Service charge=£1,200 per annum", "unknown|-|-|120000|-"),
    ]),
    "lot": (lambda c: flat(records.lot_status(c), "status", "sold_pence"), [("Sold for £250,000", "sold|25000000"), ("SOLD PRIOR £1.2m", "sold_prior|120000000"), ("Withdrawn", "withdrawn|-"), ("Guide £100,000", "available|-"), ("Postponed £5k", "postponed|-")]),
    "record_status": (records.record_status, [("Sold", "sold"), (" under offer ", "under_offer"), ("other", "unknown"), (None, "unknown")]),
    "reference_on": (records.reference_date, [("R260430 098", "2026-04-30"), ("r260431", None), ("X260430", None), ("R2604", None)]),
    "london_on": (lambda c: records.london_date(c.try_cast("long")), [("1777503600000", "2026-04-30"), ("1767225600000", "2026-01-01"), ("x", None)]),
    "byline": (lambda c: flat(records.byline(c), "bedrooms", "property_type", "raw"), [("3 bedroom semi-detached house", "3|semi_detached|3 bedroom semi-detached house"), ("1 bed flat", "1|flat|1 bed flat"), ("Land at Leeds", "-|land|Land at Leeds"), ("", "-|unknown|-")]),
    "method": (lambda c: records.sale_method(_tags(c)), [("tag-modern:x;tenure:freehold", "modern"), ("a:Traditional auction", "traditional"), ("a:online only", "online_timed"), ("a:b", "unknown"), ("a:traditional;b:modern method", "modern")]),
    "sale_tenure": (t.sale_tenure_tag, [("Share of freehold", "freehold"), ("Leasehold", "leasehold"), ("x", "unknown")]),
    "signal": (lambda c: F.array_join(F.transform(t.once(as_map(c), records.carrier_signals), lambda x: F.concat_ws("|", x.getField("carrier"), x.getField("level"))), ","), [("ee=green;o2=Amber;three=odd;vodafone=no", "ee|likely,o2|limited,vodafone|none"), ("x=green", "")]),
    "hybrid": (lambda c: flat(records.status_or_guide(c), "status", "low", "high", "qualifier"), [("Sold Prior", "sold_prior|-|-|-"), ("*Guide | £200,000+ (plus fees)", "available|20000000|-|offers_in_excess_of"), ("£150,000 - £175,000", "available|15000000|17500000|guide_price"), ("Offers over £1.5m", "available|150000000|-|offers_over"), ("For sale", "available|-|-|-")]),
    "address": (lambda c: flat(records.address_of(*(F.get(F.split(c, ";"), F.lit(i)) for i in range(3))), "raw", "postcode", "outcode"), [("1 High St; ;LS1 4AB", "1 High St, LS1 4AB|LS1 4AB|LS1"), (" ; ; ", None), ("{k} Low Rd;York;", "{k} Low Rd, York|-|-")]),
    "station": (lambda c: flat(records.site_of_label(c), "site", "pollutant"), [
        ("Aberdeen Erroll Park-Nitrogen dioxide (air)", "Aberdeen Erroll Park|Nitrogen dioxide (air)"), ("Stoke-on-Trent Centre-Carbon monoxide (air)", "Stoke-on-Trent Centre|Carbon monoxide (air)"),
        ("Site-Non-volatile PM10 (hourly)", "Site|Non-volatile PM10 (hourly)"), ("Plain {k}", "Plain {k}|-"), ("A-B-odd", "A|B-odd"),
    ]),
    "country": (lambda c: records.country_iso(F.get(F.split(c, ","), F.lit(0)), F.get(F.split(c, ","), F.lit(1))), [("gb,", "GB"), ("GBR,England", "GB"), (",Ireland", "IE"), ("1,Atlantis", None)]),
    "finder": (lambda c: records.tender_status(c, "contracts_finder"), [("Awarded", "awarded"), ("pipeline", "planned"), ("active", "unknown"), (None, "unknown")]),
    "tender": (lambda c: records.tender_status(c, "find_a_tender"), [(" Active ", "open"), ("unsuccessful", "cancelled"), ("open", "unknown")]),
    "controller": (_controller, [
        ("/company/1/persons-with-significant-control/individual/p{k},individual-person,A,-", "p{k}"), ("-,corporate-entity-person,B Ltd, 0{k} ", "company:0{k}"), ("-,individual-person, Ann {k} ,-", "fp:individual-person|ann {k}"), ("-,legal-person,Fund,-", "fp:legal-person|fund"),
    ]),
    "corporate": (records.is_corporate, [("corporate-entity-person-with-significant-control", "true"), ("Legal-Person", "true"), ("individual", "false"), ("super-secure-person", "false"), (None, "false")]),
    "event": (records.event_kind, [("Sold STC", "sold_stc"), (" reduced ", "reduced"), ("odd", "unknown")]),
    "relative": (records.relative_event_kind, [("Reduced yesterday", "reduced"), ("Added 3 days ago", "listed"), ("Sold STC", "sold_stc"), ("Under offer", "under_offer"), ("Odd", "unknown"), (" ", None)]),
    "asked": (_listing_price, [("£250,000;Guide price;sale", "false|25000000|guide_price|-"), ("£900 pcm;-;sale", "true|90000|unknown|per_month"), ("£800;-;rent", "true|80000|unknown|unknown"), ("£90,000;-;shared_ownership", "false|9000000|shared_ownership_from|-"), ("-;-;sale", None)]),
    "place": (lambda c: flat(records.coordinates_in_text(c), "lat", "lng"), [
        ('{"latitude":51.5,"longitude":-0.12}', "51.5|-0.12"), ('x "lng":-1.5 "lon": -1.25, "lat": 53.5', "53.5|-1.25"), ('{\\"longitude\\":-0.1,\\"latitude\\":52.5}', "52.5|-0.1"), ('"lat":0.0,"lon":0.0 "lat":52.25,"lon":-0.5', "52.25|-0.5"), ("none", None),
    ]),
}


@query(_dealt(_RECORDS, 1))
def fields_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A36, A38, A42, A44, A46-A48, A51-A53, A58-A63, L5, L8."""
    return _run(spark, sf_dir, _RECORDS)
