"""Fields of records as column expressions: coordinates in pages, leases, auction lots, station labels, tenders, companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

_NUMBER = r"-?\d+(?:\.\d+)?"
# Statuses of auction lots by phrase, tried in this order.
LOT_STATUSES = {"sold prior": "sold_prior", "sold": "sold", "withdrawn": "withdrawn", "postponed": "postponed", "unsold": "unsold", "under offer": "under_offer"}
# Exact statuses of lots in catalogue records.
RECORD_STATUSES = {"available": "available", "under offer": "under_offer", "sold prior": "sold_prior", "sold": "sold", "withdrawn": "withdrawn", "postponed": "postponed", "unsold": "unsold"}
# What a price field starts with if it holds a status instead.
STATUS_STARTS = {
    "sold prior": "sold_prior", "sold pre": "sold_prior", "sold post": "sold", "sold": "sold", "withdrawn": "withdrawn", "unsold": "unsold", "under offer": "under_offer", "postponed": "postponed",
    "for sale by auction": "available",
}
# Property types in auction bylines, tried in this order.
BYLINE_TYPES = {
    "terraced": "terraced", "end of terrace": "end_of_terrace", "end-of-terrace": "end_of_terrace", "semi-detached": "semi_detached", "semi detached": "semi_detached", "detached": "detached", "flat": "flat",
    "apartment": "apartment", "maisonette": "maisonette", "bungalow": "bungalow", "cottage": "cottage", "studio": "studio", "park home": "park_home", "land": "land", "commercial": "commercial",
}
# Signal labels of mobile carriers, and the carriers.
SIGNALS = {"green": "likely", "enhanced": "enhanced", "likely": "likely", "amber": "limited", "limited": "limited", "red": "none", "none": "none", "no": "none"}
CARRIERS = ("ee", "o2", "three", "vodafone")
# ISO codes of countries by name.
COUNTRIES = {
    "united kingdom": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "uk": "GB", "ireland": "IE", "france": "FR", "germany": "DE",
    "spain": "ES", "italy": "IT", "netherlands": "NL", "belgium": "BE", "portugal": "PT", "poland": "PL", "united states": "US", "usa": "US",
}
# Tender statuses of the two sources.
TENDER_STATUSES = {
    "contracts_finder": {"open": "open", "awarded": "awarded", "closed": "closed", "completed": "complete", "complete": "complete", "cancelled": "cancelled", "canceled": "cancelled", "withdrawn": "cancelled", "planned": "planned", "pipeline": "planned"},
    "find_a_tender": {"active": "open", "planning": "planned", "planned": "planned", "complete": "complete", "completed": "complete", "cancelled": "cancelled", "canceled": "cancelled", "withdrawn": "cancelled", "unsuccessful": "cancelled"},
}
# Kinds of timeline events by badge.
EVENT_KINDS = {
    "listed": "listed", "relisted": "relisted", "reduced": "reduced", "increased": "increased", "under offer": "under_offer", "sold stc": "sold_stc", "sold (stc)": "sold_stc",
    "sold subject to contract": "sold_stc", "sold": "sold", "let agreed": "let_agreed", "withdrawn": "withdrawn",
}


def mapped(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The value of a stripped, lower-case key in a small fixed table."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(t.strip(key)))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def _whole(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("long")


# pages


def coordinates_in_text(c: Column) -> Column:
    """struct<lat, lng>: the first pair inside the British Isles' box, or null. Four orders of keys are tried in turn, first
    on the text and then on the text with its escaped quotes plain."""

    def pairs(text: Column, first: str, second: str, swapped: bool) -> Column:
        pattern = rf'"{first}"\s*:\s*({_NUMBER})\s*,\s*"{second}"\s*:\s*({_NUMBER})'
        a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
        lat, lng = (b, a) if swapped else (a, b)
        both = F.zip_with(lat, lng, lambda y, x: F.struct(y.try_cast("double").alias("lat"), x.try_cast("double").alias("lng")))
        return F.get(F.filter(both, lambda p: p.getField("lat").between(49.0, 61.0) & p.getField("lng").between(-8.8, 2.1)), F.lit(0))

    orders = (("latitude", "longitude", False), ("longitude", "latitude", True), ("lat", "lo[nr]g?", False), ("lo[nr]g?", "lat", True))
    return F.coalesce(*(pairs(text, *o) for text in (c, F.replace(c, F.lit('\\"'), F.lit('"'))) for o in orders))


# leases

_LEASE = ("lease_length", "ground_rent", "service_charge", "review_date", "ground_rent_review", "review_period", "ground_rent_review_percentage", "lease_review_percentage")


def _pence_a_year(c: Column) -> Column:
    stated = F.regexp_extract(c, r"(?i)£\s*([\d,]+(?:\.\d+)?)\s*(?:per\s+annum|p\.?a\.?|per\s+year|/year|year|annual)", 1)
    any_sum = F.regexp_extract(c, r"£\s*([\d,]+(?:\.\d+)?)", 1)
    return F.bround(_number(F.coalesce(F.nullif(stated, F.lit("")), any_sum)) * 100, 0).cast("long")


def lease_terms(entries: Column) -> Column:
    """Lease economics of a map<string,string> of labelled texts; null if it has none of the keys."""
    e = lambda k: F.nullif(F.try_element_at(entries, F.lit(k)), F.lit(""))
    years, left = _whole(e("lease_length"), r"(?i)(\d{1,4})\s*(?:years?|yrs?)"), F.lower(e("lease_length")).rlike("remaining|left")
    review = F.coalesce(e("review_date"), e("ground_rent_review"), e("review_period"))
    share = F.coalesce(e("ground_rent_review_percentage"), e("lease_review_percentage"))
    terms = F.struct(
        F.when(left, years).alias("years_remaining"), F.when(~left, years).alias("length_years"), _pence_a_year(e("ground_rent")).alias("ground_rent_pence"), _pence_a_year(e("service_charge")).alias("service_charge_pence"),
        _whole(review, r"(?i)(\d{1,4})\s*(?:years?|yrs?)").alias("review_years"), F.regexp_extract(share, r"(\d{1,3}(?:\.\d+)?)\s*%", 1).try_cast("double").alias("review_pct"),
    )
    return F.when(F.coalesce(*map(e, _LEASE)).isNotNull(), terms)


def lease_of_costs(years: Column, ground_rent: Column, service_charge: Column, review_years: Column) -> Column:
    """Lease economics of typed fields in pounds; null if years, rent and charge are all null or zero."""
    some = F.coalesce(*(F.nullif(x.cast("double"), F.lit(0.0)) for x in (years, ground_rent, service_charge))).isNotNull()
    pence = lambda x: (x.cast("double") * 100).cast("long")
    return F.when(some, F.struct(years.cast("long").alias("years_remaining"), pence(ground_rent).alias("ground_rent_pence"), pence(service_charge).alias("service_charge_pence"), review_years.cast("long").alias("review_years")))


def lease_of_rows(rows: Column) -> Column:
    """struct<tenure, years_remaining, ground_rent_pence, service_charge_pence, review_years> of a map of label to text
    ("Tenure", "Ground rent", "Service charge"); null if all four numbers are."""
    e = lambda k: F.try_element_at(rows, F.lit(k))
    pounds = lambda c: _number(F.regexp_extract(c, r"(?i)£\s*([\d,]+)\s*per\s*annum", 1)).cast("long") * 100
    years = _whole(e("Tenure"), r"(?i)(\d+)\s*(?:yrs?|years?)\s*left")
    review = _whole(e("Ground rent"), r"(?i)review\s*period:\s*(?:every\s*)?(\d+)\s*(?:yrs?|years?)")
    numbers = {"years_remaining": years, "ground_rent_pence": pounds(e("Ground rent")), "service_charge_pence": pounds(e("Service charge")), "review_years": review}
    some = F.coalesce(*(F.nullif(x, F.lit(0)) for x in numbers.values())).isNotNull()
    return F.when(some, F.struct(t.tenure_in_text(F.coalesce(e("Tenure"), F.lit(""))).alias("tenure"), *(x.alias(k) for k, x in numbers.items())))


# auctions


def lot_status(c: Column) -> Column:
    """struct<status, sold_pence>: the first status phrase in a text, and the price it states if the lot is sold."""
    status = t.first_phrase(F.lower(F.coalesce(c, F.lit(""))), LOT_STATUSES.items(), "available")
    amount = _number(F.regexp_extract(c, r"£\s*([\d,]+(?:\.\d+)?)([KkMm])?", 1))
    unit = F.lower(F.regexp_extract(c, r"£\s*([\d,]+(?:\.\d+)?)([KkMm])?", 2))
    pence = F.bround(amount * F.when(unit == "k", 1e5).when(unit == "m", 1e8).otherwise(100.0), 0).cast("long")
    return F.struct(status.alias("status"), F.when(status.isin("sold", "sold_prior") & (amount > 0), pence).alias("sold_pence"))


def record_status(c: Column) -> Column:
    """The status of a catalogue record; unknown if it isn't one."""
    return mapped(c, RECORD_STATUSES, "unknown")


def reference_date(c: Column) -> Column:
    """The day in a reference like R260430 098; null if it has no six digits or no such day."""
    digits = F.regexp_replace(F.get(F.split(F.substring(c, 2, 1_000), " "), F.lit(0)), r"\D", "")
    return F.when(F.upper(F.left(c, F.lit(1))) == "R", F.when(F.length(digits) == 6, F.try_to_date(F.concat(F.lit("20"), digits), "yyyyMMdd")))


def london_date(epoch_ms: Column) -> Column:
    """The day in London of milliseconds since 1970."""
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=epoch_ms.cast("double") / 1000)
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), utc).cast("date")


def byline(c: Column) -> Column:
    """struct<bedrooms, property_type, raw> of a line like "3 bedroom semi-detached house"."""
    raw = t.strip(c)
    pattern = r"(?i)^(\d+)\s*bed(?:room)?s?\s+([A-Za-z \-]+?)$"
    kind = F.coalesce(F.nullif(F.regexp_extract(raw, pattern, 2), F.lit("")), raw)
    return F.struct(_whole(raw, pattern).cast("int").alias("bedrooms"), t.first_phrase(F.lower(F.coalesce(kind, F.lit(""))), BYLINE_TYPES.items(), "unknown").alias("property_type"), F.nullif(raw, F.lit("")).alias("raw"))


def sale_method(tags: Column) -> Column:
    """Of an array of struct<css, text>: modern, traditional or online_timed by the last tag that says so; else unknown."""

    def one(tag: Column) -> Column:
        css, text = F.lower(F.coalesce(tag.getField("css"), F.lit(""))), F.lower(F.coalesce(tag.getField("text"), F.lit("")))
        return F.when(css.contains("modern") | text.contains("modern method"), "modern").when(css.contains("traditional") | text.contains("traditional"), "traditional").when(text.contains("online"), "online_timed")

    return F.coalesce(F.get(F.reverse(F.filter(F.transform(tags, one), lambda x: x.isNotNull())), F.lit(0)), F.lit("unknown"))


def status_or_guide(c: Column) -> Column:
    """struct<status, low, high, qualifier> of a field that holds a status or a guide price; available without either."""
    return t.once(t.squeeze(F.coalesce(c, F.lit(""))), _status_or_guide)


def _status_or_guide(plain: Column) -> Column:
    status = F.lit(None).cast("string")
    for start, value in reversed(STATUS_STARTS.items()):
        status = F.when(F.lower(plain).startswith(start), F.lit(value)).otherwise(status)
    pattern = r"£\s*([\d,]+(?:\.\d+)?)(\+|[Kk]|[Mm])?"
    amounts, marks = (F.regexp_extract_all(plain, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pence = F.zip_with(amounts, marks, lambda a, u: F.bround(_number(a) * F.when(F.lower(u) == "k", 1e5).when(F.lower(u) == "m", 1e8).otherwise(100.0), 0).cast("long"))
    qualifier = (
        F.when(F.exists(marks, lambda m: m == "+"), "offers_in_excess_of").when(F.size(amounts) >= 2, "guide_price").when(plain.rlike(r"(?i)offers?\s+in\s+excess"), "offers_in_excess_of")
        .when(plain.rlike(r"(?i)offers?\s+over"), "offers_over").otherwise("guide_price")
    )
    guide = status.isNull() & (F.size(amounts) > 0)
    return F.struct(F.coalesce(status, F.lit("available")).alias("status"), F.when(guide, F.get(pence, F.lit(0))).alias("low"), F.when(guide, F.get(pence, F.lit(1))).alias("high"), F.when(guide, qualifier).alias("qualifier"))


def address_of(*parts: Column) -> Column:
    """struct<raw, postcode, outcode> of the parts that aren't blank; null without any."""
    raw = t.join_address(*parts)
    return F.when(raw.isNotNull(), F.struct(raw.alias("raw"), t.postcode_in_text(raw).alias("postcode"), t.outcode_in_text(raw).alias("outcode")))


# mobile signal and air quality


def carrier_signals(reception: Column) -> Column:
    """array<struct<carrier, level>> of a map of carrier to label; unknown labels are left out."""
    each = F.transform(F.array(*map(F.lit, CARRIERS)), lambda c: F.struct(c.alias("carrier"), mapped(F.try_element_at(reception, c), SIGNALS).alias("level")))
    return F.filter(each, lambda x: x.getField("level").isNotNull())


def site_of_label(c: Column) -> Column:
    """struct<site, pollutant> of a label "site-pollutant", both of which can have hyphens.

    The split is at the last hyphen whose tail is a known pollutant and starts with a capital or a digit, else at the last
    with a known pollutant, else at the first; without a hyphen all is the site.
    """
    pieces = F.split(c, "-")
    at = F.sequence(F.lit(1), F.size(pieces) - 1)
    cut = F.transform(at, lambda k: F.struct(F.array_join(F.slice(pieces, F.lit(1), k), "-").alias("head"), t.strip(F.array_join(F.slice(pieces, k + 1, F.size(pieces)), "-")).alias("tail")))
    known = F.reverse(F.filter(cut, lambda x: (x.getField("tail") != "") & (t.pollutant(x.getField("tail")) != "other")))
    best = F.coalesce(F.get(F.filter(known, lambda x: x.getField("tail").rlike(r"^[\p{Lu}\p{Nd}]")), F.lit(0)), F.get(known, F.lit(0)), F.get(cut, F.lit(0)))
    site = F.regexp_replace(best.getField("head"), r"[ -]+$", "")
    split = F.struct(F.coalesce(F.nullif(site, F.lit("")), c).alias("site"), F.nullif(best.getField("tail"), F.lit("")).alias("pollutant"))
    return F.when(c.contains("-"), split).when(c.isNotNull(), F.struct(c.alias("site"), F.lit(None).cast("string").alias("pollutant")))


# tenders


def country_iso(code: Column, name: Column) -> Column:
    """A code of two letters, else the code of a known name."""
    up = F.upper(t.strip(code))
    return F.coalesce(F.when(up.rlike("^[A-Z]{2}$"), up), mapped(name, COUNTRIES))


def tender_status(raw: Column, source: str) -> Column:
    """Statuses of ``contracts_finder`` or ``find_a_tender`` in one vocabulary; unknown for others."""
    return mapped(raw, TENDER_STATUSES[source], "unknown")


# companies


def controller_id(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, r"/persons-with-significant-control/[^/]+/([^/?#]+)", 1), F.lit(""))


def is_corporate(kind: Column) -> Column:
    """Whether a controller is a legal entity."""
    return F.coalesce(F.lower(kind).rlike("corporate|legal-person"), F.lit(False))


def controller_identity(link: Column, kind: Column, name: Column, registration: Column) -> Column:
    """A controller's id from its link, else the number of a corporate one, else a fingerprint of kind and name."""
    number = F.when(is_corporate(kind), F.nullif(t.strip(registration), F.lit("")))
    print_ = F.concat(F.lit("fp:"), F.lower(F.coalesce(kind, F.lit(""))), F.lit("|"), F.lower(t.strip(F.coalesce(name, F.lit("")))))
    return F.coalesce(controller_id(link), F.concat(F.lit("company:"), number), print_)


# listings


def event_kind(badge: Column) -> Column:
    return mapped(badge, EVENT_KINDS, "unknown")


def relative_event_kind(label: Column) -> Column:
    """The kind of an event known by a label such as "Reduced yesterday"; null for blank labels."""
    low = F.lower(label)
    kind = F.when(low.contains("reduced"), "reduced").when(low.contains("added") | low.contains("new"), "listed").when(low.contains("sold") & low.contains("stc"), "sold_stc").when(low.contains("under offer"), "under_offer").otherwise("unknown")
    return F.when(F.length(t.strip(label)) > 0, kind)


def price_of_listing(raw: Column, note: Column, pence: Column, transaction: Column) -> Column:
    """struct<is_rent, amount_pence, qualifier, period> of a listing's price text; null without text and amount."""
    both = F.lower(F.concat_ws(" ", F.nullif(raw, F.lit("")), F.nullif(note, F.lit(""))))
    found, period = t.price_qualifier(both), t.rent_period(F.coalesce(raw, F.lit("")))
    rent = (transaction == "rent") | (period != "unknown")
    shared = (transaction == "shared_ownership") | both.contains("shared ownership")
    qualifier = F.when(~F.coalesce(rent, F.lit(False)) & shared & (found == "unknown"), "shared_ownership_from").otherwise(found)
    priced = F.struct(F.coalesce(rent, F.lit(False)).alias("is_rent"), pence.alias("amount_pence"), qualifier.alias("qualifier"), F.when(rent, period).alias("period"))
    return F.when((F.length(F.coalesce(raw, F.lit(""))) > 0) | pence.isNotNull(), priced)
