"""Rows from JSON records of public services: hazards, shoreline, planning entities, labour statistics, companies.

Every function takes a DataFrame with one record as JSON text in ``column``; what can't be read is null, and records
that aren't JSON go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions import text as t

# Shoreline policies; others count as unknown.
POLICIES = ("Hold The Line", "Advance The Line", "Managed Realignment", "No Active Intervention")


def _parsed(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("v", F.try_parse_json(F.col(column))).filter("v is not null")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _named(path: str) -> Column:
    """A text that isn't blank or UNKNOWN."""
    text = t.strip(_get(path))
    return F.when((text != "") & (F.upper(text) != "UNKNOWN"), text)


def landslides(rows: DataFrame, column: str = "json") -> DataFrame:
    """Landslides of a map service (attributes, geometry)."""
    return _parsed(rows, column).select(
        t.safe_int(_get("$.attributes.LS_ID")).alias("landslide_id"), _named("$.attributes.LANDSLIDE_NAME").alias("name"), _named("$.attributes.LOCALITY_DETAILS").alias("locality"),
        _named("$.attributes.FIRST_KNOWN_DATE_YEAR").alias("first_known_year"), t.coerce_float(_get("$.attributes.PLUS_OR_MINUS_METRES")).alias("uncertainty_m"), _get("$.geometry.y", "double").alias("lat"), _get("$.geometry.x", "double").alias("lng"),
    )


# Classes of the shrink-swell layers.
CLASSES = ("None", "Improbable", "Possible", "Probable")


def shrink_swell(rows: DataFrame, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Shrink-swell classes of a map service, with the columns to ``keep``; classes that aren't known are "Unknown"."""
    found = F.initcap(t.strip(_get("$.attributes.CLASS")))
    known = F.when(found.isin(*CLASSES), found).otherwise("Unknown")
    return _parsed(rows, column).select(*keep, known.alias("class"), _named("$.attributes.LEGEND").alias("legend"), _get("$.attributes.VERSION").alias("version"))


def shoreline(rows: DataFrame, scenario: str, horizon: int, uplift: int, column: str = "json") -> DataFrame:
    """Shoreline features: the predicted distance of one scenario (smp or nfi), horizon and uplift, policies and policy units."""
    policy = lambda key: F.when(F.length(t.strip(_get(key))) > 0, F.when(t.strip(_get(key)).isin(*POLICIES), t.strip(_get(key))).otherwise("unknown"))
    units = F.array_distinct(F.filter(F.array(*(F.nullif(t.strip(_get(f"$.properties.smp_pu{i}")), F.lit("")) for i in range(1, 6))), lambda x: x.isNotNull()))
    return _parsed(rows, column).select(
        _get("$.properties.frontageid").alias("frontage_id"), _get("$.properties.smp_name").alias("smp_name"), F.lit(scenario).alias("scenario"), F.lit(horizon).alias("horizon"), F.lit(uplift).alias("uplift"),
        t.coerce_float(_get(f"$.properties.{scenario}{horizon}_{uplift}")).alias("predicted_m"), policy("$.properties.mt_smp").alias("medium_policy"), policy("$.properties.lt_smp").alias("long_policy"), units.alias("policy_units"),
    )


def planning_entities(rows: DataFrame, column: str = "json") -> DataFrame:
    """Entities of a planning register: whole numbers given as texts are read, an empty geometry is null."""
    whole = lambda key: t.parse_int(_get(key))
    return _parsed(rows, column).select(whole("$.entity").alias("entity"), _get("$.name").alias("name"), _get("$.dataset").alias("dataset"), F.nullif(_get("$.geometry"), F.lit("")).alias("geometry"), whole("$['organisation-entity']").alias("organisation_entity"), _get("$.reference").alias("reference"), _get("$['entry-date']").try_cast("date").alias("entry_date"))


def observations(rows: DataFrame, column: str = "json") -> DataFrame:
    """Labour observations: the value as an object or a number, and the area's code and name."""
    value = F.coalesce(_get("$.obs_value.value"), _get("$.obs_value"))
    return _parsed(rows, column).select(t.coerce_float(value).alias("value"), _get("$.geography.geogcode").alias("area_code"), _get("$.geography.description").alias("area_name"))


def data_sets(rows: DataFrame, column: str = "json") -> DataFrame:
    """Catalogue entries whose name and description are a list of objects, an object or a text."""
    words = lambda key: F.coalesce(_get(f"$.{key}[0].value"), _get(f"$.{key}.value"), F.when(~F.coalesce(_get(f"$.{key}"), F.lit("")).rlike(r"^\s*[\[{]"), _get(f"$.{key}")))
    return _parsed(rows, column).select(_get("$.id").alias("id"), F.nullif(words("name"), F.lit("")).alias("name"), F.nullif(words("description"), F.lit("")).alias("description"))


def controllers(rows: DataFrame, company: str, column: str = "json") -> DataFrame:
    """Persons with control of the company in column ``company``: identity, kind, name, company number of corporate ones, and days."""
    number = F.when(records.is_corporate(_get("$.kind")), F.nullif(t.strip(_get("$.identification.registration_number")), F.lit("")))
    identity = records.controller_identity(_get("$.links.self"), _get("$.kind"), _get("$.name"), _get("$.identification.registration_number"))
    return _parsed(rows, column).select(F.col(company).alias("company"), identity.alias("identity"), _get("$.kind").alias("kind"), _get("$.name").alias("name"), number.alias("company_number"), _get("$.notified_on").alias("notified_on"), _get("$.ceased_on").alias("ceased_on"))


def officers(rows: DataFrame, company: str, column: str = "json") -> DataFrame:
    """Officers of the company in column ``company``; those without an id in their link go."""
    officer = t.officer_id(_get("$.links.officer.appointments"))
    return _parsed(rows, column).select(F.col(company).alias("company"), officer.alias("officer"), _get("$.name").alias("name"), _get("$.officer_role").alias("role"), _get("$.appointed_on").alias("appointed_on"), _get("$.resigned_on").alias("resigned_on")).filter("officer is not null")


def charges(rows: DataFrame, company: str, column: str = "json") -> DataFrame:
    """Charges on the company in column ``company``."""
    return _parsed(rows, column).select(F.col(company).alias("company"), _get("$.charge_code").alias("charge_code"), _get("$.status").alias("status"), _get("$.created_on").try_cast("date").alias("created_on"), _get("$.satisfied_on").try_cast("date").alias("satisfied_on"), _get("$.persons_entitled[0].name").alias("lender"))


def council_tax(rows: DataFrame, *, link: str = "link", title: str = "title", address: str = "address", band: str = "band") -> DataFrame:
    """Council-tax rows of text columns: the property's id from its link, the postcode from the title or address, the band in capitals; rows without id or band go."""
    property_id = F.nullif(F.regexp_extract(link, r"/property/([^/?#]+)", 1), F.lit(""))
    postcode = F.coalesce(t.postcode_in_text(F.col(title)), t.postcode_in_text(F.col(address)))
    out = rows.select(property_id.alias("property_id"), F.col(address).alias("address"), postcode.alias("postcode"), F.nullif(F.upper(t.strip(F.col(band))), F.lit("")).alias("band"))
    return out.filter("property_id is not null and band is not null")
