"""Registers: tenders from nested JSON, planning applications, auction lots and council-tax bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions import text as t
from ..session import tasks

#: Releases of the open contracting data standard, as far as the operators read them.
RELEASE = (
    "ocid string, id string, date string, parties array<struct<id:string,name:string,address:struct<region:string,postalCode:string>>>, buyer struct<id:string,name:string>, "
    "tender struct<title:string,description:string,status:string,value:struct<amount:double,currency:string>,classification:struct<scheme:string,id:string>,additionalClassifications:array<struct<scheme:string,id:string>>,items:array<struct<deliveryAddresses:array<struct<region:string>>>>,documents:array<struct<documentType:string,url:string>>>, "
    "awards array<struct<value:struct<amount:double>,suppliers:array<struct<id:string,name:string>>>>, tag array<string>"
)


def tenders(releases: DataFrame, *, column: str = "json", base_url: str = "") -> DataFrame:
    """One row a release (JSON text): value, buyer, suppliers, classifications, region and url resolved."""
    # exploding one element keeps filters above the parse, which would else be repeated in each of them
    r = releases.select("*", F.explode(F.array(F.from_json(column, RELEASE))).alias("r"))
    party = lambda i: F.get(F.filter("r.parties", lambda p: p.getField("id") == i), F.lit(0))
    awarded = F.get(F.filter("r.awards", lambda a: a.getField("value").getField("amount").isNotNull()), F.lit(0))
    flat = F.flatten(F.filter(F.transform("r.awards", lambda a: a.getField("suppliers")), lambda x: x.isNotNull()))
    # one pass: a map from id (else name) to the first supplier that has it
    pairs = F.transform(flat, lambda s: F.struct(F.coalesce(s.getField("id"), s.getField("name")).alias("key"), s.alias("value")))
    first = F.aggregate(F.filter(pairs, lambda p: p.getField("key").isNotNull()), F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<struct<id:string,name:string>>").alias("values")), lambda s, p: F.when(F.array_contains(s.getField("keys"), p.getField("key")), s).otherwise(F.struct(F.array_append(s.getField("keys"), p.getField("key")).alias("keys"), F.array_append(s.getField("values"), p.getField("value")).alias("values"))))
    suppliers = first.getField("values")
    main = F.when(F.col("r.tender.classification.id").isNotNull(), F.array("r.tender.classification")).otherwise(F.array().cast("array<struct<scheme:string,id:string>>"))
    codes = F.transform(F.concat(main, F.coalesce("r.tender.additionalClassifications", F.array().cast("array<struct<scheme:string,id:string>>"))), lambda c: F.struct(F.upper(F.coalesce(c.getField("scheme"), F.lit("CPV"))).alias("scheme"), c.getField("id").alias("id")))
    places = F.flatten(F.filter(F.transform("r.tender.items", lambda i: i.getField("deliveryAddresses")), lambda x: x.isNotNull()))
    region = F.get(F.filter(F.transform(places, lambda a: a.getField("region")), lambda x: x.isNotNull()), F.lit(0))
    url = lambda ok: F.get(F.filter("r.tender.documents", ok), F.lit(0)).getField("url")
    return r.select(
        F.col("r.ocid").alias("ocid"), F.col("r.tender.title").alias("title"), F.col("r.tender.description").alias("description"), records.tender_status(F.col("r.tender.status"), "find_a_tender").alias("status"), t.iso_timestamp(F.col("r.date")).cast("date").alias("published"),
        F.coalesce(party(F.col("r.buyer.id")).getField("name"), F.col("r.buyer.name")).alias("buyer"), party(F.col("r.buyer.id")).getField("address").getField("region").alias("buyer_region"),
        F.coalesce(awarded.getField("value").getField("amount"), F.col("r.tender.value.amount")).alias("amount"), suppliers.alias("suppliers"), codes.alias("classifications"), region.alias("region"),
        F.coalesce(url(lambda d: d.getField("documentType") == "tenderNotice"), url(lambda d: d.getField("url").isNotNull()), F.concat(F.lit(base_url), F.col("r.ocid"))).alias("url"),
    )


def has_code(classifications: Column, code: str, *, prefix: bool = False) -> Column:
    """Whether any CPV classification is ``code``, or starts with it as given."""
    same = (lambda c: c.getField("id").startswith(code)) if prefix else (lambda c: c.getField("id") == code)
    return F.exists(classifications, lambda c: (c.getField("scheme") == "CPV") & same(c))


#: Notices of the other register, as far as the operators read them: keys begin with a capital or not, by the notice's age.
def notices(rows: DataFrame, *, column: str = "json") -> DataFrame:
    """One row a notice (JSON text of any of its generations) in the columns of ``tenders``, with amount_low and amount_high.

    Values are the awarded one, and the range; codes come as one text, a list of texts or a list of objects; the buyer as an
    object or in flat fields.
    """
    n = rows.withColumn("v", F.try_parse_json(F.col(column))).filter("v is not null")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)

    def pick(key: str, kind: str = "string") -> Column:
        return F.coalesce(get(f"$.{key}", kind), get(f"$.{key[0].lower()}{key[1:]}", kind))

    texts, objects = pick("CpvCodes", "array<string>"), pick("CpvCodes", "array<map<string,string>>")
    one = F.split(t.squeeze(get("$.cpvCodes")), " ")
    listed = F.coalesce(F.when(get("$.cpvCodes[0]").isNull() & get("$.CpvCodes[0]").isNull(), one), F.when(F.exists(texts, lambda x: x.startswith("{")), F.transform(objects, lambda o: F.coalesce(F.try_element_at(o, F.lit("code")), F.try_element_at(o, F.lit("Code")), F.try_element_at(o, F.lit("id"))))), texts, F.array().cast("array<string>"))
    codes = F.transform(F.filter(F.transform(listed, lambda x: t.strip(x)), lambda x: F.length(x) > 0), lambda x: F.struct(F.lit("CPV").alias("scheme"), x.alias("id")))
    name = F.coalesce(get("$.Organisation.Name"), get("$.Organisation.name"), get("$.organisation.Name"), get("$.organisation.name"), pick("OrganisationName"))
    low, high, awarded = (pick(k, "double") for k in ("ValueLow", "ValueHigh", "AwardedValue"))
    return n.select(
        F.coalesce(pick("Id"), pick("NoticeIdentifier")).alias("ocid"), pick("Title").alias("title"), pick("Description").alias("description"), records.tender_status(F.coalesce(pick("Status"), pick("NoticeStatus")), "contracts_finder").alias("status"),
        t.iso_timestamp(F.coalesce(pick("PublishedDate"), pick("PublishedOn"))).cast("date").alias("published"), F.nullif(t.strip(name), F.lit("")).alias("buyer"), F.coalesce(pick("RegionText"), pick("Region")).alias("region"), pick("NoticeType").alias("notice_type"),
        awarded.alias("amount"), low.alias("amount_low"), high.alias("amount_high"), codes.alias("classifications"), F.lit("contracts_finder").alias("source"),
    )


def all_tenders(releases: DataFrame, notice_rows: DataFrame, *, base_url: str = "") -> DataFrame:
    """Both registers in one schema; what one of them lacks is null."""
    one = tenders(releases, base_url=base_url).withColumn("source", F.lit("find_a_tender"))
    return one.unionByName(notices(notice_rows), allowMissingColumns=True)


def search_tenders(rows: DataFrame, *, keyword: str | None = None, codes: tuple[str, ...] = (), prefix: bool = False, regions: tuple[str, ...] = (), statuses: tuple[str, ...] = (), kinds: tuple[str, ...] = (), published: tuple[str | None, str | None] = (None, None), low: float | None = None, high: float | None = None, limit: int | None = None) -> DataFrame:
    """Tenders by all of: keyword in title or description, any CPV code (or its prefix), region of the buyer or the place,
    status, kind of notice, days of publication (both included), and value.

    A row without an amount is measured by the top of its range against ``low`` and by the bottom against ``high``.
    """
    out = rows
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    if keyword:
        out = out.filter(F.lower(F.concat_ws(" ", "title", "description")).contains(keyword.lower()))
    if codes:
        hit = F.lit(False)
        for c in codes:
            hit = hit | has_code(F.col("classifications"), c, prefix=prefix)
        out = out.filter(hit)
    if regions:
        out = out.filter(F.coalesce(has("buyer_region").isin(*regions), F.lit(False)) | F.coalesce(F.col("region").isin(*regions), F.lit(False)))
    if statuses:
        out = out.filter(F.col("status").isin(*statuses))
    if kinds:
        out = out.filter(has("notice_type").isin(*kinds))
    if published[0]:
        out = out.filter(F.col("published") >= F.lit(published[0]).cast("date"))
    if published[1]:
        out = out.filter(F.col("published") <= F.lit(published[1]).cast("date"))
    if low is not None:
        out = out.filter(F.coalesce(F.col("amount"), has("amount_high").cast("double")) >= low)
    if high is not None:
        out = out.filter(F.coalesce(F.col("amount"), has("amount_low").cast("double")) <= high)
    return out.orderBy(F.col("published").desc_nulls_last(), "ocid").limit(limit) if limit else out


def facets(rows: DataFrame) -> DataFrame:
    """How many tenders each region, kind of notice and status has, in one pass: facet, value and n."""
    names = ("region", "notice_type", "status")
    counts = rows.groupingSets([[c] for c in names], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # grouping_id has a bit for each column that a row is summed over
    facet = F.when(F.col("g") == 3, "region").when(F.col("g") == 5, "notice_type").otherwise("status")
    return counts.select(facet.alias("facet"), F.when(facet == "region", F.col("region")).when(facet == "notice_type", F.col("notice_type")).otherwise(F.col("status")).alias("value"), "n")


def union_schemas(*tables: DataFrame) -> DataFrame:
    """All rows in one schema; columns that a table lacks are null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def applications(rows: DataFrame, *, visible_only: bool = True, since: Column | None = None, text: str | None = None, box: tuple[float, float, float, float] | None = None, limit: int | None = None) -> DataFrame:
    """Planning applications by visibility, change date, text in address or description (case as stored) and box; counting them is ``count()``."""
    out = rows.filter("visible") if visible_only else rows
    if since is not None:
        out = out.filter(F.col("last_modified") > since)
    if text:
        out = out.filter(F.col("address").contains(text) | F.col("description").contains(text))
    if box:
        out = out.filter(F.col("lat").between(box[0], box[2]) & F.col("lng").between(box[1], box[3]))
    return out.orderBy(F.col("last_modified").desc_nulls_last(), "reference").limit(limit) if limit else out


def application_by_key(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The application of each wanted reference or key_val, visible or not."""
    return wanted.select(key).distinct().join(rows, key)


def applications_by_council(rows: DataFrame, since: Column) -> DataFrame:
    """How many visible applications each council has changed since a day, and the latest change."""
    return applications(rows, since=since).groupBy("council").agg(F.count("*").alias("applications"), F.max("last_modified").alias("latest"))


def meta_text(c: Column) -> Column:
    """map of "label: value | label: value", labels in lower case, values without white space around them; of a repeated label the last value holds."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda p: F.split(p, ":", 2)), lambda kv: F.size(kv) == 2)
    pairs = F.transform(parts, lambda kv: F.struct(F.lower(t.strip(F.get(kv, F.lit(0)))).alias("k"), t.strip(F.get(kv, F.lit(1))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.getField("k") == p.getField("k")))
    return F.map_from_entries(last)


def application_details(rows: DataFrame, *, column: str = "meta") -> DataFrame:
    """Typed columns of a detail text: status, dates (the decision day by the first of three labels that is set)."""
    m = rows.withColumn("__m", meta_text(F.col(column)))
    e = lambda k: t.placeholder_to_null(F.try_element_at("__m", F.lit(k)))
    decided = F.coalesce(*(t.planning_date(e(k)) for k in ("decision issued date", "decision made date", "decision date")))
    return m.withColumns({"status": e("status"), "received_on": t.planning_date(e("received")), "validated_on": t.planning_date(e("validated")), "decided_on": decided}).drop("__m")


def lots(rows: DataFrame, *, column: str = "json") -> DataFrame:
    """Auction lots of catalogue records (JSON text): reference and its slug, auction day, status, sold price, guide and address."""
    fields = "reference string, lot_number string, lot_status string, lot_type string, price double, sort_price double, guide_price_text string, auction_date long, address1 string, address2 string, town string, county string, postcode string"
    r = rows.withColumn("r", F.from_json(column, fields)).filter("r.reference is not null")
    parts = (F.col(f"r.{c}") for c in ("address1", "address2", "town", "county", "postcode"))
    r = r.withColumns({"status": records.record_status(F.col("r.lot_status")), "raw": t.join_address(*parts)})
    status, price = F.col("status"), t.first_positive(F.col("r.price"), F.col("r.sort_price"))
    return r.select(
        F.col("r.reference").alias("reference"), t.reference_slug(F.col("r.reference")).alias("slug"), F.col("r.lot_type").alias("lot_type"), F.coalesce(records.london_date(F.col("r.auction_date")), records.reference_date(F.col("r.reference"))).alias("auction_on"),
        status, F.when(status.isin("sold", "sold_prior"), F.bround(price * 100, 0).cast("long")).alias("sold_pence"), t.guide_price(F.col("r.guide_price_text")).alias("guide"),
        F.when(F.col("raw").isNotNull(), F.struct("raw", t.postcode_in_text(F.col("raw")).alias("postcode"), t.outcode_in_text(F.col("raw")).alias("outcode"))).alias("address"),
    )


def upcoming_auctions(residential: DataFrame, commercial: DataFrame, today: Column, *, lot_type: str | None = None) -> DataFrame:
    """Auctions (auction_id, auction_on) of both kinds from ``today`` on, of one lot type or both."""
    both = residential.withColumn("lot_type", F.lit("residential")).unionByName(commercial.withColumn("lot_type", F.lit("commercial")), allowMissingColumns=True)
    out = both.filter(F.col("auction_on") >= today)
    return out.filter(F.col("lot_type") == lot_type) if lot_type else out


#: In how many shares the targets of a postcode are dealt; each meets a copy of the postcode's bands.
_SHARES = 16


def council_tax(targets: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands of each target's postcode; Scottish postcodes have none here.

    Every target meets every band of its postcode, so the work is in the pairs and not in the bytes: targets are dealt
    over ``tasks`` by postcode and share, which splits a frequent postcode, and a small file isn't one long task.
    """
    own = F.when(~t.is_scottish(F.col("postcode")), t.normalise_postcode(F.col("postcode")))
    # exploding one element keeps the filter, and with it the normalising, above the repartition
    left = targets.repartition(tasks(targets)).withColumn("__pc", F.explode(F.array(own))).filter("__pc is not null")
    left = left.withColumn("__share", F.pmod(F.xxhash64(*targets.columns), F.lit(_SHARES)).cast("int")).repartition(tasks(targets), "__pc", "__share")
    right = bands.repartition(tasks(bands)).withColumn("__pc", F.explode(F.array(t.normalise_postcode(F.col("postcode"))))).select("__pc", F.upper("band").alias("band"), F.col("property_id").alias("band_property"), F.explode(F.array(*map(F.lit, range(_SHARES)))).alias("__share"))
    return left.join(right, ["__pc", "__share"]).drop("__pc", "__share")
