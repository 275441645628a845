"""Listings: changes between snapshots, timelines, and first-seen pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fields whose change a snapshot diff reports, apart from price, features, images and status.
DIFFED = ("description", "agent")


def changes(snapshots: DataFrame, *, deleted_before: Column | None = None) -> DataFrame:
    """Each snapshot (source_id, captured_at, event_id, price_pence, features, status, and any of images, description and
    agent) against the one before it.

    Adds previous_price, price_delta, price_delta_pct (two decimals), features_added, features_removed, image_delta,
    status_changed, description_changed, agent_changed, field_changes (map of field to before and after) and kind, one of
    fourteen. With ``deleted_before``, a listing last seen earlier than that gets one more row of kind ``deleted``.
    """
    there = [c for c in DIFFED if c in snapshots.columns]
    own = snapshots if "images" in snapshots.columns else snapshots.withColumn("images", F.lit(None).cast("int"))
    w = Window.partitionBy("source_id").orderBy("captured_at", "event_id")
    seen = ["price_pence", "features", "status", "images", *there]
    before = own.withColumns({f"__{c}": F.lag(c).over(w) for c in seen} | {"__n": F.row_number().over(w), "__last": F.lead("event_id").over(w).isNull()})
    delta = F.col("price_pence") - F.col("__price_pence")
    old = F.coalesce("__features", F.col("features"))
    changed = lambda c: (F.col("__n") > 1) & ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    pair = lambda c: F.when(changed(c), F.struct(F.lit(c).alias("key"), F.struct(F.col(f"__{c}").cast("string").alias("before"), F.col(c).cast("string").alias("after")).alias("value")))
    out = before.withColumns({
        "previous_price": F.col("__price_pence"), "price_delta": delta, "price_delta_pct": F.when(F.col("__price_pence") != 0, F.bround(100.0 * delta / F.col("__price_pence"), 2)),
        "features_added": F.array_except("features", old), "features_removed": F.array_except(old, "features"), "image_delta": F.col("images") - F.col("__images"),
        "status_changed": F.coalesce(F.col("status") != F.col("__status"), F.lit(False)), "previous_status": F.col("__status"),
        **{f"{c}_changed": changed(c) if c in there else F.lit(False) for c in DIFFED},
        "field_changes": F.map_from_entries(F.filter(F.array(*(pair(c) for c in ["price_pence", "status", "images", *there])), lambda x: x.isNotNull())),
    })
    out = out.withColumn("kind", _kind())
    if deleted_before is not None:
        gone = out.filter(F.col("__last") & (F.col("captured_at") < deleted_before)).withColumn("kind", F.lit("deleted"))
        out = out.unionByName(gone)
    return out.drop("__n", "__last", *(f"__{c}" for c in seen), *([] if "images" in snapshots.columns else ["images"]))


def _kind() -> Column:
    """The first of the kinds that fits; a status outweighs a price, and that the fields of the page."""
    first, moved, status = F.col("__n") == 1, F.col("status_changed"), F.col("status")
    return (
        F.when(first, "new").when(moved & (status == "removed") & (F.col("previous_status") == "sold_stc"), "removed_sold_stc").when(moved & (status == "removed"), "deleted")
        .when(moved & (status == "sold_stc"), "sold_stc").when(moved & (status == "under_offer"), "under_offer").when(moved & (status == "active"), "back_on_market")
        .when(F.col("price_delta") < 0, "price_reduced").when(F.col("price_delta") > 0, "price_increased").when((F.size("features_added") > 0) | (F.size("features_removed") > 0), "feature_changed")
        .when(F.col("image_delta") > 0, "photos_added").when(F.col("image_delta") < 0, "photos_removed").when(F.col("description_changed"), "description_changed").when(F.col("agent_changed"), "agent_changed")
        .otherwise("unchanged")
    )


def with_listed_event(events: DataFrame, added: DataFrame) -> DataFrame:
    """Events (source_id, kind, occurred_on, price_pence) and a "listed" one, on the day a listing was added, for each listing that has none."""
    have = events.filter(F.col("kind") == "listed").select("source_id").distinct()
    more = added.filter(F.col("added_on").isNotNull()).join(have, "source_id", "left_anti")
    return events.unionByName(more.select("source_id", F.lit("listed").alias("kind"), F.col("added_on").alias("occurred_on"), F.lit(None).cast("long").alias("price_pence")))


def timeline(events: DataFrame) -> DataFrame:
    """Dated events with the change from the latest earlier event that has a price (stated changes stay)."""
    w = Window.partitionBy("source_id").orderBy("captured_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("price_pence", ignorenulls=True).over(w)
    return events.withColumn("__last", last).withColumns({"delta": F.coalesce(F.col("stated_delta"), F.col("price_pence") - F.col("__last")), "delta_pct": F.when(F.col("__last") != 0, F.bround(100.0 * (F.col("price_pence") - F.col("__last")) / F.col("__last"), 2))}).drop("__last")


def new_per_page(listings: DataFrame) -> DataFrame:
    """Listings first seen on each page of a crawl (source_id, page, position)."""
    first = listings.groupBy("source_id").agg(F.min(F.struct("page", "position")).alias("x"))
    return listings.select("page").distinct().join(first.groupBy(F.col("x.page").alias("page")).agg(F.count("*").alias("new")), "page", "left").withColumn("new", F.coalesce("new", F.lit(0)))


def best_image(images: DataFrame) -> DataFrame:
    """One url a picture: the original, else the largest, else a jpeg, else the first by name."""
    rank = F.struct(F.col("original").cast("int").alias("o"), (F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).alias("s"), F.lower("url").endswith(".jpg").cast("int").alias("j"), F.col("url"))
    return images.groupBy("listing", "picture").agg(F.max(rank).alias("x")).select("listing", "picture", F.col("x.url").alias("url"))


def search(listings: DataFrame, *, location: str | None = None, transaction: str | None = None, price: tuple[int | None, int | None] = (None, None), beds: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    out = listings
    if location:
        out = out.filter(F.lower("address").contains(location.lower()))
    if transaction:
        out = out.filter(F.col("transaction") == transaction)
    for column, (low, high) in (("price_pence", price), ("bedrooms", beds)):
        if low is not None:
            out = out.filter(F.col(column) >= low)
        if high is not None:
            out = out.filter(F.col(column) <= high)
    return out
