"""The change feed of listings on a stream: every kind of change between snapshots, in time order, and deletions.

Snapshots may come late and out of order: each waits in state until the watermark has passed its time, so a listing's
snapshots are compared in the order in which they were taken, whatever micro-batches brought them. A listing that has
not been seen for ``gone_after`` is deleted at that time: its state goes, and a later snapshot is new again. State is
one snapshot a listing that is alive, and the snapshots that are not older than the watermark. Listings share a fixed
number of states (buckets), each of which is read and written as a whole when a snapshot in it is due.

Defined results: snapshots later than the watermark are dropped; so are those without a source, a time or an event id;
ties in time go by event id; an event that comes again while it waits counts once; a null price, status or list is a
value like others and no change of price, status or features by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = "price_pence long, features array<string>, status string, images int, description string, agent string"
_NAMES = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]
_FOUND_TYPES = "previous_price long, price_delta long, features_added array<string>, features_removed array<string>, image_delta int, changed array<string>"
_FOUND = tuple(f.split(" ")[0] for f in _FOUND_TYPES.split(", "))
OUT = "source_id string, event_id long, at long, kind string, previous_price long, price_pence long, price_delta long, features_added array<string>, features_removed array<string>, image_delta int, changed array<string>"
_ROW = Row(*(f.split(" ")[0] for f in OUT.split(", ")))
# Fixed value: listings share this many states.
_BUCKETS = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


Snapshot = tuple  # price, features, status, images, description and agent, in the order of FIELDS


def compare(now: Snapshot, was: Snapshot | None) -> dict[str, Any]:
    """A snapshot against the one before it, if there is one: kind, deltas, features that came and went, and changed fields."""
    price, features, status, images, *texts = now
    if was is None:
        return {"kind": "new", "previous_price": None, "price_delta": None, "features_added": None if features is None else [], "features_removed": None if features is None else [], "image_delta": None, "changed": []}
    old_price, old_features, old_status, old_images, *old_texts = was
    minus = lambda x, y: None if x is None or y is None else x - y
    delta, image = minus(price, old_price), minus(images, old_images)
    before = features if old_features is None else old_features
    added, removed = (None, None) if features is None else ([x for x in dict.fromkeys(features) if x not in before], [x for x in dict.fromkeys(before) if x not in features])
    pairs = {"price_pence": (price, old_price), "status": (status, old_status), "images": (images, old_images), "description": (texts[0], old_texts[0]), "agent": (texts[1], old_texts[1])}
    changed = [name for name, (x, y) in pairs.items() if x != y]
    kind = None
    if status is not None and old_status is not None and status != old_status:
        kind = "removed_sold_stc" if status == "removed" and old_status == "sold_stc" else _OF_STATUS.get(status)
    if kind is None:
        rules = (("price_reduced", (delta or 0) < 0), ("price_increased", (delta or 0) > 0), ("feature_changed", added or removed), ("photos_added", (image or 0) > 0), ("photos_removed", (image or 0) < 0), ("description_changed", "description" in changed), ("agent_changed", "agent" in changed))
        kind = next((name for name, fits in rules if fits), "unchanged")
    return {"kind": kind, "previous_price": old_price, "price_delta": delta, "features_added": added, "features_removed": removed, "image_delta": image, "changed": changed}


#: Kinds of a change to a status; changes to other statuses are judged by what else changed.
_OF_STATUS = {"removed": "deleted", "sold_stc": "sold_stc", "under_offer": "under_offer", "active": "back_on_market"}


class Listings(StatefulProcessor):
    """The listings of one bucket: the last snapshot of each, and those that wait for the watermark.

    Every call of the state costs milliseconds, so each list is read and written once for all listings of a bucket.
    """

    def __init__(self, gone_after_ms: int):
        self.gone = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", f"source_id string, at long, event_id long, {FIELDS}, {_FOUND_TYPES}")
        self.waiting = handle.getListState("waiting", f"source_id string, at long, event_id long, {FIELDS}")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        new = [(r["source_id"], int(r["at"]), int(r["event_id"]), *_plain(tuple(r[c] for c in _NAMES))) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(x[1] for x in new) // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        """Each listing's snapshots that the watermark has passed, in time order; then its end, if that has passed too."""
        until = timerValues.getCurrentWatermarkInMs() * 1000
        came: dict[str, dict[tuple[int, int], Snapshot]] = {}
        for v in self.waiting.get():
            came.setdefault(v[0], {})[int(v[1]), int(v[2])] = _plain(tuple(v[3:]))  # the last of those that came again
        n, alive = 3 + len(_NAMES), {}
        for v in map(tuple, self.last.get()):
            alive[v[0]] = ((int(v[1]), int(v[2]), _plain(v[3:n])), dict(zip(_FOUND, (list(x) if isinstance(x, (list, tuple)) else x for x in v[n:]), strict=True)))
        out: list[Row] = []
        kept, later = [], []
        moved = False
        for source in sorted(came.keys() | alive.keys()):
            stored = alive.get(source, (None, None))
            snapshots = came.get(source, {})
            held = [(*k, snapshots[k]) for k in sorted(snapshots)]
            due = [x for x in held if x[0] <= until]
            later += [(source, x) for x in held[len(due) :]]
            before, shown = self._due(source, due, *stored, until, out)
            if before is not None:
                kept.append((source, before, shown))
            moved = moved or bool(due) or before != stored[0]
        if not moved:
            return
        for state, rows in ((self.waiting, [(s, *x[:2], *x[2]) for s, x in later]), (self.last, [(s, *x[:2], *x[2], *(shown[c] for c in _FOUND)) for s, x, shown in kept])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        following = [-(-x[0] // 1000) for _, x in later] + [-(-x[0] // 1000) + self.gone for _, x, _ in kept]
        if following:
            self.handle.registerTimer(min(following))
        yield from out

    def _due(self, source: str, due: list, before, shown, until: int, out: list[Row]) -> tuple:
        """What is known of a listing after the snapshots that are due; ``out`` gets their rows."""
        gone = self.gone * 1000

        def row(x, found) -> Row:
            return _ROW(source, x[1], x[0], found["kind"], found["previous_price"], x[2][0], *(found[c] for c in _FOUND[1:]))

        for x in due:
            if before is not None and x[0] - before[0] > gone:
                out.append(row(before, shown | {"kind": "deleted"}))
                before = None
            shown = compare(x[2], None if before is None else before[2])
            out.append(row(x, shown))
            before = x
        if before is not None and before[0] + gone <= until:
            out.append(row(before, shown | {"kind": "deleted"}))
            before = None
        return before, shown

    def close(self) -> None:
        pass


def _plain(value: tuple) -> tuple:
    """Values as the state's types."""
    price, features, status, images, description, agent = value
    return (None if price is None else int(price), None if features is None else [str(x) for x in features], status, None if images is None else int(images), description, agent)


def changes(snapshots: DataFrame, *, late: str, gone_after_ms: int) -> DataFrame:
    """The change feed of streaming snapshots (source_id, event_id, captured_at, price_pence, and any of features, status,
    images, description and agent): one row a snapshot, and one of kind ``deleted`` a listing that is gone.

    ``late`` is how far the watermark stays behind the newest snapshot.
    """
    kinds = dict(f.strip().split(" ") for f in FIELDS.split(", "))
    rows = snapshots.select(F.col("source_id").cast("string").alias("source_id"), F.col("event_id").cast("long").alias("event_id"), F.col("captured_at").cast("timestamp").alias("captured_at"), *((F.col(c) if c in snapshots.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _NAMES))
    rows = rows.filter("source_id is not null and event_id is not null and captured_at is not null").withWatermark("captured_at", late)
    rows = rows.withColumns({"at": F.unix_micros("captured_at"), "bucket": F.pmod(F.xxhash64("source_id"), F.lit(_BUCKETS))})
    found = rows.groupBy("bucket").transformWithState(Listings(gone_after_ms), OUT, "append", "EventTime")
    names = [f.split(" ")[0] for f in OUT.split(", ")]
    return found.select(*(F.timestamp_micros("at").alias("captured_at") if c == "at" else F.col(c) for c in names))


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
