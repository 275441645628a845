"""The listing feed on a stream against the batch diff, with late snapshots in several micro-batches."""

import datetime as dt
import random

import pytest

from hearthspark.operators import listings
from hearthspark.streaming import feeds, listing_feed

SCHEMA = "source_id string, event_id long, captured_at timestamp, price_pence long, features array<string>, status string, images int, description string, agent string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def feed(spark, folder, batches, *, late="30 hours", gone_hours):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    with listing_feed.rocks_state(spark):
        return feeds.run_once(listing_feed.changes(stream, late=late, gone_after_ms=gone_hours * 3_600_000), None, mode="append").collect()


def snapshots(n, seed):
    rng = random.Random(seed)
    out = []
    for e in range(n):
        at = START + dt.timedelta(hours=rng.randrange(24 * 12), microseconds=rng.randrange(10**6))
        out.append((f"s{rng.randrange(6)}", e, at, rng.choice([None, 100, 100, 200]), rng.choice([None, [], ["a"], ["a", "b", "a"]]), rng.choice([None, "active", "active", "sold_stc", "removed", "under_offer", "let"]), rng.choice([None, 3, 3, 4]), rng.choice([None, "x", "x", "y"]), rng.choice(["p", "p", "q"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_diff(spark, tmp_path, seed):
    rows = snapshots(120, seed)
    rng = random.Random(seed)
    rows.sort(key=lambda r: r[2] + dt.timedelta(hours=rng.randrange(24)))  # up to a day late
    size = len(rows) // 4
    batches = [rows[k * size : (k + 1) * size] for k in range(4)]
    mark = max(r[2] for b in batches for r in b) - dt.timedelta(hours=30)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
    got = feed(spark, tmp_path / "in", batches, gone_hours=10**6)
    due = [r for b in batches for r in b if r[2] <= mark]
    want = listings.changes(spark.createDataFrame(due, SCHEMA)).collect()
    fields = ("kind", "previous_price", "price_pence", "price_delta", "image_delta", "features_added", "features_removed")
    as_sets = lambda r: tuple(sorted(v) if isinstance(v, list) else v for v in (r[c] for c in fields))
    assert {r["event_id"]: as_sets(r) for r in got} == {r["event_id"]: as_sets(r) for r in want} and len(got) == len(want) > 60
    assert {r["event_id"]: set(r["changed"]) for r in got} == {r["event_id"]: set(r["field_changes"]) for r in want}


def test_deletions_and_late_rows(spark, tmp_path):
    def snap(e, hours, price=100, source="a"):
        return (source, e, START + dt.timedelta(hours=hours), price, None, "active", None, None, None)

    batches = [
        [snap(1, 0), snap(2, 10, 90), snap(20, 5, source="b")],
        [snap(3, 8, 95), snap(4, 200, 80), (None, 9, START, 1, None, None, None, None, None)],  # 3 is late, but not too late; b and a fall silent
        [snap(6, 205, 85), snap(4, 200, 80)],  # 4 comes again while it waits
        [snap(5, 20, 70)],  # later than the watermark
        [snap(99, 400, source="z")],
    ]
    got = feed(spark, tmp_path / "in", batches, late="30 hours", gone_hours=48)
    told = sorted((r["source_id"], r["captured_at"].replace(tzinfo=None), r["event_id"], r["kind"]) for r in got)
    assert [(s, e, k) for s, _, e, k in told] == [("a", 1, "new"), ("a", 3, "price_reduced"), ("a", 2, "deleted"), ("a", 2, "price_reduced"), ("a", 4, "new"), ("a", 6, "deleted"), ("a", 6, "price_increased"), ("b", 20, "deleted"), ("b", 20, "new")]


def test_every_kind():
    kinds = lambda **k: tuple(k.get(c) for c in listing_feed._NAMES)
    base = dict(price_pence=5, features=["a"], status="active", images=2, description="d", agent="g")
    cases = {
        "removed_sold_stc": ({"status": "sold_stc"}, {"status": "removed"}), "deleted": ({}, {"status": "removed"}), "sold_stc": ({}, {"status": "sold_stc", "price_pence": 1}), "under_offer": ({}, {"status": "under_offer"}), "back_on_market": ({"status": "removed"}, {}),
        "price_reduced": ({}, {"price_pence": 4, "images": 9}), "price_increased": ({}, {"price_pence": 6}), "feature_changed": ({}, {"features": ["b"], "images": 9}), "photos_added": ({}, {"images": 3}), "photos_removed": ({}, {"images": 1, "description": "e"}),
        "description_changed": ({}, {"description": "e"}), "agent_changed": ({}, {"agent": None}), "unchanged": ({"status": "let"}, {"status": "other"}),
    }
    for kind, (was, now) in cases.items():
        assert listing_feed.compare(kinds(**base | now), kinds(**base | was))["kind"] == kind
    assert listing_feed.compare(kinds(**base), None)["kind"] == "new"
