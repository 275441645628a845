"""Structured Streaming versions of the feeds: deduplicated ingest, windowed counts, latest readings, changes, upserts.

Every function takes a streaming DataFrame (some a static one too) and gives a streaming DataFrame, except ``upsert``
and ``run_once``, which start queries. State is bounded by watermarks or by one row a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import temporal
from ..session import shared_checkpoints


def since(stream: DataFrame, mark: Column, *, ts: str = "ts", key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Rows after the high-water mark, each key once within the watermark."""
    return stream.filter(F.col(ts) > mark).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, *, by: str, size: str, ts: str = "ts", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), by).agg(F.count("*").alias("n"), F.max(F.struct(ts, "value")).alias("last")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", F.col("last.value").alias("latest"))


def sessions(stream: DataFrame, *, by: str, gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")


def enrich(stream: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Stream-static left join."""
    return stream.join(static, keys, "left")


def adjusted(sales: DataFrame, index: DataFrame, *, price: str = "price", date: str = "transfer_date") -> DataFrame:
    """Streaming sales with adjusted_price, as ``temporal.adjust`` gives it: a range join with a table of index months.

    Each month of the index holds until the next one begins, so a sale meets one row of its region at most. The index is
    a table; a query that starts anew reads it anew. Negative prices raise.
    """
    month = t.month_key(F.col(date).cast("string"))
    spans = temporal.ranges(index).select(F.col("region").alias("__region"), F.col("month").alias("__from"), F.col("next_month").alias("__until"), F.col("value").alias("__index"))
    latest = index.groupBy(F.col("region").alias("__of")).agg(F.max_by("value", "month").alias("__to"), F.max("month").alias("__last"))
    dated = sales.withColumn("__month", month)
    holds = (F.col("region") == F.col("__region")) & (F.col("__month") >= F.col("__from")) & (F.col("__until").isNull() | (F.col("__month") < F.col("__until")))
    out = dated.join(spans, holds, "left").join(latest, F.col("region") == F.col("__of"), "left")
    own = F.when(F.col(price) < 0, F.raise_error(F.lit("negative price"))).otherwise(F.col(price))
    moved = F.bround(own * F.col("__to") / F.col("__index"), 0).cast("long")
    return out.withColumn("adjusted_price", F.coalesce(F.when(F.col("__month") <= F.col("__last"), moved), own.cast("long"))).select(*sales.columns, "adjusted_price")


def link(sales: DataFrame, certificates: DataFrame, *, days: int, late: str = "1 day") -> DataFrame:
    """Stream-stream interval join on ``key``: certificates within ``days`` of a sale; rank the pairs downstream."""
    s = sales.withWatermark("sale_ts", late).alias("s")
    c = certificates.withWatermark("inspected_ts", late).alias("c")
    near = F.expr(f"s.key = c.key AND c.inspected_ts BETWEEN s.sale_ts - INTERVAL {days} DAYS AND s.sale_ts + INTERVAL {days} DAYS")
    return s.join(c, near).select("s.key", "s.transaction_id", "s.sale_ts", "c.lmk_key", "c.inspected_ts")


def price_changes(stream: DataFrame, *, expire_ms: int | None = None) -> DataFrame:
    """Changes of each source's price between its snapshots in time order within a batch; one row of state a source.

    Snapshots without a price or source don't count. A source's rows of a batch are sorted and shifted as a frame; with
    ``expire_ms``, a source that has been silent for so long of processing time is forgotten and starts anew.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["captured_at", "event_id"])
        price = rows["price_pence"].astype("Int64")
        before = price.shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        kind = np.select([before.isna(), (price < before).fillna(False), (price > before).fillna(False)], ["new", "price_reduced", "price_increased"], "unchanged")
        state.update((int(price.iloc[-1]),))
        if expire_ms:
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({"source_id": key[0], "event_id": rows["event_id"].to_numpy(), "previous_price": before.to_numpy(), "price_pence": price.to_numpy(), "kind": kind}).astype({"previous_price": "Int64", "price_pence": "Int64"})

    known = stream.filter("price_pence is not null and source_id is not null").groupBy("source_id")
    return known.applyInPandasWithState(step, "source_id long, event_id long, previous_price long, price_pence long, kind string", "price long", "append", "ProcessingTimeTimeout" if expire_ms else "NoTimeout")


def upsert(stream: DataFrame, path: str, checkpoint: str, *, keys: list[str] | None = None, mode: str = "update"):
    """Start writing each batch into a table, once: a batch that is run again writes the same version again.

    With ``keys`` a version is the table after the batch: the batch's last row of each key and the rows of all other keys
    of the version before. Without, versions are the batches alone. Readers take ``current`` or all versions.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if keys:
            rows = batch.dropDuplicates(keys)
            before = _versions(batch.sparkSession, path, below=number)
            if before:
                old = batch.sparkSession.read.parquet(f"{path}/batch={before[-1]}")
                rows = rows.unionByName(old.join(rows.select(keys), keys, "left_anti"), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _versions(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """The numbers of the versions that were written as a whole, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath() for s in files.listStatus(root)]
    done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(n for n in done if below is None or n < below)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table written with keys; only that version is read."""
    return spark.read.parquet(f"{path}/batch={_versions(spark, path)[-1]}")


def closest(linked: DataFrame) -> DataFrame:
    """Of ``link``'s pairs, as a table: one certificate a sale, the nearest in time, then the smallest key."""
    gap = F.abs(F.unix_micros(F.col("inspected_ts").cast("timestamp")) - F.unix_micros(F.col("sale_ts").cast("timestamp")))
    return linked.groupBy("transaction_id").agg(F.min(F.struct(gap.alias("gap"), "lmk_key")).alias("x")).select("transaction_id", F.col("x.lmk_key").alias("lmk_key"))


def run_once(stream: DataFrame, keys: list[str] | None, *, mode: str = "update") -> DataFrame:
    """Drain a stream's present input into the shared folder and read what it gave."""
    spark = stream.sparkSession
    root = f"{shared_checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    query = upsert(stream, f"{root}/out", f"{root}/state", keys=keys, mode=mode)
    query.awaitTermination()
    if keys:
        return current(spark, f"{root}/out")
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*").drop("batch")
