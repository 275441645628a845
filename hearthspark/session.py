"""Sessions, and shipping this package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **conf}
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="hearthspark-"), "hearthspark.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of ``checkpoint()``: the one the cluster names in ``spark.checkpoint.dir``; on one machine a new local one will do."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def staged(df: DataFrame, *, freed: bool = False) -> DataFrame:
    """``df`` written to the shared folder as a table and read back: like ``checkpoint()``, but compressed and read by column.

    ``freed``: shuffle files of the write go when it ends, and not when the driver happens to collect its garbage.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_checkpoints(spark).rstrip('/')}/staged-{uuid.uuid4().hex}", spark.conf.get(key)
    spark.conf.set(key, freed or before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """How many tasks share the work on small rows that meet many others, or cost much each: bytes alone would put them into a few.

    Not the number of shuffle partitions itself: Spark takes out a repartition that its input seems to have already.
    """
    spark = df.sparkSession
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
