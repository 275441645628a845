"""Helpers shared by the corpus operators: staged tables, bounded samples, default sessions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine a new local one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _staged[path] = spark
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one for files that aren't tables; ``release`` deletes it, or the end of the program."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _staged[path] = spark
    return path


def release(path: str) -> None:
    _delete(_staged.pop(path), path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; others are deleted when the program ends."""
    for table in tables:
        path = table.staged_at
        _delete(_staged.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_staged() -> None:
    for path, spark in _staged.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is already gone; the folder's owner clears it
            return


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0 of crc32 over an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col, F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, key: Column, n: int, by: str | None = None) -> list:
    """At most ``n`` rows (of each value of ``by``), chosen by the hash ``key`` and collected; each hash once a group.

    Copies count once: groups are sized by their distinct hashes, from a pre-aggregated count. A hash threshold then
    keeps a little over ``n`` expected hashes a group, so that neither the shuffle nor the driver sees a whole group;
    groups of which fewer than there could be come back are drawn again with a larger share.
    """
    df = df.withColumn("__h", F.xxhash64(key))
    unit = (F.col("__h").cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    group = F.col(by) if by else F.lit(0)
    counts = {r[0]: r[1] for r in df.groupBy("__h", group.alias("g")).agg(F.lit(1)).groupBy("g").count().collect()}
    share = {g: min(1.0, (1.2 * n + 50) / c) for g, c in counts.items()}
    out = []
    while share:
        keep = F.lit(False)
        for g, s in sorted(share.items(), key=lambda x: str(x[0])):
            keep = keep | (group.eqNullSafe(F.lit(g)) & (unit <= F.lit(s)))
        rows = df.filter(keep).dropDuplicates(["__h", by] if by else ["__h"]).collect()
        rows.sort(key=lambda r: r["__h"])
        taken: dict = {}
        for r in rows:
            taken.setdefault(r[by] if by else 0, []).append(r)
        short = {g: min(1.0, 2 * s) for g, s in share.items() if s < 1.0 and len(taken.get(g, ())) < min(n, counts[g])}
        for g, found in taken.items():
            if g not in short:
                out += found[:n]
        share = short
    return sorted(out, key=lambda r: r["__h"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, *, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels (0 or 1) of about ``n`` rows of each label at most, chosen by a hash of the id, staged.

    The labels' ids are thinned before they meet the documents, so the broadcast side has a bound whatever the size of
    the corpus, and the documents are scanned without a shuffle. Rows without a label, an id or a document don't count.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    unit = (F.xxhash64("id", F.lit(label)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    keep = F.lit(False)
    for y, c in sorted(counts.items()):
        keep = keep | ((F.col("label") == y) & (unit <= min(1.0, n / c)))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(docs.join(F.broadcast(known.filter(keep)), "id").select("text", "label"), "labelled")
