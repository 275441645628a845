"""Quality rules judged for whole hosts: failures by host, shrunk by an empirical beta prior, joined back to documents.

Each text is measured once (words, symbols, repeated lines, repeated three-word windows). A document fails if any rule
fails; hosts sum documents and failures; a beta prior fitted to all hosts by the method of moments shrinks each host's
failure rate, so that a host of three bad pages isn't judged like one of three million. Documents of a host whose
shrunk rate exceeds ``max_rate`` are rejected, and so is every document that fails a base rule itself.

Defined results: null and empty texts have no words and fail; null hosts are one host of their own; repeated rows each
count; empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import stage

_SYMBOLS = spans.byte_set(b"#*$%&|<>")
_DOC = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether an equal one comes before it in its text (any one counts as first), and how many equal ones its text has."""
    _, first, back, count = np.unique(spans.mix(h + doc.astype(np.uint64) * _DOC), return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(h), bool)
    later[first] = False
    return later, count[back]


def measure(c: spans.Chunk) -> list[np.ndarray]:
    """The five counts of every text of a chunk."""
    inside = spans.NOT_SPACE[c.data]
    s, e = c.runs(inside)
    at = c.offsets(s)
    n_words = np.diff(at)
    word_chars = c.sums(inside & ((c.data & 0xC0) != 0x80))
    n_symbols = c.sums(_SYMBOLS[c.data])
    stop = np.flatnonzero(c.data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    held = np.concatenate([[0], np.cumsum(inside)])
    full = held[stop] > held[start]
    start, stop = start[full], stop[full]
    doc = np.searchsorted(c.start, start, "right") - 1
    later, _ = _per_text(c.hashes(start, stop), doc)
    n_dup = np.bincount(doc[later], minlength=c.n)
    w, first = spans.windows(c.hashes(s, e), at, 3)
    _, count = _per_text(w, np.searchsorted(at, first, "right") - 1)
    edge = np.zeros(len(s) + 1, np.int64)
    again = first[count >= 2]
    edge += np.bincount(again, minlength=len(edge))
    edge -= np.bincount(again + 3, minlength=len(edge))
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return [n_words, word_chars, n_symbols, n_dup, covered[at[1:]] - covered[at[:-1]]]


def text_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in spans.chunks(batch.column(2)):
                part = batch.slice(c.lo, c.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in measure(c))], ["doc_id", "host", *_COUNTS])

    kinds = [f"{n} {docs.schema[n].dataType.simpleString()}" for n in ("doc_id", "host")]
    return docs.mapInArrow(scan, ", ".join([*kinds, *(f"{n} long" for n in _COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """All rules that count against a host; the first two are the base rules."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters of the hosts' failure rates by the method of moments, from one aggregated row."""
    x = hosts.agg(F.count("*").alias("k"), F.sum("docs").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("docs")).alias("ff"), F.sum(F.col("docs").cast("double") * F.col("docs")).alias("nn")).first()
    if not x["n"]:
        return 0.5, 0.5
    m = x["f"] / x["n"]
    spread = x["ff"] - x["n"] * m * m - (x["k"] - 1) * m * (1 - m)
    weight = x["n"] - x["nn"] / x["n"]
    v = spread / weight if weight > 0 else 0.0
    strength = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
    return m * strength, (1 - m) * strength


def host_verdicts(counts: DataFrame, *, max_rate: float = 0.5) -> DataFrame:
    """host, docs, failed, rate (shrunk) and rejected, and how often each rule failed."""
    each = rules()
    any_failed = F.lit(False)
    for c in each.values():
        any_failed = any_failed | c
    hosts = stage(counts.groupBy("host").agg(F.count("*").alias("docs"), F.count_if(any_failed).alias("failed"), *(F.count_if(c).alias(f"failed_{k}") for k, c in each.items())), "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def apply_rules(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rejected and kept, one row per document.

    The counts are staged, so texts are read once; only rejected hosts are joined back, by a null-safe outer join that
    splits a hot host's rows over tasks.
    """
    counts = stage(text_counts(documents, id_col=id_col, text_col=text_col, host_col=host_col), "counts")
    bad = host_verdicts(counts, max_rate=max_rate).filter("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected"))
    out = counts.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select("doc_id", "host", *_COUNTS, base_failed().alias("base_failed"), "host_rejected", (~base_failed() & ~F.col("host_rejected")).alias("kept"))
