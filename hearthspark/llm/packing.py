"""Packing by power-of-two decomposition: documents are cut into pieces of binary length, one piece a sequence.

A document of n tokens gives n // 1024 pieces of 1024 and one piece for each set bit of n % 1024, longest first. Every
piece is a sequence of its own whose length is a power of two, so that no sequence crosses documents and none needs
padding; sequences of equal length form one bucket, from which batches of one shape are drawn.

Sequence ids are bucket-major: all sequences of 2**b tokens have ids from b * 2**56 on. Within a bucket, ids follow
the position of the row in the scan, so a task that is run again gives the same ids; they are unique, not gapless.

Defined results: a null or empty text is the end token alone (one piece of length 1). Repeated rows give repeated
pieces, each in its own sequence. Empty tables give no pieces. Other columns are never read.

Token ids are those of the ``tokenizers`` file named by ``tokenizer_path``; a table of whole words seen before saves
most of the byte-pair merges. The table is emptied when it is full, which changes time only.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 1024
_BUCKET_BITS = 56
#: How byte-level BPE cuts texts before merging (fixed value of the published tokenizer).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between white space and white space (or the end): there the tokenizer's pieces don't start at each space.
_IRREGULAR = re.compile(r"\s (?:\s|\Z)")


class _Words(dict):
    """Token ids, as bytes, of a space and a word."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word[-1:] in (",", ".") and word[-2:-1].isalpha():  # a mark after a letter starts a piece of its own
            ids = self[word[:-1]] + np.array(self.encode(word[-1]), "<u4").tobytes()
        else:
            ids = np.array(self.encode(" " + word), "<u4").tobytes()
        self[word] = ids
        return ids


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token of a byte-level BPE file whose ids are the ranks of its merges; None for other files."""
    whole = json.loads(Path(path).read_text())
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    if whole.get("normalizer") or whole.get("post_processor") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None  # not the cutting that _PIECES does
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab = model["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    if model.get("type") != "BPE" or any(c not in vocab for c in byte) or [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merged)}


class Tokens:
    """Whole texts to little-endian unsigned 32-bit ids, exactly those of ``encode(text, add_special_tokens=False)``.

    A word that isn't in the table goes through ``tiktoken`` with the file's own vocabulary where the file is
    byte-level BPE (several times faster, the same ids; tests compare both), else through ``tokenizers``. Texts that
    hold the string of an added token, which ``tokenizers`` gives that token's id, always go through ``tokenizers``.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.ids = self.plain = lambda text: own.encode(text, add_special_tokens=False).ids
        ranks = _ranks(path)
        if ranks:
            import tiktoken

            self.ids = tiktoken.Encoding("from_file", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = [t.content for t in own.get_added_tokens_decoder().values()]
        self.by_word = ranks is not None
        self.words = _Words(self.ids, most)

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.plain(text), "<u4").tobytes()
        if not self.by_word or _IRREGULAR.search(text):
            return np.array(self.ids(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return np.array(self.ids(head), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def pieces(n: int, longest: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each binary-length piece of n tokens."""
    out = [(k * longest, longest) for k in range(n // longest)]
    at, bit = n - n % longest, longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(documents: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, longest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids_crc32 and, on request, ids."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                row, start, length, total, crc, ids = [], [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    data = tokens.encode(text or "") + end
                    n = len(data) // 4
                    for a, m in pieces(n, longest):
                        piece = data[4 * a : 4 * (a + m)]
                        row.append(k)
                        start.append(a)
                        length.append(m)
                        total.append(n)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc))]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    bucket = F.log2(F.col("length")).cast("int")
    return (
        out.withColumn("bucket", bucket)
        .withColumn("sequence_id", F.shiftleft(bucket.cast("long"), _BUCKET_BITS) + F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def write_sequences(packed: DataFrame, path: str) -> None:
    """One folder for each sequence length, from which batches of equal shape are read."""
    packed.write.partitionBy("bucket").parquet(path)
