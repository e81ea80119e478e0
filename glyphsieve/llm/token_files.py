"""Token-id files: length-delimited binary records with masked checksums, and a separate offset index.

A record, little-endian:
    u64 length of the payload | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | 0x0A
payload:
    u8 flags (1: doc_id is null) | u8 bytes per id (2 or 4) | i64 doc_id | u32 number of ids | ids
mask(c) = (c rotated right by 15 bits) + 0xA282EAD8, modulo 2**32 (fixed values of the well-known framing).
The end byte lets Spark's own committed line writer and any Hadoop file system hold the
files; readers go by the lengths alone. Files hold ascending doc_ids, file by file, and
are bounded in size. The index (Parquet) has file, offset, length, doc_id, start, n_tokens.

Edge cases: null text encodes as empty (only the end id); a null doc_id sorts first and is
flagged; repeated doc_ids give a record each, ordered by text hash. An empty table gives no
records. A text is held whole in its worker. Other columns, whatever their names, are not
read. A damaged record raises ValueError on reading.
"""

from __future__ import annotations

import contextlib
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from .common import mapped, new_path, written  # noqa: E402
from .pieces import Bounded, encoded, sized_batches  # noqa: E402

MODEL, END_ID = "word_bpe_49k.json", 1
#: Text bytes a file is planned for, least and most; ids of two bytes take less than that. Files grow with the square root of the input from GROWING bytes on.
FILE_BYTES, MOST_BYTES, GROWING = 16 << 20, 512 << 20, 1 << 36
#: Rows that the driver sees to find the files' limits, and how many of them a file has at least.
LIMIT_ROWS, FILE_ROWS = 2_000_000, 20
#: Entries of a worker's memo, and text bytes that are encoded at once.
MEMO, BATCH = 350_000, 8 << 20
HEAD, TAIL, FIXED = 12, 5, 14


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", mask(zlib.crc32(size))) + payload + struct.pack("<I", mask(zlib.crc32(payload))) + b"\n"


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BBqI", doc_id is None, width, doc_id or 0, len(ids) // width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, width, doc_id, n = struct.unpack_from("<BBqI", payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", n, FIXED)
    return None if null else doc_id, ids


def read_at(content, offset: int) -> tuple[bytes, int]:
    """The checked payload of the record at an offset, and the next record's offset."""
    size = bytes(content[offset : offset + 8])
    (n,) = struct.unpack("<Q", size)
    if struct.unpack_from("<I", content, offset + 8)[0] != mask(zlib.crc32(size)):
        raise ValueError(f"length damaged at {offset}")
    payload = bytes(content[offset + HEAD : offset + HEAD + n])
    if struct.unpack_from("<I", content, offset + HEAD + n)[0] != mask(zlib.crc32(payload)):
        raise ValueError(f"payload damaged at {offset}")
    return payload, offset + HEAD + n + TAIL


#: Two signs side by side, which the tokenizer would keep together.
_SIGNS = re.compile(r"[^\w\s](?=[^\w\s])")
#: A word of lower-case ASCII letters and the signs after it, which the tokenizer parts there.
_ENDED = re.compile(r"([a-z]+)([!-&(-/:-;=-@\[-^`{-~]+)")


def prepare(text: str) -> str:
    """Parts of a text that the tokenizer encodes alone, parted by spaces; '' may occur and means nothing.

    It drops white space before it splits, so spaces and line feeds always part. In Latin-1
    lower case and composition are by character; where no two signs touch, a full stop or
    comma is always a part of its own.
    """
    text = text.replace("\n", " ")
    if "<" not in text and (text.isascii() or max(text) < "\u0100"):
        text = text.lower()
        if not _SIGNS.search(text):
            text = text.replace(".", " .").replace(",", " ,")
    return text


class WordCache(Bounded):
    """Chunk to packed ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""}, MEMO)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

        # Words in lower case need no normaliser and no splitter but spaces.
        from tokenizers import pre_tokenizers

        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def make(self, chunk: str) -> bytes:
        ended = _ENDED.fullmatch(chunk)
        if ended:
            return self[ended[1]] + self[ended[2]]
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def prefetch(self, wanted: list[str]) -> None:
        """Words of letters alone are encoded many in one text, whose ids are cut apart after each that ends a word."""
        plain = [c for c in wanted if c not in self.old and len(c) <= self.chars and c.isalpha() and max(c) < "\u0100" and c == c.lower()]
        lines = [" ".join(plain[i : i + 200]) for i in range(0, len(plain), 200)]
        found = [np.array(e.ids, self.kind) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*found, np.empty(0, self.kind)])
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
        raw, at = ids.tobytes(), 0
        for c, end in zip(plain, cuts, strict=True):
            self[c] = raw[at:end]
            at = end


@lru_cache(maxsize=1)
def words(path: str) -> WordCache:
    return WordCache(path)


def file_bytes(total: int) -> int:
    """Text bytes a file is planned for, of so many in all."""
    return min(MOST_BYTES, FILE_BYTES * max(1, math.isqrt(total // GROWING)))


@contextlib.contextmanager
def limits_sampled(spark: SparkSession, parts: int) -> Iterator[None]:
    """Inside, range partitions are found from a bounded number of rows in all."""
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    held = spark.conf.get(key)
    spark.conf.set(key, str(max(FILE_ROWS, min(int(held), LIMIT_ROWS // parts))))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def write(docs: DataFrame, path: str, model_path: str, end_id: int = END_ID) -> None:
    """Record files of docs (doc_id, text) under path."""
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // file_bytes(total)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        cache = words(model_path).claim()
        end = end_id.to_bytes(cache.width, "little")
        for batch in sized_batches(batches, 1, BATCH):
            texts = [prepare(t or "") for t in batch.column(1).to_pylist()]
            ids, places = encoded(texts, cache.all, cache.kind)
            raw, at = memoryview(ids.tobytes()), (places * cache.width).tolist()
            out = [frame(pack(d, bytes(raw[a:b]) + end, cache.width)) for d, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # The line writer adds the end byte.
    lines = mapped(placed, run, "record binary", True).select(F.expr("substring(record, 1, length(record) - 1)").cast("string").alias("value"))
    with limits_sampled(docs.sparkSession, parts):
        # A file a partition, whatever the session says: readers number files by their partitions.
        lines.write.option("maxRecordsPerFile", 0).text(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Every record of the files, checked: file, offset, length, ids before it in the file, doc_id, n_tokens, ids_crc32 (and ids)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, at, within, rows = memoryview(content.as_buffer()), 0, 0, []
                number = int(re.search(r"part-(\d+)", name)[1])
                while at < len(content):
                    payload, after = read_at(content, at)
                    doc_id, found = unpack(payload)
                    wide = found.astype("<u4")
                    rows.append((number, at, after - at, within, doc_id, len(found), zlib.crc32(wide.tobytes()), wide if ids else None))
                    within += len(found)
                    at = after
                    if len(rows) >= 4096 or at >= len(content):
                        cols = list(zip(*rows, strict=True))
                        kinds = [pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64())]
                        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 7 + ids]
                        yield pa.RecordBatch.from_arrays(arrays, names=["file", "offset", "length", "within", "doc_id", "n_tokens", "ids_crc32", "ids"][: 7 + ids])
                        rows = []

    return mapped(files, run, "file int, offset bigint, length bigint, within bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the files: what read() gives, with the first id's place among all ids."""
    rows = written(read(spark, path), "token-index")
    # One row per file; sums before a file are added up in blocks of files, then over the blocks.
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    block = F.floor(F.col("file") / 1024)
    in_block = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = per_file.withColumn("block", block).withColumn("before", F.coalesce(F.sum("n").over(in_block), F.lit(0)))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    files = files.join(blocks, "block").select("file", (F.col("before") + F.col("base")).alias("before"))
    return rows.join(files, "file").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def write_indexed(docs: DataFrame, path: str, model_path: str) -> DataFrame:
    """Files and their index (under path/index); the index as read back."""
    spark = docs.sparkSession
    write(docs, f"{path}/records", model_path)
    index(spark, f"{path}/records").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def shuffled(index_rows: DataFrame, seed: int) -> DataFrame:
    """The index in a reproducible random order of records, for readers that seek by (file, offset, length)."""
    return index_rows.orderBy(F.xxhash64(F.lit(seed), "file", "offset"), "file", "offset")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    return write_indexed(docs, new_path(docs.sparkSession, "token-files"), model_path).select("doc_id", "start", "n_tokens", "ids_crc32")
