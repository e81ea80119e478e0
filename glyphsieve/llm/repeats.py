"""Exact removal of repeated byte strings across documents by partitioned suffix arrays.

A byte is removed if a string of SPAN bytes that covers it also starts in a document with a
smaller doc_id. Equal strings must meet in one task, without shipping every position:

1. Texts are packed into blocks (compressed, written once, bucketed by block).
2. In each string of SPAN bytes the least hash of its GRAM-byte pieces is its key. Keys
   are constant over runs of neighbouring positions, so a text has one run for some 14
   bytes. Blocks send their distinct keys to buckets, which send back one bit for each: also
   seen in another block; and a second one: held by so many runs that it is hot.
3. Runs with shared keys are cut out as segments. Equal segments meet in the block first
   (by a hash of their bytes, then byte by byte); the least doc_id stands for them. Hot
   segments are cut into their single strings, which have keys of their own, so that a
   passage in a third of all documents is one row a block.
4. A bucket has all segments of its keys. Equal ones are settled by the least doc_id. Where
   a key has several different ones, a suffix array over them, built by two-stage sorting,
   and its adjacent common prefixes find which strings of SPAN bytes they share.
5. The answers, a bit for each position of a segment, return to the blocks.

Two-stage sorting: suffixes smaller than their successors are sorted directly, all others
are induced by one scan over the buckets of first symbols. No step compares beyond SPAN.

A block is worked on in slices of PIECE bytes with 32-bit places, so a worker holds some 40
bytes for a byte of a block at worst (every key hot) and few otherwise. A text longer than
a block is a block of its own. Block and bucket sizes follow the square root of the input
beyond a terabyte (`sizes`), so that neither rows between them nor their memory run away.

Edge cases: null texts are empty; texts under SPAN bytes lose nothing; an empty table gives
none. A null doc_id counts as larger than any other. Rows with the same doc_id never remove
from each other. Repeated rows give a row each. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_GROUP, mapped, new_path, written

SPAN, GRAM = 50, 24
#: Text bytes to a partition of segments, and the most such partitions.
SETTLED, MOST_PARTS = 8 << 20, 1 << 17
#: Text bytes of a block and of the slices that are worked on at once; keys a bucket is planned for; runs that make a key hot; bytes of a suffix array.
BLOCK, PIECE, BUCKET_KEYS, HOT, POOL = 8 << 20, 1 << 20, 2_000_000, 4096, 1 << 20
#: Input from which blocks and buckets grow, and how many times they do at most.
LARGE, GROWTH = 1 << 40, 8
#: Positions that count as one more run of a key, so that endless repetition within a text is hot too.
LONG = 256
#: Bytes of the rows that are handed on at once.
GIVEN = 4 << 20
NULL_ID = (1 << 63) - 1
LOW = 32


def pack(*arrays) -> bytes:
    """Arrays and byte strings, compressed one after the other."""
    raw = [memoryview(np.ascontiguousarray(a)).cast("B") if isinstance(a, np.ndarray) and a.size else memoryview(b"" if isinstance(a, np.ndarray) else a) for a in arrays]
    stream = zstandard.ZstdCompressor(level=3).compressobj(size=8 * (len(raw) + 1) + sum(map(len, raw)))
    return b"".join([stream.compress(struct.pack(f"<{len(raw) + 1}Q", len(raw), *map(len, raw))), *map(stream.compress, raw), stream.flush()])


def unpack(blob: bytes) -> list[memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (n,) = struct.unpack_from("<Q", data)
    sizes, at, out = struct.unpack_from(f"<{n}Q", data, 8), 8 * (n + 1), []
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


# -- keys ------------------------------------------------------------------------------------


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        z = (z ^ (z >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def words64(raw) -> np.ndarray:
    """The little-endian 64-bit word at each byte position."""
    data = np.frombuffer(raw, np.uint8)
    out = np.empty(len(data) - 7, np.uint64)
    for r in range(min(8, len(out))):
        n = (len(data) - r) // 8
        out[r::8] = np.frombuffer(raw, "<u8", n, r)[: len(out[r::8])]
    return out


def least_keys(raw) -> np.ndarray:
    """For each position the least hash of the GRAM-byte pieces in the SPAN bytes from there."""
    v = words64(raw)
    n = len(raw) - GRAM + 1
    with np.errstate(over="ignore"):
        g = v[:n] * np.uint64(0x9E3779B97F4A7C15) + v[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + v[16 : 16 + n] * np.uint64(0x165667B19E3779F9)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    width, held = SPAN - GRAM + 1, 1
    while 2 * held <= width:
        g = np.minimum(g[:-held], g[held:])
        held *= 2
    if width > held:
        g = np.minimum(g[: len(g) - (width - held)], g[width - held :])
    return g


def slices(offsets: np.ndarray):
    """(first text, behind the last, from, to): whole texts of PIECE bytes together, or the parts of a longer one, which overlap by SPAN - 1 bytes."""
    first, total = 0, len(offsets) - 1
    while first < total:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        base, end = int(offsets[first]), int(offsets[last])
        for low in range(base, max(base + 1, end - SPAN + 1), PIECE) if last == first + 1 else (base,):
            yield first, last, low, min(end, low + PIECE + SPAN - 1) if last == first + 1 else end
        first = last


def runs(raw, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, positions, key) of the runs of equal keys in each text of a block, by place."""
    starts, counts, keys = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
    for first, last, base, end in slices(offsets):
        if end - base < SPAN:
            continue
        least = least_keys(raw[base:end])
        if last == first + 1:
            at, doc = np.arange(len(least)), None
            cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        else:
            doc = np.repeat(np.arange(first, last, dtype=np.int32), np.diff(offsets[first : last + 1]))[: len(least)]
            at = np.flatnonzero(np.arange(base + SPAN, base + SPAN + len(least)) <= offsets[doc + 1])
            k, d = least[at], doc[at]
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(at) else np.empty(0, np.int64)
        if len(at):
            starts.append((at[cut] + base).astype(np.int32))
            counts.append(np.diff(np.append(cut, len(at))).astype(np.int32))
            keys.append(mix(least[at[cut]]))
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n[0], n[1], ... things: whose it is, and its number there."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)


def stretches(start: np.ndarray):
    """(from, to) of ascending starts that lie in the same PIECE of text."""
    edges = np.searchsorted(start, np.arange(0, int(start[-1]) + PIECE + 1, PIECE)).tolist() if len(start) else []
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def contents(raw, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each segment, wherever it stands: the sum over its strings of SPAN bytes. Segments ascend and share no position."""
    out = np.empty(len(start), np.uint64)
    for a, b in stretches(start):
        base, n = int(start[a]), count[a:b]
        w = words64(raw[base : int(start[b - 1]) + int(count[b - 1]) + SPAN - 1])
        whose, within = spread(n)
        p = (start[a:b] - base)[whose] + within
        h = within.astype(np.uint64)
        with np.errstate(over="ignore"):
            h *= np.uint64(0xD1B54A32D192ED03)
            for k in (*range(0, SPAN - 7, 8), SPAN - 8):
                h ^= w[p + k]
                h *= np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(32)
            out[a:b] = np.add.reduceat(h, np.cumsum(n) - n)
    return mix(out)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each distinct hash, and the first place of each number; range by range, so that little is sorted at once."""
    bits = (len(hashes) >> 20).bit_length()
    number, firsts, base = np.empty(len(hashes), np.int32), [np.empty(0, np.int32)], 0
    for part in range(1 << bits):
        own = np.flatnonzero(hashes >> np.uint64(64 - bits) == part) if bits else np.arange(len(hashes))
        if len(own):
            own = own[np.argsort(hashes[own], kind="stable")]
            h = hashes[own]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            number[own] = base + np.cumsum(new) - 1
            firsts.append(own[new].astype(np.int32))
            base += len(firsts[-1])
    return number, np.concatenate(firsts)


def different(raw, start: np.ndarray, count: np.ndarray, number: np.ndarray, first: np.ndarray) -> list[int]:
    """Segments whose bytes are not those of the first one of their number."""
    found = []
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), SPAN) if len(raw) >= SPAN else None
    for low in range(0, len(start), 1 << 16):
        own = np.arange(low, min(len(start), low + (1 << 16)))
        like = first[number[own]]
        own, like = own[like != own], like[like != own]
        bad = count[own] != count[like]
        found += own[bad].tolist()
        own, like = own[~bad], like[~bad]
        at = 0
        while len(own):
            step = np.minimum(at, count[own] - 1)
            bad = (window[start[own] + step] != window[start[like] + step]).any(axis=1)
            found += own[bad].tolist()
            more = ~bad & (count[own] - 1 > at)
            own, like, at = own[more], like[more], at + SPAN
    return sorted(found)


# -- suffix arrays ------------------------------------------------------------------------------


def symbol_words(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols from each place on as one big-endian word, and how many it holds: 8, or 4 of texts with over 256 different ones."""
    present = np.zeros(int(text.max()) + 1, bool)
    present[text] = True
    if present.sum() <= 256:
        rank = (np.cumsum(present) - 1).astype(np.uint8)
        return words64(rank[text].tobytes() + bytes(8 * SPAN)).byteswap(), 8
    return words64(text.astype(">u2").tobytes() + bytes(16 * SPAN)).byteswap()[::2], 4


def ordered(words: np.ndarray, step: int, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` symbols at least: word by word, each time only those that still tie."""
    at = at[np.argsort(words[at], kind="stable")]
    word = words[at]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    last = len(words) - 1
    for d in range(step, depth, step):
        ties = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(ties):
            break
        group, own = np.cumsum(new[ties]), at[ties]
        word = words[np.minimum(own + d, last)]
        order = np.lexsort((word, group))
        at[ties], word = own[order], word[order]
        fresh = new[ties]
        fresh[1:] |= word[1:] != word[:-1]
        new[ties] = fresh
    return at


def suffix_array(text: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Suffixes of text (uint16, its last symbol 0 and least) in the order of their first `depth` symbols at least.

    Two-stage: a suffix is of the first kind if it is smaller than its successor.
    """
    n = len(text)
    differ = np.flatnonzero(text[1:] != text[:-1])
    # The next place at which neighbours differ decides between a suffix and its successor.
    nxt = np.full(n, n - 1)
    nxt[differ] = differ
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    rising = np.zeros(n, bool)
    inside = nxt < n - 1
    rising[inside] = text[nxt[inside]] < text[nxt[inside] + 1]
    rising[n - 1] = True
    small = ordered(*symbol_words(text), np.flatnonzero(rising), depth)
    symbols = int(text.max()) + 1
    # In a bucket the induced suffixes come before the directly sorted ones.
    parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    cuts = np.searchsorted(text[small], np.arange(symbols + 1))
    out = []
    for c in range(symbols):
        done = 0
        while done < len(parts[c]):
            wave = np.concatenate(parts[c][done:])
            done = len(parts[c])
            _induce(text, rising, wave, parts)
        direct = small[cuts[c] : cuts[c + 1]]
        if len(direct):
            _induce(text, rising, direct, parts)
        out += [*parts[c], direct]
    return np.concatenate(out)


def _induce(text: np.ndarray, rising: np.ndarray, known: np.ndarray, parts: list[list[np.ndarray]]) -> None:
    """Appends to the buckets, in order, the predecessors of known suffixes that are larger than their successors."""
    before = known[known > 0] - 1
    before = before[~rising[before]]
    if len(before):
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cut):
            parts[int(text[part[0]])].append(part)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int = SPAN) -> np.ndarray:
    """Of each suffix with the one before it, up to limit; 0 for the first. Compared word by word."""
    words, step = symbol_words(text)
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    alive, last = np.arange(len(a)), len(words) - 1
    for d in range(0, limit, step):
        if not len(alive):
            break
        differ = words[np.minimum(a[alive] + d, last)] ^ words[np.minimum(b[alive] + d, last)]
        same = differ == 0
        out[alive[same] + 1] += step
        rest, differ = alive[~same], differ[~same]
        # Equal symbols in front of the first that differs, by halves.
        for bits in (32, 16, 8):
            if bits * step >= 64:
                equal = differ >> np.uint64(64 - bits) == 0
                out[rest + 1] += np.where(equal, bits * step // 64, 0)
                differ = np.where(equal, differ << np.uint64(bits), differ)
        alive = alive[same]
    out[1:] = np.minimum(np.minimum(out[1:], limit), len(text) - np.maximum(a, b))
    return out


def shared_strings(segments: list[bytes], owners: list[int]) -> list[np.ndarray]:
    """For each segment a flag per position: the SPAN bytes from there also stand in a segment of a smaller owner."""
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    text = np.zeros(int(ends[-1]), np.uint16)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    segment = np.repeat(np.arange(len(segments)), lengths + 1)
    order = suffix_array(text)
    order = order[order + SPAN < ends[segment[order]]]
    prefix = common_prefixes(text, order)
    group = np.flatnonzero(prefix < SPAN)
    own = np.array(owners, np.int64)[segment[order]]
    least = np.minimum.reduceat(own, group)
    hit = order[own > np.repeat(least, np.diff(np.append(group, len(order))))]
    flags = np.zeros(len(text), bool)
    flags[hit] = True
    return [flags[b : e - SPAN] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


# -- blocks --------------------------------------------------------------------------------------


def _blocks(docs: DataFrame, parts: int, block: int) -> DataFrame:
    """(block, body): packed doc_ids, null marks, offsets and texts; written, bucketed by block."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        number, ids, texts, size = 0, [], [], 0

        def out():
            nonlocal number, ids, texts, size
            values = np.array([NULL_ID if i is None else i for i in ids], np.int64)
            body = pack(values, np.array([i is None for i in ids], bool), np.cumsum([0, *map(len, texts)], dtype=np.int64), b"".join(texts))
            row = pa.RecordBatch.from_arrays([pa.array([task + number]), pa.array([body], pa.binary())], names=["block", "body"])
            number, ids, texts, size = number + 1, [], [], 0
            return row

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                if ids and size + len(raw) > block:
                    yield out()
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield out()

    spark = docs.sparkSession
    name = f"glyphsieve_blocks_{uuid.uuid4().hex}"
    packed = mapped(docs.select("doc_id", "text"), run, "block bigint, body binary")
    packed.write.bucketBy(parts, "block").option("path", new_path(spark, "blocks")).option("parquet.block.size", ROW_GROUP).saveAsTable(name)
    table = spark.table(name)
    # The plan holds the files and their buckets; the catalogue needs no entry any more.
    spark.sql(f"DROP TABLE {name}")
    return table


def _ids(keys: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of a key: the bucket's bits and LOW more."""
    return keys >> np.uint64(64 - bits - LOW)


def _by_bucket(ids: np.ndarray, bits: int):
    """(bucket, from, to) of sorted ids."""
    bucket = (ids >> np.uint64(LOW)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(ids) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(ids)) if len(ids) else cut
    return zip(bucket[cut].tolist(), cut.tolist(), ends.tolist(), strict=True)


def weighed(keys: np.ndarray, count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of a block's runs, the id's place for each run, and each id's weight: runs, long ones counting more."""
    ids, back = np.unique(_ids(keys, bits), return_inverse=True)
    return ids, back.astype(np.int32), np.bincount(back, 1 + count // LONG, len(ids)).astype(np.int64)


def _keys_of_blocks(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, offsets, raw = unpack(body.as_py())
                _, count, keys = runs(raw, np.frombuffer(offsets, np.int64))
                ids, _, weights = weighed(keys, count, bits)
                low, many = ids.astype(np.uint32), np.minimum(weights, 65_535).astype(np.uint16)
                rows = [(bucket, low[a:b].tobytes() + many[a:b].tobytes()) for bucket, a, b in _by_bucket(ids, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "body"])

    return mapped(blocks.select("block", "body"), run, "bucket bigint, block bigint, body binary")


def _grouped(batches, key: int = 0):
    """(key, rows) of sorted batches, rows as tuples of all columns."""
    held, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[key] != held:
                yield held, rows
                rows = []
            held = row[key]
            rows.append(row)
    if rows:
        yield held, rows


def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.repartition(parts, key).sortWithinPartitions(key)


def _shared_keys(sent: DataFrame, parts: int, most: int = HOT) -> DataFrame:
    """(block, bucket, body): a bit for each key sent: shared with another block, and one: hot."""

    def run(batches):
        for bucket, rows in _grouped(batches):
            lows, manys = [], []
            for _, _, body in rows:
                n = len(body) // 6
                lows.append(np.frombuffer(body, np.uint32, n))
                manys.append(np.frombuffer(body, np.uint16, n, 4 * n))
            low, many = np.concatenate(lows), np.concatenate(manys)
            order = np.argsort(low, kind="stable")
            group = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
            sizes = np.diff(np.append(group, len(low)))
            shared, hot = np.empty(len(low), bool), np.empty(len(low), bool)
            shared[order] = np.repeat(sizes > 1, sizes)
            hot[order] = np.repeat(np.add.reduceat(many[order].astype(np.int64), group) >= most, sizes)
            ends = np.cumsum([0, *map(len, lows)]).tolist()
            bodies = [np.packbits(np.concatenate([shared[a:b], hot[a:b]])).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(bodies, pa.binary())], names=["block", "bucket", "bits"])

    return mapped(_dealt(sent, "bucket", parts), run, "block bigint, bucket bigint, bits binary")


class Cut:
    """The shared runs of a block as segments, in order of place; a hot run falls into its single strings.

    start, count and single are by run, number (its segment) and whole (a smaller document of the
    block has it too) by piece. at, positions, least, seg_id and sent are by segment: where one
    stands, its strings, its least doc_id, its id, and whether it must meet others.
    """

    def __init__(self, raw, offsets: np.ndarray, doc_ids: np.ndarray, answers: dict[int, bytes], bits: int):
        start, count, keys = runs(raw, offsets)
        ids, back, weights = weighed(keys, count, bits)
        shared, hot = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for bucket, a, b in _by_bucket(ids, bits):
            flags = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=2 * (b - a)).astype(bool)
            shared[a:b], hot[a:b] = flags[: b - a], flags[b - a :]
        take = np.flatnonzero((shared | (weights > 1))[back])
        self.start, self.count, back = start[take], count[take], back[take]
        self.single = hot[back]
        kept = ids[back]
        del start, count, keys, ids, take
        self.owner = np.repeat(np.arange(len(self.start), dtype=np.int32), self.pieces())
        at, n = self.places(), np.where(self.single, 1, self.count)[self.owner]
        hashes = contents(raw, at, n)
        self.number, self.first = numbered(hashes)
        self._confirm(raw, at, n)
        ids_of = hashes[self.first]
        del hashes
        owner = self.owner[self.first]
        self.positions, self.at = n[self.first], at[self.first]
        # The least owner of each segment, and pieces that a smaller document of the block has.
        self.least = np.full(len(self.first), NULL_ID, np.int64)
        self.whole = np.empty(len(at), bool)
        parts = [(a, min(a + (1 << 20), len(at))) for a in range(0, len(at), 1 << 20)]
        documents = lambda a, b: doc_ids[np.searchsorted(offsets, at[a:b], "right") - 1]
        for a, b in parts:
            np.minimum.at(self.least, self.number[a:b], documents(a, b))
        for a, b in parts:
            self.whole[a:b] = documents(a, b) > self.least[self.number[a:b]]
        del at, n, self.owner, self.first
        # A string alone must meet others if another block has its key; a longer segment also if its key has others here.
        alone, back = self.single[owner], back[owner]
        self.seg_id = _ids(ids_of, bits)
        self.seg_id[~alone] = kept[owner[~alone]]
        self.sent = shared[back] | (~alone & (np.bincount(back, minlength=len(shared))[back] > 1))

    def pieces(self) -> np.ndarray:
        return np.where(self.single, self.count, 1)

    def places(self) -> np.ndarray:
        before = np.cumsum(self.pieces(), dtype=np.int32) - self.pieces().astype(np.int32)
        out = np.arange(len(self.owner), dtype=np.int32)
        out += (self.start - before)[self.owner]
        return out

    def _confirm(self, raw, at: np.ndarray, n: np.ndarray) -> None:
        """Gives segments of one hash whose bytes differ numbers of their own."""
        known: dict[bytes, int] = {}
        for i in different(raw, at, n, self.number, self.first):
            text = bytes(raw[int(at[i]) : int(at[i]) + int(n[i]) + SPAN - 1])
            if text not in known:
                known[text] = len(self.first)
                self.first = np.append(self.first, np.int32(i))
            self.number[i] = known[text]

    def state(self, sent: np.ndarray, cuts: list) -> bytes:
        return pack(np.diff(self.start, prepend=0).astype(np.uint32), self.count, self.single, self.number, self.whole, sent.astype(np.uint32), self.positions, np.array(cuts, np.int64))


def _segments(blocks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """Two kinds of rows (block, bucket, body): the segments sent to a bucket, and under a bucket below 0 the block's own state."""
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    # A block's answers are bounded by its size; the blocks stay where they are bucketed.
    joined = blocks.select("block", "body").join(gathered.hint("shuffle_hash"), "block", "left")

    def run(batches):
        def out(block, rows):
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "bucket", "body"])

        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                given = {a["bucket"]: a["bits"] for a in batch.column(2)[i].as_py() or []}
                ids, _, offsets, raw = unpack(batch.column(1)[i].as_py())
                cut = Cut(raw, np.frombuffer(offsets, np.int64), np.frombuffer(ids, np.int64), given, bits)
                sent = np.flatnonzero(cut.sent).astype(np.int32)
                sent = sent[np.argsort(cut.seg_id[sent], kind="stable")]
                cuts = list(_by_bucket(cut.seg_id[sent], bits))
                yield out(block, [(-1 - block, cut.state(sent, cuts))])
                rows, size = [], 0
                for bucket, a, b in cuts:
                    own = sent[a:b]
                    text = b"".join([raw[x:y] for x, y in zip(cut.at[own].tolist(), (cut.at[own] + cut.positions[own] + SPAN - 1).tolist(), strict=True)])
                    rows.append((bucket, pack(cut.seg_id[own].astype(np.uint32), cut.positions[own].astype(np.uint32), cut.least[own], text)))
                    size += len(rows[-1][1])
                    if size > GIVEN:
                        yield out(block, rows)
                        rows, size = [], 0
                del cut, raw
                if rows:
                    yield out(block, rows)

    return mapped(joined, run, "block bigint, bucket bigint, body binary")


def settle(ids: np.ndarray, positions: np.ndarray, owners: np.ndarray, text: bytes) -> np.ndarray:
    """A flag for each position of the segments of a bucket: removed for a smaller document's sake.

    Of equal segments of one id the least owner's stands for all; where an id has several different
    ones, those go into a suffix array, some ids together.
    """
    n = len(ids)
    ends = np.cumsum(positions + SPAN - 1)
    begins = (ends - positions - SPAN + 1).tolist()
    ends = ends.tolist()
    places = np.cumsum(positions) - positions
    flags = np.zeros(int(positions.sum()), bool)
    order = np.argsort(ids, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
    upto = np.append(cut[1:], n)
    pool: list[tuple[bytes, int, list[int]]] = []
    size = 0

    def flush():
        nonlocal pool, size
        if pool:
            for (_, _, members), found in zip(pool, shared_strings([p[0] for p in pool], [p[1] for p in pool]), strict=True):
                for m in members:
                    flags[places[m] : places[m] + len(found)] = found
        pool, size = [], 0

    for a, b in zip(cut[upto - cut > 1].tolist(), upto[upto - cut > 1].tolist(), strict=True):
        texts: dict[bytes, list[int]] = {}
        for m in order[a:b].tolist():
            texts.setdefault(text[begins[m] : ends[m]], []).append(m)
        for segment, members in texts.items():
            low = min(owners[members].tolist()) if len(members) > 1 else int(owners[members[0]])
            for m in members:
                if owners[m] > low:
                    flags[places[m] : places[m] + positions[m]] = True
            if len(texts) > 1:
                pool.append((segment, low, [m for m in members if owners[m] == low]))
                size += len(segment)
        if size > POOL:
            flush()
    flush()
    return flags


def _settled(sent: DataFrame, parts: int) -> DataFrame:
    """(block, bucket, bits): a flag for each position of the segments sent; the blocks' states as they are."""

    def run(batches):
        for bucket, rows in _grouped(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][1]]), pa.array([bucket]), pa.array([rows[0][2]], pa.binary())], names=["block", "bucket", "bits"])
                continue
            ids, positions, owners, texts = [], [], [], []
            for _, _, body in rows:
                i, p, o, t = unpack(body)
                ids.append(np.frombuffer(i, np.uint32))
                positions.append(np.frombuffer(p, np.uint32).astype(np.int64))
                owners.append(np.frombuffer(o, np.int64))
                texts.append(bytes(t))
            flags = settle(np.concatenate(ids), np.concatenate(positions), np.concatenate(owners), b"".join(texts))
            ends = np.cumsum([0, *(int(p.sum()) for p in positions)]).tolist()
            bodies = [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(bodies, pa.binary())], names=["block", "bucket", "bits"])

    return mapped(_dealt(sent, "bucket", parts), run, "block bigint, bucket bigint, bits binary")


def spans(at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, document) of the maximal runs of bytes that the strings from these positions cover."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.searchsorted(offsets, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (at[1:] > at[:-1] + SPAN) | (doc[1:] != doc[:-1])]))
    return at[new], at[np.append(new[1:], len(at)) - 1] + SPAN, doc[new]


def removed_spans(state: list, answers: dict[int, bytes], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spans() of the positions of a block at which a string to be removed starts, stretch by stretch."""
    steps, count, single, number, whole, sent, positions, cuts = (np.frombuffer(x, k) for x, k in zip(state, ("<u4", "<i4", bool, "<i4", bool, "<u4", "<i4", np.int64), strict=True))
    start = np.cumsum(steps, dtype=np.int32)
    place = np.cumsum(positions, dtype=np.int32) - positions
    flags = np.zeros(int(positions.sum(dtype=np.int64)), bool)
    for bucket, a, b in cuts.reshape(-1, 3).tolist():
        own = sent[a:b]
        whose, within = spread(positions[own])
        flags[place[own][whose] + within] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=len(whose)).astype(bool)
    pieces = np.where(single, count, 1)
    before = np.cumsum(pieces, dtype=np.int32) - pieces
    found = [spans(np.empty(0, np.int64), offsets)]
    for a, b in stretches(start):
        whose, within = spread(count[a:b])
        alone = single[a:b][whose]
        piece = before[a:b][whose] + np.where(alone, within, 0)
        hit = whole[piece] | flags[place[number[piece]] + np.where(alone, 0, within)]
        found.append(spans((start[a:b].astype(np.int64)[whose] + within)[hit], offsets))
    low, high, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(low):
        return low, high, doc
    # What ends in one stretch may go on in the next.
    new = np.flatnonzero(np.concatenate([[True], (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])]))
    return low[new], high[np.append(new[1:], len(low)) - 1], doc[new]


def _removed(blocks: DataFrame, state: DataFrame, answers: DataFrame, texts: bool) -> DataFrame:
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    side = state.select("block", F.col("bits").alias("state")).join(gathered, "block", "left")
    joined = blocks.select("block", "body").join(side.hint("shuffle_hash"), "block", "left")
    last = "kept_text binary" if texts else "kept_sha256 string"

    kinds = [*[pa.int64()] * 4, pa.binary() if texts else pa.string()]

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

        for batch in batches:
            for i in range(batch.num_rows):
                ids, nulls, offsets, raw = unpack(batch.column(1)[i].as_py())
                offsets = np.frombuffer(offsets, np.int64)
                given = {a["bucket"]: a["bits"] for a in batch.column(3)[i].as_py() or []}
                a, b, doc = removed_spans(unpack(batch.column(2)[i].as_py()), given, offsets)
                first = np.searchsorted(doc, np.arange(len(offsets)))
                rows, size = [], 0
                edges = offsets.tolist()
                a, b, cut = a.tolist(), b.tolist(), first.tolist()
                for d, (doc_id, null) in enumerate(zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(nulls, bool).tolist(), strict=True)):
                    low, high = edges[d], edges[d + 1]
                    pieces, gone = [], 0
                    for k in range(cut[d], cut[d + 1]):
                        pieces.append(raw[low : a[k]])
                        gone += b[k] - a[k]
                        low = b[k]
                    pieces.append(raw[low:high])
                    kept = b"".join(pieces) if texts else hashlib.sha256(b"".join(pieces)).hexdigest()
                    rows.append((None if null else doc_id, high - edges[d], gone, cut[d + 1] - cut[d], kept))
                    size += len(kept)
                    if size > GIVEN or len(rows) >= 2048 or d == len(edges) - 2:
                        yield out(rows)
                        rows, size = [], 0

    return mapped(joined, run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")


def sizes(total: int, parts: int) -> tuple[int, int, int]:
    """(bytes of a block, bits of a bucket's number, partitions of segments) for an input of so many bytes of text."""
    growth = min(GROWTH, max(1, math.isqrt(total // LARGE)))
    # Some 2 / (SPAN - GRAM + 2) of the positions begin a run; buckets are a power of two.
    buckets = max(4 * parts, total * 2 // (SPAN - GRAM + 2) // (BUCKET_KEYS * growth))
    # Segments grow with what is shared, so their partitions follow the bytes, not the session's setting alone.
    return BLOCK * growth, max(1, (buckets - 1).bit_length()), max(parts, min(total // SETTLED, MOST_PARTS))


def remove_repeats(docs: DataFrame, texts: bool = True, most: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is kept: its bytes, or their SHA-256."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, bits, settlers = sizes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, parts)
    blocks = _blocks(docs, parts, block)
    answers = _shared_keys(_keys_of_blocks(blocks, bits), parts, most)
    sent = _segments(blocks, answers, bits).select("bucket", "block", "body")
    held = written(_settled(sent, settlers), "settled")
    return _removed(blocks, held.filter("bucket < 0"), held.filter("bucket >= 0"), texts)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, texts=False)
