"""SimHash near-duplicates, searched with BK-trees.

A fingerprint bit is 1 if it is set in over half of the shingles' hashes. Distinct
fingerprints are the nodes of a graph; rows that share one are in one class from the
start, so copies cost nothing further. Nodes are dealt into shards such that every link
has both ends in at least one shard, and each shard has a BK-tree (children keyed by their
integer Hamming distance to the parent) of which a search follows only edges within the
radius. The shards' trees are built where the shard's rows meet: their total size grows
with the corpus, so they cannot be broadcast whole, and broadcasting them in waves would
have every row search every tree (figures in the README).

Sharding for 64 bits and radius 3 is exact: of 6 blocks 3 agree, so a node goes to 20
shards of 31 to 33 shared bits. A shard of over `SHARD_NODES` nodes is dealt again by the
remaining bits in the same way, which leaves 2**18 nodes of it at most.

`near_duplicates` links documents whose 256-bit fingerprints of five-word shingles agree
in 0.8 of the bits or more. Its shards are the shingles of a prefix filter: documents of any
length whose shingles have a Jaccard similarity of 0.8 or more meet in at least one shard.
A shard of over `NEAR_NODES` rows is dealt again into blocks (`near_links`).

Trees stop a search once the new node is joined to all components of its tree, and emit
only links that join components: no link between components is lost, and a class of n
copies yields n - 1 links.

Edge cases: a text without words (null, empty, blank) has fingerprint zero and is linked
like any other under the contract; `near_duplicates` gives it no shard, so only equal ones
are one class. Null doc_ids take part; a class's id is its smallest non-null doc_id.
Repeated rows give a row each; an empty table gives none. A text is held whole in its
worker, whatever its length, its hashes counted 65,536 at a time. Other columns are carried by
`keep_one`, whatever their names, and not read by the others.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ROW, mapped, maybe_broadcast, numbered_rows, small_batches, written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
SHARD_NODES = 4096
#: near_duplicates: words of a shingle, least share of equal bits, words of 64 bits.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_WORDS = 5, 0.8, 4
#: The order of shingles: one text in SAMPLE is looked at, OFTEN of these make a shingle frequent, the FREQUENT most so are put last.
SAMPLE, OFTEN, FREQUENT = 16, 8, 100_000
#: Rows of a shard of near_duplicates above which it is dealt again, and about how many of them go to all of its blocks.
NEAR_NODES, HUBS = 16_384, 64
#: Rows up to which a list of removed rows is broadcast, checked by counting.
GONE_ROWS = 1_000_000
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


# -- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(raw: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of ASCII-lower-cased words; bytes.split() cuts at the six ASCII spaces."""
    w = raw.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < size:
        return np.array([xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False))
    return np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(w) - size + 1)


def majority(h: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits from each hash (a multiply and xor-shift finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a signed bigint)."""

    def run(batches):
        for batch in small_batches(batches):
            fp = np.array([majority(shingle_hashes((t.as_py() or "").encode(), size)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


# -- BK-trees --------------------------------------------------------------------------------


class BKTree:
    """Fingerprints as integers; union-find over them, joined where they are within the radius."""

    def __init__(self, radius: int):
        self.radius, self.nodes, self.children, self.root_of, self.components = radius, [], [], [], 0

    def find(self, i: int) -> int:
        root = self.root_of
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joined(self, x: int) -> list[int]:
        """One node within the radius of x for each component that has any."""
        if not self.nodes:
            return []
        found: dict[int, int] = {}
        stack, radius, nodes, children = [0], self.radius, self.nodes, self.children
        while stack:
            i = stack.pop()
            d = (nodes[i] ^ x).bit_count()
            if d <= radius:
                found.setdefault(self.find(i), i)
                if len(found) == self.components:
                    break
            if kids := children[i]:
                stack += [c for e, c in kids.items() if d - radius <= e <= d + radius]
        return list(found.values())

    def insert(self, x: int, links: list[int]) -> None:
        new = len(self.nodes)
        self.nodes.append(x)
        self.children.append({})
        self.root_of.append(new)
        self.components += 1 - len(links)
        for i in links:
            self.root_of[self.find(i)] = new
        i = 0
        while new:
            d = (self.nodes[i] ^ x).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = new
                return
            i = self.children[i][d]


def _groups(batches, limit: int = SHARD_NODES):
    """(first, key, fps) of runs of equal keys in sorted batches; a long run comes in pieces, first is False for its later ones.

    Runs of one row are left out. Keys and fps are compared as numpy arrays or bytes.
    """
    held_key, held = None, []
    given = False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        last = len(starts) - 1
        for g in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
            key, rows = keys[starts[g]], fps.slice(starts[g], ends[g] - starts[g]).to_pylist()
            if held_key is not None and key == held_key:
                held += rows
            else:
                if given or len(held) > 1:
                    yield not given, held_key, held, True
                held_key, held, given = key, rows, False
            if len(held) > limit:
                yield not given, held_key, held, False
                held, given = [], True
    if given or len(held) > 1:
        yield not given, held_key, held, True


# -- links within radius 3 of 64 bits ---------------------------------------------------------


def _cells(value, blocks, chosen):
    """The bits of the chosen blocks, side by side."""
    out, width = F.lit(0).cast("long"), 0
    for i in chosen:
        at, bits = blocks[i]
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << bits) - 1)), width))
        width += bits
    return out


def _shards(nodes: DataFrame) -> DataFrame:
    """(key, fp): each node in its 20 shards. The key has the number of the choice above 33 bits of fingerprint."""
    keys = [F.shiftleft(F.lit(c).cast("long"), 33).bitwiseOR(_cells(F.col("fp"), BLOCKS, chosen)) for c, chosen in enumerate(combinations(range(6), 3))]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _trees(sharded: DataFrame, defer: bool, limit: int = SHARD_NODES) -> DataFrame:
    """Links (a, b) of the shards; where defer holds, the rows (key as a, fp as b) of large shards instead, marked."""

    def run(batches):
        links: list[tuple[int, int]] = []
        late: list[tuple[int, int]] = []

        def out(rows, flag):
            a, b = np.array(rows, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), flag))], names=["a", "b", "late"])

        tree = BKTree(RADIUS)
        for first, key, fps, whole in _groups(batches, limit):
            if first:
                tree = BKTree(RADIUS)
            if defer and not (first and whole):
                late += [(int(key), fp) for fp in fps]
            else:
                for fp in fps:
                    x = fp & 0xFFFFFFFFFFFFFFFF
                    near = tree.joined(x)
                    for i in near:
                        y = tree.nodes[i]
                        links.append((y - (1 << 64) if y >> 63 else y, fp))
                    tree.insert(x, near)
            if len(links) > 50_000:
                yield out(links, False)
                links = []
            if late:
                yield out(late, True)
                late = []
        if links:
            yield out(links, False)

    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(sharded.repartition(parts, "key").sortWithinPartitions("key"), run, "a bigint, b bigint, late boolean")


def links(nodes: DataFrame, limit: int = SHARD_NODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that join all that are within radius 3."""
    first = written(_trees(_shards(nodes), True, limit), "simhash-links")
    late = first.filter("late")
    out = first.filter("NOT late").select("a", "b")
    if late.isEmpty():
        return out
    # The bits outside the shard's choice, in six blocks of which three agree again.
    keys = []
    for c, chosen in enumerate(combinations(range(6), 3)):
        rest = [(at + k, 1) for i, (at, bits) in enumerate(BLOCKS) if i not in chosen for k in range(bits)]
        cut = [rest[k * len(rest) // 6 : (k + 1) * len(rest) // 6] for k in range(6)]
        own = [F.struct(F.lit(s).alias("s"), _cells(F.col("b"), sum((cut[i] for i in pick), []), range(sum(len(cut[i]) for i in pick))).alias("bits")) for s, pick in enumerate(combinations(range(6), 3))]
        keys.append(F.when(F.shiftright("a", 33) == c, F.array(*own)))
    again = late.select("a", F.col("b").alias("fp"), F.explode(F.coalesce(*keys)).alias("own"))
    # Hashing three numbers into one key can only put more nodes together.
    again = again.select(F.xxhash64("a", "own.s", "own.bits").alias("key"), "fp")
    return out.unionByName(_trees(again, False).select("a", "b"))


# -- components -------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large and small stars.

    Every step is written, so lineage stays short; it ends when a step changes nothing. The least
    neighbours are written too: a join of two tables that are both yet to be dealt is one whose
    hubs Spark can split over tasks, which it can't where an aggregate has already dealt one side.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()

    before = state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(large.filter("u != v").distinct(), "stars")
        # Small star: smaller neighbours and the node itself get the smallest of them.
        low = written(e.groupBy("u").agg(F.min("v").alias("m")), "lows")
        joined = e.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = written(small.filter("u != v").distinct(), "stars")
        after = state(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        before = after


def classes(prints: DataFrame, found: DataFrame) -> DataFrame:
    """prints (doc_id, fp) with component_id: the smallest doc_id of the class that its fingerprint is in."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = components(found)
    ends = root.select(F.col("node").alias("fp"), "root").unionByName(root.select(F.col("root").alias("fp"), "root").distinct())
    known = first.join(ends, "fp", "left").select("fp", "low", "root")
    known = written(known, "known")
    low = written(known.filter("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("least")), "roots")
    ids = known.join(low, "root", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    return prints.join(ids, "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of all rows under the contract's shingles and radius."""
    prints = written(fingerprints(docs), "fingerprints")
    return classes(prints, links(prints.select("fp").distinct()))


def digest(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near duplicates at a similarity ----------------------------------------------------------


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingle hashes that a sample of docs (doc_id, text) holds often, most frequent last.

    They only set the order of prefix_keys(), which is exact under any order, so what the sample misses costs time alone.
    """

    def run(batches):
        for batch in small_batches(batches):
            parts = [np.unique(shingle_hashes((t.as_py() or "").encode(), NEAR_SHINGLE)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))], names=["h"])

    some = docs.filter(F.xxhash64("text") % SAMPLE == 0).select("text").distinct()
    counted = mapped(some, run, "h bigint").groupBy("h").count().filter(F.col("count") >= OFTEN)
    rows = counted.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    return np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefix_keys(h: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n distinct shingle hashes: by value, then the frequent ones, the most frequent last.

    frequent is sorted, order has the rank of each. Sets with a Jaccard similarity of 0.8 or more
    share at least 0.8 of the larger one, so under one order for all their prefixes meet.
    """
    distinct = np.unique(h)
    size = len(distinct) - (4 * len(distinct) + 4) // 5 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)
        often = frequent[at] == distinct
        distinct = np.concatenate([distinct[~often], distinct[often][np.argsort(order[at[often]])]])
    return distinct[:size].view(np.int64)


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (32 bytes) and keys (the shards it goes to)."""
    ranked = frequent_shingles(docs)
    order = np.argsort(ranked)
    frequent = ranked[order]

    def run(batches):
        for batch in small_batches(batches):
            fps, keys = [], []
            for t in batch.column(1):
                h = shingle_hashes((t.as_py() or "").encode(), NEAR_SHINGLE)
                fps.append(b"".join(majority(mixed(h, k)).to_bytes(8, "little") for k in range(NEAR_WORDS)))
                keys.append(prefix_keys(h, frequent, order) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "keys"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, fp binary, keys array<bigint>")


def _near_trees(sharded: DataFrame, radius: int, defer: bool, limit: int) -> DataFrame:
    """Links (a, b) of the shards (key, fp); where defer holds, the rows (key, fp as b) of large shards instead."""

    def run(batches):
        a, b, keys = [], [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(keys, pa.int64())], names=["a", "b", "key"])

        tree = BKTree(radius)
        for first, key, fps, whole in _groups(batches, limit):
            if first:
                tree = BKTree(radius)
            if defer and not (first and whole):
                a += [None] * len(fps)
                b += fps
                keys += [int(key)] * len(fps)
            else:
                for fp in fps:
                    x = int.from_bytes(fp, "little")
                    near = tree.joined(x)
                    a += [tree.nodes[i].to_bytes(len(fp), "little") for i in near]
                    b += [fp] * len(near)
                    keys += [None] * len(near)
                    tree.insert(x, near)
            if len(a) > 20_000:
                yield out()
                a, b, keys = [], [], []
        if a:
            yield out()

    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(sharded.repartition(parts, "key").sortWithinPartitions("key"), run, "a binary, b binary, key bigint")


def near_links(nodes: DataFrame, radius: int, limit: int = NEAR_NODES) -> DataFrame:
    """Links (a, b) between fingerprints that join all that share a key and are within the radius. nodes: key, fp.

    A shard of over `limit` rows is dealt into blocks, each with some rows of all its blocks, which
    joins most of a group of near copies. What its largest component lacks is then compared with
    every block, and among itself block by block, so that each pair not joined before meets in a tree.
    """
    first = written(_near_trees(nodes, radius, True, limit), "near-links")
    late = first.filter("key IS NOT NULL").select("key", F.col("b").alias("fp")).distinct()
    out = first.filter("key IS NULL").select("a", "b")
    if late.isEmpty():
        return out
    spread = F.xxhash64("fp")
    cut = lambda n: F.ceil(2 * F.col(n) / limit)
    series = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    sizes = late.groupBy("key").agg(F.count("*").alias("n"))
    rows = late.join(maybe_broadcast(sizes, GONE_ROWS), "key").withColumn("blocks", cut("n"))
    hub = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")) < HUBS
    own = F.explode(F.when(hub, series("blocks")).otherwise(F.array(F.pmod(spread, F.col("blocks")))))
    blocks = rows.select("key", "fp", own.alias("block")).select(F.xxhash64("key", "block").alias("key"), "fp")
    out = written(out.unionByName(_near_trees(blocks, radius, False, limit).select("a", "b")), "near-blocks")
    root = components(out).select(F.col("node").alias("fp"), "root")
    rooted = written(late.join(root, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "near-late")
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    most = most.select("key", F.col("m.root").alias("most"), F.col("m.n").alias("large"), (F.col("all") - F.col("m.n")).alias("small")).filter("small > 0")
    rows = rooted.join(maybe_broadcast(most, GONE_ROWS), "key").withColumns({"large": cut("large"), "small": cut("small")})
    inside = rows.filter("root = most").select("key", "fp", F.pmod(spread, F.col("large")).alias("i"), F.explode(series("small")).alias("j"))
    outside = rows.filter("root != most").withColumn("own", F.pmod(spread, F.col("small")))
    against = outside.select("key", "fp", F.explode(series("large")).alias("i"), F.col("own").alias("j"))
    among = outside.select("key", "fp", "own", F.explode(series("small")).alias("other")).filter("own != other")
    among = among.select("key", "fp", (-1 - F.least("own", "other")).alias("i"), F.greatest("own", "other").alias("j"))
    tiles = inside.unionByName(against).unionByName(among).select(F.xxhash64("key", "i", "j").alias("key"), "fp")
    return out.unionByName(_near_trees(tiles, radius, False, limit).select("a", "b"))


def near_duplicates(docs: DataFrame, limit: int = NEAR_NODES) -> DataFrame:
    """doc_id, fp and component_id of all rows: classes of five-word fingerprints that agree in 0.8 of their bits."""
    radius = int(64 * NEAR_WORDS * (1 - NEAR_SIMILARITY))
    prints = written(near_fingerprints(docs), "near-fingerprints")
    # Equal fingerprints of different texts have different keys, and keep them all.
    nodes = prints.select("fp", "keys").distinct().select(F.explode("keys").alias("key"), "fp")

    found = near_links(nodes, radius, limit)
    return classes(prints.select("doc_id", "fp"), found)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each class of near duplicates: the smallest doc_id, nulls last, then the first row."""
    rows = numbered_rows(docs)
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    found = written(found.join(rows.select(ROW, "doc_id"), ROW), "near-classes")
    # Every class has one row that stays, so the rest is what is not among these: no join on a class, however large.
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("best"))
    gone = found.join(best.select(F.col(f"best.{ROW}").alias(ROW)), ROW, "left_anti").select(ROW)
    gone = written(gone, "near-gone")
    return rows.join(maybe_broadcast(gone, GONE_ROWS), ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
