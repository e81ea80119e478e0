"""Sharding by a Feistel permutation with cycle walking over global row numbers (DataFrame operations only).

Rows are numbered 0..N-1 in the order of a key: a range partitioning, a running index in
each partition, and the partitions' offsets (one row per partition). The number is split
into two digits of bases a = b = ceil(sqrt(N)) and passed through Feistel rounds; results
outside 0..N-1 are walked on until they fall inside. Shard and slot are the remainder and
quotient of the permuted number, so shard counts differ by one at most, slots have no
gaps, and both can be computed, and inverted, from a row number alone.

Edge cases: null keys sort first; rows with equal keys are ordered by their remaining
columns, so any two orders differ in equal rows only. Null text: size 1, checksum 0. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, SEED, ROUNDS = 16, 20_260_101, 6
#: Prime below 2**31: products of two residues fit a bigint.
PRIME = 2_147_483_647


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    x, out = seed % PRIME, []
    for _ in range(rounds):
        a = x = (x * 48_271 + 11) % PRIME
        b = x = (x * 48_271 + 11) % PRIME
        out.append((a or 1, b))
    return out


def base(n: int) -> int:
    """Least b with b * b >= n."""
    b = int(n**0.5)
    while b * b < n:
        b += 1
    while b > 1 and (b - 1) * (b - 1) >= n:
        b -= 1
    return max(b, 1)


def feistel(x: int, n: int, seed: int = SEED) -> int:
    """The permutation on plain integers, for callers that need a single row's place."""
    b = base(n)
    while True:
        left, right = divmod(x, b)
        for k, c in round_keys(seed):
            m = (right % PRIME * k + c) % PRIME
            left, right = right, (left + m * m % PRIME) % b
        x = left * b + right
        if x < n:
            return x


def inverse(y: int, n: int, seed: int = SEED) -> int:
    """The row number that feistel() sends to y."""
    b = base(n)
    while True:
        left, right = divmod(y, b)
        for k, c in reversed(round_keys(seed)):
            m = (left % PRIME * k + c) % PRIME
            left, right = (right - m * m % PRIME) % b, left
        y = left * b + right
        if y < n:
            return y


def _once(x: Column, b: int, seed: int) -> Column:
    """One pass of the rounds: the two digits travel as a struct so that nothing is computed twice."""
    state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).alias("r"))
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c")) for k, c in round_keys(seed)])

    def step(s: Column, key: Column) -> Column:
        m = (s["r"] % PRIME * key["k"] + key["c"]) % PRIME
        return F.struct(s["r"].alias("l"), ((s["l"] + m * m % PRIME) % b).alias("r"))

    return F.aggregate(keys, state, step, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """feistel() as a column. Numbers below n stay below n.

    No walk leaves 0..n-1 for longer than there are numbers outside it, b * b - n <= 2 sqrt(n),
    so as many steps are exact; only the few rows whose first pass falls outside take them.
    """
    b = base(n)
    out = _once(number, b, seed)
    if b * b > n:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(b * b - n + 1)), out, lambda y, _: F.when(y < n, y).otherwise(_once(y, b, seed)))
        out = F.when(out < n, out).otherwise(walk)
    return out


def numbered(df: DataFrame, key: str, column: str) -> DataFrame:
    """df, written once, with consecutive global row numbers from 0 in the order of key, then of all other columns."""
    rest = [c for c in df.columns if c != key]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(f"`{c}`").asc_nulls_first() for c in [key, *rest]]
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = written(placed.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    pid = F.shiftright("__id", 33)
    held = held.withColumns({"__pid": pid, "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row per partition, so the running sum is over a bounded table.
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("__pid").agg(F.count("*").alias("n")).select("__pid", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__before"))
    out = held.join(F.broadcast(offsets), "__pid")
    return out.withColumn(column, F.col("__at") + F.col("__before")).drop("__id", "__pid", "__at", "__before")


def assign(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with row_number, permuted, shard and slot."""
    rows = numbered(df, key, "row_number")
    n = rows.count()
    if not n:
        return rows.withColumns({"permuted": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    p = rows.withColumn("permuted", permuted(F.col("row_number"), n, seed))
    return p.withColumns({"shard": (F.col("permuted") % shards).cast("int"), "slot": F.floor(F.col("permuted") / shards).cast("long")})


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> None:
    """df in one folder per shard, each in slot order within its files (files of a shard are split by slot range)."""
    out = assign(df, key, shards, seed)
    out.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def digest(docs: DataFrame) -> DataFrame:
    out = assign(sized(docs))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
