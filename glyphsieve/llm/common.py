"""What the training-data operators share: inputs, shared storage, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern of the contracts: what separates ASCII-lower-cased words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same rule for bytes: A-Z to a-z, every separator to a space, then bytes.split().
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none, one is made and set if everything runs on this machine (tests);
    a cluster must name one.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        held = spark.conf.get("spark.glyphsieve.own.dir", None)
        if not held:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            held = tempfile.mkdtemp(prefix="glyphsieve-")
            spark.conf.set("spark.glyphsieve.own.dir", held)
    return held


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/glyphsieve/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, under this application's own."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Deletes all tables that this application has written so far; to be called when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a row group: a writer holds one in memory.
ROW_GROUP = 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Column of numbered_rows().
ROW = "__row"


def numbered_rows(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written once so that it stays the same."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the JVM's byte-wise lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound, else as it is (shuffled join)."""
    return F.broadcast(df) if bounded(df, rows) else df


#: Rows and bytes of an Arrow batch, set where the session has larger ones. Texts are long, and both sides of the pipe hold whole batches.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def released() -> None:
    """Gives unused memory back: workers outlive their tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, fn, schema: str, memo: bool = False) -> DataFrame:
    """df.mapInArrow(fn), with this package's folder on the workers' path. memo: fn uses one of the workers' memos; others drop them."""
    here = __file__.rsplit("/", 3)[0]
    spark = df.sparkSession
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (here, env.get("PYTHONPATH", "")) if p)
    for key, most in ARROW.items():
        held = spark.conf.get(key)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))

    def run(batches):
        from glyphsieve.llm.pieces import drop_memos

        if not memo:
            drop_memos()
        yield from fn(batches)
        released()

    return df.mapInArrow(run, schema)


def small_batches(batches, rows: int = 256):
    """Arrow batches cut into slices, so that what Python holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
