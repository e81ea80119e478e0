"""Byte corpora and tabular inputs. Operator ids: S1-S5, S7-S9, S11, N4's directory listing, F1.

Spark's own file index leaves out names that begin with _ or a dot, which corpora hold and
scope rules speak of, so `corpus` is a data source of its own: it lists every file, deals them
over partitions by size, and reads at most max_bytes of each. `binary_files` is the built-in
reader, for stores that only Spark opens.
"""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import dims
from ..operators.detect import reachable

SCHEMA = "path string, length long, modified timestamp, content binary"


class Listed(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        super().__init__(files)
        self.files = files


class CorpusReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["root"])
        self.limit = int(options.get("max_bytes", "0"))
        self.target = int(options.get("partition_bytes", str(64 << 20)))
        self.skip = tuple(x for x in options.get("skip_suffixes", "").split(",") if x)

    def partitions(self):
        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                full = os.path.join(folder, name)
                if not name.endswith(self.skip) if self.skip else True:
                    stat = os.stat(full)
                    found.append((os.path.relpath(full, self.root).replace(os.sep, "/"), stat.st_size, stat.st_mtime))
        found.sort()
        parts, size = [[]], 0
        for f in found:
            if parts[-1] and size + f[1] > self.target:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f[1]
        return [Listed(p) for p in parts]

    def read(self, partition):
        for path, size, mtime in partition.files:
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read(self.limit) if self.limit else f.read()
            yield path, size, datetime.datetime.fromtimestamp(mtime, datetime.UTC), content


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return "glyphsieve-corpus"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CorpusReader(self.options)


def corpus(spark: SparkSession, root: str, max_bytes: int = 0, skip_suffixes: str = "") -> DataFrame:
    """Path (ordinal order within partitions), length, modified and content of every file below root."""
    reachable(spark)
    spark.dataSource.register(CorpusSource)
    return spark.read.format("glyphsieve-corpus").options(root=root, max_bytes=str(max_bytes), skip_suffixes=skip_suffixes).load()


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """S1 where only Spark reads: path relative to root. Names that begin with _ or a dot are not listed by it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.substring_index("path", f"/{tail}/", -1)
    return rows.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def inventory(files: DataFrame, name: str) -> DataFrame:
    """Corpus, RelativePath, OriginalSize, OriginalSha256, OriginalLastWriteUtc of all but backup files."""
    written = F.date_format(F.to_utc_timestamp("modified", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.filter(~F.col("path").endswith(".bak")).select(
        F.lit(name).alias("Corpus"), F.col("path").alias("RelativePath"), F.col("length").alias("OriginalSize"), F.sha2("content", 256).alias("OriginalSha256"), written.alias("OriginalLastWriteUtc")
    )


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest is no longer that of the inventory. Sources are only read, so there should be none."""
    key = ["Corpus", "RelativePath"]
    return before.select(*key, "OriginalSha256").join(after.select(*key, F.col("OriginalSha256").alias("now")), key, "left").filter(~F.col("now").eqNullSafe(F.col("OriginalSha256")))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\x00", emptyValue="")
    return rows.toDF(*[c.removeprefix("\ufeff").strip() for c in rows.columns])


def manifest(spark: SparkSession, path: str, exact: bool = False) -> DataFrame | None:
    """Encoding, BOM, RelativePath, AlsoValidAs, Category and key; null if a needed column is missing.

    Columns are found by name, whatever their case. Blank paths go; of equal keys the last row
    counts. The key is the path without leading slashes, in lower case unless exact.
    """
    rows = _csv(spark, path)
    have = {c.lower(): c for c in rows.columns}
    if not {"encoding", "relativepath"} <= have.keys():
        return None
    pick = lambda n: (F.col(f"`{have[n.lower()]}`") if n.lower() in have else F.lit(None).cast("string")).alias(n)
    out = rows.select(*[pick(n) for n in ("Encoding", "BOM", "RelativePath", "AlsoValidAs", "Category")]).filter("trim(coalesce(RelativePath, '')) != '' AND Encoding IS NOT NULL")
    plain = F.ltrim(F.replace("RelativePath", F.lit("\\"), F.lit("/")), F.lit("/"))
    out = out.withColumns({"key": plain if exact else F.lower(plain), "__at": F.monotonically_increasing_id()})
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("__at")))
    return out.withColumn("__n", last).filter("__n = 1").drop("__n", "__at")


def with_manifest(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files (path) with their manifest row, by key whatever the case."""
    from ..operators.classify import relative

    return files.join(rows.withColumnRenamed("RelativePath", "listed"), F.lower(relative(F.col("path"))) == F.col("key"), "left").drop("key")


def run(spark: SparkSession, root: str) -> DataFrame:
    """Every audit.csv one folder below root; all columns strings, the folder as Corpus where the file has none."""
    rows = _csv(spark, f"{root}/*/audit.csv")
    if "Corpus" not in rows.columns:
        rows = rows.withColumn("Corpus", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows


def typed(rows: DataFrame) -> DataFrame:
    """A run's strings as the inner types: '' is null, True and False booleans, -1 null."""
    out = {}
    for name in rows.columns:
        value = F.nullif(F.col(f"`{name}`"), F.lit(""))
        if name in dims.AUDIT_BOOLEANS:
            value = value == "True"
        elif name in dims.AUDIT_NUMBERS:
            number = value.try_cast("double") if hasattr(value, "try_cast") else value.cast("double")
            value = F.when(number >= 0, number if name == "ReferenceConstraint" else number.cast("long"))
        out[name] = value
    return rows.select(*[v.alias(n) for n, v in out.items()])


def converter_report(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The converter's report with paths relative to root."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    file = F.replace("File", F.lit("\\"), F.lit("/"))
    relative = F.when(F.startswith(file, F.lit(base)), F.substring(file, F.lit(len(base) + 1), F.length(file))).otherwise(file)
    return _csv(spark, path).withColumn("File", relative)


REQUEST = "Mode string, Items array<struct<Path:string,ForcedEncoding:string,ForcedBom:boolean,DecoderMode:string>>, Encodings array<string>"


def request(spark: SparkSession, text: str) -> DataFrame:
    """A diagnostic request in JSON; what is not one raises."""
    rows = spark.createDataFrame([(text,)], "value string")
    return rows.select(F.from_json("value", REQUEST, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def sources(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, text of source files, without byte-order mark."""
    from ..functions.content import strip_bom

    rows = spark.read.text(pattern, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), strip_bom(F.col("value")).alias("text"))
