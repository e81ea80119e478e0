"""Catalogues in Markdown: S6, W1. A heading names a directory; table rows below it name its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import forward_filled
from ..functions.names import catalogue_tokens

#: Fixed patterns: a directory at a heading's start or in parentheses at its end, any heading, a table row.
LEADING, IN_PARENTHESES, HEADING, ROW = r"^#{2,4}\s*`([^`/]+)/`", r"\(`([^`/]+)/`\)\s*$", r"^#{1,6}\s", r"^\|\s*`([^`]+)`\s*\|"
PROVENANCE = "\x00provenance"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of one text file: its order is that of the file, so it is read whole."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def sections(lines: DataFrame) -> DataFrame:
    """line_no, section, token of the table rows. A catalogue is one small file, so one task walks it in order."""
    line = F.rtrim("line")
    found = F.coalesce(F.nullif(F.regexp_extract(line, LEADING, 1), F.lit("")), F.nullif(F.regexp_extract(line, IN_PARENTHESES, 1), F.lit("")))
    title = F.trim(F.regexp_replace(line, "^#+", ""))
    marked = F.when(line.rlike(HEADING), F.coalesce(found, F.when(title == "Provenance", PROVENANCE).otherwise("")))
    rows = lines.select("line_no", line.alias("line"), marked.alias("heading")).withColumn("section", forward_filled(F.col("heading"), "line_no"))
    return rows.filter(F.col("heading").isNull() & F.col("line").rlike(ROW)).select("line_no", "section", F.regexp_extract("line", ROW, 1).alias("token"))


def catalogue(lines: DataFrame) -> DataFrame:
    """path, token: the catalogued files with their directory's encoding; the last of equal paths counts, whatever their case."""
    rows = sections(lines)
    files = rows.filter(F.coalesce("section", F.lit("")) != "").filter(F.col("section") != PROVENANCE).select("line_no", F.col("section").alias("directory"), F.col("token").alias("file"))
    tokens = rows.filter(F.col("section") == PROVENANCE).select("token")
    joined = files.join(catalogue_tokens(files.select("directory"), tokens), "directory")
    path = F.concat_ws("/", "directory", "file")
    return joined.groupBy(F.lower(path).alias("key")).agg(F.max_by(path, "line_no").alias("path"), F.max_by("token", "line_no").alias("token")).select("path", "token")
