"""Comparison of two runs. Operator ids: A24, A25, J9, J10, J15, Q6, Q9, U1, O2, K12."""

from __future__ import annotations

import difflib
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from .classify import transition
from .detect import struct_of

KEY = ["Corpus", "RelativePath"]


def guarded(before: DataFrame, after: DataFrame) -> None:
    """Q9: a comparison with an empty side proves nothing."""
    for name, df in (("before", before), ("after", after)):
        if df.isEmpty():
            raise ValueError(f"the run {name} has no rows")


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every file of either run with its outcomes, absent ones marked, and the verdict; only changed ones."""
    side = lambda df, n: df.select(*KEY, F.col("FailureCategory").alias(n))
    rows = side(before, "before").join(side(after, "after"), KEY, "full_outer")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(dims.ABSENT)) for c in ("before", "after")}).filter("before != after")
    return rows.withColumn("verdict", transition(F.col("before"), F.col("after")))


def transition_counts(rows: DataFrame, *by: str) -> DataFrame:
    """By before, after, verdict or by given columns."""
    return rows.groupBy(*(by or ("before", "after", "verdict"))).agg(F.count("*").alias("n"))


def shifts(before: DataFrame, after: DataFrame, column: str = "FailureCategory", threshold: float = dims.SHIFT_ALARM) -> DataFrame:
    """Over files in both runs, the change in count and share of each value; alarm at the threshold or beyond."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is a share")
    both = before.select(*KEY, F.col(column).alias("b")).join(after.select(*KEY, F.col(column).alias("a")), KEY)
    sides = both.select(F.explode(F.array(F.struct(F.col("b").alias("value"), F.lit(1).alias("was"), F.lit(0).alias("now")), F.struct(F.col("a").alias("value"), F.lit(0).alias("was"), F.lit(1).alias("now")))).alias("s")).select("s.*")
    counts = sides.groupBy("value").agg(F.sum("was").alias("before"), F.sum("now").alias("after")).filter("before != after")
    total = F.broadcast(both.agg(F.count("*").alias("total")))
    share = F.round((F.col("after") - F.col("before")) / F.col("total"), 6)
    out = counts.crossJoin(total).select("value", "before", "after", (F.col("after") - F.col("before")).alias("delta"), share.alias("share"))
    return out.withColumn("alarm", F.abs("share") >= threshold)


def drift(members: DataFrame) -> DataFrame:
    """Member, versions: texts that should be one (repository, member, text), after normalising line ends and spaces."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("text"), "\r\n?", "\n"), r"[ \t]+", " "))
    return members.withColumn("sha256", F.sha2(text.cast("binary"), 256)).groupBy("member").agg(F.count_distinct("sha256").alias("versions"), F.count_distinct("repository").alias("repositories"))


DIFFERENCE = {"context": 2, "lines": 60}


def _difference(member, first, second, here, there) -> dict | None:
    if first is None or second is None:
        return None
    lines = difflib.unified_diff(first.split("\n"), second.split("\n"), f"{here}/{member}", f"{there}/{member}", lineterm="", n=DIFFERENCE["context"])
    return {"difference": "\n".join(islice(lines, DIFFERENCE["lines"]))}


def drifted(members: DataFrame) -> DataFrame:
    """Q6: member, versions (arrays of repositories, most first) and the difference of the two most frequent versions, where there are several.

    A version's own repositories are few (copies of one source), whatever the number of members.
    """
    text = F.array_join(F.transform(F.split(F.regexp_replace(F.trim("text"), "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    versions = members.select("member", "repository", text.alias("text")).groupBy("member", "text").agg(F.array_sort(F.collect_set("repository")).alias("own"))
    ranked = versions.select("member", F.struct((-F.size("own")).alias("order"), "own", "text").alias("v")).groupBy("member").agg(F.array_sort(F.collect_list("v")).alias("v")).filter("size(v) > 1")
    pick = lambda i, n: F.col("v")[i][n]
    shown = struct_of("struct<difference:string>", _difference)("member", pick(0, "text"), pick(1, "text"), pick(0, "own")[0], pick(1, "own")[0])
    return ranked.select("member", F.transform("v", lambda x: x["own"]).alias("versions"), shown["difference"].alias("difference"))


def member_body(source: str, signature: str) -> str | None:
    """Q6: the text from a signature to the end of its braces; strings and comments do not count. Null if there is none."""
    at = source.find(signature)
    start = source.find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    depth, i, n = 0, start, len(source)
    while i < n:
        two = source[i : i + 2]
        if two == "//":
            i = source.find("\n", i)
            if i < 0:
                return None
        elif two == "/*":
            i = source.find("*/", i) + 1
            if i < 1:
                return None
        elif source[i] in "\"'":
            quote, i = source[i], i + 1
            while i < n and source[i] != quote:
                i += 2 if source[i] == "\\" else 1
        elif source[i] == "{":
            depth += 1
        elif source[i] == "}":
            depth -= 1
            if not depth:
                return source[at : i + 1]
        i += 1
    return None
