"""Codec names: resolution, spellings, directory and catalogue tokens.

Operator ids: N1-N3, N6-N10, N12, X2. Names are resolved against a dimension built once on
the driver from the interpreter's codec registry; per-row work is joins and expressions.
"""

from __future__ import annotations

import codecs
import re
from encodings.aliases import aliases
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims


@lru_cache(maxsize=4096)
def resolve_codec(name: str | None) -> str | None:
    """Canonical name of a codec, without a trailing remark in parentheses; null if there is no such text codec."""
    token = re.sub(r"\s*\([^)]*\)$", "", (name or "").strip().lower())
    token = dims.ALIASES.get(token, token)
    try:
        info = codecs.lookup(token) if token else None
    except (LookupError, ValueError):
        return None
    return info.name if info is not None and info._is_text_encoding else None


@lru_cache(maxsize=1)
def codec_names() -> dict[str, str]:
    """Every spelling that the registry is known to take, and the aliases, with their canonical names."""
    known = {*aliases, *aliases.values(), *dims.ALIASES, *dims.UNAIDED, *dims.BASELINE, *dims.CODE_PAGES}
    forms = {f for n in known for f in (n, n.replace("_", "-"), n.replace("-", "_"))}
    return {n: c for n in sorted(forms) if (c := resolve_codec(n))}


def codec_dimension(spark: SparkSession) -> DataFrame:
    """(name, codec, code_page): bounded by the registry, so it may be broadcast."""
    rows = [(n, c, dims.CODE_PAGES.get(c)) for n, c in codec_names().items()]
    return spark.createDataFrame(rows, "name string, codec string, code_page int")


def cleaned(name: Column) -> Column:
    """N1, the part that is done per row: trimmed, lower case, without the remark."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s*\([^)]*\)$", "")


def resolved(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the canonical codec of a column's names."""
    table = F.broadcast(codec_dimension(df.sparkSession).select(F.col("name").alias("__name"), F.col("codec").alias(out)))
    return df.join(table, cleaned(F.col(column)) == F.col("__name"), "left").drop("__name")


def with_code_page(df: DataFrame, column: str, out: str) -> DataFrame:
    table = df.sparkSession.createDataFrame([(c, p) for c, p in dims.CODE_PAGES.items()], f"__codec string, {out} int")
    return df.join(F.broadcast(table), F.col(column) == F.col("__codec"), "left").drop("__codec")


def spellings(name: Column) -> Column:
    """The distinct spellings to try for a name, best first."""
    given = F.trim(name)
    low = F.lower(given)
    bare = F.regexp_replace(low, "[_-]", "")
    hint = F.create_map(*[F.lit(x) for pair in dims.SPELLINGS.items() for x in pair])[bare]
    iso, cp, win = r"^iso(\d{4})[-_]?(\w+)$", r"^cp(\d+)$", r"^(?:windows|ibm)[-_]?(\d+)$"
    number = F.regexp_extract(low, cp, 1)
    tries = F.array(
        given, hint, F.translate(low, "_", "-"), F.translate(low, "-", "_"), F.regexp_replace(low, "[-_](le|be)$", "$1"),
        F.when(low.endswith("-sig"), F.regexp_replace(low, "-sig$", "")),
        F.when(low.rlike(iso), F.concat(F.lit("iso-"), F.regexp_extract(low, iso, 1), F.lit("-"), F.regexp_extract(low, iso, 2))),
        F.when(low.rlike(cp), F.concat(F.lit("windows-"), number)), F.when(low.rlike(cp), F.concat(F.lit("ibm"), number)),
        F.when(low.rlike(win), F.concat(F.lit("cp"), F.regexp_extract(low, win, 1))),
    )
    return F.array_distinct(F.filter(tries, lambda t: t.isNotNull() & (t != "")))


def unaided(codec: Column) -> Column:
    """Whether a conversion may go ahead without being told the source."""
    return F.coalesce(F.replace(F.lower(codec), F.lit("_"), F.lit("-")).isin(dims.UNAIDED), F.lit(False))


def tool_spellings(codec: str) -> list[str]:
    """Names under which a converter may know a codec, best first."""
    name = codec.lower()
    dashed = name.replace("_", "-")
    out = [name, dashed]
    if m := re.fullmatch(r"cp(\d+)", name):
        n = int(m[1])
        out += ([f"windows-{n}"] if 1250 <= n <= 1258 else []) + [f"ibm{n}"]
    out += [t[k] for t, k in ((dims.DIRECT, dashed), (dims.BY_CODE_PAGE, name)) if k in t]
    if m := re.fullmatch(r"iso2022[-_](.+)", name):
        out.append(f"iso-2022-{m[1].replace('_', '-')}")
    if m := re.fullmatch(r"iso8859[-_](\d+)", name):
        out.append(f"iso-8859-{m[1]}")
    if m := re.fullmatch(r"mac[-_](.+)", name):
        out.append(f"x-mac-{m[1]}")
    return list(dict.fromkeys(out))


def first_available(df: DataFrame, candidates: str, available: DataFrame, out: str) -> DataFrame:
    """For each row the value of the first candidate name (array column) that a table (name, value) has."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    tries = rows.select("__row", F.posexplode(candidates).alias("at", "name"))
    best = tries.join(F.broadcast(available), "name").groupBy("__row").agg(F.min_by("value", "at").alias(out))
    return rows.join(best, "__row", "left").drop("__row")


# -- directories ------------------------------------------------------------------------------


def directory_codecs(dirs: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Directory, codec: a language tag off the end first, else the longest prefix of whole segments that is a codec."""
    spark = dirs.sparkSession
    table = F.broadcast(codec_dimension(spark).select("name", "codec"))
    d = dirs.select("directory").distinct().withColumn("parts", F.split(F.lower(F.trim("directory")), "-"))
    cuts = d.select("directory", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("cut"))
    cuts = cuts.withColumn("name", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), "-"))
    cuts = cuts.filter(~F.lower(F.trim("directory")).isin("none-none", ""))
    hits = cuts.join(table, "name")
    if languages is not None:
        tags = F.broadcast(languages.select(F.col("tag").alias("__tag")))
        hits = hits.join(tags, F.element_at("parts", -1) == F.col("__tag"), "left")
        stripped = F.col("__tag").isNotNull() & (F.size("parts") > 1) & (F.col("cut") == F.size("parts") - 1)
    else:
        stripped = F.lit(False)
    best = hits.groupBy("directory").agg(F.max_by("codec", F.struct(stripped.alias("s"), "cut")).alias("codec"))
    return d.select("directory").join(best, "directory", "left")


def directory_codec(directory: Column) -> Column:
    """N3 without language tags, as an expression: the longest prefix of whole segments that is a codec; the registry bounds its table."""
    table = F.create_map(*[F.lit(x) for pair in codec_names().items() for x in pair])
    low = F.lower(F.trim(directory))
    parts = F.split(low, "-")
    found = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.element_at(table, F.array_join(F.slice(parts, F.lit(1), n), "-")))
    return F.when(directory.isNotNull() & ~low.isin("none-none", ""), F.get(F.reverse(F.filter(found, lambda x: x.isNotNull())), F.lit(0)))


def language_tags(dirs: DataFrame) -> DataFrame:
    """Tag, n: what follows the longest resolving proper prefix, where two directories or more have it."""
    table = F.broadcast(codec_dimension(dirs.sparkSession).select("name", "codec"))
    d = dirs.select("directory").distinct().filter(~F.col("directory").startswith(".")).withColumn("parts", F.split(F.lower("directory"), "-"))
    cuts = d.filter(F.size("parts") > 1).select("directory", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("cut"))
    cuts = cuts.withColumn("name", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), "-")).join(table, "name")
    tag = F.array_join(F.slice("parts", F.col("cut") + 1, F.size("parts")), "-")
    best = cuts.groupBy("directory").agg(F.max_by(tag, "cut").alias("tag"))
    return best.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 2")


def catalogue_tokens(dirs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Directory, token: the longest catalogue token that is the directory or ends before a dash in it, else the directory."""
    d = dirs.select("directory").distinct()
    t = F.broadcast(tokens.select("token").distinct().filter(~F.col("token").isin(dims.SPURIOUS_TOKENS)))
    # Candidate prefixes make this an equality join: a directory has one per dash.
    parts = F.split("directory", "-")
    cut = d.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))).alias("token"))
    best = cut.join(t, "token").groupBy("directory").agg(F.max_by("token", F.length("token")).alias("token"))
    return d.join(best, "directory", "left").select("directory", F.coalesce("token", "directory").alias("token"))


# -- ground truth labels ------------------------------------------------------------------------


def token_class(token: Column, content: Column | None = None) -> Column:
    """Class of a catalogue token; utf-16 and utf-32 are settled by the bytes."""
    from .content import sniffed

    low = F.lower(token)
    out = F.when(low.isin(dims.NO_REFERENCE_TOKENS), F.lit(None)).when(low == "utf-8", "utf-8").when(low == "utf-8-sig", "utf-8-bom").when(low == "ascii", "ascii")
    for name, cls in (("utf-16-le", "utf-16LE"), ("utf-16-be", "utf-16BE"), ("utf-32-le", "utf-32LE"), ("utf-32-be", "utf-32BE")):
        out = out.when(low == name, cls)
    if content is not None:
        out = out.when(low.isin("utf-16", "utf-32"), sniffed(low, content))
    return out.otherwise("legacy")


def manifest_class(encoding: Column, bom: Column) -> Column:
    """Class of a manifest's encoding and BOM state; Binary has none."""
    low = F.lower(encoding)
    marked = F.coalesce(bom == "BOM", F.lit(False))
    out = F.when(low == "binary", F.lit(None)).when(low.isin("us-ascii", "ascii"), "ascii")
    for name in dims.BARE_CLASSES:
        out = out.when(low == name.lower(), F.when(marked, f"{name}-bom").otherwise(name))
    return out.otherwise("legacy")


def accepted_classes(expected: Column, also: Column) -> Column:
    """The classes that count as right: the expected one and those of the semicolon-separated alternatives, without BOM."""
    other = F.when(F.coalesce(F.trim(also), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(also, ";"), lambda t: manifest_class(F.trim(t), F.lit("NoBOM")))
    )
    return F.array_union(F.array(expected), other)


def bucket(encoding: Column) -> Column:
    """Population bucket of a declared encoding, whatever its BOM."""
    low = F.lower(encoding)
    out = F.when(low.isin("us-ascii", "ascii"), "us-ascii").when(low.isin("binary", *dims.NO_REFERENCE_TOKENS), "Binary").when(low == "utf-8-sig", "utf-8")
    for name in dims.BARE_CLASSES:
        out = out.when(F.replace(low, F.lit("-le"), F.lit("le")) == name.lower(), name).when(F.replace(low, F.lit("-be"), F.lit("be")) == name.lower(), name)
    return out.otherwise("Legacy")


def described(encoding: Column, bom: Column) -> Column:
    """Encoding-BOM, encoding-NoBOM or the encoding alone."""
    return F.when(bom.isin("BOM", "NoBOM"), F.concat_ws("-", encoding, bom)).otherwise(encoding)
