"""Rule cascades: one category per row. Operator ids: F1-F11, C1-C6, C8, N11, N14, X4, X6, X7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def false(c: Column) -> Column:
    return F.coalesce(~c, F.lit(False))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- scope ---------------------------------------------------------------------------------------


def relative(path: Column) -> Column:
    """forward slashes, none in front."""
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def matches(path: Column, pattern: str = "*") -> Column:
    """the file name fits a wildcard (* and ?), whatever its case."""
    import re

    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return basename(path).rlike(f"(?is)^{regex}$")


def scope(path: Column, strict: bool = True) -> Column:
    """ExcludedByEC, OutOfScope, SidecarDirectory, or null. strict False: only the first (manifest corpora)."""
    dirs = F.transform(directories(path), F.lower)
    within = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    out = F.when(within(dims.EXCLUDED_DIRS), "ExcludedByEC")
    if strict:
        out = out.when(within(dims.OUT_OF_SCOPE_DIRS) | F.lower(basename(path)).isin(dims.OUT_OF_SCOPE_NAMES), "OutOfScope")
        out = out.when(F.exists(directories(path), lambda d: d.startswith("_")), "SidecarDirectory")
    return out


def no_reference(token: Column) -> Column:
    """F7."""
    return F.lower(F.trim(token)).isin(dims.NO_REFERENCE_TOKENS)


def filename_token(path: Column) -> Column:
    """The encoding that a DOC file's name states as its fifth part, else null."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    p = F.split(stem, "_")
    return F.when(basename(path).startswith("DOC") & (F.size(p) >= 5), F.get(p, F.lit(4)))


def resolve_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """C1, F8, J1 for manifest corpora: files (path) with declared, codec, bom and source.

    manifest: RelativePath, Encoding, BOM. Matched by exact path; a name that states another codec is a conflict.
    """
    from ..functions.names import resolved

    m = manifest.select(F.col("RelativePath").alias("path"), F.col("Encoding").alias("__enc"), F.col("BOM").alias("__bom"))
    rows = files.join(m, "path", "left").withColumns({"__token": filename_token(F.col("path")), "__scope": scope(F.col("path"), False)})
    rows = resolved(resolved(rows, "__enc", "__codec"), "__token", "__named")
    known = F.col("__scope").isNull() & F.col("__enc").isNotNull()
    conflict = (F.col("__enc") != "Binary") & F.col("__named").isNotNull() & F.col("__codec").isNotNull() & (F.col("__named") != F.col("__codec"))
    source = (
        F.when(F.col("__scope").isNotNull(), F.col("__scope")).when(F.col("__enc").isNull(), "NotInManifest").when(F.col("__enc") == "Binary", "Manifest")
        .when(conflict, "MetadataConflict").when(F.col("__named").isNotNull(), "Manifest+Filename").otherwise("Manifest")
    )
    rows = rows.withColumns({"source": source, "declared": F.when(known, F.col("__enc")).otherwise(""), "bom": F.when(known, F.coalesce("__bom", F.lit(""))).otherwise("")})
    rows = rows.withColumn("codec", F.when(known & (F.col("__enc") != "Binary") & ~true(conflict), F.col("__codec")))
    return rows.drop("__enc", "__bom", "__codec", "__token", "__named", "__scope")


def resolve_directories(files: DataFrame, top: bool, languages: DataFrame | None = None) -> DataFrame:
    """C1 for directory corpora: files (path) with declared, codec, bom and source, from the top or the parent directory."""
    from ..functions.names import directory_codec, directory_codecs

    dirs = directories(F.col("path"))
    token = F.when(F.size(dirs) > 0, F.element_at(dirs, 1 if top else -1))
    rows = files.withColumns({"__scope": scope(F.col("path")), "__token": token})
    inside = F.col("__scope").isNull() & F.col("__token").isNotNull()
    if languages is None:
        # A few directories can hold all files, so contents are not dealt by their names.
        rows = rows.withColumn("__codec", directory_codec(F.when(inside, F.col("__token"))))
    else:
        codecs = directory_codecs(rows.filter(inside).select(F.col("__token").alias("directory")), languages)
        # One row per distinct directory name.
        rows = rows.join(codecs.withColumnRenamed("directory", "__token").withColumnRenamed("codec", "__codec"), "__token", "left")
    none = true(no_reference(F.col("__token")))
    source = F.coalesce(F.col("__scope"), F.when(F.col("__token").isNull(), "OutOfScope").when(none, "NoReferenceEncoding").otherwise("TopLevelDirectory" if top else "ParentDirectory"))
    rows = rows.withColumns({"source": source, "declared": F.when(inside, F.col("__token")).otherwise(""), "bom": F.lit("")})
    return rows.withColumn("codec", F.when(inside & ~none, F.col("__codec"))).drop("__scope", "__token", "__codec")


# -- predicates --------------------------------------------------------------------------------------


def scored(outcome: Column) -> Column:
    """F9."""
    return ~outcome.isin(dims.UNSCORED)


def comparable(status: Column, reference: Column, made: Column) -> Column:
    """both texts are known and the tool claims success."""
    return reference.isNotNull() & made.isNotNull() & status.isin("Converted", "Unchanged")


def source_unsupported(codec: Column, explicit_run: Column, spelling: Column, aided: Column) -> Column:
    """A source had to be named, and the converter knows it under no name."""
    return codec.isNotNull() & explicit_run & spelling.isNull() & ~aided


def backup_integrity(backup: Column, original: Column, status: Column) -> Column:
    """By the digests of backup (null if there is none) and original."""
    return F.when(backup.isNotNull(), F.when(backup == original, "Verified").otherwise("Mismatch")).when(status == "Converted", "Missing").otherwise("NotApplicable")


def match(reference: Column, detected: Column, reference_page: Column, detected_page: Column) -> tuple[Column, Column]:
    """(match, basis): by code page if both have one, else by canonical name. Null without a reference."""
    both = reference_page.isNotNull() & detected_page.isNotNull()
    same = F.when(both, reference_page == detected_page).otherwise(F.coalesce(reference == detected, F.lit(False)))
    return F.when(reference.isNotNull(), same), F.when(reference.isNotNull(), F.when(both, "CodePage").otherwise("CodecName"))


# -- verdicts ------------------------------------------------------------------------------------------


def detection_outcome(reference: Column, page: Column, detected: Column, matched: Column, equivalent: Column, accepted: Column, constraint: Column) -> Column:
    """The detection taxonomy; evidence is a detected codec that fails on the file, or a reference that constrains it."""
    return (
        F.when(reference.isNull(), "NoReference").when(page.isNull(), "NoDotNetCodec").when(detected.isNull(), "NotIdentified")
        .when(true(matched), "ExactMatch").when(true(equivalent), "TextEquivalent")
        .when(false(accepted) | true(constraint >= dims.CONSTRAINT_FLOOR), "Misdetection").otherwise("StructurallyAmbiguous")
    )


def binary_verdict(status: Column, byte_identical: Column) -> Column:
    """C4: a file with no encoding is right to be left alone."""
    return F.when(status == "Skipped", "UnknownEncoding").when(status == "Refused", "RefusedByPolicy").when(status == "Error", "DecodeError").when(true(byte_identical), "NoOpCorrect").otherwise("Misdetection")


def outcome(
    source: Column, reference: Column, declared: Column, unsupported: Column, backup: Column, status: Column, stage: Column, preset: Column,
    text_identical: Column, byte_identical: Column, matched: Column, strict_throws: Column,
) -> Column:
    """Exactly one outcome for a row. A preset verdict outranks everything; then scope, sources, backups, statuses, text."""
    return (
        F.when(preset.isNotNull(), preset)
        .when(source.isin(dims.OUT_OF_SCOPE_SOURCES), "OutOfScope").when(source.isin("NoReferenceEncoding", "MetadataConflict"), source)
        .when(reference.isNull() & (F.coalesce(declared, F.lit("")) != "") & (declared != "Binary"), "UnknownReferenceEncoding")
        .when(true(unsupported), "ECCodecUnsupported")
        .when(backup == "Mismatch", "BackupIntegrityFailure").when(backup == "Missing", "MissingBackup")
        .when(status == "MissingConvertedFile", "MissingConvertedFile").when(status == "Skipped", "UnknownEncoding").when(status == "Refused", "RefusedByPolicy")
        .when(status == "Error", F.when(stage == "Encode", "EncodeError").when(stage == "Write", "WriteError").otherwise("DecodeError"))
        .when(true(text_identical), F.when(true(byte_identical) & false(matched), "NoOpMislabeled").otherwise("PASS"))
        .when(true(byte_identical), "NoOpMislabeled").when(true(strict_throws) & true(matched), "SilentDecodeLoss")
        .when(false(matched), "Misdetection").otherwise("MappingDifference")
    )


def mismatch_type(expected: Column, actual: Column) -> Column:
    """C5."""
    return F.when(actual.isNull(), "FalseNegative").when(expected.isNull(), "FalsePositive").otherwise("Misclassified")


def correct(expected: Column, actual: Column, accepted: Column | None = None) -> Column:
    """Equal (nothing named for nothing to name included), or among the accepted classes."""
    same = expected.eqNullSafe(actual)
    return same if accepted is None else same | F.coalesce(F.array_contains(accepted, actual), F.lit(False))


def severity(o: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.SEVERITY.items() for x in pair])
    return F.coalesce(table[o], F.lit(dims.WORST))


def transition(before: Column, after: Column) -> Column:
    """C8."""
    a, b = severity(before), severity(after)
    return F.when(b < a, "Improved").when(b > a, "Regressed").otherwise("Lateral")


def exit_code(problems: int, regressions: int, strict: bool) -> int:
    """2 if the audit itself did not hold, 1 for regressions under strict, else 0."""
    return 2 if problems else 1 if strict and regressions else 0
