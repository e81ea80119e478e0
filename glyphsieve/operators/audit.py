"""The audit: a row for every file of a corpus, from its bytes to its one outcome.

Operator ids: J3, J4, J5, N12, N13, X4, F10 and the columns that dims.AUDIT_COLUMNS names; the rules are
those of the other operator modules. Three relations with a row a file meet by path, or stand in one row where the conversion is made here:

* inventory: what the files were before conversion, with their reference (C1),
* results: what the converter did, from its report (S8) or from `convert` here,
* contents: the bytes that stand there now, and the backup if there is one.

Only rows that a rule asks about reach the costly measures: other rows hand them nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import codec_layer as layer
from ..functions import content as fc
from ..functions import names
from . import classify, detect

KEY = "RelativePath"
c = F.col


def inventory(files: DataFrame, corpus: str) -> DataFrame:
    """S2 with its reference columns: files (path, content, declared, codec, bom, source) as C1 resolves them."""
    return files.select(*_listing(corpus))


def _listing(corpus: str) -> list[Column]:
    return [
        F.lit(corpus).alias("Corpus"), c("path").alias(KEY), F.octet_length("content").cast("long").alias("OriginalByteLength"), F.sha2("content", 256).alias("OriginalSha256"),
        c("declared").alias("ReferenceEncodingDeclared"), c("codec").alias("ReferenceEncoding"), c("bom").alias("ReferenceBOM"), c("source").alias("ReferenceMetadataSource"),
    ]


RESULTS = ["ConversionStatus", "DetectedEncoding", "DetectedBOM", "ResultStage", "ECReasonCode", "ECExplicitSource", "ECSourceUnsupported"]


def convert(files: DataFrame, explicit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, contents) of converting files, for callers that keep the two apart."""
    rows = converted(files, explicit)
    return rows.select(c("path").alias(KEY), *RESULTS), rows.select(c("path").alias(KEY), "current", "backup")


def converted(files: DataFrame, explicit: bool = True) -> DataFrame:
    """files (path, content, codec) with results, contents and the reference's reading, from converting them to UTF-8 in one pass.

    explicit: the reference codec is named as the source where policy needs one; where the
    converter has no name for it, the file goes unnamed and is marked so (X4).
    """
    # Each codec that has a code page is tried once, under its spellings.
    spelled = F.create_map(*[F.lit(x) for codec in dims.CODE_PAGES if (name := layer.tool_name(codec)) for x in (codec, name)])
    rows = files.withColumns({"__spelled": spelled[c("codec")], "__bytes": F.coalesce("content", F.lit(b""))})
    aided = names.unaided(c("codec"))
    named = F.when(~aided, c("__spelled")) if explicit else F.lit(None).cast("string")
    unsupported = classify.source_unsupported(c("codec"), F.lit(explicit), c("__spelled"), aided)
    rows = detect.detected_converted(rows.withColumns({"ECExplicitSource": named, "ECSourceUnsupported": F.coalesce(unsupported, F.lit(False))}), "ECExplicitSource", "__bytes", reference="codec")
    status = c("conversion.status")
    made = status == "Converted"
    return rows.withColumns({
        "ConversionStatus": status, "DetectedEncoding": c("detected_codec"), "DetectedBOM": F.when(c("detected_codec").isNotNull(), F.when(c("detected_bom"), "BOM").otherwise("NoBOM")),
        "ResultStage": c("conversion.stage"), "ECReasonCode": c("conversion.reason"), "current": F.when(made, c("conversion.output")).otherwise(c("content")), "backup": F.when(made, c("content")),
    }).drop("conversion", "__spelled", "__bytes")


def reported(report: DataFrame) -> DataFrame:
    """results from a converter's report (S8): File, Encoding, BOM, Result, ReasonCode. A remark in parentheses is no encoding."""
    encoding = F.when(~F.startswith(F.trim("Encoding"), F.lit("(")), c("Encoding"))
    rows = names.resolved(report.withColumn("__encoding", encoding), "__encoding", "__codec")
    return rows.select(
        c("File").alias(KEY), c("Result").alias("ConversionStatus"), F.coalesce("__codec", "__encoding").alias("DetectedEncoding"), F.when(c("BOM") == "Yes", "BOM").otherwise("NoBOM").alias("DetectedBOM"),
        F.lit(None).cast("string").alias("ResultStage"), c("ReasonCode").alias("ECReasonCode"), F.lit(None).cast("string").alias("ECExplicitSource"), F.lit(False).alias("ECSourceUnsupported"),
    )


def working_copy(files: DataFrame) -> DataFrame:
    """contents of a converted folder (path, content): each file with the one of the same name and .bak."""
    backups = files.filter(c("path").endswith(".bak")).select(F.expr("substring(path, 1, length(path) - 4)").alias(KEY), c("content").alias("backup"))
    return files.filter(~c("path").endswith(".bak")).select(c("path").alias(KEY), c("content").alias("current")).join(backups, KEY, "left")


def diagnosed(rows: DataFrame) -> DataFrame:
    """Rows with the production and the strict diagnosis of each backup under the detected codec, and whether that reads the same text.

    All three are had in one pass where the rows stand; others hand over nulls, so no content is shuffled for them.
    """
    wanted = c("ReferenceEncoding").isNotNull() & c("backup").isNotNull()
    other = F.when(~c("DetectionMatch") & c("reference.text").isNotNull(), c("DetectedEncoding"))
    rows = rows.withColumns({
        # What was not identified fails at detection, as any unknown name does.
        "__codec": F.when(wanted, F.coalesce("DetectedEncoding", F.lit("(none)"))), "__backup": F.when(wanted, c("backup")),
        "__other": other, "__text": F.when(other.isNotNull(), c("reference.text")), "__original": F.when(other.isNotNull(), c("original")),
    })
    found = {mode: detect.diagnosis("__codec", mode, "__backup") for mode in ("production", "strict")}
    rows = rows.withColumns(found | {"DetectionTextEquivalent": detect.equivalence("__other", "__text", "__original")})
    # A struct of nulls is no diagnosis.
    rows = rows.withColumns({mode: F.when(c("__codec").isNotNull(), c(mode)) for mode in found})
    return rows.drop("__codec", "__backup", "__other", "__text", "__original")


def strictness_of(rows: DataFrame) -> DataFrame:
    """(declared, codec) pairs with the strictness of the first spelling that can be probed. As many rows as names, not files."""
    pairs = rows.select("ReferenceEncodingDeclared", "ReferenceEncoding").filter("ReferenceEncoding IS NOT NULL").distinct()
    pairs = pairs.withColumn("tries", F.array_distinct(F.concat(names.spellings(c("ReferenceEncodingDeclared")), names.spellings(c("ReferenceEncoding")))))
    probes = detect.strictness(detect.probe_universe(rows.sparkSession, pairs.select(F.explode("tries")))).filter("available")
    found = names.first_available(pairs, "tries", probes.select("name", F.struct("decoder", "encoder").alias("value")), "strictness")
    return found.select("ReferenceEncodingDeclared", "ReferenceEncoding", c("strictness.decoder").alias("DecoderStrictness"), c("strictness.encoder").alias("EncoderStrictness"))


def _candidates(rows: DataFrame) -> list[str]:
    """The codecs that the corpus holds and the converter knows: at most the codec registry."""
    return sorted(r[0] for r in rows.select("ReferenceEncoding").distinct().collect() if r[0] in dims.CODE_PAGES)


def audit(listed: DataFrame, results: DataFrame, contents: DataFrame, forced: bool = True) -> DataFrame:
    """The audit table: inventory, results and contents to dims.AUDIT_COLUMNS."""
    # A file without a result, or without bytes, was lost on the way.
    rows = listed.join(results, KEY, "left").join(contents, KEY, "left")
    return _audit(rows, listed, forced)


def _audit(rows: DataFrame, listed: DataFrame, forced: bool) -> DataFrame:
    """The same from rows that hold all three; reference too, where the original was read on the way."""
    rows = names.with_code_page(rows, "ReferenceEncoding", "ReferenceCodePage")
    lost = c("ConversionStatus").isNull() | (c("current").isNull() & c("backup").isNull())
    rows = rows.withColumn("ConversionStatus", F.when(lost, "MissingConvertedFile").otherwise(c("ConversionStatus")))
    rows = rows.join(F.broadcast(strictness_of(listed)), ["ReferenceEncodingDeclared", "ReferenceEncoding"], "left")
    rows = names.with_code_page(rows, "DetectedEncoding", "DetectedCodePage")
    rows = rows.withColumns({"current": F.coalesce("current", F.lit(b"")), "original": F.coalesce("backup", "current", F.lit(b""))})
    sha = lambda x: F.sha2(c(x), 256)
    size = lambda x: F.octet_length(x).cast("long")
    rows = rows.withColumns({
        "BackupByteLength": size("backup"), "ConvertedByteLength": size("current"), "BackupSha256": F.when(c("backup").isNotNull(), sha("backup")), "ConvertedSha256": sha("current"),
        "ByteIdentical": c("original") == c("current"), "OriginalBOMKind": fc.bom_kind(c("original")),
    })
    match, basis = classify.match(c("ReferenceEncoding"), c("DetectedEncoding"), c("ReferenceCodePage"), c("DetectedCodePage"))
    rows = rows.withColumns({
        "BackupIntegrity": classify.backup_integrity(c("BackupSha256"), c("OriginalSha256"), c("ConversionStatus")), "OriginalBOM": F.when(c("OriginalBOMKind") == "", "NoBOM").otherwise("BOM"),
        "DetectionMatch": match, "DetectionBasis": basis, "DetectionLabelExact": F.when(c("ReferenceEncoding").isNotNull(), F.coalesce(c("DetectedEncoding") == c("ReferenceEncoding"), F.lit(False))),
    })
    return _judged(_texts(rows), _candidates(listed), forced)


def _texts(rows: DataFrame) -> DataFrame:
    """The texts before and after, whether they are one, and where they part."""
    if "reference" not in rows.columns:
        rows = detect.reference_text(rows, "ReferenceEncoding", "original")
    readable = F.is_valid_utf8(c("current").cast("string")) & ~F.coalesce(c("reference.verdict") == "ReferenceDecodeError", F.lit(False)) & ((F.octet_length("current") > 0) | (c("ConversionStatus") == "Converted"))
    rows = rows.withColumn("made", F.when(readable, fc.strip_bom(c("current").cast("string"))))
    same = F.when(classify.comparable(c("ConversionStatus"), c("reference.text"), c("made")), c("reference.text") == c("made"))
    rows = rows.withColumn("TextIdentical", same)
    rows = rows.withColumn("difference", F.when(~c("TextIdentical"), fc.first_difference(c("reference.text"), c("made"))))
    return diagnosed(rows)


def _judged(rows: DataFrame, candidates: list[str], forced: bool) -> DataFrame:
    """Evidence, verdicts and the columns' names."""
    doubtful = c("ReferenceCodePage").isNotNull() & c("DetectedEncoding").isNotNull() & ~c("DetectionMatch") & ~F.coalesce("DetectionTextEquivalent", F.lit(False))
    rows = rows.withColumns({"__doubt": F.when(doubtful, c("ReferenceEncoding")), "__bytes": F.when(doubtful, c("original"))})
    rows = detect.evidence(rows, "__doubt", "DetectedEncoding", candidates, "__bytes")
    e, p, s = (lambda n: c(f"evidence.{n}")), (lambda n: c(f"production.{n}")), (lambda n: c(f"strict.{n}"))
    throws = s("stage") == "Decode"
    rows = rows.withColumns({
        "ECStrictDecodeOutcome": F.when(c("strict").isNotNull(), F.when(throws, "Throws").otherwise("Accepts")), "ConversionErrorStage": F.coalesce(p("stage"), c("ResultStage")),
        "DetectionOutcome": classify.detection_outcome(c("ReferenceEncoding"), c("ReferenceCodePage"), c("DetectedEncoding"), c("DetectionMatch"), c("DetectionTextEquivalent"), e("accepted"), e("constraint")),
    })
    rows = rows.withColumn("ECImplementationDefect", F.coalesce((c("ECStrictDecodeOutcome") == "Throws") & p("stage").isNull(), F.lit(False)))
    cascade = classify.outcome(
        c("ReferenceMetadataSource"), c("ReferenceEncoding"), c("ReferenceEncodingDeclared"), c("ECSourceUnsupported"), c("BackupIntegrity"), c("ConversionStatus"),
        c("ConversionErrorStage"), c("reference.verdict"), c("TextIdentical"), c("ByteIdentical"), c("DetectionMatch"), c("ECStrictDecodeOutcome") == "Throws",
    )
    binary = (c("ReferenceEncodingDeclared") == "Binary") & c("ReferenceEncoding").isNull()
    rows = rows.withColumn("FailureCategory", F.when(binary, classify.binary_verdict(c("ConversionStatus"), c("ByteIdentical"))).otherwise(cascade))
    rows = rows.withColumn("__sha256", c("reference.sha256"))
    if forced:
        rows = detect.forced_reference(rows, "ReferenceEncoding", "__sha256", "FailureCategory", "original")
    else:
        rows = rows.withColumn("forced", F.lit(None).cast("string"))
    d = lambda n: c(f"difference.{n}")
    rows = rows.withColumns({
        "PlausibleCodecCount": e("n_plausible"), "DistinctReadings": e("n_readings"), "PlausibleCodecs": e("plausible"), "ReferenceConstraint": e("constraint"),
        "ConversionErrorType": p("error"), "ConversionErrorMessage": p("message"), "ReferenceTextLength": c("reference.length"), "ReferenceTextSha256": c("__sha256"),
        "ConvertedTextLength": F.length("made"), "ConvertedTextSha256": F.when(c("made").isNotNull(), fc.text_sha256(c("made"))), "ECProductionTextSha256": p("sha256"),
        "FirstDifferenceIndex": d("index"), "ReferenceCodePoint": d("code_point_a"), "ConvertedCodePoint": d("code_point_b"), "ReferenceChar": d("char_a"), "ConvertedChar": d("char_b"),
        "ContextBefore": d("before"), "ContextAfter": d("after"), "ForcedReferenceOutcome": c("forced"), "CorpusRoundTrip": c("reference.round_trip"),
    })
    return rows.select(*dims.AUDIT_COLUMNS)


def audited(files: DataFrame, corpus: str, explicit: bool = True, forced: bool = True) -> DataFrame:
    """The audit of resolved files (path, content, declared, codec, bom, source) with the conversion made here: all of a file stays in its row, nothing is joined by path."""
    rows = converted(files, explicit).select(*_listing(corpus), *RESULTS, "current", "backup", "reference")
    return _audit(rows, inventory(files, corpus), forced)
