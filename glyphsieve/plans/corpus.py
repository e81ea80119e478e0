"""Relations that the registered queries run on, made from the documents table.

`corpus`: every document as a byte file in one of twelve encodings. `fixture`: an audit table whose
columns are spread over all cases by arithmetic on doc_id; its expressions are plain SQL that
any engine can evaluate, so the reference queries use the same list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify

#: (declared encoding, BOM state, mark, class) by doc_id % 12.
VARIANTS = [
    ("utf-8", "NoBOM", "", "utf-8"), ("utf-8", "BOM", "EFBBBF", "utf-8-bom"), ("utf-16LE", "NoBOM", "", "utf-16LE"), ("utf-16LE", "BOM", "FFFE", "utf-16LE-bom"),
    ("utf-16BE", "NoBOM", "", "utf-16BE"), ("utf-16BE", "BOM", "FEFF", "utf-16BE-bom"), ("utf-32LE", "NoBOM", "", "utf-32LE"), ("utf-32LE", "BOM", "FFFE0000", "utf-32LE-bom"),
    ("utf-32BE", "NoBOM", "", "utf-32BE"), ("utf-32BE", "BOM", "0000FEFF", "utf-32BE-bom"), ("iso-8859-1", "NoBOM", "", "legacy"), ("us-ascii", "NoBOM", "", "ascii"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def by_variant(values: list[str], key: str = "v") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) + 1).cast("int"))


def encoded(text: Column, v: Column) -> Column:
    """The bytes of a text in its variant, without mark."""
    little = F.unhex(F.regexp_replace(F.hex(F.encode(text, "UTF-32")), "(..)(..)(..)(..)", "$4$3$2$1"))
    ascii_only = F.regexp_replace(text, "[^\\x00-\\x7F]", "?")
    return (
        F.when(v < 2, F.encode(text, "UTF-8")).when(v < 4, F.encode(text, "UTF-16LE")).when(v < 6, F.encode(text, "UTF-16BE"))
        .when(v < 8, little).when(v < 10, F.encode(text, "UTF-32")).when(v == 10, F.encode(text, "ISO-8859-1")).otherwise(F.encode(ascii_only, "UTF-8"))
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, declared, bom, expected, bucket-ready names, text and content."""
    rows = documents(spark, sf_dir).withColumn("v", F.col("doc_id") % 12)
    content = F.concat(F.unhex(by_variant([m for _, _, m, _ in VARIANTS])), encoded(F.col("text"), F.col("v")))
    return rows.select(
        "doc_id", F.concat(by_variant([d for d, *_ in VARIANTS]), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        by_variant([d for d, *_ in VARIANTS]).alias("declared"), by_variant([b for _, b, _, _ in VARIANTS]).alias("bom"),
        by_variant([c for *_, c in VARIANTS]).alias("expected"), F.when(F.col("v") == 11, F.regexp_replace("text", "[^\\x00-\\x7F]", "?")).otherwise(F.col("text")).alias("text"), content.alias("content"),
    )


#: Letters of the documents in the order of their frequency, and common signs of other scripts that stand for them.
_LETTERS = "eanitrsouhldcgmpfbvwykqxjz"
SCRIPTS = {
    "cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжш", "kana": "のいたにしとるはをがてでなっれかさもうらりあすこきま", "han": "的一是不在人有我他这个中大来上国和地到以时要就出会可", "hangul": "이다는을의에가고하지한를도로사기아나자리어그대서일보",
}
#: Encodings and the script that their files are written in.
LEGACY = [
    ("koi8-r", "cyrillic"), ("cp1251", "cyrillic"), ("cp866", "cyrillic"), ("iso8859-5", "cyrillic"), ("euc_jp", "kana"), ("shift_jis", "kana"), ("iso2022_jp", "kana"),
    ("gb18030", "han"), ("big5", "han"), ("euc_kr", "hangul"), ("cp1252", "latin"),
]


def legacy_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, declared and content: each document in another script and a legacy encoding of it, every eleventh cut before its last byte."""
    from ..operators.detect import java_charsets, JVM

    rows = documents(spark, sf_dir).withColumn("v", F.floor(F.col("doc_id") / 2) % len(LEGACY))
    plain = F.regexp_replace(F.lower("text"), "[^\\x00-\\x7F]", "e")
    # Big5 has traditional forms only.
    forms = {"这": "這", "个": "個", "来": "來", "国": "國", "时": "時", "会": "會"}
    out = F.lit(None).cast("binary")
    with java_charsets(spark):
        for i, (codec, script) in enumerate(LEGACY):
            signs = SCRIPTS.get(script)
            if codec == "big5":
                signs = "".join(forms.get(x, x) for x in signs)
            text = F.translate(plain, _LETTERS, signs) if signs else F.concat(F.lit("“"), F.col("text"), F.lit("”"))
            out = F.when(F.col("v") == i, F.encode(F.when(F.col("v") == i, text), JVM[codec])).otherwise(out)
        rows = rows.select("doc_id", by_variant([x for x, _ in LEGACY]).alias("declared"), out.alias("content"))
    return rows.withColumn("content", F.when(F.col("doc_id") % 11 == 5, F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(F.col("content")))


#: Portable expressions of the audit fixture over doc_id, in order; later ones may use earlier columns by nesting.
_CODEC = "CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'shift_jis' WHEN 2 THEN 'koi8-r' WHEN 3 THEN 'cp1252' ELSE 'utf-16-le' END"
_SOURCE = "CASE WHEN doc_id % 53 = 0 THEN 'OutOfScope' WHEN doc_id % 59 = 0 THEN 'NoReferenceEncoding' WHEN doc_id % 61 = 0 THEN 'MetadataConflict' ELSE 'Manifest' END"
_DECLARED = f"CASE WHEN doc_id % 67 = 0 THEN 'Binary' WHEN doc_id % 13 = 0 THEN 'viscii' ELSE {_CODEC} END"
_REFERENCE = f"CASE WHEN doc_id % 53 = 0 OR doc_id % 59 = 0 OR doc_id % 61 = 0 OR doc_id % 67 = 0 OR doc_id % 13 = 0 THEN NULL ELSE {_CODEC} END"
_DETECTED = f"CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'cp1252' ELSE {_CODEC} END"
_PAGE = "CASE {0} WHEN 'utf-8' THEN 65001 WHEN 'shift_jis' THEN 932 WHEN 'koi8-r' THEN 20866 WHEN 'cp1252' THEN 1252 WHEN 'utf-16-le' THEN 1200 END"
_STATUS = "CASE doc_id % 19 WHEN 0 THEN 'Skipped' WHEN 1 THEN 'Refused' WHEN 2 THEN 'Error' WHEN 3 THEN 'MissingConvertedFile' WHEN 4 THEN 'Unchanged' WHEN 5 THEN 'Unchanged' ELSE 'Converted' END"
_SAME = "(doc_id % 19 IN (4, 5) OR doc_id % 23 = 0)"
_TEXT = f"CASE WHEN ({_REFERENCE}) IS NULL OR doc_id % 19 < 4 THEN NULL ELSE doc_id % 10 <> 0 END"
FIXTURE = [
    ("doc_id", "doc_id"), ("CASE doc_id % 4 WHEN 0 THEN 'uts3' WHEN 1 THEN 'chardet' WHEN 2 THEN 'charsetnormalizer' ELSE 'utfunknown26' END", "Corpus"),
    ("concat('d', CAST(doc_id % 7 AS varchar(20)), '/f', CAST(doc_id AS varchar(20)), '.txt')", "RelativePath"),
    (_SOURCE, "ReferenceMetadataSource"), (_DECLARED, "ReferenceEncodingDeclared"), (_REFERENCE, "ReferenceEncoding"), (_DETECTED, "DetectedEncoding"),
    (f"CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_PAGE.format(f'({_REFERENCE})')} END", "ReferenceCodePage"), (_PAGE.format(f"({_DETECTED})"), "DetectedCodePage"),
    ("CASE WHEN doc_id % 2 = 0 THEN 'NoBOM' ELSE 'BOM' END", "ReferenceBOM"), ("CASE WHEN doc_id % 2 = 0 OR doc_id % 29 = 0 THEN 'NoBOM' ELSE 'BOM' END", "OriginalBOM"),
    (_STATUS, "ConversionStatus"), ("CASE WHEN doc_id % 19 = 2 THEN CASE doc_id % 3 WHEN 0 THEN 'Decode' WHEN 1 THEN 'Encode' ELSE 'Write' END END", "ConversionErrorStage"),
    ("CASE WHEN doc_id % 19 = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'ExplicitSourceConflictsWithDetection' ELSE 'LegacySourceNotNamed' END END", "ECReasonCode"),
    ("doc_id % 83 = 0", "ECSourceUnsupported"), (_SAME, "ByteIdentical"), (_TEXT, "TextIdentical"),
    ("CASE WHEN doc_id % 7 = 0 THEN doc_id % 3 = 0 END", "DetectionTextEquivalent"), ("doc_id % 4 <> 1", "accepted"), ("CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CAST(doc_id % 9 AS double) * 0.03 END", "ReferenceConstraint"),
    ("CASE WHEN doc_id % 101 = 0 THEN 'ReferenceDecodeError' WHEN doc_id % 103 = 0 THEN 'CorpusByteOrderMislabel' END", "preset"), ("doc_id % 6 = 0", "strict_throws"),
    ("md5(concat('o', CAST(doc_id AS varchar(20))))", "OriginalSha256"), ("CASE WHEN doc_id % 89 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN 'x' ELSE md5(concat('o', CAST(doc_id AS varchar(20)))) END", "BackupSha256"),
    (f"CASE WHEN {_SAME} AND doc_id % 71 <> 0 THEN md5(concat('o', CAST(doc_id AS varchar(20)))) ELSE md5(concat('c', CAST(doc_id AS varchar(20)))) END", "ConvertedSha256"),
    (f"CASE WHEN ({_REFERENCE}) IS NOT NULL THEN md5(concat('t', CAST(doc_id AS varchar(20)))) END", "ReferenceTextSha256"),
    (f"CASE WHEN ({_TEXT}) IS NULL THEN NULL WHEN ({_TEXT}) AND doc_id % 73 <> 0 THEN md5(concat('t', CAST(doc_id AS varchar(20)))) ELSE md5(concat('u', CAST(doc_id AS varchar(20)))) END", "ConvertedTextSha256"),
    ("(doc_id * 7919) % 400000", "OriginalByteLength"), ("CASE WHEN doc_id % 10 = 0 THEN doc_id % 40 END", "FirstDifferenceIndex"),
    ("CASE WHEN doc_id % 10 = 0 THEN concat('U+00E', CAST(doc_id % 7 AS varchar(20))) END", "ReferenceCodePoint"), ("CASE WHEN doc_id % 10 = 0 THEN concat('U+30A', CAST(doc_id % 3 AS varchar(20))) END", "ConvertedCodePoint"),
    ("doc_id % 6 = 0 AND doc_id % 4 = 0", "ECImplementationDefect"), ("CASE WHEN doc_id % 6 = 0 THEN 'Throws' ELSE 'Decodes' END", "ECStrictDecodeOutcome"), ("doc_id % 8 <> 0", "CorpusRoundTrip"),
]


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(*[f"{e} AS `{n}`" for e, n in FIXTURE])


def verdicts(rows: DataFrame) -> DataFrame:
    """A fixture with BackupIntegrity, DetectionMatch, DetectionBasis, DetectionOutcome and FailureCategory from the operators."""
    c = F.col
    rows = rows.withColumn("BackupIntegrity", classify.backup_integrity(c("BackupSha256"), c("OriginalSha256"), c("ConversionStatus")))
    match, basis = classify.match(c("ReferenceEncoding"), c("DetectedEncoding"), c("ReferenceCodePage"), c("DetectedCodePage"))
    rows = rows.withColumns({"DetectionMatch": match, "DetectionBasis": basis})
    rows = rows.withColumn(
        "DetectionOutcome",
        classify.detection_outcome(c("ReferenceEncoding"), c("ReferenceCodePage"), c("DetectedEncoding"), c("DetectionMatch"), c("DetectionTextEquivalent"), c("accepted"), c("ReferenceConstraint")),
    )
    cascade = classify.outcome(
        c("ReferenceMetadataSource"), c("ReferenceEncoding"), c("ReferenceEncodingDeclared"), c("ECSourceUnsupported"), c("BackupIntegrity"), c("ConversionStatus"),
        c("ConversionErrorStage"), c("preset"), c("TextIdentical"), c("ByteIdentical"), c("DetectionMatch"), c("strict_throws"),
    )
    return rows.withColumn("FailureCategory", F.when((c("ReferenceEncodingDeclared") == "Binary") & c("preset").isNull(), classify.binary_verdict(c("ConversionStatus"), c("ByteIdentical"))).otherwise(cascade))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(fixture(spark, sf_dir))


def second_run(rows: DataFrame) -> DataFrame:
    """A later run of the same audit: some files gone, one new, some outcomes moved."""
    moved = F.when(F.col("doc_id") % 14 == 0, "ECCodecUnsupported").when(F.col("doc_id") % 15 == 0, "PASS").otherwise(F.col("FailureCategory"))
    kept = rows.filter("doc_id % 37 != 5").withColumn("FailureCategory", moved)
    return kept.withColumn("RelativePath", F.when(F.col("doc_id") % 41 == 7, F.concat("RelativePath", F.lit(".new"))).otherwise(F.col("RelativePath")))
