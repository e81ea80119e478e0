"""Closed vocabularies and thresholds. All lists here are fixed values that results depend on."""

from __future__ import annotations

# Classes in display order; None (undetected) is not a class.
BOM_CLASSES = ["utf-8-bom", "utf-16LE-bom", "utf-16BE-bom", "utf-32LE-bom", "utf-32BE-bom"]
BARE_CLASSES = ["utf-8", "utf-16LE", "utf-16BE", "utf-32LE", "utf-32BE"]
CLASSES = [*BOM_CLASSES, *BARE_CLASSES, "ascii", "legacy"]
UNDETECTED = "(undetected)"
BUCKETS = ["utf-8", "utf-16BE", "utf-16LE", "utf-32BE", "utf-32LE", "us-ascii", "Legacy", "Binary"]

# Outcomes, and those that are not scored or speak of the audit itself.
OUTCOMES = [
    "PASS", "NoOpCorrect", "NoOpMislabeled", "RefusedByPolicy", "Misdetection", "MappingDifference", "SilentDecodeLoss", "UnknownEncoding",
    "DecodeError", "EncodeError", "WriteError", "ReferenceDecodeError", "MetadataConflict", "BackupIntegrityFailure", "MissingBackup",
    "MissingConvertedFile", "CorpusRoundTripFailure", "UnknownReferenceEncoding", "ECCodecUnsupported", "AuditInfrastructureFailure",
    "OutOfScope", "NoReferenceEncoding", "CorpusByteOrderMislabel",
]
UNSCORED = ["OutOfScope", "NoReferenceEncoding", "UnknownReferenceEncoding", "ECCodecUnsupported", "MetadataConflict", "CorpusByteOrderMislabel", "RefusedByPolicy"]
INFRASTRUCTURE = ["BackupIntegrityFailure", "MissingBackup", "MissingConvertedFile", "AuditInfrastructureFailure"]
NO_COMPARISON = ["UnknownEncoding", "DecodeError", "EncodeError", "WriteError", "ReferenceDecodeError", "MissingConvertedFile", "MissingBackup", "BackupIntegrityFailure"]
STATUSES = ["Converted", "Unchanged", "Skipped", "Refused", "Error", "MissingConvertedFile"]
DETECTION_OUTCOMES = ["ExactMatch", "TextEquivalent", "StructurallyAmbiguous", "Misdetection", "NoDotNetCodec", "NoReference", "NotIdentified"]
JUDGED = ["ExactMatch", "TextEquivalent", "StructurallyAmbiguous", "Misdetection"]
OUT_OF_SCOPE_SOURCES = ["OutOfScope", "NotInManifest", "ExcludedByEC", "SidecarDirectory"]
TEXT_CAUSES = ["Misdetection", "MappingDifference", "SilentDecodeLoss", "NoOpMislabeled"]

# Severity of an outcome; anything else is 9.
SEVERITY = {
    "PASS": 0, "NoOpCorrect": 0,
    "OutOfScope": 1, "NoReferenceEncoding": 1, "UnknownReferenceEncoding": 1, "ECCodecUnsupported": 1, "MetadataConflict": 1, "CorpusByteOrderMislabel": 1,
    "UnknownEncoding": 2, "RefusedByPolicy": 2,
    "DecodeError": 3, "EncodeError": 3, "WriteError": 3, "ReferenceDecodeError": 3,
    "NoOpMislabeled": 4, "MappingDifference": 5, "Misdetection": 6, "SilentDecodeLoss": 7,
    "BackupIntegrityFailure": 8, "MissingBackup": 8, "MissingConvertedFile": 8, "AuditInfrastructureFailure": 8, "CorpusRoundTripFailure": 8,
}
WORST, ABSENT = 9, "(absent)"

# Scope.
EXCLUDED_DIRS = [".git", ".svn", ".hg", ".vs", ".idea", "bin", "obj", "node_modules", "packages", "dist", "build", "target"]
OUT_OF_SCOPE_NAMES = ["readme.md", "catalog.md", "claude.md", ".gitignore", ".gitattributes", "license", "license.md", "license-corpus", "pyproject.toml"]
OUT_OF_SCOPE_DIRS = ["scripts"]
NO_REFERENCE_TOKENS = ["none", "none-none"]
SPURIOUS_TOKENS = ["utf-16-be", "utf-32-be"]

# Names of codecs.
ALIASES = {
    "shift-jis": "shift_jis", "ks_c_5601-1987": "euc_kr", "x-mac-ce": "mac_latin2", "x-mac-cyrillic": "mac_cyrillic",
    "hz-gb-2312": "hz", "x-cp50227": "iso2022_cn", "utf-8-sig": "utf-8-sig",
}
SPELLINGS = {
    "cp949": "ks_c_5601-1987", "maclatin2": "x-mac-ce", "maccyrillic": "x-mac-cyrillic", "macroman": "macintosh", "macgreek": "x-mac-greek",
    "macturkish": "x-mac-turkish", "maciceland": "x-mac-icelandic", "hz": "hz-gb-2312", "cp932": "shift_jis",
}
DIRECT = {
    "utf-16-le": "utf-16le", "utf-16-be": "utf-16be", "utf-32-le": "utf-32le", "utf-32-be": "utf-32be", "utf-8-sig": "utf-8",
    "mac-cyrillic": "x-mac-cyrillic", "mac-roman": "macintosh", "mac-latin2": "x-mac-ce", "mac-greek": "x-mac-greek",
    "mac-turkish": "x-mac-turkish", "mac-iceland": "x-mac-icelandic", "hz": "hz-gb-2312",
}
BY_CODE_PAGE = {"cp932": "shift_jis", "cp936": "gb2312", "cp949": "ks_c_5601-1987", "cp950": "big5", "cp874": "windows-874", "cp65001": "utf-8"}
UNAIDED = [
    "ascii", "us-ascii", "utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-16le", "utf-16be", "utf-32", "utf-32-le", "utf-32-be", "utf-32le", "utf-32be",
]
BASELINE = [
    "utf-8", "us-ascii", "utf-16le", "utf-16be", "utf-32le", "utf-32be", "euc-jp", "shift_jis", "big5", "gb18030", "gb2312", "euc-kr",
    "iso-2022-kr", "windows-1252", "iso-8859-1", "koi8-r",
]
ACKNOWLEDGED_TOKENS = [("utf-16-be", "utf-16"), ("utf-32-be", "utf-32")]
#: Python codec to the platform's code page; a codec without one cannot be named by the tool.
CODE_PAGES = {
    "ascii": 20127, "utf-8": 65001, "utf-8-sig": 65001, "utf-16": 1200, "utf-16-le": 1200, "utf-16-be": 1201, "utf-32": 12000, "utf-32-le": 12000, "utf-32-be": 12001, "utf-7": 65000,
    "euc_jp": 51932, "shift_jis": 932, "cp932": 932, "big5": 950, "cp950": 950, "gb18030": 54936, "gb2312": 936, "gbk": 936, "cp949": 949, "euc_kr": 51949,
    "iso2022_jp": 50220, "iso2022_kr": 50225, "hz": 52936, "koi8-r": 20866, "koi8-u": 21866, "johab": 1361,
    "mac-roman": 10000, "mac-greek": 10006, "mac-cyrillic": 10007, "mac-latin2": 10029, "mac-iceland": 10079, "mac-turkish": 10081,
    "iso8859-1": 28591, "iso8859-2": 28592, "iso8859-3": 28593, "iso8859-4": 28594, "iso8859-5": 28595, "iso8859-6": 28596, "iso8859-7": 28597,
    "iso8859-8": 28598, "iso8859-9": 28599, "iso8859-13": 28603, "iso8859-15": 28605,
} | {f"cp{n}": n for n in (437, 720, 737, 775, 850, 852, 855, 857, 858, 860, 861, 862, 863, 864, 865, 866, 869, 874, *range(1250, 1259))}

# Thresholds.
SAMPLE_BYTES, ENTROPY_BYTES, ENTROPY_BITS = 65_536, 512, 7.4
UTF32_BYTES, UTF16_BYTES, NUL_HIGH, NUL_LOW, NUL_FLOOR, CHI_SQUARE = 16, 10, 0.5, 0.1, 0.02, 300.0
TEXT_SCALARS, TEXT_SHARE = 500, 0.9
CONSTRAINT_FLOOR, CONSTRAINT_TRIALS, CONSTRAINT_SEED, CONSTRAINT_BITS = 0.10, 48, 0xC0DEC, (0x80, 0x40, 0x20, 0x01)
SHIFT_ALARM, SAMPLE_SEED, PER_STRATUM, PER_CORPUS = 0.01, 20_260_826, 3, 150
BATCH_CHARS, BATCH_EXTRA, MESSAGE_CHARS, HEAD_CHARS, CONTEXT_CHARS, SHOWN_CODECS = 24_000, 12, 300, 80, 20, 8

# Probes of a codec's strictness.
DECODER_PROBES = ["8FB0DF", "FFFEFDFC", "8120", "C0AF", "EDA080"]
ENCODER_PROBES = ["café", "日本語", "Ωμέγα", "\U0001f600"]

# The columns of the audit table, in order. Numbers unmeasured are null inside, -1 in files.
AUDIT_STRINGS_FIRST = ["Corpus", "RelativePath", "ReferenceEncodingDeclared", "ReferenceEncoding", "ReferenceBOM", "ReferenceMetadataSource"]
AUDIT_COLUMNS = [
    *AUDIT_STRINGS_FIRST, "ReferenceCodePage", "DetectedEncoding", "DetectedCodePage", "DetectedBOM", "OriginalBOM", "OriginalBOMKind",
    "DetectionMatch", "DetectionBasis", "DetectionLabelExact", "DetectionTextEquivalent", "DetectionOutcome", "PlausibleCodecCount", "DistinctReadings",
    "PlausibleCodecs", "ReferenceConstraint", "ConversionStatus", "ConversionErrorStage", "ConversionErrorType", "ConversionErrorMessage", "ECReasonCode",
    "ECExplicitSource", "ECSourceUnsupported", "OriginalByteLength", "BackupByteLength", "ConvertedByteLength", "OriginalSha256", "BackupSha256",
    "ConvertedSha256", "BackupIntegrity", "ByteIdentical", "ReferenceTextLength", "ConvertedTextLength", "TextIdentical", "ReferenceTextSha256",
    "ConvertedTextSha256", "DecoderStrictness", "EncoderStrictness", "ECProductionTextSha256", "ECStrictDecodeOutcome", "ECImplementationDefect",
    "FailureCategory", "FirstDifferenceIndex", "ReferenceCodePoint", "ConvertedCodePoint", "ReferenceChar", "ConvertedChar", "ContextBefore", "ContextAfter",
    "ForcedReferenceOutcome", "CorpusRoundTrip",
]
AUDIT_BOOLEANS = [
    "DetectionMatch", "DetectionLabelExact", "DetectionTextEquivalent", "ECSourceUnsupported", "ByteIdentical", "TextIdentical", "ECImplementationDefect", "CorpusRoundTrip",
]
AUDIT_NUMBERS = [
    "PlausibleCodecCount", "DistinctReadings", "ReferenceConstraint", "OriginalByteLength", "BackupByteLength", "ConvertedByteLength", "ReferenceTextLength", "ConvertedTextLength", "FirstDifferenceIndex",
]
