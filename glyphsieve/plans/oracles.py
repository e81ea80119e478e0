"""The registered queries in DuckDB's SQL, written apart from the operators they check."""

from __future__ import annotations

from .corpus import FIXTURE

_NAMES = "['utf-8','utf-8','utf-16LE','utf-16LE','utf-16BE','utf-16BE','utf-32LE','utf-32LE','utf-32BE','utf-32BE','iso-8859-1','us-ascii']"
_MARKS = "['','EFBBBF','','FFFE','','FEFF','','FFFE0000','','0000FEFF','','']"
_BOMS = "['NoBOM','BOM','NoBOM','BOM','NoBOM','BOM','NoBOM','BOM','NoBOM','BOM','NoBOM','NoBOM']"
_EXPECTED = "['utf-8','utf-8-bom','utf-16LE','utf-16LE-bom','utf-16BE','utf-16BE-bom','utf-32LE','utf-32LE-bom','utf-32BE','utf-32BE-bom','legacy','ascii']"


_CODECS = "['utf-8','utf-8','utf-16-le','utf-16-le','utf-16-be','utf-16-be','utf-32-le','utf-32-le','utf-32-be','utf-32-be','iso8859-1','ascii']"
#: A sequence that ends before its time, in hex digits.
_TAIL = "(C[2-9A-F]|D.|E.|F[0-4]|E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].|F[1-3][89AB].|F48.|(F0[9AB].|F[1-3][89AB].|F48.)[89AB].)$"
_MALFORMED = [("utf-8", 11), ("utf-16-le", 3), ("utf-16-be", 2), ("utf-32-le", 3), ("utf-32-be", 1), ("ascii", 2), ("shift_jis", 2), ("euc_jp", 3), ("iso2022_jp", 2), ("big5", 2), ("gb18030", 2), ("gb2312", 1), ("euc_kr", 2)]


def _units(form: str, args: str) -> str:
    return f"array_to_string(list_transform(string_split(text,''), lambda ch: printf('{form}', {args})),'')"


CORPUS = f"""
src AS (SELECT doc_id, CASE WHEN doc_id % 12 = 11 THEN regexp_replace(coalesce(text,''), '[^\\x00-\\x7F]', '?', 'g') ELSE coalesce(text,'') END AS text, doc_id % 12 AS v FROM documents),
corpus AS (SELECT doc_id, text, v, {_NAMES}[v+1] AS declared, {_BOMS}[v+1] AS bom, {_EXPECTED}[v+1] AS expected, {_NAMES}[v+1] || '/doc_' || doc_id || '.txt' AS path,
  {_MARKS}[v+1] || CASE WHEN v IN (0,1,11) THEN hex(encode(text)) WHEN v IN (2,3) THEN {_units('%02X%02X', 'unicode(ch) % 256, unicode(ch) // 256')}
   WHEN v IN (4,5) THEN {_units('%04X', 'unicode(ch)')} WHEN v IN (6,7) THEN {_units('%02X%02X0000', 'unicode(ch) % 256, unicode(ch) // 256')}
   WHEN v IN (8,9) THEN {_units('%08X', 'unicode(ch)')} ELSE {_units('%02X', 'unicode(ch)')} END AS h FROM src)"""

RESOLVED = f"""{CORPUS},
res AS (SELECT doc_id, text, v, bom, doc_id % 20 = 3 AS out, CASE WHEN doc_id % 20 = 3 THEN 'node_modules/' || path ELSE path END AS path, CASE WHEN doc_id % 20 = 3 THEN '' ELSE declared END AS declared, CASE WHEN doc_id % 20 = 3 THEN '' ELSE {_CODECS}[v + 1] END AS codec,
  CASE WHEN doc_id % 20 = 3 THEN 'ExcludedByEC' ELSE 'ParentDirectory' END AS source, CASE WHEN doc_id % 25 = 2 THEN substr(h, 1, length(h) - 2) ELSE h END AS h FROM corpus)"""

_KIND = "CASE WHEN starts_with(h,'FFFE0000') THEN 'UTF-32LE' WHEN starts_with(h,'0000FEFF') THEN 'UTF-32BE' WHEN starts_with(h,'EFBBBF') THEN 'UTF-8' WHEN starts_with(h,'FFFE') THEN 'UTF-16LE' WHEN starts_with(h,'FEFF') THEN 'UTF-16BE' ELSE '' END"
_HEAD = "substr(h, 1, 131072)"

DETECTED = f"""{CORPUS},
k AS (SELECT *, {_KIND} AS kind, {_HEAD} AS g FROM corpus),
b AS (SELECT *, list_count(list_filter(regexp_extract_all(g,'(..)..',1), lambda x: x = '00'))::double / (length(g)//4) AS e, list_count(list_filter(regexp_extract_all(g,'..(..)',1), lambda x: x = '00'))::double / (length(g)//4) AS o,
  substr(g, 1, 8 * (length(g)//8)) AS w, regexp_replace(g, '(C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])$', '') AS u FROM k),
found AS (SELECT doc_id, path, declared, bom, expected, CASE WHEN kind <> '' THEN replace(replace(lower(kind), 'le', 'LE'), 'be', 'BE') || '-bom'
  WHEN length(w) >= 32 AND regexp_full_match(w, '(....(0[0-9A-F]|10)00)+') THEN 'utf-32LE' WHEN length(w) >= 32 AND regexp_full_match(w, '(00(0[0-9A-F]|10)....)+') THEN 'utf-32BE'
  WHEN length(g) >= 20 AND e > 0.5 AND o < 0.1 THEN 'utf-16BE' WHEN length(g) >= 20 AND o > 0.5 AND e < 0.1 THEN 'utf-16LE'
  WHEN regexp_full_match(g, '([0-7].)*') THEN CASE WHEN list_count(list_filter(regexp_extract_all(substr(g, 1, 1000), '..'), lambda x: x = '7F' OR (x < '20' AND x NOT IN ('09','0A','0D')))) <= 0.1 * (length(substr(g, 1, 1000)) // 2) THEN 'ascii' END WHEN try(decode(unhex(u))) IS NOT NULL THEN 'utf-8' ELSE 'legacy' END AS actual FROM b)"""

#: The corpus as the audit sees it, and the verdicts that follow from how each file was made.
BUILT = f"""{CORPUS.replace('corpus AS (', 'made AS (')},
corpus AS (SELECT doc_id, text AS given, v, declared, bom, expected, path, doc_id % 20 = 3 AS out, doc_id % 25 = 2 AS cut, CASE WHEN doc_id % 25 = 2 THEN substr(h, 1, length(h) - 2) ELSE h END AS h,
  CASE WHEN doc_id % 25 = 2 THEN left(text, length(text) - 1) ELSE text END AS text, doc_id % 25 <> 2 OR v >= 10 OR (v < 2 AND right(text, 1) < chr(128)) AS ok FROM made){DETECTED[len(CORPUS):]},
one AS (SELECT b.*, f.actual, CASE WHEN b.out THEN '' ELSE {_CODECS}[b.v + 1] END AS reference, CASE WHEN f.actual IS NULL THEN '' WHEN f.actual = 'legacy' THEN 'iso8859-1' WHEN f.actual = 'ascii' THEN 'ascii' WHEN f.actual LIKE 'utf-8%' THEN 'utf-8'
  ELSE replace(replace(replace(f.actual, '-bom', ''), 'LE', '-le'), 'BE', '-be') END AS detected FROM b JOIN found f USING (doc_id)),
two AS (SELECT *, CASE WHEN detected = '' THEN 'Skipped' WHEN actual = 'legacy' THEN 'Refused' WHEN NOT ok THEN 'Error' WHEN hex(encode(text)) = h THEN 'Unchanged' ELSE 'Converted' END AS status, reference = detected AS same FROM one),
three AS (SELECT *, status IN ('Converted', 'Unchanged') AS done, NOT out AND ok AS readable, sha256(unhex({_units('%02X%02X0000', 'unicode(ch) % 256, unicode(ch) // 256')})) AS points FROM two)"""

_CLASSES = "['utf-8-bom','utf-16LE-bom','utf-16BE-bom','utf-32LE-bom','utf-32BE-bom','utf-8','utf-16LE','utf-16BE','utf-32LE','utf-32BE','ascii','legacy']"
_JUDGED = "j AS (SELECT *, coalesce(actual = expected, false) AS ok, expected AS credited FROM found)"
_ACCEPTED = "j AS (SELECT *, ok0 AS ok, CASE WHEN ok0 THEN actual ELSE expected END AS credited FROM (SELECT *, coalesce(actual = expected, false) OR (declared IN ('utf-8','iso-8859-1') AND coalesce(actual, '') IN ('ascii','utf-8')) AS ok0 FROM found))"
_MATRIX = f"""cls AS (SELECT unnest({_CLASSES}) AS class), m AS (SELECT class, count(*) FILTER (credited = class AND ok) AS tp, count(*) FILTER (credited = class AND NOT ok) AS fn,
  count(*) FILTER (actual = class AND NOT ok) AS fp, count(*) FILTER (credited <> class AND NOT (coalesce(actual, '') = class AND NOT ok)) AS tn FROM cls, j GROUP BY class)"""


def _share(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN 100.0 * {a} / ({b}) ELSE 0.0 END, 6)::double"


FIX = "fix AS (SELECT " + ", ".join(f'{e} AS "{n}"' for e, n in FIXTURE) + " FROM documents)"
AUDIT = f"""{FIX},
a0 AS (SELECT *, CASE WHEN BackupSha256 IS NULL THEN CASE WHEN ConversionStatus = 'Converted' THEN 'Missing' ELSE 'NotApplicable' END WHEN BackupSha256 = OriginalSha256 THEN 'Verified' ELSE 'Mismatch' END AS BackupIntegrity,
  CASE WHEN ReferenceEncoding IS NOT NULL THEN CASE WHEN ReferenceCodePage IS NOT NULL AND DetectedCodePage IS NOT NULL THEN ReferenceCodePage = DetectedCodePage ELSE coalesce(ReferenceEncoding = DetectedEncoding, false) END END AS DetectionMatch,
  CASE WHEN ReferenceEncoding IS NOT NULL THEN CASE WHEN ReferenceCodePage IS NOT NULL AND DetectedCodePage IS NOT NULL THEN 'CodePage' ELSE 'CodecName' END END AS DetectionBasis FROM fix),
audit AS (SELECT *, CASE WHEN ReferenceEncoding IS NULL THEN 'NoReference' WHEN ReferenceCodePage IS NULL THEN 'NoDotNetCodec' WHEN DetectedEncoding IS NULL THEN 'NotIdentified' WHEN DetectionMatch THEN 'ExactMatch'
   WHEN coalesce(DetectionTextEquivalent, false) THEN 'TextEquivalent' WHEN NOT accepted OR coalesce(ReferenceConstraint, -1) >= 0.10 THEN 'Misdetection' ELSE 'StructurallyAmbiguous' END AS DetectionOutcome,
  CASE WHEN preset IS NOT NULL THEN preset
   WHEN ReferenceEncodingDeclared = 'Binary' THEN CASE ConversionStatus WHEN 'Skipped' THEN 'UnknownEncoding' WHEN 'Refused' THEN 'RefusedByPolicy' WHEN 'Error' THEN 'DecodeError' ELSE CASE WHEN ByteIdentical THEN 'NoOpCorrect' ELSE 'Misdetection' END END
   WHEN ReferenceMetadataSource = 'OutOfScope' THEN 'OutOfScope' WHEN ReferenceMetadataSource IN ('NoReferenceEncoding','MetadataConflict') THEN ReferenceMetadataSource
   WHEN ReferenceEncoding IS NULL THEN 'UnknownReferenceEncoding' WHEN ECSourceUnsupported THEN 'ECCodecUnsupported' WHEN BackupIntegrity = 'Mismatch' THEN 'BackupIntegrityFailure' WHEN BackupIntegrity = 'Missing' THEN 'MissingBackup'
   WHEN ConversionStatus = 'MissingConvertedFile' THEN 'MissingConvertedFile' WHEN ConversionStatus = 'Skipped' THEN 'UnknownEncoding' WHEN ConversionStatus = 'Refused' THEN 'RefusedByPolicy'
   WHEN ConversionStatus = 'Error' THEN ConversionErrorStage || 'Error'
   WHEN TextIdentical THEN CASE WHEN ByteIdentical AND NOT DetectionMatch THEN 'NoOpMislabeled' ELSE 'PASS' END WHEN ByteIdentical THEN 'NoOpMislabeled'
   WHEN strict_throws AND DetectionMatch THEN 'SilentDecodeLoss' WHEN NOT DetectionMatch THEN 'Misdetection' ELSE 'MappingDifference' END AS FailureCategory FROM a0)"""
_UNSCORED = "('OutOfScope','NoReferenceEncoding','UnknownReferenceEncoding','ECCodecUnsupported','MetadataConflict','CorpusByteOrderMislabel','RefusedByPolicy')"
_SEVERITY = """CASE WHEN {0} IN ('PASS','NoOpCorrect') THEN 0 WHEN {0} IN ('OutOfScope','NoReferenceEncoding','UnknownReferenceEncoding','ECCodecUnsupported','MetadataConflict','CorpusByteOrderMislabel') THEN 1
 WHEN {0} IN ('UnknownEncoding','RefusedByPolicy') THEN 2 WHEN {0} IN ('DecodeError','EncodeError','WriteError','ReferenceDecodeError') THEN 3 WHEN {0} = 'NoOpMislabeled' THEN 4 WHEN {0} = 'MappingDifference' THEN 5
 WHEN {0} = 'Misdetection' THEN 6 WHEN {0} = 'SilentDecodeLoss' THEN 7 WHEN {0} = '(absent)' THEN 9 ELSE 8 END"""
RUNS = f"""{AUDIT},
later AS (SELECT Corpus, CASE WHEN doc_id % 41 = 7 THEN RelativePath || '.new' ELSE RelativePath END AS RelativePath, CASE WHEN doc_id % 14 = 0 THEN 'ECCodecUnsupported' WHEN doc_id % 15 = 0 THEN 'PASS' ELSE FailureCategory END AS FailureCategory FROM audit WHERE doc_id % 37 <> 5)"""
MOVED = f"""{RUNS},
t AS (SELECT Corpus, RelativePath, coalesce(x.FailureCategory, '(absent)') AS before, coalesce(y.FailureCategory, '(absent)') AS after FROM audit x FULL JOIN later y USING (Corpus, RelativePath)),
moved AS (SELECT *, CASE WHEN {_SEVERITY.format('after')} < {_SEVERITY.format('before')} THEN 'Improved' WHEN {_SEVERITY.format('after')} > {_SEVERITY.format('before')} THEN 'Regressed' ELSE 'Lateral' END AS verdict FROM t WHERE before <> after)"""
_SIZE = "CASE WHEN OriginalByteLength < 1024 THEN '<1K' WHEN OriginalByteLength < 16384 THEN '1K-16K' WHEN OriginalByteLength < 262144 THEN '16K-256K' ELSE '>256K' END"
_CONSTRAINT = "CASE WHEN ReferenceConstraint IS NULL THEN 'n/a' WHEN ReferenceConstraint = 0 THEN '0.00' WHEN ReferenceConstraint < 0.05 THEN '0.00-0.05' WHEN ReferenceConstraint < 0.10 THEN '0.05-0.10 (just below)' WHEN ReferenceConstraint < 0.20 THEN '0.10-0.20 (just above)' ELSE '>0.20' END"
_BIN = "coalesce(ReferenceEncodingDeclared = 'Binary', false)"
RULES = [
    ("PASS without identical text", "FailureCategory = 'PASS' AND NOT coalesce(TextIdentical, false)"), ("PASS with differing hashes", "FailureCategory = 'PASS' AND coalesce(TextIdentical, false) AND ReferenceTextSha256 IS DISTINCT FROM ConvertedTextSha256"),
    ("identical text, differing hashes", "coalesce(TextIdentical, false) AND ReferenceTextSha256 IS DISTINCT FROM ConvertedTextSha256"), ("differing text, equal hashes", "NOT coalesce(TextIdentical, true) AND ReferenceTextSha256 IS NOT NULL AND ReferenceTextSha256 = ConvertedTextSha256"),
    ("scored without reference", f"FailureCategory NOT IN {_UNSCORED} AND ReferenceEncoding IS NULL AND NOT {_BIN}"), ("verified backup differs", "BackupIntegrity = 'Verified' AND BackupSha256 IS DISTINCT FROM OriginalSha256"),
    ("identical bytes differ", "ByteIdentical AND OriginalSha256 IS DISTINCT FROM ConvertedSha256"), ("no-op changed bytes", "FailureCategory = 'NoOpMislabeled' AND NOT ByteIdentical"),
    ("exact match does not match", "DetectionOutcome = 'ExactMatch' AND NOT coalesce(DetectionMatch, false)"), ("text-equivalent codecs match", "DetectionOutcome = 'TextEquivalent' AND coalesce(DetectionMatch, true)"),
    ("text-equivalent without equal text", "DetectionOutcome = 'TextEquivalent' AND NOT coalesce(DetectionMatch, true) AND NOT coalesce(DetectionTextEquivalent, false)"),
    ("ambiguous but constrained", "DetectionOutcome = 'StructurallyAmbiguous' AND coalesce(ReferenceConstraint, -1) >= 0.10"), ("misdetection unmeasured", "DetectionOutcome = 'Misdetection' AND ReferenceConstraint IS NULL"),
    ("no codec but a code page", "DetectionOutcome = 'NoDotNetCodec' AND ReferenceCodePage IS NOT NULL"), ("no reference but a codec", "DetectionOutcome = 'NoReference' AND ReferenceEncoding IS NOT NULL"),
    ("never compared", f"FailureCategory NOT IN {_UNSCORED} AND NOT {_BIN} AND FailureCategory NOT IN ('UnknownEncoding','DecodeError','EncodeError','WriteError','ReferenceDecodeError','MissingConvertedFile','MissingBackup','BackupIntegrityFailure') AND TextIdentical IS NULL"),
]




def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


SQL = {
    "bom_kind": f"WITH {CORPUS} SELECT doc_id, {_KIND} AS kind, CASE WHEN {_KIND} = '' THEN '' ELSE replace(replace(lower({_KIND}), 'le', 'LE'), 'be', 'BE') || '-bom' END AS class FROM corpus",
    "bom_kind_counts": f"WITH {CORPUS} SELECT {_KIND} AS kind, count(*) AS n FROM corpus GROUP BY 1",
    "inventory": f"WITH {CORPUS} SELECT path, (length(h)//2)::bigint AS size, sha256(unhex(h)) AS sha256, declared, bom FROM corpus",
    "inventory_rows": f"""WITH {CORPUS} SELECT 'made' AS "Corpus", path AS "RelativePath", (length(h)//2)::bigint AS "OriginalSize", sha256(unhex(h)) AS "OriginalSha256", strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS "OriginalLastWriteUtc" FROM corpus WHERE doc_id % 10 <> 4""",
    "codepoint_sha256": f"SELECT doc_id, sha256(unhex({_units('%02X%02X0000', 'unicode(ch) % 256, unicode(ch) // 256')})) AS sha256 FROM documents",
    "sample_prefix": f"WITH {CORPUS} SELECT doc_id, (length({_HEAD})//2)::bigint AS n, sha256(unhex({_HEAD})) AS sha256, CASE WHEN length(h) >= 8 THEN substr(h, 1, 8) END AS header FROM corpus",
    "byte_entropy": f"""WITH {CORPUS}, bytes AS (SELECT doc_id, unnest(regexp_extract_all({_HEAD}, '..')) AS b FROM corpus), n AS (SELECT doc_id, b, count(*) AS n FROM bytes GROUP BY 1, 2), p AS (SELECT *, n::double / sum(n) OVER (PARTITION BY doc_id) AS p FROM n),
 e AS (SELECT doc_id, sum(n)::bigint AS n_bytes, -sum(p * log2(p)) AS e FROM p GROUP BY 1) SELECT doc_id, n_bytes, round(e, 6) AS entropy, n_bytes >= 512 AND e > 7.4 AS gated FROM e""",
    "utf16_chi_square": f"""WITH {CORPUS}, g AS (SELECT doc_id, substr({_HEAD}, 1, 4 * (length({_HEAD})//4)) AS g FROM corpus), x AS (SELECT doc_id, 0 AS ch, unnest(regexp_extract_all(g, '(..)..', 1)) AS b FROM g UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(g, '..(..)', 1)) FROM g),
 n AS (SELECT doc_id, ch, b, count(*)::double AS n FROM x GROUP BY 1, 2, 3), s AS (SELECT doc_id, ch, sum(n) AS units, 256.0 * sum(n * n) / sum(n) - sum(n) AS chi FROM n GROUP BY 1, 2)
 SELECT doc_id, max(units)::bigint AS units, round(max(chi) FILTER (ch = 0), 4) AS chi_even, round(max(chi) FILTER (ch = 1), 4) AS chi_odd FROM s GROUP BY 1""",
    "nul_channel_ratio": f"WITH {DETECTED} SELECT doc_id, round(e, 6) AS even, round(o, 6) AS odd FROM b",
    "unicode_candidates": f"""WITH {DETECTED} SELECT doc_id, CASE WHEN length(w) >= 32 AND regexp_full_match(w, '(....(0[0-9A-F]|10)00)+') THEN 'LE' WHEN length(w) >= 32 AND regexp_full_match(w, '(00(0[0-9A-F]|10)....)+') THEN 'BE' END AS utf32,
 CASE WHEN length(g) >= 20 AND e > 0.5 AND o < 0.1 THEN 'BE' WHEN length(g) >= 20 AND o > 0.5 AND e < 0.1 THEN 'LE' END AS utf16 FROM b""",
    "looks_like_text": r"""WITH t AS (SELECT doc_id, left(CASE WHEN doc_id % 3 = 0 THEN repeat(chr(1), (doc_id % 80)::int) || text ELSE text END, 500) AS t FROM documents)
 SELECT doc_id, length(t) > 0 AND length(t) - length(regexp_replace(t, '[^\p{Cc}\p{Co}]|[\r\n\t]', '', 'g')) >= 0.9 * length(t) AS text_like FROM t""",
    "detect_corpus": f"WITH {DETECTED} SELECT doc_id, expected, coalesce(actual, '(undetected)') AS actual FROM found",
    "population_by_bucket": f"""WITH {CORPUS}, c AS (SELECT CASE declared WHEN 'us-ascii' THEN 'us-ascii' WHEN 'iso-8859-1' THEN 'Legacy' ELSE declared END AS bucket FROM corpus)
 SELECT b.bucket, count(c.bucket) AS n FROM (SELECT unnest(['utf-8','utf-16BE','utf-16LE','utf-32BE','utf-32LE','us-ascii','Legacy','Binary']) AS bucket) b LEFT JOIN c USING (bucket) GROUP BY 1""",
    "claims_by_class": f"WITH {DETECTED} SELECT k.class, count(f.actual) AS n FROM (SELECT unnest(list_append({_CLASSES}, '(undetected)')) AS class) k LEFT JOIN (SELECT coalesce(actual, '(undetected)') AS actual FROM found) f ON f.actual = k.class GROUP BY 1",
    "confusion_matrix": f"WITH {DETECTED}, {_JUDGED}, {_MATRIX} SELECT *, {_share('(tp+tn)', '(tp+fn+fp+tn)')} AS accuracy, {_share('fn', '(fn+tp)')} AS fnr, {_share('fp', '(fp+tn)')} AS fpr FROM m",
    "overall_metrics": f"WITH {DETECTED}, {_JUDGED}, {_MATRIX}, s AS (SELECT sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tn) AS tn FROM m), p AS (SELECT count(*) AS processed, count(*) FILTER (ok) AS correct FROM j) SELECT processed, correct, {_share('correct', 'processed')} AS accuracy, {_share('fp', '(fp+tn)')} AS fpr, {_share('fn', '(fn+tp)')} AS fnr FROM p, s",
    "accepted_set_scoring": f"WITH {DETECTED}, {_ACCEPTED}, {_MATRIX} SELECT * FROM m",
    "mismatch_list": f"WITH {DETECTED}, {_JUDGED} SELECT actual AS class, 'FP' AS side, path, 'Misclassified' AS type FROM j WHERE NOT ok AND actual IS NOT NULL UNION ALL SELECT expected, 'FN', path, CASE WHEN actual IS NULL THEN 'FalseNegative' ELSE 'Misclassified' END FROM j WHERE NOT ok",
    "run_counters": f"""WITH {CORPUS}, f AS (SELECT regexp_full_match(lower('doc_' || doc_id || '.txt'), 'doc_.*1.\\.txt') AS m, doc_id % 9 <> 0 AS k, doc_id % 50 = 11 AS e FROM corpus)
 SELECT count(*) AS discovered, count(*) FILTER (NOT m) AS skipped_by_filter, count(*) FILTER (m AND NOT k) AS skipped_no_ground_truth, count(*) FILTER (m AND k AND NOT e) AS processed, count(*) FILTER (m AND k AND e) AS errored FROM f""",
    "codec_candidates": _values([
        ("UTF-8", "UTF-8|utf-8|utf_8"), ("utf-16-le", "utf-16-le|utf_16_le|utf-16le"), ("cp1252", "cp1252|windows-1252|ibm1252"), ("iso2022_jp", "iso2022_jp|iso2022-jp|iso-2022-jp"), ("iso8859-15", "iso8859-15|iso8859_15|iso-8859-15"),
        ("windows-1251", "windows-1251|windows_1251|cp1251"), ("ibm-850", "ibm-850|ibm_850|cp850"), ("cp949", "cp949|ks_c_5601-1987|windows-949|ibm949"), ("mac_latin2", "mac_latin2|x-mac-ce|mac-latin2"),
        ("utf-8-sig", "utf-8-sig|utf_8_sig|utf-8"), (" KOI8-R ", "KOI8-R|koi8-r|koi8_r")], "name, spellings"),
    "catalogue_directories": _values([
        ("utf-8-english", "utf-8"), ("utf-16-be", "utf-16"), ("utf-32-be", "utf-32"), ("windows-1251-be", "windows-1251"), ("koi8-r-ru", "koi8-r"), ("iso-8859-5-be", "iso-8859-5"), ("shift-jis-ja", "shift-jis"), ("none-none", "none"),
        ("cp864-ar", "cp864"), ("big5-zh", "big5"), ("gb18030-zh", "gb18030-zh"), ("unheard-of", "unheard-of"), ("windows-1251-ru", "windows-1251"), ("hz-gb-2312-zh", "hz-gb-2312-zh")], "directory, token"),
    "language_codes": "SELECT tag, n::bigint AS n FROM (VALUES ('be', 4), ('ru', 2), ('zh', 3)) AS t(tag, n)",
    "directory_codecs": _values([
        ("utf-8-english", "utf-8"), ("utf-16-be", "utf-16"), ("utf-32-be", "utf-32"), ("windows-1251-be", "cp1251"), ("koi8-r-ru", "koi8-r"), ("iso-8859-5-be", "iso8859-5"), ("shift-jis-ja", "shift_jis"), ("none-none", None),
        ("cp864-ar", "cp864"), ("big5-zh", "big5"), ("gb18030-zh", "gb18030"), ("unheard-of", None), ("windows-1251-ru", "cp1251"), ("hz-gb-2312-zh", "hz")], "directory, codec"),
    "catalog_forward_fill": _values([("big5-zh/a.txt", "big5"), ("big5-zh/b.txt", "big5"), ("None-None/c.bin", "None-None"), ("utf-8-english/e.txt", "utf-8")], "path, token"),
    "manifest_classes": f"""WITH r AS (SELECT doc_id, {_NAMES}[doc_id % 12 + 1] AS enc, CASE WHEN doc_id % 24 < 12 THEN 'BOM' ELSE 'NoBOM' END AS bom FROM documents)
 SELECT doc_id, enc, CASE enc WHEN 'us-ascii' THEN 'ascii' WHEN 'iso-8859-1' THEN 'legacy' ELSE CASE WHEN bom = 'BOM' THEN enc || '-bom' ELSE enc END END AS class, enc || '-' || bom AS described, CASE enc WHEN 'iso-8859-1' THEN 'Legacy' ELSE enc END AS bucket FROM r""",
    "scope_filter": """WITH r AS (SELECT doc_id, ['utf-8','.git','scripts','_side','Build','a/_b','x/Target','deep/er'][doc_id % 8 + 1] AS d, CASE WHEN doc_id % 13 = 0 THEN 'README.md' WHEN doc_id % 17 = 0 THEN 'License' ELSE 'f' || doc_id || '.txt' END AS f FROM documents)
 SELECT doc_id, d || '/' || f AS path, CASE WHEN d IN ('.git','Build','x/Target') THEN 'ExcludedByEC' WHEN d = 'scripts' OR f IN ('README.md','License') THEN 'OutOfScope' WHEN d IN ('_side','a/_b') THEN 'SidecarDirectory' ELSE '' END AS scope FROM r""",
    "filename_crosscheck": """WITH r AS (SELECT doc_id, doc_id % 7 <> 0 AS listed, CASE WHEN doc_id % 11 = 0 THEN 'Binary' ELSE 'utf-8' END AS e, doc_id % 4 <> 0 AS doc, CASE WHEN doc_id % 3 = 0 THEN 'koi8-r' ELSE 'utf-8' END AS t FROM documents)
 SELECT doc_id, CASE WHEN listed THEN e ELSE '' END AS declared, CASE WHEN listed THEN 'NoBOM' ELSE '' END AS bom, CASE WHEN NOT listed THEN 'NotInManifest' WHEN e = 'Binary' THEN 'Manifest' WHEN NOT doc THEN 'Manifest' WHEN t <> 'utf-8' THEN 'MetadataConflict' ELSE 'Manifest+Filename' END AS source,
 CASE WHEN listed AND e = 'utf-8' AND NOT (doc AND t <> 'utf-8') THEN 'utf-8' ELSE '' END AS codec FROM r""",
    "text_identity": f"WITH {CORPUS} SELECT doc_id, true AS identical, length(text)::bigint AS length, sha256(unhex({_units('%02X%02X0000', 'unicode(ch) % 256, unicode(ch) // 256')})) AS sha256, true AS round_trip FROM corpus",
    "outcome_cascade": f"WITH {AUDIT} SELECT doc_id, FailureCategory, DetectionOutcome, DetectionMatch, DetectionBasis, BackupIntegrity FROM audit",
    "outcome_counts": f"WITH {AUDIT} SELECT FailureCategory, count(*) AS n FROM audit GROUP BY 1",
    "coverage_rows": f"""WITH {FIX} SELECT label, count(*) FILTER (x.label = f.label) AS n FROM (SELECT CASE WHEN ConversionStatus <> 'Converted' THEN ConversionStatus WHEN ByteIdentical THEN 'identical' ELSE 'rewritten' END AS label FROM fix) f
 RIGHT JOIN (SELECT unnest(['rewritten','identical','Unchanged','Skipped','Refused','Error','MissingConvertedFile']) AS label) x USING (label) GROUP BY label""",
    "pair_summary": f"""WITH {AUDIT} SELECT ReferenceEncodingDeclared, DetectedEncoding, count(*) AS files, count(*) FILTER (DetectionMatch) AS detection_match, count(*) FILTER (TextIdentical) AS text_identical, count(*) FILTER (NOT TextIdentical) AS text_different,
 count(*) FILTER (FailureCategory = 'PASS') AS PASS, count(*) FILTER (FailureCategory = 'NoOpMislabeled') AS NoOpMislabeled, count(*) FILTER (FailureCategory = 'Misdetection') AS Misdetection, count(*) FILTER (FailureCategory = 'MappingDifference') AS MappingDifference, count(*) FILTER (FailureCategory = 'SilentDecodeLoss') AS SilentDecodeLoss FROM audit GROUP BY 1, 2""",
    "metadata_summary": f"WITH {FIX} SELECT ReferenceEncodingDeclared, count(*) AS files, arg_min_null(ReferenceEncoding, doc_id) AS codec, arg_min_null(ReferenceEncoding, doc_id) IS NOT NULL AS resolved FROM fix GROUP BY 1",
    "outcome_pivot": f"WITH {AUDIT} SELECT ReferenceEncoding, " + ", ".join(f"count(*) FILTER (FailureCategory = '{o}') AS {o}" for o in ("PASS", "NoOpMislabeled", "Misdetection", "MappingDifference", "DecodeError", "RefusedByPolicy")) + " FROM audit GROUP BY 1",
    "bom_policy": f"WITH {FIX} SELECT count(*) AS known, count(*) FILTER (ReferenceBOM = OriginalBOM) AS agree FROM fix",
    "text_loss_risk": f"WITH {FIX}, r AS (SELECT *, ConversionStatus = 'Converted' AND NOT ByteIdentical AS w FROM fix) SELECT count(*) FILTER (w) AS rewritten, count(*) FILTER (w AND TextIdentical) AS preserved, count(*) FILTER (w AND NOT TextIdentical) AS changed, count(*) FILTER (w AND TextIdentical IS NULL) AS uncompared, count(*) FILTER (ByteIdentical AND NOT TextIdentical) AS untouched_different FROM r",
    "refusal_reasons": f"WITH {FIX} SELECT ECReasonCode, count(*) AS n FROM fix WHERE ConversionStatus = 'Refused' GROUP BY 1",
    "detection_taxonomy": f"WITH {AUDIT}, n AS (SELECT DetectionOutcome, count(*) AS n, DetectionOutcome IN ('ExactMatch','TextEquivalent','StructurallyAmbiguous','Misdetection') AS j FROM audit GROUP BY 1) SELECT DetectionOutcome, n, CASE WHEN j THEN round(n::double / (SELECT sum(n) FROM n WHERE j), 6) END AS share FROM n",
    "four_metrics": f"""WITH {AUDIT}, s AS (SELECT * FROM audit WHERE FailureCategory NOT IN {_UNSCORED}) SELECT 'detection' AS metric, count(*) FILTER (DetectionMatch) AS good, count(DetectionMatch) AS total FROM s UNION ALL
 SELECT 'strict_decoding', count(*) FILTER (FailureCategory <> 'SilentDecodeLoss'), count(*) FROM s UNION ALL SELECT 'conformance', count(*) FILTER (FailureCategory <> 'MappingDifference'), count(*) FROM s UNION ALL SELECT 'preservation', count(*) FILTER (TextIdentical), count(TextIdentical) FROM s""",
    "detection_rollup": f"""WITH {AUDIT}, r AS (SELECT Corpus, DetectionMatch AS m, ReferenceCodePage IS NOT NULL AS p FROM audit WHERE ReferenceEncoding IS NOT NULL), u AS (SELECT * FROM r UNION ALL SELECT 'ALL', m, p FROM r)
 SELECT Corpus, count(*) FILTER (m) AS good, count(*) AS total, count(*) FILTER (m AND p) AS adjusted_good, count(*) FILTER (p) AS adjusted_total FROM u GROUP BY 1""",
    "top_confusions": f"""WITH {AUDIT}, p AS (SELECT ReferenceEncoding, coalesce(DetectedEncoding, '(undetected)') AS detected, count(*) AS n FROM audit WHERE NOT DetectionMatch GROUP BY 1, 2),
 w AS (SELECT ReferenceEncoding FROM p GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 15), k AS (SELECT p.*, row_number() OVER (PARTITION BY ReferenceEncoding ORDER BY n DESC, detected) AS rank FROM p JOIN w USING (ReferenceEncoding)) SELECT * FROM k WHERE rank <= 3""",
    "missing_codecs": f"WITH {AUDIT} SELECT ReferenceEncodingDeclared, count(*) AS n FROM audit WHERE DetectionOutcome = 'NoDotNetCodec' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
    "divergences": f"WITH {FIX} SELECT ReferenceCodePoint, ConvertedCodePoint, ReferenceEncoding, count(*) AS n FROM fix WHERE FirstDifferenceIndex IS NOT NULL GROUP BY 1, 2, 3 ORDER BY n DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 15",
    "corpus_rollup": f"WITH {AUDIT} SELECT Corpus, count(*) AS files, count(*) FILTER (ECImplementationDefect) AS defects, count(*) FILTER (ECStrictDecodeOutcome = 'Throws') AS throws, count(*) FILTER (BackupIntegrity = 'Verified') AS backups_verified, count(*) FILTER (CorpusRoundTrip) AS round_trips FROM audit GROUP BY 1",
    "reconcile": f"""WITH {AUDIT}, k AS (SELECT count(*) AS n, count(*) FILTER (FailureCategory IN ('Misdetection','MappingDifference','SilentDecodeLoss','NoOpMislabeled')) AS causes, count(*) FILTER (NOT TextIdentical AND FailureCategory NOT IN {_UNSCORED}) AS different FROM audit)
 SELECT 'status' AS "check", n AS expected, n AS found, true AS ok FROM k UNION ALL SELECT 'outcome', n, n, true FROM k UNION ALL SELECT 'text', causes, different, different <= causes FROM k""",
    "run_transitions": f"WITH {MOVED} SELECT * FROM moved",
    "transition_counts": f"WITH {MOVED} SELECT Corpus, verdict, count(*) AS n FROM moved GROUP BY 1, 2",
    "distribution_shift": f"""WITH {RUNS}, pairs AS (SELECT x.FailureCategory AS b, y.FailureCategory AS a FROM audit x JOIN later y USING (Corpus, RelativePath)), v AS (SELECT b AS value FROM pairs UNION SELECT a FROM pairs),
 n AS (SELECT value, (SELECT count(*) FROM pairs WHERE b = value) AS before, (SELECT count(*) FROM pairs WHERE a = value) AS after, (SELECT count(*) FROM pairs) AS total FROM v)
 SELECT value, before::bigint AS before, after::bigint AS after, (after - before)::bigint AS delta, round((after - before)::double / total, 6) AS share, abs(round((after - before)::double / total, 6)) >= 0.01 AS alarm FROM n WHERE before <> after""",
    "coverage_anti_join": f"""WITH {FIX}, disk AS (SELECT doc_id, Corpus, RelativePath FROM fix WHERE doc_id % 43 <> 3), judged AS (SELECT doc_id, Corpus, RelativePath FROM fix WHERE doc_id % 47 <> 4 UNION ALL SELECT doc_id, Corpus, RelativePath FROM fix WHERE doc_id % 31 = 6)
 SELECT 'missing' AS fault, Corpus, RelativePath FROM disk WHERE doc_id NOT IN (SELECT doc_id FROM judged) UNION ALL SELECT DISTINCT 'invented', Corpus, RelativePath FROM judged WHERE doc_id NOT IN (SELECT doc_id FROM disk) UNION ALL SELECT 'duplicate', Corpus, RelativePath FROM judged GROUP BY 2, 3 HAVING count(*) > 1""",
    "row_rule_violations": f"WITH {AUDIT} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, Corpus, RelativePath FROM audit WHERE {v}" for k, v in RULES),
    "stratified_sample": f"""WITH {AUDIT}, s AS (SELECT *, {_SIZE} AS size_bucket, {_CONSTRAINT} AS constraint_bucket FROM audit), k AS (SELECT *, row_number() OVER (PARTITION BY Corpus, ReferenceEncoding, FailureCategory, DetectionOutcome, OriginalBOM, size_bucket, constraint_bucket ORDER BY md5('20260826:' || RelativePath), RelativePath) AS rank FROM s)
 SELECT Corpus, RelativePath, size_bucket, constraint_bucket, rank FROM k WHERE rank <= 3""",
    "uniform_sample": f"WITH {FIX}, k AS (SELECT *, row_number() OVER (PARTITION BY Corpus ORDER BY md5('20260826:' || RelativePath), RelativePath) AS rank FROM fix) SELECT Corpus, RelativePath, rank FROM k WHERE rank <= 150",
    "convert_corpus": f"""WITH {DETECTED}, x AS (SELECT b.doc_id, b.h, b.v, b.text, f.actual, b.v = 10 AND b.doc_id % 24 = 10 AS named FROM b JOIN found f USING (doc_id)), y AS (SELECT *, CASE WHEN NOT named AND actual IS NULL THEN 'Skipped' WHEN named AND actual NOT IN ('ascii','legacy') THEN 'Refused' WHEN NOT named AND actual = 'legacy' THEN 'Refused' WHEN hex(encode(text)) = h THEN 'Unchanged' ELSE 'Converted' END AS status FROM x)
 SELECT doc_id, status, CASE WHEN status = 'Skipped' THEN 'EncodingNotIdentified' WHEN status <> 'Refused' THEN '' WHEN named THEN 'ExplicitSourceConflictsWithDetection' ELSE 'LegacySourceNotNamed' END AS reason, CASE WHEN status IN ('Converted','Unchanged') THEN sha256(encode(text)) END AS sha256, CASE WHEN status IN ('Converted','Unchanged') THEN true END AS identical FROM y""",
    "hash_recheck": f"WITH {CORPUS}, n AS (SELECT declared AS Corpus, count(*) AS n FROM corpus GROUP BY 1) SELECT Corpus, least(n, 150) AS n, 0::bigint AS wrong FROM n",
    "token_faults": _values([("koi8-r", "cp1251", "koi8-r")], "ReferenceEncodingDeclared, ReferenceEncoding, itself"),
    "utf8_valid": f"""WITH {CORPUS}, z AS (SELECT doc_id, h, substr(h, 1, length(h) - 2) AS k FROM corpus), t AS (SELECT *, regexp_replace(h, '{_TAIL}', '') AS h1, regexp_replace(k, '{_TAIL}', '') AS k1, regexp_full_match(h, '([0-7].)*') AS a, regexp_full_match(k, '([0-7].)*') AS ka FROM z)
 SELECT doc_id, a AS ascii, length(h1) > 0 AND try(decode(unhex(h1))) IS NOT NULL AND NOT a AS valid, length(k1) > 0 AND try(decode(unhex(k1))) IS NOT NULL AND NOT ka AS valid_cut FROM t""",
    "ambiguous_marks": f"""WITH {CORPUS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN starts_with(h, 'FFFE') THEN 'utf-16LE-bom' WHEN starts_with(h, 'FEFF') THEN 'utf-16BE-bom' ELSE 'utf-16LE' END
 ELSE CASE WHEN starts_with(h, 'FFFE0000') THEN 'utf-32LE-bom' WHEN starts_with(h, '0000FEFF') THEN 'utf-32BE-bom' ELSE 'utf-32LE' END END AS class FROM corpus""",
    "strip_bom": "SELECT doc_id, repeat(chr(65279), greatest(0, (doc_id % 3)::int - 1)) || coalesce(text, '') AS text FROM documents",
    "first_difference": """WITH q AS (SELECT doc_id, coalesce(text, '') AS a, CASE WHEN doc_id % 5 = 2 THEN greatest(length(coalesce(text, '')) - 1, 0) ELSE doc_id * 7919 % greatest(length(coalesce(text, '')), 1) END AS p FROM documents),
 r AS (SELECT doc_id, a, CASE WHEN doc_id % 5 = 0 THEN a WHEN doc_id % 5 = 1 THEN left(a, p) ELSE left(a, p) || 'Ω' || substr(a, p + 2) END AS b FROM q),
 x AS (SELECT *, CASE WHEN a = b THEN NULL ELSE list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')), lambda z: z[1] IS DISTINCT FROM z[2]), true) - 1 END AS i FROM r),
 y AS (SELECT *, CASE WHEN i IS NULL THEN '' ELSE substr(a, i + 1, 1) END AS ca, CASE WHEN i IS NULL THEN '' ELSE substr(b, i + 1, 1) END AS cb FROM x)
 SELECT doc_id, i::bigint AS at, CASE WHEN ca = '' THEN '' ELSE printf('U+%04X', unicode(ca)) END AS code_point_a, CASE WHEN cb = '' THEN '' ELSE printf('U+%04X', unicode(cb)) END AS code_point_b, ca AS char_a, cb AS char_b,
 CASE WHEN i IS NULL THEN '' ELSE substr(a, greatest(i - 20, 0) + 1, i - greatest(i - 20, 0)) END AS before, CASE WHEN i IS NULL THEN '' ELSE substr(a, i + 1, 20) END AS after FROM y""",
    "malformed_refused": _values([(x, i, n, n - ((x, i) == ("utf-32-le", "jvm")), int((x, i) == ("utf-32-le", "jvm"))) for i in ("python", "jvm") for x, n in _MALFORMED], "codec, implementation, n, refused, acknowledged").replace("SELECT *", "SELECT codec, implementation, n::bigint AS n, refused::bigint AS refused, acknowledged::bigint AS acknowledged"),
    "silent_loss": "SELECT doc_id, doc_id % 48 < 12 AND doc_id % 12 <> 10 AS silent_loss, CASE WHEN doc_id % 48 < 12 AND doc_id % 12 <> 10 THEN 'Decode' ELSE '' END AS stage FROM documents",
    "text_equivalent": f"WITH {CORPUS} SELECT doc_id, CASE WHEN v >= 10 THEN true WHEN v = 0 THEN regexp_full_match(h, '([0-7].)*') ELSE h = '' END AS equivalent FROM corpus",
    "greedy_batches": f"""WITH RECURSIVE {CORPUS}, o AS (SELECT declared AS codec, length(path) + 12 AS need, row_number() OVER (PARTITION BY declared ORDER BY path) AS k FROM corpus),
 w AS (SELECT codec, k, need AS used, 0 AS batch FROM o WHERE k = 1 UNION ALL SELECT o.codec, o.k, CASE WHEN w.used + o.need > 400 THEN o.need ELSE w.used + o.need END, w.batch + (w.used + o.need > 400)::int FROM w JOIN o ON o.codec = w.codec AND o.k = w.k + 1)
 SELECT codec, batch::bigint AS batch, count(*) AS n FROM w GROUP BY 1, 2""",
    "oracle_readings": f"WITH {CORPUS} SELECT {_CODECS}[v + 1] AS codec, 'agree' AS verdict, count(*) AS n FROM corpus GROUP BY 1",
    "forced_reference": f"""WITH {DETECTED}, x AS (SELECT b.h, b.text, f.actual, b.v = 10 AND b.doc_id % 24 = 10 AS named FROM b JOIN found f USING (doc_id)),
 y AS (SELECT (NOT named AND actual IS NULL) OR (named AND actual NOT IN ('ascii','legacy')) OR (NOT named AND actual = 'legacy') OR hex(encode(text)) = h AS kept FROM x)
 SELECT CASE WHEN kept THEN 'RefusedByPolicy' ELSE 'PASS' END AS outcome, CASE WHEN kept THEN 'assignAfter=PASS;strictUpFront=PASS' ELSE '' END AS forced, count(*) AS n FROM y GROUP BY 1, 2""",
    "directory_references": f"WITH {RESOLVED} SELECT doc_id, path, declared, codec, source FROM res",
    "converter_results": f"""WITH {CORPUS} SELECT path AS "RelativePath", {_CODECS}[v + 1] AS reference, CASE WHEN doc_id % 13 = 6 THEN 'MissingConvertedFile' WHEN doc_id % 9 = 0 THEN 'Skipped' ELSE 'Converted' END AS status,
 CASE WHEN doc_id % 13 = 6 OR doc_id % 9 = 0 THEN '' ELSE {_CODECS}[v + 1] END AS detected, CASE WHEN doc_id % 13 = 6 THEN '' ELSE bom END AS bom FROM corpus""",
    "token_classes": f"""WITH {CORPUS} SELECT doc_id, CASE WHEN v < 2 THEN 'utf-8' WHEN v < 6 THEN CASE WHEN starts_with(h, 'FFFE') THEN 'utf-16LE-bom' WHEN starts_with(h, 'FEFF') THEN 'utf-16BE-bom' ELSE 'utf-16LE' END
 WHEN v < 10 THEN CASE WHEN starts_with(h, 'FFFE0000') THEN 'utf-32LE-bom' WHEN starts_with(h, '0000FEFF') THEN 'utf-32BE-bom' ELSE 'utf-32LE' END WHEN v = 10 THEN 'legacy' ELSE 'ascii' END AS class FROM corpus""",
    "audit_rows": f"""WITH {BUILT} SELECT CASE WHEN out THEN 'node_modules/' || path ELSE path END AS "RelativePath", CASE WHEN out THEN '' ELSE declared END AS "ReferenceEncodingDeclared", reference AS "ReferenceEncoding",
 CASE WHEN out THEN 'ExcludedByEC' ELSE 'ParentDirectory' END AS "ReferenceMetadataSource", detected AS "DetectedEncoding", CASE WHEN detected = '' THEN '' WHEN actual LIKE '%-bom' THEN 'BOM' ELSE 'NoBOM' END AS "DetectedBOM",
 CASE WHEN kind = '' THEN 'NoBOM' ELSE 'BOM' END AS "OriginalBOM", kind AS "OriginalBOMKind", CASE WHEN NOT out THEN same END AS "DetectionMatch", CASE WHEN readable AND NOT same AND detected <> '' THEN true END AS "DetectionTextEquivalent",
 status AS "ConversionStatus", CASE status WHEN 'Skipped' THEN 'EncodingNotIdentified' WHEN 'Refused' THEN 'LegacySourceNotNamed' WHEN 'Error' THEN 'InvalidBytes' ELSE '' END AS "ECReasonCode", sha256(unhex(h)) AS "OriginalSha256",
 CASE WHEN status = 'Converted' THEN sha256(encode(text)) ELSE sha256(unhex(h)) END AS "ConvertedSha256", CASE WHEN status = 'Converted' THEN 'Verified' ELSE 'NotApplicable' END AS "BackupIntegrity", status <> 'Converted' AS "ByteIdentical",
 CASE WHEN readable AND done THEN true END AS "TextIdentical", CASE WHEN readable THEN points ELSE '' END AS "ReferenceTextSha256", CASE WHEN done THEN points WHEN detected = '' AND (out OR ok) AND regexp_full_match(h, '([0-7].)+') THEN sha256(unhex(regexp_replace(h, '(..)', '\\1000000', 'g'))) ELSE '' END AS "ConvertedTextSha256", CASE WHEN readable THEN true END AS "CorpusRoundTrip",
 CASE WHEN NOT out AND NOT ok THEN 'ReferenceDecodeError' WHEN out THEN 'OutOfScope' WHEN status = 'Skipped' THEN 'UnknownEncoding' WHEN status = 'Refused' THEN 'RefusedByPolicy' WHEN status = 'Error' THEN 'DecodeError' WHEN status = 'Unchanged' AND NOT same THEN 'NoOpMislabeled' ELSE 'PASS' END AS "FailureCategory" FROM three""",
    "audit_outcomes": f"""WITH {BUILT}, four AS (SELECT *, NOT out AND v = 10 AS named FROM three), five AS (SELECT *, CASE WHEN named THEN CASE WHEN actual NOT IN ('ascii', 'legacy') THEN 'Refused' WHEN hex(encode(text)) = h THEN 'Unchanged' ELSE 'Converted' END ELSE status END AS s FROM four)
 SELECT CASE WHEN out THEN NULL ELSE reference END AS "ReferenceEncoding", s AS "ConversionStatus", CASE WHEN NOT out AND NOT ok THEN 'ReferenceDecodeError' WHEN out THEN 'OutOfScope' WHEN s = 'Skipped' THEN 'UnknownEncoding' WHEN s = 'Refused' THEN 'RefusedByPolicy' WHEN s = 'Error' THEN 'DecodeError' WHEN s = 'Unchanged' AND NOT same THEN 'NoOpMislabeled' ELSE 'PASS' END AS "FailureCategory", count(*) AS n FROM five GROUP BY 1, 2, 3""",
}
