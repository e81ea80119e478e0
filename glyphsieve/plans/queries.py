"""The registered queries: each operator of the inventory over the derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import content as fc
from ..functions import names as fn
from ..operators import audit, classify, compare, detect, integrity, score
from . import corpus as rel

S, D = SparkSession, DataFrame
c = F.col


# -- bytes ------------------------------------------------------------------------------------------


def bom_kind(s: S, d: str) -> D:
    return rel.corpus(s, d).select("doc_id", fc.bom_kind(c("content")).alias("kind"), F.coalesce(fc.bom_class(c("content")), F.lit("")).alias("class"))


def bom_kind_counts(s: S, d: str) -> D:
    return rel.corpus(s, d).groupBy(fc.bom_kind(c("content")).alias("kind")).agg(F.count("*").alias("n"))


def inventory(s: S, d: str) -> D:
    return rel.corpus(s, d).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "declared", "bom")


def inventory_rows(s: S, d: str) -> D:
    """The inventory's own columns; backup files are not in it."""
    from ..sources import files

    when = F.timestamp_seconds(F.lit(1_700_000_000) + c("doc_id"))
    path = F.when(c("doc_id") % 10 == 4, F.concat("path", F.lit(".bak"))).otherwise(c("path"))
    rows = rel.corpus(s, d).select(path.alias("path"), F.octet_length("content").cast("long").alias("length"), when.alias("modified"), "content")
    return files.inventory(rows, "made")


def codepoint_sha256(s: S, d: str) -> D:
    return rel.documents(s, d).select("doc_id", fc.text_sha256(c("text")).alias("sha256"))


def sample_prefix(s: S, d: str) -> D:
    head = fc.sample(c("content"))
    return rel.corpus(s, d).select("doc_id", F.octet_length(head).cast("long").alias("n"), F.sha2(head, 256).alias("sha256"), F.hex(fc.header(c("content"), 4)).alias("header"))


def byte_entropy(s: S, d: str) -> D:
    # Rounding would lose the sign of -0.0.
    rounded = F.when(c("entropy") == 0, c("entropy")).otherwise(F.round("entropy", 6))
    return detect.entropy(rel.corpus(s, d), "doc_id").select("doc_id", "n_bytes", rounded.alias("entropy"), "gated")


def utf16_chi_square(s: S, d: str) -> D:
    return detect.chi_square(rel.corpus(s, d), "doc_id").select("doc_id", F.col("units").cast("long").alias("units"), F.round("chi_even", 4).alias("chi_even"), F.round("chi_odd", 4).alias("chi_odd"))


def nul_channel_ratio(s: S, d: str) -> D:
    return detect.nul_shares(rel.corpus(s, d), "doc_id").select("doc_id", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


def unicode_candidates(s: S, d: str) -> D:
    return detect.unicode_candidates(rel.corpus(s, d), "doc_id")


def utf8_valid(s: S, d: str) -> D:
    rows = rel.corpus(s, d).select("doc_id", "content", F.expr("substring(content, 1, octet_length(content) - 1)").alias("cut"))
    return rows.select("doc_id", fc.is_ascii(c("content")).alias("ascii"), fc.valid_utf8(c("content")).alias("valid"), fc.valid_utf8(c("cut")).alias("valid_cut"))


def ambiguous_marks(s: S, d: str) -> D:
    """Every file under a name that leaves the byte order open."""
    token = F.when(c("doc_id") % 2 == 0, "utf-16").otherwise("utf-32")
    return rel.corpus(s, d).select("doc_id", fc.sniffed(token, c("content")).alias("class"))


def looks_like_text(s: S, d: str) -> D:
    # Documents have no bad characters, so a third of them get some.
    bad = F.when(c("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("\x01"), (c("doc_id") % 80).cast("int")), c("text"))).otherwise(c("text"))
    return rel.documents(s, d).select("doc_id", fc.looks_like_text(bad).alias("text_like"))


# -- detection and scoring ------------------------------------------------------------------------------


def detections(s: S, d: str) -> D:
    found = detect.detect(rel.corpus(s, d))
    return found.select("doc_id", "path", "declared", "bom", "expected", c("detected_class").alias("actual"))


def detect_corpus(s: S, d: str) -> D:
    return detections(s, d).select("doc_id", "expected", F.coalesce("actual", F.lit(dims.UNDETECTED)).alias("actual"))


def population_by_bucket(s: S, d: str) -> D:
    return score.population(rel.corpus(s, d).withColumn("bucket", fn.bucket(c("declared"))))


def claims_by_class(s: S, d: str) -> D:
    return score.claims(detections(s, d))


def confusion_matrix(s: S, d: str) -> D:
    return score.per_class(score.confusion(score.judged(detections(s, d))))


def overall_metrics(s: S, d: str) -> D:
    return score.overall(score.judged(detections(s, d)))


def accepted_set_scoring(s: S, d: str) -> D:
    # A file declared as UTF-8 or Latin-1 that is pure ASCII may be named so.
    rows = detections(s, d).withColumn("accepted", fn.accepted_classes(c("expected"), F.when(c("declared").isin("utf-8", "iso-8859-1"), "us-ascii;utf-8").otherwise("")))
    return score.confusion(score.judged(rows, "accepted"))


def mismatch_list(s: S, d: str) -> D:
    return score.mismatches(score.judged(detections(s, d))).select("class", "side", "path", "type")


def run_counters(s: S, d: str) -> D:
    rows = rel.corpus(s, d).select(classify.matches(c("path"), "DOC_*1?.TXT").alias("matched"), (c("doc_id") % 9 != 0).alias("known"), (c("doc_id") % 50 == 11).alias("failed"))
    return score.run_counters(rows)


# -- names ------------------------------------------------------------------------------------------------


CODECS = ["UTF-8", "utf-16-le", "cp1252", "iso2022_jp", "iso8859-15", "windows-1251", "ibm-850", "cp949", "mac_latin2", "utf-8-sig", " KOI8-R "]
DIRECTORIES = [
    "utf-8-english", "utf-16-be", "utf-32-be", "windows-1251-be", "koi8-r-ru", "iso-8859-5-be", "shift-jis-ja", "none-none", "cp864-ar", "big5-zh", "gb18030-zh",
    "unheard-of", "windows-1251-ru", "hz-gb-2312-zh",
]
TOKENS = ["utf-8", "utf-16", "utf-32", "utf-16-be", "utf-32-be", "windows-1251", "koi8-r", "iso-8859-5", "shift-jis", "none", "cp864", "big5"]
CATALOGUE = [
    "# Title", "## Provenance", "| `utf-8` | 1 |", "| `big5` | 2 |", "## `big5-zh/`", "| File | Source |", "| `a.txt` | x |", "| `b.txt` | y |", "plain text",
    "### Binary (`None-None/`)", "| `c.bin` | z |", "## Other", "| `d.txt` | lost |", "#### `utf-8-english/`", "| `e.txt` | w |",
]


def codec_candidates(s: S, d: str) -> D:
    rows = s.createDataFrame([(x,) for x in CODECS], "name string")
    return rows.select("name", F.array_join(fn.spellings(c("name")), "|").alias("spellings"))


def catalogue_directories(s: S, d: str) -> D:
    dirs = s.createDataFrame([(x,) for x in DIRECTORIES], "directory string")
    return fn.catalogue_tokens(dirs, s.createDataFrame([(x,) for x in TOKENS], "token string"))


def language_codes(s: S, d: str) -> D:
    return fn.language_tags(s.createDataFrame([(x,) for x in DIRECTORIES], "directory string"))


def directory_codecs(s: S, d: str) -> D:
    dirs = s.createDataFrame([(x,) for x in DIRECTORIES], "directory string")
    return fn.directory_codecs(dirs, fn.language_tags(dirs))


def catalog_forward_fill(s: S, d: str) -> D:
    from ..sources.catalogue import catalogue

    return catalogue(s.createDataFrame(list(enumerate(CATALOGUE)), "line_no int, line string"))


def manifest_classes(s: S, d: str) -> D:
    rows = rel.documents(s, d).select("doc_id", F.element_at(F.array(*[F.lit(x) for x, *_ in rel.VARIANTS]), (c("doc_id") % 12 + 1).cast("int")).alias("enc"))
    bom = F.when(c("doc_id") % 24 < 12, "BOM").otherwise("NoBOM")
    return rows.select("doc_id", "enc", fn.manifest_class(c("enc"), bom).alias("class"), fn.described(c("enc"), bom).alias("described"), fn.bucket(c("enc")).alias("bucket"))


def scope_filter(s: S, d: str) -> D:
    dirs = F.element_at(F.array(*map(F.lit, ["utf-8", ".git", "scripts", "_side", "Build", "a/_b", "x/Target", "deep/er"])), (c("doc_id") % 8 + 1).cast("int"))
    name = F.when(c("doc_id") % 13 == 0, "README.md").when(c("doc_id") % 17 == 0, "License").otherwise(F.concat(F.lit("f"), c("doc_id").cast("string"), F.lit(".txt")))
    path = classify.relative(F.concat(F.lit("\\"), F.replace(dirs, F.lit("/"), F.lit("\\")), F.lit("\\"), name))
    return rel.documents(s, d).select("doc_id", path.alias("path")).select("doc_id", "path", F.coalesce(classify.scope(c("path")), F.lit("")).alias("scope"))


def filename_crosscheck(s: S, d: str) -> D:
    path = F.concat(F.lit("set/"), F.when(c("doc_id") % 4 == 0, "TXT").otherwise("DOC"), c("doc_id").cast("string"), F.lit("_a_b_c_"), F.when(c("doc_id") % 3 == 0, "koi8-r").otherwise("utf-8"), F.lit("_x.v1.txt"))
    files = rel.documents(s, d).select("doc_id", path.alias("path"))
    manifest = files.filter("doc_id % 7 != 0").select(c("path").alias("RelativePath"), F.when(c("doc_id") % 11 == 0, "Binary").otherwise("utf-8").alias("Encoding"), F.lit("NoBOM").alias("BOM"))
    return classify.resolve_manifest(files, manifest).select("doc_id", "declared", "bom", "source", F.coalesce("codec", F.lit("")).alias("codec"))


# -- text ---------------------------------------------------------------------------------------------------


def strip_bom(s: S, d: str) -> D:
    mark = F.decode(F.unhex(F.lit("FEFF")), "UTF-16BE")
    return rel.documents(s, d).select("doc_id", fc.strip_bom(F.concat(F.repeat(mark, (c("doc_id") % 3).cast("int")), c("text"))).alias("text"))


def first_difference(s: S, d: str) -> D:
    """Whole texts, with differences anywhere, for every fifth at the end."""
    last = F.greatest(F.length("text") - 1, F.lit(0))
    at = F.when(c("doc_id") % 5 == 2, last).otherwise((c("doc_id") * 7919 % (last + 1)).cast("int"))
    rows = rel.documents(s, d).withColumn("at", at)
    other = F.when(c("doc_id") % 5 == 0, c("text")).when(c("doc_id") % 5 == 1, F.left("text", c("at"))).otherwise(F.concat(F.left("text", c("at")), F.lit("Ω"), F.expr("substring(text, at + 2)")))
    return rows.select("doc_id", fc.first_difference(c("text"), other).alias("x")).select(
        "doc_id", c("x.index").cast("long").alias("at"), "x.code_point_a", "x.code_point_b", "x.char_a", "x.char_b", "x.before", "x.after"
    )


def text_identity(s: S, d: str) -> D:
    rows = detect.reference_text(declared(rel.corpus(s, d)), "codec")
    return rows.select("doc_id", (c("reference.text") == c("text")).alias("identical"), c("reference.length").cast("long").alias("length"), c("reference.sha256").alias("sha256"), c("reference.round_trip").alias("round_trip"))


# -- the audit ---------------------------------------------------------------------------------------------------


def outcome_cascade(s: S, d: str) -> D:
    return rel.audit(s, d).select("doc_id", "FailureCategory", "DetectionOutcome", "DetectionMatch", "DetectionBasis", "BackupIntegrity")


def outcome_counts(s: S, d: str) -> D:
    return score.counted(rel.audit(s, d), "FailureCategory")


def coverage_rows(s: S, d: str) -> D:
    return score.coverage(rel.audit(s, d))


def pair_summary(s: S, d: str) -> D:
    return score.pair_summary(rel.audit(s, d))


def metadata_summary(s: S, d: str) -> D:
    return score.metadata_summary(rel.audit(s, d), "doc_id")


def outcome_pivot(s: S, d: str) -> D:
    return score.by_reference(rel.audit(s, d)).select("ReferenceEncoding", "PASS", "NoOpMislabeled", "Misdetection", "MappingDifference", "DecodeError", "RefusedByPolicy")


def bom_policy(s: S, d: str) -> D:
    return score.bom_agreement(rel.audit(s, d))


def text_loss_risk(s: S, d: str) -> D:
    return score.text_loss(rel.audit(s, d))


def refusal_reasons(s: S, d: str) -> D:
    return score.refusal_reasons(rel.audit(s, d))


def detection_taxonomy(s: S, d: str) -> D:
    return score.taxonomy(rel.audit(s, d))


def four_metrics(s: S, d: str) -> D:
    return score.four_metrics(rel.audit(s, d))


def detection_rollup(s: S, d: str) -> D:
    return score.detection_rollup(rel.audit(s, d))


def top_confusions(s: S, d: str) -> D:
    return score.top_confusions(rel.audit(s, d)).select("ReferenceEncoding", "detected", "n", c("rank").cast("long").alias("rank"))


def missing_codecs(s: S, d: str) -> D:
    return score.missing_codecs(rel.audit(s, d))


def divergences(s: S, d: str) -> D:
    return score.divergences(rel.audit(s, d), 15, "ReferenceEncoding")


def corpus_rollup(s: S, d: str) -> D:
    return score.corpus_rollup(rel.audit(s, d))


def reconcile(s: S, d: str) -> D:
    return score.reconciled(rel.audit(s, d))


# -- runs and integrity ----------------------------------------------------------------------------------------------


def run_transitions(s: S, d: str) -> D:
    a = rel.audit(s, d)
    return compare.transitions(a, rel.second_run(a))


def transition_counts(s: S, d: str) -> D:
    return compare.transition_counts(run_transitions(s, d), "Corpus", "verdict")


def distribution_shift(s: S, d: str) -> D:
    a = rel.audit(s, d)
    return compare.shifts(a, rel.second_run(a))


def coverage_anti_join(s: S, d: str) -> D:
    a = rel.audit(s, d).select("doc_id", "Corpus", "RelativePath")
    return integrity.coverage_faults(a.filter("doc_id % 43 != 3"), a.filter("doc_id % 47 != 4").unionByName(a.filter("doc_id % 31 = 6")))


def row_rule_violations(s: S, d: str) -> D:
    return integrity.rule_violations(rel.audit(s, d))


def stratified_sample(s: S, d: str) -> D:
    return integrity.stratified_sample(rel.audit(s, d)).select("Corpus", "RelativePath", "size_bucket", "constraint_bucket", c("rank").cast("long").alias("rank"))


def uniform_sample(s: S, d: str) -> D:
    return integrity.uniform_sample(rel.audit(s, d)).select("Corpus", "RelativePath", c("rank").cast("long").alias("rank"))


# -- codecs ---------------------------------------------------------------------------------------------------------------


def malformed_refused(s: S, d: str) -> D:
    """A row for each codec and implementation: sequences, those refused, and those known to be read."""
    counted = F.count("*").alias("n"), score.count_if(c("refused")).alias("refused"), score.count_if(c("acknowledged")).alias("acknowledged")
    return detect.conformance(s).groupBy("codec", "implementation").agg(*counted)


def strictness_probe(s: S, d: str) -> D:
    return detect.strictness(detect.probe_universe(s))


def strictness_by_page(s: S, d: str) -> D:
    return score.strictness_by_page(strictness_probe(s, d))


def conversions(s: S, d: str) -> D:
    """Every file, unaided where the policy allows, Latin-1 files named for every other one."""
    return detect.detected_converted(named(rel.corpus(s, d)), "explicit")


def named(rows: D) -> D:
    """rows with explicit: the source that some are converted from by name."""
    return rows.withColumn("explicit", F.when((c("declared") == "iso-8859-1") & (c("doc_id") % 24 == 10), "iso8859-1"))


def convert_corpus(s: S, d: str) -> D:
    rows = conversions(s, d)
    made = c("conversion.output")
    return rows.select("doc_id", c("conversion.status").alias("status"), F.coalesce("conversion.reason", F.lit("")).alias("reason"), F.sha2(made, 256).alias("sha256"), (made.cast("string") == c("text")).alias("identical"))


#: The codec of each variant's declared encoding.
DECLARED = ["utf-8", "utf-8", "utf-16-le", "utf-16-le", "utf-16-be", "utf-16-be", "utf-32-le", "utf-32-le", "utf-32-be", "utf-32-be", "iso8859-1", "ascii"]


def declared(rows: D) -> D:
    """rows with codec: that of the declared encoding."""
    return rows.withColumn("codec", F.element_at(F.array(*map(F.lit, DECLARED)), (c("doc_id") % 12 + 1).cast("int")))


def forced_reference(s: S, d: str) -> D:
    rows = detect.detected_converted(declared(named(rel.corpus(s, d))), "explicit", reference="codec", texts=False)
    rows = rows.withColumns({"sha256": c("reference.sha256"), "outcome": F.when(c("conversion.status") == "Converted", "PASS").otherwise("RefusedByPolicy")})
    return detect.forced_reference(rows, "codec", "sha256", "outcome").groupBy("outcome", F.coalesce("forced", F.lit("")).alias("forced")).agg(F.count("*").alias("n"))


def codec_evidence(s: S, d: str) -> D:
    rows = declared(rel.corpus(s, d)).withColumn("other", F.lit("cp1252"))
    out = detect.evidence(rows, "codec", "other", ["utf-8", "cp1252", "iso8859-1", "shift_jis", "koi8-r"])
    return out.select("doc_id", "evidence.*")


def silent_loss(s: S, d: str) -> D:
    """A byte FF ends every fourth file of each encoding: Latin-1 alone can have it there."""
    broken = F.when(c("doc_id") % 48 < 12, F.concat(c("content"), F.unhex(F.lit("FF")))).otherwise(c("content"))
    rows = declared(rel.corpus(s, d)).withColumn("content", broken)
    rows = rows.withColumns({mode: detect.diagnosis("codec", mode) for mode in ("production", "strict")})
    return detect.silent_loss(rows).select("doc_id", "silent_loss", F.coalesce("strict.stage", F.lit("")).alias("stage"))


def oracle_readings(s: S, d: str) -> D:
    rows = detect.second_reading(detect.reference_text(declared(rel.corpus(s, d)), "codec"), "codec")
    rows = rows.withColumns({"first": c("reference.text"), "second": fc.strip_bom(c("other"))})
    return integrity.oracle_verdicts(rows, "first", "second").groupBy("codec", "verdict").agg(F.count("*").alias("n"))


def hash_recheck(s: S, d: str) -> D:
    """A sample of each declared encoding, with the digests of two implementations."""
    rows = rel.corpus(s, d).select("doc_id", c("declared").alias("Corpus"), c("path").alias("RelativePath"), "content", "text")
    rows = detect.reference_text(declared(integrity.uniform_sample(rows)), "codec").withColumn("stored", c("reference.sha256"))
    wrong = integrity.hash_faults(rows, "text", "stored").select("doc_id", F.lit(True).alias("wrong"))
    joined = rows.select("doc_id", "Corpus").join(wrong, "doc_id", "left")
    return joined.groupBy("Corpus").agg(F.count("*").alias("n"), score.count_if(c("wrong")).alias("wrong"))


def token_faults(s: S, d: str) -> D:
    rows = [("utf-16-be", "utf-16"), ("utf-32-be", "utf-32"), ("koi8-r", "cp1251"), ("utf-8", "utf-8"), ("shift-jis", "shift_jis"), ("weird", "utf-8"), ("viscii", None)]
    return integrity.token_faults(s.createDataFrame(rows, "ReferenceEncodingDeclared string, ReferenceEncoding string"))


def text_equivalent(s: S, d: str) -> D:
    return detect.text_equivalent(rel.corpus(s, d).withColumn("other", F.lit("cp1252")), "other", "text").select("doc_id", "equivalent")


def greedy_batches(s: S, d: str) -> D:
    rows = rel.corpus(s, d).select(c("declared").alias("codec"), "path")
    return integrity.greedy_batches(rows, 400).groupBy("codec", "batch").agg(F.count("*").alias("n"))


# -- the audit, from files to verdicts ------------------------------------------------------------------------------------


def resolved(s: S, d: str) -> D:
    """The corpus with the reference that its directories give, one file in twenty in a directory out of scope, one in 25 cut short."""
    rows = rel.corpus(s, d)
    path = F.when(c("doc_id") % 20 == 3, F.concat(F.lit("node_modules/"), c("path"))).otherwise(c("path"))
    cut = F.when(c("doc_id") % 25 == 2, F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(c("content"))
    files = rows.select("doc_id", path.alias("path"), cut.alias("content"))
    return classify.resolve_directories(files, False)


AUDITED = [
    "RelativePath", "ReferenceEncodingDeclared", "ReferenceEncoding", "ReferenceMetadataSource", "DetectedEncoding", "DetectedBOM", "OriginalBOM", "OriginalBOMKind", "DetectionMatch",
    "DetectionTextEquivalent", "ConversionStatus", "ECReasonCode", "OriginalSha256", "ConvertedSha256", "BackupIntegrity", "ByteIdentical", "TextIdentical", "ReferenceTextSha256",
    "ConvertedTextSha256", "CorpusRoundTrip", "FailureCategory",
]


def audit_rows(s: S, d: str) -> D:
    """Every file through inventory, conversion, diagnoses and verdicts; sources unnamed."""
    rows = audit.audited(resolved(s, d), "corpus", explicit=False, forced=False)
    return rows.select(*[F.coalesce(c(n), F.lit("")).alias(n) if t == "string" else c(n) for n, t in rows.select(*AUDITED).dtypes])


def audit_outcomes(s: S, d: str) -> D:
    """The same with sources named where the policy needs them."""
    return score.counted(audit.audited(resolved(s, d), "corpus", forced=False), "ReferenceEncoding", "ConversionStatus", "FailureCategory")


def directory_references(s: S, d: str) -> D:
    """C1 for directory corpora."""
    return resolved(s, d).select("doc_id", "path", "declared", F.coalesce("codec", F.lit("")).alias("codec"), "source")


def converter_results(s: S, d: str) -> D:
    """The report of a converter, as its files name things, joined to the inventory; some files are in no report."""
    files = classify.resolve_directories(rel.corpus(s, d).select("doc_id", "path", "content", "declared"), False)
    label = F.when(c("doc_id") % 9 == 0, "(undetected)").when(c("doc_id") % 4 == 0, F.concat(F.upper("declared"), F.lit(" (sure)"))).otherwise(c("declared"))
    report = rel.corpus(s, d).filter("doc_id % 13 != 6").select(
        c("path").alias("File"), label.alias("Encoding"), F.when(c("bom") == "BOM", "Yes").otherwise("No").alias("BOM"), F.when(c("doc_id") % 9 == 0, "Skipped").otherwise("Converted").alias("Result"), F.lit("").alias("ReasonCode")
    )
    rows = audit.inventory(files, "corpus").join(audit.reported(report), audit.KEY, "left")
    return rows.select(audit.KEY, F.coalesce("ReferenceEncoding", F.lit("")).alias("reference"), F.coalesce("ConversionStatus", F.lit("MissingConvertedFile")).alias("status"), F.coalesce("DetectedEncoding", F.lit("")).alias("detected"), F.coalesce("DetectedBOM", F.lit("")).alias("bom"))


def token_classes(s: S, d: str) -> D:
    """The class of every file's directory token."""
    token = F.when(c("declared") == "us-ascii", "ascii").otherwise(F.regexp_replace("declared", "[LB]E$", ""))
    return rel.corpus(s, d).select("doc_id", fn.token_class(token, c("content")).alias("class"))


def legacy_detection(s: S, d: str) -> D:
    """Texts in four scripts and eleven encodings, whole and cut short: files, those named exactly, and those of the right class."""
    rows = detect.detect(rel.legacy_corpus(s, d))
    exact = c("detected_codec") == c("declared")
    return rows.groupBy("declared").agg(F.count("*").alias("n"), score.count_if(exact).alias("exact"), score.count_if(c("detected_class") == "legacy").alias("legacy"))


QUERIES = {
    f.__name__: f
    for f in (
        bom_kind, bom_kind_counts, inventory, inventory_rows, codepoint_sha256, sample_prefix, byte_entropy, utf16_chi_square, nul_channel_ratio, unicode_candidates, utf8_valid, ambiguous_marks,
        looks_like_text, detect_corpus, population_by_bucket, claims_by_class, confusion_matrix, overall_metrics, accepted_set_scoring, mismatch_list, run_counters,
        codec_candidates, catalogue_directories, language_codes, directory_codecs, catalog_forward_fill, manifest_classes, scope_filter, filename_crosscheck, strip_bom,
        first_difference, text_identity, outcome_cascade, outcome_counts, coverage_rows, pair_summary, metadata_summary, outcome_pivot, bom_policy, text_loss_risk,
        refusal_reasons, detection_taxonomy, four_metrics, detection_rollup, top_confusions, missing_codecs, divergences, corpus_rollup, reconcile, run_transitions,
        transition_counts, distribution_shift, coverage_anti_join, row_rule_violations, stratified_sample, uniform_sample, malformed_refused, strictness_probe,
        strictness_by_page, convert_corpus, forced_reference, codec_evidence, silent_loss,
        oracle_readings, hash_recheck, token_faults, text_equivalent, greedy_batches,
        audit_rows, audit_outcomes, directory_references, converter_results, token_classes, legacy_detection,
    )
}
