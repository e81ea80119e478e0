"""Scoring of detections and audit aggregates. Operator ids: A1-A23, A26, A28-A30, J7, J12, W2, W3, O2, O3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .classify import correct, mismatch_type, scored


def count_if(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0)).cast("long")


def _labels(df: DataFrame, names: list[str], column: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, position int"))


def population(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """A1: bucket, n in the fixed order, zeros included."""
    counts = df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    return _labels(df, dims.BUCKETS, "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def claims(df: DataFrame, actual: str = "actual") -> DataFrame:
    """A2: class, n of what was reported, undetected included."""
    counts = df.groupBy(F.coalesce(F.col(actual), F.lit(dims.UNDETECTED)).alias("class")).agg(F.count("*").alias("n"))
    return _labels(df, [*dims.CLASSES, dims.UNDETECTED], "class").join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def judged(df: DataFrame, accepted: str | None = None) -> DataFrame:
    """Df (expected, actual) with ok and credited: the reported class if it is right, else the expected one."""
    ok = correct(F.col("expected"), F.col("actual"), F.col(accepted) if accepted else None)
    return df.withColumn("ok", ok).withColumn("credited", F.when(F.col("ok"), F.col("actual")).otherwise(F.col("expected")))


def tallied(df: DataFrame) -> DataFrame:
    """judged() rows counted by credited, actual and ok: one pass over the rows, and a few hundred rows for whatever is asked of them."""
    return df.groupBy("credited", "actual", "ok").agg(F.count("*").alias("n"))


def confusion(df: DataFrame) -> DataFrame:
    """Class, tp, fn, fp, tn of judged() rows, one against the rest.

    Each tally counts for the class it is credited to, for the one it is wrongly reported as, and in
    the total, which does without a product of rows and classes and reads the rows once.
    """
    n, zero, wrong = F.col("n"), F.lit(0).cast("long"), ~F.col("ok")
    part = lambda name, tp, fn, fp, total: F.struct(name.alias("class"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), total.alias("total"))
    parts = F.array(
        part(F.col("credited"), F.when(F.col("ok"), n).otherwise(zero), F.when(wrong, n).otherwise(zero), zero, n),
        part(F.when(wrong, F.col("actual")), zero, zero, F.when(wrong, n).otherwise(zero), zero),
    )
    sums = tallied(df).select(F.explode(parts).alias("p")).select("p.*").groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "fn", "fp", "total")])
    # A row a class and one without: the window is over those.
    sums = sums.withColumn("total", F.sum("total").over(Window.partitionBy()))
    out = _labels(df, dims.CLASSES, "class").join(sums, "class", "left")
    count = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    total = F.coalesce(F.max("total").over(Window.partitionBy()), F.lit(0)).cast("long")
    return out.select("class", count("tp").alias("tp"), count("fn").alias("fn"), count("fp").alias("fp"), (total - count("tp") - count("fn") - count("fp")).alias("tn"))


def percent(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded as SQL engines round doubles: the scaled double to its nearest integer. Spark's round() takes the decimal digits instead, which differs at ties."""
    scale = 10.0**digits
    return F.floor(F.when(b > 0, 100.0 * a / b).otherwise(0.0) * scale + 0.5) / scale


def overall(df: DataFrame) -> DataFrame:
    """A4, A5: processed, correct, accuracy, and the micro-averaged false positive and negative rates, from one pass."""
    n, ok = F.col("n"), F.col("ok")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    one = tallied(df).agg(
        total(F.lit(True)).alias("processed"), total(ok).alias("correct"), total(ok & F.col("credited").isin(dims.CLASSES)).alias("tp"),
        total(~ok & F.col("credited").isin(dims.CLASSES)).alias("fn"), total(~ok & F.col("actual").isin(dims.CLASSES)).alias("fp"),
    )
    c = {x: F.col(x) for x in ("processed", "correct", "tp", "fn", "fp")}
    tn = len(dims.CLASSES) * c["processed"] - c["tp"] - c["fn"] - c["fp"]
    return one.select("processed", "correct", percent(c["correct"], c["processed"]).alias("accuracy"), percent(c["fp"], c["fp"] + tn).alias("fpr"), percent(c["fn"], c["fn"] + c["tp"]).alias("fnr"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Accuracy, fnr and fpr of each class."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return matrix.withColumns({"accuracy": percent(tp + tn, tp + fn + fp + tn), "fnr": percent(fn, fn + tp), "fpr": percent(fp, fp + tn)})


def run_counters(df: DataFrame) -> DataFrame:
    """Of files with matched, known (has ground truth) and failed flags."""
    m, k, e = F.col("matched"), F.col("known"), F.col("failed")
    return df.agg(
        F.count("*").alias("discovered"), count_if(~m).alias("skipped_by_filter"), count_if(m & ~k).alias("skipped_no_ground_truth"),
        count_if(m & k & ~e).alias("processed"), count_if(m & k & e).alias("errored"),
    )


def mismatches(df: DataFrame) -> DataFrame:
    """Wrong rows of judged(), under the class they were reported as (FP) and the one they are (FN)."""
    sides = F.array(F.struct(F.col("actual").alias("class"), F.lit("FP").alias("side")), F.struct(F.col("expected").alias("class"), F.lit("FN").alias("side")))
    wrong = df.filter(~F.col("ok")).withColumn("type", mismatch_type(F.col("expected"), F.col("actual")))
    return wrong.select(F.explode(sides).alias("s"), "path", "expected", "actual", "type").select("s.class", "s.side", "path", "expected", "actual", "type").filter("class IS NOT NULL")


# -- audit aggregates: columns are named as in dims.AUDIT_COLUMNS, booleans and nulls inside -------------


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """Rows by the values of columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def pair_summary(df: DataFrame) -> DataFrame:
    """Nine counters for each pair of declared and detected encoding."""
    o, t = F.col("FailureCategory"), F.col("TextIdentical")
    return df.groupBy("ReferenceEncodingDeclared", "DetectedEncoding").agg(
        F.count("*").alias("files"), count_if(F.col("DetectionMatch")).alias("detection_match"), count_if(t).alias("text_identical"), count_if(~t).alias("text_different"),
        *[count_if(o == c).alias(c) for c in ("PASS", "NoOpMislabeled", "Misdetection", "MappingDifference", "SilentDecodeLoss")],
    )


def metadata_summary(df: DataFrame, order: str) -> DataFrame:
    """A10, K7: declared encoding, files, the codec of the first row that has it, and whether it resolves."""
    first = F.min_by("ReferenceEncoding", F.struct(F.col(order)))
    out = df.groupBy("ReferenceEncodingDeclared").agg(F.count("*").alias("files"), first.alias("codec"))
    return out.withColumn("resolved", F.col("codec").isNotNull())


def coverage(df: DataFrame) -> DataFrame:
    """Label, n; the rows add up to all files."""
    s, same = F.col("ConversionStatus"), F.col("ByteIdentical")
    rewritten = (s == "Converted") & ~same
    wide = df.agg(
        count_if(rewritten).alias("rewritten"), (count_if(s == "Converted") - count_if(rewritten)).alias("identical"), *[count_if(s == x).alias(x) for x in dims.STATUSES[1:]]
    )
    names = ["rewritten", "identical", *dims.STATUSES[1:]]
    return wide.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") AS (label, n)"))


def reconciled(df: DataFrame) -> DataFrame:
    """Check, expected, found, ok."""
    o, s = F.col("FailureCategory"), F.col("ConversionStatus")
    one = df.agg(
        F.count("*").alias("files"), count_if(s.isin(dims.STATUSES)).alias("statuses"), count_if(o.isin(dims.OUTCOMES)).alias("outcomes"),
        count_if(~F.col("TextIdentical") & scored(o)).alias("different"), count_if(o.isin(dims.TEXT_CAUSES)).alias("causes"),
    )
    rows = one.select(F.expr("stack(3, 'status', files, statuses, 'outcome', files, outcomes, 'text', causes, different) AS (check, expected, found)"))
    return rows.withColumn("ok", F.when(F.col("check") == "text", F.col("found") <= F.col("expected")).otherwise(F.col("found") == F.col("expected")))


def four_metrics(df: DataFrame) -> DataFrame:
    """Metric, good, total over scored rows."""
    o = F.col("FailureCategory")
    s = scored(o)
    wide = df.agg(
        count_if(s & F.col("DetectionMatch")).alias("d1"), count_if(s & F.col("DetectionMatch").isNotNull()).alias("d2"),
        count_if(s & (o != "SilentDecodeLoss")).alias("s1"), count_if(s).alias("n"), count_if(s & (o != "MappingDifference")).alias("c1"),
        count_if(s & F.col("TextIdentical")).alias("t1"), count_if(s & F.col("TextIdentical").isNotNull()).alias("t2"),
    )
    return wide.select(F.expr("stack(4, 'detection', d1, d2, 'strict_decoding', s1, n, 'conformance', c1, n, 'preservation', t1, t2) AS (metric, good, total)"))


def taxonomy(df: DataFrame) -> DataFrame:
    """N of each detection outcome, with the share among the judged ones (null for others)."""
    counts = df.groupBy("DetectionOutcome").agg(F.count("*").alias("n"))
    judgeable = df.agg(count_if(F.col("DetectionOutcome").isin(dims.JUDGED)).alias("judged"))
    share = F.when(F.col("DetectionOutcome").isin(dims.JUDGED) & (F.col("judged") > 0), F.round(F.col("n") / F.col("judged"), 6))
    return counts.crossJoin(F.broadcast(judgeable)).select("DetectionOutcome", "n", share.alias("share"))


def text_loss(df: DataFrame) -> DataFrame:
    """Of rewritten files those preserved, changed and not compared; and untouched files whose text differs."""
    t, rewritten = F.col("TextIdentical"), (F.col("ConversionStatus") == "Converted") & ~F.col("ByteIdentical")
    return df.agg(
        count_if(rewritten).alias("rewritten"), count_if(rewritten & t).alias("preserved"), count_if(rewritten & ~t).alias("changed"),
        count_if(rewritten & t.isNull()).alias("uncompared"), count_if(F.col("ByteIdentical") & ~t).alias("untouched_different"),
    )


def bom_agreement(df: DataFrame) -> DataFrame:
    """Files whose declared BOM state is known, and those whose bytes agree."""
    known = F.col("ReferenceBOM").isin("BOM", "NoBOM") & F.col("OriginalBOM").isin("BOM", "NoBOM")
    return df.agg(count_if(known).alias("known"), count_if(known & (F.col("ReferenceBOM") == F.col("OriginalBOM"))).alias("agree"))


def refusal_reasons(df: DataFrame) -> DataFrame:
    """By count, then by reason."""
    return df.filter("ConversionStatus = 'Refused'").groupBy("ECReasonCode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ECReasonCode")


def divergences(df: DataFrame, top: int, *extra: str) -> DataFrame:
    """The most frequent pairs of differing code points (and further columns); ties in the order of the keys."""
    keys = ["ReferenceCodePoint", "ConvertedCodePoint", *extra]
    return df.filter("FirstDifferenceIndex IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(top)


def detection_rollup(df: DataFrame) -> DataFrame:
    """Per corpus and over ALL: matches of rows with a reference, and adjusted by those with a code page."""
    known = F.col("ReferenceEncoding").isNotNull()
    page = known & F.col("ReferenceCodePage").isNotNull()
    m = F.col("DetectionMatch")
    out = df.rollup("Corpus").agg(count_if(known & m).alias("good"), count_if(known).alias("total"), count_if(page & m).alias("adjusted_good"), count_if(page).alias("adjusted_total"))
    return out.withColumn("Corpus", F.coalesce("Corpus", F.lit("ALL")))


def missing_codecs(df: DataFrame, top: int = 30) -> DataFrame:
    """A21, first part: the most frequent encodings without a code page."""
    return df.filter("DetectionOutcome = 'NoDotNetCodec'").groupBy("ReferenceEncodingDeclared").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ReferenceEncodingDeclared").limit(top)


def top_confusions(df: DataFrame, references: int = 15, each: int = 3) -> DataFrame:
    """For the most misread references their most frequent detected encodings."""
    pairs = df.filter(~F.col("DetectionMatch")).groupBy("ReferenceEncoding", F.coalesce("DetectedEncoding", F.lit(dims.UNDETECTED)).alias("detected")).agg(F.count("*").alias("n"))
    worst = pairs.groupBy("ReferenceEncoding").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "ReferenceEncoding").limit(references)
    rank = F.row_number().over(Window.partitionBy("ReferenceEncoding").orderBy(F.desc("n"), "detected"))
    return pairs.join(F.broadcast(worst), "ReferenceEncoding").withColumn("rank", rank).filter(F.col("rank") <= each)


def corpus_rollup(df: DataFrame) -> DataFrame:
    """A22."""
    return df.groupBy("Corpus").agg(
        F.count("*").alias("files"), count_if(F.col("ECImplementationDefect")).alias("defects"), count_if(F.col("ECStrictDecodeOutcome") == "Throws").alias("throws"),
        count_if(F.col("BackupIntegrity") == "Verified").alias("backups_verified"), count_if(F.col("CorpusRoundTrip")).alias("round_trips"),
    )


def by_reference(df: DataFrame) -> DataFrame:
    """A column for each outcome."""
    return df.groupBy("ReferenceEncoding").pivot("FailureCategory", dims.OUTCOMES).agg(F.count(F.lit(1))).na.fill(0)


def strictness_by_page(probes: DataFrame) -> DataFrame:
    """One spelling per code page: the shortest, the first by name among equals."""
    best = F.min_by(F.struct("name", "decoder", "encoder"), F.struct(F.length("name").alias("size"), "name"))
    return probes.filter("code_page IS NOT NULL").groupBy("code_page").agg(best.alias("b")).select("code_page", "b.*")
