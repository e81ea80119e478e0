"""Checks of the audit by itself. Operator ids: Q1-Q5, Q7, Q8, J11, A27, A28, P1, P2, C7, W4, X3."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.content import constraint_bucket, size_bucket
from .classify import scored, true

KEY = ["Corpus", "RelativePath"]


def coverage_faults(disk: DataFrame, rows: DataFrame) -> DataFrame:
    """Fault (missing, invented, duplicate), Corpus, RelativePath."""
    named = lambda df, n: df.select(F.lit(n).alias("fault"), *KEY)
    twice = rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")
    return named(disk.join(rows, KEY, "left_anti"), "missing").unionByName(named(rows.join(disk, KEY, "left_anti").select(*KEY).distinct(), "invented")).unionByName(named(twice, "duplicate"))


def rules() -> dict[str, Column]:
    """Q2: what no row may show."""
    c = F.col
    o, d, t = c("FailureCategory"), c("DetectionOutcome"), c("TextIdentical")
    same_text = c("ReferenceTextSha256").eqNullSafe(c("ConvertedTextSha256"))
    binary = true(c("ReferenceEncodingDeclared") == "Binary")
    return {
        "unknown outcome": ~true(o.isin(dims.OUTCOMES)),
        "PASS without identical text": (o == "PASS") & ~true(t),
        "PASS with differing hashes": (o == "PASS") & true(t) & ~same_text,
        "identical text, differing hashes": true(t) & ~same_text,
        "differing text, equal hashes": true(~t) & c("ReferenceTextSha256").isNotNull() & same_text,
        "scored without reference": scored(o) & c("ReferenceEncoding").isNull() & ~binary,
        "verified backup differs": (c("BackupIntegrity") == "Verified") & ~c("BackupSha256").eqNullSafe(c("OriginalSha256")),
        "identical bytes differ": true(c("ByteIdentical")) & ~c("OriginalSha256").eqNullSafe(c("ConvertedSha256")),
        "no-op changed bytes": (o == "NoOpMislabeled") & ~true(c("ByteIdentical")),
        "unknown detection outcome": ~true(d.isin(dims.DETECTION_OUTCOMES)),
        "exact match does not match": (d == "ExactMatch") & ~true(c("DetectionMatch")),
        "text-equivalent codecs match": (d == "TextEquivalent") & ~true(~c("DetectionMatch")),
        "text-equivalent without equal text": (d == "TextEquivalent") & true(~c("DetectionMatch")) & ~true(c("DetectionTextEquivalent")),
        "ambiguous but constrained": (d == "StructurallyAmbiguous") & true(c("ReferenceConstraint") >= dims.CONSTRAINT_FLOOR),
        "misdetection unmeasured": (d == "Misdetection") & c("ReferenceConstraint").isNull(),
        "no codec but a code page": (d == "NoDotNetCodec") & c("ReferenceCodePage").isNotNull(),
        "no reference but a codec": (d == "NoReference") & c("ReferenceEncoding").isNotNull(),
        "never compared": scored(o) & ~binary & ~o.isin(dims.NO_COMPARISON) & t.isNull(),
    }


def rule_violations(rows: DataFrame) -> DataFrame:
    """Q2: rule, Corpus, RelativePath; one pass over the rows."""
    broken = F.filter(F.array(*[F.when(true(v), F.lit(k)) for k, v in rules().items()]), lambda r: r.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), *KEY)


def token_faults(rows: DataFrame) -> DataFrame:
    """Q4: declared tokens that are codecs themselves and were resolved to another, save the acknowledged pairs."""
    from ..functions.names import resolved

    pairs = rows.select("ReferenceEncodingDeclared", "ReferenceEncoding").filter("ReferenceEncoding IS NOT NULL").distinct()
    known = resolved(pairs, "ReferenceEncodingDeclared", "itself").filter(F.col("itself").isNotNull() & (F.col("itself") != F.col("ReferenceEncoding")))
    fine = F.lit(False)
    for token, codec in dims.ACKNOWLEDGED_TOKENS:
        fine = fine | ((F.col("ReferenceEncodingDeclared") == token) & (F.col("ReferenceEncoding") == codec))
    return known.filter(~fine)


def ranked(path: Column, seed: int = dims.SAMPLE_SEED) -> Column:
    """A reproducible order that any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), path))


def uniform_sample(rows: DataFrame, n: int = dims.PER_CORPUS) -> DataFrame:
    """N rows of each corpus."""
    w = Window.partitionBy("Corpus").orderBy(ranked(F.col("RelativePath")), "RelativePath")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def stratified_sample(rows: DataFrame, k: int = dims.PER_STRATUM) -> DataFrame:
    """K rows of each stratum: corpus, encoding, outcome, detection outcome, BOM, size and constraint buckets."""
    strata = ["Corpus", "ReferenceEncoding", "FailureCategory", "DetectionOutcome", "OriginalBOM", "size_bucket", "constraint_bucket"]
    rows = rows.withColumns({"size_bucket": size_bucket(F.col("OriginalByteLength")), "constraint_bucket": constraint_bucket(F.col("ReferenceConstraint"))})
    w = Window.partitionBy(*strata).orderBy(ranked(F.col("RelativePath")), "RelativePath")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def oracle_verdicts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement of two independent readings of each row."""
    a, b = F.col(first), F.col(second)
    verdict = F.when(a.isNull(), "undecodable").when(b.isNull(), "unavailable").when(a == b, "agree").otherwise("disagree")
    return rows.withColumn("verdict", verdict)


def consequential(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Q8: RelativePath, codec, index and both code points of rows whose readings part although the audit holds their text for preserved."""
    from ..functions.content import first_difference

    parted = oracle_verdicts(rows, first, second).filter("verdict = 'disagree' AND TextIdentical").withColumn("d", first_difference(F.col(first), F.col(second)))
    return parted.select("RelativePath", "codec", F.col("d.index").alias("index"), F.col("d.code_point_a").alias("first"), F.col("d.code_point_b").alias("second"))


def hash_faults(rows: DataFrame, text: str, stored: str) -> DataFrame:
    """Q3: rows whose stored text digest is not what the JVM computes from the text (the stored one comes from the codec layer)."""
    from ..functions.content import text_sha256

    return rows.filter(~F.col(stored).eqNullSafe(text_sha256(F.col(text))))


def greedy_batches(items: DataFrame, budget: int = dims.BATCH_CHARS, extra: int = dims.BATCH_EXTRA) -> DataFrame:
    """Codec, path, batch: paths of a codec in order, a new batch where the next path would break the budget.

    The running size restarts with each batch, which no window frame expresses; a codec's paths are walked in order
    by one task. Its bound: batches are the command lines of a converter that runs on one machine over one corpus
    folder, whose paths (some 100 bytes each) that task holds; ten million of them take a gigabyte.
    """
    from .detect import reachable

    reachable(items.sparkSession)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path", kind="stable")
        batch, used, out = 0, 0, []
        for path in pdf["path"]:
            need = len(path) + extra
            if used and used + need > budget:
                batch, used = batch + 1, 0
            used += need
            out.append(batch)
        return pdf.assign(batch=out)[["codec", "path", "batch"]]

    return items.select("codec", "path").groupBy("codec").applyInPandas(walk, "codec string, path string, batch long")
