"""Reports and files. Operator ids: K1-K13."""

from __future__ import annotations

import datetime
import json
import platform
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import compare, score


def sentinels(rows: DataFrame) -> DataFrame:
    """The audit table as strings: booleans as True and False, unmeasured numbers -1, everything else missing ''."""
    have = dict(rows.dtypes)

    def cell(name: str) -> Column:
        if name not in have:
            return F.lit("-1" if name in dims.AUDIT_NUMBERS else "").alias(name)
        value = F.col(f"`{name}`")
        if have[name] == "boolean":
            value = F.when(value, "True").when(~value, "False")
        return F.coalesce(value.cast("string"), F.lit("-1" if name in dims.AUDIT_NUMBERS else "")).alias(name)

    return rows.select(*[cell(n) for n in dims.AUDIT_COLUMNS])


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files with headers, in the order of rows; single: one file, for tables with a bound of their own."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_audit(rows: DataFrame, path: str, single: bool = False) -> None:
    """K5: 56 columns in the fixed order; in one file only where it is small."""
    write_csv(sentinels(rows), path, single)


def write_inventory(rows: DataFrame, path: str) -> None:
    """K4."""
    write_csv(rows.select("Corpus", "RelativePath", "OriginalSize", "OriginalSha256", "OriginalLastWriteUtc", "ReferenceEncodingDeclared", "ReferenceEncoding", "ReferenceBOM", "ReferenceMetadataSource"), path)


def write_summaries(rows: DataFrame, path: str, order: str) -> None:
    """K6, K7: a row for each name or pair of names."""
    write_csv(score.pair_summary(rows), f"{path}/summary.csv", True)
    write_csv(score.metadata_summary(rows, order), f"{path}/metadata-summary.csv", True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A bounded text as one file in a folder, in whatever store Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run(rows: DataFrame, inventory: DataFrame, path: str, name: str) -> None:
    """All files of a run under path/name, which `sources.files.run` reads back; rows should be written or cached before."""
    spark, root = rows.sparkSession, f"{path}/{name}"
    write_audit(rows, f"{root}/audit.csv")
    write_inventory(inventory, f"{root}/inventory.csv")
    write_summaries(rows, root, "RelativePath")
    details(rows).write.mode("overwrite").text(f"{root}/audit-details.json")
    write_text(spark, summary(rows), f"{root}/summary.md")
    write_text(spark, json.dumps(provenance(spark), indent=2), f"{root}/run.json")


def details(rows: DataFrame) -> DataFrame:
    """K9: JSON lines of rows that differ or show a defect, with the first difference nested or null."""
    kept = rows.filter((~F.col("TextIdentical")) | F.coalesce(F.col("ECImplementationDefect"), F.lit(False)))
    have = rows.columns
    inner = [n for n in ("FirstDifferenceIndex", "ReferenceCodePoint", "ConvertedCodePoint", "ReferenceChar", "ConvertedChar", "ContextBefore", "ContextAfter") if n in have]
    first = F.when(F.col("FirstDifferenceIndex").isNotNull(), F.struct(*inner)).alias("firstDifference")
    outer = [n for n in ("Corpus", "RelativePath", "ReferenceEncoding", "DetectedEncoding", "FailureCategory") if n in have]
    return kept.select(F.to_json(F.struct(*outer, first), {"ignoreNullFields": "false"}).alias("value"))


def merged_reports(*parts: DataFrame) -> DataFrame:
    """Reports under one another, by file, without private columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.drop(*[c for c in out.columns if c.startswith("_")]).orderBy("File")


def diagnosis_json(rows: DataFrame) -> DataFrame:
    """A JSON object for each row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def provenance(spark: SparkSession, repository: str = ".") -> dict:
    """What a run was made with."""
    git = subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True, text=True)
    return {
        "finishedUtc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "spark": spark.version, "python": platform.python_version(), "platform": platform.platform(),
        "java": spark.sparkContext._jvm.System.getProperty("java.version"), "commit": git.stdout.strip() or None,
        "conf": {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")},
    }


def write_comparison(before: DataFrame, after: DataFrame, path: str) -> bool:
    """Changed files, their counts, shifts and both runs' metrics, and a page about them; whether a shift is alarming."""
    compare.guarded(before, after)
    spark = before.sparkSession
    changed = compare.transitions(before, after)
    write_csv(changed.orderBy("verdict", *compare.KEY), f"{path}/before-after-summary.csv")
    shifts = compare.shifts(before, after)
    write_csv(shifts.orderBy(F.desc(F.abs("share")), "value"), f"{path}/shifts.csv", True)
    sides = {n: {r["metric"]: [r["good"], r["total"]] for r in score.four_metrics(df).collect()} for n, df in (("before", before), ("after", after))}
    write_text(spark, json.dumps(sides, indent=2), f"{path}/metrics.json")
    # Outcomes and verdicts are closed lists, so these tables are small.
    moves = compare.transition_counts(changed, "before", "after", "verdict").orderBy("verdict", F.desc("n"), "before", "after")
    metrics = spark.createDataFrame([(m, *[count_percent(*sides[n][m]) for n in sides]) for m in sides["before"]], "metric string, before string, after string")
    write_text(spark, "\n".join(["# Before and after", "", *markdown("Metrics", metrics), *markdown("Shifts", shifts.orderBy(F.desc(F.abs("share")), "value")), *markdown("Changed files", moves)]), f"{path}/before-after.md")
    return not shifts.filter("alarm").isEmpty()


def markdown(title: str, df: DataFrame) -> list[str]:
    """A bounded table as lines of Markdown."""
    cells = [" | ".join("" if v is None else str(v) for v in r) for r in df.collect()]
    return [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *[f"| {x} |" for x in cells], ""]


def count_percent(n: int, total: int) -> str:
    """K3 for the driver's text."""
    return f"{n} ({100.0 * n / total if total else 0.0:.2f}%)"


def report(judged: DataFrame, counters: dict, title: str, listed: int | None = None) -> str:
    """K1, K2: the scoring report. Tables have a row a class; the listing of mismatches is by class, side and path.

    listed bounds the listing for the console; None lists all, through an iterator over partitions.
    """
    o = score.overall(judged).first()
    lines = [title, "=" * len(title), "", "Counts", "------", *[f"{k:<32}: {v}" for k, v in counters.items()], "", "Overall", "-------"]
    lines += [f"Accuracy : {o['accuracy']:.2f}%", f"FPR      : {o['fpr']:.2f}%", f"FNR      : {o['fnr']:.2f}%", "", "Reported", "--------"]
    lines += [f"  {r['class']:<22}{r['n']:>6}" for r in sorted(score.claims(judged).collect(), key=lambda r: [*dims.CLASSES, dims.UNDETECTED].index(r["class"]))]
    lines += ["", f"{'Encoding':<14}{'Accuracy':>15}{'FNR':>15}{'FPR':>15}{'TP':>7}{'FN':>7}{'FP':>7}{'TN':>7}"]
    for r in sorted(score.confusion(judged).collect(), key=lambda r: dims.CLASSES.index(r["class"])):
        tp, fn, fp, tn = r["tp"], r["fn"], r["fp"], r["tn"]
        lines.append(f"{r['class']:<14}{count_percent(tp + tn, o['processed']):>15}{count_percent(fn, fn + tp):>15}{count_percent(fp, fp + tn):>15}{tp:>7}{fn:>7}{fp:>7}{tn:>7}")
    wrong = score.mismatches(judged).orderBy("class", "side", "path")
    lines += ["", "Mismatches", "----------"]
    none = True
    for r in (wrong.limit(listed) if listed is not None else wrong).toLocalIterator():
        none = False
        lines.append(f"  [{r['side']}] {r['class']}: {r['path']} [reported: {r['actual'] or dims.UNDETECTED}] [expected: {r['expected'] or dims.UNDETECTED}]")
    return "\n".join([*lines, "(none)"] if none else lines) + "\n"


def summary(rows: DataFrame) -> str:
    """K8: the audit's summary in Markdown, over all and by corpus. Every table has a bound: closed lists, names of encodings, top lists."""
    out = ["# Audit summary", "", f"Files: {rows.count()}", ""]
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in dims.AUDIT_COLUMNS if n not in rows.columns})
    tables = {
        "Outcomes": score.counted(rows, "FailureCategory").orderBy(F.desc("n"), "FailureCategory"), "Operational coverage": score.coverage(rows), "Metrics": score.four_metrics(rows),
        "Detection taxonomy": score.taxonomy(rows).orderBy(F.desc("n"), "DetectionOutcome"), "Detection by corpus": score.detection_rollup(rows).orderBy("Corpus"),
        "Corpora": score.corpus_rollup(rows).orderBy("Corpus"), "Outcomes by corpus": score.counted(rows, "Corpus", "FailureCategory").orderBy("Corpus", F.desc("n"), "FailureCategory"),
        "Text loss": score.text_loss(rows), "Byte-order marks": score.bom_agreement(rows), "Refusals": score.refusal_reasons(rows), "Encodings without a codec": score.missing_codecs(rows),
        "Confusions": score.top_confusions(rows).orderBy(F.desc("n"), "ReferenceEncoding", "detected"), "First differences": score.divergences(rows, 15),
        "Strictness": score.counted(rows.filter("ReferenceEncoding IS NOT NULL"), "ReferenceEncoding", "DecoderStrictness", "EncoderStrictness").orderBy("ReferenceEncoding", "DecoderStrictness"),
        "Forced reference": score.counted(rows.filter("ForcedReferenceOutcome IS NOT NULL"), "ForcedReferenceOutcome").orderBy(F.desc("n"), "ForcedReferenceOutcome"),
        "Ground truth": score.counted(rows, "ReferenceMetadataSource").orderBy(F.desc("n"), "ReferenceMetadataSource"), "Named sources": score.counted(rows.filter("ECExplicitSource IS NOT NULL"), "ECExplicitSource").orderBy(F.desc("n"), "ECExplicitSource"),
        "Reconciliation": score.reconciled(rows),
    }
    return "\n".join(out + [line for title, df in tables.items() for line in markdown(title, df)])
