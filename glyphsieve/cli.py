"""Command line. Operator ids: F12, C9.

    python -m glyphsieve.cli detect FOLDER [PATTERN] --manifest FILE [--report FILE]
    python -m glyphsieve.cli audit FOLDER --name NAME --out FOLDER (--manifest FILE | --directories top|parent) [--report FILE] [--unnamed]
    python -m glyphsieve.cli compare BEFORE AFTER --out FOLDER [--allow-shift]
    python -m glyphsieve.cli check RUN
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import audit, classify, compare, detect, integrity, score
from .sources import catalogue, files, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("glyphsieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run_detect(spark: SparkSession, folder: str, pattern: str, manifest: str | None, listing: str | None, report: str | None) -> int:
    rows = files.corpus(spark, folder, max_bytes=65_536).withColumn("matched", classify.matches(F.col("path"), pattern))
    if manifest:
        truth = files.manifest(spark, manifest)
        if truth is None:
            print("the manifest lacks a needed column", file=sys.stderr)
            return 2
        rows = files.with_manifest(rows, truth).withColumn("known", F.col("Encoding").isNotNull())
        rows = rows.withColumn("expected", names.manifest_class(F.col("Encoding"), F.col("BOM")))
        rows = rows.withColumn("accepted", names.accepted_classes(F.col("expected"), F.col("AlsoValidAs")))
    else:
        truth = catalogue.catalogue(catalogue.read_lines(spark, listing)).withColumn("key", F.lower("path")).drop("path")
        rows = rows.join(truth, F.lower("path") == F.col("key"), "left").drop("key").withColumn("known", F.col("token").isNotNull())
        rows = rows.withColumn("expected", names.token_class(F.col("token"), F.col("content")))
        rows = rows.withColumn("accepted", F.array("expected"))
    counters = score.run_counters(rows.withColumn("failed", F.lit(False))).first().asDict()
    found = detect.detect(rows.filter("matched AND known")).withColumn("actual", F.col("detected_class"))
    judged = score.judged(found.select("path", "expected", "accepted", "actual"), "accepted")
    text = sinks.report(judged, counters, "Encoding detection report")
    print(text)
    if report:
        with open(report, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


def run_audit(spark: SparkSession, folder: str, name: str, out: str, manifest: str | None, directories: str | None, report: str | None, explicit: bool) -> int:
    """From a folder to a run: every file audited, with the conversion made here or, given a converter's report, with its working copy."""
    found = files.corpus(spark, folder)
    kept = found.filter(~F.col("path").endswith(".bak"))
    if manifest:
        truth = files.manifest(spark, manifest, exact=True)
        if truth is None:
            print("the manifest lacks a needed column", file=sys.stderr)
            return 2
        truth = truth.withColumn("RelativePath", F.col("key"))
        listed = classify.resolve_manifest(kept, truth)
    else:
        languages = names.language_tags(kept.select(F.get(classify.directories(F.col("path")), F.lit(0)).alias("directory")).distinct().filter("directory IS NOT NULL"))
        listed = classify.resolve_directories(kept, directories == "top", languages)
    inventory = audit.inventory(listed, name)
    if report:
        contents = audit.working_copy(found)
        # What stood there before the conversion is the backup, where there is one.
        before = contents.select("RelativePath", F.coalesce("backup", "current").alias("__b"))
        inventory = inventory.join(before, "RelativePath").withColumns({"OriginalByteLength": F.octet_length("__b").cast("long"), "OriginalSha256": F.sha2("__b", 256)}).drop("__b")
        results = audit.reported(files.converter_report(spark, report, folder))
    else:
        results, contents = audit.convert(listed, explicit)
    rows = audit.audit(inventory, results, contents).persist()
    listing = files.inventory(kept, name).join(inventory.drop("Corpus", "OriginalSha256", "OriginalByteLength"), "RelativePath", "left")
    sinks.write_run(rows, listing, out, name)
    broken = score.reconciled(rows).filter("NOT ok").count()
    faults = integrity.coverage_faults(inventory.select("Corpus", "RelativePath"), rows.select("Corpus", "RelativePath")).count()
    rows.unpersist()
    return classify.exit_code(broken + faults, 0, False)


def run_compare(spark: SparkSession, before: str, after: str, out: str, allowed: bool) -> int:
    try:
        alarm = sinks.write_comparison(files.typed(files.run(spark, before)), files.typed(files.run(spark, after)), out)
    except Exception as e:  # a missing or empty run proves nothing
        print(f"not comparable: {e}", file=sys.stderr)
        return 2
    return 2 if alarm and not allowed else 0


def run_check(spark: SparkSession, root: str) -> int:
    rows = files.typed(files.run(spark, root))
    broken = integrity.rule_violations(rows)
    problems = score.reconciled(rows).filter("NOT ok")
    n, bad = broken.count(), problems.count()
    for r in broken.groupBy("rule").agg(F.count("*").alias("n")).collect():
        print(f"{r['rule']}: {r['n']}")
    return classify.exit_code(bad, n, True)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphsieve")
    sub = parser.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect")
    d.add_argument("folder")
    d.add_argument("pattern", nargs="?", default="*")
    truth = d.add_mutually_exclusive_group(required=True)
    truth.add_argument("--manifest")
    truth.add_argument("--catalogue")
    d.add_argument("--report")
    u = sub.add_parser("audit")
    u.add_argument("folder")
    u.add_argument("--name", required=True)
    u.add_argument("--out", required=True)
    reference = u.add_mutually_exclusive_group(required=True)
    reference.add_argument("--manifest")
    reference.add_argument("--directories", choices=["top", "parent"])
    u.add_argument("--report")
    u.add_argument("--unnamed", action="store_true")
    k = sub.add_parser("compare")
    k.add_argument("before")
    k.add_argument("after")
    k.add_argument("--out", required=True)
    k.add_argument("--allow-shift", action="store_true")
    c = sub.add_parser("check")
    c.add_argument("run")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "detect":
        return run_detect(spark, a.folder, a.pattern, a.manifest, a.catalogue, a.report)
    if a.command == "audit":
        return run_audit(spark, a.folder, a.name, a.out, a.manifest, a.directories, a.report, not a.unnamed)
    if a.command == "compare":
        return run_compare(spark, a.before, a.after, a.out, a.allow_shift)
    return run_check(spark, a.run)


__all__ = ["compare", "main"]

if __name__ == "__main__":
    sys.exit(main())
