"""Sources, sinks, comparison, integrity and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from glyphsieve import cli, dims
from glyphsieve.operators import audit, classify, compare, integrity, score
from glyphsieve.plans import corpus as rel
from glyphsieve.sources import catalogue, files, sinks
from helpers import SF


@pytest.fixture
def tree(tmp_path):
    for name, data in {"utf-8/a b.txt": "héllo wörld".encode(), "_side/y.txt": b"y", ".gitignore": b"z", "utf-16/b.txt": "longer text".encode("utf-16-le"), "empty.txt": b"", "x.bak": b"old"}.items():
        path = tmp_path / "c" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "m.csv").write_text('\ufeffEncoding,RelativePath,bom,AlsoValidAs\nus-ascii,utf-8/a b.txt,NoBOM,\nutf-8,"UTF-8/A B.txt",NoBOM,"us-ascii;utf-16LE"\n\nutf-16LE,utf-16/b.txt,NoBOM,\n', encoding="utf-8")
    return tmp_path


def test_corpus_lists_everything(spark, tree):
    rows = files.corpus(spark, str(tree / "c")).collect()
    assert sorted(r["path"] for r in rows) == sorted([".gitignore", "_side/y.txt", "empty.txt", "utf-16/b.txt", "utf-8/a b.txt", "x.bak"])
    assert max(len(r["content"]) for r in files.corpus(spark, str(tree / "c"), max_bytes=3).collect()) == 3
    inv = files.inventory(files.corpus(spark, str(tree / "c")), "t")
    assert inv.count() == 5 and files.unchanged(inv, inv).count() == 0


def test_manifest(spark, tree):
    rows = {r["key"]: r for r in files.manifest(spark, str(tree / "m.csv")).collect()}
    assert set(rows) == {"utf-8/a b.txt", "utf-16/b.txt"} and rows["utf-8/a b.txt"]["Encoding"] == "utf-8" and rows["utf-8/a b.txt"]["Category"] is None
    (tree / "bad.csv").write_text("Encoding\nx\n")
    assert files.manifest(spark, str(tree / "bad.csv")) is None


def test_cli_detect(spark, tree, capsys):
    assert cli.run_detect(spark, str(tree / "c"), "*.TXT", str(tree / "m.csv"), None, str(tree / "r.txt")) == 0
    text = (tree / "r.txt").read_text()
    assert "Accuracy : 100.00%" in text and "skipped_no_ground_truth" in text and "(none)" in text


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "CATALOG.md").write_text("## Provenance\n| `utf-8` | 1 |\n## `utf-8-en/`\n| `a.txt` | x |\n| `A.TXT` | y |\n")
    assert [tuple(r) for r in catalogue.catalogue(catalogue.read_lines(spark, str(tmp_path / "CATALOG.md"))).collect()] == [("utf-8-en/A.TXT", "utf-8")]


def test_run_round_trip_and_compare(spark, tmp_path):
    audit = rel.audit(spark, SF)
    for name, rows in (("before", audit), ("after", rel.second_run(audit))):
        sinks.write_audit(rows.withColumn("ReferenceCodePage", F.col("ReferenceCodePage").cast("string")), str(tmp_path / name / "all" / "audit.csv"), single=True)
    back = files.typed(files.run(spark, str(tmp_path / "before")))
    assert len(files.run(spark, str(tmp_path / "before")).columns) == 56 and back.columns == dims.AUDIT_COLUMNS
    assert {tuple(r) for r in score.four_metrics(back).collect()} == {tuple(r) for r in score.four_metrics(audit).collect()}
    assert cli.run_compare(spark, str(tmp_path / "before"), str(tmp_path / "after"), str(tmp_path / "o"), False) == 2
    assert cli.run_compare(spark, str(tmp_path / "before"), str(tmp_path / "after"), str(tmp_path / "o"), True) == 0
    assert cli.run_compare(spark, str(tmp_path / "none"), str(tmp_path / "after"), str(tmp_path / "o"), True) == 2
    assert cli.run_check(spark, str(tmp_path / "before")) == 1


def test_comparison_guards(spark):
    audit = rel.audit(spark, SF)
    with pytest.raises(ValueError):
        compare.guarded(audit, audit.limit(0))
    with pytest.raises(ValueError):
        compare.shifts(audit, audit, threshold=2)
    assert compare.transitions(audit, audit).count() == 0 and compare.shifts(audit, audit).count() == 0


def test_reports(spark):
    audit = rel.audit(spark, SF)
    text = sinks.summary(audit)
    assert "## Outcomes" in text and "## Reconciliation" in text
    line = json.loads(sinks.details(audit).first()["value"])
    assert "firstDifference" in line
    assert sinks.provenance(spark)["spark"] == spark.version
    judged = score.judged(spark.createDataFrame([("a", "utf-8", None), ("b", "ascii", "utf-8")], "path string, expected string, actual string"))
    assert "[FN] utf-8: a" in sinks.report(judged, {"processed": 2}, "T") and "[FP] utf-8: b" in sinks.report(judged, {}, "T")
    merged = sinks.merged_reports(spark.createDataFrame([("b", 1)], "File string, _x int"), spark.createDataFrame([("a",)], "File string"))
    assert [r["File"] for r in merged.collect()] == ["a", "b"] and merged.columns == ["File"]


def test_request(spark):
    row = files.request(spark, '{"Mode":"forced","Items":[{"Path":"p","ForcedEncoding":"utf-8"}]}').first()
    assert row["Mode"] == "forced" and row["Items"][0]["Path"] == "p"
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        files.request(spark, "{nope").collect()


def test_batches(spark):
    rows = integrity.greedy_batches(spark.createDataFrame([("c", p) for p in ("a" * 10, "b" * 10, "c" * 30, "d")], "codec string, path string"), 40, 2)
    assert [r["batch"] for r in rows.orderBy("path").collect()] == [0, 0, 1, 1]


def test_cascade_controls(spark):
    outcome = lambda **k: classify.outcome(**{n: F.lit(k.get(n)).cast("boolean" if n in ("unsupported", "text_identical", "byte_identical", "matched", "strict_throws") else "string") for n in ("source", "reference", "declared", "unsupported", "backup", "status", "stage", "preset", "text_identical", "byte_identical", "matched", "strict_throws")})
    base = {"source": "Manifest", "reference": "utf-8", "declared": "utf-8", "backup": "Verified", "status": "Converted"}
    cases = [
        (base | {"text_identical": True}, "PASS"), (base | {"text_identical": True, "byte_identical": True, "matched": False}, "NoOpMislabeled"), (base, "MappingDifference"),
        (base | {"strict_throws": True, "matched": True}, "SilentDecodeLoss"), (base | {"matched": False}, "Misdetection"), (base | {"preset": "ReferenceDecodeError", "source": "OutOfScope"}, "ReferenceDecodeError"),
        (base | {"status": "Error", "stage": "Write"}, "WriteError"), (base | {"status": "Error"}, "DecodeError"), (base | {"backup": "Missing"}, "MissingBackup"), (base | {"unsupported": True}, "ECCodecUnsupported"),
        (base | {"reference": None, "declared": "viscii"}, "UnknownReferenceEncoding"), (base | {"source": "SidecarDirectory"}, "OutOfScope"),
    ]
    row = spark.range(1).select(*[outcome(**k).alias(str(i)) for i, (k, _) in enumerate(cases)]).first()
    assert [row[str(i)] for i in range(len(cases))] == [e for _, e in cases]


def test_mutated_audit_is_caught(spark):
    audit = rel.audit(spark, SF).filter("doc_id % 71 != 0 AND doc_id % 73 != 0")
    clean = integrity.rule_violations(audit).count()
    spoiled = audit.withColumn("TextIdentical", F.when(F.col("FailureCategory") == "PASS", F.lit(False)).otherwise(F.col("TextIdentical")))
    assert integrity.rule_violations(spoiled).count() > clean
    assert integrity.rule_violations(audit.withColumn("FailureCategory", F.lit("Nonsense"))).filter("rule = 'unknown outcome'").count() == audit.count()


def test_drift(spark):
    rows = spark.createDataFrame([("a", "m", "x  y\r\n"), ("b", "m", "x y\n"), ("a", "n", "1"), ("b", "n", "2")], "repository string, member string, text string")
    assert {r["member"]: r["versions"] for r in compare.drift(rows).collect()} == {"m": 1, "n": 2}
    more = rows.unionByName(spark.createDataFrame([("c", "n", "1 "), ("a", "o", "p\nq"), ("b", "o", "p\nr")], rows.schema))
    shown = {r["member"]: (r["versions"], r["difference"]) for r in compare.drifted(more).collect()}
    assert shown == {"n": ([["a", "c"], ["b"]], "--- a/n\n+++ b/n\n@@ -1 +1 @@\n-1\n+2"), "o": ([["a"], ["b"]], "--- a/o\n+++ b/o\n@@ -1,2 +1,2 @@\n p\n-q\n+r")}
    assert compare.member_body('int f() { if (x) { "}" } // }\n }', "int f()") == 'int f() { if (x) { "}" } // }\n }' and compare.member_body("int f(", "int g") is None


def test_streaming(spark, tmp_path):
    from glyphsieve.streaming import files as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("héllo wörld".encode())
    q = stream.detected(stream.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "k")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["detected_class"] for r in spark.sql("SELECT * FROM seen").collect()] == ["utf-8"]


def test_audit_of_a_folder(spark, tmp_path):
    """From bytes to a run: every branch of the cascade that a folder can show, and the files of the run read back."""
    root = tmp_path / "c"
    texts = {
        "utf-8-english/a.txt": "naïve café, and more of it".encode(), "utf-8-english/plain.txt": b"plain words only", "koi8-r-ru/b.txt": "Привет, как дела сегодня у тебя".encode("koi8-r"),
        "utf-16le-en/c.txt": "some longer text".encode("utf-16-le"), "euc-jp-ja/d.txt": "日本語のテキストです。これは長い文章".encode("euc_jp"), "viscii-vi/e.txt": b"abc \xe9", "utf-8-english/cut.txt": "déjà vu é".encode()[:-1],
        "none-none/f.bin": bytes((i * 37 + (i >> 3) * 11) % 256 for i in range(4096)), "node_modules/x/g.txt": b"skip", "README.md": b"top", "utf-32be-en/h.txt": "\ufeffwide text here".encode("utf-32-be"),
        "utf-16be-en/wrong.txt": "\ufeffmislabelled text".encode("utf-16-le"), "gb18030-zh/z.txt": "中文文本测试，这是一个比较长的句子。".encode("gb18030"), "euc-kr-ko/k.txt": "한국어 텍스트 테스트 문장입니다".encode("euc_kr"),
    }
    for name, data in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert cli.run_audit(spark, str(root), "mini", str(tmp_path / "run"), None, "top", None, True) == 0
    rows = {r["RelativePath"]: r for r in files.typed(files.run(spark, str(tmp_path / "run"))).collect()}
    assert set(rows) == set(texts) and files.run(spark, str(tmp_path / "run")).columns == dims.AUDIT_COLUMNS
    verdicts = {p: r["FailureCategory"] for p, r in rows.items()}
    assert verdicts == {
        "utf-8-english/a.txt": "PASS", "utf-8-english/plain.txt": "NoOpMislabeled", "koi8-r-ru/b.txt": "PASS", "utf-16le-en/c.txt": "PASS", "euc-jp-ja/d.txt": "PASS", "viscii-vi/e.txt": "UnknownReferenceEncoding",
        "utf-8-english/cut.txt": "ReferenceDecodeError", "none-none/f.bin": "NoReferenceEncoding", "node_modules/x/g.txt": "OutOfScope", "README.md": "OutOfScope", "utf-32be-en/h.txt": "PASS",
        "utf-16be-en/wrong.txt": "CorpusByteOrderMislabel", "gb18030-zh/z.txt": "PASS", "euc-kr-ko/k.txt": "PASS",
    }
    r = rows["koi8-r-ru/b.txt"]
    assert r["ECExplicitSource"] == "koi8-r" and r["BackupIntegrity"] == "Verified" and r["TextIdentical"] and r["ReferenceTextSha256"] == r["ConvertedTextSha256"] and r["DecoderStrictness"]
    assert rows["utf-8-english/plain.txt"]["DetectionTextEquivalent"] and rows["utf-8-english/plain.txt"]["DetectionOutcome"] == "TextEquivalent"
    assert (tmp_path / "run/mini/inventory.csv").exists() and "## Corpora" in spark.read.text(str(tmp_path / "run/mini/summary.md"), wholetext=True).first()[0]
    named = {r["RelativePath"]: r["DetectedEncoding"] for r in rows.values()}
    assert cli.run_audit(spark, str(root), "mini", str(tmp_path / "plain"), None, "top", None, False) == 0
    unnamed = {r["RelativePath"]: r["FailureCategory"] for r in files.typed(files.run(spark, str(tmp_path / "plain"))).collect()}
    assert unnamed["koi8-r-ru/b.txt"] == "RefusedByPolicy" and {p for p in unnamed if unnamed[p] != verdicts[p]} == {"koi8-r-ru/b.txt", "euc-jp-ja/d.txt", "gb18030-zh/z.txt", "euc-kr-ko/k.txt"}
    assert cli.run_check(spark, str(tmp_path / "run")) == 0
    assert cli.run_compare(spark, str(tmp_path / "run"), str(tmp_path / "plain"), str(tmp_path / "diff"), True) == 0
    assert "## Changed files" in spark.read.text(str(tmp_path / "diff/before-after.md"), wholetext=True).first()[0] and len(named) == len(texts)


def test_audit_of_a_converters_report(spark, tmp_path):
    """A converter's own report and working copy: verified, spoiled and missing backups, lost files, files in no report."""
    root = tmp_path / "w"
    (root / "utf-16LE").mkdir(parents=True)
    old = "text of some lengths".encode("utf-16-le")
    for name in ("good", "spoiled", "nobackup", "changed"):
        (root / f"utf-16LE/{name}.txt").write_bytes(b"text of some lengths" if name != "changed" else b"text of other length")
        if name != "nobackup":
            (root / f"utf-16LE/{name}.txt.bak").write_bytes(old)
    (root / "utf-16LE/unreported.txt").write_bytes(old)
    (root / "utf-16LE/skipped.txt").write_bytes(old)
    rows = [(n, "utf-16LE (sure)", "No", "Converted", "") for n in ("good", "spoiled", "nobackup", "changed")] + [("skipped", "(undetected)", "No", "Skipped", "EncodingNotIdentified")]
    text = "File,Encoding,BOM,Target,TargetBOM,Result,ReasonCode\n" + "".join(f"{root}/utf-16LE/{n}.txt,{e},{b},utf-8,No,{r},{c}\n" for n, e, b, r, c in rows)
    (tmp_path / "report.csv").write_text("\ufeff" + text, encoding="utf-8")
    found = files.corpus(spark, str(root))
    listed = audit.inventory(classify.resolve_directories(found.filter("NOT endswith(path, '.bak')"), True), "w")
    original = F.when(F.col("RelativePath").contains("spoiled"), F.lit("0" * 64)).otherwise(F.sha2(F.lit(old), 256))
    listed = listed.withColumn("OriginalSha256", original)
    out = audit.audit(listed, audit.reported(files.converter_report(spark, str(tmp_path / "report.csv"), str(root))), audit.working_copy(found))
    got = {r["RelativePath"].split("/")[1][:-4]: r for r in out.collect()}
    assert {n: r["FailureCategory"] for n, r in got.items()} == {
        "good": "PASS", "spoiled": "BackupIntegrityFailure", "nobackup": "MissingBackup", "changed": "MappingDifference", "unreported": "MissingConvertedFile", "skipped": "UnknownEncoding",
    }
    assert got["changed"]["FirstDifferenceIndex"] == 8 and got["skipped"]["DetectedEncoding"] is None and got["good"]["DetectedEncoding"] == "utf-16-le"


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.src").write_text("\ufeffint f() { }", encoding="utf-8")
    assert [r["text"] for r in files.sources(spark, str(tmp_path / "s" / "*.src")).collect()] == ["int f() { }"]
    rows = spark.createDataFrame([("a", None), (None, 1)], "x string, n int")
    assert [json.loads(r["value"]) for r in sinks.diagnosis_json(rows).collect()] == [{"x": "a", "n": None}, {"x": None, "n": 1}]
