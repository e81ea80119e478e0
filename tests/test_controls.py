"""Negative controls (Q7): what the audit must tell apart, and what it must refuse to conclude."""

import pytest
from pyspark.sql import functions as F

from glyphsieve import cli, dims
from glyphsieve.functions import codec_layer as layer
from glyphsieve.functions import names
from glyphsieve.operators import compare, integrity, score

LANGUAGES = ["be", "bg", "zh", "en", "ja", "ru", "de", "ar", "vi"]
#: Directory, its codec with evidence of languages.
DIRECTORIES = [
    ("utf-16-be", "utf-16"), ("utf-32-be", "utf-32"), ("utf-16", "utf-16"), ("iso-8859-1", "iso8859-1"), ("koi8-r", "koi8-r"), ("koi8-r-ru", "koi8-r"), ("big5-zh", "big5"), ("windows-1252-en", "cp1252"),
    ("shift_jis-ja", "shift_jis"), ("hp-roman8-en", "hp-roman8"), ("euc-tw-zh", None), ("viscii-vi", None), ("none-none", None), ("utf-8-sig-de", "utf-8-sig"), ("cp864-ar", "cp864"), ("gb18030-zh", "gb18030"),
]


def test_directories(spark):
    dirs = spark.createDataFrame([(d,) for d, _ in DIRECTORIES], "directory string")
    tags = spark.createDataFrame([(t,) for t in LANGUAGES], "tag string")
    assert {r["directory"]: r["codec"] for r in names.directory_codecs(dirs, tags).collect()} == dict(DIRECTORIES)
    # Without that evidence an ambiguous name is its longest codec.
    plain = {r["directory"]: r["codec"] for r in names.directory_codecs(dirs).collect()}
    assert plain["utf-16-be"] == "utf-16-be" and plain["utf-32-be"] == "utf-32-be" and plain["koi8-r"] == "koi8-r"


@pytest.mark.parametrize("codec", ["utf-8", "shift_jis", "euc_jp", "big5", "gb18030", "euc_kr", "gb2312", "utf-16-le", "utf-32-be"])
@pytest.mark.parametrize("spoil", [lambda b: b[:-1], lambda b: bytes([b[0] ^ 0x80]) + b[1:], lambda b: b[1:]])
def test_corruption_never_passes_for_the_text(codec, spoil):
    text = {"euc_kr": "한국어텍스트"}.get(codec, "中文字文字")
    read = layer.strict(spoil(text.encode(codec)), codec)
    assert read is None or layer.text_sha256(read) != layer.text_sha256(text)


@pytest.mark.parametrize(("data", "codec", "text"), [
    (b"", "utf-8", ""), (b"\xef\xbb\xbf", "utf-8", ""), (b"\xff\xfe", "utf-16", ""), (b"\xef\xbb\xbfa", "utf-8-sig", "a"), (b"\xff\xfea\x00", "utf-16", "a"), (b"\xff\xfe\x00\x00a\x00\x00\x00", "utf-32", "a"),
    (b"\xff\xfea\x00", "utf-16-le", "a"), (b"\xfe\xff\x00a", "utf-16-be", "a"),
])
def test_marks_are_no_text(data, codec, text):
    found = layer.reference_reading(data, codec)
    assert found["text"] == text and found["length"] == len(text)


@pytest.mark.parametrize(("a", "b", "same"), [("latin-1", "iso-8859-1", True), ("shift-jis", "shift_jis", True), ("UTF8", "utf-8", True), ("utf-16-le", "utf-16-be", False), ("cp1252", "iso8859-1", False), ("utf-8", "utf-8-sig", False), ("big5", "cp950", False)])
def test_identity_is_of_codecs(a, b, same):
    assert (names.resolve_codec(a) == names.resolve_codec(b)) == same


def test_wrong_byte_order_is_the_corpus_fault():
    text = "some text of a file"
    assert layer.reference_reading(("\ufeff" + text).encode("utf-16-le"), "utf-16-be")["verdict"] == "CorpusByteOrderMislabel"
    assert layer.opposite_decodes(text.encode("utf-16-le"), "utf-16-be") and not layer.opposite_decodes(b"\x00", "utf-16-be") and not layer.opposite_decodes(b"ab", "utf-8")


def test_every_status_is_covered_once(spark):
    rows = [("Converted", False), ("Converted", True), ("Unchanged", True), ("Skipped", True), ("Refused", True), ("Error", True), ("MissingConvertedFile", True)]
    found = {r["label"]: r["n"] for r in score.coverage(spark.createDataFrame(rows, "ConversionStatus string, ByteIdentical boolean")).collect()}
    assert sum(found.values()) == len(rows) and set(found.values()) == {1} and {"rewritten", "identical", *dims.STATUSES[1:]} == set(found)


def test_a_moved_population_raises_the_alarm(spark):
    before = spark.range(1500).select(F.lit("c").alias("Corpus"), F.col("id").cast("string").alias("RelativePath"), F.lit("PASS").alias("FailureCategory"))
    after = before.withColumn("FailureCategory", F.when(F.col("RelativePath").cast("int") < 1344, "ECCodecUnsupported").otherwise("PASS"))
    found = {r["value"]: (r["delta"], r["alarm"]) for r in compare.shifts(before, after).collect()}
    assert found == {"PASS": (-1344, True), "ECCodecUnsupported": (1344, True)}
    few = before.withColumn("FailureCategory", F.when(F.col("RelativePath").cast("int") < 10, "Misdetection").otherwise("PASS"))
    assert not any(r["alarm"] for r in compare.shifts(before, few).collect())


def test_batches_keep_every_path_in_order(spark):
    paths = ["alpha.txt", "beta.txt", "delta.txt", "gamma.txt", "x" * 60]
    rows = integrity.greedy_batches(spark.createDataFrame([("c", p) for p in paths], "codec string, path string"), 40).orderBy("path").collect()
    assert [r["path"] for r in rows] == paths and [r["batch"] for r in rows] == sorted(r["batch"] for r in rows) and rows[-1]["batch"] > 0
    sizes = {}
    for r in rows:
        sizes.setdefault(r["batch"], []).append(len(r["path"]) + dims.BATCH_EXTRA)
    assert all(sum(s) <= 40 or len(s) == 1 for s in sizes.values())


def test_nothing_proves_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for before, after in (("none", "none"), ("empty", "empty")):
        assert cli.run_compare(spark, str(tmp_path / before), str(tmp_path / after), str(tmp_path / "o"), True) == 2
