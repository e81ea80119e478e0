"""Codec layer: detection, negative controls, conversion."""

import pytest
from pyspark.sql import functions as F

from glyphsieve import dims
from glyphsieve.functions import codec_layer as layer
from glyphsieve.functions import names
from glyphsieve.operators import detect, integrity

MIXED = "Plain, café, naïve, Ωμέγα, Ж, 日本語, \U0001f600."


@pytest.mark.parametrize("codec", ["utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_unicode_is_detected(codec):
    data = ("The text is long enough to be judged. " * 3).encode(codec)
    assert layer.detect(data) == (("ascii" if codec == "utf-8" else codec), False)
    mark = {c: m for m, c in layer.BOMS}[codec]
    assert layer.detect(mark + data) == (codec, True)


@pytest.mark.parametrize(("codec", "text"), [("euc_jp", "日本語のテキストです。これは長い文章"), ("shift_jis", "日本語のテキストです。これは長い文章"), ("koi8-r", "Привет, как дела сегодня у тебя"), ("gb18030", "中文文本测试，这是一个比较长的句子。"), ("euc_kr", "한국어 텍스트 테스트 문장입니다")])
def test_legacy_is_detected(codec, text):
    assert layer.detect(text.encode(codec)) == (codec, False)


def test_gates():
    noise = bytes((i * 37 + (i >> 3) * 11) % 256 for i in range(4096))
    assert layer.entropy(noise) > dims.ENTROPY_BITS and layer.detect(b"\xef\xbb\xbf" + noise) is None
    assert layer.detect(b"") is None and layer.detect(None) is None
    assert layer.utf16(b"a\x00b\x00c\x00d\x00") is None and layer.utf32("abc".encode("utf-32-le")) is None


@pytest.mark.parametrize("change", [lambda t: t[:-1], lambda t: t + "x", lambda t: t.replace("é", "e"), lambda t: t.replace(",", ";", 1), lambda t: t.upper(), lambda t: "\ufeff\ufeff" + t, lambda t: t.replace("日", "曰"), lambda t: t.replace("\U0001f600", "\U0001f601"), lambda t: t.replace(" ", "\u00a0", 1), lambda t: t + "\r"])
def test_changed_text_changes_the_hash(change):
    assert layer.text_sha256(change(MIXED)) != layer.text_sha256(MIXED)


@pytest.mark.parametrize("codec", ["utf-8", "shift_jis", "euc_jp", "big5", "gb18030"])
def test_corruption_is_rejected(codec):
    data = ("日本" * 3).encode(codec)
    assert layer.strict(data[:-1], codec) is None
    assert layer.strict(data, codec) != layer.strict(bytes([data[0] ^ 0x80]) + data[1:], codec)


def test_reference_reading():
    assert layer.reference_reading(b"\xff\xfeA\x00", "utf-16-be")["verdict"] == "CorpusByteOrderMislabel"
    assert layer.reference_reading(b"\xff", "utf-8")["verdict"] == "ReferenceDecodeError"
    assert layer.reference_reading(b"\xef\xbb\xbf", "utf-8")["text"] == ""
    assert layer.round_trips("é".encode("utf-16"), "é", "utf-16-le") is True


def test_constraint_is_fixed():
    text = "日本語のテキスト".encode("euc_jp")
    assert layer.constraint(text, "euc_jp") == layer.constraint(text, "euc_jp") > 0
    assert layer.constraint(b"abc", "iso8859-1") == 0 == layer.constraint(b"", "utf-8")


def test_conversion_policy():
    latin = "café".encode("latin-1") + b" au lait"
    assert layer.convert(latin, "iso8859-1", None)["status"] == "Refused"
    assert layer.convert(latin, "iso8859-1", "iso-8859-1")["output"] == "café au lait".encode()
    assert layer.convert(latin, "utf-8", "cp1252")["reason"] == "ExplicitSourceConflictsWithDetection"
    assert layer.convert(b"abc", "ascii", None)["status"] == "Unchanged" and layer.convert(b"\x00", None, None)["status"] == "Skipped"
    assert layer.convert(b"\xff", "utf-8", None)["stage"] == "Decode"
    assert layer.convert(b"abc", "ascii", "no-such")["reason"] == "UnsupportedSource"


def test_malformed_sequences_are_refused(spark):
    rows = detect.conformance(spark)
    assert rows.count() == 72 and rows.filter("NOT refused AND NOT acknowledged").count() == 0
    assert rows.filter("implementation = 'python' AND NOT refused").count() == 0 and rows.filter("acknowledged AND refused").count() == 0
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false" and spark.conf.get("spark.sql.legacy.codingErrorAction") == "false"


def test_strictness_pins(spark):
    probed = detect.strictness(spark.createDataFrame([("utf-8",), ("big5",), ("nonsense",)], "name string"))
    expected = spark.createDataFrame([("utf-8", "NonStrict"), ("nonsense", "Unknown"), ("absent", "Strict")], "name string, expected string")
    assert {r["name"]: r["agrees"] for r in detect.expected_strictness(probed, expected).collect()} == {"utf-8": True, "nonsense": True, "absent": False}


def test_names():
    assert names.resolve_codec("UTF-8 (detected)") == "utf-8" and names.resolve_codec("x-mac-ce") == "mac-latin2" and names.resolve_codec("euc-tw") is None and names.resolve_codec("base64") is None
    assert names.tool_spellings("cp1252") == ["cp1252", "windows-1252", "ibm1252"] and "shift_jis" in names.tool_spellings("cp932")


def test_unaided(spark):
    rows = spark.createDataFrame([("utf_8",), ("utf-16-le",), ("ascii",), ("cp1252",), (None,)], "n string").select(names.unaided(F.col("n")).alias("u")).collect()
    assert [r["u"] for r in rows] == [True, True, True, False, False]


def test_legacy_corpora(spark):
    """D11 over texts in four scripts: nearly every file gets its class, and most their very encoding."""
    from helpers import SF

    from glyphsieve.plans import queries

    rows = {r["declared"]: r for r in queries.legacy_detection(spark, SF).collect()}
    assert len(rows) == 11 and sum(r["n"] for r in rows.values()) == 200
    assert all(r["legacy"] >= 0.95 * r["n"] for c, r in rows.items())
    assert sum(r["exact"] for r in rows.values()) >= 0.9 * 200, rows


def test_small_rules(spark):
    assert layer.structure_bearing("utf-8") and layer.structure_bearing("shift_jis") and not layer.structure_bearing("koi8-r") and not layer.structure_bearing("no-such")
    probes = spark.createDataFrame([("windows-1252", 1252), ("cp1252", 1), ("ibm866", 866)], "name string, value int")
    rows = spark.createDataFrame([(1, ["x", "windows-1252", "cp1252"]), (2, ["nothing"]), (3, ["ibm866"])], "id int, tries array<string>")
    assert {r["id"]: r["page"] for r in names.first_available(rows, "tries", probes, "page").collect()} == {1: 1252, 2: None, 3: 866}


def test_tool_names():
    found = {c: layer.tool_name(c) for c in dims.CODE_PAGES}
    assert found["koi8-r"] == "koi8-r" and found["cp1252"] == "cp1252" and found["utf-16-le"] and layer.tool_name("iso8859-16") is None and layer.tool_name(None) is None
    assert all(names.resolve_codec(n) == c for c, n in found.items() if n)


def test_disagreement_of_readings(spark):
    """The two implementations map a few signs differently; where the audit rests on them, it is told so."""
    files = {"same.txt": ("big5", "中文".encode("big5")), "stroke.txt": ("big5", "中".encode("big5") + b"\xa1\xfe"), "bar.txt": ("shift_jis", b"\x81\x5c"), "changed.txt": ("shift_jis", b"\x81\x5c")}
    rows = spark.createDataFrame([(p, k, b, p != "changed.txt") for p, (k, b) in files.items()], "RelativePath string, codec string, content binary, TextIdentical boolean")
    rows = detect.second_reading(detect.reference_text(rows, "codec"), "codec").withColumn("first", F.col("reference.text"))
    found = {r["RelativePath"]: (r["codec"], r["index"], r["first"], r["second"]) for r in integrity.consequential(rows, "first", "other").collect()}
    assert found == {"stroke.txt": ("big5", 1, "U+FF0F", "U+2571"), "bar.txt": ("shift_jis", 0, "U+2015", "U+2014")}
