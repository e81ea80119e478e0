"""Byte and text functions against plain versions, at their edges."""

import itertools

import pytest
from pyspark.sql import functions as F

from glyphsieve import dims
from glyphsieve.functions import codec_layer as layer
from glyphsieve.functions import content as fc
from glyphsieve.operators import detect


def test_truncated_utf8_tails(spark):
    """The native tail rule equals an incremental decoder on every tail of up to three bytes from telling bytes."""
    telling = [0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    cases = [bytes(t) for n in (1, 2, 3) for t in itertools.product(telling, repeat=n)]
    cases = [b"ab\xc3\xa9" + c for c in cases]
    rows = spark.createDataFrame([(bytearray(c),) for c in cases], "content binary").select("content", F.is_valid_utf8(fc.whole_utf8(F.col("content")).cast("string")).alias("ok")).collect()
    wrong = [bytes(r["content"]).hex() for r in rows if r["ok"] != (layer.decode_whole(bytes(r["content"]), "utf-8") is not None)]
    assert not wrong, wrong[:5]


def test_bom_table(spark):
    cases = {"EFBBBF41": "UTF-8", "FFFE4100": "UTF-16LE", "FEFF0041": "UTF-16BE", "FFFE0000": "UTF-32LE", "0000FEFF": "UTF-32BE", "41": "", "": ""}
    rows = spark.createDataFrame([(bytearray.fromhex(h),) for h in cases], "content binary").select(F.hex("content").alias("h"), fc.bom_kind(F.col("content")).alias("k"))
    assert {r["h"]: r["k"] for r in rows.collect()} == cases


def test_sample_and_header(spark):
    row = spark.createDataFrame([(bytearray(b"abc"), bytearray(b""))], "a binary, b binary").select(fc.sample(F.col("a"), 2).alias("s"), fc.sample(F.col("b")).alias("e"), fc.header(F.col("a"), 4).alias("h")).first()
    assert bytes(row["s"]) == b"ab" and row["e"] is None and row["h"] is None
    with pytest.raises(ValueError):
        fc.sample(F.col("a"), 0)


def test_entropy_equals_the_layer(spark):
    blobs = [bytes(range(256)) * 4, b"abac", b"x" * 600, "naïve".encode() * 50]
    rows = detect.entropy(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "id int, content binary"), "id").collect()
    for r in rows:
        assert abs(r["entropy"] - layer.entropy(blobs[r["id"]])) < 1e-9
        assert r["gated"] == (len(blobs[r["id"]]) >= dims.ENTROPY_BYTES and layer.entropy(blobs[r["id"]]) > dims.ENTROPY_BITS)


def test_looks_like_text(spark):
    texts = ["", "abc", "\x01" * 51 + "a" * 449, "\x01" * 50 + "a" * 450, "\r\n\t ", "\ue000" * 2 + "ab", "a" * 500 + "\x01" * 500, "\U0001f600\x00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fc.looks_like_text(F.col("t")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in rows} == {i: layer.looks_like_text(t) for i, t in enumerate(texts)}


def test_strip_and_hash(spark):
    texts = ["", "\ufeff", "\ufeff\ufeffa", "héllo \U0001f600"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fc.strip_bom(F.col("t")).alias("s"), fc.text_sha256(F.col("t")).alias("h")).collect()
    for r in rows:
        assert r["s"] == layer.strip_bom(texts[r["i"]]) and r["h"] == layer.text_sha256(texts[r["i"]])


def test_first_difference(spark):
    pairs = [("abc", "abd", 2), ("abc", "abc", None), ("abc", "ab", 2), ("", "x", 0), ("\U0001f600a", "\U0001f600b", 1)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", fc.first_difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r["i"]: r["d"]["index"] for r in rows} == {i: at for i, (_, _, at) in enumerate(pairs)}
    assert next(r for r in rows if r["i"] == 2)["d"]["code_point_b"] == ""


def test_buckets(spark):
    rows = spark.createDataFrame([(0, None), (1023, 0.0), (1024, 0.05), (16_384, 0.1), (262_144, 0.2)], "n long, x double").select(fc.size_bucket(F.col("n")).alias("s"), fc.constraint_bucket(F.col("x")).alias("c")).collect()
    assert [r["s"] for r in rows] == ["<1K", "<1K", "1K-16K", "16K-256K", ">256K"]
    assert [r["c"] for r in rows] == ["n/a", "0.00", "0.05-0.10 (just below)", "0.10-0.20 (just above)", ">0.20"]
