"""Queries over whole texts and all encodings, against plain versions."""

from helpers import SF
from pyspark.sql import functions as F

from glyphsieve.functions import codec_layer as layer
from glyphsieve.plans import corpus, queries


def of_corpus(spark, *columns):
    return {r["doc_id"]: [bytes(v) if isinstance(v, bytearray) else v for v in r[1:]] for r in corpus.corpus(spark, SF).select("doc_id", *columns).collect()}


def test_utf8_valid(spark):
    def valid(data):
        return bool(layer.decode_whole(data, "utf-8")) and not data.isascii()

    files = of_corpus(spark, "content")
    rows = {r["doc_id"]: (r["ascii"], r["valid"], r["valid_cut"]) for r in queries.utf8_valid(spark, SF).collect()}
    assert rows == {i: (data.isascii(), valid(data), valid(data[:-1])) for i, (data,) in files.items()}
    assert {i % 12 for i in rows} == set(range(12))


def test_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in corpus.documents(spark, SF).collect()}
    stripped = {r["doc_id"]: r["text"] for r in queries.strip_bom(spark, SF).collect()}
    assert stripped == {i: "\ufeff" * max(0, i % 3 - 1) + t for i, t in texts.items()}
    rows = {r["doc_id"]: tuple(r[1:]) for r in queries.first_difference(spark, SF).collect()}
    assert rows.keys() == texts.keys() and sum((r[0] or 0) > 200 for r in rows.values()) > 50
    for i, a in texts.items():
        at = max(len(a) - 1, 0) if i % 5 == 2 else i * 7919 % max(len(a), 1)
        b = a if i % 5 == 0 else a[:at] if i % 5 == 1 else a[:at] + "Ω" + a[at + 1 :]
        n = None if a == b else next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        ca, cb = ("", "") if n is None else (a[n : n + 1], b[n : n + 1])
        assert rows[i] == (n, ca and f"U+{ord(ca):04X}", cb and f"U+{ord(cb):04X}", ca, cb, "" if n is None else a[max(n - 20, 0) : n], "" if n is None else a[n : n + 20])


def test_codecs_of_all_encodings(spark):
    files = of_corpus(spark, "content", "text")
    same = {r["doc_id"]: r["equivalent"] for r in queries.text_equivalent(spark, SF).collect()}
    read = {i: layer.strict(data, "cp1252") for i, (data, _) in files.items()}
    assert same == {i: read[i] is not None and layer.strip_bom(read[i]) == files[i][1] for i in files}
    lost = {r["doc_id"]: (r["silent_loss"], r["stage"]) for r in queries.silent_loss(spark, SF).collect()}
    assert lost == {i: (True, "Decode") if i % 48 < 12 and i % 12 != 10 else (False, "") for i in files}
    rows = queries.codec_evidence(spark, SF)
    found = {r["doc_id"]: r for r in rows.collect()}
    assert found.keys() == files.keys()
    for i, r in found.items():
        assert r["constraint"] == round(layer.constraint(files[i][0], queries.DECLARED[i % 12]), 3) and r["accepted"] == (read[i] is not None)
    assert queries.forced_reference(spark, SF).agg(F.sum("n")).first()[0] == len(files)
