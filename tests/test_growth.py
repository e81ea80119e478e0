"""Steps whose cost must not outgrow the input: no per-byte rows or arrays in the JVM, few Python passes, no shuffle of contents."""

import duckdb
import numpy as np
import pytest
from helpers import SF, same_rows
from pyspark.sql import functions as F

from glyphsieve.functions import codec_layer as layer
from glyphsieve.operators import detect, score
from glyphsieve.plans import oracles, queries



def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["unicode_candidates", "nul_channel_ratio"])
def test_units_are_counted_without_arrays(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "regexp_extract_all" not in text and text.count("ArrowEvalPython") == 1


def test_shares_and_orders(spark):
    blobs = [b"", b"a", b"\x00a", b"a\x00" * 5, b"\x00a" * 5, b"a\x00" * 4, b"a\x00\x00\x00" * 4, b"\x00\x00\x00a" * 4 + b"x", b"a\x00\x11\x00" * 4, None]
    rows = spark.createDataFrame([(i, b if b is None else bytearray(b)) for i, b in enumerate(blobs)], "id int, content binary")
    shares = {r["id"]: (r["even"], r["odd"]) for r in detect.nul_shares(rows, "id").collect()}
    assert shares == {0: (None, None), 1: (None, None), 2: (1, 0), 3: (0, 1), 4: (1, 0), 5: (0, 1), 6: (0.5, 1), 7: (1, 0.5), 8: (0, 1), 9: (None, None)}
    orders = {r["id"]: (r["utf32"], r["utf16"]) for r in detect.unicode_candidates(rows, "id").collect()}
    assert orders == {**{i: (None, None) for i in range(10)}, 3: (None, "LE"), 4: (None, "BE"), 6: ("LE", None), 7: ("BE", None), 8: (None, "LE")}


@pytest.mark.parametrize(("name", "passes"), [("forced_reference", 2), ("silent_loss", 1), ("claims_by_class", 1), ("audit_outcomes", 3), ("audit_rows", 3), ("legacy_detection", 1)])
def test_passes_are_few_and_batches_small(spark, name, passes):
    """Every pass holds a worker and a batch for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    text = plan(queries.QUERIES[name](spark, SF))
    assert len([line for line in text.splitlines() if "ArrowEvalPython" in line and "content" in text]) <= passes
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


@pytest.mark.parametrize("name", ["audit_rows", "audit_outcomes", "converter_results"])
def test_contents_are_not_dealt(spark, name):
    """No join but with a broadcast table has contents on a side."""
    joins = [j for j in plan(queries.QUERIES[name](spark, SF)).splitlines() if "Join" in j and "rightHint=(strategy=broadcast)" not in j]
    assert len(joins) <= (1 if name == "converter_results" else 1), joins


def test_directory_codec(spark):
    from glyphsieve.functions import names

    given = [*queries.DIRECTORIES, "None", "", " UTF-8-x ", None]
    dirs = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "id int, directory string")
    plain = {r["directory"]: r["codec"] for r in names.directory_codecs(dirs.filter("directory IS NOT NULL")).collect()}
    assert {r["directory"]: r["codec"] for r in dirs.select("directory", names.directory_codec(F.col("directory")).alias("codec")).collect()} == plain | {None: None}


def test_cyrillic_weights():
    """The scores from byte counts are those from the decoded characters."""
    text = "Съешь же ещё этих мягких французских булок, да выпей чаю" * 3
    for codec in layer.CYRILLIC:
        data = text.encode(codec)
        weights, undefined = layer._cyrillic_weights()[codec]
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        plain = sum(len(layer._FREQUENT) - layer._FREQUENT.index(x) if x in layer._FREQUENT else -8 for x in text if x > "\x7f")
        assert not counts[undefined].any() and int(counts[128:] @ weights) == plain
        assert all((layer.strict(bytes([b]), codec) is None) == (b in undefined) for b in range(256))


@pytest.mark.parametrize("name", ["byte_entropy"])
def test_short_files_against_sql(spark, tmp_path, name):
    """Files of one value, and of values in exact powers of two, which tables of more documents have."""
    texts = ["A", "AAAA", "-", "AB" * 3, "ABCC" * 3, "AABC" * 48, "é", "A" * 127 + "B"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(12 * i + v, t) for i, t in enumerate(texts) for v in range(12)], "doc_id bigint, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    out, df = con.execute(oracles.SQL[name]), queries.QUERIES[name](spark, str(tmp_path))
    rows, want = df.collect(), out.fetchall()
    assert same_rows(rows, df.columns, [d[0] for d in out.description], want), sorted(set(map(str, map(tuple, rows))) ^ set(map(str, want)))[:6]


def test_rates_at_ties(spark):
    """A matrix of 640,000 rows, where shares end in a five at the seventh digit."""
    rows = [(a, 640_000) for a in (402, 406, 1000, 639_598, 0, 640_000)] + [(0, 0)]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", score.percent(F.col("a"), F.col("b")).alias("x")).collect()
    sql = duckdb.connect().execute(f"SELECT a, b, {oracles._share('a', 'b')} FROM (VALUES {str(rows)[1:-1]}) AS t(a, b)").fetchall()
    assert {(r["a"], r["b"]): r["x"] for r in found} == {(a, b): x for a, b, x in sql}
