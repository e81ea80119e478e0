"""Detection and codec work as DataFrame operators.

Operator ids: D1, D6, D9-D13, V9, V12-V17, X1, X8-X12, X14, X15, J8, J14, Q8. Each function takes a
DataFrame with a binary column and adds columns by one pass of Arrow batches; rows that need no
costly measure hand nulls to it.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import codec_layer as layer
from ..functions.content import classified
from ..functions.names import resolve_codec


def reachable(spark: SparkSession) -> None:
    """This package's folder on the workers' path, where it is not installed."""
    here = __file__.rsplit("/", 3)[0]
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (here, env.get("PYTHONPATH", "")) if p)


#: Rows and bytes of an Arrow batch, set where the session has larger ones: files are long, and both sides of the pipe hold whole batches.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    for key, most in ARROW.items():
        held = spark.conf.get(key)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def struct_of(schema: str, one):
    """An Arrow function that makes a struct of each row, by `one` of its values, which gives the fields or none.

    It is marked as not deterministic, so that Spark never evaluates it once more for a filter on what it gives.
    """
    reachable(SparkSession.active())
    bounded_batches(SparkSession.active())
    fields = [part.split(":") for part in schema.removeprefix("struct<").removesuffix(">").split(",")]
    names, kinds = [n for n, _ in fields], [_KINDS[k] for _, k in fields]

    def run(*columns: pa.Array) -> pa.Array:
        cells = [[] for _ in names]
        for row in zip(*columns, strict=True):
            found = one(*(v.as_py() for v in row)) or {}
            for cell, n in zip(cells, names, strict=True):
                cell.append(found.get(n))
        made = pa.StructArray.from_arrays([pa.array(cell, k) for cell, k in zip(cells, kinds, strict=True)], names=names)
        pa.default_memory_pool().release_unused()
        return made

    return F.arrow_udf(run, ", ".join(f"{n} {k}" for n, k in fields)).asNondeterministic()


def _bytes(value) -> bytes:
    return value if value is not None else b""


def _detected(content) -> dict | None:
    found = layer.detect(_bytes(content))
    return {"codec": found[0], "bom": found[1]} if found else None


def detect(df: DataFrame, content: str = "content") -> DataFrame:
    """Df with detected_codec, detected_bom, detected_code_page and detected_class, null where nothing is named."""
    found = struct_of("struct<codec:string,bom:boolean>", _detected)(F.substring(F.col(content), 1, dims.SAMPLE_BYTES))
    return _named(df.withColumn("__d", found))


def _named(out: DataFrame) -> DataFrame:
    """The columns of detect() from the struct __d."""
    out = out.withColumns({"detected_codec": F.col("__d.codec"), "detected_bom": F.col("__d.bom")}).drop("__d")
    out = out.withColumn("detected_code_page", code_pages()[F.col("detected_codec")])
    return out.withColumn("detected_class", classified(F.col("detected_codec"), F.col("detected_code_page"), F.col("detected_bom")))


def _reading(content, codec) -> dict | None:
    if codec is None or content is None:
        return None
    found = layer.reference_reading(_bytes(content), codec)
    text = found.get("text")
    return found | {"round_trip": layer.round_trips(_bytes(content), text, codec) if text is not None else None}


REFERENCE = "struct<text:string,length:int,sha256:string,verdict:string,round_trip:boolean>"


def _referred(text: bool):
    return struct_of(REFERENCE if text else REFERENCE.replace("text:string,", ""), _reading)


def reference_text(df: DataFrame, codec: str, content: str = "content") -> DataFrame:
    """Df with reference (text, length, sha256, verdict, round_trip) under the declared codec."""
    return df.withColumn("reference", _referred(True)(content, codec))


def _equivalent(content, codec, text) -> bool | None:
    if codec is None or text is None:
        return None
    read = layer.strict(_bytes(content), codec)
    return read is not None and layer.strip_bom(read) == text


def text_equivalent(df: DataFrame, codec: str, text: str, content: str = "content") -> DataFrame:
    """Df with equivalent: another codec reads the same text."""

    return df.withColumn("equivalent", equivalence(codec, text, content))


def equivalence(codec: str, text: str, content: str = "content") -> Column:
    """The verdict of text_equivalent() as an expression."""
    return struct_of("struct<same:boolean>", lambda c, k, t: {"same": _equivalent(c, k, t)})(content, codec, text)["same"]


def evidence(df: DataFrame, reference: str, detected: str, candidates: list[str], content: str = "content") -> DataFrame:
    """Df with evidence: what the bytes say against the detected codec."""

    def one(data, ref, det) -> dict | None:
        if data is None or ref is None:
            return None
        names = layer.plausible(_bytes(data), candidates)
        return {
            "constraint": round(layer.constraint(_bytes(data), ref), 3), "accepted": det is not None and layer.strict(_bytes(data), det) is not None,
            "n_plausible": len(names), "n_readings": layer.readings(_bytes(data), names), "plausible": ",".join(names[: dims.SHOWN_CODECS]),
        }

    schema = "struct<constraint:double,accepted:boolean,n_plausible:int,n_readings:int,plausible:string>"
    return df.withColumn("evidence", struct_of(schema, one)(content, reference, detected))


def converted(df: DataFrame, detected: str, explicit: str, content: str = "content") -> DataFrame:
    """Df with conversion (status, stage, reason, output)."""
    run = struct_of("struct<status:string,stage:string,reason:string,output:binary>", lambda c, d, e: layer.convert(_bytes(c), d, e))
    return df.withColumn("conversion", run(content, detected, explicit))


CONVERSION = "struct<codec:string,bom:boolean,status:string,stage:string,reason:string,output:binary>"


def _detected_converted(content, explicit) -> dict:
    data = _bytes(content)
    codec, bom = layer.detect(data) or (None, None)
    return {"codec": codec, "bom": bom, **layer.convert(data, codec, explicit)}


def detected_converted(df: DataFrame, explicit: str, content: str = "content", reference: str | None = None, texts: bool = True) -> DataFrame:
    """D10, X1 and V9 in one pass over the bytes, by one worker a task: the columns of detect(), conversion, and reference where a codec is given.

    texts False: without output and text, for callers that only ask for verdicts and digests.
    """
    made = {"__x": struct_of(CONVERSION if texts else CONVERSION.replace(",output:binary", ""), _detected_converted)(content, explicit)}
    if reference:
        made["reference"] = _referred(texts)(content, reference)
    x = lambda *names: F.struct(*[F.col(f"__x.{n}").alias(n) for n in names])
    out = df.withColumns(made).withColumns({"__d": x("codec", "bom"), "conversion": x("status", "stage", "reason", *(["output"] if texts else []))})
    return _named(out.drop("__x"))


DIAGNOSIS = "struct<codec:string,stage:string,error:string,message:string,sha256:string,length:int,encoded:int,head:string>"


def diagnosed(df: DataFrame, codec: str, mode: str, out: str, content: str = "content", decode_only: bool = False) -> DataFrame:
    """Df with the diagnosis of one conversion under production or strict decoding."""
    return df.withColumn(out, diagnosis(codec, mode, content, decode_only))


def diagnosis(codec: str, mode: str, content: str = "content", decode_only: bool = False) -> Column:
    """The diagnosis of diagnosed() as an expression, so that several share one pass."""
    if mode not in ("production", "strict"):
        raise ValueError(f"no such mode: {mode}")
    run = struct_of(DIAGNOSIS, lambda c, k: layer.diagnose(_bytes(c), k, True, mode, decode_only) if k is not None else None)
    return run(content, codec)


def silent_loss(df: DataFrame) -> DataFrame:
    """Production decoding went through where strict decoding did not."""
    return df.withColumn("silent_loss", F.coalesce(F.col("strict.stage") == "Decode", F.lit(False)) & F.col("production.stage").isNull())


def _forced(content, codec, sha256) -> dict | None:
    if content is None or codec is None:
        return None
    if codec not in dims.CODE_PAGES:
        return {"outcome": "NoDotNetCodec"}
    words = []
    for mode in ("production", "strict"):
        found = layer.diagnose(content, codec, True, mode, True)
        words.append(found["stage"] or ("PASS" if found["sha256"] == sha256 else "DIFFERS"))
    return {"outcome": f"assignAfter={words[0]};strictUpFront={words[1]}"}


def forced_reference(df: DataFrame, reference: str, sha256: str, outcome: str, content: str = "content") -> DataFrame:
    """Df with forced, for rows that neither passed nor needed nothing, and have a reference; one pass, others hand over nulls."""
    wanted = F.col(reference).isNotNull() & ~F.col(outcome).isin("PASS", "NoOpCorrect")
    run = struct_of("struct<outcome:string>", _forced)
    return df.withColumn("forced", run(F.when(wanted, F.col(content)), reference, sha256)["outcome"])


# -- statistics of bytes -----------------------------------------------------------------------------


def _head(content: str) -> Column:
    return F.substring(F.col(content), 1, dims.SAMPLE_BYTES)


def nul_shares(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Key, even and odd: the share of NUL bytes in each channel of the sample's two-byte units, null without any."""
    run = struct_of("struct<even:double,odd:double>", lambda data: dict(zip(("even", "odd"), layer.nul_shares(_bytes(data)) or (None, None), strict=True)))
    return df.select(key, run(_head(content)).alias("x")).select(key, "x.*")


def _candidates(content) -> dict:
    data = _bytes(content)
    little, big = layer.utf32_orders(data)
    return {"utf32": "LE" if little else "BE" if big else None, "utf16": {"utf-16-le": "LE", "utf-16-be": "BE"}.get(layer.utf16_order(data))}


def unicode_candidates(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Key, utf32 and utf16: the byte order that the sample's units allow, LE preferred for UTF-32, null for none."""
    return df.select(key, struct_of("struct<utf32:string,utf16:string>", _candidates)(_head(content)).alias("x")).select(key, "x.*")


def _counts(content: bytes | None, even: bool) -> np.ndarray:
    """How often each byte stands in each channel of the sample: two rows of 256."""
    data = np.frombuffer((content or b"")[: dims.SAMPLE_BYTES], np.uint8)
    if even:
        data = data[: len(data) & ~1]
    return np.array([np.bincount(data[k::2], minlength=256) for k in (0, 1)])


def _entropy(content) -> dict | None:
    n = _counts(content, False).sum(axis=0)
    total = int(n.sum())
    p = (n[n > 0] / max(total, 1)).tolist()
    # Shares that are powers of two are exact, and so is their sum; a single value gives -0.0, as the sum in SQL does.
    return {"n_bytes": total, "entropy": -math.fsum(x * math.log2(x) for x in p)} if total else None


def entropy(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Key, n_bytes, entropy (bits a byte) and gated: too even a distribution to be text. Rows without bytes are left out."""
    found = struct_of("struct<n_bytes:bigint,entropy:double>", _entropy)(F.substring(F.col(content), 1, dims.SAMPLE_BYTES))
    out = df.select(key, found.alias("e")).select(key, "e.*").filter("n_bytes IS NOT NULL")
    return out.withColumn("gated", (F.col("n_bytes") >= dims.ENTROPY_BYTES) & (F.col("entropy") > dims.ENTROPY_BITS))


def _chi_square(content) -> dict | None:
    n = _counts(content, True).astype(float)
    units = n[0].sum()
    return {"units": int(units), "chi_even": float(256 / units * (n[0] ** 2).sum() - units), "chi_odd": float(256 / units * (n[1] ** 2).sum() - units)} if units else None


def chi_square(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Key, units and each channel's chi-square against a uniform distribution, over whole two-byte units. Rows without any are left out."""
    found = struct_of("struct<units:bigint,chi_even:double,chi_odd:double>", _chi_square)(F.substring(F.col(content), 1, dims.SAMPLE_BYTES))
    return df.select(key, found.alias("x")).select(key, "x.*").filter("units IS NOT NULL")


# -- the codecs themselves --------------------------------------------------------------------------


def strictness(names: DataFrame) -> DataFrame:
    """Name, code_page, available, decoder and encoder strictness of distinct codec names."""

    def one(name) -> dict:
        codec = resolve_codec(name)
        return {"codec": codec, "available": codec is not None, "decoder": layer.decoder_strictness(name), "encoder": layer.encoder_strictness(name)}

    found = names.select("name").distinct().withColumn("s", struct_of("struct<codec:string,available:boolean,decoder:string,encoder:string>", one)("name"))
    return found.select("name", "s.codec", code_pages()[F.col("s.codec")].alias("code_page"), "s.available", "s.decoder", "s.encoder")


def probe_universe(spark: SparkSession, *columns: DataFrame) -> DataFrame:
    """The baseline and every name that the given one-column tables hold."""
    out = spark.createDataFrame([(n,) for n in dims.BASELINE], "name string")
    for c in columns:
        out = out.union(c.toDF("name").filter("name IS NOT NULL AND name != ''"))
    return out.distinct()


def expected_strictness(probed: DataFrame, expected: DataFrame) -> DataFrame:
    """Name, expected, decoder, agrees: pinned strictness against what is measured (an unprobed name disagrees)."""
    joined = expected.join(probed.select("name", "decoder"), "name", "left")
    return joined.withColumn("agrees", F.coalesce(F.col("decoder") == F.col("expected"), F.lit(False)))


# Byte sequences that no strict decoder may read, by codec.
MALFORMED = {
    "utf-8": [
        b"abc\xc3", b"abc\xe4\xb8", b"abc\xf0\x9f\x8c", b"abc\x80def", b"abc\xfe", b"abc\xff", b"abc\xc0\x80", b"abc\xc0\xaf", b"abc\xed\xa0\x80",
        b"abc\xf5\x80\x80\x80", b"\xbf\xbf",
    ],
    "utf-16-le": [b"a\x00b", b"\x00\xd8A\x00", b"\x00\xdcA\x00"],
    "utf-16-be": [b"\x00a\x00", b"\xd8\x00\x00A"],
    "utf-32-le": [b"a\x00\x00", b"\x00\x00\x11\x00", b"\x00\xd8\x00\x00"],
    "utf-32-be": [b"\x00\x11\x00\x00"],
    "ascii": [b"abc\x80", b"caf\xe9"],
    "shift_jis": [b"abc\x82", b"abc\x82 "],
    "euc_jp": [b"abc\xa4", b"abc\xa4 ", b"abc\x8f\xa1"],
    "iso2022_jp": [b"abc\x1b$", b"abc\x1b$Z"],
    "big5": [b"abc\xa4", b"abc\xa4 "],
    "gb18030": [b"abc\xb0", b"abc\x810\x81"],
    "gb2312": [b"abc\xb0 "],
    "euc_kr": [b"abc\xb0", b"abc\xb0 "],
}
#: What the second implementation reads all the same: its UTF-32 takes surrogates for characters.
ACKNOWLEDGED = [("utf-32-le", b"\x00\xd8\x00\x00")]
#: Charset of the JVM for a codec, the second implementation.
JVM = {
    "utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-le": "UTF-32LE", "utf-32-be": "UTF-32BE", "ascii": "US-ASCII", "shift_jis": "Shift_JIS",
    "euc_jp": "EUC-JP", "iso2022_jp": "ISO-2022-JP", "iso2022_kr": "ISO-2022-KR", "big5": "Big5", "gb18030": "GB18030", "gb2312": "GB2312", "euc_kr": "EUC-KR", "koi8-r": "KOI8-R",
    "cp866": "IBM866", **{f"cp{n}": f"windows-{n}" for n in range(1250, 1259)}, **{f"iso8859-{n}": f"ISO-8859-{n}" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 15)},
}
REPLACED = "\ufffd"


@contextlib.contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Inside, expressions are made that take any charset of the JVM and put U+FFFD for what they can't read."""
    keys = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def second_reading(df: DataFrame, codec: str, content: str = "content") -> DataFrame:
    """Q8: df with other: the text as the JVM reads it strictly, null where it has no such charset or can't read the bytes.

    What it can't read it replaces; a text with a replacement character is one that was not
    read, unless writing it again gives the same bytes.
    """
    value = F.col(content)
    with java_charsets(df.sparkSession):
        read = write = F.lit(None)
        for name, charset in JVM.items():
            read = F.when(F.col(codec) == name, F.decode(F.when(F.col(codec) == name, value), charset)).otherwise(read)
        df = df.withColumn("__read", read.cast("string"))
        for name, charset in JVM.items():
            doubt = (F.col(codec) == name) & F.contains(F.col("__read"), F.lit(REPLACED))
            write = F.when(doubt, F.encode(F.when(doubt, F.col("__read")), charset)).otherwise(write)
        df = df.withColumn("__written", write.cast("binary"))
        whole = ~F.contains(F.col("__read"), F.lit(REPLACED)) | F.coalesce(F.col("__written") == value, F.lit(False))
        return df.withColumn("other", F.when(whole, F.col("__read"))).drop("__read", "__written")


def conformance(spark: SparkSession) -> DataFrame:
    """Codec, payload, implementation (python, jvm), refused and acknowledged, a row for each malformed sequence and implementation."""
    rows = [(codec, payload, (codec, payload) in ACKNOWLEDGED) for codec, payloads in MALFORMED.items() for payload in payloads]
    rows = spark.createDataFrame(rows, "codec string, payload binary, lenient boolean")
    refused = struct_of("struct<refused:boolean>", lambda c, p: {"refused": layer.strict(p, c) is None})
    first = rows.select("codec", "payload", F.lit("python").alias("implementation"), refused("codec", "payload")["refused"].alias("refused"), F.lit(False).alias("acknowledged"))
    other = second_reading(rows, "codec", "payload")
    return first.unionByName(other.select("codec", "payload", F.lit("jvm").alias("implementation"), F.col("other").isNull().alias("refused"), F.col("lenient").alias("acknowledged")))


def code_pages() -> Column:
    return F.create_map(*[F.lit(x) for pair in dims.CODE_PAGES.items() for x in pair])
