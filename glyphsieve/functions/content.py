"""Expressions over bytes and text that stay inside the JVM.

"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .. import dims

#: Longest signature first where one starts another: (bytes, class, kind).
SIGNATURES = [
    ("FFFE0000", "utf-32LE-bom", "UTF-32LE"), ("0000FEFF", "utf-32BE-bom", "UTF-32BE"), ("EFBBBF", "utf-8-bom", "UTF-8"),
    ("FFFE", "utf-16LE-bom", "UTF-16LE"), ("FEFF", "utf-16BE-bom", "UTF-16BE"),
]


def sample(content: Column, limit: int = dims.SAMPLE_BYTES) -> Column:
    """S3: the bytes a detector may look at; empty content is null."""
    if limit <= 0:
        raise ValueError("a sample needs a positive size")
    return F.when(F.octet_length(content) > 0, F.substring(content, 1, limit))


def header(content: Column, size: int) -> Column:
    """The first bytes, null where there are fewer."""
    return F.when(F.octet_length(content) >= size, F.substring(content, 1, size))


def _signed(content: Column, index: int) -> Column:
    out = None
    for signature in SIGNATURES:
        hit = F.startswith(content, F.unhex(F.lit(signature[0])))
        out = F.when(hit, signature[index]) if out is None else out.when(hit, signature[index])
    return out


def bom_class(content: Column) -> Column:
    """Class of the byte-order mark, null without one; what follows is not looked at."""
    return _signed(content, 1)


def bom_kind(content: Column) -> Column:
    """D3: the signature's name, '' without one."""
    return F.coalesce(_signed(content, 2), F.lit(""))


def sniffed(token: Column, content: Column) -> Column:
    """Class of the ambiguous tokens utf-16 and utf-32, by the mark the bytes begin with, little-endian without one."""
    starts = lambda h: F.startswith(content, F.unhex(F.lit(h)))
    wide = F.when(starts("FFFE0000"), "utf-32LE-bom").when(starts("0000FEFF"), "utf-32BE-bom").otherwise("utf-32LE")
    half = F.when(starts("FFFE"), "utf-16LE-bom").when(starts("FEFF"), "utf-16BE-bom").otherwise("utf-16LE")
    return F.when(token == "utf-32", wide).when(token == "utf-16", half)


#: Unfinished sequences at the end, by length; second bytes exclude what can never become valid.
_TAILS = {1: "[CD].|E.|F[0-4]", 2: "E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].|F[1-3][89AB].|F48.", 3: "(F0[9AB].|F[1-3][89AB].|F48.)[89AB]."}


def whole_utf8(content: Column) -> Column:
    """V2 for UTF-8: content without an unfinished sequence of at most three bytes at its end."""
    size, tail = F.octet_length(content), F.lit(0)
    for n, form in _TAILS.items():
        end = F.hex(F.substring(content, -n, n))
        tail = F.when((size >= n) & end.rlike(f"^({form})$") & ~end.rlike("^C[01]$"), n).otherwise(tail)
    return F.substring(content, F.lit(1), (size - tail).cast("int"))


def valid_utf8(content: Column) -> Column:
    """Strictly valid UTF-8 up to an unfinished tail, not empty and not pure ASCII."""
    whole = whole_utf8(content)
    return (F.octet_length(whole) > 0) & F.is_valid_utf8(whole.cast("string")) & ~is_ascii(content)


def is_ascii(content: Column) -> Column:
    """All bytes below 0x80: ISO-8859-1 maps each byte to a character, and no other keeps its length in UTF-8."""
    return F.octet_length(F.decode(content, "ISO-8859-1")) == F.octet_length(content)


def looks_like_text(text: Column) -> Column:
    """V3: of the first 500 characters nine tenths are neither control nor private use; CR, LF, tab and space are fine."""
    head = F.left(text, F.lit(dims.TEXT_SCALARS))
    bad = F.regexp_count(head, F.lit(r"[\p{Cc}\p{Co}&&[^\r\n\t]]"))
    return F.when(F.length(head) > 0, F.length(head) - bad >= dims.TEXT_SHARE * F.length(head)).otherwise(False)


def classified(codec: Column, code_page: Column, bom: Column) -> Column:
    """Class of a codec. BOM-less Unicode code pages have their own, 20127 is ascii, others are legacy."""
    name = F.when(code_page == 65001, "utf-8").when(code_page == 1200, "utf-16LE").when(code_page == 1201, "utf-16BE").when(code_page == 12000, "utf-32LE").when(code_page == 12001, "utf-32BE")
    unicode = F.when(bom, F.concat(name, F.lit("-bom"))).otherwise(name)
    return F.when(codec.isNull(), F.lit(None)).otherwise(F.coalesce(unicode, F.when(code_page == 20127, "ascii"), F.lit("legacy")))


def strip_bom(text: Column) -> Column:
    """V4: without one leading U+FEFF."""
    mark = F.decode(F.unhex(F.lit("FEFF")), "UTF-16BE")
    return F.when(F.startswith(text, mark), F.substring(text, 2, 2_147_483_647)).otherwise(text)


def text_sha256(text: Column) -> Column:
    """V5: SHA-256 of the code points as little-endian 32-bit integers."""
    little = F.regexp_replace(F.hex(F.encode(text, "UTF-32")), "(..)(..)(..)(..)", "$4$3$2$1")
    return F.sha2(F.unhex(little), 256)


def first_difference(a: Column, b: Column, context: int = dims.CONTEXT_CHARS) -> Column:
    """V8: struct of index (null where equal), code points, characters and context around the first difference.

    Where one text begins the other, the index is the shorter's length. Past an end the fields are ''.
    """
    chars = lambda t: F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))
    common = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.slice(chars(a), F.lit(1), common), F.slice(chars(b), F.lit(1), common), lambda x, y: x != y)
    found = F.array_position(same, F.lit(True))
    index = F.when(a == b, F.lit(None)).when(found > 0, found - 1).otherwise(common).cast("int")
    char = lambda t: F.coalesce(F.substring(t, index + 1, F.lit(1)), F.lit(""))
    point = lambda t: F.when(char(t) != "", F.format_string("U+%04X", F.ascii(char(t)))).otherwise("")
    start = F.greatest(index - context, F.lit(0))
    return F.struct(
        index.alias("index"), point(a).alias("code_point_a"), point(b).alias("code_point_b"), char(a).alias("char_a"), char(b).alias("char_b"),
        F.coalesce(F.substring(a, start + 1, index - start), F.lit("")).alias("before"), F.coalesce(F.substring(a, index + 1, F.lit(context)), F.lit("")).alias("after"),
    )


def count_percent(n: Column, total: Column) -> Column:
    """K3: 'n (p.pp%)', 0.00 of nothing."""
    return F.format_string("%d (%.2f%%)", n, F.when(total > 0, 100.0 * n / total).otherwise(0.0))


def size_bucket(n: Column) -> Column:
    """C7, sizes."""
    return F.when(n < 1024, "<1K").when(n < 16_384, "1K-16K").when(n < 262_144, "16K-256K").otherwise(">256K")


def constraint_bucket(x: Column) -> Column:
    """C7, constraint; null or negative is not measured."""
    return (
        F.when(x.isNull() | (x < 0), "n/a").when(x == 0, "0.00").when(x < 0.05, "0.00-0.05").when(x < 0.10, "0.05-0.10 (just below)").when(x < 0.20, "0.10-0.20 (just above)").otherwise(">0.20")
    )


def forward_filled(column: Column, order: str, partition: str | None = None) -> Column:
    """The last value that is not null so far."""
    spec = Window.partitionBy(partition).orderBy(order) if partition else Window.orderBy(order)
    return F.last(column, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))
