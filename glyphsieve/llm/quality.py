"""Quality rules: plain text statistics and tokenizer fertility.

Fertility is measured with a public vocabulary on the whole text: characters per token,
the share of byte-fallback tokens (line feeds, returns and tabs apart, which this kind of
vocabulary always spells in bytes) and the entropy of the token distribution.

There are two kinds of rejection bands, and a text must lie inside both. `BANDS` are fixed
and wide, by the script that most of a text's letters belong to; entropy is judged there only
from ENTROPY_TOKENS on. `fences` are measured: all texts of the table that pass the base
rules, grouped by script, language (column `lang`, where there is one) and size (powers of
two of their tokens, since short texts vary more and have less entropy), give quartiles of
characters per token and of entropy, and what lies REACH times their distance outside them
is rejected. Half of a group's texts would have to be bad to move the quartiles far.
Quartiles are exact to 1 / STEPS and depend on the table alone, not on its partitions.
Groups of fewer than GROUP texts have no fences; their texts of LONG_TOKENS or more take the
characters per token of all such texts of the script and language, if those are enough.

Edge cases: a null or empty text has no words, so it fails the base rule; its fertility
figures are null. A null language is a language of its own. An empty table gives no rows.
A text is held whole in its worker. Repeated rows and ids give a row each. Other columns,
whatever their names, are carried by `keep` and not read by `digest`.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, maybe_broadcast, written
from .pieces import BATCH_BYTES, STAGE_BYTES, Cache, encoded, model, sized_batches

MODEL = "piece_bpe_32k.model"
#: Fixed by the contract.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 5, 10, 20
SPACES = " \t\n\v\f\r"
#: Script: least and most characters per token, most byte-fallback share, least entropy in bits.
BANDS = {
    "latin": (1.2, 8.0, 0.10, 3.0),
    "greek": (0.8, 6.0, 0.20, 3.0),
    "cyrillic": (0.8, 6.0, 0.20, 3.0),
    "arabic": (0.5, 5.0, 0.40, 3.0),
    "hebrew": (0.5, 5.0, 0.40, 3.0),
    "indic": (0.3, 4.0, 0.90, 3.0),
    "thai": (0.3, 4.0, 0.90, 3.0),
    "kana": (0.3, 4.0, 0.70, 3.0),
    "han": (0.3, 4.0, 0.80, 3.0),
    "hangul": (0.3, 4.0, 0.90, 3.0),
    "other": (0.2, 8.0, 1.00, 3.0),
}
#: Starts of the code point ranges, and their script ("" for marks that belong to none).
RANGES = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"),
    (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
#: Tokens from which on entropy is judged.
ENTROPY_TOKENS = 64
#: Fences: parts of one that figures are counted in, texts of a group at least, and the distance from the quartiles in their distance, and in the figure itself at least.
STEPS, GROUP, REACH, LEAST_REACH = 256, 100, 4.0, 0.04
#: Tokens from which on characters per token vary little with size, and the size that stands for all those texts.
LONG_TOKENS, ANY_SIZE = 256, -1
#: Groups up to which their fences are broadcast, checked by counting.
FENCE_ROWS = 100_000
#: Entries of a worker's memo, and rejected texts up to which they are broadcast (some 100 bytes each), checked by counting.
MEMO, REJECTED_ROWS = 100_000, 500_000
KEY = ["script", "language", "size"]

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, byte_share double, entropy double, script string"
)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that stand in the text twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
    # Equal keys are confirmed word by word.
    seen = Counter(tuple(words[i : i + size]) for i in at.tolist())
    steps = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(words[i : i + size])] > 1:
            steps[i] += 1
            steps[i + size] -= 1
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=1)
def script_table() -> tuple[np.ndarray, list[str]]:
    return np.array([a for a, _ in RANGES]), [s for _, s in RANGES]


def script(text: str) -> str:
    """The script of most letters; the first by name among equals, "other" without letters."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "other"
    starts, names = script_table()
    counts: Counter = Counter()
    for chunk in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[chunk : chunk + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4")
        which = np.bincount(np.searchsorted(starts, points, "right") - 1, minlength=len(names))
        for i in np.flatnonzero(which):
            counts[names[i]] += int(which[i])
    counts.pop("", None)
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "other"


@lru_cache(maxsize=1)
def _cache(path: str) -> tuple[Cache, np.ndarray]:
    m = model(path)
    fallback = np.zeros(1 << 16, bool)
    fallback[[i for b, i in m.byte_id.items() if b not in b"\n\r\t"]] = True
    return Cache(m, lambda t: np.array(m.encode(t), "<u2").tobytes(), b"".join, entries=MEMO, many=lambda ts: m.packed(ts, "<u2")), fallback


def fertility(path: str, texts: list[str]) -> list[tuple]:
    """(n_tokens, chars_per_token, byte_share, entropy) of each text; figures of no tokens are null."""
    cache, fallback = _cache(path)
    cache.claim()
    ids, ends = encoded([cache.pieces.prepare(t) for t in texts], cache.all, "<u2")
    out = []
    for text, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = ids[a:b]
        if a == b:
            out.append((0, None, None, None))
            continue
        _, counts = np.unique(own, return_counts=True)
        p = counts / len(own)
        out.append((len(own), len(text) / len(own), float(np.count_nonzero(fallback[own])) / len(own), float(max(0.0, -(p * np.log2(p)).sum()))))
    return out


def figures(doc_ids, texts, path: str) -> list[pa.Array]:
    """The columns of SCHEMA."""
    rows = []
    plain = [t or "" for t in texts.to_pylist()]
    for doc_id, text, fertile in zip(doc_ids.to_pylist(), plain, fertility(path, plain), strict=True):
        raw = text.encode()
        words = raw.split()
        rows.append((
            doc_id, len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(raw), repeated_words(words),
            *fertile, script(text),
        ))
    kinds = [pa.int64()] * 7 + [pa.float64()] * 3 + [pa.string()]
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def language_of(docs: DataFrame) -> Column:
    named = {c.lower(): c for c in docs.columns}
    return F.coalesce(F.col(f"`{named['lang']}`").cast("string"), F.lit("")) if "lang" in named else F.lit("")


def text_key(text: Column) -> Column:
    """128 bits of a text (null: empty), which stand for it: whatever is measured depends on the text alone."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def measure(docs: DataFrame, path: str, key: bool = False, limit: int = BATCH_BYTES) -> DataFrame:
    """language, doc_id and all figures; with the text's key if it is asked for."""
    own = [f.split()[0] for f in SCHEMA.split(", ")]
    first = ["language", *["text_key"] * key]
    rows = docs.select("doc_id", "text", language_of(docs).alias("language"), *[text_key(F.col("text")).alias("text_key")] * key)

    def run(batches):
        for batch in sized_batches(batches, 1, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *figures(batch.column(0), batch.column(1), path)], names=[*first, *own])

    return mapped(rows, run, f"language string, {'text_key binary, ' * key}{SCHEMA}", True)


def sized(measured: DataFrame) -> DataFrame:
    """With base_failed and the size class."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "size": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")})


def fences(measured: DataFrame, group: int = GROUP) -> DataFrame:
    """(script, language, size) of the groups with enough texts, and the least and most of chars and bits that they allow."""
    step = lambda c: F.floor(F.col(c) * STEPS)
    long = F.when(F.col("n_tokens") >= LONG_TOKENS, step("chars_per_token"))
    kinds = [("chars", F.col("size"), step("chars_per_token")), ("bits", F.col("size"), step("entropy")), ("chars", F.lit(ANY_SIZE), long)]
    figure = F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), size.alias("size"), at.alias("step")) for n, size, at in kinds])).alias("f")
    good = sized(measured).filter("NOT base_failed AND n_tokens > 0")
    counted = good.select("script", "language", figure).select("script", "language", "f.*").filter("step IS NOT NULL").groupBy(*KEY, "figure", "step").agg(F.count("*").alias("n"))
    # As many rows as a group has steps, however many texts.
    each = Window.partitionBy(*KEY, "figure")
    upto = each.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(each)}).filter(F.col("all") >= group)
    quartile = lambda k: ((F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("step"))) + 0.5) / STEPS).alias(f"q{k}")
    found = ranked.groupBy(*KEY, "figure").agg(quartile(1), quartile(3))
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), LEAST_REACH * (F.col("q3") + F.col("q1")) / 2)
    found = found.select(*KEY, "figure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    pick = lambda n, c: F.max(F.when(F.col("figure") == n, F.col(c))).alias(f"{n}_{c}")
    return found.groupBy(*KEY).agg(*[pick(n, c) for n in ("chars", "bits") for c in ("low", "high")])


def judged(measured: DataFrame, bands: dict[str, tuple[float, float, float, float]] = BANDS, group: int = GROUP) -> DataFrame:
    """measured, which must be a written table, with base_failed, fertile (null figures pass) and kept."""
    ok = F.lit(True)
    for name, (least, most, share, bits) in bands.items():
        inside = F.col("chars_per_token").between(least, most) & (F.col("byte_share") <= share) & ((F.col("entropy") >= bits) | (F.col("n_tokens") < ENTROPY_TOKENS))
        ok = F.when(F.col("script") == name, inside).otherwise(ok)
    limits = written(fences(measured, group), "fences")
    own = maybe_broadcast(limits.filter(F.col("size") != ANY_SIZE), FENCE_ROWS)
    pooled = limits.filter(F.col("size") == ANY_SIZE).select("script", "language", F.col("chars_low").alias("any_low"), F.col("chars_high").alias("any_high"))
    out = sized(measured).join(own, KEY, "left").join(maybe_broadcast(pooled, FENCE_ROWS), KEY[:2], "left")
    long = F.col("n_tokens") >= LONG_TOKENS
    least, most = (F.coalesce(f"chars_{side}", F.when(long, F.col(f"any_{side}"))) for side in ("low", "high"))
    fenced = F.coalesce(F.col("chars_per_token").between(least, most), F.lit(True)) & F.coalesce(F.col("entropy").between(F.col("bits_low"), F.col("bits_high")), F.lit(True))
    out = out.withColumn("fertile", F.coalesce(ok, F.lit(True)) & fenced)
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("fertile"))
    return out.drop("size", "chars_low", "chars_high", "bits_low", "bits_high", "any_low", "any_high")


def digest(docs: DataFrame, path: str) -> DataFrame:
    return judged(written(measure(docs, path), "quality"))


def keep(docs: DataFrame, path: str, group: int = GROUP) -> DataFrame:
    """The rows of docs that are kept, all columns. Figures are written with their texts' keys, by which rejected rows are found again; texts are not."""
    rows = judged(written(measure(docs, path, True, STAGE_BYTES), "quality"), group=group)
    gone = written(rows.filter("NOT kept").select(F.col("text_key").alias("__rejected"), F.col("language").alias("__rejected_language")).distinct(), "rejected")
    same = (text_key(F.col("text")) == F.col("__rejected")) & (language_of(docs) == F.col("__rejected_language"))
    return docs.join(maybe_broadcast(gone, REJECTED_ROWS), same, "left_anti")
