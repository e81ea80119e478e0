"""Personal data by bootstrapped contextual extraction.

Seeds are entities that their form gives away: e-mail addresses, IP addresses, payment
cards, phone numbers, access keys and hexadecimal secrets. Candidates are all strings with
digits that could be identifiers (`CANDIDATE`, LEAST signs or more). A candidate has up to four
lexical patterns: the word and signs before it; the two words before it; the two words
after it; and the word on either side. Of a word the LETTERS next to the candidate
count, of signs the SIGNS next to it.

Patterns and instances form a graph. In each round a pattern's confidence in a kind is the
mean confidence of its distinct instances, and an instance's is that of the best of its
accepted patterns, seeds staying at 1. A pattern is accepted at a confidence of ACCEPT or
more if chance does not explain it: were its n instances drawn from all candidates, of which
a share r is seeds of the kind, so high a confidence c has a probability of at most
exp(-n KL(c, r)), and over all patterns of the corpus less than CHANCE such may be expected.
So the support that a pattern needs grows with the corpus, and three coincidences are none.
Rounds go on until no pattern or instance is new; candidates that accepted patterns select
and no seed covers become spans, of the kind of the most confident one.

One pass over the texts writes candidates (row key, place, patterns, value hash); all scoring
is Spark aggregation over them, so its cost follows the number of candidates.

Edge cases: null and empty texts have no spans; an empty table gives no rows. A text is held
whole in its worker and searched in linear time. Repeated rows and ids give a row each.
Other columns, whatever their names, are carried by `redact` and not read by `extract`.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ROW, mapped, maybe_broadcast, numbered_rows, small_batches, written

#: Fixed by the contract: the base kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A run of digits that fails from its start fails from within too, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Further seeds, by form alone.
KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}(?![A-Za-z0-9])")
DIGIT = re.compile("[0-9]")
#: Runs of these signs, without those at their ends that end no identifier, are candidates if they have a digit and LEAST signs.
CANDIDATE, LEAST, ENDS = re.compile(r"[A-Za-z0-9._+/-]+"), 6, "._/-"
RUN = re.compile(r"[A-Za-z0-9._+/-]*\Z")
#: Letters of a word and signs that patterns hold at most.
LETTERS, SIGNS = 32, 6
BEFORE = re.compile(rf"(?:([^\W\d_]{{1,{LETTERS}}})(\W{{1,{SIGNS}}}))?([^\W\d_]{{1,{LETTERS}}})([ \t\"'=:#(]{{0,{SIGNS}}})\Z")
AFTER = re.compile(rf"([ \t\"'=:;,)]{{0,{SIGNS}}}[^\W\d_]{{1,{LETTERS}}})(\W{{1,{SIGNS}}}[^\W\d_]{{1,{LETTERS}}})?")
BLANKS = re.compile(r"\s+")
NEAR = 2 * (LETTERS + SIGNS)
#: Least confidence of a pattern, and how many accepted ones may be chance.
ACCEPT, CHANCE = 0.8, 0.01
#: Rounds end where no pattern or instance is new and the patterns' confidence has risen by less than this in all.
SETTLED = 1e-3
#: Accepted patterns up to which they are broadcast (some 200 bytes each at most), checked by counting.
PATTERN_ROWS = 100_000
#: Rows with spans up to which they are broadcast, checked by counting.
SPAN_ROWS = 100_000
#: Characters looked at for an e-mail's local part at a time.
STEP = 256


def run_start(text: str, at: int, free: int, run: re.Pattern) -> int:
    """Where the run of signs that ends at a place begins, not before `free`."""
    width = STEP
    while True:
        low = max(free, at - width)
        start = low + run.search(text[low:at]).start()
        if start > low or low == free:
            return start
        width *= 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ takes the run of local characters before it, back to the last address."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = run_start(text, at, free, LOCAL)
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append(("phone", *m.span()))
    return out


def seeds(text: str) -> list[tuple[str, int, int]]:
    """The base spans, then keys and secrets."""
    out = base_spans(text)
    if DIGIT.search(text):
        out += [("key", *m.span()) for m in KEY.finditer(text)] if "AKIA" in text or "ASIA" in text else []
        out += [("secret", *m.span()) for m in SECRET.finditer(text)]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of what stands at start to end: L word before, LL two words before, RR two words after, B both sides."""
    out = []
    before = BEFORE.search(text[max(0, start - NEAR) : start])
    after = AFTER.match(text, end, end + NEAR)
    plain = lambda t: BLANKS.sub(" ", t.lower())
    if before:
        left = plain(before[3] + before[4])
        out.append("L" + left)
        if before[1]:
            out.append("LL" + plain(before[1] + before[2]) + left)
    if after:
        if after[2]:
            out.append("RR" + plain(after[0]))
        if before:
            out.append("B" + left + "|" + plain(after[1]))
    return out


def candidates(text: str) -> list[tuple[str | None, int, int, list[str], int]]:
    """(seed kind or none, start, end, patterns, value hash): all seeds, and the candidates that overlap none."""
    found: list[tuple[str | None, int, int]] = [*seeds(text)]
    first = DIGIT.search(text)
    if first:
        taken = sorted((a, b) for _, a, b in found)
        i = 0
        for m in CANDIDATE.finditer(text, run_start(text, first.start(), 0, RUN)):
            run = m[0].lstrip(ENDS)
            a = m.end() - len(run)
            run = run.rstrip(ENDS + "+")
            b = a + len(run)
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if len(run) >= LEAST and DIGIT.search(run) and not (i < len(taken) and taken[i][0] < b):
                found.append((None, a, b))
    return [(k, a, b, contexts(text, a, b), xxh64_intdigest(text[a:b].encode()) - (1 << 63)) for k, a, b in found]


def collected(docs: DataFrame) -> DataFrame:
    """key, doc_id and the candidates of each row of docs (key, doc_id, text), written."""
    names = ("kind", "start", "end", "cues", "value")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()), strict=True))))

    def run(batches):
        for batch in small_batches(batches):
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t.as_py() or "")] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["key", "doc_id", "found"])

    out = mapped(docs.select("key", "doc_id", "text"), run, "key bigint, doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,cues:array<string>,value:bigint>>")
    return written(out, "pii-candidates")


def surprise(confidence: Column, share: Column) -> Column:
    """KL divergence of two coins, in nats; 0 where the confidence is no higher than the share."""
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    return F.when(confidence > share, part(confidence, share) + part(1 - confidence, 1 - share)).otherwise(0.0)


def patterns(rows: DataFrame) -> DataFrame:
    """(cue, kind, confidence) of the accepted patterns over collected() rows."""
    seen = rows.select(F.explode("found").alias("f")).select("f.*")
    values = written(seen.groupBy("value").agg(F.max("kind").alias("kind")), "pii-values")
    seeded = values.filter("kind IS NOT NULL").withColumn("confidence", F.lit(1.0))
    edges = written(seen.select("value", F.explode("cues").alias("cue")).distinct(), "pii-edges")
    cues = written(edges.groupBy("cue").agg(F.count("*").alias("n")).filter("n > 1"), "pii-cues")
    # How many patterns could mislead, and the share of each kind among all candidates (one row a kind).
    many = F.lit(math.log(max(1, cues.count()) / CHANCE))
    shares = values.groupBy("kind").agg(F.count("*").alias("k")).select("kind", ((F.col("k") + 1) / (values.count() + 2)).alias("share")).filter("kind IS NOT NULL")
    known, before = seeded, None
    while True:
        # All that is known supports a pattern: seeds, and what accepted patterns have found.
        summed = edges.join(known, "value").groupBy("cue", "kind").agg(F.sum("confidence").alias("s"))
        scored = summed.join(cues, "cue").join(F.broadcast(shares), "kind").withColumn("confidence", F.col("s") / F.col("n"))
        sure = F.col("n") * surprise(F.col("confidence"), F.col("share")) >= many
        good = written(scored.filter((F.col("confidence") >= ACCEPT) & sure).select("cue", "kind", "confidence"), "pii-patterns")
        accepted = maybe_broadcast(good, PATTERN_ROWS)
        grown = edges.join(accepted, "cue").join(seeded.select("value"), "value", "left_anti").groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))
        known = written(seeded.unionByName(grown), "pii-known")
        now = (*good.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first(), known.count())
        # Nothing is ever taken back and confidence only rises, so this ends.
        if before and (now[0], now[2]) == (before[0], before[2]) and now[1] - before[1] < SETTLED:
            break
        before = now
    # One kind per cue: the most confident, then the first by name.
    rank = F.struct("confidence", F.expr("-ascii(kind)"), "kind")
    return written(good.groupBy("cue").agg(F.max_by("kind", rank).alias("kind"), F.max("confidence").alias("confidence")), "pii-accepted")


def extract(docs: DataFrame) -> DataFrame:
    """key, doc_id, base and spans: arrays of (kind, start, end) by the kinds' order, then start. docs: key, doc_id, text."""
    rows = collected(docs)
    accepted = patterns(rows).select("cue", F.struct("confidence", F.expr("-ascii(kind)").alias("order"), F.col("kind").alias("learned")).alias("best"))
    each = rows.select("key", F.explode("found").alias("f")).select("key", "f.*")
    seeded = each.filter("kind IS NOT NULL").select("key", "kind", "start", "end")
    unsure = each.filter("kind IS NULL").select("key", "start", "end", F.explode("cues").alias("cue"))
    learned = unsure.join(maybe_broadcast(accepted, PATTERN_ROWS), "cue").groupBy("key", "start", "end").agg(F.max("best").alias("best"))
    learned = learned.select("key", F.col("best.learned").alias("kind"), "start", "end")
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    marked = F.struct(F.when(order > 0, order).otherwise(len(KINDS) + 1).alias("o"), "kind", "start", "end")
    # A document's spans are bounded by its text.
    every = seeded.withColumn("seed", F.lit(True)).unionByName(learned.withColumn("seed", F.lit(False)))
    spans = every.groupBy("key").agg(
        F.array_sort(F.collect_list(marked)).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("seed") & (order > 0), marked))).alias("base")
    )
    none = F.array().cast("array<struct<o:bigint,kind:string,start:bigint,end:bigint>>")
    joined = rows.select("key", "doc_id").join(spans, "key", "left")
    return joined.select("key", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    # The candidates' table fixes the numbers; the texts need not be written again.
    found = extract(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span of text replaced by its kind in angle brackets (overlapping spans become one)."""
    rows = numbered_rows(docs)
    spans = extract(rows.select(F.col(ROW).alias("key"), "doc_id", "text")).filter("size(spans) > 0").select("key", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("__spans"))
    joined = rows.join(maybe_broadcast(spans.withColumnRenamed("key", ROW), SPAN_ROWS), ROW, "left").drop(ROW)
    names = docs.columns
    at, marks = names.index("text"), len(names)

    def run(batches):
        for batch in small_batches(batches):
            texts = []
            for text, cell in zip(batch.column(at).to_pylist(), batch.column(marks), strict=True):
                given = cell.as_py()
                if text is not None and given:
                    parts, free = [], 0
                    for s in sorted(given, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= free:
                            parts += [text[free : s["start"]], f"<{s['kind'].upper()}>"]
                        free = max(free, s["end"])
                    text = "".join(parts) + text[free:]
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(marks)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(joined, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
