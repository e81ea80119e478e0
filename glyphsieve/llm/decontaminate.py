"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

`build_index` stores token postings (key, term_id, pos). `phrase_matches` takes, for
each benchmark window, its rarest terms by corpus frequency, shifts their posting
lists to a common alignment and intersects them, rarest first; what survives is
intersected with the lists of all remaining terms, so matches are exact.

Edge cases: a null text has no words; an empty text likewise (one row, zeros). Rows that
repeat a doc_id are judged row by row and give a row each. Null item_ids are ignored;
repeated benchmark rows count once. An empty benchmark marks nothing. Columns other than
doc_id and text are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, WORD_BREAK, ascii_lower, maybe_broadcast, numbered_rows, written

WINDOW = 10
#: Broadcast bounds in rows, checked by counting; above them the same joins shuffle.
VOCABULARY_ROWS, PIVOT_ROWS, KEY_ROWS = 200_000, 200_000, 1_000_000
#: term_id of the record that ends each document; its position is the word count.
END = 0


def tokens(df: DataFrame, *keep: str) -> DataFrame:
    """One row per word (term, pos from 0) and a last row with the empty term at pos = word count."""
    text = F.concat(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    split = df.select(*keep, F.split(text, WORD_BREAK).alias("words"))
    lead = (F.col("words")[0] == "").cast("int").alias("lead")
    out = split.select(*keep, lead, F.posexplode("words").alias("at", "term"))
    return out.select(*keep, "term", (F.col("at") - F.col("lead")).alias("pos")).filter("pos >= 0")


def benchmark_terms(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, ipos, term) of the distinct benchmark rows, and (term, term_id) of its vocabulary."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL").distinct()
    rows = written(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "bench-rows")
    terms = tokens(rows, "item", "item_id").filter("term != ''").withColumnRenamed("pos", "ipos")
    vocabulary = terms.select("term").distinct()
    ids = vocabulary.select("term", (F.monotonically_increasing_id() + 1).alias("term_id"))
    return terms, written(ids.unionByName(rows.sparkSession.createDataFrame([("", END)], "term string, term_id long")), "bench-terms")


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (key, term_id or term, pos, doc_id) of every word, or of a vocabulary's words.

    key numbers the rows of docs; doc_id is set on the record that ends a document.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id"), "text")
    words = tokens(keyed, "key", "doc_id")
    words = words.withColumn("doc_id", F.when(F.col("term") == "", F.col("doc_id")))
    if vocabulary is not None:
        words = words.join(maybe_broadcast(vocabulary, VOCABULARY_ROWS), "term").select("key", "term_id", "pos", "doc_id")
    return written(words, "postings")


def windows(terms: DataFrame, size: int) -> DataFrame:
    """(item, w0, len) of every run of size consecutive item words; a shorter item is one window."""
    per_item = terms.groupBy("item").agg(F.count("*").cast("int").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))
    return per_item.select("item", F.least("n", F.lit(size)).alias("len"), F.explode(starts).alias("w0"))


def phrase_matches(index: DataFrame, terms: DataFrame, vocabulary: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, item, delta, w0, len): item words w0.. stand at document words delta + w0.. ."""
    freq = index.groupBy("term_id").agg(F.count("*").alias("freq"))
    placed = terms.join(vocabulary, "term").join(freq, "term_id", "left").select("item", "ipos", "term_id", F.coalesce("freq", F.lit(0)).alias("freq"))
    placed = written(placed, "bench-placed")
    cells = windows(terms, size).withColumn("ipos", F.explode(F.sequence(F.col("w0"), F.col("w0") + F.col("len") - 1)))
    cells = cells.join(placed, ["item", "ipos"])
    # The rarest term of each window, and the next one at another place.
    ranked = cells.groupBy("item", "w0", "len").agg(F.slice(F.array_sort(F.collect_list(F.struct("freq", "ipos", "term_id"))), 1, 2).alias("rare"))
    plan = ranked.select("item", "w0", "len", F.col("rare")[0].alias("a"), F.get("rare", F.lit(1)).alias("b")).filter("a.freq > 0")
    plan = written(
        plan.select("item", "w0", "len", F.col("a.ipos").alias("p1"), F.col("a.term_id").alias("t1"), F.coalesce("b.ipos", "a.ipos").alias("p2"), F.coalesce("b.term_id", "a.term_id").alias("t2")),
        "bench-plan",
    )
    first = plan.select("item", "p1", F.col("t1").alias("term_id")).distinct()
    aligned = index.join(maybe_broadcast(first, PIVOT_ROWS), "term_id").select("key", "item", "p1", (F.col("pos") - F.col("p1")).alias("delta"))
    second = plan.select("item", "p1", "p2", F.col("t2").alias("term_id")).distinct()
    wanted = aligned.join(maybe_broadcast(second, PIVOT_ROWS), ["item", "p1"]).withColumn("pos", F.col("delta") + F.col("p2"))
    listed = index.join(maybe_broadcast(second.select("term_id").distinct(), PIVOT_ROWS), "term_id", "left_semi").select("key", "term_id", "pos")
    both = written(wanted.join(listed, ["key", "term_id", "pos"], "left_semi").select("key", "item", "delta", "p1", "p2"), "pairs")
    keys = both.select("key").distinct()
    rest = index.join(maybe_broadcast(keys, KEY_ROWS), "key", "left_semi").select("key", "term_id", "pos")
    spans = both.join(maybe_broadcast(plan.select("item", "w0", "len", "p1", "p2"), PIVOT_ROWS), ["item", "p1", "p2"]).select("key", "item", "delta", "w0", "len")
    cell = spans.withColumn("ipos", F.explode(F.sequence(F.col("w0"), F.col("w0") + F.col("len") - 1)))
    cell = cell.join(maybe_broadcast(placed.select("item", "ipos", "term_id"), PIVOT_ROWS), ["item", "ipos"]).withColumn("pos", F.col("delta") + F.col("ipos"))
    held = cell.join(rest, ["key", "term_id", "pos"], "left_semi")
    return held.groupBy("key", "item", "delta", "w0", "len").agg(F.count("*").alias("n")).filter("n = len").drop("n")


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(query_id, key, at): all distinct terms of a query lie within span words around its rarest term at `at`.

    queries: (query_id, term_id), distinct. The rarest list leads; the others are joined to
    it by document and term and kept if within the span on either side.
    """
    freq = index.groupBy("term_id").agg(F.count("*").alias("freq"))
    q = queries.distinct().join(freq, "term_id", "left").na.fill(0, ["freq"])
    lead = q.groupBy("query_id").agg(F.min(F.struct("freq", "term_id")).alias("lead"), F.count("*").alias("n_terms"))
    at = index.join(lead.select("query_id", "n_terms", F.col("lead.term_id").alias("term_id")), "term_id").select("query_id", "n_terms", "key", F.col("pos").alias("at"))
    # Each posting of a leading term looks into its own and the next blocks of span words.
    block = F.floor(F.col("at") / span)
    sought = at.join(queries.distinct(), "query_id").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    lists = index.select("key", "term_id", "pos", F.floor(F.col("pos") / span).alias("block"))
    near = sought.join(lists, ["key", "term_id", "block"]).filter(F.abs(F.col("pos") - F.col("at")) <= span)
    found = near.select("query_id", "n_terms", "key", "at", "term_id").distinct().groupBy("query_id", "key", "at", "n_terms").agg(F.count("*").alias("n"))
    return found.filter("n = n_terms").select("query_id", "key", "at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, item_ids (strings, sorted)."""
    terms, vocabulary = benchmark_terms(benchmark)
    index = build_index(docs.select("doc_id", "text"), vocabulary)
    found = written(phrase_matches(index, terms, vocabulary, size).withColumn("start", F.col("delta") + F.col("w0")), "phrases")
    words = found.select("key", "start", "len").distinct().withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
    hits = words.select("key", "pos").distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    names = terms.select("item", "item_id").distinct()
    items = found.select("key", "item").distinct().join(maybe_broadcast(names, PIVOT_ROWS), "item")
    # A document's list is bounded by the number of benchmark items.
    items = items.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ends = index.filter(F.col("term_id") == END).select("key", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(hits.join(items, "key"), "key", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs."""
    rows = numbered_rows(docs)
    found = decontaminate(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, size)
    gone = written(found.filter("n_hit > 0").select(F.col("doc_id").alias(ROW)), "contaminated")
    return rows.join(maybe_broadcast(gone, KEY_ROWS), ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
