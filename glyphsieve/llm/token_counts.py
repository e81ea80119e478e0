"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

Tier one is a broadcast table of token counts of frequent pre-tokens: the vocabulary's own
word-initial pieces, which are the pre-tokens its training text had most often. It has at
most as many entries as the vocabulary, whatever the corpus. Tier two is a cache in each
worker, bounded in entries; what it lacks is encoded by the library.

Edge cases: a null text counts as empty: 0 bytes, 0 tokens; an empty table gives no rows. A
text is held whole in its worker and cut into parts before it is looked up, so no length is
too great. Repeated rows and ids give a row each. Other columns pass through `count`
untouched, but for one that has the name of the count, whatever its case: it is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .pieces import SPACE, Cache, counted, model, sized_batches

MODEL, LIMIT = "piece_bpe_32k.model", 4096


def frequent_lengths(path: str) -> dict[str, int]:
    m = model(path)
    words = [p for p in m.ids if p[0] == SPACE and len(p) > 1 and p[1] != SPACE]
    return {p: len(ids) for p, ids in zip(words, m.library.encode([p[1:] for p in words], num_threads=1), strict=True)}


_caches: dict[str, Cache] = {}


def _counter(path: str, table) -> Cache:
    if path not in _caches:
        m = model(path)
        _caches[path] = Cache(m, lambda t: len(m.encode(t)), sum, table.value, many=m.lengths)
    return _caches[path]


def count(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of a text column."""
    if column.lower() == text.lower():
        raise ValueError("the count would replace the text")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()])
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    at = docs.columns.index(text)

    def run(batches):
        cache = _counter(path, table).claim()
        prepare = cache.pieces.prepare
        for batch in sized_batches(batches, at):
            counts = counted([prepare(t or "") for t in batch.column(at).to_pylist()], cache.all)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, f"{fields}, `{column}` bigint", True)


def digest(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    n = count(docs.select("doc_id", "text"), path)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return n.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
