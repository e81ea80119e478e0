"""The training-data operators as queries over the tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licences, pii, quality, repeats, sharding, simhash, token_counts, token_files, transducer
from .common import documents, tokenizer


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), benchmark))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(documents(spark, sf_dir), tokenizer(token_files.MODEL))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir), tokenizer(quality.MODEL))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(documents(spark, sf_dir), tokenizer(token_counts.MODEL))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op10_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digest(documents(spark, sf_dir), tokenizer(transducer.MODEL))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_licences": op5_licences,
    "op6_token_counts": op6_token_counts,
    "op7_shards": op7_shards,
    "op8_repeats": op8_repeats,
    "op9_pii": op9_pii,
    "op10_transducer": op10_transducer,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id::varchar AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM place) JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_KEYS = sharding.round_keys()
_DIGIT = "instr('0123456789ABCDEF', x[{0}]) - 1"
OP7 = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS crc),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ({_DIGIT.format(1)}) * 16 + {_DIGIT.format(2)}) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) AS text_crc32 FROM d, t),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS x FROM s), c AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::bigint AS b FROM documents),
f AS (SELECT x, x // b AS l, x % b AS r, 0 AS k FROM r, c
  UNION ALL SELECT x, r, (l + (((r % 2147483647) * {[k for k, _ in _KEYS]}[k % 6 + 1] + {[c for _, c in _KEYS]}[k % 6 + 1]) % 2147483647) * (((r % 2147483647) * {[k for k, _ in _KEYS]}[k % 6 + 1] + {[c for _, c in _KEYS]}[k % 6 + 1]) % 2147483647) % 2147483647) % b, k % 6 + 1 FROM f, c WHERE k < 6 OR l * b + r >= n),
p AS (SELECT x, l * b + r AS y FROM f, c WHERE k = 6 AND l * b + r < n)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'rows' AS law, (y % 16)::int AS shard, (y // 16)::bigint AS slot, NULL::int AS grown_shard, x::bigint AS row_number FROM r JOIN p USING (x)"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
low AS (SELECT s, min(doc_id) AS first FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT g.doc_id, p FROM g JOIN low USING (s) WHERE first < g.doc_id),
mark AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM hit),
isle AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark) GROUP BY doc_id, k),
cut AS (SELECT i.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS piece, h FROM isle i JOIN d USING (doc_id) WINDOW w AS (PARTITION BY i.doc_id ORDER BY a)),
rest AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM cut GROUP BY 1)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN rest USING (doc_id)"""

#: The others need XXH64, a tokenizer's merges, a suffix automaton's chains or learned patterns; tests/llm holds them against plain versions.
SQL: dict[str, str] = {"op1_decontaminate": OP1, "op7_shards": OP7, "op8_repeats": OP8}
