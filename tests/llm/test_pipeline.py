"""The pipeline stage by stage, each on what the one before kept, against plain versions."""

import re

import corpus_pipeline
from edge_texts import SCHEMA
from pyspark.sql import functions as F

from glyphsieve.llm import pieces, pii
from glyphsieve.llm.common import tokenizer
from glyphsieve.llm.quality import repeated_words


def test_stages(spark, docs, benchmark, tmp_path):
    benchmark.filter("item_id IN (1, 2, 10)").select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = held.collect()
        held = stage(spark, held, str(tmp_path)).cache()
        after = held.collect()
        if name == "quality rules":
            words = [(r["text"] or "").encode().split() for r in before]
            good = [r["text"] for r, w in zip(before, words, strict=True) if len(w) >= 10 and 100 * repeated_words(w) <= 20 * len(w)]
            assert {r["text"] for r in after} <= set(good) and len(after) >= 0.95 * len(good)
        elif name == "simhash near-dedup":
            texts = [r["text"] for r in after]
            assert len(texts) == len(set(texts)) and len(before) - len(after) >= 2
            assert {r["doc_id"] for r in after} >= set(range(20, 60)) & {r["doc_id"] for r in before}
        elif name == "benchmark decontamination":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert gone >= set(range(60, 70)) & {r["doc_id"] for r in before} and len(gone) < 20
        elif name == "personal data":
            assert len(after) == len(before) and not any(pii.base_spans(r["text"]) for r in after)
            assert any("<SECRET>" in r["text"] for r in after)
        else:
            library = pieces.model(tokenizer("piece_bpe_32k.model")).library
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before) and all(r["ids"] == library.encode(texts[r["doc_id"]]) and re.sub("▁", " ", texts[r["doc_id"]]) == r["decoded"] for r in after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert held.columns == columns


def test_nothing_and_run(spark, benchmark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_everywhere(spark, benchmark, tmp_path):
    benchmark.select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.range(5).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMA).schema])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, str(tmp_path)).count() in (0, 1, 5)
