import pytest
from edge_texts import BENCHMARK, SCHEMA, TEXTS
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "k", 1, "f", 2, "n", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.col("text")).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(*r, "x") for r in BENCHMARK], "item_id long, text string, term string")
