"""An optional streaming form: files that arrive are detected by the same functions. The batch engine needs none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", str(per_trigger)).load(folder)


def detected(files: DataFrame) -> DataFrame:
    """path, length, modificationTime and the detected class of each arriving file."""
    return detect(files).select("path", "length", "modificationTime", "detected_codec", "detected_class")


def counts(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files by class and window of their modification time; state older than the watermark is dropped."""
    rows = detected(files).withWatermark("modificationTime", late)
    return rows.groupBy(F.window("modificationTime", window), "detected_class").agg(F.count("*").alias("n"))
