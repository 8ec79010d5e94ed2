"""Streaming replay of a change log: operations arrive in files, the alive statements are kept up to date.

The state is the last operation per statement. Each micro-batch is folded first and merged into a new version of the
snapshot; a version is written once under its batch number, so a batch that runs again writes the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRIPLE

LOG = "seq long, version long, op string, s string, p string, o string, otype string"


def fold(log: DataFrame) -> DataFrame:
    """The last operation on each statement."""
    return log.groupBy(*TRIPLE).agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("version", "seq").alias("version"))


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000):
    """An available-now query from Parquet log files to snapshots ``target/batch=n``."""
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, n: int) -> None:
        new = fold(batch)
        if n:
            new = fold(spark.read.parquet(f"{target}/batch={n - 1}").unionByName(new.select("s", "p", "o", "otype", "seq", "op", "version"), allowMissingColumns=True))
        new.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alive(spark: SparkSession, target: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{target}/batch={batch}").where("op = 'add'").select(*TRIPLE)


def windowed_counts(stream: DataFrame, at: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Operations per window and kind, with a watermark for late ones. Works on streams and on tables."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), "op").agg(F.count("*").alias("n"))
