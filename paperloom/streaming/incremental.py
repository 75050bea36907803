"""Work on what is new: batch resumption, hash-keyed reuse and a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones, so a run that broke off goes on where it stood."""
    return rows.join(done.select(key), key, "left_anti")


def reusable(rows: DataFrame, cache: DataFrame, key: str, sha: str = "content_sha256") -> tuple[DataFrame, DataFrame]:
    """(cached results of rows whose content is unchanged, rows that must be worked on again)."""
    return rows.select(key, sha).join(cache, [key, sha]), rows.join(cache.select(key, sha), [key, sha], "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, sha: str = "content_sha256") -> DataFrame:
    """(key, change): added, removed, content_changed or unchanged."""
    both = old.select(key, F.col(sha).alias("was")).join(new.select(key, F.col(sha).alias("now")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "content_changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def ingest(spark: SparkSession, folder: str, pattern: str, schema, transform, out: str, checkpoint: str) -> None:
    """Appends transform(new files of folder) to the Parquet table at out and stops; files that an earlier call took are left alone."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
