"""Queries over resumed and incremental work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import sql_tokens, tokens
from paperloom.operators.graph import use_checkpoints
from paperloom.operators.index import read
from paperloom.streaming import incremental as Z


def _docs(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("content_sha256"))


def new_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label, as those that no run has finished."""
    return Z.unseen(_docs(spark, d), read(spark, d, "labels", "doc_id"), "doc_id")


def cached_results(spark, d):
    """Results of labelled documents that may be kept: those of quality 1 count as unchanged."""
    cache = _docs(spark, d).join(read(spark, d, "labels"), "doc_id")
    cache = cache.select("doc_id", F.when(F.col("quality") == 1, F.col("content_sha256")).otherwise("stale").alias("content_sha256"), "toxic")
    kept, again = Z.reusable(_docs(spark, d), cache, "doc_id")
    return kept.select("doc_id", F.lit("kept").alias("state")).union(again.select("doc_id", F.lit("again").alias("state")))


def snapshot_changes(spark, d):
    """The labelled documents against those of quality 1 or without a label."""
    rows = _docs(spark, d).join(read(spark, d, "labels"), "doc_id", "left")
    old = rows.where("quality is not null").withColumn("content_sha256", F.when(F.col("toxic") == 1, "old").otherwise(F.col("content_sha256")))
    return Z.changes(old, rows.where("quality is null or quality = 1"), "doc_id")


def streamed_counts(spark, d):
    """Term counts of all documents through a file stream that takes each file once."""
    use_checkpoints(spark)
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getConf().get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{d}/documents.parquet")
    one = source.inputFiles()
    folder, pattern = (d, "documents.parquet") if len(one) == 1 and one[0].endswith("/documents.parquet") else (f"{d}/documents.parquet", "*.parquet")
    count = lambda rows: rows.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_terms"))
    for _ in range(2):  # the second call finds nothing new
        Z.ingest(spark, folder, pattern, source.schema, count, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


_SHA = "x AS (SELECT doc_id, sha256(text) AS sha, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
QUERIES = {f.__name__: f for f in (new_documents, cached_results, snapshot_changes, streamed_counts)}
SQL = {
    "new_documents": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "cached_results": f"WITH {_SHA} SELECT doc_id, CASE WHEN quality = 1 THEN 'kept' ELSE 'again' END AS state FROM x",
    "snapshot_changes": f"""WITH {_SHA} SELECT doc_id, CASE WHEN quality IS NULL THEN 'added' WHEN quality = 0 THEN 'removed' WHEN toxic = 1 THEN 'content_changed' ELSE 'unchanged' END AS change FROM x""",
    "streamed_counts": f"SELECT doc_id, len({sql_tokens('text')}) AS n_terms FROM documents",
}
