"""Latent semantic vectors by subspace iteration over weighted postings.

Terms and documents stay tables.  Only the k by k Gram matrices of k chosen dimensions reach the
driver, whatever the number of documents or terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.graph import use_checkpoints
from paperloom.operators.index import corpus_stats, postings
from paperloom.operators.retrieval import smooth_idf, sublinear_tf


def weights(terms: DataFrame) -> DataFrame:
    """(doc_id, term, w): sublinear TF times smooth IDF."""
    every = postings(terms)
    df = every.groupBy("term").agg(F.count("*").alias("df"))
    w = sublinear_tf(F.col("tf")) * smooth_idf(F.col("n_docs"), F.col("df"))
    return every.join(df, "term").crossJoin(corpus_stats(terms).select("n_docs")).select("doc_id", "term", w.alias("w"))


def _sum(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Sums of w * v[i] by key."""
    sums = rows.groupBy(key).agg(*[F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(k)])
    return sums.select(key, F.array(*[F.col(f"s{i}") for i in range(k)]).alias("v"))


def _gram(rows: DataFrame, k: int) -> np.ndarray:
    row = rows.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).collect()[0]
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def _times(matrix: np.ndarray) -> Column:
    """v @ matrix as an array of columns."""
    rows, columns = matrix.shape
    return F.array(*[sum((F.col("v")[i] * float(matrix[i, j]) for i in range(1, rows)), F.col("v")[0] * float(matrix[0, j])) for j in range(columns)])


def fit(terms: DataFrame, k: int, rounds: int = 6, extra: int = 4) -> tuple[DataFrame, DataFrame, list[float]]:
    """(doc_id, v): unit document vectors; (term, v): the right singular vectors; and the singular values.

    The sign of each dimension makes its largest term weight positive, ties to the first term.
    """
    use_checkpoints(terms.sparkSession)
    a = weights(terms).checkpoint()
    n = k + extra
    seed = [F.xxhash64("term", F.lit(i)).cast("double") / float(1 << 63) for i in range(n)]
    q = a.select("term").distinct().select("term", F.array(*seed).alias("v"))
    for _ in range(rounds):
        g = _gram(q := q.checkpoint(), n)
        values, vectors = np.linalg.eigh(g)
        q = q.select("term", _times(vectors / np.sqrt(np.maximum(values, 1e-300))).alias("v"))
        docs = _sum(a.join(q, "term"), "doc_id", n)
        q = _sum(a.join(docs, "doc_id"), "term", n)
    g = _gram(q := q.checkpoint(), n)
    values, vectors = np.linalg.eigh(g)
    q = q.select("term", _times(vectors / np.sqrt(np.maximum(values, 1e-300))).alias("v")).checkpoint()
    docs = _sum(a.join(q, "term"), "doc_id", n).checkpoint()
    values, vectors = np.linalg.eigh(_gram(docs, n))
    order = np.argsort(-values)[:k]
    turn = vectors[:, order]
    q, docs = q.select("term", _times(turn).alias("v")), docs.select("doc_id", _times(turn).alias("v"))
    tops = q.agg(*[F.min_by(F.col("v")[i], F.struct((-F.round(F.abs(F.col("v")[i]), 9)).alias("x"), "term")).alias(f"t{i}") for i in range(k)]).collect()[0]
    sign = np.diag([1.0 if (tops[f"t{i}"] or 0) >= 0 else -1.0 for i in range(k)])
    q, docs = q.select("term", _times(sign).alias("v")), docs.select("doc_id", _times(sign).alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    unit = docs.withColumn("n", norm).select("doc_id", F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias("v"))
    return unit, q, [float(np.sqrt(max(0.0, values[i]))) for i in order]


def project(queries: DataFrame, terms: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, embedding): queries (query_id, term) in the space of the term vectors; unknown terms add nothing."""
    found = postings(terms).groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.join(found, "term").crossJoin(corpus_stats(terms).select("n_docs")).withColumn("w", smooth_idf(F.col("n_docs"), F.col("df")))
    return _sum(asked.join(vectors, "term"), "query_id", k).withColumnRenamed("v", "embedding")
