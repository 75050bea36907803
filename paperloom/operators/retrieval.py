"""Ranked retrieval: TF-IDF cosine, BM25, vector cosine, fusion and reranking signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.graph import use_checkpoints
from paperloom.operators.index import StoredIndex, asked_postings, postings

K1, B = 1.2, 0.75
DIGITS = 6


def sublinear_tf(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.log(tf.cast("double"))).otherwise(0.0)


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, idf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def rank(scores: DataFrame, k: int | None = None, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Positive scores ranked within each query, best first, ties by id; at most k of them."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    out = scores.where("score > 0").withColumn("rank", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25_contributions(terms: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, term, tf, df, idf, contribution) of every match."""
    found, stats = asked_postings(terms, queries)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = queries.join(df, "term").crossJoin(stats).withColumn("idf", bm25_idf(F.col("n_docs"), F.col("df")))
    joined = found.join(weighed, "term")
    weight = bm25_weight(F.col("tf"), F.col("idf"), F.col("term_count"), F.col("avg_len"), k1, b)
    return joined.select("query_id", "doc_id", "term", "tf", "df", "idf", weight.alias("contribution"))


def bm25(terms: DataFrame, queries: DataFrame, k: int = 10, **settings) -> DataFrame:
    """(query_id, rank, doc_id, score, matched): the k best documents of each query."""
    sums = bm25_contributions(terms, queries, **settings).groupBy("query_id", "doc_id")
    scores = sums.agg(F.round(F.sum("contribution"), DIGITS).alias("score"), F.count("*").alias("matched"))
    return rank(scores, k).select("query_id", "rank", "doc_id", "score", "matched")


def tfidf(terms: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): cosine of sublinear TF and smooth IDF; norms are over all terms of a document."""
    use_checkpoints(terms.sparkSession)
    every = postings(terms).checkpoint()  # the index: it is read for frequencies, norms and products
    n_docs = every.agg(F.countDistinct("doc_id").alias("n_docs"))
    df = every.groupBy("term").agg(F.count("*").alias("df"))
    weight = sublinear_tf(F.col("tf")) * smooth_idf(F.col("n_docs"), F.col("df"))
    weighed = every.join(df, "term").crossJoin(n_docs).withColumn("w", weight).select("doc_id", "term", "w")
    norms = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = queries.join(df, "term").crossJoin(n_docs).withColumn("qw", smooth_idf(F.col("n_docs"), F.col("df")))
    query_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("query_norm"))
    dots = weighed.join(asked.select("query_id", "term", "qw"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scores = dots.join(norms, "doc_id").join(query_norms, "query_id")
    return rank(scores.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("query_norm")), DIGITS).alias("score")), k).select(
        "query_id", "rank", "doc_id", "score"
    )


def tfidf_weight(tf: Column, n: Column, df: Column) -> Column:
    return sublinear_tf(tf) * smooth_idf(n, df)


def _asked(index: StoredIndex, queries: DataFrame) -> DataFrame:
    """The postings of the terms in queries, with df and the corpus statistics."""
    asked = queries.join(index.terms, "term").crossJoin(index.stats)
    return index.postings.join(asked, "term")


def bm25_search(index: StoredIndex, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """bm25 over a stored index."""
    weight = bm25_weight(F.col("tf"), bm25_idf(F.col("n_docs"), F.col("df")), F.col("term_count"), F.col("avg_len"), k1, b)
    sums = _asked(index, queries).groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), DIGITS).alias("score"), F.count("*").alias("matched"))
    return rank(sums, k).select("query_id", "rank", "doc_id", "score", "matched")


def tfidf_search(index: StoredIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """tfidf over a stored index, whose norms are kept."""
    idf = smooth_idf(F.col("n_docs"), F.col("df"))
    norms = queries.join(index.terms, "term").crossJoin(index.stats).groupBy("query_id").agg(F.sqrt(F.sum(idf * idf)).alias("query_norm"))
    dots = _asked(index, queries).groupBy("query_id", "doc_id").agg(F.sum(tfidf_weight(F.col("tf"), F.col("n_docs"), F.col("df")) * idf).alias("dot"))
    scores = dots.join(norms, "query_id").join(index.documents.select("doc_id", "norm"), "doc_id")
    return rank(scores.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("query_norm")), DIGITS).alias("score")), k).select("query_id", "rank", "doc_id", "score")


METHODS = ("bm25", "tfidf", "hybrid")
OPTIONS = {"bm25": {"k1", "b"}, "tfidf": set(), "hybrid": {"constant", "left_weight", "right_weight", "depth"}}


def search(index: StoredIndex, queries: DataFrame, method: str, k: int = 10, **options) -> DataFrame:
    """The k best documents of each query by a method; unknown methods, and options that a method has not, are errors."""
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}")
    if wrong := set(options) - OPTIONS[method]:
        raise ValueError(f"{method} has no option {sorted(wrong)}")
    if method == "bm25":
        return bm25_search(index, queries, k, **options)
    if method == "tfidf":
        return tfidf_search(index, queries, k)
    depth = options.pop("depth", 20)
    return reciprocal_rank_fusion(bm25_search(index, queries, depth), tfidf_search(index, queries, depth), **options).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_search(vectors: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine of each asked vector against all; asked: query_id and embedding.

    The asked set is fixed by its caller, so all rows meet it in one pass.
    """
    unit = lambda c: F.sqrt(dot(c, c))
    left = asked.select("query_id", F.col("embedding").alias("q"), unit(F.col("embedding")).alias("qn"))
    right = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), unit(F.col("embedding")).alias("vn"))
    pairs = right.join(left, (F.col("vn") > 0) & (F.col("qn") > 0))
    return rank(pairs.select("query_id", "doc_id", F.round(dot(F.col("v"), F.col("q")) / (F.col("vn") * F.col("qn")), DIGITS).alias("score")), k)


def max_normalized(scores: DataFrame) -> DataFrame:
    """Scores over the query's largest; zero where that is not positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("normalized", F.when(top > 0, F.round(F.col("score") / top, DIGITS)).otherwise(0.0))


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, constant: int = 60, left_weight: float = 1.0, right_weight: float = 1.0) -> DataFrame:
    """(query_id, rank, doc_id, score) of two rankings; a side without the document adds nothing."""
    l, r = left.select("query_id", "doc_id", F.col("rank").alias("lr")), right.select("query_id", "doc_id", F.col("rank").alias("rr"))
    both = l.join(r, ["query_id", "doc_id"], "full")
    part = lambda c, w: F.coalesce(w / (constant + F.col(c)), F.lit(0.0))
    return rank(both.select("query_id", "doc_id", F.round(part("lr", left_weight) + part("rr", right_weight), 9).alias("score"))).select("query_id", "rank", "doc_id", "score")


def weighted_fusion(left: DataFrame, right: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha of the left and the rest of the right score, both max-normalized."""
    l = max_normalized(left).select("query_id", "doc_id", F.col("normalized").alias("ls"))
    r = max_normalized(right).select("query_id", "doc_id", F.col("normalized").alias("rs"))
    both = l.join(r, ["query_id", "doc_id"], "full")
    score = alpha * F.coalesce("ls", F.lit(0.0)) + (1 - alpha) * F.coalesce("rs", F.lit(0.0))
    return rank(both.select("query_id", "doc_id", F.round(score, DIGITS).alias("score"))).select("query_id", "rank", "doc_id", "score")
