"""Postings and corpus statistics.

Only terms that are asked for are exploded and shuffled: lengths come from array sizes, and a
query's terms filter the exploded ones before anything is grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import query_terms, tokens
from paperloom.operators.graph import use_checkpoints


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, terms, term_count) of documents with at least one term."""
    terms = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("terms"))
    return terms.withColumn("term_count", F.size("terms").cast("long")).where("term_count > 0")


def corpus_stats(terms: DataFrame) -> DataFrame:
    """n_docs and avg_len."""
    return terms.agg(F.count("*").alias("n_docs"), F.avg("term_count").alias("avg_len"))


def postings(terms: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return terms.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(terms: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return postings(terms).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def queries_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, term): the distinct query terms of each row."""
    return items.select(F.col(id_col).alias("query_id"), F.explode(query_terms(F.col(text_col))).alias("term"))


class StoredIndex:
    """A written index: postings (doc_id, term_count, term, tf), terms (term, df), documents (doc_id, term_count, norm), stats (n_docs, avg_len)."""

    TABLES = {
        "postings": "doc_id bigint, term_count bigint, term string, tf bigint", "terms": "term string, df bigint", "documents": "doc_id bigint, term_count bigint, norm double",
        "stats": "n_docs bigint, avg_len double",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.postings, self.terms, self.documents, self.stats = (spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in self.TABLES.items())


def build_index(docs: DataFrame, path: str, weight, id_col: str = "doc_id", text_col: str = "text") -> StoredIndex:
    """Tokenizes every text once and writes the tables that searches read; weight: a term's weight in its document, of tf, n_docs and df, for the norm."""
    spark = docs.sparkSession
    rows = tokenized(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "term_count", F.explode("terms").alias("term"))
    rows.groupBy("doc_id", "term_count", "term").agg(F.count("*").alias("tf")).write.parquet(f"{path}/postings")
    read_back = lambda name: spark.read.schema(StoredIndex.TABLES[name]).parquet(f"{path}/{name}")
    every = read_back("postings")
    every.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    n_docs = every.select("doc_id").distinct().count()
    squares = every.join(read_back("terms"), "term").withColumn("w", weight(F.col("tf"), F.lit(n_docs), F.col("df")))
    squares.groupBy("doc_id", "term_count").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).write.parquet(f"{path}/documents")
    read_back("documents").agg(F.count("*").alias("n_docs"), F.avg("term_count").alias("avg_len")).write.parquet(f"{path}/stats")
    return StoredIndex(spark, path)


#: Stands for a document as such among its terms; no term is empty.
WHOLE = ""


def asked_postings(terms: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term_count, term, tf) of the terms in queries only, and corpus_stats of all documents.

    Both come from one pass over the texts: a document's length rides along as a posting of its own,
    and what is left of the corpus after the semi-join is checkpointed for the steps that follow.
    """
    use_checkpoints(terms.sparkSession)
    wanted = queries.select("term").union(queries.sparkSession.createDataFrame([(WHOLE,)], "term string")).distinct()
    long = terms.select("doc_id", "term_count", F.explode(F.array_append("terms", F.lit(WHOLE))).alias("term"))
    found = long.join(wanted, "term", "left_semi").groupBy("doc_id", "term_count", "term").agg(F.count("*").alias("tf")).checkpoint()
    return found.where(F.col("term") != WHOLE), corpus_stats(found.where(F.col("term") == WHOLE))
