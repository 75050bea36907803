"""Queries whose results SQL cannot give: greedy, positional or iterative ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import answering as A
from paperloom.operators import index as I
from paperloom.operators import retrieval as R
from paperloom.operators import semantic as L
from paperloom.plans import papers as P
from paperloom.plans import search as S

EQUATIONS = [
    ("a", "We minimise\n$$L = \\sum_i (y_i - x_i)^2 \\tag{3}$$\nwhere $y_i$ is known.\nE = m c (2)\n```\nx = 1\n```\n"), ("b", "no mathematics"), ("c", "\\[ \\alpha_t = \\beta + 1 \\] and a_1 <= b_2"),
]
TABLES = [
    ("a", "Table 1: yields\n| crop | t |\n| --- | --: |\n| rye | 3 |\n| oats | 4 |\n\nx\ty\n1\t2\n3\t4\n"), ("b", "a,b,c\n1,2,3\n4,5\n"), ("c", "| a | b |\n| - | - |\n| 1 |\n"),
]
DRAFTS = [("a", "As shown [c01] and [C2, C2] [C3] [ev_9]."), ("b", "none"), ("c", "[C7] [C7]")]
PLAIN = [("a", "1 Introduction\ntext\n2.1 Data Sets\nRESULTS AND USE\nreferences\n3 Hidden\nAppendix\nmore"), ("b", "nothing here.")]


def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    return A.sentences(I.read(spark, d, "documents", "doc_id", "text")).select("doc_id", "k", "start", "end", "kind", F.sha2("sentence", 256).alias("sha256"))


def extractive_answers(spark, d):
    items = S._items(spark, d).select(F.col("item_id").alias("query_id"), "text")
    found = S._bm25(spark, d, 4).join(I.read(spark, d, "documents", "doc_id", "text"), "doc_id")
    return A.select_sentences(A.scored_sentences(found, items))


def reranked_search(spark, d):
    terms = S._terms(spark, d)
    found = S._bm25(spark, d, 20).join(terms.select("doc_id", F.array_distinct("terms").alias("terms")), "doc_id")
    return A.redundancy_rerank(R.max_normalized(found).select("query_id", "doc_id", F.col("normalized").alias("score"), "terms"))


def lsa_search(spark, d):
    """Benchmark items in six latent dimensions, those with an id divisible by 20 as queries."""
    items = I.read(spark, d, "benchmark", "item_id", "text")
    terms = I.tokenized(items, "item_id")
    docs, vectors, _ = L.fit(terms, 6)
    asked = L.project(I.queries_of(items.where("item_id % 20 = 0")), terms, vectors, 6)
    return R.cosine_search(docs.select(F.col("doc_id").alias("vec_id"), F.col("v").alias("embedding")), asked, 5).select("query_id", "rank", "doc_id", "score")


def quoted_blocks(spark, d):
    """Shared blocks of each user turn and the answer to it."""
    turns = I.read(spark, d, "conversations")
    pairs = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked")).join(turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said")), ["conv_id", "turn"])
    both = pairs.select(F.concat_ws(":", "conv_id", "turn").alias("pair"), F.concat_ws("\u0001", "asked", "said").alias("text"))
    return A.per_text(both, lambda t: [A.quoted_blocks(*t.split("\u0001", 1))], "pair", "text", ["shared", "longest"], "shared bigint, longest bigint")


def _authored(spark, rows, function, names, schema):
    return A.per_text(spark.createDataFrame(rows, "doc string, text string"), function, "doc", "text", names, schema)


def equation_blocks(spark, d):
    return _authored(spark, EQUATIONS, A.equations, ["start", "end", "number", "equation"], "start bigint, end bigint, number string, equation string")


def equation_symbols(spark, d):
    return _authored(spark, EQUATIONS, lambda t: [s for e in A.equations(t) for s in A.symbols(e[3])], ["symbol"], "symbol string").distinct()


def text_tables(spark, d):
    return _authored(spark, TABLES, A.tables, ["start", "caption", "headers", "rows"], "start bigint, caption string, headers string, rows string")


def citation_repair(spark, d):
    return _authored(spark, DRAFTS, lambda t: [A.repair_citations(t, ["C1", "C2", "C3"], {"ev_9": "C3"})], ["text", "labels", "unknown"], "text string, labels string, unknown string")


def inferred_headings(spark, d):
    return _authored(spark, PLAIN, A.infer_headings, ["start", "title", "level", "confidence"], "start bigint, title string, level bigint, confidence double")


def highlighted(spark, d):
    terms = ["learning rate", "dropout", "accuracy"]
    return P.sections(spark).select("paper", "ordinal", A.highlight(F.col("text"), terms).alias("text")).where(F.contains("text", F.lit("[[")))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_table, extractive_answers, reranked_search, lsa_search, quoted_blocks, equation_blocks, equation_symbols, text_tables, citation_repair, inferred_headings, highlighted,
    )
}
SQL: dict[str, str] = {
    "highlighted": f"WITH {P._SEC} SELECT * FROM (SELECT paper, ordinal, regexp_replace(text, '(?i)\\b(learning rate|accuracy|dropout)\\b', '[[\\1]]', 'g') AS text FROM sec) WHERE contains(text, '[[')",
}
