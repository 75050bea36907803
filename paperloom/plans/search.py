"""Retrieval queries: benchmark items with an id divisible by 20 against all documents, vectors likewise."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import ALIASES, STOPWORDS, query_terms, quoted, sql_tokens, tokens
from paperloom.operators import index as I
from paperloom.operators import metrics as M
from paperloom.operators import retrieval as R
from paperloom.session import checkpoint_folder


def _terms(spark, d):
    return I.tokenized(I.read(spark, d, "documents", "doc_id", "text"))


def _items(spark, d):
    return I.read(spark, d, "benchmark", "item_id", "text").where("item_id % 20 = 0")


def _queries(spark, d):
    return I.queries_of(_items(spark, d))


_BUILT: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, d: str) -> I.StoredIndex:
    """The index of the documents of a folder, built once by an application and read by all its searches."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        path = f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        I.build_index(I.read(spark, d, "documents", "doc_id", "text"), path, R.tfidf_weight)
        _BUILT[key] = path
    return I.StoredIndex(spark, _BUILT[key])


def _bm25(spark, d, k=10):
    return R.search(stored_index(spark, d), _queries(spark, d), "bm25", k)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = I.read(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_terms"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_distinct"))


def term_stats(spark, d):
    return I.term_stats(_terms(spark, d))


def corpus_stats(spark, d):
    return I.corpus_stats(_terms(spark, d)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def query_normalization(spark, d):
    return I.read(spark, d, "benchmark", "item_id", "text").select("item_id", F.array_join(query_terms(F.col("text")), " ").alias("query"))


def bm25_search(spark, d):
    return _bm25(spark, d)


def bm25_explain(spark, d):
    found = R.bm25_contributions(_terms(spark, d), _queries(spark, d))
    return found.select("query_id", "doc_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


def tfidf_search(spark, d):
    return R.search(stored_index(spark, d), _queries(spark, d), "tfidf")


def _sides(spark, d):
    return _bm25(spark, d, 20), R.search(stored_index(spark, d), _queries(spark, d), "tfidf", 20)


def rrf_fusion(spark, d):
    return R.reciprocal_rank_fusion(*_sides(spark, d))


def weighted_fusion(spark, d):
    return R.weighted_fusion(*_sides(spark, d))


def max_normalization(spark, d):
    return R.max_normalized(_bm25(spark, d, 20)).select("query_id", "doc_id", "score", "normalized")


def filtered_search(spark, d):
    """Filters choose candidates; the statistics stay those of the whole corpus."""
    found = R.bm25_contributions(_terms(spark, d), _queries(spark, d))
    german = I.read(spark, d, "documents", "doc_id", "lang").where("lang = 'en'").select("doc_id")
    scores = found.join(german, "doc_id", "left_semi").groupBy("query_id", "doc_id").agg(F.round(F.sum("contribution"), 6).alias("score"))
    return R.rank(scores, 10).select("query_id", "rank", "doc_id", "score")


def vector_cosine(spark, d):
    vectors = I.read(spark, d, "embeddings", "vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.cosine_search(vectors, asked, 5).select("query_id", "rank", "doc_id", "score")


def _graded_vectors(spark, d):
    """The five nearest other vectors of each asked one; the same label is relevant."""
    labels = I.read(spark, d, "embeddings", "vec_id", "label")
    found = vector_cosine(spark, d).where("query_id <> doc_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    found = found.join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return found.select("query_id", "rank", "doc_id", (F.col("label") == F.col("query_label")).cast("int").alias("relevant"), F.col("query_label").alias("category"))


def _gold(spark, d):
    labels = I.read(spark, d, "embeddings", "vec_id", "label")
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    return labels.where("vec_id % 20 = 0").join(n, "label").select(F.col("vec_id").alias("query_id"), (F.col("n") - 1).alias("n_gold"), F.col("label").alias("category"))


def ranking_metrics(spark, d):
    return M.per_query(_graded_vectors(spark, d), _gold(spark, d), 4)


def ranking_metrics_by_category(spark, d):
    return M.averages(M.per_query(_graded_vectors(spark, d), _gold(spark, d), 4).join(_gold(spark, d).select("query_id", "category"), "query_id"))


def diversified_search(spark, d):
    """The best document of each source first, then the others, both in rank order."""
    found = _bm25(spark, d, 20).join(I.read(spark, d, "documents", "doc_id", "source"), "doc_id")
    again = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")) > 1
    order = Window.partitionBy("query_id").orderBy("again", "rank")
    return found.withColumn("again", again).withColumn("position", F.row_number().over(order).cast("long")).select("query_id", "position", "doc_id", "source")


def source_cap(spark, d):
    """At most two documents of a source and four in all, relabelled in rank order."""
    found = _bm25(spark, d, 20).join(I.read(spark, d, "documents", "doc_id", "source"), "doc_id")
    capped = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).where("n <= 2")
    capped = capped.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("k <= 4")
    return capped.select("query_id", F.concat(F.lit("C"), F.col("k").cast("string")).alias("label"), "doc_id", "source")


def char_budget(spark, d):
    """4000 characters spent in rank order; the last document is cut, later ones get nothing."""
    found = _bm25(spark, d).join(I.read(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    before = F.coalesce(F.sum("n_chars").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).where("before < 4000").select("query_id", "rank", "doc_id", F.least(F.col("n_chars"), 4000 - F.col("before")).alias("chars"))


def rerank_features(spark, d):
    """Coverage, rare-term coverage and length signals of the twenty best documents, and a score of them."""
    terms, queries = _terms(spark, d), _queries(spark, d)
    best = _bm25(spark, d, 20)
    found, stats = I.asked_postings(terms, queries)
    stats = stats.select("n_docs")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = queries.join(df, "term", "left").crossJoin(stats).withColumn("w", R.smooth_idf(F.col("n_docs"), F.coalesce("df", F.lit(0))))
    total = weighed.groupBy("query_id").agg(F.sum("w").alias("all_w"), F.count("*").alias("all_n"))
    hit = best.join(weighed.select("query_id", "term", "w"), "query_id").join(terms.select("doc_id", "terms"), "doc_id").where(F.array_contains("terms", F.col("term")))
    hit = hit.groupBy("query_id", "doc_id").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    joined = best.join(hit, ["query_id", "doc_id"]).join(total, "query_id").join(I.read(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    top = F.max("score").over(Window.partitionBy("query_id"))
    lexical, coverage, rare = F.col("score") / top, F.col("n") / F.col("all_n"), F.col("w") / F.col("all_w")
    short = F.least(F.lit(1.0), F.col("n_chars") / 500)
    score = F.greatest(F.lit(0.0), lexical + 0.4 * coverage + 0.2 * rare - 0.05 * short)
    return joined.select(
        "query_id", "doc_id", F.round(lexical, 6).alias("lexical"), F.round(coverage, 6).alias("coverage"), F.round(rare, 6).alias("rare"),
        F.round(short, 6).alias("length_signal"), F.round(score, 6).alias("score"),
    )


_T = f"t AS (SELECT doc_id, {sql_tokens('text')} AS terms FROM documents), k AS (SELECT doc_id, terms, len(terms) AS term_count FROM t WHERE len(terms) > 0)"
_S = "s AS (SELECT count(*) AS n_docs, avg(term_count) AS avg_len FROM k)"
_ALIAS = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE x END"
_QT = f"""qd AS (SELECT item_id, text, list_transform({sql_tokens('text')}, lambda x: {_ALIAS}) AS raw FROM benchmark),
qu AS (SELECT item_id, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS uniq FROM qd),
qk AS (SELECT item_id, uniq, list_filter(uniq, lambda x: NOT list_contains({quoted(STOPWORDS)}, x)) AS kept FROM qu),
qf AS (SELECT item_id, CASE WHEN len(kept) > 0 THEN kept ELSE uniq END AS terms FROM qk)"""
_Q = f"{_QT}, q AS (SELECT item_id AS query_id, unnest(terms) AS term FROM qf WHERE item_id % 20 = 0)"
_P = "e AS (SELECT doc_id, term_count, unnest(terms) AS term FROM k), p AS (SELECT doc_id, term_count, term, count(*) AS tf FROM e GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
_C = """c AS (SELECT query_id, doc_id, p.term, tf, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf,
 ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * term_count / avg_len)) AS contribution
 FROM q JOIN p USING (term) JOIN f USING (term), s)"""
_WITH = f"WITH {_T}, {_S}, {_Q}, {_P}, {_C}"
_B = "b AS (SELECT query_id, doc_id, round(sum(contribution), 6) AS score, count(*) AS matched FROM c GROUP BY ALL), br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0)"
_F = """w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n_docs + 1) / (df + 1)) + 1) AS w FROM p JOIN f USING (term), s),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
qw AS (SELECT query_id, term, ln((n_docs + 1) / (df + 1)) + 1 AS qw FROM q JOIN f USING (term), s),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY query_id),
tf0 AS (SELECT query_id, doc_id, sum(w * qw) AS d FROM w JOIN qw USING (term) GROUP BY ALL),
ts AS (SELECT query_id, doc_id, round(d / (norm * qnorm), 6) AS score FROM tf0 JOIN n USING (doc_id) JOIN qn USING (query_id)),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ts WHERE score > 0)"""
_V = """v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
 FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v WHERE score > 0), vt AS (SELECT * FROM vr WHERE rank <= 5)"""
_G = f"""{_V}, g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, doc_id, (x.label = y.label)::int AS relevant, y.label AS category
 FROM vt JOIN embeddings x ON x.vec_id = doc_id JOIN embeddings y ON y.vec_id = query_id WHERE query_id <> doc_id),
gold AS (SELECT a.vec_id AS query_id, a.label AS category, (SELECT count(*) FROM embeddings b WHERE b.label = a.label) - 1 AS n_gold FROM embeddings a WHERE a.vec_id % 20 = 0)"""

QUERIES = {
    f.__name__: f
    for f in (
        token_counts, term_stats, corpus_stats, query_normalization, bm25_search, bm25_explain, tfidf_search, rrf_fusion, weighted_fusion, max_normalization,
        filtered_search, vector_cosine, ranking_metrics, ranking_metrics_by_category, diversified_search, source_cap, char_budget, rerank_features,
    )
}

SQL = {
    "token_counts": f"WITH {_T} SELECT doc_id, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct FROM t",
    "term_stats": f"WITH {_T}, {_P} SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS cf FROM p GROUP BY term",
    "corpus_stats": f"WITH {_T}, {_S} SELECT n_docs, round(avg_len, 6) AS avg_len FROM s",
    "query_normalization": f"WITH {_QT} SELECT item_id, array_to_string(terms, ' ') AS query FROM qf",
    "bm25_search": f"{_WITH}, {_B} SELECT query_id, rank, doc_id, score, matched FROM br WHERE rank <= 10",
    "bm25_explain": f"{_WITH} SELECT query_id, doc_id, term, tf, df, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM c",
    "tfidf_search": f"{_WITH}, {_F} SELECT query_id, rank, doc_id, score FROM tr WHERE rank <= 10",
    "rrf_fusion": f"""{_WITH}, {_B}, {_F}, m AS (SELECT query_id, doc_id, round(coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0), 9) AS score
        FROM (SELECT * FROM br WHERE rank <= 20) a FULL JOIN (SELECT * FROM tr WHERE rank <= 20) b USING (query_id, doc_id))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM m""",
    "weighted_fusion": f"""{_WITH}, {_B}, {_F}, a AS (SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS x FROM br WHERE rank <= 20),
        b2 AS (SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS y FROM tr WHERE rank <= 20),
        m AS (SELECT query_id, doc_id, round(0.5::double * coalesce(x, 0) + 0.5::double * coalesce(y, 0), 6) AS score FROM a FULL JOIN b2 USING (query_id, doc_id))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM m WHERE score > 0""",
    "max_normalization": f"{_WITH}, {_B} SELECT query_id, doc_id, score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalized FROM br WHERE rank <= 20",
    "filtered_search": f"""{_WITH}, m AS (SELECT query_id, doc_id, round(sum(contribution), 6) AS score FROM c WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0) SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "vector_cosine": f"WITH {_V} SELECT query_id, rank, doc_id, score FROM vt",
    "ranking_metrics": f"WITH {_G} " + M.sql_per_query(4),
    "ranking_metrics_by_category": f"WITH {_G}, pq AS ({M.sql_per_query(4)}) " + M.SQL_AVERAGES,
    "diversified_search": f"""{_WITH}, {_B}, m AS (SELECT br.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 AS again FROM br JOIN documents USING (doc_id) WHERE rank <= 20)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY again, rank) AS position, doc_id, source FROM m""",
    "source_cap": f"""{_WITH}, {_B}, m AS (SELECT br.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM br JOIN documents USING (doc_id) WHERE rank <= 20),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kk FROM m WHERE n <= 2) SELECT query_id, 'C' || kk AS label, doc_id, source FROM o WHERE kk <= 4""",
    "char_budget": f"""{_WITH}, {_B}, m AS (SELECT query_id, rank, doc_id, n_chars, cast(coalesce(sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before
        FROM br JOIN documents USING (doc_id) WHERE rank <= 10) SELECT query_id, rank, doc_id, least(n_chars, 4000 - before) AS chars FROM m WHERE before < 4000""",
    "rerank_features": f"""{_WITH}, {_B}, qw AS (SELECT query_id, term, ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM q LEFT JOIN f USING (term), s),
        tot AS (SELECT query_id, sum(w) AS all_w, count(*) AS all_n FROM qw GROUP BY query_id),
        best AS (SELECT * FROM br WHERE rank <= 20),
        hit AS (SELECT query_id, doc_id, sum(w) AS w, count(*) AS n FROM best JOIN qw USING (query_id) JOIN p USING (doc_id, term) GROUP BY ALL),
        x AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS lexical, n::double / all_n AS coverage, w / all_w AS rare, least(1.0::double, n_chars::double / 500) AS short
          FROM best JOIN hit USING (query_id, doc_id) JOIN tot USING (query_id) JOIN documents USING (doc_id))
        SELECT query_id, doc_id, round(lexical, 6) AS lexical, round(coverage, 6) AS coverage, round(rare, 6) AS rare, round(short, 6) AS length_signal,
          round(greatest(0.0::double, lexical + 0.4::double * coverage + 0.2::double * rare - 0.05::double * short), 6) AS score FROM x""",
}
