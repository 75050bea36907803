"""Queries over chunks, spans, tokenizers, token streams and numerics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunks as K
from paperloom.operators import numeric as N
from paperloom.operators import tokens as B
from paperloom.operators.index import read


def _docs(spark, d):
    return read(spark, d, "documents", "doc_id", "text")


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = K.fixed_chunks(_docs(spark, d))
    return found.select("doc_id", "ordinal", "start_character", "end_character", F.sha2("text", 256).alias("sha256"))


def chunk_coverage(spark, d):
    return K.coverage(K.fixed_chunks(_docs(spark, d)), _docs(spark, d))


def boundary_chunks(spark, d):
    found = K.chunks(_docs(spark, d))
    return found.select("doc_id", "ordinal", "start_character", "end_character", F.sha2("text", 256).alias("sha256"))


def boundary_coverage(spark, d):
    return K.coverage(K.chunks(_docs(spark, d)), _docs(spark, d))


def _spans(spark, d):
    """The first line of every document's second half."""
    half = F.floor(F.length("text") / 2).cast("long")
    rest = F.substring_index(F.substring(F.col("text"), half + 1, F.lit(80)), "\n", 1)
    return _docs(spark, d).select(F.col("doc_id").alias("span_id"), "doc_id", half.alias("start"), (half + F.length(rest)).alias("end"))


def covering_chunk(spark, d):
    return K.smallest_covering(K.fixed_chunks(_docs(spark, d)), _spans(spark, d))


def span_overlap(spark, d):
    """Overlap of neighbouring chunks of a document."""
    found = K.fixed_chunks(_docs(spark, d)).select("doc_id", "ordinal", F.col("start_character").alias("a_start"), F.col("end_character").alias("a_end"))
    after = found.select("doc_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"))
    return found.join(after, ["doc_id", "ordinal"]).select("doc_id", "ordinal", F.round(K.overlap_share("a", "b"), 6).alias("share"))


def line_numbers(spark, d):
    return _spans(spark, d).join(_docs(spark, d), "doc_id").select("doc_id", T.line_of(F.col("text"), F.col("start").cast("int")).cast("long").alias("line"))


def document_identity(spark, d):
    docs = read(spark, d, "documents", "doc_id", "source", "text")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", T.stable_id("doc", T.canonical_string(name), T.canonical_string(F.sha2("text", 256))).alias("document_id"), F.octet_length("text").cast("long").alias("byte_length"))


def char_vocabulary(spark, d):
    return B.char_vocabulary(_docs(spark, d))


def byte_pairs(spark, d):
    return B.pair_counts(read(spark, d, "documents", "text").select(B.byte_ids(F.col("text")).alias("ids"))).select(F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), "n")


def char_bigrams(spark, d):
    """Next-character counts within the first nine tenths of each text."""
    train, _ = B.chronological(F.col("text"))
    chars = _docs(spark, d).select(F.split(train, "").alias("ids"))
    return B.pair_counts(chars.select(F.filter("ids", lambda x: x != "").alias("ids")))


def chronological_split(spark, d):
    train, rest = B.chronological(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(train).cast("long").alias("train_chars"), F.length(rest).cast("long").alias("validation_chars"), F.sha2(rest, 256).alias("validation_sha256"))


def corpus_sizes(spark, d):
    """Bytes, code points and terms by language, and bytes per term."""
    docs = read(spark, d, "documents", "lang", "text")
    sums = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(T.tokens(F.col("text")))).alias("terms"))
    return sums.select("lang", "bytes", "chars", F.col("terms").cast("long").alias("terms"), F.round(F.col("bytes") / F.col("terms"), 6).alias("bytes_per_term"))


def bpe_merges(spark, d):
    found = B.train_merges(read(spark, d, "benchmark", "text"), 12)
    return spark.createDataFrame([(int(a), int(b), int(c), int(n)) for a, b, c, n in found], "rank long, left long, right long, n long")


def sequence_windows(spark, d):
    """Byte windows of seventeen ids a document, every sixteen: inputs and targets shifted by one."""
    ids = read(spark, d, "documents", "doc_id", "text").select("doc_id", B.byte_ids(F.col("text")).alias("ids"))
    starts = F.when(F.size("ids") > 16, F.sequence(F.lit(0), F.size("ids") - 17, F.lit(16))).otherwise(F.array().cast("array<int>"))
    rows = ids.select("doc_id", "ids", F.explode(starts).alias("start"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), join(F.slice("ids", F.col("start") + 1, 16)).alias("inputs"), join(F.slice("ids", F.col("start") + 2, 16)).alias("targets"))


def _logits(spark, d):
    return read(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("embedding").alias("logits"), "label")


def softmax_top_k(spark, d):
    return N.top_k(_logits(spark, d), 3)


def masked_softmax(spark, d):
    """The probability of the last entry when only it and those before it of even place may be seen."""
    mask = F.transform("logits", lambda x, i: i % 2 == 1)
    p = N.softmax(F.col("logits"), mask)
    return _logits(spark, d).select("id", F.round(F.element_at(p, -1), 6).alias("last"), F.round(F.element_at(p, 1), 6).alias("first"))


def cross_entropy(spark, d):
    loss = N.cross_entropy(F.col("logits"), F.col("label"))
    sums = _logits(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))
    return sums.select("label", "n", F.round("loss", 6).alias("loss"), F.round(N.perplexity(F.col("loss")), 6).alias("perplexity"))


def turn_parents(spark, d):
    """Every assistant turn with the user turn before it in its conversation."""
    turns = read(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("parent_role", F.lag("role").over(before)).withColumn("parent_turn", F.lag("turn").over(before))
    return rows.where("role = 'assistant' and parent_role = 'user'").select("conv_id", "turn", "parent_turn", F.size(T.tokens(F.col("text"))).cast("long").alias("n_terms"))


_FC = """c AS (SELECT doc_id, k AS ordinal, k * 500 AS start_character, least(length(text), k * 500 + 600) AS end_character, substr(text, k * 500 + 1, 600) AS text FROM
 (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 100) / 500.0)::bigint))) AS k FROM documents WHERE length(text) > 0))"""
_SP = "sp AS (SELECT doc_id AS span_id, doc_id, length(text) // 2 AS start, length(text) // 2 + length(split_part(substr(text, length(text) // 2 + 1, 80), chr(10), 1)) AS stop FROM documents)"
_BY = "bt AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::int) AS ids FROM documents)"
_SM = "list_transform({v}, lambda x: exp(x - list_max({v})))"
_L = "l AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, chunk_coverage, boundary_chunks, boundary_coverage, covering_chunk, span_overlap, line_numbers, document_identity, char_vocabulary, byte_pairs, char_bigrams,
        chronological_split, corpus_sizes, bpe_merges, sequence_windows, softmax_top_k, masked_softmax, cross_entropy, turn_parents,
    )
}
SQL = {
    "fixed_chunks": f"WITH {_FC} SELECT doc_id, ordinal, start_character, end_character, sha256(text) AS sha256 FROM c",
    "chunk_coverage": "SELECT doc_id, greatest(1, ceil((length(text) - 100) / 500.0)::bigint) AS n_chunks, true AS covered FROM documents WHERE length(text) > 0",
    "boundary_coverage": None,
    "covering_chunk": f"""WITH {_FC}, {_SP}, m AS (SELECT span_id, doc_id, ordinal, end_character - start_character AS size, row_number() OVER (PARTITION BY span_id ORDER BY end_character - start_character, ordinal) AS k
        FROM sp JOIN c USING (doc_id) WHERE start_character <= start AND stop <= end_character) SELECT span_id, doc_id, ordinal, size FROM m WHERE k = 1""",
    "span_overlap": f"""WITH {_FC} SELECT a.doc_id, a.ordinal, round(greatest(0, least(a.end_character, b.end_character) - greatest(a.start_character, b.start_character))::double
        / least(a.end_character - a.start_character, b.end_character - b.start_character), 6) AS share FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.ordinal = a.ordinal + 1""",
    "line_numbers": "SELECT doc_id, length(p) - length(replace(p, chr(10), '')) + 1 AS line FROM (SELECT doc_id, substr(text, 1, length(text) // 2) AS p FROM documents)",
    "document_identity": """SELECT doc_id, 'doc_' || substr(sha256('["' || source || '/' || doc_id || '","' || sha256(text) || '"]'), 1, 24) AS document_id, strlen(text) AS byte_length FROM documents""",
    "char_vocabulary": """SELECT character, row_number() OVER (ORDER BY ord(character)) - 1 AS token_id, n FROM (SELECT character, count(*) AS n FROM
        (SELECT unnest(string_split(text, '')) AS character FROM documents) WHERE character <> '' GROUP BY character)""",
    "byte_pairs": f"WITH {_BY}, p AS (SELECT unnest(list_slice(ids, 1, len(ids) - 1)) AS a, unnest(list_slice(ids, 2, len(ids))) AS b FROM bt) SELECT a::bigint AS left, b::bigint AS right, count(*) AS n FROM p GROUP BY 1, 2",
    "char_bigrams": """WITH c AS (SELECT substr(text, 1, floor(length(text) * 0.9::double)::bigint) AS t FROM documents), s AS (SELECT t, unnest(range(1, length(t))) AS i FROM c)
        SELECT substr(t, i, 1) AS left, substr(t, i + 1, 1) AS right, count(*) AS n FROM s GROUP BY 1, 2""",
    "chronological_split": """SELECT doc_id, floor(length(text) * 0.9::double)::bigint AS train_chars, length(text) - floor(length(text) * 0.9::double)::bigint AS validation_chars,
        sha256(substr(text, floor(length(text) * 0.9::double)::bigint + 1)) AS validation_sha256 FROM documents""",
    "corpus_sizes": f"""SELECT lang, sum(strlen(text))::bigint AS bytes, sum(length(text))::bigint AS chars, sum(n)::bigint AS terms, round(sum(strlen(text))::double / sum(n), 6) AS bytes_per_term
        FROM (SELECT lang, text, len({T.sql_tokens('text')}) AS n FROM documents) GROUP BY lang""",
    "sequence_windows": f"""WITH {_BY}, s AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 16, 16)) AS start FROM bt)
        SELECT doc_id, start, array_to_string(list_slice(ids, start + 1, start + 16), ' ') AS inputs, array_to_string(list_slice(ids, start + 2, start + 17), ' ') AS targets FROM s""",
    "softmax_top_k": f"""WITH {_L}, e AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS token_id FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, token_id) AS rank FROM e),
        t AS (SELECT *, exp(x - max(x) OVER (PARTITION BY id)) AS p FROM r WHERE rank <= 3) SELECT id, rank, token_id, round(p / sum(p) OVER (PARTITION BY id), 6) AS probability FROM t""",
    "masked_softmax": f"""WITH {_L}, e AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i FROM l), m AS (SELECT id, i, CASE WHEN i % 2 = 1 THEN exp(x - max(CASE WHEN i % 2 = 1 THEN x END) OVER (PARTITION BY id)) ELSE 0 END AS p FROM e),
        s AS (SELECT id, i, p / sum(p) OVER (PARTITION BY id) AS p, max(i) OVER (PARTITION BY id) AS n FROM m) SELECT id, round(max(p) FILTER (WHERE i = n), 6) AS last, round(max(p) FILTER (WHERE i = 0), 6) AS first FROM s GROUP BY id""",
    "cross_entropy": f"""WITH {_L}, x AS (SELECT label, -ln(({_SM.format(v='v')})[label + 1] / list_sum({_SM.format(v='v')})) AS loss FROM l)
        SELECT label, count(*) AS n, round(avg(loss), 6) AS loss, round(exp(least(avg(loss), 709.782712893384::double)), 6) AS perplexity FROM x GROUP BY label""",
    "turn_parents": f"""WITH x AS (SELECT *, lag(role) OVER w AS parent_role, lag(turn) OVER w AS parent_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, parent_turn, len({T.sql_tokens('text')}) AS n_terms FROM x WHERE role = 'assistant' AND parent_role = 'user'""",
}
SQL = {k: v for k, v in SQL.items() if v}
