"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import table, text_of

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.exact_dedup import exact_groups

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.encode(text_of(), "UTF-8"), 256)
    return exact_groups(docs, keep={"text_sha256": sha}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.common import Scratch
    from paperloom.llm.token_store import write_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return write_tokens(docs, Scratch(spark, "tokens").path("store"), vocabulary(WORD_BPE), "words", end_id=2).documents()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.packing import pack

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary(BYTE_BPE), "spaces", end_id=0, length=1024)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.simhash import simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, bits=64, radius=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.common import Scratch
    from paperloom.llm.warc import read_warc, write_warc

    work = Scratch(spark, "warc")
    path = work.path("archive")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, work)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that holds a benchmark item: its id, how many items, and the most overlap."""
    from paperloom.llm.decontaminate import contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("overlap").alias("overlap"))


def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.extract_html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.quality import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.line_dedup import line_dedup

    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_length=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_decontaminate": op7_decontaminate,
    "op8_extract_html": op8_extract_html,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}

_BLANK = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_KEY = f"translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op5_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages),
        f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
        SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (digest)""",
    "op10_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
        keyed AS (SELECT doc_id, line, pos, {_KEY} AS key FROM lines),
        frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
