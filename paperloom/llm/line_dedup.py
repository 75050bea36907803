"""Line dedup in DataFrame functions only.

Lines are exploded with their positions and two 64-bit hashes of their keys, a count of documents
per key keeps the frequent ones, an equi-join marks the positions to drop, and documents are put
together again by position.  A key counts once a document, and counts combine on the map side.
Only hashes and positions are joined, never the lines.  A document is known by two hashes of its
id and text, so repeated rows share one decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import BLANKS, Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """Per row of docs: id, n_lines, n_dropped and kept_text.

    Lines end at line feeds; a null or empty text is one empty line.  Keys of at least min_length
    code points that at least min_docs documents hold lose all their lines.  Documents are told
    apart by their ids: rows that repeat an id count once, and rows without an id are one document.
    Lines that stay are joined by line feeds; kept_text is empty if none stays.  Every row gives a
    row, repeated ones too.  An empty table gives an empty result.
    """
    work = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("k1"), F.xxhash64(F.lit(1), id_col, text).alias("k2"), text.alias("text")
    )
    lines = base.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = base.select("id", F.transform(F.split("text", "\n", -1), line_key).alias("keys"))
    once = keyed.select("id", F.explode(F.array_distinct(F.filter("keys", lambda k: F.char_length(k) >= min_length))).alias("key"))
    # a hot key is spread by document first, and counted where it lies
    once = once.select("id", _hashes(F.col("key")).alias("h")).select("id", "h.h1", "h.h2").distinct()
    frequent = work.save(once.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "frequent")
    marked = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_length)
    marked = marked.select("k1", "k2", "pos", _hashes(F.col("key")).alias("h")).select("k1", "k2", "pos", "h.h1", "h.h2")
    drops = work.save(
        marked.join(frequent, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("pos").alias("drops")),
        "drops",
    )
    cut = F.split("text", "\n", -1)
    joined = base.join(drops, ["k1", "k2"], "left").select("id", cut.alias("lines"), "drops")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i))), "\n").alias("kept_text"),
    )
