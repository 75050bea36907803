"""Chunks, spans and their coverage."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_chunks(docs: DataFrame, size: int = 600, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, start_character, end_character, text): windows of a fixed size, in code points; empty texts have none."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / (size - overlap)).cast("int") - 1))
    rows = docs.where(n > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.posexplode(starts).alias("ordinal", "k"))
    start = F.col("k") * (size - overlap)
    end = F.least(F.length("t"), start + size)
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), start.cast("long").alias("start_character"), end.cast("long").alias("end_character"), F.substring("t", start + 1, F.lit(size)).alias("text"))


@dataclass(frozen=True)
class ChunkRules:
    target: int = 600
    maximum: int = 900
    overlap: int = 100
    minimum: int = 80


_BREAKS = (re.compile(r"\n[ \t]*\n"), re.compile(r"[.!?][\"')\]]*\s+"), re.compile(r"\s+"))


def cut_section(text: str, rules: ChunkRules) -> list[tuple[int, int]]:
    """Chunk spans of one section.  A cut prefers a paragraph, then a sentence, then any white space: the last
    one up to the target, else the first beyond it.  Breaks are found once for the text and looked up by position."""
    ends = [[m.end() for m in b.finditer(text)] for b in _BREAKS]
    spans, start, n = [], 0, len(text)
    while start < n:
        end = n
        if n - start > rules.maximum:
            low, goal, high = start + max(rules.minimum, rules.overlap + 1), start + rules.target, start + rules.maximum
            end = high
            for places in ends:
                a, b, c = bisect.bisect_left(places, low), bisect.bisect_right(places, goal), bisect.bisect_right(places, high)
                if a < c:
                    end = places[b - 1] if b > a else places[a]
                    break
        spans.append((start, end))
        if end == n:
            break
        start = end - rules.overlap
    return spans


def chunks(docs: DataFrame, rules: ChunkRules = ChunkRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, start_character, end_character, text) of every document by the boundary rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, a, b, t[a:b]) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (a, b) in enumerate(cut_section(t, rules))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)], names=["doc_id", "ordinal", "start_character", "end_character", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ordinal bigint, start_character bigint, end_character bigint, text string")


def coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_chunks, covered: whether the chunks run from start to end without a gap.  docs: doc_id, text."""
    before = F.lag("end_character").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    gaps = found.withColumn("gap", F.when(F.col("start_character") > F.coalesce(before, F.lit(0)), 1).otherwise(0))
    sums = gaps.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("gap").alias("gaps"), F.max("end_character").alias("last"))
    joined = sums.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    return joined.select("doc_id", "n_chunks", ((F.col("gaps") == 0) & (F.col("last") == F.col("n"))).alias("covered"))


def overlap_share(a: str, b: str):
    """Shared length over the shorter span's; columns a_start, a_end, b_start, b_end."""
    shared = F.greatest(F.lit(0), F.least(f"{a}_end", f"{b}_end") - F.greatest(f"{a}_start", f"{b}_start"))
    return shared / F.least(F.col(f"{a}_end") - F.col(f"{a}_start"), F.col(f"{b}_end") - F.col(f"{b}_start"))


def smallest_covering(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Each span (span_id, doc_id, start, end) with the shortest chunk that holds it, ties by ordinal."""
    joined = spans.join(found, "doc_id").where((F.col("start_character") <= F.col("start")) & (F.col("end") <= F.col("end_character")))
    best = F.min(F.struct((F.col("end_character") - F.col("start_character")).alias("size"), "ordinal")).alias("best")
    return joined.groupBy("span_id", "doc_id").agg(best).select("span_id", "doc_id", F.col("best.ordinal").alias("ordinal"), F.col("best.size").alias("size"))
