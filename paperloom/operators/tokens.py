"""Character, byte and merge tokenizers as tables, and next-token statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.graph import use_checkpoints


def char_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(character, token_id, n): distinct code points in order (that of their UTF-8 bytes).  The table has a row per code point, so one window numbers it."""
    letters = docs.select(F.explode(F.split(F.col(text_col), "")).alias("character")).where("character <> ''")
    counts = letters.groupBy("character").agg(F.count("*").alias("n"))
    return counts.select("character", (F.row_number().over(Window.orderBy("character")) - 1).cast("long").alias("token_id"), "n")


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as ids, in time linear in the text."""
    digits = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(digits, lambda x: F.conv(x, 16, 10).cast("int"))


def pair_counts(streams: DataFrame, column: str = "ids") -> DataFrame:
    """(left, right, n) of adjacent ids, overlapping ones too, never across rows."""
    ids = F.col(column)
    pairs = F.arrays_zip(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("l"), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("r"))
    return streams.select(F.explode(pairs).alias("p")).groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.count("*").alias("n"))


def replace_pair(ids: list[int], left: int, right: int, new: int) -> list[int]:
    """Left to right, without overlaps."""
    out, k = [], 0
    while k < len(ids):
        if k + 1 < len(ids) and ids[k] == left and ids[k + 1] == right:
            out.append(new)
            k += 2
        else:
            out.append(ids[k])
            k += 1
    return out


def train_merges(docs: DataFrame, merges: int, least: int = 2, every: int = 4) -> list[tuple[int, int, int, int]]:
    """(rank, left, right, n): the most frequent pair each time, ties by the smaller ids; stops below `least`.

    Each round is one aggregation; streams are rewritten in the workers and checkpointed every few rounds.
    """
    use_checkpoints(docs.sparkSession)
    streams = docs.select(byte_ids(F.col("text")).alias("ids")).checkpoint()
    found: list[tuple[int, int, int, int]] = []
    for rank in range(merges):
        best = pair_counts(streams).orderBy(F.col("n").desc(), "left", "right").limit(1).collect()
        if not best or best[0]["n"] < least:
            break
        left, right, n = best[0]["left"], best[0]["right"], best[0]["n"]
        found.append((rank, left, right, n))

        def run(batches: Iterator[pa.RecordBatch], left=left, right=right, new=256 + rank) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([replace_pair(x, left, right, new) for x in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["ids"])

        streams = streams.mapInArrow(run, "ids array<int>")
        if rank % every == every - 1:
            streams = streams.checkpoint()
    return found


def encode_merges(data: bytes, merges: dict[tuple[int, int], int]) -> list[int]:
    """Applies the earliest learnt merge that fits, again and again.  merges: pair to rank."""
    ids = list(data)
    while len(ids) > 1:
        pair = min(zip(ids, ids[1:], strict=False), key=lambda p: merges.get(p, 1 << 30))
        if pair not in merges:
            break
        ids = replace_pair(ids, *pair, 256 + merges[pair])
    return ids


def decode_merges(ids: list[int], merges: dict[tuple[int, int], int]) -> bytes:
    pairs = {256 + rank: pair for pair, rank in merges.items()}
    out, stack = bytearray(), list(reversed(ids))
    while stack:
        x = stack.pop()
        if x in pairs:
            stack += [pairs[x][1], pairs[x][0]]
        else:
            out.append(x)
    return bytes(out)


def chronological(text: Column, fraction: float = 0.9) -> tuple[Column, Column]:
    """The first part of a text and the rest."""
    n = F.floor(F.length(text) * fraction).cast("int")
    return F.substring(text, F.lit(1), n), F.substring(text, n + 1, F.length(text))
