"""Cost-balanced packing of token documents into fixed-length sequences.

Tasks pack what they read, in groups of about GROUP_TOKENS ids, without a shuffle.  The cost of a
piece of n ids is LINEAR * n + QUADRATIC * n * n: the layers and the attention inside it.  A
group's T ids get T // length full sequences and one sequence for each binary digit of the rest,
so no sequence needs padding.  Documents longer than a sequence give up full pieces first, which
fill sequences of their own; what remains is dealt in descending length to the cheapest of all
sequences that have room for it.  Only if none has room, the piece is cut at the end of the
cheapest one and its rest dealt on.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.tokens import encoder

#: Ids that are packed together.
GROUP_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence lengths that sum to tokens: full ones, then falling powers of two."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Shelf:
    """Sequences by free room: the cheapest of those with at least so much room, in logarithmic time."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _renew(self, room: int) -> None:
        at = self.size + room
        self.best[at] = self.heaps[room][0] if self.heaps[room] else None
        while at > 1:
            at >>= 1
            a, b = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = a if b is None or (a is not None and a < b) else b

    def put(self, room: int, cost: float, sequence: int) -> None:
        heap = self.heaps[room]
        heapq.heappush(heap, (cost, sequence))
        if heap[0] == (cost, sequence):
            self._renew(room)

    def take(self, least: int, room: list[int]) -> tuple[float, int] | None:
        """Removes the cheapest sequence with at least that much room; room: of every sequence."""
        at = self.size + least
        found = self.best[at]
        while at > 1:  # the rooms above `least` are the right siblings on the way up
            if not at & 1 and (best := self.best[at + 1]) is not None and (found is None or best < found):
                found = best
            at >>= 1
        if found is not None:
            heapq.heappop(self.heaps[room[found[1]]])
            self._renew(room[found[1]])
        return found


def assign(lengths: list[int], length: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each sequence is filled exactly."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    used = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % length, length):
            pieces.append((doc, start, length, used, 0))
            used += 1
        if n % length:
            rest.append((-(n % length), doc, n - n % length))
    room = capacities(-sum(n for n, _, _ in rest), length)
    taken = [0] * len(room)
    shelf = Shelf(length)
    for i, free in enumerate(room):
        shelf.put(free, 0.0, i)
    heapq.heapify(rest)
    while rest:
        n, doc, start = heapq.heappop(rest)
        n = -n
        cost, i = shelf.take(n, room) or shelf.take(1, room)
        put = min(n, room[i])
        pieces.append((doc, start, put, used + i, taken[i]))
        room[i] -= put
        taken[i] += put
        if room[i]:
            shelf.put(room[i], cost + LINEAR * put + QUADRATIC * put * put, i)
        if put < n:
            heapq.heappush(rest, (put - n, doc, start + put))
    return pieces


def pack(
    docs: DataFrame, vocabulary: str, split: str, end_id: int, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece; see SCHEMA, with the piece's ids as `ids` if asked for.

    A null text counts as empty and gives the end id alone.  sequence_id is unique but not gapless:
    it joins the number of the task and of the sequence in it.  Rows without an id are packed too,
    repeated rows each on their own; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(vocabulary, split), np.array([end_id], dtype="<u4")
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def close():
            nonlocal held, size, base
            rows = []
            last = -1
            for doc, start, n, sequence, offset in assign([len(x) for _, x in held], length):
                name, ids = held[doc]
                piece = ids[start : start + n]
                rows.append((name, start, n, zlib.crc32(piece.tobytes()), len(ids), base + sequence, offset, piece))
                last = max(last, sequence)
            base += last + 1
            held, size = [], 0
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            if with_ids:
                return pa.RecordBatch.from_arrays([*columns, pa.array([r[7].tolist() for r in rows], pa.list_(pa.int64()))], names=[*NAMES, "ids"])
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), model.encode(batch.column(1)), strict=True):
                held.append((doc, np.concatenate([ids, end]).astype("<u4")))
                size += len(ids) + 1
                if size >= GROUP_TOKENS:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<bigint>" * with_ids)
