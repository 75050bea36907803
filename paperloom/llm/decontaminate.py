"""Benchmark passages in documents, found through canonical templates.

Numbers, names and units become typed placeholders and other words are lower-cased without the
punctuation around them.  Windows of WINDOW canonical words of documents are joined by hash with
those of the benchmark's items; a window needs LITERALS words that are no placeholder, and one with
fewer joins by the words and values themselves.  Items shorter than a window are matched whole, by
their words and, with LEAST_LITERALS words that are no placeholder, by template; those of fewer
than LITERALS words, and templates with fewer than LITERALS literals, only where they stand as a
sentence or line of their own.  Windows
that line up with one item are checked slot by slot: one value of the item must always stand for
one value in the document, so a question with other numbers or names is caught while a chance
sequence of placeholders is not.  A value that stands for two takes only the windows that hold it
out, and not those whose values are the item's own.  A bitmap of the items' hashes, made in the
executors and of bounded size, spares the join windows that cannot match; the more windows the
benchmark has beyond that size, the more of them pass it, and the join decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import pieces
from paperloom.llm.common import Scratch

WINDOW, LITERALS, LEAST_LITERALS = 8, 4, 2
#: The share of an item's windows that makes a document contaminated.
SHARE = 0.3
#: Words in a row that make it contaminated, however long the item is.
RUN = 13
#: Logarithms of the fewest and the most bits of the bitmap; between them it has 256 for each window.
BITMAP_BITS = (22, 26)

# Units, which count only behind a number.
UNITS = frozenset(
    "% $ € £ ° g kg mg lb lbs oz t ton tons tonne tonnes m km cm mm mi mile miles meter meters metre metres foot feet ft inch inches yard yards l ml liter liters litre "
    "litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "pound pounds percent degree degrees kmh mph kw kwh w v a hz mb gb tb".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?(\d[\d.,:/]*)(%|[a-z°]{1,4})?")
_CODE = {k: np.uint64(xxhash.xxh64_intdigest(f"\0{k}")) for k in ("number", "name", "unit")}
_BASE = 0x9E3779B97F4A7C15 | 1
NUMBER, TITLE, UNIT, ENDS, EMPTY = 1, 2, 4, 8, 16


def _strip(piece: str) -> tuple[str, bool]:
    """The piece without punctuation around it, and whether that ends a sentence."""
    a, b = 0, len(piece)
    word = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M" or c in "%$€£°"
    while a < b and not word(piece[a]):
        a += 1
    while b > a and not word(piece[b - 1]):
        b -= 1
    return piece[a:b], any(c in ".!?:\n" for c in piece[b:])


def describe(piece: str) -> tuple[int, int, str]:
    """(hash of the literal, flags, value) of a piece; numbers have no literal."""
    core, ends = _strip(piece)
    flags = ENDS * ends
    if not core:
        return 0, flags | EMPTY, ""
    low = core.lower()
    number = _NUMBER.fullmatch(low)
    if number and (not number[2] or number[2] in UNITS):
        return 0, flags | NUMBER, number[1].replace(",", "").rstrip(".:/")
    if len(core) > 1 and core[0].isupper() and core[1:].islower() and core.isalpha():
        flags |= TITLE
    if low in UNITS:
        flags |= UNIT
    return xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), flags, low


class Windows:
    """Canonical words of a block of texts and the hashes of their windows."""

    def __init__(self, texts: pa.Array):
        distinct, at, offsets = pieces.cut(texts, lines=True)
        seen = [describe(p) for p in distinct]
        literal = np.array([s[0] for s in seen], dtype=np.uint64)[at] if len(at) else np.zeros(0, np.uint64)
        flags = np.array([s[1] for s in seen], dtype=np.uint8)[at] if len(at) else np.zeros(0, np.uint8)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        # a word starts a sentence if nothing but sentence ends and empty pieces stand between it and the last word's end
        full = (flags & EMPTY) == 0
        index = np.arange(len(at))
        last_end = np.maximum.accumulate(np.where((flags & ENDS) != 0, index, -1)) if len(at) else index
        last_word = np.maximum.accumulate(np.where(full, index, -1)) if len(at) else index
        before_end, before_word = np.concatenate([[-1], last_end[:-1]]), np.concatenate([[-1], last_word[:-1]])
        starts = (before_word < offsets[doc]) | (before_end >= before_word) if len(at) else np.zeros(0, bool)
        literal, flags, doc, self.piece, starts = literal[full], flags[full], doc[full], at[full], starts[full]
        number = (flags & NUMBER) != 0
        after = np.concatenate([[False], number[:-1]]) & np.concatenate([[False], doc[1:] == doc[:-1]]) if len(doc) else number
        unit = ((flags & UNIT) != 0) & after & ~number
        name = ((flags & TITLE) != 0) & ~starts & ~unit & ~number
        self.slot = np.select([number, unit, name], [1, 2, 3], 0).astype(np.uint8)
        codes = np.array([0, _CODE["number"], _CODE["unit"], _CODE["name"]], dtype=np.uint64)[self.slot]
        codes = np.where(self.slot == 0, literal, codes)
        self.values = [s[2] for s in seen]
        self.first = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.doc, self.codes, self.literal, self.starts = doc, codes, literal, starts

    def words(self) -> np.ndarray:
        """A hash of each word or number as it stands."""
        own = np.array([xxhash.xxh64_intdigest(f"\1{v}".encode("utf-8", "surrogatepass")) for v in self.values], dtype=np.uint64)
        return own[self.piece] if len(self.piece) else np.zeros(0, np.uint64)

    def hashes(self, codes: np.ndarray, size: int, salt: int = 0, verbatim: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of all runs of `size` codes, how many literals each holds, and where those lie that are within one text."""
        n = max(0, len(codes) - size + 1)
        h = np.full(n, salt, dtype=np.uint64)
        literals = np.zeros(n, dtype=np.int64)
        for k in range(size):
            h += codes[k : k + n] * np.uint64(pow(_BASE, k, 1 << 64))
            literals += self.slot[k : k + n] == 0
        good = self.doc[:n] == self.doc[size - 1 :][:n] if n else np.zeros(0, bool)
        if size < WINDOW and n:  # whole items that are short or mostly placeholders must be a sentence or line of their own
            alone = self.starts[:n] & np.concatenate([self.starts, [True]])[size : size + n]
            good = good & (alone | (np.int64(size) >= LITERALS) & ((literals >= LITERALS) | verbatim))
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), literals, np.flatnonzero(good)

    def templates(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the canonical windows with enough literals."""
        # shorter windows are salted with their size, and windows of words differ from all of them
        h, literals, at = self.hashes(self.codes, size, 0 if size == WINDOW else size)
        at = at[literals[at] >= (LITERALS if size == WINDOW else min(LEAST_LITERALS, size))]
        return h[at], at

    def verbatim(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the windows of words and numbers as they stand."""
        h, _, at = self.hashes(self.words(), size, 1000 + size, verbatim=True)
        return h[at], at

    def slots(self, at: int, size: int) -> list[str]:
        """The typed values in a window, in order."""
        return [f"{self.slot[k]}:{self.values[self.piece[k]]}" for k in range(at, at + size) if self.slot[k]]


def _window_rows(found: Windows, kinds: list[tuple[int, bool]], wanted=None):
    """(hash, text, place, slots) of the windows of those (size, verbatim) that wanted, a test of hashes, lets through."""
    wh, keep, slots = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for size, plain in kinds:
        h, at = found.verbatim(size) if plain else found.templates(size)
        if wanted is not None:
            on = wanted(h)
            h, at = h[on], at[on]
        wh.append(h)
        keep.append(at)
        slots += [[] if plain else found.slots(k, size) for k in at.tolist()]
    at = np.concatenate(keep)
    return np.concatenate(wh).view(np.int64), found.doc[at], (at - found.first[found.doc[at]]).astype(np.int64), slots


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wh, item_id, at, slots, size, verbatim of every window of every item; an item shorter than WINDOW is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Windows(pa.array([text.as_py()], pa.string()))
                size = min(WINDOW, len(found.codes))
                if not size:
                    continue
                rows = []
                for plain in (False, True):
                    wh, _, at, slots = _window_rows(found, [(size, plain)])
                    rows += [(w, a, x, plain) for w, a, x in zip(wh.tolist(), at.tolist(), slots, strict=True)]
                dense = {a for _, a, _, plain in rows if not plain}
                # whole windows with literals need no second hash
                rows = [r for r in rows if not r[3] or size < WINDOW or r[1] not in dense]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([item] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
                columns += [pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([size] * len(rows), pa.int32()), pa.array([r[3] for r in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["wh", "item_id", "at", "slots", "size", "verbatim"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item_id is not null")
    return rows.mapInArrow(run, "wh bigint, item_id bigint, at bigint, slots array<string>, size int, verbatim boolean")


def bitmap_of(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash (column wh), by its highest bits, and how far a hash is shifted to give its bit."""
    n = max(1, hashes.count())
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (256 * n).bit_length()))
    bit = F.shiftrightunsigned("wh", 64 - bits)
    words = hashes.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(wh, {64 - bits}) & 63 as int))")).alias("on"))
    found = words.toArrow()  # at most 2**20 rows
    out = np.zeros(1 << bits - 6, dtype=np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out.view(np.uint8), 64 - bits


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = SHARE
) -> DataFrame:
    """doc_id, text_hash, item_id, windows (of the item), matched and overlap of every document and item that it holds.

    A document holds an item if windows that agree in their slots cover at least `share` of the
    item's, or of those with enough literals, or RUN words of it in a row.  Null texts count as
    empty and hold nothing; a null item id is no item; rows equal in id and text are one document,
    and so are items that repeat an id.  Without documents or items the result is empty.
    """
    work = Scratch(docs.sparkSession, "leaks")
    wanted = work.save(item_windows(items, item_id_col, item_text_col), "items")
    dense = F.countDistinct(F.when(~F.col("verbatim"), F.col("at")))
    sizes = work.save(wanted.groupBy("item_id").agg(F.countDistinct("at").alias("windows"), dense.alias("dense")), "sizes")
    kinds = [(r["size"], r["verbatim"]) for r in wanted.select("size", "verbatim").distinct().orderBy("size", "verbatim").collect()]  # at most 2 * WINDOW
    bitmap, shift = bitmap_of(wanted.select("wh"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # at most 8 MB
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.only()
        on = shared.value

        def known(h: np.ndarray) -> np.ndarray:
            bit = (h >> np.uint64(shift)).astype(np.int64)
            return (on[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            done = 0
            for block in pieces.blocks(batch.column(2)):
                found = Windows(block)
                wh, doc, at, slots = _window_rows(found, kinds, known)
                rows = pa.array(doc)
                ids, hashes = (batch.column(k).slice(done, len(block)).take(rows) for k in (0, 1))
                done += len(block)
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(wh), pa.array(at), pa.array(slots, pa.list_(pa.string()))], names=["id", "text_hash", "wh", "pos", "values"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = work.save(rows.mapInArrow(run, f"id {kind}, text_hash bigint, wh bigint, pos bigint, values array<string>"), "windows")
    # a hash that two items share keeps both; slots that differ in type have another hash
    matched = found.join(wanted, "wh").select(
        "id", "text_hash", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "at", (~F.col("verbatim")).alias("dense"), F.arrays_zip(F.col("slots").alias("i"), F.col("values").alias("d")).alias("pairs")
    )
    lined = matched.groupBy("id", "text_hash", "item_id", "shift").agg(F.collect_set(F.struct("at", "dense", "pairs")).alias("found"))
    pairs = F.array_distinct(F.flatten(F.col("found.pairs")))
    lined = lined.withColumn("pairs", pairs).withColumn("torn", F.expr("filter(array_distinct(pairs.i), v -> size(filter(pairs, p -> p.i = v)) > 1)"))
    agreed = F.expr("filter(found, w -> forall(w.pairs, p -> p.i = p.d) or not arrays_overlap(w.pairs.i, torn))")
    same = lined.withColumn("agreed", agreed).where(F.size("agreed") > 0)
    # (last place, windows in a row up to it, most in a row), over the places in order
    row = """aggregate(array_sort(array_distinct(agreed.at)), (-9L, 0L, 0L), (s, x) -> (x, if(x = s.col1 + 1, s.col2 + 1, 1L), greatest(s.col3, if(x = s.col1 + 1, s.col2 + 1, 1L)))).col3"""
    same = same.select("id", "text_hash", "item_id", "agreed", F.expr(row).alias("row"))
    some = F.array_distinct(F.flatten(F.collect_list(F.col("agreed.at"))))
    literal = F.array_distinct(F.flatten(F.collect_list(F.expr("filter(agreed, w -> w.dense).at"))))
    held = same.groupBy("id", "text_hash", "item_id").agg(F.size(some).alias("matched"), F.size(literal).alias("literal"), F.max("row").alias("row")).join(sizes, "item_id")
    held = held.withColumn("overlap", F.greatest(F.col("matched") / F.col("windows"), F.when(F.col("dense") > 0, F.col("literal") / F.col("dense"))))
    held = held.where((F.col("overlap") >= share) | (F.col("row") >= RUN - WINDOW + 1))
    return held.select(F.col("id").alias(id_col), "text_hash", "item_id", F.col("windows").cast("long").alias("windows"), F.col("matched").cast("long").alias("matched"), "overlap")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever they are called; repeated rows stay or go together."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    id_at, text_at = (plain.columns[names.index(c)] for c in (id_col, text_col))
    bad = contaminated(plain, items, id_at, text_at).select(F.col(id_at).alias("id"), "text_hash").distinct()
    same = plain[id_at].eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(plain[text_at], F.lit(""))) == F.col("text_hash"))
    return plain.join(bad, same, "left_anti").toDF(*names)
