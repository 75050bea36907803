"""SimHash near-duplicates: exact linking within a radius, by bit-sliced comparison.

Distinct fingerprints are keyed by selected bits into tables and compared only within a key.  For a
small radius the tables are complete by the pigeonhole principle: of equal blocks at most `radius`
can differ, so some choice of the others agrees.  For a large radius they are chosen bits, as many
tables as the wanted recall asks for.  A comparison stores bit planes vertically, adds many
differences at once into carry-save counters, and abandons the words in which every distance is
beyond the radius.  Comparisons give a star per local component, never all pairs; components are
found by pointer jumping and contraction of the edges.  Keys with many fingerprints are keyed anew by
their remaining bits or cut into chunks, and every pair of chunks is a unit of its own.  The stage
of the pipeline takes such components as candidates and links by exact Jaccard similarity.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch
from paperloom.llm.pieces import only, release

#: A-Z to a-z; other bytes stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints of a key that are compared as one unit, and rows of small keys that are compared at a time.
CHUNK, TOGETHER = 2048, 1 << 14
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` lower-cased words; of all words if there are fewer; none without words."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    end = np.cumsum(size) - 1
    begin = (end + 1 - size)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(begin, end[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def _counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of 64 bits, the lowest first: byte lanes of up to 255 sums."""
    n = -len(h) % 255
    padded = np.concatenate([h, np.zeros(n, dtype=np.uint64)]).reshape(-1, 255) if len(h) > 255 else h.reshape(1, -1)
    out = np.empty((8, 8), dtype=np.int64)
    for s in range(8):
        lanes = ((padded >> np.uint64(s)) & _LANES).sum(axis=1, dtype=np.uint64)
        out[:, s] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(text: str, words: int, bits: int = 64, distinct: bool = False) -> bytes:
    """bits / 64 words, big-endian.  A bit is set if over half of the shingles' hashes set it; zero without words."""
    h = shingle_hashes(text, words)
    return fold(np.unique(h) if distinct else h, bits)


def fold(h: np.ndarray, bits: int) -> bytes:
    """The fingerprint of shingle hashes."""
    out = []
    for k in range(bits // 64):
        if k:  # further hashes of a shingle, by a mixing step on its first
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            h = h ^ (h >> np.uint64(29))
        on = _counts(h) * 2 > len(h) if len(h) else np.zeros(64, dtype=bool)
        out.append(np.packbits(on[::-1]).tobytes())
    return b"".join(out)


def pigeonhole_tables(positions: list[int], radius: int) -> list[list[int]]:
    """Keys among bit positions of which two that differ in at most radius of them share one: twice as many blocks as
    may differ (two at least), and every choice of the blocks that then must agree."""
    blocks = max(2, 2 * radius)
    cut = [x.tolist() for x in np.array_split(np.array(positions), blocks)]
    return [sum(x, []) for x in itertools.combinations(cut, blocks - radius)]


def share_of_pairs(similarity: float, bits: int, key_bits: int, tables: int, radius: int) -> float:
    """The share of pairs of exactly that Jaccard similarity that lie within the radius and share one of the sampled keys."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = 0.0
    for d in range(radius + 1):
        one = math.comb(bits - d, key_bits) / math.comb(bits, key_bits)
        total += math.comb(bits, d) * p**d * (1 - p) ** (bits - d) * (1 - (1 - one) ** tables)
    return total


def sampled_tables(bits: int, key_bits: int, n: int) -> list[list[int]]:
    """Keys of chosen bits."""
    rng = np.random.default_rng(20_240_501)
    return [sorted(rng.choice(bits, size=key_bits, replace=False).tolist()) for _ in range(n)]


_BELOW = np.array([(1 << n) - 1 for n in range(65)], dtype=np.uint64)


def close_pairs(bits: np.ndarray, radius: int, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of a 0/1 matrix that differ in at most radius columns.

    begin, end: the rows that a row is compared with, all later ones by default.
    """
    m, nb = bits.shape
    words = (m + 63) // 64
    columns = np.ascontiguousarray(bits.T)
    planes = np.zeros((nb, words * 8), dtype=np.uint8)
    packed = np.packbits(columns, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    rows = np.arange(m)
    begin = rows + 1 if begin is None else np.maximum(begin, rows + 1)
    end = np.full(m, m) if end is None else end
    n = np.where(begin < end, (end - 1) // 64 - begin // 64 + 1, 0)
    q = np.repeat(rows, n)
    w = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + (begin // 64)[q]
    # a lane that is no partner is beyond the radius from the start
    over = ~(_BELOW[np.clip(end[q] - 64 * w, 0, 64)] & ~_BELOW[np.clip(begin[q] - 64 * w, 0, 64)])
    k = radius.bit_length()
    first = (1 << k) - 1 - radius  # so that a distance beyond the radius carries out of the k counters
    counters = [np.full(len(q), _ONES if first >> b & 1 else 0, dtype=np.uint64) for b in range(k)]
    for b in range(nb):
        x = planes[b][w] ^ np.negative(columns[b].astype(np.uint64))[q]
        for c in counters:
            carry = c & x
            c ^= x
            x = carry
        over |= x
        if b % 8 == 7 and b >= radius:
            alive = over != _ONES
            if alive.sum() < 0.75 * len(alive):
                q, w, over = q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
    hit = ~over
    some = np.flatnonzero(hit)
    lane = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(lane)
    return q[some][at], w[some][at] * 64 + bit


def local_roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of m rows."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _planes(fp: list[bytes], bits: int) -> np.ndarray:
    """A 0/1 matrix of the first bits of fingerprints of equal length."""
    return np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1)[:, : bits // 8], axis=1)


def _keys(batches: Iterator[pa.RecordBatch], bits: int, tables: list[list[int]], deeper: list[list[list[int]]] | None = None) -> Iterator[pa.RecordBatch]:
    """t, key, fp of each fingerprint in every table; deeper: of (t, key, fp) in the tables below its own."""
    for batch in batches:
        fp = batch.column(batch.num_columns - 1)
        if not len(fp):
            continue
        on = _planes(fp.to_pylist(), bits).astype(np.int64)
        if deeper is None:
            for t, positions in enumerate(tables):
                key = on[:, positions] @ (1 << np.arange(len(positions), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), fp], names=["t", "key", "fp"])
            continue
        own, above = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        number = len(tables)
        for t, below in enumerate(deeper):
            at = np.flatnonzero(own == t)
            for positions in below:
                if len(at):
                    key = on[at][:, positions] @ (1 << np.arange(len(positions), dtype=np.int64))
                    key = (above[at] << len(positions)) | key
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(key), fp.take(pa.array(at))], names=["t", "key", "fp"])
                number += 1


def _compare(batches: Iterator[pa.RecordBatch], bits: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Stars of local components from rows t, key, u, v, c, fp in order; many units are compared at a time, each within itself."""
    held: list[pa.RecordBatch] = []

    def close(rows: pa.Table):
        unit = np.stack([rows.column(k).to_numpy() for k in range(4)])
        starts = np.flatnonzero(np.concatenate([[True], (unit[:, 1:] != unit[:, :-1]).any(axis=0)]))
        ends = np.concatenate([starts[1:], [rows.num_rows]])
        of = np.repeat(np.arange(len(starts)), ends - starts)
        begin, end = np.arange(rows.num_rows) + 1, ends[of]
        # of two chunks, the first one's rows meet the second one's alone
        right = unit[3] == rows.column(4).to_numpy()
        cross = unit[2] != unit[3]
        n_left = np.add.reduceat((~right).astype(np.int64), starts)
        begin = np.where(cross, (starts + n_left)[of], begin)
        end = np.where(cross & right, 0, end)
        fp = rows.column(5).to_pylist()
        i, j = close_pairs(_planes(fp, bits), radius, begin, end)
        root = local_roots(len(fp), i, j)
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array([fp[x] for x in at], pa.binary()), pa.array([fp[x] for x in root[at]], pa.binary())], names=["a", "b"])

    def cut(rows: pa.Table) -> int:
        """Where the last unit begins."""
        last = np.stack([rows.column(k).to_numpy() for k in range(4)])
        other = np.flatnonzero((last != last[:, -1:]).any(axis=0))
        return int(other[-1]) + 1 if len(other) else 0

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            rows = pa.Table.from_batches(held)
            at = cut(rows)
            if at:
                yield close(rows.slice(0, at))
            held = rows.slice(at).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield close(pa.Table.from_batches(held))


def link(fps: DataFrame, bits: int, radius: int, tables: list[list[int]], work: Scratch, chunk: int = CHUNK, complete: bool = False) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): stars whose components are those of all pairs that lie
    within the radius and share a key.  Bytes of fp beyond `bits` are not compared.

    Keys of more than `chunk` fingerprints are cut into chunks, and every pair of chunks is a unit.
    complete: the tables miss no pair; then keys of that size are first keyed anew by the bits that
    they leave, which misses none either.
    """
    keyed = fps.select("fp").mapInArrow(lambda b: _keys(b, bits, tables), "t int, key bigint, fp binary")
    hot = lambda rows, name: work.save(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), name)
    rows = keyed.join(hot(keyed, "hot"), ["t", "key"], "left")
    if complete:
        deeper = [pigeonhole_tables(sorted(set(range(bits)) - set(own)), radius) for own in tables]
        below = rows.where("n is not null").select("t", "key", "fp").mapInArrow(lambda b: _keys(b, bits, tables, deeper), "t int, key bigint, fp binary")
        below = work.save(below, "below")
        rows = rows.where("n is null").unionByName(below.join(hot(below, "still-hot"), ["t", "key"], "left"))
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int")
    units = rows.withColumn("c", F.pmod(F.xxhash64("fp"), chunks.cast("long")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    units = units.select("t", "key", F.least("c", "j").alias("u"), F.greatest("c", "j").alias("v"), "c", "fp")
    parts = units.repartition("t", "key", "u", "v").sortWithinPartitions("t", "key", "u", "v", "c", "fp")
    return work.save(parts.mapInArrow(lambda b: _compare(b, bits, radius), "a binary, b binary").distinct(), "edges")


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node of its component.

    Each round points every node at its smallest neighbour, jumps to the end of these pointers, and
    contracts the edges to those between the nodes that are left, so dense groups shrink at once.
    """

    def jump(to: DataFrame) -> DataFrame:
        """Follows the pointers (node, root) until they end; a root points at itself."""
        while True:
            top = to.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = work.save(to.join(top, "root").select("node", F.col("root").alias("was"), F.col("top").alias("root")), "jumped")
            work.drop(to)
            if jumped.where("was <> root").isEmpty():
                return jumped.select("node", "root")
            to = work.save(jumped.select("node", "root"), "pointers")
            work.drop(jumped)

    left = work.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "left")
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "near")
        roots = jump(work.save(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("root")), "low"))
        one = left.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").where("ra <> rb")
        after = work.save(one.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "left")
        work.drop(left)
        left = after
        if found is None:
            found = roots
        else:  # roots of this round's nodes replace what pointed at them
            found = work.save(found.join(roots.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "found")
    return found if found is not None else work.save(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), "none")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 64, radius: int = 2) -> DataFrame:
    """Per row of docs: id, text_hash, fp (binary), component_id and first (whether the row leads its component).

    A null text counts as empty; a text without words has the fingerprint zero and links as any
    other.  component_id is the smallest id of the component (null ids count only if it has no
    other), and the leading row is the one with the smallest id, then text hash; rows that repeat
    both lead together.  An empty table gives an empty result.  No pair within the radius is missed.
    """
    work = Scratch(docs.sparkSession, "simhash")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            fp = [fingerprint(t.as_py(), words, bits) for t in batch.column(2)]
            release()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.binary())], names=["id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = work.save(rows.mapInArrow(scan, f"id {kind}, text_hash bigint, fp binary"), "fingerprints")
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    fps = work.save(rows.groupBy("fp").agg(lead.alias("lead")), "distinct")
    roots = components(link(fps, bits, radius, pigeonhole_tables(list(range(bits)), radius), work, complete=True), work)
    rooted = work.save(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")), "rooted")
    leads = work.save(rooted.groupBy("root").agg(F.min("lead").alias("lead")), "leads")
    whole = work.save(rooted.select("fp", "root").join(leads, "root").select("fp", "lead"), "whole")
    joined = rows.join(whole, "fp")
    first = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    return joined.select(F.col("id").alias(id_col), "text_hash", "fp", F.col("lead.id").alias("component_id"), first.alias("first"))


#: The stage on five-word shingles: the similarity that links, bits, bits of a key, tables and the radius of candidates.
#: By share_of_pairs 98 % of the pairs of exactly that similarity become candidates, and more of closer ones.
SIMILARITY, STAGE_BITS, KEY_BITS, TABLES, STAGE_RADIUS = 0.8, 256, 14, 50, 58
#: Distinct sets and bytes of text that one unit of the exact comparison holds of either side, about.
SETS, SET_BYTES = 1024, 16 << 20


def similar_pairs(fp: list[bytes], texts: list[str], left: int, words: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows, linking what is linked by sets of shingles of that Jaccard similarity among pairs within the radius.

    left: rows of the first side, which are compared with the others alone; 0 compares all rows.  A
    pair that is linked through others already is not computed.
    """
    m = len(fp)
    rows = np.arange(m)
    begin, end = (np.maximum(rows + 1, left), np.where(rows < left, m, 0)) if left else (None, None)
    i, j = close_pairs(_planes(fp, STAGE_BITS), STAGE_RADIUS, begin, end)
    sets: dict[int, np.ndarray] = {}
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(x), find(y)
        if a == b:
            continue
        for k in (x, y):
            if k not in sets:
                sets[k] = np.unique(shingle_hashes(texts[k], words))
        n, o = len(sets[x]), len(sets[y])
        if min(n, o) < similarity * max(n, o):
            continue
        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if shared and shared / (n + o - shared) >= similarity:
            parent[max(a, b)] = min(a, b)
            found.append((x, y))
    return found


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs of each group of near copies, with all its columns, whatever they are called.

    Rows link if their sets of shingles have a Jaccard similarity of at least `similarity`; of a
    group the row with the smallest id stays (a null id counts last), and of rows that repeat it any
    one.  A null text counts as empty; texts without words are one group; an empty table gives an
    empty result.  Fingerprints of sets find candidates: pairs within STAGE_RADIUS that share a key.
    Their components are cut into units of bounded size that hold the texts, and every candidate of
    a unit is checked exactly unless it is linked already, so a group of n near copies costs about
    n checks; a component beyond a unit meets itself chunk by chunk.  Keys, tables and radius are
    the same at every size.
    """
    work = Scratch(docs.sparkSession, "near")
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    id_at, text_at = (plain.columns[names.index(c)] for c in (id_col, text_col))
    text = F.coalesce(F.col(text_at), F.lit(""))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            fp = []
            for t in batch.column(2):
                own = np.unique(shingle_hashes(t.as_py(), words))
                fp.append(fold(own, STAGE_BITS) + xxhash.xxh64_digest(own.tobytes()))  # equal sets are one node
            release()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.binary())], names=["id", "h", "fp"])

    kind = plain.schema[id_at].dataType.simpleString()
    rows = work.save(plain.select(F.col(id_at).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(scan, f"id {kind}, h bigint, fp binary"), "rows")
    nodes = work.save(rows.groupBy("fp").agg(F.count("*").alias("n")), "nodes")
    roots = components(link(nodes, STAGE_BITS, STAGE_RADIUS, sampled_tables(STAGE_BITS, KEY_BITS, TABLES), work), work)
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or root is not null")
    tagged = rows.join(member.select("fp", F.coalesce("root", "fp").alias("root")), "fp").select("id", "h", "fp", "root").distinct()
    marked = plain.withColumns({"h": F.xxhash64(text), "rid": F.monotonically_increasing_id()}).alias("p")
    same = F.col(f"p.{id_at}").eqNullSafe(F.col("t.id")) & (F.col("p.h") == F.col("t.h"))
    marked = work.save(marked.join(work.save(tagged, "tagged").alias("t"), same, "left").select("p.*", "fp", "root").drop("h"), "marked")
    inside = marked.where("root is not null")
    order = F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), "rid")
    heads = work.save(inside.groupBy("root", "fp").agg(F.min(order).alias("lead"), F.min_by(text, order).alias("text")), "heads")
    sizes = heads.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where("n > 1")
    chunks = F.greatest(F.ceil(F.col("n") / SETS), F.ceil(F.col("bytes") / SET_BYTES)).cast("int")
    units = heads.join(sizes.select("root", chunks.alias("chunks")), "root").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int"))
    units = units.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = units.select("root", F.least("c", "j").alias("u"), F.greatest("c", "j").alias("v"), "c", "fp", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fp, texts, left = None, [], [], 0

        def close():
            found = similar_pairs(fp, texts, left, words, similarity) if len(fp) > 1 and not (unit[1] != unit[2] and left in (0, len(fp))) else []
            return pa.RecordBatch.from_arrays([pa.array([fp[x] for x, _ in found], pa.binary()), pa.array([fp[y] for _, y in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for k, now in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if now[:3] != unit:
                    if unit is not None:
                        yield close()
                    unit, fp, texts, left = now[:3], [], [], 0
                fp.append(batch.column(4)[k].as_py())
                texts.append(batch.column(5)[k].as_py())
                left += now[1] != now[2] and now[3] == now[1]
        if unit is not None:
            yield close()

    parts = units.repartition("root", "u", "v").sortWithinPartitions("root", "u", "v", "c", "fp")
    good = components(work.save(parts.mapInArrow(check, "a binary, b binary").distinct(), "similar"), work)
    rooted = heads.join(good.withColumnRenamed("node", "fp").withColumnRenamed("root", "top"), "fp", "left")
    leads = rooted.groupBy(F.coalesce("top", "fp").alias("top")).agg(F.min("lead").alias("lead")).select(F.col("lead.rid").alias("rid"))
    kept = inside.join(work.save(leads, "leads"), "rid").select(*plain.columns)
    return marked.where("root is null").select(*plain.columns).unionByName(kept).toDF(*names)
