import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import queries as Q
from paperloom.llm.exact_dedup import drop_exact, exact_groups
from paperloom.llm.line_dedup import line_dedup
from paperloom.llm.packing import assign, capacities, pack
from paperloom.llm.simhash import (
    KEY_BITS, SIMILARITY, STAGE_BITS, STAGE_RADIUS, TABLES, close_pairs, components, drop_near, fingerprint, link, pigeonhole_tables, sampled_tables, share_of_pairs,
    shingle_hashes, similar_pairs, simhash_groups,
)
from paperloom.llm.token_store import BadStore, Block, pack_block, write_tokens
from paperloom.llm.tokens import PieceEncoder
from paperloom.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"
ODD_TEXTS = [
    "", " ", "a", "a  b", "foo<|endoftext|>bar x", "<|startoftext|> y", "it's don't I'LL x's", "\x1c a\x1d", "a\nb\n\nc", "É é. x́!", "ǅ İI ß ² x². 12 3½.",
    "a\tb", "a \nb", "x\0y z", "日本 語。 かな", "naïve's, _a_ __b. 5.", "👍🏽 ok👍.", "tail ", "\n", "Σ ΑΣ.", "a\x85b c", "a b\rc", "a\x0bb", "Ġ Ġa.", "a ́b", "x ́.",
]


def documents():
    return dict(zip(*[c.to_pylist() for c in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).columns], strict=True))


@pytest.mark.parametrize(("name", "split"), [(Q.BYTE_BPE, "spaces"), (Q.WORD_BPE, "words")])
def test_pieces_give_the_ids_of_whole_texts(name, split):
    model = PieceEncoder(public_tokenizers.path(name), split)
    texts = ODD_TEXTS + list(documents().values())
    for _ in range(2):
        for a, b in zip(model.encode(pa.array(texts)), model.whole(texts), strict=True):
            assert np.array_equal(a, b)


#: Characters that lower-casing, white space or marks make hard to cut at.
HARD = [*"aBz İIıSſßéÉçÇΣσςЖж語か٣²½ǅ.,!?'\"-_()<|>@#$%^&*`~/:;=+[]{}\\ 0129", *" " * 14, "\n", "\t", "\r", "\x0b", "\u0301", "\u0307", "\xa0", "\u2003", "\u200d", "\x1c", "\0", "\x85",
        "👍", "🏽", "it's", "I'LL", " x", "ing", "The", "İ.", "İ,!"]


@pytest.mark.parametrize(("name", "split"), [(Q.BYTE_BPE, "spaces"), (Q.WORD_BPE, "words")])
def test_any_text_gives_the_ids_of_the_library(name, split):
    rng = np.random.default_rng(17)
    texts = ["".join(HARD[k] for k in rng.integers(0, len(HARD), n)) for n in rng.integers(1, 14, 100_000).tolist()]
    model = PieceEncoder(public_tokenizers.path(name), split)
    assert all(np.array_equal(a, b) for a, b in zip(model.encode(pa.array(texts)), model.whole(texts), strict=True))


def expected_ids(name, split, end):
    model = PieceEncoder(public_tokenizers.path(name), split)
    docs = sorted(documents().items())
    return {d: [*ids.tolist(), end] for (d, _), ids in zip(docs, model.whole([t for _, t in docs]), strict=True)}


def test_token_store_query(spark):
    want, start = {}, 0
    for d, ids in expected_ids(Q.WORD_BPE, "words", 2).items():
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in Q.op1_token_store(spark, SMALL).collect()} == want


def test_token_store_fetch_and_odd_rows(spark, odd, empty, tmp_path):
    vocabulary = public_tokenizers.path(Q.WORD_BPE)
    store = write_tokens(odd, f"file://{tmp_path}/a", vocabulary, "words", 2)
    rows = store.documents(with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert rows[2].ids == [2] and sum(r.n_tokens for r in rows[:-1]) == rows[-1].start
    got = {r.doc_id: r.ids for r in store.fetch([12, 7]).collect()}
    assert got == {r.doc_id: r.ids for r in rows if r.doc_id in (7, 12)}
    assert write_tokens(empty, f"file://{tmp_path}/b", vocabulary, "words", 2).documents().count() == 0


def test_token_store_checks_the_width_and_samples_every_row(spark, odd, tmp_path):
    with pytest.raises(ValueError, match="bytes"):
        write_tokens(odd, f"file://{tmp_path}/w", public_tokenizers.path(Q.WORD_BPE), "words", 2, width=1)
    docs = [(i, f"text number {i} " * 30) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    made = [write_tokens(f, f"file://{tmp_path}/{k}", public_tokenizers.path(Q.WORD_BPE), "words", 2).dictionary for k, f in enumerate((frame, frame.orderBy(F.desc("doc_id")).repartition(5)))]
    assert made[0] == made[1] and len(made[0]) > 100


def test_token_block_knows_its_dictionary():
    import zstandard

    block = pack_block([(3, b"\1\0\2\0"), (None, b"")], 2, b"", zstandard.ZstdCompressor().compress)
    assert Block(block, b"").ids(0).tolist() == [1, 2] and Block(block, b"").doc_ids == [3, None]
    with pytest.raises(BadStore):
        Block(block, b"another dictionary")
    with pytest.raises(BadStore):
        Block(block[:-1], b"")


def check_exact(rows, texts):
    """rows: id, keep_id, group_size, kept of every row; texts: (id, text) of every row."""
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(-1 if i is None else i)
    want = Counter((i, max(groups[t or ""]), len(groups[t or ""])) for i, t in ((-1 if i is None else i, t) for i, t in texts))
    got = Counter((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2]) for r in rows)
    assert got == want
    kept = [(r[0], r[1]) for r in rows if r[3]]
    assert len(kept) == len(groups) and all(a == b for a, b in kept)


def test_exact_groups(spark, odd, empty):
    check_exact(exact_groups(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert exact_groups(empty).count() == 0 and drop_exact(empty).columns == empty.columns
    kept = drop_exact(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.text or "" for r in odd.collect()})


def test_exact_groups_with_a_hot_text(spark):
    rows = [(i, "hot " * 400 if i % 3 else f"{'p' * (i % 700)}{i}") for i in range(900)]
    check_exact(exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect(), rows)


def brute_lines(texts, least, shortest=1):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [[(x, x.strip(" \t\n\x0b\x0c\r").translate(upper)) for x in (t or "").split("\n")] for _, t in texts]
    n = Counter(k for _, k in {(i, k) for (i, _), ls in zip(texts, cut, strict=True) for _, k in ls if len(k) >= shortest})
    return Counter((i, len(ls), sum(n[k] >= least for _, k in ls), "\n".join(x for x, k in ls if n[k] < least)) for (i, _), ls in zip(texts, cut, strict=True))


def test_line_dedup(spark, odd, empty):
    texts = [(i, t) for i, t in documents().items()]
    got = line_dedup(spark.createDataFrame(texts, "doc_id bigint, text string"), min_docs=3)
    assert Counter(map(tuple, got.collect())) == brute_lines(texts, 3)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, line_dedup(odd, min_docs=2).collect())) == brute_lines(texts, 2)
    assert line_dedup(empty).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "said often\nonce")] * 10 + [(i, f"own {i}\nshared") for i in range(2, 12)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=10)
    assert Counter(map(tuple, got.collect())) == brute_lines(rows, 10)


def test_assign_fills_sequences_exactly():
    rng = np.random.default_rng(1)
    for lengths in ([], [1], [1024], [2048, 1], [5000, 3, 3, 3], rng.integers(1, 3000, 400).tolist()):
        pieces = assign(lengths)
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for doc, start, n, sequence, offset in pieces:
            by_doc[doc].append((start, n))
            by_sequence[sequence].append((offset, n))
        assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {i: n for i, n in enumerate(lengths) if n}
        for parts in [*by_doc.values(), *by_sequence.values()]:
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
        sizes = [sum(n for _, n in p) for p in by_sequence.values()]
        assert all(s <= 1024 and s & (s - 1) == 0 for s in sizes)


def test_a_piece_is_cut_only_where_no_sequence_has_room():
    rng = np.random.default_rng(6)
    for lengths in (rng.integers(1, 1024, 600).tolist(), rng.integers(600, 900, 300).tolist(), [700] * 50 + [1] * 400):
        # the same dealing by a search through all sequences
        room = capacities(sum(lengths), 1024)
        free, cost, rest, want = list(room), [0.0] * len(room), sorted(((-n, d, 0) for d, n in enumerate(lengths) if n), reverse=True), []
        while rest:
            n, doc, start = rest.pop()
            fit = [i for i in range(len(room)) if free[i] >= -n] or [i for i in range(len(room)) if free[i]]
            i = min(fit, key=lambda i: (cost[i], i))
            put = min(-n, free[i])
            want.append((doc, start, put, i, room[i] - free[i]))
            free[i] -= put
            cost[i] += put + put * put / 1024
            if put < -n:
                rest.append((n + put, doc, start + put))
                rest.sort(reverse=True)
        assert assign(lengths) == want


def test_packing_balances_cost():
    rng = np.random.default_rng(2)
    cost = Counter()
    for _, _, n, sequence, _ in assign(rng.integers(1, 900, 2000).tolist()):
        cost[sequence] += n * n
    full = np.array(list(cost.values())[:-10])
    assert full.std() < 0.8 * full.mean()


def test_packing_query(spark, odd, empty):
    want = expected_ids(Q.BYTE_BPE, "spaces", 0)
    rows = Q.op3_packing(spark, SMALL).collect()
    seen = defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == {d: len(x) for d, x in want.items()}
    vocabulary = public_tokenizers.path(Q.BYTE_BPE)
    assert {r.doc_tokens for r in pack(odd, vocabulary, "spaces", 0).where("doc_id in (1, 2)").collect()} == {1}
    assert pack(empty, vocabulary, "spaces", 0).count() == 0


def brute_fingerprint(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """fps: (id, int) pairs; the smallest id reachable from each."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return Counter((d, f, least.get(find(f))) for d, f in fps)


def test_simhash_query(spark, odd, empty):
    fps = [(d, brute_fingerprint(t, 3)) for d, t in documents().items()]
    got = Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in Q.op4_simhash(spark, SMALL).collect())
    assert got == brute_components(fps, 2)
    fps = [(r.doc_id, brute_fingerprint(r.text, 3)) for r in odd.collect()]
    got = Counter((r.doc_id, int(r.fp.hex(), 16), r.component_id) for r in simhash_groups(odd, words=3, radius=2).collect())
    assert got == brute_components(fps, 2)
    assert simhash_groups(empty, words=3).count() == 0


def test_fingerprints_of_many_shingles():
    text = " ".join(f"w{i * 7919 % 1300}" for i in range(1500))
    assert int(fingerprint(text, 3).hex(), 16) == brute_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (40, 64), dtype=np.uint8)
    on = np.repeat(base, 5, axis=0) ^ (rng.random((200, 64)) < 0.03).astype(np.uint8)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if (on[i] != on[j]).sum() <= radius}
    assert set(zip(*[x.tolist() for x in close_pairs(on, radius)], strict=True)) == want


@pytest.mark.parametrize("chunk", [16, 100, 2048])
def test_chunks_and_deeper_keys_lose_no_link(spark, chunk):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2, 64, dtype=np.uint8)
    on = centre ^ (rng.random((300, 64)) < 0.03).astype(np.uint8)
    values = sorted({np.packbits(x).tobytes() for x in on})
    work = Scratch(spark, "test")
    frame = spark.createDataFrame([(bytearray(v),) for v in values], "fp binary")
    fps = [(i, int(v.hex(), 16)) for i, v in enumerate(values)]
    want = Counter(c for _, _, c in brute_components(fps, 2))
    for complete in (False, True):
        edges = link(frame, 64, 2, pigeonhole_tables(list(range(64)), 2), work, chunk=chunk, complete=complete)
        got = {bytes(r.node): bytes(r.root) for r in components(edges, work).collect()}
        assert Counter(Counter(got.get(v, v) for v in values).values()) == Counter(want.values())


def test_close_pairs_of_ranges():
    rng = np.random.default_rng(5)
    on = rng.integers(0, 2, (3, 64), dtype=np.uint8)[rng.integers(0, 3, 300)] ^ (rng.random((300, 64)) < 0.03).astype(np.uint8)
    begin, end = rng.integers(0, 300, 300), rng.integers(0, 301, 300)
    want = {(i, j) for i in range(300) for j in range(max(i + 1, begin[i]), end[i]) if (on[i] != on[j]).sum() <= 3}
    assert set(zip(*[x.tolist() for x in close_pairs(on, 3, begin, end)], strict=True)) == want


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_near(rows, least=SIMILARITY):
    """The ids that stay of (id, text) rows, and the pairs that link."""
    sets = [set(shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for h in holds.values() for k, a in enumerate(h) for b in h[k + 1 :]} | {(a, b) for a in range(len(rows)) for b in range(a) if not sets[a] and not sets[b]}
    pairs = {(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= least}
    for a, b in pairs:
        root[find(a)] = find(b)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id[find(k)] = min(i, least_id.get(find(k), i))
    return sorted(least_id.values()), pairs


def edited(rng, words, share):
    return " ".join(f"x{rng.integers(1 << 30)}" if rng.random() < share else w for w in words)


def test_near_stage_is_brute_force(spark, odd, empty):
    rng = np.random.default_rng(8)
    rows = [(i, t) for i, t in documents().items()]
    for _ in range(60):
        words = [f"w{k}" for k in rng.integers(0, 3000, rng.integers(60, 500))]
        rows += [(len(rows) + 10_000, edited(rng, words, share)) for share in (0, 0.005, 0.01, 0.02, 0.03, 0.05)]
    rows += [(9_000_000, None), (9_000_001, "  "), (9_000_002, "a b"), (9_000_003, "A B")]
    want, pairs = brute_near(rows)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, c1 int, rid string")
    got = drop_near(frame)
    assert got.columns == frame.columns
    got = sorted(r.doc_id for r in got.collect())
    # precision is exact: what stays beyond the brute force is a link that no key found
    assert set(got) >= set(want) and len(got) - len(want) <= 0.03 * len(pairs) and len(pairs) > 100
    assert drop_near(empty).columns == empty.columns and drop_near(empty).count() == 0
    texts = {frozenset(shingle_hashes(r.text or "", 5).tolist()) for r in odd.collect()}
    assert drop_near(odd).count() == len(texts)


def test_units_of_the_near_stage_lose_no_link(spark, monkeypatch):
    from paperloom.llm import simhash

    monkeypatch.setattr(simhash, "SETS", 7)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 900, 400)]
    rows = [(i, edited(rng, words, 0.004 * (i % 4))) for i in range(80)] + [(i, f"other {i} " * 9) for i in range(100, 120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_near(frame).collect()) == brute_near(rows)[0]


def test_candidates_of_the_near_stage():
    share = lambda s: share_of_pairs(s, STAGE_BITS, KEY_BITS, TABLES, STAGE_RADIUS)
    assert 0.978 < share(0.8) < share(0.85) < share(0.9) and share(0.9) > 0.999
    assert len(sampled_tables(256, 14, 50)) == 50
    assert similar_pairs([fingerprint("a b c", 5, 256)] * 2, ["a b c", "A B C"], 0, 5, 0.8) == [(0, 1)]


def test_text_sha(spark):
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in documents().items()}
    assert {r.doc_id: r.text_sha256 for r in Q.op2_exact_dedup(spark, SMALL).collect()} == want
