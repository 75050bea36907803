import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from paperloom.llm import queries as Q
from paperloom.llm.common import Scratch
from paperloom.llm.decontaminate import clean, contaminated, describe
from paperloom.llm.extract_html import extract, main_text
from paperloom.llm.quality import DIMENSIONS, Model, keep_good, piece_buckets, pool, score, train
from paperloom.llm.simhash import drop_near, shingle_hashes
from paperloom.llm.url_filter import RULES, judge, spread
from paperloom.llm.warc import BadArchive, jumps, read_warc, write_warc

SMALL = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string"
BIG = "<p>" + "payload " * 40 + "</p>"
MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a.example.org/x", BIG), (2, "http://b.example.com/de/", BIG), (None, None, BIG), (3, None, None), (4, "no scheme", ""), (5, "http://A.net", "<p>short"),
    (6, "x://Host.ORG?q", MAGIC + BIG), (7, "http://h.org/fr/\r\nX: y", "é" * 60), (8, "http://h.org/fr/", "é" * 60), (9, "http://example.net/en/a#b", MAGIC),
]


def rows_of(table, *columns):
    return list(zip(*[pq.read_table(f"{SMALL}/{table}.parquet")[c].to_pylist() for c in columns], strict=True))


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "x") for r in PAGES], PAGE + ", id int, digest string")
    path = f"file://{tmp_path}/warc"
    write_warc(pages, path, Scratch(spark, "t"))
    got = {r.page_id: r for r in read_warc(spark, path, with_payload=True).collect()}
    assert len(got) == len(PAGES)
    for i, url, html in PAGES:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha256(body).hexdigest()
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == body
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {None: ("revisit", 1), 2: ("revisit", 1), 8: ("revisit", 7)}
    write_warc(spark.createDataFrame([], PAGE), f"{path}-empty", Scratch(spark, "t"))
    assert read_warc(spark, f"{path}-empty").count() == 0


def brute_records(data):
    """The blocks of the records that follow each other from the start of a file."""
    out = []
    while data:
        head = data.index(b"\r\n\r\n") + 4
        n = int(re.search(rb"Content-Length: (\d+)", data[:head])[1])
        out.append(data[head : head + n])
        assert data.startswith(b"WARC/1.") and data[head + n : head + n + 4] == b"\r\n\r\n"
        data = data[head + n + 4 :]
    return out


def record(body, more=b""):
    return b"WARC/1.1\r\nWARC-Type: resource\r\n%sContent-Length: %d\r\n\r\n" % (more, len(body)) + body + b"\r\n\r\n"


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_chains_of_ranges_reject_magic_in_payloads(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    inner = record(b"abc")
    bodies = [b"x", inner + inner, b"", b"WARC/1.1\r\n", b"WARC/1.", inner * 9, b"\r\n", b"\r\n\r\n", b"\n" * 7, b"y" * 900, b"\xff\xfe", inner[:-3]]
    files = [b"".join(record(bodies[k], b"X: http://WARC/1.1\r\n" if split > 300 and k % 5 == 1 else b"") for k in rng.integers(0, len(bodies), n)) for n in ((1, 40, 5, 0) if split > 64 else (1, 4, 0))]
    for k, data in enumerate(files):
        (tmp_path / f"{k}.warc").write_bytes(data)
    zipped = b"".join(gzip.compress(record(b)) for b in bodies)
    (tmp_path / "z.warc.gz").write_bytes(zipped)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = Counter(bytes(r.payload) for r in read_warc(spark, f"file://{tmp_path}", with_payload=True).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == Counter(x for data in [*files, gzip.decompress(zipped)] for x in brute_records(data))


def test_broken_archives(spark, tmp_path):
    good = record(b"x") + record(b"y" * 50)
    digest = b"WARC-Payload-Digest: sha256:%s\r\n" % (b"0" * 64)
    for k, broken in enumerate((good[:-1], b"x" + good, good[: len(record(b"x")) + 5], b"junk", good + b"tail", record(b"abc", digest))):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a.warc").write_bytes(broken)
        with pytest.raises(BadArchive):
            read_warc(spark, f"file://{tmp_path}/{k}")


def test_jumps():
    # 0 -> 10 -> 30 -> leaves; 20 -> 30; 25 breaks off
    assert [x[0] for x in jumps([0, 10, 20, 25, 30], [10, 30, 30, 27, 50], 40)] == [50, 50, 50, -1, 50]
    got = jumps([0, 10, 20, 25, 30], [10, 30, 30, 27, 50], 40)
    on = lambda c, e: got[c][1] <= got[e][1] <= got[c][2]
    assert [[c for c in range(5) if on(c, e)] for e in range(5)] == [[0, 1, 4], [1, 4], [2, 4], [3], [4]]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    for pages, frame in ((PAGES, spark.createDataFrame([(*r, "x") for r in PAGES], PAGE + ", host string")), (rows_of("pages", "page_id", "url", "html"), None)):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in (judge(frame) if frame is not None else Q.op6_url_filter(spark, SMALL)).collect()}
        assert len(got) == len(pages)
        for i, url, _ in pages:
            host, path, rule, verdict = brute_url(url)
            assert got[i][:3] == (host, path, rule) and got[i][3] == (verdict or "allow")
    assert judge(spark.createDataFrame([], PAGE)).count() == 0


def test_links_spread_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [
        (1, "http://bad.net/a", link("farm.com")), (2, "http://farm.com/a", link("bad.net", "farm.com")), (3, "http://good.org/fr/a", link("friend.com", "FRIEND.com")),
        (4, "http://friend.com/a", None), (5, "http://far.com/", link("farm.com")),
    ]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(pages, PAGE), tolerance=0.01).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def pagerank(names, edges, seeds):
    """Solved exactly: hosts without a link give what they hold back to the seeds."""
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), w in edges.items():
        m[at[b], at[a]] += w
    start = np.array([n in seeds for n in names], dtype=float)
    start /= max(1.0, start.sum())
    out = m.sum(axis=0)
    m = m / np.where(out > 0, out, 1) + np.outer(start, out == 0)
    return np.linalg.solve(np.eye(len(names)) - 0.85 * m, 0.15 * start)


def test_verdicts_of_a_link_graph_are_brute_force(spark):
    rng = np.random.default_rng(0)
    hosts = [f"h{i}.{('com', 'net', 'org')[0 if i % 10 else 1 + i // 10 % 2]}" for i in range(2000)]
    pages, edges = [], Counter()
    for i in range(6000):
        src = hosts[i % 2000]
        to = [hosts[k] for k in {int(x) for x in (rng.pareto(1.0, rng.integers(0, 4)) * 40 % 2000)}]
        path = "/fr/x" if src.endswith("org") and i % 3 else "/x"
        pages.append((i, f"http://{src}{path}", "".join(f"<a href='https://{h}/y'>" for h in to)))
        edges.update((src, h) for h in to if h != src)
    speaks = Counter((brute_url(u)[0], brute_url(u)[3]) for _, u, _ in pages)
    good = {h for h in hosts if 2 * speaks[h, "allow"] >= 3}
    bad = {h for h in hosts if h not in good and 2 * speaks[h, "block"] >= 3}
    trust = pagerank(hosts, edges, good)
    distrust = pagerank(hosts, {(b, a): w for (a, b), w in edges.items()}, bad)
    share = {h: d / (t + d) if t + d else 0.0 for h, t, d in zip(hosts, trust, distrust, strict=True)}
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(pages, PAGE), tolerance=1e-4).collect()}
    assert len(good) > 50 and len(bad) > 50 and 200 < sum(s > 0.5 for s in share.values()) < 1800
    for i, u, _ in pages:
        host, _, rule, verdict = brute_url(u)
        if rule or abs(share[host] - 0.5) > 0.02:
            assert got[i] == (verdict or ("block" if share[host] > 0.5 else "allow")), (u, share[host])


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><a>Menu</a></nav>
    <!-- <p>no</p> --><div class="cookie-notice">We use</div><main><article><header><h1>Head &amp; <b>bo</b>ld</h1></header><p>One
    two&nbsp;three<br>four<p>Five <script>var t="</p>";</script>six</p><ul><li>a<li>b</ul><div class="ad">Buy</div><form>Search</form><div id="comments"><p>Nice!</p></div>
    <table><tr><td>x<td>y</table><p hidden>gone</p></article></main><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "\n\n".join(["Head & bold", "One two three four", "Five six", "a", "b", "x", "y"])
    assert main_text("") == "" and main_text("plain a<b text") == "plain a<b text"
    assert main_text("<div>a</div><div class='menu'>b</div><p>c") == "a\n\nc"


def test_names_speak_only_of_boxes_and_whole():
    page = lambda body: main_text(f"<body class='has-sidebar'>{body}</body>")
    for kept in ("<div class='share-price'>Stock up 3%</div>", "<p class='notice'>Stock up 3%</p>", "<blockquote class='banner'>Stock up 3%</blockquote>", "<div id='related-work'>Stock up 3%</div>"):
        assert page(kept) == "Stock up 3%"
    for gone in ("<div class='cookie-notice'>x</div>", "<div id='site-footer'>x</div>", "<ul class='share-buttons'><li>x</ul>", "<div role='search'>x</div>", "<div style='display: none'>x</div>"):
        assert page(gone) == ""
    assert page("<div class='search'><article>found</article></div><div>not</div>") == "found"


def brute_article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    import html

    cut = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in cut) if x)


def test_extract_query(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in Q.op8_extract_html(spark, SMALL).collect()}
    want = {i: brute_article(h) for i, h in rows_of("pages", "page_id", "html")}
    assert got == {i: (t, len(t)) for i, t in want.items()}


WORDS = "alder birch cedar elm fir hazel larch maple oak pine rowan willow yew ash beech lime".split()


def template_page(rng, k):
    """A page without any telling name, and its article: menu, teaser and small print lie in plain boxes as the article does."""
    say = lambda n: " ".join(rng.choice(WORDS, n)).capitalize()
    article = [say(4), *[say(int(n)) for n in rng.integers(15, 60, rng.integers(1, 6))]]
    inner = f"<h2>{article[0]}</h2>" + "".join(f"<p>{x}</p>" for x in article[1:])
    menu = "".join(f"<div><a href='/{w}'>{w}</a></div>" for w in rng.choice(WORDS, 5))
    page = (
        f"<body><div class='k1'>Welcome to the wood</div><div class='k2'>{menu}</div><div class='k3'>{say(3)}</div>"
        f"<div class='k4'>{inner}<div class='k5'>Read on in our shop</div></div><div class='k6'>Page {k} of all</div></body>"
    )
    return page, "\n\n".join(article)


def test_the_template_finds_the_article(spark):
    rng = np.random.default_rng(2)
    made = [template_page(rng, k) for k in range(40)]
    pages = [(k, f"http://wood.example/{k}", html) for k, (html, _) in enumerate(made)]
    # a host of three pages, a host whose pages are copies of two, and a page alone on its host
    pages += [(100 + k, f"http://small.example/{k}", made[k][0]) for k in range(3)] + [(200 + k, f"http://copies.example/{k}", made[k // 19][0]) for k in range(20)]
    pages += [(300, "http://alone.example/", made[0][0]), (301, None, None), (302, "http://wood.example/x", "")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, PAGE).repartition(5)).collect()}
    want = {k: text for k, (_, text) in enumerate(made)} | {100 + k: made[k][1] for k in range(3)} | {200 + k: made[k // 19][1] for k in range(20)}
    assert {k: got[k] for k in want} == want
    # without a template there is nothing to tell these boxes apart
    assert got[300] == main_text(made[0][0]) != made[0][1] and got[301] == got[302] == ""
    assert extract(spark.createDataFrame([], PAGE)).count() == 0


def test_copies_keep_their_article(spark):
    page = lambda k: f"<body><div class='menu'>Menu</div><article><p>One story told in full</p><p>and its end</p></article><footer>{k}</footer></body>"
    pages = [(k, f"http://h.example/{k}", page(k % 3)) for k in range(30)]
    assert {r.text for r in extract(spark.createDataFrame(pages, PAGE)).collect()} == {"One story told in full\n\nand its end"}


def test_classes_must_be_in_order():
    from paperloom.llm.extract_html import _signatures

    same = _signatures([(1, 10), (1, 11), (2, 20), (2, 21), (2, 20), (2, 21), (1, 12)])
    assert same == _signatures([(1, 10), (1, 11), (2, 20), (2, 21), (1, 12)])
    assert same[2] != _signatures([(1, 10), (2, 20), (2, 21), (1, 11), (1, 12)])[2]  # another gap
    assert same[1] != _signatures([(1, 11), (1, 10), (2, 20), (2, 21), (1, 12)])[1]  # another order
    assert same[2] != _signatures([(1, 10), (1, 11), (2, 20), (2, 21), (2, 21), (1, 12)])[2]  # rounds that differ


def test_pool_is_the_mean_of_words():
    rng = np.random.default_rng(0)
    from paperloom.llm.quality import BUCKETS, REPEAT

    vectors = rng.normal(size=(BUCKETS, DIMENSIONS)).astype(np.float32)
    texts = ["", "a b  c", None, "x x x\nx", "!!! ***", "Ab,c ab. \t 12"]
    for text, got in zip(texts, pool(pa.array(texts, pa.string()), vectors), strict=True):
        found = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
        ids = [b for w in found for b in (piece_buckets(w) if w else ())]
        ids += [REPEAT for a, b in zip(found, found[1:]) if a == b and a]
        assert np.allclose(got, np.mean(vectors[ids], axis=0) if ids else 0, atol=1e-5)


def test_quality_on_held_out_rows(spark):
    labels = dict(rows_of("labels", "doc_id", "quality"))
    base = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    rows = Q.op9_quality(spark, base).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 100 and np.mean(held) > 0.93


def test_quality_without_labels_and_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = train(odd, labels)
    assert {r["score"] for r in score(odd, model).collect()} == {0.5} and score(odd, model).columns == [*odd.columns, "score"]
    clash = odd.withColumnsRenamed({"n": "score", "id": "Score_"})
    with pytest.raises(ValueError, match="score"):
        score(clash, model)
    assert keep_good(clash, model).columns == clash.columns and keep_good(clash, model).count() == odd.count() and keep_good(empty, model).count() == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert score(odd, train(docs, labels)).count() == odd.count() and score(empty, Model([], [])).count() == 0


ITEM = "A train that leaves Paris at 40 km per hour meets another train after 3 hours, so how far has each of them gone by then?"
OTHER = ITEM.replace("Paris", "Berlin").replace("40", "55").replace("3", "7")


def test_templates():
    assert describe("1,200.5!")[2] == "1200.5" and describe("(Paris)")[2] == "paris" and describe("--")[1] & 16


def test_contaminated(spark, odd, empty):
    items = spark.createDataFrame([(1, ITEM), (2, None), (None, "x"), (3, "too short")], "item_id bigint, text string")
    docs = [
        (1, "Some words before. " + ITEM), (2, "before " + OTHER + " after"), (3, "A train that leaves the town"), (4, None), (5, ""), (5, "x"),
        (6, "Well, " + ITEM.replace("train after 3", "train after 9").replace("40 km per hour meets another train", "40 km per hour meets another train")), (None, ITEM),
        (8, " ".join(f"w{i}" for i in range(500)) + " " + ITEM + " " + "z " * 3000),
    ]
    frame = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id bigint, text string, item_id string")
    assert {r.doc_id for r in contaminated(frame, items).collect()} == {1, 2, 6, None, 8}
    kept = clean(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 5]
    assert clean(odd, items).count() == odd.count() and clean(empty, items).count() == 0
    assert clean(frame, items.limit(0)).count() == len(docs)


def test_contaminated_slots_must_agree(spark):
    item = "values 5 and then 5 are put into the same old box as before"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, item.replace("5 and then 5", "8 and then 9"))], "doc_id bigint, text string")
    assert [r.doc_id for r in contaminated(docs, items).collect()] == [1]


def test_a_conflict_drops_only_its_windows(spark):
    rest = "the old miller counts his sacks by candle light and writes each sum into a book that nobody else may read"
    item = f"values 5 and then 5 are put into the same old box as before while {rest}"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = [(1, item.replace("then 5", "then 6")), (2, item.replace("5 and then 5", "8 and then 9")), (3, rest[:30])]
    found = {r.doc_id: r for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    # five windows hold one of the two numbers; none of the item's other windows is lost
    assert {d: (r.windows, r.matched) for d, r in found.items()} == {1: (29, 24), 2: (29, 24)}


def test_long_runs_short_items_and_numbers(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    run = lambda n: "before that " + " ".join(long.split()[20 : 20 + n]) + " and after"
    sums = "What is 3 + 4 + 12 + 7 + 19 + 2 + 6 + 88?"
    items = spark.createDataFrame([(1, long), (2, "Paris is the capital of France"), (3, sums), (4, "Too short")], "item_id bigint, text string")
    docs = [
        (1, run(13)), (2, run(12)), (3, "Everyone knows Paris is the capital of France today"), (4, "Everyone knows that Rome is the capital of Italy"), (5, f"So: {sums} Well"),
        (6, "So: What is 3 + 4 + 12 + 8 + 20 + 2 + 6 + 88?"), (7, "That was too short for them"), (8, "Well.\nToo short!\nYes."), (9, "1 2 3 4 5 6 7 8 9 10"), (10, "the capital of France"),
    ]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (8, 4)}


def test_contaminated_is_brute_force(spark):
    def words(t):
        return [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in t.split()) if w]

    grams = {}
    for i, t in rows_of("benchmark", "item_id", "text"):
        w = words(t)
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = set()
    sizes = Counter(i for s in grams.values() for i in s)
    for d, t in rows_of("documents", "doc_id", "text"):
        w = words(t)
        hits = Counter(i for g in {tuple(w[k : k + 8]) for k in range(len(w) - 7)} for i in grams.get(g, ()))
        want |= {d for i, n in hits.items() if n >= 0.5 * sizes[i]}
    assert {r.doc_id for r in Q.op7_decontaminate(spark, SMALL).collect()} == want and want


def test_near_stage_is_jaccard(spark):
    def pair(k, tail):
        words = [f"w{k}x{i}" for i in range(100)]
        return " ".join(words), " ".join(words[: 100 - tail] + [f"v{k}x{i}" for i in range(tail)])

    # of 96 shingles each, 86 of 106 are shared (0.811), and 84 of 108 (0.778)
    rows = [(1000 * tail + 2 * k + j, t) for tail in (10, 12) for k in range(100) for j, t in enumerate(pair(k + 100 * tail, tail))]
    kept = [r.doc_id for r in drop_near(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sum(d >= 12000 for d in kept) == 200
    assert sum(d < 12000 for d in kept) <= 102


def brute_words(text):
    """(canonical word, value, slot kind, whether it starts a sentence) of each word."""
    out, ended = [], True
    for piece in re.findall(r"\n|[^\x20\x09-\x0D]+", text or ""):
        h, flags, value = describe(piece)
        if flags & 16:
            ended |= bool(flags & 8)
            continue
        kind = 1 if flags & 1 else 2 if flags & 4 and out and out[-1][2] == 1 else 3 if flags & 2 and not ended else 0
        out.append((("", "#", "unit", "name")[kind] or f"w{value}", value, kind, ended))
        ended = bool(flags & 8)
    return out


def brute_windows(words, size, plain):
    """place -> (window, slots) of one text."""
    out = {}
    for k in range(len(words) - size + 1):
        run = words[k : k + size]
        literals = sum(w[2] == 0 for w in run)
        alone = run[0][3] and (k + size == len(words) or words[k + size][3])
        if not plain and literals < (4 if size == 8 else min(2, size)):
            continue
        if size < 8 and not alone and not (size >= 4 and (plain or literals >= 4)):
            continue
        out[k] = (tuple(w[1] for w in run), []) if plain else (tuple(w[0] for w in run), [(w[2], w[1]) for w in run if w[2]])
    return out


def brute_contaminated(docs, items):
    wanted = {}
    for i, text in items:
        words = brute_words(text)
        size = min(8, len(words))
        if i is not None and size:
            dense = brute_windows(words, size, False)
            plain = {k: w for k, w in brute_windows(words, size, True).items() if size < 8 or k not in dense}
            wanted[i] = size, dense, plain
    found = set()
    for d, text in docs:
        words = brute_words(text)
        own = {(size, plain): brute_windows(words, size, plain) for size in range(1, 9) for plain in (False, True)}
        for i, (size, dense, plain) in wanted.items():
            lined = {}
            for kind, windows in ((False, dense), (True, plain)):
                for at, (run, slots) in windows.items():
                    for k, (other, values) in own[size, kind].items():
                        if run == other and [x[0] for x in slots] == [x[0] for x in values]:
                            lined.setdefault(k - at, []).append((at, kind, list(zip(slots, values, strict=True))))
            matched, literal, longest = set(), set(), 0
            for hits in lined.values():
                means = {}
                for _, _, pairs in hits:
                    for a, b in pairs:
                        means.setdefault(a, set()).add(b)
                good = [h for h in hits if all(a == b for a, b in h[2]) or all(len(means[a]) == 1 for a, _ in h[2])]
                matched |= {h[0] for h in good}
                literal |= {h[0] for h in good if not h[1]}
                places = {h[0] for h in good}
                for x in places - {y + 1 for y in places}:
                    n = 1
                    while x + n in places:
                        n += 1
                    longest = max(longest, n)
            share = max(len(matched) / len({*dense, *plain}), len(literal) / len(dense) if dense else 0)
            if matched and (share >= 0.3 or longest >= 6):
                found.add((d, i))
    return found


def test_contaminated_is_the_brute_force_of_its_method(spark):
    rng = np.random.default_rng(3)
    small = "the a of Paris London 3 40 km sums and then Anna walks home with 7 apples, far away from it. Who goes? Yes! 12 kg".split()
    items = [(i, " ".join(rng.choice(small, n))) for i, n in enumerate(rng.integers(1, 30, 60).tolist())]
    docs = []
    for d in range(150):
        parts = [" ".join(rng.choice(small, rng.integers(0, 12)))]
        for _ in range(2):
            words = items[rng.integers(0, 60)][1].split()
            words = [rng.choice(["5", "88", "Rome", w]) if w[0].isdigit() or w[0].isupper() and rng.random() < 0.5 else w for w in words]
            cut = rng.integers(0, max(1, len(words) // 2))
            parts += [" ".join(words[cut:] if rng.random() < 0.4 else words), rng.choice(["", ".", "\n"])]
        docs.append((d, " ".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and 100 < len(want) < 6000
    docs, items = rows_of("documents", "doc_id", "text"), rows_of("benchmark", "item_id", "text")
    assert {r.doc_id for r in Q.op7_decontaminate(spark, SMALL).collect()} == {d for d, _ in brute_contaminated(docs, items)}


def test_a_short_question_with_other_numbers(spark):
    items = spark.createDataFrame([(1, "What is 12 plus 30?"), (2, "3 + 4")], "item_id bigint, text string")
    docs = [(1, "Hello. What is 7 plus 5? Well."), (2, "I know what is 7 plus 5 and more"), (3, "5 + 6"), (4, "So 3 + 4\n"), (5, "3 + 4")]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1), (5, 2)}


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from paperloom.llm.common import table

    work = Scratch(spark, "t")
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in P.STAGES:
        docs = work.save(stage(spark, docs, SMALL), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == names and {r.doc_id for r in kept[name]} <= set(before)
    assert len({r.text for r in kept["exact_dedup"]}) == len(kept["exact_dedup"]) == len({r.text for r in kept["quality"]})
    left = {r.doc_id for r in kept["decontamination"]}
    flagged = {r.doc_id for r in Q.op7_decontaminate(spark, SMALL).collect()}
    assert left == {r.doc_id for r in kept["near_dedup"]} - flagged
    assert {r.doc_id for r in kept["packing"]} == left
    labels = dict(rows_of("labels", "doc_id", "quality"))
    first = {r.doc_id for r in kept["quality"]}
    right = [(d in first) == (labels[d] == 1) for d in labels if d in before]
    assert np.mean(right) > 0.9
    assert {r.doc_id for r in P.run(spark, SMALL).collect()} == left
