"""Main text of pages by equivalence-class template deduction.

Tokens are tags and text runs, told apart by the path of elements above them.  A token's occurrence
vector, its counts over the distinct pages of a host, is kept as a commutative fingerprint beside
its support, so vectors are compared without being gathered: sums combine on the map side, and a
host with a third of all pages is no hot group.  Tokens of a host with equal vectors and wide
support form a class.  A second pass checks classes on every page: the tokens of a valid class come
in one order, round after round, and lie in the same gaps of the class that occurs once a page.
Valid classes nest, by those gaps and the paths of their tokens, into the host's template.

The template's tags bound its slots: a text belongs to the slot of the innermost template element
around it.  The second pass also sums up each slot over the host's pages: characters, characters in
links, how many different texts.  The article is the smallest template element that holds most of
what varies and is no link; names of elements and classes only weigh a slot.  Inside it, elements
named as something else and slots that hold the same text on every page are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch
from paperloom.llm.url_filter import host_and_path

#: A class belongs to the template if its tokens stand, and stand in order, on this share of a host's distinct pages.
SUPPORT = 0.8
#: The article holds this share of the weight of all slots; a slot of an element that is named as an article or main part
#: weighs FAVOUR as much as a plain one, a slot of one that is named as something else a FAVOUR-th; a slot whose text
#: hardly differs between pages weighs LEAST at least, and a plain box that never does nothing.
SHARE, FAVOUR, LEAST = 0.85, 8.0, 0.1

# Element names and words in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus related recommended share "
    "sharing social widget login signup search toolbar pagination pager".split()
)
#: Words that may stand beside one of HINTS in a class or id; with any other word the name says something else.
BESIDE = frozenset(
    "bar bars block box boxes bottom btn button buttons container content fixed float global group header inner items left link links list main mobile outer page panel "
    "policy primary right row secondary section site slot small sticky text title top unit wrap wrapper".split()
)
#: Elements that such a name marks; of paragraphs and quotations it says how they look.
BOXES = frozenset("div section ul ol dl table details center fieldset dir tr td li header span form".split())
#: Elements that carry text but bound no slot.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address dt dd caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
REMARKS = frozenset("comment comments reply replies".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORDS = re.compile(r"[a-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def _named(name: str, hints: frozenset[str]) -> bool:
    """Whether a class or id is made of hints and words that may stand beside them."""
    words = _WORDS.findall(name)
    return any(w in hints for w in words) and all(w in hints or w in BESIDE for w in words)


def _outside(tag: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether an element says of itself that it is not main text."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    if tag == "article":
        return any(_named(n, REMARKS) for n in names)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    named = tag in BOXES and (any(_named(n, HINTS) for n in names) or ("header" in names and not in_article))
    return hidden or named or found.get("role", "").lower() in ROLES


class Element:
    """out: some element from here up is named as something else; main: some is an article or main part (within out, none)."""

    __slots__ = ("tag", "path", "token", "out", "main", "link", "above")

    def __init__(self, tag: str, path: str, out: bool, main: bool, link: bool, above: Element | None):
        self.tag, self.path, self.out, self.main, self.link, self.above = tag, path, out, main, link, above
        self.token = _token("tag", path) if path else 0


def events(page: str) -> Iterator[tuple[str, str, Element]]:
    """("tag", path, element) as a block opens, ("break", "", element) at block ends, ("text", run, element)."""
    root = Element("", "", False, False, False, None)
    stack = [root]
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if (m.start() if m else len(page)) > at:
            yield "text", page[at : m.start() if m else len(page)], stack[-1]
        if not m:
            return
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(e.tag == tag for e in stack):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            if tag in BLOCK:
                yield "break", "", stack[-1]
            continue
        if tag == "br":
            yield "text", " ", stack[-1]
        if tag in VOID:
            if tag in BLOCK:
                yield "break", "", stack[-1]
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            ends = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        found = _attributes(m[3]) if m[3] else {}
        above = stack[-1]
        in_article = any(e.tag in ("article", "main") for e in stack)
        # an article or main part inside a region that only its class names as something else is one all the same
        core = tag in ("article", "main") or found.get("role") == "main"
        own = _outside(tag, found, in_article)
        out = own or (above.out and not (core and not any(e.tag in OUTSIDE for e in stack)))
        mark = ".".join(x for x in (tag, found.get("class", ""), found.get("id", "")) if x)
        path = f"{above.path}>{mark}" if tag in BLOCK else above.path
        element = Element(tag, path, out, not out and (above.main or core), above.link or tag == "a", above)
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append(element)
        if tag in BLOCK:
            yield "break", "", element
            yield "tag", element.path, element


def _token(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{text}".encode("utf-8", "surrogatepass")) >> 1


def tokens(page: str) -> Counter:
    """How often each token of a page occurs."""
    found: Counter = Counter()
    for kind, text, element in events(page):
        if kind == "tag":
            found[element.token] += 1
        elif kind == "text" and (run := " ".join(text.split())):
            found[_token("text", f"{element.path}\0{run}")] += 1
    return found


class Template:
    """What a host's pages share: tags of valid classes, slots that hold the same text everywhere, and the element that is the article."""

    def __init__(self, tags: Iterable[int] = (), fixed: Iterable[int] = (), article: int | None = None):
        self.tags, self.fixed, self.article = frozenset(tags), frozenset(fixed), article

    def slot(self, element: Element | None) -> Element | None:
        """The innermost template element around that bounds a slot."""
        while element is not None and (element.token not in self.tags or element.tag in FLOW):
            element = element.above
        return element

    def chain(self, slot: Element) -> list[int]:
        """The slot's element and the template elements around it; all that are in an article or main part count as the outermost of them."""
        found: list[Element] = []
        above: Element | None = slot
        while above is not None:
            if above.token in self.tags and above.tag not in FLOW:
                if found and found[-1].main and above.main:
                    found.pop()
                found.append(above)
            above = above.above
        return [e.token for e in found]

    def inside(self, element: Element | None) -> bool:
        """Whether an element is in the article."""
        while element is not None and element.token != self.article:
            element = element.above
        return element is not None


def main_text(page: str, template: Template | None = None) -> str:
    """Blocks of the article, joined by blank lines.

    Without a template the article and main elements are the article; a page without either has all
    that lies in no element named as something else.
    """
    template = template or Template()
    blocks: list[tuple[bool, str]] = []
    run: list[str] = []
    main = False
    any_main = False

    def close():
        nonlocal run, main
        if text := " ".join("".join(run).split()):
            blocks.append((main, text))
        run, main = [], False

    for kind, text, element in events(page):
        here = template.inside(element) if template.article is not None else element.main
        if kind == "break":
            close()
            any_main |= here
        elif kind == "text" and not element.out:
            if template.fixed and (slot := template.slot(element)) is not None and slot.token in template.fixed:
                run.append(" ")
                continue
            run.append(entities.unescape(text))
            main |= here
    close()
    return "\n\n".join(text for inside, text in blocks if inside or not any_main)


def vectors(pages: DataFrame, work: Scratch) -> DataFrame:
    """(host, cls, tokens): the classes of each host, tokens with equal vectors on at least SUPPORT of its distinct pages."""
    copies = pages.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1")
    weighed = pages.join(work.save(copies, "copies"), ["host", "page"], "left").select("host", "page", "html", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list] = {}
            for host, own, page, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for token, n in [(0, 1), *tokens(page).items()]:
                    x = seen.setdefault((host, token), [0.0, 0, 0])
                    h = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), own & (1 << 64) - 1)
                    x[0] += weight
                    x[1] += h & 0x7FFFFFFF
                    x[2] += h >> 33
            keys = list(seen)
            values = [pa.array([seen[k][c] for k in keys], kind) for c, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *values], names=["host", "token", "n", "low", "high"])

    counted = weighed.mapInArrow(count, "host string, token bigint, n double, low bigint, high bigint").groupBy("host", "token")
    found = work.save(counted.agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).where("n > 1.5 or token = 0"), "vectors")
    whole = found.where("token = 0 and n > 1.5").select("host", F.col("n").alias("pages"))
    wide = found.where("token <> 0").join(whole, "host").where(F.col("n") >= SUPPORT * F.col("pages"))
    classes = wide.groupBy("host", "low", "high").agg(F.collect_set("token").alias("tokens")).where(F.size("tokens") > 1)
    return work.save(classes.select("host", F.xxhash64("low", "high").alias("cls"), F.array_sort("tokens").alias("tokens")), "classes")


def _signatures(order: list[tuple[int, int]]) -> dict[int, int]:
    """A hash for each class on a page, from its (class, token) in order: the order of its tokens in a round, whether all
    rounds are alike, and the gaps it lies in of the class that occurs once a page and has the most tokens.
    """
    seen: dict[int, list[int]] = {}
    for cls, token in order:
        seen.setdefault(cls, []).append(token)
    once = min((c for c, found in seen.items() if len(set(found)) == len(found)), key=lambda c: (-len(seen[c]), c), default=None)
    gap, gaps = 0, {c: set() for c in seen}
    for cls, _ in order:
        if cls == once:
            gap += 1
        else:
            gaps[cls].add(gap)
    out = {}
    for cls, found in seen.items():
        size = len(set(found))
        alike = len(found) % size == 0 and all(found[k] == found[k % size] for k in range(len(found)))
        out[cls] = xxhash.xxh64_intdigest(f"{found[:size] if alike else found}{sorted(gaps[cls])}") >> 1
    return out


def _by_host(batch: pa.RecordBatch, at: int, made: dict, make) -> Iterator:
    """What `make` builds from the columns from `at` on, row by row; a host's own is built once while it is in use."""
    hosts = batch.column(0).to_pylist()
    for k, host in enumerate(hosts):
        if host not in made:
            if len(made) >= 64:
                made.clear()
            made[host] = make(*(batch.column(c)[k].as_py() for c in range(at, batch.num_columns)))
        yield made[host]


SEEN = "host string, kind int, a bigint, b bigint, chain array<bigint>, n bigint, linked bigint, text bigint, outer bigint, inner bigint, fixable boolean"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From host, html, classes: kind 0 for a page, 1 for (class, signature) on it, 2 for its slots."""

    def make(classes):
        return {t: c["cls"] for c in classes for t in c["tokens"]}, Template(t for c in classes for t in c["tokens"])

    made: dict = {}
    names = [x.split()[0] for x in SEEN.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.bool_()]
    for batch in batches:
        rows: list[tuple] = []
        signs: Counter = Counter()
        for host, page, (own, template) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _by_host(batch, 2, made, make), strict=True):
            order: list[tuple[int, int]] = []
            found: dict[int, list] = {}
            for kind, text, element in events(page):
                bare = " ".join(text.split()) if kind == "text" else ""
                token = element.token if kind == "tag" else _token("text", f"{element.path}\0{bare}") if bare else None
                if token in own:
                    order.append((own[token], token))
                if bare and (slot := template.slot(element)) is not None:
                    x = found.setdefault(slot.token, [slot, 0, 0, xxhash.xxh64(), 0, 0])
                    x[1] += len(bare)
                    x[2] += len(bare) * element.link
                    x[3].update(bare.encode("utf-8", "surrogatepass"))
                    x[4] += len(bare) * element.out
                    x[5] += len(bare) * element.main
            signs[host, 0, 0, 0] += 1
            for cls, sign in _signatures(order).items():
                signs[host, 1, cls, sign] += 1
            for token, (slot, n, linked, text, outer, inner) in found.items():
                rows.append((host, 2, token, 0, template.chain(slot), n, linked, text.intdigest() >> 1, outer, inner, slot.tag in BOXES))
        rows += [(*k, None, n, 0, 0, 0, 0, False) for k, n in signs.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def slots(pages: DataFrame, classes: DataFrame, work: Scratch) -> DataFrame:
    """(host, template, fixed, article): tokens of valid classes, slots with one text, and the element that is the article."""
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("cls", "tokens")).alias("classes"))
    total = lambda c: F.sum(c).alias(c)
    seen = pages.select("host", "html").join(by_host, "host").mapInArrow(_survey, SEEN).groupBy("host", "kind", "a", "b")
    seen = seen.agg(
        F.first("chain").alias("chain"), total("n"), total("linked"), total("outer"), total("inner"), F.first("fixable").alias("fixable"),
        F.approx_count_distinct("text").alias("texts"), F.count("*").alias("rows"),
    )
    seen = work.save(seen, "seen")
    good = seen.where("kind = 1").groupBy("host", F.col("a").alias("cls")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).where(F.col("top") >= SUPPORT * F.col("all"))
    valid = work.save(classes.join(good, ["host", "cls"]).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template")), "valid")
    pages_of = seen.where("kind = 0").select("host", F.col("n").alias("on"))
    # a slot whose own element is no valid template element falls to the next one around it
    found = seen.where("kind = 2").join(valid, "host").join(pages_of, "host").withColumn("chain", F.filter("chain", lambda x: F.array_contains("template", x)))
    # characters outside links, as far as they differ from page to page; names weigh
    share = F.least(F.lit(1.0), F.greatest(F.lit(LEAST), F.col("texts") / F.col("rows")))
    varied = F.when(F.col("fixable") & (F.col("texts") == 1), 0.0).otherwise(share)
    named = F.pow(F.lit(FAVOUR), (F.col("inner") - F.col("outer")) / F.greatest(F.col("n"), F.lit(1)))
    fixed = F.col("fixable") & (F.col("texts") == 1) & (F.col("rows") >= SUPPORT * F.col("on")) & F.array_contains("template", F.col("a"))
    found = work.save(found.select("host", F.col("a").alias("slot"), "chain", ((F.col("n") - F.col("linked")) * varied * named).alias("weight"), fixed.alias("fixed")), "slots")
    whole = found.groupBy("host").agg(F.sum("weight").alias("whole"), F.collect_list(F.when(F.col("fixed"), F.col("slot"))).alias("fixed"))
    nested = found.select("host", "weight", F.posexplode("chain").alias("up", "element"), F.size("chain").alias("depth"))
    held = nested.groupBy("host", "element").agg(F.sum("weight").alias("held"), F.max(F.col("depth") - F.col("up")).alias("depth")).join(whole, "host")
    best = F.max_by("element", F.struct("depth", "held", "element"))
    articles = held.where((F.col("held") >= SHARE * F.col("whole")) & (F.col("held") > 0)).groupBy("host").agg(best.alias("article"), F.first("fixed").alias("fixed"))
    return work.save(valid.join(articles, "host"), "articles")


def templates(pages: DataFrame, work: Scratch) -> DataFrame:
    """(host, template, fixed, article) of every host whose distinct pages share valid classes.  pages: host, page (a hash of the html), html."""
    return slots(pages, vectors(pages, work), work)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row.

    A null html is an empty page, and a page without a host has no template.  Copies of a page weigh
    as one in its host's template, and every row gives a row.  An empty table gives an empty result.
    """
    work = Scratch(pages.sparkSession, "html")
    host, _ = host_and_path(F.col(url_col))
    kind = pages.schema[id_col].dataType.simpleString()
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), html.alias("html"), F.xxhash64(html).alias("page"))
    found = templates(rows.where("host <> '' and html <> ''").select("host", "page", "html"), work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        make = lambda template, fixed, article: Template(template or (), fixed or (), article)
        for batch in batches:
            texts = [main_text(page, template) for page, template in zip(batch.column(3).to_pylist(), _by_host(batch, 4, made, make), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    joined = rows.join(found, "host", "left").select("host", "id", "url", "html", "template", "fixed", "article")
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
