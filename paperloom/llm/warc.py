"""WARC archives through Spark's own readers and writers.

Records are strings, and the text writer ends each with the blank line that ends a WARC record, so
an archive part is a plain file wherever Spark can write.  The text reader cuts files of any size
into ranges and those at the magic that begins a record, which cannot overlap itself, so ranges
agree on the cuts.  A task emits each candidate of its range with the offset of its successor, and
jumps along the pointers inside the range: where a chain from a candidate leaves the range, and
which candidates lie on it.  Joins then double the jumps from range to range, from the start of
each file; only candidates on the chain from there are records, magic inside payloads is not.
Records that a range boundary cuts, those with magic in their payload, are put together from the
pieces of both ranges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch

#: Payloads of fewer bytes are stored again; bytes a header may have.
REVISIT_BYTES, HEADER_BYTES = 100, 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "page_id bigint, url string, record_id string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
MAGIC = b"WARC/1."
_START = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)")


class BadArchive(ValueError):
    """A file whose chain of records breaks off, or a record without its end or its digest."""


def _urn(page_id, digest):
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def write_warc(pages: DataFrame, path: str, work: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row.  Of equal payloads of at least REVISIT_BYTES bytes the one with the
    smallest id is a response and others revisit it; all others are responses.  A null payload
    counts as empty.  Rows equal in id and payload share their record type and id; rows without an id
    revisit a row that has one.  Control characters and blanks of a url are percent-encoded.  An empty
    table gives an archive without records.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html"))
    shared = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = work.save(shared.where("n > 1").select("digest", "first"), "shared")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html")))
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    url = F.col("url")
    for code in range(33):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(F.col("url").rlike(r"[\x00-\x20]"), url).otherwise(F.col("url"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Page-ID", F.col("id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("first"), F.col("digest")))),
        line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("first").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    out = rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n")
    out.mode("overwrite").text(path)


def record_end(data: bytes) -> tuple[int, int] | None:
    """Where the block of the record at the start of data begins and where its successor does; None if data holds no whole header."""
    head = data.find(b"\r\n\r\n")
    size = _LENGTH.search(data, 0, head + 2) if head >= 0 else None
    return (head + 4, head + 8 + int(size[1])) if size and _START.match(data) else None


def parse(data: bytes) -> tuple:
    """The values of SCHEMA, what is wrong (null if nothing) and the payload (null for revisits) of one whole record.

    Records of any type and writer: what a header does not say is null, and a digest of another kind
    than SHA-256 in hex is not checked.
    """
    at, end = record_end(data)
    field = {}
    for line in data[:at].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        field.setdefault(name.strip().lower(), value.strip())
    kind = field.get("warc-type", "")
    number = lambda k: int(field[k]) if field.get(k, "").lstrip("-").isdigit() else None
    said = field.get("warc-payload-digest", "").lower().removeprefix("sha256:")
    said = said if re.fullmatch("[0-9a-f]{64}", said) else None
    wrong = None if data[end - 4 : end] == b"\r\n\r\n" else "has no end"
    payload, size = None, number("warc-payload-length")
    if kind != "revisit":
        payload = data[at : end - 4]
        if field.get("content-type", "").lower().startswith("application/http"):
            payload = payload[payload.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in payload else b""
        own, size = hashlib.sha256(payload).hexdigest(), len(payload)
        wrong = wrong or (None if said in (None, own) else "does not have its digest")
        said = own
    return number("warc-page-id"), field.get("warc-target-uri"), field.get("warc-record-id"), kind, number("warc-refers-to-page-id"), size, said, wrong, payload


class _Candidate:
    """A place that may be a record, with the bytes from there on until it is whole."""

    def __init__(self, at: int):
        self.at, self.parts, self.have, self.need, self.next = at, [], 0, None, -1

    def feed(self, data: bytes) -> bool:
        """Takes bytes; whether no more are of use."""
        self.parts.append(data)
        self.have += len(data)
        if self.need is None:
            start = b"".join(self.parts)
            found = record_end(start)
            if found:
                self.need, self.next = found[1], self.at + found[1]
            elif b"\r\n\r\n" in start or self.have > HEADER_BYTES or not _START.match(start):
                return True
        return self.need is not None and self.have >= self.need

    def bytes(self) -> bytes | None:
        """The record, where it is whole."""
        return b"".join(self.parts)[: self.need] if self.need is not None and self.have >= self.need else None


def jumps(at: list[int], follows: list[int], end: int) -> list[tuple[int, int, int]]:
    """(exit, first, last) of each candidate of a range, in order: where its chain leaves the range (-1: it breaks off), and
    numbers such that a candidate lies on the chain from another if that one's first is between its own first and last.
    """
    place = {a: k for k, a in enumerate(at)}
    n = len(at)
    above = [place.get(x, -1) for x in follows]
    out = [x if x >= end else -1 for x in follows]
    size = [1] * n
    for k in range(n):  # a successor lies behind, so sizes are whole when they are handed on
        if above[k] >= 0:
            size[above[k]] += size[k]
    first, free = [0] * n, [0] * n
    top = 0
    for k in reversed(range(n)):
        p = above[k]
        if p >= 0:
            out[k] = out[p]
            first[k], free[p] = free[p], free[p] + size[k]
        else:
            first[k], top = top, top + size[k]
        free[k] = first[k] + 1
    return [(out[k], first[k], first[k] + size[k] - 1) for k in range(n)]


#: kind 0: a range and its length; 1: a candidate's jump; 2: what a whole candidate says; 3: a candidate that the range cuts.
ROWS = f"file string, block bigint, kind int, at bigint, next bigint, low bigint, high bigint, {SCHEMA}, wrong string, payload binary"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _scan(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """ROWS of the ranges of a task, from file, block and the bytes between two magics, in order."""
    columns = [x.split() for x in ROWS.split(", ")]
    key, at = None, 0
    seen: list[_Candidate] = []
    left: list[_Candidate] = []
    rows: list[tuple] = []

    def close():
        nonlocal seen, left
        rows.append((*key, 0, 0, at) + (None,) * 11)
        for c, (out, low, high) in zip(seen, jumps([c.at for c in seen], [c.next for c in seen], at), strict=True):
            rows.append((*key, 1, c.at, out, low, high) + (None,) * 9)
        rows.extend((*key, 3, c.at, c.next) + (None,) * 11 for c in left if c.need is not None)
        seen, left = [], []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])
        rows.clear()
        return out

    for batch in batches:
        for file, block, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != key:
                if key is not None:
                    close()
                key, at = (file, block), 0
                if block == 0:  # what lies before the first magic of a file
                    at = len(content)
                    continue
            data = MAGIC + content
            c = _Candidate(at)
            seen.append(c)
            left.append(c)
            still = []
            for x in left:
                if not x.feed(data):
                    still.append(x)
                elif (whole := x.bytes()) is not None:
                    *said, payload = parse(whole)
                    rows.append((*key, 2, x.at, None, None, None, *said, payload if with_payload else None))
                    x.parts = []
            left = still
            at += len(data)
        if rows:
            yield flush()
    if key is not None:
        close()
        yield flush()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, at and bytes of everything between two magics, the magic before it included."""
    key, at = None, 0
    for batch in batches:
        files, blocks, contents = (c.to_pylist() for c in batch.columns)
        offsets, data = [], []
        for file, block, content in zip(files, blocks, contents, strict=True):
            first = (file, block) != key
            if first:
                key, at = (file, block), 0
            offsets.append(at)
            data.append(content if first and block == 0 else MAGIC + content)
            at += len(data[-1])
        columns = [batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "data"])


def _whole(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """file, off and what the record says, from file, off, next and its pieces in order."""
    names = ["file", "off", *NAMES, "wrong", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        rows = []
        for file, off, after, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = b"".join(p["data"] for p in parts)[: after - off]
            *said, payload = parse(data) if len(data) == after - off else (None,) * 7 + ("is cut short", None)
            rows.append((file, off, *said, payload if with_payload else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in a folder, plain or compressed member by member; see SCHEMA, with the payload
    (null for revisits) if asked for.

    payload_bytes and payload_digest are of the full payload, for revisits as well as far as they say
    it.  BadArchive if the chain of a file breaks off or a record lacks its end or digest, and if a
    range boundary lies in a header that holds the magic itself.
    """
    work = Scratch(spark, "warc")
    parts = spark.read.option("lineSep", MAGIC.decode()).text(path)
    parts = parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("content"))
    rows = work.save(parts.mapInArrow(lambda b: _scan(b, with_payload), ROWS), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = rows.where("kind = 0").select("file", "block", F.coalesce(F.sum("next").over(before), F.lit(0)).alias("start"), F.col("next").alias("size"))
    ranges = work.save(ranges, "ranges")
    ends = ranges.groupBy("file").agg(F.max(F.col("start") + F.col("size")).alias("size"), F.count("*").alias("n")).where("size > 0")
    most = ends.agg(F.max("n")).collect()[0][0] or 0
    placed = lambda kind: rows.where(f"kind = {kind}").join(ranges.select("file", "block", "start"), ["file", "block"])
    leave = F.when(F.col("next") >= 0, F.col("start") + F.col("next")).otherwise(F.lit(-1)).alias("next")
    jump = work.save(placed(1).select("file", (F.col("start") + F.col("at")).alias("off"), leave, "block", "low"), "jumps")
    entries, once = ends.select("file", F.lit(0).cast("long").alias("off")), jump.select("file", "off", "next")
    for _ in range(most.bit_length()):  # after k rounds the entries of the first 2 ** k ranges are known
        entries = work.save(entries.union(entries.join(once, ["file", "off"]).select("file", "next")).distinct().where("off >= 0"), "entries")
        far = once.select("file", F.col("off").alias("next"), F.col("next").alias("far"))
        once = work.save(once.join(far, ["file", "next"], "left").select("file", "off", F.coalesce("far", "next").alias("next")), "doubled")
    entered = work.save(entries.join(jump, ["file", "off"], "left"), "entered")
    lost = entered.join(ends.select("file", "size"), "file").where("(block is null and off <> size) or next < 0").select("file").first()
    if lost is not None:
        raise BadArchive(f"the chain of records breaks off before the end of {lost.file}")
    on = entered.where("block is not null").select("file", "block", F.col("low").alias("entry"))
    reached = placed(1).join(on, ["file", "block"]).where("low <= entry and entry <= high").select("file", "block", "at", "start")
    found = reached.join(rows.where("kind = 2").select("file", "block", "at", *NAMES, "wrong", "payload"), ["file", "block", "at"])
    found = found.select("file", (F.col("start") + F.col("at")).alias("off"), *NAMES, "wrong", "payload")
    cut = reached.join(rows.where("kind = 3").select("file", "block", "at", "next"), ["file", "block", "at"])
    cut = work.save(cut.select("file", (F.col("start") + F.col("at")).alias("off"), (F.col("start") + F.col("next")).alias("next")), "cut")
    if not cut.isEmpty():
        every = parts.mapInArrow(_pieces, "file string, block bigint, at bigint, data binary").join(ranges, ["file", "block"])
        every = every.select("file", (F.col("start") + F.col("at")).alias("p"), "data").join(cut, "file").where("off <= p and p < next")
        whole = every.groupBy("file", "off", "next").agg(F.array_sort(F.collect_list(F.struct("p", "data"))).alias("parts"))
        schema = f"file string, off bigint, {SCHEMA}, wrong string, payload binary"
        found = found.unionByName(whole.mapInArrow(lambda b: _whole(b, with_payload), schema))
    found = work.save(found, "records")
    bad = found.where("wrong is not null").first()
    if bad is not None:
        raise BadArchive(f"the record at {bad.off} of {bad.file} {bad.wrong}")
    return found.select(*NAMES, *["payload"] * with_payload)
