"""Documents from text files, Markdown and extracted pages, and verified table artifacts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".md", ".markdown")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(```|~~~)")


class SourceError(ValueError):
    """An unreadable, unsupported or repeated source."""


def normalized_path(path: Column) -> Column:
    """Forward slashes, no white space around, single separators."""
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), "/+", "/")


def read_files(spark: SparkSession, path: str, errors: str = "strict") -> DataFrame:
    """(source_path, media_type, text, byte_length) of the text and Markdown files in a folder or pattern.

    Another suffix, a repeated logical path, an empty text or, unless errors is "replace", text
    that is not UTF-8 is an error.
    """
    files = spark.read.format("binaryFile").load(path).select(normalized_path(F.col("path")).alias("source_path"), "content")
    decoded = F.try_validate_utf8(F.col("content").cast("string")) if errors == "strict" else F.make_valid_utf8(F.col("content").cast("string"))
    name = F.lower("source_path")
    kind = F.when(name.endswith(".txt"), "text/plain").when(name.endswith(".md") | name.endswith(".markdown"), "text/markdown")
    rows = files.select("source_path", kind.alias("media_type"), decoded.alias("text"), F.octet_length("content").cast("long").alias("byte_length"))
    bad = rows.where(F.col("media_type").isNull() | F.col("text").isNull() | (F.trim("text") == "")).select("source_path").limit(5).collect()
    if bad:
        raise SourceError(f"unsupported, empty or undecodable: {[r[0] for r in bad]}")
    twice = rows.groupBy("source_path").count().where("count > 1").limit(5).collect()
    if twice:
        raise SourceError(f"repeated paths: {[r[0] for r in twice]}")
    return rows


def from_pages(pages: DataFrame) -> DataFrame:
    """(source, page, text, start_character, end_character): where each page lies when a source's non-empty pages are joined by line feeds in page order."""
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    rows = pages.where("text <> ''").withColumn("start_character", start)
    return rows.select("source", "page", "text", "start_character", (F.col("start_character") + F.length("text")).cast("long").alias("end_character"))


def split_markdown(text: str) -> list[tuple[int, int, str | None, list[str], int, int]]:
    """(ordinal, level, heading, path, start, end): sections at ATX headings outside fences, with a preamble if text comes first."""
    cuts: list[tuple[int, int, str | None, list[str]]] = []
    stack: list[tuple[int, str]] = []
    fence = None
    at = 0
    for line in text.splitlines(keepends=True):
        mark = _FENCE.match(line)
        if mark and fence in (None, mark[1]):
            fence = None if fence else mark[1]
        elif fence is None and (m := _HEADING.match(line.rstrip("\r\n"))):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            cuts.append((at, len(m[1]), m[2], [h for _, h in stack]))
        at += len(line)
    if not cuts or cuts[0][0] > 0:
        cuts.insert(0, (0, 0, None, []))
    ends = [c[0] for c in cuts[1:]] + [len(text)]
    return [(k, level, heading, path, start, end) for k, ((start, level, heading, path), end) in enumerate(zip(cuts, ends, strict=True))]


def markdown_sections(docs: DataFrame) -> DataFrame:
    """The sections of every document; docs: source_path, text."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
    names = ["source_path", "ordinal", "level", "heading", "heading_path", "start_character", "end_character"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *s) for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in split_markdown(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)

    return docs.select("source_path", "text").mapInArrow(run, "source_path string, ordinal bigint, level bigint, heading string, heading_path array<string>, start_character bigint, end_character bigint")


def _digest(df: DataFrame):
    """Rows and an order-free checksum of their JSON."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    one = lambda part: F.coalesce(F.bit_xor(F.conv(F.substring(F.sha2(text, 256), part, 15), 16, 10).cast("long")), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.hex(one(p)) for p in (1, 16, 31, 46)]).alias("checksum")).collect()[0]


def write_artifact(df: DataFrame, path: str, version: int = 1) -> None:
    """A Parquet table with a manifest of its version, row count and checksum, written last."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    spark = df.sparkSession
    found = _digest(spark.read.schema(df.schema).parquet(f"{path}/table"))
    spark.createDataFrame([(version, found["rows"], found["checksum"])], "version int, rows long, checksum string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_artifact(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The table of an artifact; another version or checksum is an error."""
    manifest = spark.read.schema("version int, rows long, checksum string").json(f"{path}/manifest").collect()
    if len(manifest) != 1 or manifest[0]["version"] != version:
        raise SourceError("the artifact has no manifest of this version")
    df = spark.read.parquet(f"{path}/table")
    found = _digest(df)
    if (found["rows"], found["checksum"]) != (manifest[0]["rows"], manifest[0]["checksum"]):
        raise SourceError("the artifact does not have its checksum")
    return df
