"""Sentences with offsets, cited extractive answers, citation repair, headings, tables and equations of texts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import casefold, query_terms, tokens

# Abbreviations, sentence ends, heading names, display patterns and operators.
ABBREVIATIONS = ("e.g.", "i.e.", "mr.", "mrs.", "ms.", "dr.", "prof.", "vs.", "etc.")
HEADINGS = (
    "abstract", "introduction", "background", "related work", "method", "methods", "methodology", "model", "model architecture", "architecture", "algorithm",
    "approach", "training", "implementation", "implementation details", "data", "dataset", "datasets", "experiments", "experimental setup", "results",
    "analysis", "evaluation", "ablation", "ablation study", "discussion", "limitations", "conclusion", "conclusions", "references", "appendix", "front matter",
    "title",
)
DISPLAYS = (
    r"\$\$.+?\$\$", r"\\\[.+?\\\]", r"\\begin\{(?:equation\*?|align\*?|gather\*?)\}.+?\\end\{(?:equation\*?|align\*?|gather\*?)\}", r"\\\(.+?\\\)", r"(?<!\$)\$(?!\$)[^\n]+?(?<!\$)\$(?!\$)",
)
OPERATORS = r"<=|>=|≤|≥|=|∑|∫|∂|argmax|argmin|\blog\b"
SYMBOLS = r"\\[A-Za-z]+|[α-ωΑ-Ω]|[A-Za-z](?:_[A-Za-z0-9{}]+)?"

_END = re.compile(r"[.!?。！？]+(?:[ \t]*\[C[1-9]\d*(?:\s*,\s*C[1-9]\d*)*\])*")
_SPECIAL = re.compile(r"(?P<heading>#{1,6}\s+\S)|(?P<bullet>(?:[-*+]|\d+[.)])\s+\S)")


def _abbreviated(text: str, at: int) -> bool:
    """Whether the full stop at a position belongs to an abbreviation."""
    for word in ABBREVIATIONS:
        for k, c in enumerate(word):
            begin = at - k
            if c == "." and begin >= 0 and text[begin : begin + len(word)].lower() == word and (begin == 0 or not text[begin - 1].isalnum()):
                return True
    return False


def _prose(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    begin = start
    for m in _END.finditer(text, start, end):
        stop = m.start()
        decimal = text[stop] == "." and stop > 0 and text[stop - 1].isdigit() and m.end() < len(text) and text[m.end()].isdigit()
        if decimal or (text[stop] == "." and _abbreviated(text, stop)):
            continue
        yield begin, m.end(), "prose"
        begin = m.end()
    yield begin, end, "prose"


def sentence_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points: prose sentences with the citations behind them, headings, bullets and whole code fences."""
    found: list[tuple[int, int, str]] = []
    at = 0
    prose = fence = None
    for line in [*text.splitlines(keepends=True), ""]:
        bare = line.strip()
        mark = bare[:3] if bare[:3] in ("```", "~~~") else None
        special = _SPECIAL.match(bare)
        if fence is None and (mark or not bare or special) and prose is not None:
            found += _prose(text, prose, at)
            prose = None
        if fence is not None:
            if mark == fence[1] or not line:
                found.append((fence[0], at + len(line), "code"))
                fence = None
        elif mark:
            fence = (at, mark)
        elif special:
            found.append((at, at + len(line), special.lastgroup))
        elif bare and prose is None:
            prose = at
        at += len(line)
    out = []
    for a, b, kind in found:
        piece = text[a:b]
        if piece.strip():
            out.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip()), kind))
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, start, end, kind, sentence) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(d, k, a, b, kind, t[a:b]) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (a, b, kind) in enumerate(sentence_spans(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], names=["doc_id", "k", "start", "end", "kind", "sentence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, k bigint, start bigint, end bigint, kind string, sentence string")


def scored_sentences(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Every evidence sentence scored for its question.

    evidence: query_id, rank, doc_id, score, text; questions: query_id, text.  The score is .55 of
    the question's terms covered, .25 of the sentence's terms that are the question's, and .20 of
    the damped retrieval score.
    """
    asked = questions.select("query_id", query_terms(F.col("text")).alias("asked"))
    found = sentences(evidence.select("doc_id", "text").distinct()).where("kind <> 'heading'")
    rows = evidence.select("query_id", "rank", "doc_id", "score").join(found, "doc_id").join(asked, "query_id")
    terms = F.array_distinct(tokens(F.col("sentence")))
    rows = rows.withColumn("hits", F.array_intersect("asked", terms)).withColumn("n_terms", F.size(terms))
    n = F.size("hits")
    value = 0.55 * n / F.greatest(F.lit(1), F.size("asked")) + 0.25 * n / F.greatest(F.lit(1), F.col("n_terms")) + 0.2 * F.col("score") / (1 + F.col("score"))
    return rows.select("query_id", "rank", "doc_id", "start", "end", "sentence", "hits", F.size("asked").alias("n_asked"), F.round(value, 6).alias("value"))


def select_sentences(scored: DataFrame, most: int = 3, characters: int = 1600, stop: float = 0.8, relative: float = 0.5) -> DataFrame:
    """(query_id, position, label, doc_id, start, end, value): the greedy cited answer of each query.

    A sentence must score at least `relative` of the best, be new, and add a question term; the
    choice stops at `most` sentences or `stop` of the terms.  Each label is the evidence's rank.
    """
    # only sentences over the relative bound and with a hit can be taken, so groups stay small
    best = scored.groupBy("query_id").agg(F.max("value").alias("best"))
    rows = scored.join(best, "query_id").where((F.col("value") >= F.col("best") * relative) & (F.size("hits") > 0)).drop("best")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["value", "rank", "start"], ascending=[False, True, True])
        covered: set[str] = set()
        seen: set[str] = set()
        used, out = 0, []
        for r in group.itertuples():
            flat = " ".join(r.sentence.split()).casefold()
            if flat in seen or not set(r.hits) - covered or used + len(r.sentence) + 8 > characters:
                continue
            out.append((r.query_id, len(out) + 1, f"C{r.rank}", r.doc_id, r.start, r.end, r.value))
            seen.add(flat)
            covered |= set(r.hits)
            used += len(r.sentence) + 8
            if len(out) == most or len(covered) >= stop * r.n_asked:
                break
        return pd.DataFrame(out, columns=["query_id", "position", "label", "doc_id", "start", "end", "value"])

    schema = "query_id bigint, position bigint, label string, doc_id bigint, start bigint, end bigint, value double"
    return rows.groupBy("query_id").applyInPandas(run, schema)


def redundancy_rerank(candidates: DataFrame, k: int = 10, penalty: float = 0.5, threshold: float = 0.8) -> DataFrame:
    """(query_id, position, doc_id, score): picks the best each time, taking penalty times the overlap with what is chosen
    off the scores of candidates that share at least `threshold` of their terms with it.  candidates: query_id, doc_id, score, terms."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = [(float(r.score), int(r.doc_id), frozenset(r.terms)) for r in group.itertuples()]
        chosen: list[tuple[float, int, frozenset]] = []
        while left and len(chosen) < k:
            def value(c):
                share = max((len(c[2] & o[2]) / max(1, min(len(c[2]), len(o[2]))) for o in chosen), default=0.0)
                return max(0.0, c[0] - (penalty * share if share >= threshold else 0.0))

            best = min(left, key=lambda c: (-value(c), c[1]))
            if value(best) <= 0:
                break
            chosen.append((round(value(best), 6), best[1], best[2]))
            left.remove(best)
        return pd.DataFrame([(group.query_id.iloc[0], n, d, s) for n, (s, d, _) in enumerate(chosen, 1)], columns=["query_id", "position", "doc_id", "score"])

    return candidates.groupBy("query_id").applyInPandas(run, "query_id bigint, position bigint, doc_id bigint, score double")


def quoted_blocks(left: str, right: str, least: int = 20) -> tuple[int, int]:
    """Characters in shared blocks of at least `least`, and the longest of them, white space collapsed and case folded."""
    a, b = (" ".join(x.split()).casefold() for x in (left or "", right or ""))
    sizes = [m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least]
    return sum(sizes), max(sizes, default=0)


def repair_citations(text: str, labels: list[str], aliases: dict[str, str] | None = None) -> tuple[str, list[str], list[str]]:
    """(text, labels used, unknown ones): [c02] and bracketed source ids become [C2]; repeats in a row of citations go."""
    unknown: list[str] = []

    def one(m: re.Match[str]) -> str:
        raw = m[1].strip()
        number = re.fullmatch(r"[Cc](\d+)", raw)
        name = f"C{int(number[1])}" if number else (aliases or {}).get(raw)
        if name is None:
            return m[0]
        if name not in labels:
            unknown.append(name)
        return f"[{name}]"

    text = re.sub(r"\[([^\[\],]+)\]", one, re.sub(r"\[(\s*[Cc]\d+\s*(?:,\s*[Cc]\d+\s*)+)\]", lambda m: "".join(f"[{x.strip()}]" for x in m[1].split(",")), text))
    text = re.sub(r"(?:\s*\[C[1-9]\d*\]){2,}", lambda m: " " + " ".join(f"[{x}]" for x in dict.fromkeys(re.findall(r"C[1-9]\d*", m[0]))), text).strip()
    return text, list(dict.fromkeys(re.findall(r"\[(C[1-9]\d*)\]", text))), list(dict.fromkeys(unknown))


def infer_headings(text: str) -> list[tuple[int, str, int, float]]:
    """(offset, title, level, confidence): numbered, named and upper-case heading lines; inside references only an appendix counts."""
    found: list[tuple[int, str, int, float]] = []
    seen: set[str] = set()
    at, references = 0, False
    for raw in text.splitlines(keepends=True):
        line = " ".join(raw.split())
        low = re.sub(r"[^a-z ]", "", line.lower()).strip()
        number = re.fullmatch(r"(\d+(?:\.\d+)*)[.)]?\s+([A-Za-z].{1,100})", line)
        hit = None
        if number and not number[2].endswith((".", ";", ",")) and len(number[2].split()) <= 12 and number[2][0].isupper():
            hit = (number[2], min(6, number[1].count(".") + 1), 0.95)
        elif low in HEADINGS and line:
            hit = (low.title(), 1, 0.98)
        elif 2 <= len(line.split()) <= 10 and len(line) <= 80 and line.upper() == line and any(c.isalpha() for c in line) and not line.endswith((".", ",", ";")) and sum(c.isdigit() for c in line) <= 4:
            hit = (line.title(), 1, 0.72)
        if hit:
            role = re.sub(r"[^a-z ]", "", hit[0].lower()).strip()
            if role == "appendix" or not references:
                references = role == "references"
                if role not in seen:
                    seen.add(role)
                    found.append((at, *hit))
        at += len(raw)
    return found


def tables(text: str) -> list[tuple[int, str, list[str], list[list[str]]]]:
    """(offset, caption, headers, rows) of pipe tables with a rule below the head, and of runs of equally wide tab or comma lines."""
    lines: list[tuple[int, str]] = []
    at = 0
    for raw in text.splitlines(keepends=True):
        lines.append((at, raw.rstrip("\r\n")))
        at += len(raw)
    pipe = lambda s: [c.strip() for c in s.strip().strip("|").split("|")] if s.strip().startswith("|") and s.strip().endswith("|") and len(s.strip()) > 1 else None
    split = lambda s: [c.strip() for c in s.split("\t")] if "\t" in s else [c.strip() for c in s.split(",")] if s.count(",") >= 2 else None
    caption = lambda k: lines[k - 1][1].strip() if k and re.match(r"(?i)\s*(?:table|tab\.)\s+\d+", lines[k - 1][1]) else ""
    found, k = [], 0
    while k < len(lines):
        head = pipe(lines[k][1])
        rule = pipe(lines[k + 1][1]) if head and k + 1 < len(lines) else None
        if rule and all(re.fullmatch(r":?-+:?", c) for c in rule):
            end = k + 2
            while end < len(lines) and pipe(lines[end][1]) is not None:
                end += 1
            rows = [pipe(s) for _, s in lines[k + 2 : end]]
            if rows and all(len(r) == len(head) for r in rows):
                found.append((lines[k][0], caption(k), head, rows))
            k = end
            continue
        end = k
        while end < len(lines) and pipe(lines[end][1]) is None and split(lines[end][1]) is not None:
            end += 1
        if end - k >= 2:
            rows = [split(s) for _, s in lines[k:end]]
            if len({len(r) for r in rows}) == 1 and len(rows[0]) > 1:
                found.append((lines[k][0], caption(k), rows[0], rows[1:]))
        k = max(end, k + 1)
    return found


def equations(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, number, text): display and inline mathematics and operator lines outside fences; the earliest, then the kind listed first, wins an overlap."""
    found = [(*m.span(), p) for p, rx in enumerate(DISPLAYS) for m in re.finditer(rx, text, re.S)]
    at, fenced = 0, False
    for raw in text.splitlines(keepends=True):
        bare = raw.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif bare and not fenced and len(bare) <= 500 and re.search(OPERATORS, bare):
            numbered = re.search(r"\\tag\{[^}]+\}|\(\d+[a-z]?\)\s*$", bare)
            if numbered or len(re.findall(SYMBOLS, bare)) >= 2:
                start = at + len(raw) - len(raw.lstrip())
                found.append((start, start + len(bare), len(DISPLAYS)))
        at += len(raw)
    out: list[tuple[int, int, str, str]] = []
    for a, b, _ in sorted(found, key=lambda x: (x[0], x[2], x[0] - x[1])):
        if not out or a >= out[-1][1]:
            body = text[a:b]
            number = re.search(r"\\tag\{([^}]+)\}", body) or re.search(r"\((\d+[a-z]?)\)\s*(?:\$\$|\\\])?\s*$", body)
            out.append((a, b, number[1] if number else "", re.sub(r"\s+", " ", body.replace("−", "-").replace("‐", "-"))))
    return out


def symbols(text: str) -> list[str]:
    """LaTeX, Greek and single-letter names of an equation, in order, without operators."""
    skip = {"\\argmax", "\\argmin", "\\cdot", "\\frac", "\\geq", "\\leq", "\\log", "\\odot", "\\prod", "\\sum", "\\tag"}  # fixed values
    found = re.findall(r"\\[A-Za-z]+(?:_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]+))?|[α-ωΑ-Ω](?:_[A-Za-z0-9{}]+)?|(?<![A-Za-z\\])[A-Za-z](?:_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]+))?(?![A-Za-z])", text)
    return [s for s in dict.fromkeys(found) if s.split("_")[0] not in skip]


def per_text(docs: DataFrame, function, id_col: str, text_col: str, names: list[str], schema: str) -> DataFrame:
    """Rows of function(text) for every text, behind its id; values of lists are joined by ` | `."""

    def flat(v):
        return " | ".join(flat(x) for x in v) if isinstance(v, list) else v if isinstance(v, (int, float, str)) else str(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *[flat(v) for v in (r if isinstance(r, tuple) else (r,))]) for i, t in zip(pdf["i"], pdf["t"], strict=True) for r in function(t)]
            yield pd.DataFrame(rows, columns=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"id {kind}, {schema}")


def highlight(text, terms: list[str]):
    """Terms wrapped in double brackets, by whole words without regard to case."""
    if not terms:
        return text
    return F.regexp_replace(text, r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])", "[[$1]]")


def same_text(a, b):
    return casefold(F.trim(F.regexp_replace(a, r"\s+", " "))) == casefold(F.trim(F.regexp_replace(b, r"\s+", " ")))
