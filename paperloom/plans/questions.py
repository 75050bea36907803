"""Queries over question candidates, claim types, section roles and ingestion health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import index as I
from paperloom.operators import questions as Q
from paperloom.operators.answering import HEADINGS
from paperloom.operators.curation import PRIORITY
from paperloom.plans import papers as P


def canonical_roles(spark: SparkSession, d: str) -> DataFrame:
    return P.sections(spark).select("paper", "ordinal", Q.normalized_heading(F.col("heading")).alias("normalized"), Q.canonical_role(F.col("heading")).alias("role"))


def claim_types(spark, d):
    """Every benchmark item's atomic claims with their types."""
    texts = I.read(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("id"), "text")
    return Q.atomic_claims(texts).select("id", "k", "claim", Q.claim_type(F.col("claim")).alias("claim_type"))


def authored_claims(spark, d):
    texts = P.sections(spark).select(F.concat_ws(":", "paper", "ordinal").alias("id"), "text")
    return Q.atomic_claims(texts).select("id", "k", "claim", Q.claim_type(F.col("claim")).alias("claim_type"))


def _papers(spark):
    rows = P.sections(spark)
    titles = rows.where("ordinal = 0").select("paper", F.col("heading").alias("title"))
    texts = rows.groupBy("paper").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return titles.join(texts, "paper")


def question_candidates(spark, d):
    return Q.candidates(_papers(spark), spark)


def review_order(spark, d):
    """Candidates of all papers by priority."""
    return question_candidates(spark, d).select("paper", "position", Q.priority(F.col("question_type")).cast("long").alias("priority"))


def ingestion_health(spark, d):
    """Languages as papers and documents as their sections; the source stands for a heading."""
    rows = I.read(spark, d, "documents", "lang", "source", "text").select(F.col("lang").alias("paper"), F.when(F.col("source") == "src3", "").otherwise(F.col("source")).alias("heading"), "text")
    return Q.ingestion_health(rows)


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(heading), '^[0-9.]+\\s*', ''), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
_ORDER = sorted(HEADINGS, key=lambda h: (-len(h), HEADINGS.index(h)))
_CLAIMS = """s0 AS (SELECT id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM src),
s1 AS (SELECT id, unnest(range(len(ss))) AS s, unnest(ss) AS sentence FROM s0),
s2 AS (SELECT id, s, string_split(regexp_replace(sentence, '\\s*;\\s*|\\s*,\\s+(while|whereas|but)\\b', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM s1 WHERE NOT starts_with(ltrim(sentence), '#')),
s3 AS (SELECT id, s, unnest(range(len(ps))) AS p, unnest(ps) AS claim FROM s2),
s4 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s, p) - 1 AS k, trim(claim) AS claim FROM s3 WHERE trim(claim) <> '')"""
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(claim, '{p}') THEN '{n}'" for n, p in Q.CLAIM_TYPES) + " ELSE 'factual' END AS claim_type"
_PAPERS = f"""{P._SEC}, pa AS (SELECT paper, max(CASE WHEN ordinal = 0 THEN heading END) AS title, replace(lower(string_agg(text, chr(10) ORDER BY ordinal)), 'ß', 'ss') AS low FROM sec GROUP BY paper)"""
_CAND = f"""{_PAPERS}, te AS (SELECT * FROM {P._values([(i, t, q) for i, (t, q) in enumerate(Q.TEMPLATES)], 'n, question_type, template')}),
tt AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY n) AS turn, min(n) OVER (PARTITION BY question_type) AS first FROM te),
gr AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY turn, first) AS position FROM pa CROSS JOIN tt WHERE {' AND '.join(f"(question_type <> '{t}' OR {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in ws)})" for t, ws in Q.TOPICS.items())})"""

QUERIES = {f.__name__: f for f in (canonical_roles, claim_types, authored_claims, question_candidates, review_order, ingestion_health)}
SQL = {
    "canonical_roles": f"WITH {P._SEC}, x AS (SELECT paper, ordinal, {_NORM} AS normalized FROM sec) SELECT paper, ordinal, normalized, CASE {' '.join(f'WHEN normalized = {chr(39)}{h}{chr(39)} THEN {chr(39)}{h}{chr(39)}' for h in HEADINGS)} "
    + " ".join(f"WHEN contains(' ' || normalized || ' ', ' {h} ') THEN '{h}'" for h in _ORDER)
    + " END AS role FROM x",
    "claim_types": f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {_CLAIMS} SELECT id, k, claim, {_TYPE} FROM s4",
    "authored_claims": f"WITH {P._SEC}, src AS (SELECT paper || ':' || ordinal AS id, text FROM sec), {_CLAIMS} SELECT id, k, claim, {_TYPE} FROM s4",
    "question_candidates": f"""WITH {_CAND} SELECT paper, position, question_type, CASE question_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.ANSWERABILITY.items())} ELSE 'answerable' END AS answerability,
        replace(template, '{{title}}', title) AS question FROM gr WHERE position <= 12""",
    "review_order": f"WITH {_CAND} SELECT paper, position, CASE question_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in PRIORITY.items())} ELSE 7 END::bigint AS priority FROM gr WHERE position <= 12",
    "ingestion_health": """WITH s AS (SELECT lang AS paper, CASE WHEN source = 'src3' THEN '' ELSE source END AS heading, text FROM documents),
        x AS (SELECT paper, count(*) AS n, count(*) FILTER (WHERE heading = '') AS bare, count(*) - count(DISTINCT text) AS again, sum(length(text)) AS chars FROM s GROUP BY paper)
        SELECT paper, n AS n_sections, round(bare::double / n, 6) AS untitled, round(again::double / n, 6) AS duplicates, round(chars::double / n, 6) AS mean_length,
          bare::double / n <= 0.25 AND again::double / n <= 0.5 AND chars::double / n >= 20 AS healthy FROM x""",
}
