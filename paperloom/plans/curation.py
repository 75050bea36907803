"""Queries over duplicates, splits, trust, audits and calibration.

Reviews that the tables lack are derived from them: a label's quality is the human decision, and
the confidence of the automatic one is a hash of its doc_id, so it is a stand-in with a fixed spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import curation as C
from paperloom.operators import dedup as D
from paperloom.operators.index import read


def _records(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents", "doc_id", "lang", "source"), "doc_id")
    step = F.conv(F.substring(F.sha2(F.concat(F.lit("confidence:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 5001
    confidence = (5000 + step) / 10000.0
    return rows.select("doc_id", "lang", "source", "toxic", confidence.alias("confidence"), (confidence >= 0.9).alias("automatic"), (F.col("quality") == 1).alias("human"))


def exact_identity(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each normalised text and how many share it."""
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", D.identity(F.col("text")).alias("identity"))
    return docs.groupBy("identity").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def near_duplicates(spark, d):
    return D.near_duplicates(read(spark, d, "documents", "doc_id", "text"))


def hash_split(spark, d):
    return read(spark, d, "documents", "doc_id").select("doc_id", C.hash_split(F.col("doc_id")).alias("split"))


def quota_split(spark, d):
    return C.quota_split(read(spark, d, "documents", "source"), "source")


def coalesced_split(spark, d):
    """Documents of one text share the split of the smallest id among them."""
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", D.identity(F.col("text")).alias("identity"))
    first = docs.groupBy("identity").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "identity").select("doc_id", C.hash_split(F.col("first")).alias("split"))


def split_leakage(spark, d):
    """Texts whose documents the plain split puts apart; the coalesced split has none."""
    docs = read(spark, d, "documents", "doc_id", "text").select(D.identity(F.col("text")).alias("identity"), C.hash_split(F.col("doc_id")).alias("split"))
    return docs.groupBy("identity").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n_docs")).where("n_splits > 1")


def _examples(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents", "doc_id", "text"), "doc_id")
    status = F.when(F.col("doc_id") % 4 == 0, "codex_curated").when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "codex_approved").otherwise("human_approved")
    return rows.select(F.col("doc_id").alias("example_id"), status.alias("status"), (F.col("doc_id") % 3 == 0).alias("audited"), (F.col("doc_id") % 7 == 0).alias("circular"), D.identity(F.col("text")).alias("cluster_id"))


def trust_filter(spark, d):
    rows = _examples(spark, d).where(C.eligible(F.col("status"), F.col("audited"), F.col("circular"), "human-and-audited"))
    return rows.select("example_id", "status", C.weight(F.col("status"), F.col("audited")).alias("weight"))


def trust_representatives(spark, d):
    rows = _examples(spark, d).where(C.eligible(F.col("status"), F.col("audited"), F.col("circular"), "all-trusted"))
    return C.representatives(rows.withColumn("weight", C.weight(F.col("status"), F.col("audited"))))


def audit_sample(spark, d):
    rows = _records(spark, d).select(F.col("doc_id").alias("example_id"), "confidence", (F.col("automatic") != F.col("human")).alias("disagreement"), (F.col("toxic") == 1).alias("novel"))
    return C.audit_sample(rows)


def calibration_report(spark, d):
    return C.calibration(_records(spark, d))


def calibration_by_language(spark, d):
    return C.calibration(_records(spark, d), "lang")


def calibration_bins(spark, d):
    return C.confidence_bins(_records(spark, d))


def readiness_gates(spark, d):
    return C.gates(C.calibration(_records(spark, d)))


def threshold_recommendation(spark, d):
    return C.recommended_threshold(_records(spark, d), 0.3)


def diversity_counts(spark, d):
    """Counts by several single keys, as grouping sets."""
    rows = read(spark, d, "documents", "doc_id", "lang", "source").join(read(spark, d, "labels"), "doc_id", "left")
    parts = [rows.groupBy(F.coalesce(F.col(k).cast("string"), F.lit("unlabelled")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(k).alias("dimension"), "value", "n") for k in ("lang", "source", "quality", "toxic")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def diversity_warnings(spark, d):
    docs = read(spark, d, "documents", "lang", "source")
    row = docs.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))
    top = docs.groupBy("source").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"))
    flags = F.filter(F.array(F.when(F.col("n") == 0, "empty"), F.when(F.col("langs") < 5, "few_languages"), F.when(F.col("sources") < 3, "few_sources"), F.when(F.col("most") > 0.6 * F.col("n"), "one_source")), lambda x: x.isNotNull())
    return row.crossJoin(top).select("n", F.array_join(flags, ",").alias("warnings"))


def round_robin(spark, d):
    return C.round_robin(read(spark, d, "documents", "doc_id", "source"), "source", "doc_id")


def type_cap(spark, d):
    """At most twelve events of a type and user, first ones first."""
    events = read(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    return C.capped(events, ["user_id", "event_type"], ["ts", "event_id"], 12).select("event_id", "user_id", "event_type", "k")


_I = "sha256(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r]+', ' ', 'g')))"
_U = lambda c, seed=0: f"(('0x' || substr(sha256('{seed}:' || {c}), 1, 13))::bigint / 4503599627370496.0::double)"
_SPLIT = lambda c: f"CASE WHEN {_U(c)} < 0.15::double THEN 'test' WHEN {_U(c)} < 0.3::double THEN 'validation' ELSE 'train' END"
_R = """r AS (SELECT doc_id, lang, source, toxic, quality = 1 AS human, (5000 + ('0x' || substr(sha256('confidence:' || doc_id), 1, 8))::bigint % 5001)::double / 10000.0::double AS confidence
 FROM labels JOIN documents USING (doc_id)), rec AS (SELECT *, confidence >= 0.9::double AS automatic FROM r)"""
_CAL = """n, tp, fp, tn, fn, round((tp + tn)::double / n, 6) AS agreement, round((fp + fn)::double / n, 6) AS override_rate, round(CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN fp::double / (tp + fp) ELSE 0 END, 6) AS false_approval_rate,
 round(brier / n, 6) AS brier_score, round(CASE WHEN near > 0 THEN near_wrong::double / near ELSE 0 END, 6) AS near_threshold_error_rate"""
_SUMS = """count(*) AS n, count(*) FILTER (WHERE automatic AND human) AS tp, count(*) FILTER (WHERE automatic AND NOT human) AS fp, count(*) FILTER (WHERE NOT automatic AND NOT human) AS tn,
 count(*) FILTER (WHERE NOT automatic AND human) AS fn, sum(power(confidence - human::int, 2)) AS brier, count(*) FILTER (WHERE abs(confidence - 0.95::double) <= 0.02::double + 1e-12) AS near,
 count(*) FILTER (WHERE abs(confidence - 0.95::double) <= 0.02::double + 1e-12 AND automatic <> human) AS near_wrong"""
_X = f"""x AS (SELECT doc_id AS example_id, CASE WHEN doc_id % 4 = 0 THEN 'codex_curated' WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'codex_approved' ELSE 'human_approved' END AS status,
 doc_id % 3 = 0 AS audited, doc_id % 7 = 0 AS circular, {_I} AS cluster_id FROM labels JOIN documents USING (doc_id))"""
_W = "CASE WHEN status = 'human_approved' THEN 1.0::double WHEN status = 'codex_curated' THEN 0.85::double WHEN audited THEN 0.9::double ELSE 0.6::double END"

QUERIES = {
    f.__name__: f
    for f in (
        exact_identity, near_duplicates, hash_split, quota_split, coalesced_split, split_leakage, trust_filter, trust_representatives, audit_sample, calibration_report,
        calibration_by_language, calibration_bins, readiness_gates, threshold_recommendation, diversity_counts, diversity_warnings, round_robin, type_cap,
    )
}
SQL = {
    "exact_identity": f"SELECT {_I} AS identity, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "near_duplicates": """WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS words FROM documents),
        c AS MATERIALIZED (SELECT words, min(doc_id) AS class_id, len(words) AS n FROM t GROUP BY words),
        l AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b FROM c a JOIN c b ON a.class_id < b.class_id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)
          WHERE len(list_intersect(a.words, b.words)) >= 0.9::double * (a.n + b.n - len(list_intersect(a.words, b.words))) - 1e-9),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        w(node, root) AS (SELECT class_id, class_id FROM c UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node),
        r AS (SELECT node, min(root) AS root FROM w GROUP BY node), k AS (SELECT a AS class_id, count(*) AS n_links FROM e GROUP BY a)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, root AS component_id FROM t JOIN c USING (words) LEFT JOIN k USING (class_id) JOIN r ON r.node = class_id""",
    "hash_split": f"SELECT doc_id, {_SPLIT('doc_id')} AS split FROM documents",
    "quota_split": """WITH u AS (SELECT DISTINCT source AS id FROM documents), k AS (SELECT id, row_number() OVER (ORDER BY sha256('42:' || id), id) AS k, count(*) OVER () AS n FROM u),
        q AS (SELECT *, greatest(1, round_even(n * 0.15, 0)) AS t FROM k) SELECT id, CASE WHEN k <= t THEN 'test' WHEN k <= 2 * t THEN 'validation' ELSE 'train' END AS split FROM q""",
    "coalesced_split": f"WITH i AS (SELECT doc_id, {_I} AS identity FROM documents), f AS (SELECT identity, min(doc_id) AS first FROM i GROUP BY 1) SELECT doc_id, {_SPLIT('first')} AS split FROM i JOIN f USING (identity)",
    "split_leakage": f"SELECT {_I} AS identity, count(DISTINCT {_SPLIT('doc_id')}) AS n_splits, count(*) AS n_docs FROM documents GROUP BY 1 HAVING n_splits > 1",
    "trust_filter": f"WITH {_X} SELECT example_id, status, {_W} AS weight FROM x WHERE status = 'human_approved' OR (status = 'codex_approved' AND NOT circular AND audited)",
    "trust_representatives": f"""WITH {_X}, y AS (SELECT *, {_W} AS weight FROM x WHERE status IN ('human_approved', 'codex_curated') OR (status = 'codex_approved' AND NOT circular)),
        z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE status WHEN 'human_approved' THEN 0 WHEN 'codex_curated' THEN 1 ELSE 2 END, weight DESC, example_id) AS k FROM y)
        SELECT cluster_id, example_id, status, weight FROM z WHERE k = 1""",
    "audit_sample": f"""WITH {_R}, m AS (SELECT doc_id AS example_id, concat_ws(',', CASE WHEN abs(confidence - 0.95::double) <= 0.02::double + 1e-12 THEN 'near_threshold' END,
          CASE WHEN automatic <> human THEN 'reviewer_disagreement' END, CASE WHEN toxic = 1 THEN 'novel_failure' END) AS reasons FROM rec),
        k AS (SELECT *, row_number() OVER (PARTITION BY reasons = '' ORDER BY sha256('42:' || example_id), example_id) AS k, count(*) OVER () AS n, count(*) FILTER (WHERE reasons <> '') OVER () AS must FROM m)
        SELECT example_id, CASE WHEN reasons = '' THEN 'deterministic_random_sample' ELSE reasons END AS reasons FROM k WHERE reasons <> '' OR k <= ceil(n * 0.1) - must""",
    "calibration_report": f"WITH {_R}, s AS (SELECT {_SUMS} FROM rec) SELECT {_CAL} FROM s",
    "calibration_by_language": f"WITH {_R}, s AS (SELECT lang, {_SUMS} FROM rec GROUP BY lang) SELECT lang, {_CAL} FROM s",
    "calibration_bins": f"""WITH {_R}, b(label, lower, upper) AS (VALUES {', '.join(f"('{t}', {a}::double, {b}::double)" for a, b, t in C.BUCKETS)})
        SELECT label, count(confidence) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(human::int), 6) AS approval_rate,
          round(CASE WHEN count(*) FILTER (WHERE automatic) > 0 THEN (count(*) FILTER (WHERE automatic AND NOT human))::double / count(*) FILTER (WHERE automatic) ELSE 0 END, 6) AS false_approval_rate
        FROM b LEFT JOIN rec ON confidence >= lower AND confidence < upper GROUP BY label""",
    "readiness_gates": f"""WITH {_R}, s AS (SELECT {_SUMS} FROM rec), c AS (SELECT {_CAL} FROM s), g AS (SELECT n, concat_ws(',', CASE WHEN n < 100 THEN 'minimum_pairs' END,
          CASE WHEN tp + fp < 20 THEN 'minimum_auto_approval_candidates' END, CASE WHEN agreement < 0.95 THEN 'agreement' END, CASE WHEN override_rate > 0.05 THEN 'override_rate' END,
          CASE WHEN precision < 0.95 THEN 'auto_approval_precision' END, CASE WHEN false_approval_rate > 0.05 THEN 'false_approval_rate' END,
          CASE WHEN near_threshold_error_rate > 0.1 THEN 'near_threshold_error_rate' END) AS failed FROM c)
        SELECT n, CASE WHEN n < 100 THEN 'calibration_required' WHEN failed <> '' THEN 'auto_approval_suspended' ELSE 'calibration_active' END AS state, failed FROM g""",
    "threshold_recommendation": f"WITH {_R} SELECT min(a.confidence) AS threshold FROM (SELECT DISTINCT confidence FROM rec) a WHERE (SELECT avg((NOT human)::int) FROM rec b WHERE b.confidence >= a.confidence) <= 0.3",
    "diversity_counts": " UNION ALL ".join(f"SELECT '{k}' AS dimension, coalesce({k}::varchar, 'unlabelled') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2" for k in ("lang", "source", "quality", "toxic")),
    "diversity_warnings": """SELECT n, concat_ws(',', CASE WHEN n = 0 THEN 'empty' END, CASE WHEN langs < 5 THEN 'few_languages' END, CASE WHEN sources < 3 THEN 'few_sources' END, CASE WHEN most > 0.6 * n THEN 'one_source' END) AS warnings
        FROM (SELECT count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, (SELECT max(k) FROM (SELECT count(*) AS k FROM documents GROUP BY source)) AS most FROM documents)""",
    "round_robin": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::varchar), doc_id) AS turn FROM documents",
    "type_cap": "SELECT event_id, user_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k <= 12",
}
