"""Queries over question concepts, evidence, grades and review diagnostics.

The tables hold no reviews: reviewers, outcomes and gold labels that they lack are hashes of doc_id,
named as such by `_pick`.  Texts, turns, vectors, urls and labels are those of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import evaluation as E
from paperloom.operators import index as I
from paperloom.operators import retrieval as R
from paperloom.operators.curation import hash_split
from paperloom.operators.index import read
from paperloom.plans import curation as PC
from paperloom.plans import search as PS


def _pick(key: str, n: int, c=None):
    """A number below n that stands in for what the tables lack."""
    c = F.col("doc_id") if c is None else c
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}:"), c.cast("string")), 256), 1, 8), 16, 10).cast("long") % n


def _of(key: str, values, c=None):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_pick(key, len(values), c) + 1).cast("int"))


def _sql_pick(key: str, n: int, c: str = "doc_id") -> str:
    return f"(('0x' || substr(sha256('{key}:' || {c}), 1, 8))::bigint % {n})"


def _sql_of(key: str, values, c: str = "doc_id") -> str:
    return f"{T.quoted(values)}[{_sql_pick(key, len(values), c)} + 1]"


def question_concepts(spark: SparkSession, d: str) -> DataFrame:
    found = E.concepts(F.col("text"))
    join = lambda c: F.array_join(c, " ")
    return read(spark, d, "benchmark", "item_id", "text").select("item_id", *[join(found[k]).alias(k) for k in ("essential", "optional", "entities", "numbers")], found["intent"].alias("intent"))


def metadata_filter(spark, d):
    docs = read(spark, d, "documents", "doc_id", "source", "lang").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"), F.col("lang").alias("media_type"))
    return E.metadata_filter(docs, media_type="en", source_name="src1").select("document_id")


def _url_paths(spark, d):
    return read(spark, d, "pages", "page_id", "url").select("page_id", F.filter(F.split(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "").alias("path"))


def heading_prefix(spark, d):
    """Pages below /en, the parts of their paths read as headings."""
    return _url_paths(spark, d).where(E.heading_prefix(F.col("path"), ["en"])).select("page_id")


def evidence_eligibility(spark, d):
    """The twenty best documents of each query that hold one of its essential terms and score at least 2."""
    terms, items = PS._terms(spark, d), PS._items(spark, d)
    hits = R.bm25_contributions(terms, PS._queries(spark, d)).groupBy("query_id", "doc_id").agg(F.round(F.sum("contribution"), 6).alias("score"), F.collect_set("term").alias("matched"))
    essential = items.select(F.col("item_id").alias("query_id"), E.concepts(F.col("text"))["essential"].alias("essential"))
    best = R.rank(hits, 20).join(essential, "query_id").where(E.evidence_eligible(F.col("score"), F.col("matched"), F.col("essential"), 2.0))
    return best.select("query_id", "rank", "doc_id", "score")


TYPES = ("metadata", "equation", "result", "complexity", "limitation", "derivation", "critical_reasoning", "hyperparameter", "historical_impact")


def allowed_types(spark, d):
    """Documents with a question type each, without the types that are pending."""
    return read(spark, d, "documents", "doc_id").select("doc_id", _of("type", TYPES).alias("question_type")).where(E.type_allowed(F.col("question_type")))


def citation_display(spark, d):
    """Every document's citation: pages for some, lines for the others."""
    docs = read(spark, d, "documents", "doc_id", "source", "lang", "text")
    page = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7 + 1)
    lines = F.size(F.split("text", "\n", -1))
    shown = E.citation_display(F.col("source"), page, page + F.col("doc_id") % 2, F.lit(1), lines, F.filter(F.array(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "part")), lambda x: x.isNotNull()))
    return docs.select("doc_id", shown.alias("citation"))


def _turns(spark, d):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return read(spark, d, "conversations").withColumn("before", before)


def fact_presence(spark, d):
    """Whether a turn states the first four words of the turn before it."""
    fact = F.array_join(F.slice(F.split("before", " "), 1, 4), " ")
    return _turns(spark, d).where("before <> ''").select("conv_id", "turn", E.fact_present(F.col("text"), fact).alias("present"))


def formatted_citations(spark, d):
    """A turn's label, cited together with the first one of its conversation."""
    label = F.concat(F.lit("C"), (F.col("turn") + 1).cast("string"))
    return read(spark, d, "conversations").select("conv_id", "turn", E.format_citations(F.array_distinct(F.array(F.lit("C1"), label))).alias("citations"))


def retrieval_grades(spark, d):
    """The five nearest other vectors of each asked one; the same label is relevant, in grades of one and two."""
    found = PS.vector_cosine(spark, d).where("query_id <> doc_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    labels = read(spark, d, "embeddings", "vec_id", "label")
    asked = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = asked.join(labels, "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"), (1 + F.col("vec_id") % 2).cast("int").alias("grade"))
    return E.retrieval_grades(found, gold)


def result_redundancy(spark, d):
    """Four spans of each document, two of which nearly coincide in some, as the results of one query."""
    spans = F.array(*[F.struct(F.lit(r).cast("long").alias("rank"), (F.col("n_chars") * a / 20).cast("long").alias("start"), (F.col("n_chars") * b / 20).cast("long").alias("stop")) for r, a, b in ((1, 0, 10), (2, 1, 11), (3, 9, 20), (4, 0, 3))])
    rows = read(spark, d, "documents", "doc_id", "n_chars").select(F.col("doc_id").alias("query_id"), "doc_id", F.explode(spans).alias("s"))
    return E.redundancy(rows.select("query_id", "doc_id", "s.*"))


def set_metrics(spark, d):
    """The terms of a turn as a prediction of those of the turn before."""
    found = E.set_metrics(T.tokens(F.col("text")), T.tokens(F.col("before")))
    return _turns(spark, d).select("conv_id", "turn", *[c.alias(k) for k, c in found.items()])


def _reviews(spark, d):
    rows = read(spark, d, "labels")
    label = F.when(_pick("pending", 4) == 0, None).when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "should_abstain").otherwise(_of("label", ("incorrect", "partial")))
    return rows.select("doc_id", label.alias("label"))


def review_summary(spark, d):
    return E.review_summary(_reviews(spark, d))


STATUSES = ("accepted", "accepted", "accepted", "rejected", "uncertain", "duplicate")


def curation_report(spark, d):
    rows = read(spark, d, "labels", "doc_id")
    confidence = (7000 + _pick("sure", 3001)) / 10000.0
    return E.curation_report(rows.select(F.col("doc_id").alias("id"), _of("status", STATUSES).alias("status"), confidence.alias("confidence"), (_pick("split", 5) == 0).alias("disagreed"), (_pick("valid", 9) > 0).alias("validated")))


def claim_graph_metrics(spark, d):
    """Conversations as graphs and turns as claims: one that shares a term with the turn before is supported, every third has no citation."""
    rows = _turns(spark, d).select(F.col("conv_id").alias("graph"), F.arrays_overlap(T.tokens(F.col("text")), T.tokens(F.col("before"))).alias("supported"), (F.col("turn") % 3 > 0).alias("cited"))
    return E.claim_graph_metrics(rows)


def prompt_variations(spark, d):
    return E.prompt_variations(read(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("id"), F.col("text").alias("question")))


def evidence_set_hash(spark, d):
    """The turns of a conversation as its evidence."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("C"), (F.col("turn") + 1).cast("string")).alias("label"), F.sha2("text", 256).alias("sha"))
    return E.ordered_hash(rows, "conv_id", "turn", "label", "sha")


def vocabulary_hash(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", E.vocabulary_hash(T.tokens(F.col("text"))).alias("sha256"))


def recorded_reviews(spark, d):
    """Every document is pending; those with an id divisible by 20 are decided."""
    ids = read(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("id"))
    decisions = ids.where("id % 20 = 0").select("id", F.when(F.col("id") % 40 == 0, "approved").otherwise("rejected").alias("status"))
    return E.record_reviews(ids.withColumn("status", F.lit("pending")), decisions)


def labelled_evidence(spark, d):
    """Turns that cite the turns of their conversation, and now and then one that does not exist."""
    turns = read(spark, d, "conversations")
    answers = turns.select(F.col("conv_id").alias("graph"), F.col("turn").alias("claim"), F.concat("text", F.lit(" [C1, C"), (F.col("turn") + 2).cast("string"), F.lit("]")).alias("text"))
    evidence = turns.select(F.col("conv_id").alias("graph"), F.concat(F.lit("C"), (F.col("turn") + 1).cast("string")).alias("label"), F.col("turn").alias("evidence_id"))
    return E.labelled_evidence(answers, evidence)


def evidence_identity(spark, d):
    docs = read(spark, d, "documents", "doc_id", "source", "lang", "text")
    page = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7 + 1)
    name = F.col("doc_id").cast("string")
    found = E.evidence_identity(F.concat(F.lit("doc_"), name), F.concat(F.lit("chunk_"), name), page, page, F.lit(1), F.size(F.split("text", "\n", -1)), F.array("lang", "source"), F.sha2("text", 256))
    return docs.select("doc_id", found.alias("evidence_id"))


OUTCOMES = ("supports", "direct", "partial", "unsupported", "irrelevant", "complete", "other")


def _passes(spark, d):
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("seq")) for r in (*E.CRITICS, "final_adjudicator") for k in (1, 2)])
    rows = read(spark, d, "labels", "doc_id").select("doc_id", F.explode(roles).alias("p")).select("doc_id", "p.*")
    key = F.concat_ws("/", F.col("doc_id").cast("string"), "role", F.col("seq").cast("string"))
    return rows.where((F.col("seq") == 1) | (_pick("again", 2, key) == 0)).select(F.col("doc_id").alias("id"), "role", "seq", _of("outcome", OUTCOMES, key).alias("outcome"))


def reviewer_disagreements(spark, d):
    return E.disagreements(_passes(spark, d)).select("id", F.array_join("categories", ",").alias("categories"))


def adjudications(spark, d):
    """The decision on each labelled document, from its disagreements and stand-in gates."""
    rows = E.disagreements(_passes(spark, d)).withColumnRenamed("id", "doc_id")
    evidence = _of("evidence", ("direct", "partial", "insufficient"))
    decision, found = E.adjudication(_pick("structural", 5) > 0, _pick("support", 4) > 0, evidence, F.lit(0), _pick("ambiguous", 12) == 0, F.size("categories") > 0)
    return rows.select("doc_id", decision.alias("decision"), F.array_join(found, ",").alias("triggers"))


def repair_outcomes(spark, d):
    fields = ("structural", "support", "relevance")
    gates = [[_pick(f"{when}-{f}", 3) > 0 for f in fields] for when in ("before", "after")]
    return read(spark, d, "labels", "doc_id").groupBy(E.repair_outcome(*gates).alias("outcome")).agg(F.count("*").alias("n"))


def risk_categories(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(E.risk_categories(F.col("text")), ",").alias("categories"))


SYSTEMS = ("alpha", "beta")


def circular_provenance(spark, d):
    rows = read(spark, d, "labels", "doc_id")
    validators = F.when(_pick("validators", 3) == 0, F.array(F.lit("gamma"))).otherwise(F.array().cast("array<string>"))
    found = E.circular_warnings(_of("producer", SYSTEMS), F.lit("1"), _of("reviewer", SYSTEMS), F.lit("1"), F.when(_pick("corrected", 2) == 0, _of("corrector", ("alpha", "delta"))), validators)
    return rows.select("doc_id", F.array_join(found, ",").alias("warnings"))


GOLD = ("sufficient", "partially_sufficient", "insufficient", "external_required")


def sufficiency_grades(spark, d):
    """Every turn as an answer; a tenth of them abstain."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text", _of("gold", GOLD, key).alias("gold"), (_pick("abstain", 10, key) == 0).alias("abstained"))
    return rows.select("conv_id", "turn", *[c.alias(k) for k, c in E.sufficiency_grade(F.col("gold"), F.col("text"), F.col("abstained")).items()])


def evidence_integrity(spark, d):
    """A span of each document, some with an end beyond it, a wrong line, another text or no document."""
    docs = read(spark, d, "documents", "doc_id", "text")
    start, stop = F.floor(F.length("text") / 4).cast("int"), F.greatest(F.floor(F.length("text") / 2), F.floor(F.length("text") / 4) + 1).cast("int")
    rows = docs.where(F.length("text") > 0).withColumns({"start": start, "stop": stop, "k": _pick("fault", 8)})
    chosen = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    evidence = rows.select(
        F.col("doc_id").alias("evidence_id"), F.when(F.col("k") == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), "start",
        (F.col("stop") + F.when(F.col("k") == 1, F.length("text")).otherwise(0)).alias("stop"), (T.line_of(F.col("text"), F.col("start")) + (F.col("k") == 2).cast("int")).alias("start_line"),
        T.line_of(F.col("text"), F.col("stop") - 1).alias("end_line"), F.when(F.col("k") == 3, F.concat(chosen, F.lit("!"))).otherwise(chosen).alias("selected"),
    )
    return E.evidence_errors(evidence, docs).groupBy("error").agg(F.count("*").alias("n"))


def tokenizer_comparison(spark, d):
    """Bytes for each token of the character, byte and term tokenizers, by language."""
    docs = read(spark, d, "documents", "lang", "text")
    sums = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("character"), F.sum(F.octet_length("text")).alias("byte"), F.sum(F.size(T.tokens(F.col("text")))).alias("term"))
    rows = sums.unpivot(["lang", "bytes"], ["character", "byte", "term"], "tokenizer", "tokens")
    return rows.select("lang", "tokenizer", F.col("tokens").cast("long").alias("tokens"), F.round(F.col("bytes") / F.col("tokens"), 6).alias("bytes_per_token"))


def dataset_build(spark, d):
    """Representatives of the examples that carry weight, split by hash and counted."""
    kept = PC.trust_representatives(spark, d).where("weight > 0").select(F.col("example_id").alias("doc_id"), "status", "weight")
    rows = kept.select(hash_split(F.col("doc_id")).alias("split"), "status", "weight")
    return rows.groupBy("split", "status").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def dispatched_search(spark, d):
    """Every method of the search over the stored index, three results each."""
    index = PS.stored_index(spark, d)
    found = [R.search(index, PS._queries(spark, d), method, 3).select("query_id", "rank", "doc_id", "score").withColumn("method", F.lit(method)) for method in R.METHODS]
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES = {
    f.__name__: f
    for f in (
        question_concepts, metadata_filter, heading_prefix, evidence_eligibility, allowed_types, citation_display, fact_presence, formatted_citations, retrieval_grades, result_redundancy,
        set_metrics, review_summary, curation_report, claim_graph_metrics, prompt_variations, evidence_set_hash, vocabulary_hash, recorded_reviews, labelled_evidence, evidence_identity,
        reviewer_disagreements, adjudications, repair_outcomes, risk_categories, circular_provenance, sufficiency_grades, evidence_integrity, tokenizer_comparison, dataset_build, dispatched_search,
    )
}

_TURNS = "x AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)"
_CF = "replace(lower({0}), 'ß', 'ss')"
_FLAT = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"
# word boundaries are those of Unicode; the oracle's are of ASCII, so it reads other letters as _ and other signs as blanks
_PLAIN = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}\\p{M}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
_NAMES = f"list_transform(regexp_extract_all({_PLAIN}, '\\b[A-Z][A-Za-z0-9+.-]*\\b'), lambda x: {_CF.format('x')})"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_CONCEPTS = f"""cq AS (SELECT item_id, text, terms, list_filter(terms, lambda x: NOT list_contains({T.quoted(T.INTENT)}, x)) AS strong, list_filter(terms, lambda x: list_contains({T.quoted(T.INTENT)}, x)) AS weak,
 regexp_extract_all({_PLAIN}, '\\b\\d+(?:\\.\\d+)?\\b') AS nums, {_NAMES} AS names, {T.sql_tokens('text')} AS raw FROM qf JOIN benchmark USING (item_id)),
ce AS (SELECT *, CASE WHEN len(strong) > 0 THEN strong ELSE terms END AS essential, CASE WHEN len(strong) > 0 THEN weak ELSE [] END AS optional FROM cq)"""
_PAGE = "(CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 + 1 END)"
_LINES = "len(string_split(text, chr(10)))"


def _family(c: str) -> str:
    return f"CASE WHEN {c} IN {E.PASSING} THEN 'pass' WHEN {c} = 'partial' THEN 'partial' WHEN {c} IN {E.FAILING} THEN 'fail' END"


_KEY = "doc_id || '/' || role || '/' || seq"
_ROLES = ", ".join(f"max(CASE WHEN role = '{r}' THEN fam END) AS {r}" for r in (*E.CRITICS, "final_adjudicator"))
_PASSES = f"""ps AS (SELECT doc_id, role, seq FROM labels, (SELECT unnest({T.quoted((*E.CRITICS, 'final_adjudicator'))}) AS role), (SELECT unnest([1, 2]) AS seq)),
pr AS (SELECT doc_id, role, seq, {_sql_of('outcome', OUTCOMES, _KEY)} AS outcome FROM ps WHERE seq = 1 OR {_sql_pick('again', 2, _KEY)} = 0),
pl AS (SELECT doc_id, role, arg_max(outcome, seq) AS outcome FROM pr GROUP BY ALL), pf AS (SELECT doc_id, role, {_family('outcome')} AS fam FROM pl),
pv AS (SELECT doc_id, {_ROLES} FROM pf GROUP BY doc_id),
pw AS (SELECT *, list_filter([{', '.join(E.CRITICS)}], lambda x: x IS NOT NULL) AS votes FROM pv),
pd AS (SELECT *, list_filter([{', '.join(f"CASE WHEN ({a} = 'pass' AND {b} = 'fail') OR ({a} = 'fail' AND {b} = 'pass') THEN '{a}_vs_{b}' END" for a, b in E.CRITIC_PAIRS)},
 CASE WHEN final_adjudicator IS NOT NULL AND len(votes) > 0 AND final_adjudicator <> (CASE WHEN len(votes) = 3 AND votes[2] = votes[3] THEN votes[2] ELSE votes[1] END) THEN 'final_adjudicator_overrides_majority' END],
 lambda x: x IS NOT NULL) AS categories FROM pw)"""
_GATES = [[f"({_sql_pick(f'{when}-{f}', 3)} > 0)" for f in ("structural", "support", "relevance")] for when in ("before", "after")]
_FIXED = " OR ".join(f"(NOT {a} AND {b})" for a, b in zip(*_GATES, strict=True))
_BROKE = " OR ".join(f"({a} AND NOT {b})" for a, b in zip(*_GATES, strict=True))
_GAIN = "(pow(2, {0}) - 1) / log2({1} + 1)"
_CKEY = "conv_id || '/' || turn"

SQL = {
    "question_concepts": f"""WITH {PS._QT}, {_CONCEPTS} SELECT item_id, array_to_string(essential, ' ') AS essential, array_to_string(optional, ' ') AS optional,
        array_to_string(list_filter({_FIRST.format('names')}, lambda x: NOT list_contains({T.quoted(E.QUESTION_WORDS)}, x)), ' ') AS entities, array_to_string({_FIRST.format('nums')}, ' ') AS numbers,
        CASE WHEN list_has_any(terms, {T.quoted(E.ABLATION_WORDS)}) THEN 'ablation' WHEN list_has_any(raw, {T.quoted(E.MECHANISM_WORDS)}) THEN 'mechanism' WHEN len(nums) > 0 THEN 'numerical' ELSE 'lookup' END AS intent FROM ce""",
    "metadata_filter": "SELECT doc_id AS document_id FROM documents WHERE lang = 'en' AND source = 'src1'",
    "heading_prefix": "SELECT page_id FROM pages WHERE list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1] = 'en'",
    "evidence_eligibility": f"""{PS._WITH}, {_CONCEPTS}, hs AS (SELECT query_id, doc_id, round(sum(contribution), 6) AS score, list(term) AS matched FROM c GROUP BY ALL),
        hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs WHERE score > 0)
        SELECT query_id, rank, doc_id, score FROM hr JOIN ce ON ce.item_id = query_id WHERE rank <= 20 AND score >= 2 AND list_has_any(matched, essential)""",
    "allowed_types": f"SELECT * FROM (SELECT doc_id, {_sql_of('type', TYPES)} AS question_type FROM documents) WHERE question_type NOT IN {E.PENDING_TYPES}",
    "citation_display": f"""SELECT doc_id, '[' || source || ', ' || CASE WHEN {_PAGE} IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'p. ' || {_PAGE} ELSE 'pp. ' || {_PAGE} || '–' || ({_PAGE} + 1) END
        WHEN {_LINES} = 1 THEN 'line 1' ELSE 'lines 1–' || {_LINES} END || ', § ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' › part' ELSE '' END || ']' AS citation FROM documents""",
    "fact_presence": f"""WITH {_TURNS}, f AS (SELECT conv_id, turn, text, array_to_string(list_slice(string_split(before, ' '), 1, 4), ' ') AS fact FROM x WHERE before <> ''),
        t AS (SELECT *, {T.sql_tokens('fact')} AS ft, {T.sql_tokens('text')} AS tt FROM f)
        SELECT conv_id, turn, contains({_FLAT.format('text')}, {_FLAT.format('fact')}) OR (NOT regexp_matches(fact, '[=<>]') AND len(ft) > 0 AND list_has_all(tt, ft)) AS present FROM t""",
    "formatted_citations": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN '[C1]' ELSE '[C1, C' || (turn + 1) || ']' END AS citations FROM conversations",
    "retrieval_grades": f"""WITH {PS._G}, gg AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1 + b.vec_id % 2 AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        sc AS (SELECT query_id, doc_id, score FROM vt), r AS (SELECT g.query_id, g.rank, score, coalesce(grade, 0) AS gr FROM g JOIN sc USING (query_id, doc_id) LEFT JOIN gg USING (query_id, doc_id)),
        io AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos FROM gg), id AS (SELECT query_id, sum(CASE WHEN pos <= 5 THEN {_GAIN.format('grade', 'pos')} ELSE 0 END) AS ideal, count(*) AS ng FROM io GROUP BY query_id),
        p AS (SELECT query_id, count(*) AS n, sum((gr > 0)::int) AS h, sum((gr > 0 AND rank <= 1)::int) AS h1, sum((gr > 0 AND rank <= 3)::int) AS h3, sum((gr > 0 AND rank <= 5)::int) AS h5, min(CASE WHEN gr > 0 THEN rank END) AS first,
          sum(CASE WHEN gr > 0 THEN rank ELSE 0 END) AS ranks, sum(CASE WHEN rank <= 5 THEN {_GAIN.format('gr', 'rank')} ELSE 0 END) AS dcg, sum((score > 0)::int) AS pos, sum((score > 0 AND gr = 0)::int) AS wrong FROM r GROUP BY query_id)
        SELECT query_id, round(CASE WHEN ng > 0 THEN h1::double / ng ELSE 1 END, 6) AS recall_at_1, round(CASE WHEN ng > 0 THEN h3::double / ng ELSE 1 END, 6) AS recall_at_3, round(CASE WHEN ng > 0 THEN h5::double / ng ELSE 1 END, 6) AS recall_at_5,
          CASE WHEN ng > 0 THEN (h5 > 0)::int::double ELSE 1 END AS hit, round(coalesce(1.0::double / first, 0), 6) AS reciprocal_rank, round(CASE WHEN ng > 0 THEN dcg / ideal ELSE 1 END, 6) AS ndcg,
          round(CASE WHEN ng > 0 THEN (ranks + (ng - h) * (n + 1))::double / ng END, 6) AS mean_relevant_rank, round(CASE WHEN pos > 0 THEN wrong::double / pos ELSE 0 END, 6) AS irrelevant_rate
        FROM p LEFT JOIN id USING (query_id)""",
    "result_redundancy": """WITH s AS (SELECT doc_id, r, (n_chars * a // 20) AS start, (n_chars * b // 20) AS stop FROM documents, (VALUES (1, 0, 10), (2, 1, 11), (3, 9, 20), (4, 0, 3)) v(r, a, b)),
        p AS (SELECT x.doc_id, least(x.stop, y.stop) - greatest(x.start, y.start) AS shared, least(x.stop - x.start, y.stop - y.start) AS shorter FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.r < y.r)
        SELECT doc_id AS query_id, count(*) AS pairs, sum((shorter > 0 AND shared::double / shorter >= 0.8)::int)::bigint AS redundant, round(sum((shorter > 0 AND shared::double / shorter >= 0.8)::int)::double / count(*), 6) AS share FROM p GROUP BY doc_id""",
    "set_metrics": f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, list_distinct({T.sql_tokens('text')}) AS p, list_distinct({T.sql_tokens('before')}) AS e FROM x),
        m AS (SELECT conv_id, turn, len(p) AS n, len(e) AS m, len(list_intersect(p, e)) AS b FROM t),
        q AS (SELECT *, CASE WHEN n = 0 AND m = 0 THEN 1.0::double ELSE b::double / greatest(n, 1) END AS pr, CASE WHEN m = 0 THEN 1.0::double ELSE b::double / m END AS re FROM m)
        SELECT conv_id, turn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1, (n = m AND b = n)::int::double AS exact FROM q""",
    "review_summary": f"""WITH r AS (SELECT CASE WHEN {_sql_pick('pending', 4)} = 0 THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'should_abstain' ELSE {_sql_of('label', ('incorrect', 'partial'))} END AS label FROM labels)
        SELECT count(*) AS records, count(label) AS reviewed, {', '.join(f"count(*) FILTER (WHERE label = '{x}') AS {x}" for x in E.REVIEW_LABELS)},
          round(CASE WHEN count(label) > 0 THEN count(*) FILTER (WHERE label = 'correct')::double / count(label) ELSE 0 END, 6) AS pass_rate,
          round(CASE WHEN count(label) > 0 THEN count(*) FILTER (WHERE label = 'benchmark_problem')::double / count(label) ELSE 0 END, 6) AS problem_rate FROM r""",
    "curation_report": f"""WITH r AS (SELECT doc_id AS id, {_sql_of('status', STATUSES)} AS status, (7000 + {_sql_pick('sure', 3001)})::double / 10000 AS c, {_sql_pick('split', 5)} = 0 AS disagreed, {_sql_pick('valid', 9)} > 0 AS validated FROM labels)
        SELECT count(*) AS records, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'uncertain') AS uncertain,
          count(*) FILTER (WHERE status = 'duplicate') AS duplicates, round(count(*) FILTER (WHERE status = 'accepted')::double / count(*), 6) AS acceptance_rate, round(count(*) FILTER (WHERE status = 'duplicate')::double / count(*), 6) AS duplicate_rate,
          round(count(*) FILTER (WHERE validated)::double / count(*), 6) AS validation_rate, round(count(*) FILTER (WHERE NOT disagreed)::double / count(*), 6) AS agreement, round(avg(c), 6) AS mean_confidence,
          count(*) FILTER (WHERE c < 0.8) AS below_0_80, count(*) FILTER (WHERE c >= 0.8 AND c < 0.9) AS below_0_90, count(*) FILTER (WHERE c >= 0.9 AND c < 0.97) AS below_0_97, count(*) FILTER (WHERE c >= 0.97) AS from_0_97,
          (SELECT id FROM r WHERE status = 'accepted' ORDER BY c DESC, id LIMIT 1) AS strongest, (SELECT id FROM r WHERE status = 'accepted' ORDER BY c, id LIMIT 1) AS weakest FROM r""",
    "claim_graph_metrics": f"""WITH {_TURNS}, c AS (SELECT conv_id AS graph, list_has_any({T.sql_tokens('text')}, {T.sql_tokens('before')}) AS s, turn % 3 > 0 AS k FROM x)
        SELECT graph, count(*) AS claims, count(*) FILTER (WHERE s) AS supported, count(*) FILTER (WHERE NOT s) AS unsupported, count(*) FILTER (WHERE s AND NOT k) AS uncited,
          round(CASE WHEN count(*) FILTER (WHERE s) > 0 THEN count(*) FILTER (WHERE s AND k)::double / count(*) FILTER (WHERE s) ELSE 0 END, 6) AS completeness, round(count(*) FILTER (WHERE s)::double / count(*), 6) AS alignment FROM c GROUP BY graph""",
    "prompt_variations": """WITH b AS (SELECT item_id, text, rtrim(text, '?.') AS base FROM benchmark), v AS (SELECT item_id, text, lower(substr(base, 1, 1)) || substr(base, 2) AS low FROM b)
        SELECT item_id AS parent, k, CASE k WHEN 0 THEN 'Could you explain ' || low || '?' WHEN 1 THEN 'Walk me through this: ' || text WHEN 2 THEN 'In plain language, ' || low || '?' ELSE 'Give a rigorous answer with citations: ' || text END AS question
        FROM v, (SELECT unnest(range(4)) AS k)""",
    "evidence_set_hash": """SELECT conv_id, count(*) AS n, sha256('[' || string_agg('["C' || (turn + 1) || '","' || sha256(text) || '"]', ',' ORDER BY turn) || ']') AS sha256 FROM conversations GROUP BY conv_id""",
    "vocabulary_hash": f"""WITH t AS (SELECT doc_id, list_sort(list_distinct({T.sql_tokens('text')})) AS terms FROM documents)
        SELECT doc_id, sha256('[' || array_to_string(list_transform(terms, lambda x: '"' || x || '"'), ',') || ']') AS sha256 FROM t""",
    "recorded_reviews": "SELECT doc_id AS id, CASE WHEN doc_id % 40 = 0 THEN 'approved' WHEN doc_id % 20 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM documents",
    "labelled_evidence": """WITH c AS (SELECT conv_id AS graph, turn AS claim, unnest(list_distinct(regexp_extract_all(text || ' [C1, C' || (turn + 2) || ']', '\\[C[1-9][0-9]*(?:[ \\t\\n\\r]*,[ \\t\\n\\r]*C[1-9][0-9]*)*\\]'))) AS g FROM conversations),
        l AS (SELECT DISTINCT graph, claim, unnest(regexp_extract_all(g, 'C[0-9]+')) AS label FROM c)
        SELECT graph, claim, label, turn AS evidence_id FROM l LEFT JOIN conversations ON conv_id = graph AND 'C' || (turn + 1) = label""",
    "evidence_identity": f"""SELECT doc_id, 'evidence_' || substr(sha256('{{"chunk_id":"chunk_' || doc_id || '","document_id":"doc_' || doc_id || '","end_line":' || {_LINES} || ',"heading_path":["' || lang || '","' || source || '"],"page_end":' || coalesce({_PAGE}::varchar, 'null')
        || ',"page_start":' || coalesce({_PAGE}::varchar, 'null') || ',"source_hash":"' || sha256(text) || '","start_line":1}}'), 1, 24) AS evidence_id FROM documents""",
    "reviewer_disagreements": f"WITH {_PASSES} SELECT doc_id AS id, array_to_string(categories, ',') AS categories FROM pd",
    "adjudications": f"""WITH {_PASSES}, a AS (SELECT doc_id, list_filter([CASE WHEN {_sql_pick('structural', 5)} = 0 THEN 'citation_structural_failure' END, CASE WHEN {_sql_pick('support', 4)} = 0 THEN 'unsupported_claim' END,
          CASE WHEN {_sql_of('evidence', ('direct', 'partial', 'insufficient'))} = 'insufficient' THEN 'insufficient_evidence' END, CASE WHEN {_sql_pick('ambiguous', 12)} = 0 THEN 'ambiguous_benchmark' END,
          CASE WHEN len(categories) > 0 THEN 'hard_reviewer_disagreement' END], lambda x: x IS NOT NULL) AS t FROM pd)
        SELECT doc_id, CASE WHEN list_contains(t, 'ambiguous_benchmark') THEN 'exclude' WHEN list_contains(t, 'insufficient_evidence') THEN 'abstain_or_reject' WHEN len(t) > 0 THEN 'repair_or_reject' ELSE 'eligible_for_model_adjudication' END AS decision,
          array_to_string(t, ',') AS triggers FROM a""",
    "repair_outcomes": f"SELECT CASE WHEN ({_FIXED}) AND NOT ({_BROKE}) THEN 'fixed' WHEN {_BROKE} THEN 'introduced_new_issue' ELSE 'unchanged' END AS outcome, count(*) AS n FROM labels GROUP BY 1",
    "risk_categories": f"""SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{n}' END" for n, p in E.RISKS)}], lambda x: x IS NOT NULL)), ',') AS categories FROM (SELECT doc_id, {_PLAIN} AS t FROM documents)""",
    "circular_provenance": f"""WITH r AS (SELECT doc_id, {_sql_of('producer', SYSTEMS)} AS p, {_sql_of('reviewer', SYSTEMS)} AS v, CASE WHEN {_sql_pick('corrected', 2)} = 0 THEN {_sql_of('corrector', ('alpha', 'delta'))} END AS c, {_sql_pick('validators', 3)} = 0 AS checked FROM labels)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN p = v AND NOT checked THEN 'same_producer_and_reviewer_without_independent_validation' END, CASE WHEN c = p OR c = v THEN 'correction_system_reuses_producer_or_reviewer' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r""",
    "sufficiency_grades": f"""WITH r AS (SELECT conv_id, turn, {_sql_of('gold', GOLD, _CKEY)} AS gold, {_sql_pick('abstain', 10, _CKEY)} = 0 AS ab, {T.sql_tokens('text')} AS t FROM conversations),
        q AS (SELECT *, ab OR list_has_any(t, {T.quoted(E.QUALIFIERS)}) AS ql, ab OR list_has_any(t, ['external', 'outside', 'later']) AS o FROM r),
        p AS (SELECT *, CASE WHEN ab THEN 'insufficient' WHEN o AND gold = 'external_required' THEN 'external_required' WHEN ql AND gold = 'partially_sufficient' THEN 'partially_sufficient' ELSE 'sufficient' END AS predicted FROM q)
        SELECT conv_id, turn, predicted, (CASE WHEN gold = 'partially_sufficient' AND predicted IN ('partially_sufficient', 'sufficient') THEN ql ELSE predicted = gold END)::int AS correct,
          (gold IN ('insufficient', 'external_required') AND NOT ab AND NOT (gold = 'external_required' AND ql))::int AS false_answer, (gold = 'sufficient' AND ab)::int AS false_abstention,
          (gold <> 'external_required' OR o)::int AS external_recognized, (gold NOT IN ('partially_sufficient', 'external_required') OR ql)::int AS qualified FROM p""",
    "evidence_integrity": f"""SELECT CASE {_sql_pick('fault', 8)} WHEN 0 THEN 'missing_document' WHEN 1 THEN 'range_outside_document' WHEN 2 THEN 'line_mismatch' WHEN 3 THEN 'text_mismatch' END AS error, count(*) AS n
        FROM documents WHERE length(text) > 0 GROUP BY 1""",
    "tokenizer_comparison": f"""WITH s AS (SELECT lang, sum(strlen(text))::bigint AS b, sum(length(text))::bigint AS character, sum(strlen(text))::bigint AS byte, sum(len({T.sql_tokens('text')}))::bigint AS term FROM documents GROUP BY lang)
        SELECT lang, tokenizer, tokens, round(b::double / tokens, 6) AS bytes_per_token FROM (UNPIVOT s ON character, byte, term INTO NAME tokenizer VALUE tokens)""",
    "dataset_build": f"""SELECT split, status, count(*) AS n, round(sum(weight), 6) AS weight FROM ({PC.SQL['trust_representatives']}) r JOIN ({PC.SQL['hash_split']}) h ON h.doc_id = r.example_id WHERE weight > 0 GROUP BY ALL""",
    "dispatched_search": f"""{PS._WITH}, {PS._B}, {PS._F}, m AS (SELECT query_id, doc_id, round(coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0), 9) AS score
        FROM (SELECT * FROM br WHERE rank <= 20) a FULL JOIN (SELECT * FROM tr WHERE rank <= 20) b USING (query_id, doc_id)), mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m)
        SELECT query_id, rank, doc_id, score, 'bm25' AS method FROM br WHERE rank <= 3 UNION ALL SELECT query_id, rank, doc_id, score, 'tfidf' FROM tr WHERE rank <= 3 UNION ALL SELECT query_id, rank, doc_id, score, 'hybrid' FROM mr WHERE rank <= 3""",
}
