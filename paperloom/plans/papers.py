"""Queries over authored paper sections, answers, grades and conversations.

The driver's tables hold no papers, so a few short invented ones are written here; the operators
take tables of any size.  Grades that no table has are fixed functions of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import extract as X
from paperloom.operators import grading as G
from paperloom.operators import index as I
from paperloom.operators import retrieval as R
from paperloom.plans import search as S
from paperloom.sources import documents as D

SECTIONS = [
    ("river", 0, "River Flow Nets", 1, "River Flow Nets. A short invented paper."),
    ("river", 1, "Abstract", 2, "We propose a gated network for river levels. It improves over the linear baseline. We assume stationary inflow."),
    ("river", 2, "2 Method and Algorithm", 2, "1. read the gauges\n2. normalize the levels\n- fit the network\nWe use Adam and minimize squared error. The architecture has 4 layers and 8 attention heads."),
    ("river", 3, "Experiments", 2, "On the Delta Gauge dataset with 1,200 training examples we train for 30 epochs with batch size 64. The learning rate is 0.001 and dropout of 0.1. Accuracy and log loss are reported over 5 runs with seed 7."),
    ("river", 4, "Ablation", 2, "Without gates the learning rate = 0.0005 was needed. Each part reduces error."),
    ("river", 5, "Limitations", 2, "The model does not handle ice. It requires daily gauges. Future work will add snow."),
    ("river", 6, "References", 2, "Ames, B. (2019). Gauges. doi 10.1234/abc.5.\n\nBell, C. 2021. Floods of spring."),
    ("crop", 0, "Crop Yield Lines", 1, "Crop Yield Lines."),
    ("crop", 1, "Summary", 2, "We introduce a regression model for yields! Does rain matter? We show that it does."),
    ("crop", 2, "Data and Setup", 2, "The Field Strip corpus has 300 test examples. We use SGD with learning rate of 0.01 on one CPU. PyTorch was used. MSE is the metric; the random forest baseline is strong."),
    ("crop", 3, "Discussion", 2, "The method fails when fields flood. Under the assumption of finite variance the bound is tight. We plan to test more sites."),
    ("lamp", 0, "Lamp", 1, "No facts here."),
]
ANSWERS = [
    (1, "Gates help [C1]. Depth too [C2, C3]."), (2, "No source is given."), (3, "Twice [C1] and [C1,C10], not [C0] or [c2]."), (4, ""), (5, "[C7]"),
]
MARKDOWN = [
    ("a.md", "intro line\n# Title\nbody\n## Part one\ntext\n```\n# not a heading\n```\n## Part two\nmore\n# Next\nend"), ("b.md", "no headings at all"), ("c.md", "# Only ##\n\n### Deep\nx"),
]


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "paper string, ordinal long, heading string, level int, text string")


def section_roles(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark).select("paper", "ordinal", F.array_join(X.roles(F.col("heading"), F.col("ordinal"), F.col("level")), ",").alias("roles"))


def sentence_spans(spark, d):
    return X.sentences(sections(spark))


def extracted_facts(spark, d):
    return X.facts(sections(spark))


def hyperparameter_conflicts(spark, d):
    found = X.facts(sections(spark)).where(F.col("category").isin([c for c, _ in X.HYPERPARAMETERS]))
    return found.groupBy("paper", "category").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("vs"), F.countDistinct("value").alias("n")).select("paper", "category", F.col("vs").alias("values"), F.when(F.col("n") > 1, "conflicting").otherwise("explicit").alias("validation"))


def reproduction_checklist(spark, d):
    return X.checklist(X.facts(sections(spark)), sections(spark))


def risk_flags(spark, d):
    return X.risk_flags(reproduction_checklist(spark, d))


def paper_comparison(spark, d):
    some = sections(spark).where("paper <> 'lamp'")
    return X.comparison(X.facts(some), some)


def research_gaps(spark, d):
    return X.gaps(X.facts(sections(spark)), sections(spark))


def procedure_steps(spark, d):
    return X.steps(sections(spark))


def reference_lines(spark, d):
    return X.references(sections(spark))


def section_policy(spark, d):
    """Whether each section is expected or forbidden for each question type, and whether it is boilerplate."""
    rows = spark.createDataFrame([(k, list(a), list(b)) for k, (a, b) in G.POLICY.items()], "question_type string, expected array<string>, forbidden array<string>")
    low = T.casefold(F.col("heading"))
    holds = lambda c: F.exists(c, lambda w: F.contains(low, w))
    grid = sections(spark).crossJoin(F.broadcast(rows))  # a fixed list of question types
    return grid.select("paper", "ordinal", "question_type", holds(F.col("expected")).alias("expected"), holds(F.col("forbidden")).alias("forbidden"), holds(T.literal_words(T.BOILERPLATE)).alias("boilerplate"))


def citation_labels(spark, d):
    answers = spark.createDataFrame(ANSWERS, "answer_id long, text string")
    return answers.select("answer_id", F.array_join(T.citation_labels(F.col("text")), ",").alias("labels"), T.strip_citations(F.col("text")).alias("bare"))


def phrase_presence(spark, d):
    """Whether each document's first word, written twice, occurs in it as a phrase or as terms, and whether it negates."""
    docs = I.read(spark, d, "documents", "doc_id", "text")
    word = F.substring_index(F.col("text"), " ", 1)
    return docs.select("doc_id", T.phrase_present(F.col("text"), F.concat(word, F.lit("  "), word)).alias("present"), T.has_negation(T.tokens(F.col("text"))).alias("negated"))


def instruction_profiles(spark, d):
    """Each user turn with up to four user turns before it as context."""
    users = I.read(spark, d, "conversations").where("role = 'user'")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    rows = users.withColumn("context", F.array_join(F.collect_list("text").over(before), " "))
    return rows.select("conv_id", "turn", *[c.alias(n) for n, c in G.profile(F.col("text"), F.col("context")).items()])


def claim_support(spark, d):
    """Every assistant turn as a claim against the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = I.read(spark, d, "conversations").withColumn("evidence", F.coalesce(before, F.lit(""))).where("role = 'assistant'")
    return rows.select("conv_id", "turn", *[c.alias(n) for n, c in G.claim_support(F.col("text"), F.col("evidence")).items()])


def _grades(spark, d):
    k = F.col("doc_id")
    step = lambda a, m: (k * a) % m
    docs = I.read(spark, d, "documents", "doc_id", "lang")
    return docs.select(
        "doc_id", (step(7, 9) - 7).alias("wrong_section"), (step(3, 11) / 11).alias("irrelevant_rate"), (step(5, 6) - 4).alias("missed_gold"), (step(11, 13) - 11).alias("boilerplate"),
        (step(2, 5) - 3).alias("redundancy"), (step(1, 17) == 0).alias("false_answer"), (step(1, 19) == 0).alias("false_abstention"), (step(1, 4) / 4).alias("relevance"),
        (step(1, 5) / 4).alias("completeness"), (step(1, 23) - 21).alias("prohibited"), (step(1, 3) / 2).alias("numerical_accuracy"), (step(1, 8) - 6).alias("missing_required"),
        (step(1, 7) / 4).alias("citation_coverage"), (step(1, 10) / 10).alias("appropriateness"), F.when(F.col("lang") == "en", "beginner").otherwise("researcher").alias("audience"),
        (step(1, 29) == 3).alias("external"),
    )


def failure_taxonomy(spark, d):
    found = _grades(spark, d).select("doc_id", G.failures().alias("f"))
    primary, secondary, confidence = G.root_cause(F.col("f"))
    return found.select("doc_id", F.array_join("f", ",").alias("failures"), primary.alias("primary_cause"), secondary.alias("secondary_causes"), confidence.alias("confidence"))


def failure_counts(spark, d):
    return _grades(spark, d).select(F.explode(G.failures()).alias("failure"), "audience").groupBy("failure").agg(F.count("*").alias("n"), F.sum((F.col("audience") == "beginner").cast("int")).alias("n_beginner"))


def run_comparison(spark, d):
    """BM25 against TF-IDF as two runs: best documents and how many of ten are shared."""
    queries = S._queries(spark, d)
    index = S.stored_index(spark, d)
    one, two = R.search(index, queries, "bm25"), R.search(index, queries, "tfidf")
    both = one.select("query_id", "doc_id", F.col("rank").alias("a")).join(two.select("query_id", "doc_id", F.col("rank").alias("b")), ["query_id", "doc_id"], "full")
    up, down = F.col("b") < F.col("a"), F.col("b") > F.col("a")
    one_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy("query_id").agg(
        one_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), one_if(F.col("b").isNull()).alias("lost"), one_if(F.col("a").isNull()).alias("added"),
        one_if(up).alias("improved"), one_if(down).alias("regressed"), F.max(F.when(F.col("a") == 1, F.col("doc_id")).otherwise(-1)).alias("best_before"),
        F.max(F.when(F.col("b") == 1, F.col("doc_id")).otherwise(-1)).alias("best_after"),
    )


def evidence_sufficiency(spark, d):
    """Coverage and strength of what was found for each query, and whether it suffices."""
    queries = S._queries(spark, d)
    asked = queries.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    found = R.search(S.stored_index(spark, d), queries, "bm25", 4).groupBy("query_id").agg(F.max("score").alias("top"), F.max("matched").alias("matched"), F.count("*").alias("n_evidence"))
    rows = asked.join(found, "query_id", "left").na.fill(0)
    coverage = F.col("matched") / F.col("n_terms")
    score = (coverage + F.col("top") / (1 + F.col("top")) + F.least(F.lit(1.0), F.col("n_evidence") / 4)) / 3
    return rows.select("query_id", F.round(coverage, 6).alias("coverage"), F.round(score, 6).alias("score"), ((coverage >= 0.2) & (F.col("matched") >= 1) & (F.col("n_evidence") >= 1)).alias("sufficient"))


def markdown_sections(spark, d):
    found = D.markdown_sections(spark.createDataFrame(MARKDOWN, "source_path string, text string"))
    return found.select("source_path", "ordinal", "level", "heading", F.array_join("heading_path", " > ").alias("heading_path"), "start_character", "end_character")


def page_documents(spark, d):
    """Benchmark items as pages of one document for each ten of them."""
    pages = I.read(spark, d, "benchmark", "item_id", "text").select(F.floor(F.col("item_id") / 10).cast("long").alias("source"), F.col("item_id").alias("page"), "text")
    found = D.from_pages(pages)
    return found.select("source", "page", "start_character", "end_character", F.sha2("text", 256).alias("sha256"))


def source_paths(spark, d):
    rows = I.read(spark, d, "pages", "page_id", "url")
    return rows.select("page_id", D.normalized_path(F.concat(F.lit(" "), F.replace("url", F.lit("/"), F.lit("\\")))).alias("path"))


def _values(rows, names) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) v({names})"


_SEC = f"sec AS (SELECT paper, ordinal::bigint AS ordinal, heading, level, text FROM {_values(SECTIONS, 'paper, ordinal, heading, level, text')})"
_ROLE = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(heading), '{f}')" for f in fs) + f" THEN '{r}' END" for r, fs in X.ROLES) + "], lambda x: x IS NOT NULL)"
_RL = f"rl AS (SELECT *, CASE WHEN len({_ROLE}) > 0 THEN {_ROLE} WHEN ordinal = 0 AND level = 1 AND heading <> '' THEN ['title'] ELSE ['unknown'] END AS roles FROM sec)"
_SENT = """st0 AS (SELECT paper, ordinal, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM sec),
st AS (SELECT * FROM (SELECT paper, ordinal, unnest(range(len(ss))) AS k, trim(unnest(ss)) AS sentence FROM st0) WHERE sentence <> '')"""
_sq = lambda p: p.replace("'", "''")
_F1 = " UNION ALL ".join(f"SELECT paper, ordinal, '{c}' AS category, unnest(regexp_extract_all(text, '{_sq(p)}', 1)) AS value FROM sec" for c, p in (*X.HYPERPARAMETERS, *X.METHODS))
_F2 = f"SELECT paper, ordinal, 'metric', unnest(list_filter({T.quoted(X.METRICS)}, lambda m: contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || m || ' '))) FROM sec"
_CLAIM = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{t}'" for t, p in X.CLAIMS) + " END"
_F3 = " UNION ALL ".join(
    f"SELECT paper, ordinal, {tag}, sentence FROM st WHERE {test}"
    for tag, test in ((_CLAIM, f"{_CLAIM} IS NOT NULL"), ("'assumption'", f"regexp_matches(sentence, '{X.ASSUMPTION}')"), ("'limitation'", f"regexp_matches(sentence, '{X.LIMITATION}')"))
)
_FACTS = f"{_SEC}, {_RL}, {_SENT}, fa AS (SELECT DISTINCT * FROM ({_F1} UNION ALL {_F2} UNION ALL {_F3}))"
_HP = T.quoted([c for c, _ in X.HYPERPARAMETERS])
_CHECK = f"""ck AS (SELECT paper, item, sum(coalesce(n, 0))::bigint AS n, max(coalesce(list_contains({_HP}, category) AND n > 1, false)) AS clash FROM (SELECT DISTINCT paper FROM sec)
 CROSS JOIN {_values([(name, c) for name, cs in X.CHECKLIST for c in cs], 'item, category')} LEFT JOIN (SELECT paper, category, count(DISTINCT value) AS n FROM fa GROUP BY ALL) USING (paper, category) GROUP BY ALL),
cl AS (SELECT paper, item, CASE WHEN n = 0 THEN 'not_found' WHEN clash THEN 'conflicting' ELSE 'found' END AS status, n AS n_values FROM ck)"""
_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_has = lambda words: f"({_any('now', words)} OR {_any('before', words)})"
_bg = lambda c: "CASE " + " ".join(f"WHEN {_any(c, w)} THEN '{n}'" for n, w in G.BACKGROUND) + " END"
_SIG = " + ".join(
    f"{x}::int"
    for x in [*[_any("before", w) for _, w in G.BACKGROUND], *[_any("now", w) for _, w in G.BACKGROUND], *[_has(w) for w in (G.SIMPLE, G.DEEP, G.CONCISE, G.DERIVE, G.CRITIQUE, G.COMPARE, G.FORMAL)], *[_has(w) for _, w in G.FORMATS]]
)
_fold = lambda c: f"replace(lower({c}), 'ß', 'ss')"
_TRI = "CASE WHEN len({t}) >= 3 THEN list_transform(range(1, len({t}) - 1), lambda i: array_to_string(list_slice({t}, i, i + 2), ' ')) ELSE [] END"
_NEG = T.quoted(T.NEGATIONS)
_GR = """g AS (SELECT doc_id, (doc_id * 7) % 9 - 7 AS wrong_section, ((doc_id * 3) % 11)::double / 11 AS irrelevant_rate, (doc_id * 5) % 6 - 4 AS missed_gold, (doc_id * 11) % 13 - 11 AS boilerplate,
 (doc_id * 2) % 5 - 3 AS redundancy, doc_id % 17 = 0 AS false_answer, doc_id % 19 = 0 AS false_abstention, (doc_id % 4)::double / 4 AS relevance, (doc_id % 5)::double / 4 AS completeness, doc_id % 23 - 21 AS prohibited,
 (doc_id % 3)::double / 2 AS numerical_accuracy, doc_id % 8 - 6 AS missing_required, (doc_id % 7)::double / 4 AS citation_coverage, (doc_id % 10)::double / 10 AS appropriateness,
 CASE WHEN lang = 'en' THEN 'beginner' ELSE 'researcher' END AS audience, doc_id % 29 = 3 AS external FROM documents)"""
_TESTS = (
    ("wrong_section > 0", "retrieval_wrong_section"), ("irrelevant_rate > 0.5", "retrieval_irrelevant_passage"), ("missed_gold > 0", "retrieval_missed_gold_evidence"), ("boilerplate > 0", "retrieval_boilerplate"),
    ("redundancy > 0", "retrieval_redundant"), ("false_answer", "sufficiency_false_positive"), ("false_abstention", "sufficiency_false_negative"), ("relevance < 0.5", "answer_not_relevant"),
    ("completeness < 0.75", "answer_incomplete"), ("prohibited > 0", "answer_overgeneralized"), ("prohibited > 0", "prohibited_claim_present"), ("numerical_accuracy < 1", "answer_wrong_number"),
    ("missing_required > 0", "required_concept_missing"), ("citation_coverage < 1", "citation_incomplete"), ("appropriateness < 0.6 AND audience = 'beginner'", "audience_too_technical"),
    ("appropriateness < 0.6 AND audience <> 'beginner'", "audience_too_shallow"), ("external", "external_context_required"),
)
_FL = f"{_GR}, fl AS (SELECT *, list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for c, n in _TESTS)}], lambda x: x IS NOT NULL) AS f FROM g)"
_CAUSES = "list_filter([" + ", ".join(f"CASE WHEN list_has_any(f, {T.quoted(ls)}) THEN '{n}' END" for n, ls in G.GROUPS) + "], lambda x: x IS NOT NULL)"

QUERIES = {
    f.__name__: f
    for f in (
        section_roles, sentence_spans, extracted_facts, hyperparameter_conflicts, reproduction_checklist, risk_flags, paper_comparison, research_gaps, procedure_steps, reference_lines,
        section_policy, citation_labels, phrase_presence, instruction_profiles, claim_support, failure_taxonomy, failure_counts, run_comparison, evidence_sufficiency, markdown_sections,
        page_documents, source_paths,
    )
}
SQL = {
    "section_roles": f"WITH {_SEC}, {_RL} SELECT paper, ordinal, array_to_string(roles, ',') AS roles FROM rl",
    "sentence_spans": f"WITH {_SEC}, {_SENT} SELECT paper, ordinal, k, sentence FROM st",
    "extracted_facts": f"WITH {_FACTS} SELECT paper, ordinal, category, value FROM fa",
    "hyperparameter_conflicts": f"""WITH {_FACTS} SELECT paper, category, array_to_string(list_sort(list(DISTINCT value)), ',') AS values, CASE WHEN count(DISTINCT value) > 1 THEN 'conflicting' ELSE 'explicit' END AS validation
        FROM fa WHERE list_contains({_HP}, category) GROUP BY paper, category""",
    "reproduction_checklist": f"WITH {_FACTS}, {_CHECK} SELECT * FROM cl",
    "risk_flags": f"""WITH {_FACTS}, {_CHECK} SELECT paper, item, CASE WHEN status = 'not_found' THEN 'missing' ELSE 'conflicting' END AS reason FROM cl
        WHERE (status = 'not_found' AND list_contains({T.quoted(X.RISKS)}, item)) OR status = 'conflicting'""",
    "paper_comparison": f"""WITH {_FACTS}, s AS (SELECT paper, category, array_to_string(list_sort(list(DISTINCT value)), chr(1)) AS vs FROM fa GROUP BY ALL),
        r AS (SELECT category, count(vs) AS have, count(*) AS n, count(DISTINCT vs) AS kinds FROM (SELECT DISTINCT paper FROM sec WHERE paper <> 'lamp') CROSS JOIN {_values([(x,) for x in X.DIMENSIONS], 'category')}
          LEFT JOIN s USING (paper, category) GROUP BY category)
        SELECT category AS dimension, CASE WHEN have < n THEN 'missing' WHEN kinds = 1 THEN 'shared' ELSE 'different' END AS relationship, kinds AS n_values FROM r""",
    "research_gaps": f"""WITH {_FACTS} SELECT DISTINCT paper, category AS kind, value FROM fa WHERE category IN ('limitation', 'future_work')
        UNION ALL SELECT paper, 'missing_ablation', 'no ablation section' FROM rl GROUP BY paper HAVING NOT bool_or(list_contains(roles, 'ablation'))""",
    "procedure_steps": f"""WITH {_SEC}, {_RL}, x AS (SELECT paper, ordinal, regexp_extract_all(text, '(?m)^[ \\t]*(?:\\d+[.)]|[-*])[ \\t]+([^\\n]+)$', 1) AS ss FROM rl WHERE list_has_any(roles, ['algorithm', 'methodology']))
        SELECT paper, ordinal, unnest(range(len(ss))) AS k, unnest(ss) AS step FROM x""",
    "reference_lines": f"""WITH {_SEC}, {_RL}, x AS (SELECT paper, string_split(text, chr(10)) AS ls FROM rl WHERE list_contains(roles, 'references')), y AS (SELECT paper, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM x)
        SELECT paper, k, regexp_extract(line, '\\b((?:19|20)\\d\\d)\\b', 1) AS year, regexp_extract(line, '\\b(10\\.\\d{{4,9}}/[^\\s]*[^\\s.,;])', 1) AS doi, trim(line) AS line FROM y WHERE trim(line) <> ''""",
    "section_policy": f"""WITH {_SEC}, p(question_type, expected, forbidden) AS (VALUES {', '.join(f"('{k}', {T.quoted(a)}, {T.quoted(b)})" for k, (a, b) in G.POLICY.items())})
        SELECT paper, ordinal, question_type, len(list_filter(expected, lambda w: contains(lower(heading), w))) > 0 AS expected, len(list_filter(forbidden, lambda w: contains(lower(heading), w))) > 0 AS forbidden,
          len(list_filter({T.quoted(T.BOILERPLATE)}, lambda w: contains(lower(heading), w))) > 0 AS boilerplate FROM sec CROSS JOIN p""",
    "citation_labels": f"""WITH a AS (SELECT answer_id::bigint AS answer_id, text FROM {_values(ANSWERS, 'answer_id, text')})
        SELECT answer_id, array_to_string(regexp_extract_all(array_to_string(regexp_extract_all(text, '{T.CITATION}'), ' '), 'C[0-9]+'), ',') AS labels,
          trim(regexp_replace(regexp_replace(text, '{T.CITATION}', '', 'g'), ' +', ' ', 'g')) AS bare FROM a""",
    "phrase_presence": f"""WITH x AS (SELECT doc_id, {_fold('text')} AS t, {_fold("string_split(text, ' ')[1]")} AS w, {T.sql_tokens('text')} AS terms FROM documents),
        y AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS flat, trim(regexp_replace(w || '  ' || w, '\\s+', ' ', 'g')) AS p, {T.sql_tokens("w || '  ' || w")} AS pt FROM x)
        SELECT doc_id, contains(flat, p) OR (len(pt) > 0 AND list_has_all(terms, pt)) AS present, list_has_any(terms, {_NEG}) AS negated FROM y""",
    "instruction_profiles": f"""WITH u AS (SELECT conv_id, turn, {_fold('text')} AS now, {_fold("coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '')")} AS before
          FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, CASE WHEN {_has(G.CONCISE)} THEN 'brief' WHEN {_has(G.DEEP)} THEN 'deep' ELSE 'standard' END AS depth,
          CASE WHEN {_has(G.DERIVE)} OR {_has(G.FORMAL)} THEN 'advanced' WHEN {_has(G.SIMPLE)} THEN 'basic' ELSE 'moderate' END AS mathematical_depth,
          coalesce({_bg('now')}, {_bg('before')}, 'undergraduate') AS background, CASE WHEN {_has(G.FORMAL)} THEN 'formal' WHEN {_has(G.SIMPLE)} THEN 'intuitive' ELSE 'direct' END AS style,
          CASE {' '.join(f"WHEN {_has(w)} THEN '{n}'" for n, w in G.FORMATS)} WHEN {_has(G.DERIVE)} THEN 'derivation' ELSE 'prose' END AS format,
          {_has(G.CRITIQUE)} AS critique, {_has(G.COMPARE)} AS comparison, round(least(1.0::double, 0.5::double + 0.08::double * ({_SIG})), 6) AS confidence FROM u""",
    "claim_support": f"""WITH x AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS evidence FROM conversations),
        t AS (SELECT conv_id, turn, {T.sql_tokens('text')} AS ct, {T.sql_tokens('evidence')} AS et FROM x WHERE role = 'assistant'),
        s AS (SELECT *, CASE WHEN len(ct) > 0 THEN len(list_intersect(list_distinct(ct), list_distinct(et)))::double / len(list_distinct(ct)) ELSE 0 END AS share,
          list_has_any({_TRI.format(t='ct')}, {_TRI.format(t='et')}) AS exact, list_has_any(ct, {_NEG}) <> list_has_any(et, {_NEG}) AS mismatch FROM t),
        c AS (SELECT *, 0.6::double * share + CASE WHEN exact THEN 0.2::double ELSE 0 END AS score FROM s)
        SELECT conv_id, turn, round(share, 6) AS term_share, exact AS shared_run, mismatch AS negation_mismatch, round(score, 6) AS score, score >= 0.45::double AND NOT mismatch AS supported FROM c""",
    "failure_taxonomy": f"""WITH {_FL}, c AS (SELECT doc_id, f, {_CAUSES} AS cs FROM fl)
        SELECT doc_id, array_to_string(f, ',') AS failures, CASE WHEN len(cs) > 0 THEN cs[1] WHEN list_contains(f, 'external_context_required') THEN 'benchmark_ambiguity' ELSE 'none' END AS primary_cause,
          array_to_string(list_slice(cs, 2, 10), ',') AS secondary_causes,
          CASE WHEN len(cs) = 1 THEN 'high' WHEN len(cs) > 1 THEN 'medium' WHEN list_contains(f, 'external_context_required') THEN 'high' ELSE 'medium' END AS confidence FROM c""",
    "failure_counts": f"WITH {_FL}, u AS (SELECT unnest(f) AS failure, audience FROM fl) SELECT failure, count(*) AS n, count(*) FILTER (WHERE audience = 'beginner') AS n_beginner FROM u GROUP BY failure",
    "run_comparison": f"""{S._WITH}, {S._B}, {S._F}, m AS (SELECT query_id, doc_id, a.rank AS a, b.rank AS b FROM (SELECT * FROM br WHERE rank <= 10) a FULL JOIN (SELECT * FROM tr WHERE rank <= 10) b USING (query_id, doc_id))
        SELECT query_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (WHERE b IS NULL) AS lost, count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE b < a) AS improved,
          count(*) FILTER (WHERE b > a) AS regressed, max(CASE WHEN a = 1 THEN doc_id ELSE -1 END) AS best_before, max(CASE WHEN b = 1 THEN doc_id ELSE -1 END) AS best_after FROM m GROUP BY query_id""",
    "evidence_sufficiency": f"""{S._WITH}, {S._B}, n AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id), f2 AS (SELECT query_id, max(score) AS top, max(matched) AS matched, count(*) AS n_evidence FROM br WHERE rank <= 4 GROUP BY query_id),
        x AS (SELECT query_id, n_terms, coalesce(top, 0) AS top, coalesce(matched, 0) AS matched, coalesce(n_evidence, 0) AS n_evidence FROM n LEFT JOIN f2 USING (query_id))
        SELECT query_id, round(matched::double / n_terms, 6) AS coverage, round((matched::double / n_terms + top / (1 + top) + least(1.0::double, n_evidence::double / 4)) / 3, 6) AS score,
          matched::double / n_terms >= 0.2 AND matched >= 1 AND n_evidence >= 1 AS sufficient FROM x""",
    "page_documents": """WITH x AS (SELECT item_id // 10 AS source, item_id AS page, text, sum(length(text) + 1) OVER (PARTITION BY item_id // 10 ORDER BY item_id) AS after FROM benchmark WHERE text <> '')
        SELECT source, page, (after - length(text) - 1)::bigint AS start_character, (after - 1)::bigint AS end_character, sha256(text) AS sha256 FROM x""",
    "source_paths": "SELECT page_id, regexp_replace(trim(replace(replace(url, '/', chr(92)), chr(92), '/')), '/+', '/', 'g') AS path FROM pages",
}
