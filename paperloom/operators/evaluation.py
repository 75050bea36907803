"""Question concepts, evidence checks, grades, review diagnostics and reports as column functions and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.grading import labels

# Question words, intents, types under review, review outcomes, style and qualification words, risk patterns, filter fields.
QUESTION_WORDS = ("what", "which", "how", "why")
ABLATION_WORDS = ("ablation", "ablated", "ablate")
MECHANISM_WORDS = ("how", "mechanism", "work")
PENDING_TYPES = ("complexity", "critical_reasoning", "derivation", "equation", "figure_interpretation", "historical_impact", "cross_paper_synthesis")
PASSING = ("direct", "supported", "complete", "supports", "eligible", "correct_abstention")
FAILING = (
    "insufficient", "irrelevant", "external_required", "unsupported", "incomplete", "wrong_source", "wrong_span", "missing", "malformed", "excluded", "incorrect_abstention",
)
CRITICS = ("evidence_critic", "answer_critic", "citation_critic")
CRITIC_PAIRS = (("evidence_critic", "answer_critic"), ("answer_critic", "citation_critic"), ("evidence_critic", "citation_critic"))
QUALIFIERS = ("although", "however", "limited", "may", "might", "only", "not", "suggests", "under")
RISKS = (
    ("impact_claim", r"\b(impact|influential|changed the field)\b"), ("novelty_claim", r"\b(novel|novelty|new contribution)\b"), ("first_to_claim", r"\b(first|earliest|pioneered)\b"),
    ("research_gap", r"\b(research gap|open problem|future research)\b"), ("external_literature", r"\b(literature|later work|subsequent work)\b"),
    ("multiple_interpretations", r"\b(ambiguous|interpretations?)\b"), ("figure_table_uncertainty", r"\b(figure|table|diagram|plot)\b"),
)
FILTER_FIELDS = ("document_id", "source_name", "media_type", "publication_year", "logical_collection")
REVIEW_LABELS = ("correct", "partial", "incorrect", "should_abstain", "benchmark_problem")


def concepts(question: Column) -> dict[str, Column]:
    """Essential and optional terms, named entities, numbers and the intent of a question."""
    terms = T.query_terms(question)
    asked = T.literal_words(T.INTENT)
    strong = F.array_except(terms, asked)
    some = F.size(strong) > 0
    names = F.transform(F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Za-z0-9+.-]*\b"), F.lit(0)), T.casefold)
    numbers = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)))
    intent = F.when(F.arrays_overlap(terms, T.literal_words(ABLATION_WORDS)), "ablation").when(F.arrays_overlap(T.tokens(question), T.literal_words(MECHANISM_WORDS)), "mechanism")
    return {
        "essential": F.when(some, strong).otherwise(terms), "optional": F.when(some, F.array_intersect(terms, asked)).otherwise(F.array().cast("array<string>")),
        "entities": F.array_except(F.array_distinct(names), T.literal_words(QUESTION_WORDS)), "numbers": numbers,
        "intent": intent.when(F.size(numbers) > 0, "numerical").otherwise("lookup"),
    }


def metadata_filter(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose fields all equal what is wanted, as candidates: corpus statistics come from the unfiltered rows."""
    if unknown := set(wanted) - set(FILTER_FIELDS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    return rows.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items()], F.lit(True)))


def heading_prefix(path: Column, prefix: list[str]) -> Column:
    """Whether a heading path begins with these headings."""
    return F.slice(path, 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix]) if prefix else F.lit(True)


def evidence_eligible(score: Column, matched: Column, essential: Column, least: float) -> Column:
    """A positive score of at least `least` and one essential term among the matched ones."""
    return (score > 0) & (score >= least) & F.arrays_overlap(matched, essential)


def type_allowed(question_type: Column) -> Column:
    """Whether a question type is not pending validation."""
    return ~question_type.isin(*PENDING_TYPES)


def citation_display(label: Column, page_start: Column, page_end: Column, start_line: Column, end_line: Column, heading_path: Column) -> Column:
    """The source with its pages, or else its lines, and its headings."""
    pages = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).otherwise(F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("–"), page_end.cast("string")))
    lines = F.when(start_line == end_line, F.concat(F.lit("line "), start_line.cast("string"))).otherwise(F.concat(F.lit("lines "), start_line.cast("string"), F.lit("–"), end_line.cast("string")))
    where = F.when(page_start.isNotNull() & page_end.isNotNull(), pages).otherwise(lines)
    headings = F.when(F.size(heading_path) > 0, F.concat(F.lit(", § "), F.array_join(heading_path, " › "))).otherwise("")
    return F.concat(F.lit("["), label, F.lit(", "), where, headings, F.lit("]"))


def fact_present(answer: Column, fact: Column) -> Column:
    """The fact as a phrase, or all its terms unless it states an equation or inequality."""
    flat = lambda c: F.trim(F.regexp_replace(T.casefold(c), r"[ \t\n\r\f\x0b]+", " "))
    terms = F.array_distinct(T.tokens(fact))
    every = (F.size(terms) > 0) & (F.size(F.array_except(terms, T.tokens(answer))) == 0)
    return F.contains(flat(answer), flat(fact)) | (~fact.rlike("[=<>]") & every)


def format_citations(labels_: Column) -> Column:
    """[C1, C2], or nothing without labels."""
    return F.when(F.size(labels_) > 0, F.concat(F.lit("["), F.array_join(labels_, ", "), F.lit("]"))).otherwise("")


def retrieval_grades(found: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per query: recall at 1, 3 and 5, hit, reciprocal rank, graded nDCG, mean relevant rank and the share of irrelevant results.

    found: query_id, rank, doc_id, score; gold: query_id, doc_id, grade.  Without gold a query has recall, hit and nDCG 1 and
    no mean rank; gold that is not found counts as one rank behind the last.
    """
    grades = gold.where("grade > 0")
    rows = found.join(grades, ["query_id", "doc_id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    hit = F.col("g") > 0
    at = lambda n: F.sum((hit & (F.col("rank") <= n)).cast("int"))
    per = rows.groupBy("query_id").agg(
        *[at(n).alias(f"h{n}") for n in (1, 3, 5)], at(k).alias("hk"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(hit.cast("int")).alias("h"), F.count("*").alias("n"),
        F.sum(F.when(hit, F.col("rank")).otherwise(0)).alias("ranks"), F.sum(F.when(F.col("rank") <= k, gain(F.col("g"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum((F.col("score") > 0).cast("int")).alias("positive"), F.sum(((F.col("score") > 0) & ~hit).cast("int")).alias("wrong"),
    )
    # the ideal order needs only how often each grade occurs
    step = grades.groupBy("query_id", "grade").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.least(F.col("before") + F.col("m"), F.lit(k)).cast("int")
    places = F.when(last > F.col("before"), F.sequence((F.col("before") + 1).cast("int"), F.greatest(last, (F.col("before") + 1).cast("int")))).otherwise(F.array().cast("array<int>"))
    ideal = step.groupBy("query_id").agg(F.sum(F.aggregate(places, F.lit(0.0), lambda s, r: s + gain(F.col("grade"), r))).alias("ideal"), F.sum("m").alias("n_gold"))
    joined = per.join(ideal, "query_id", "left").na.fill(0, ["n_gold"])
    some = F.col("n_gold") > 0
    or_one = lambda c: F.round(F.when(some, c).otherwise(1.0), 6)
    return joined.select(
        "query_id", *[or_one(F.col(f"h{n}") / F.col("n_gold")).alias(f"recall_at_{n}") for n in (1, 3, 5)], or_one((F.col("hk") > 0).cast("double")).alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), or_one(F.col("dcg") / F.col("ideal")).alias("ndcg"),
        F.round(F.when(some, (F.col("ranks") + (F.col("n_gold") - F.col("h")) * (F.col("n") + 1)) / F.col("n_gold")), 6).alias("mean_relevant_rank"),
        F.round(F.when(F.col("positive") > 0, F.col("wrong") / F.col("positive")).otherwise(0.0), 6).alias("irrelevant_rate"),
    )


def redundancy(results: DataFrame, least: float = 0.8) -> DataFrame:
    """Per query the share of pairs of results whose spans of one document overlap by `least` of the shorter; results: query_id, rank, doc_id, start, stop."""
    a, b = results.alias("a"), results.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    shared = F.least("a.stop", "b.stop") - F.greatest("a.start", "b.start")
    shorter = F.least(F.col("a.stop") - F.col("a.start"), F.col("b.stop") - F.col("b.start"))
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (shorter > 0) & (shared / shorter >= least)
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.count("*").alias("pairs"), F.sum(F.when(same, 1).otherwise(0)).alias("redundant")).withColumn("share", F.round(F.col("redundant") / F.col("pairs"), 6))


def set_metrics(predicted: Column, expected: Column) -> dict[str, Column]:
    """Precision, recall, F1 and equality of two sets; both empty is a precision of 1, nothing expected a recall of 1."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    n, m, both = F.size(p), F.size(e), F.size(F.array_intersect(p, e))
    precision = F.when((n == 0) & (m == 0), 1.0).otherwise(both / F.greatest(n, F.lit(1)))
    recall = F.when(m == 0, 1.0).otherwise(both / F.greatest(m, F.lit(1)))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return {"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6), "exact": ((n == m) & (both == n)).cast("int").cast("double")}


def review_summary(records: DataFrame) -> DataFrame:
    """One row: reviewed records, those of each label with explicit zeros, and rates over reviewed ones; records: label (null while pending)."""
    of = lambda name: F.coalesce(F.sum((F.col("label") == name).cast("int")), F.lit(0))
    reviewed = F.count("label")
    share = lambda name: F.round(F.when(reviewed > 0, of(name) / reviewed).otherwise(0.0), 6)
    counts = [of(name).cast("long").alias(name) for name in REVIEW_LABELS]
    return records.agg(F.count("*").alias("records"), reviewed.alias("reviewed"), *counts, share("correct").alias("pass_rate"), share("benchmark_problem").alias("problem_rate"))


def curation_report(records: DataFrame) -> DataFrame:
    """One row of counts, rates, confidence bands and the most and least certain accepted record; records: id, status, confidence, disagreed, validated."""
    c, good = F.col("confidence"), F.col("status") == "accepted"
    n = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0)).cast("long")
    rate = lambda x: F.round(F.when(F.count("*") > 0, n(x) / F.count("*")).otherwise(0.0), 6)
    return records.agg(
        F.count("*").alias("records"), n(good).alias("accepted"), n(F.col("status") == "rejected").alias("rejected"), n(F.col("status") == "uncertain").alias("uncertain"),
        n(F.col("status") == "duplicate").alias("duplicates"), rate(good).alias("acceptance_rate"), rate(F.col("status") == "duplicate").alias("duplicate_rate"),
        rate(F.col("validated")).alias("validation_rate"), rate(~F.col("disagreed")).alias("agreement"), F.round(F.avg(c), 6).alias("mean_confidence"),
        n(c < 0.8).alias("below_0_80"), n((c >= 0.8) & (c < 0.9)).alias("below_0_90"), n((c >= 0.9) & (c < 0.97)).alias("below_0_97"), n(c >= 0.97).alias("from_0_97"),
        F.max_by(F.when(good, F.col("id")), F.when(good, F.struct(c, -F.col("id")))).alias("strongest"), F.min_by(F.when(good, F.col("id")), F.when(good, F.struct(c, F.col("id")))).alias("weakest"),
    )


def claim_graph_metrics(claims: DataFrame) -> DataFrame:
    """Per graph: claims by support and citation, and shares of them; claims: graph, supported, cited."""
    n = lambda x: F.sum(x.cast("int"))
    s, both = n(F.col("supported")), n(F.col("supported") & F.col("cited"))
    return claims.groupBy("graph").agg(
        F.count("*").alias("claims"), s.alias("supported"), n(~F.col("supported")).alias("unsupported"), (s - both).alias("uncited"),
        F.round(F.when(s > 0, both / s).otherwise(0.0), 6).alias("completeness"), F.round(s / F.count("*"), 6).alias("alignment"),
    )


def prompt_variations(questions: DataFrame) -> DataFrame:
    """(parent, k, question): four phrasings of each question; questions: id, question."""
    q = F.col("question")
    base = F.regexp_replace(q, r"[?.]+$", "")
    low = F.concat(F.lower(F.substring(base, 1, 1)), F.expr("substring(" + "regexp_replace(question, '[?.]+$', ''), 2)"))
    made = F.array(
        F.concat(F.lit("Could you explain "), low, F.lit("?")), F.concat(F.lit("Walk me through this: "), q), F.concat(F.lit("In plain language, "), low, F.lit("?")),
        F.concat(F.lit("Give a rigorous answer with citations: "), q),
    )
    return questions.select(F.col("id").alias("parent"), F.posexplode(made).alias("k", "question")).withColumn("k", F.col("k").cast("long"))


def ordered_hash(rows: DataFrame, group: str, order: str, *parts: str) -> DataFrame:
    """(group, n, sha256) of the rows of a group in order, as a compact JSON array of arrays of strings; groups are answers, with few rows."""
    one = F.concat(F.lit("["), F.concat_ws(",", *[T.canonical_string(F.col(p).cast("string")) for p in parts]), F.lit("]"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), one.alias("x")))), lambda r: r["x"])
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("sha256"))


def vocabulary_hash(terms: Column) -> Column:
    """SHA-256 of the sorted distinct terms as a JSON array."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(terms)), T.canonical_string), ","), F.lit("]")), 256)


def record_reviews(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with the status of their decision; both: id, status.  A decision must name one record, and a record have one decision at most."""
    wrong = decisions.groupBy("id").agg(F.count("*").alias("n")).join(records.select("id").withColumn("known", F.lit(True)), "id", "left").where("n > 1 or known is null")
    if (bad := wrong.select("id").first()) is not None:
        raise ValueError(f"no single record and decision for {bad.id}")
    return records.join(decisions.select("id", F.col("status").alias("decided")), "id", "left").select("id", F.coalesce("decided", "status").alias("status"))


def labelled_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(graph, claim, label, evidence_id) of every citation of a claim; evidence_id is null for an unknown label.  answers: graph, claim, text; evidence: graph, label, evidence_id."""
    cited = answers.select("graph", "claim", F.explode(F.array_distinct(T.citation_labels(F.col("text")))).alias("label"))
    return cited.join(evidence, ["graph", "label"], "left").select("graph", "claim", "label", "evidence_id")


def evidence_identity(document_id: Column, chunk_id: Column, page_start: Column, page_end: Column, start_line: Column, end_line: Column, heading_path: Column, source_hash: Column) -> Column:
    """evidence_ and 24 hex digits of the SHA-256 of the source coordinates as JSON with sorted keys."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    string = lambda c: F.coalesce(T.canonical_string(c), F.lit("null"))
    headings = F.concat(F.lit("["), F.array_join(F.transform(heading_path, T.canonical_string), ","), F.lit("]"))
    fields = (
        ("chunk_id", string(chunk_id)), ("document_id", string(document_id)), ("end_line", number(end_line)), ("heading_path", headings), ("page_end", number(page_end)),
        ("page_start", number(page_start)), ("source_hash", string(source_hash)), ("start_line", number(start_line)),
    )
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields]
    return F.concat(F.lit("evidence_"), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 24))


def outcome_family(outcome: Column) -> Column:
    """pass, partial or fail of a review outcome; null for any other."""
    return F.when(outcome.isin(*PASSING), "pass").when(outcome == "partial", "partial").when(outcome.isin(*FAILING), "fail")


def disagreements(passes: DataFrame) -> DataFrame:
    """(id, categories): conflicts between the latest passes of the critics, and with the adjudicator; passes: id, role, seq, outcome.

    The majority is the most frequent family of the critics, of equals the one that comes first in their order.
    """
    roles = (*CRITICS, "final_adjudicator")
    latest = passes.groupBy("id").agg(*[outcome_family(F.max_by(F.when(F.col("role") == r, F.col("outcome")), F.when(F.col("role") == r, F.col("seq")))).alias(r) for r in roles])
    pair = lambda a, b: ((F.col(a) == "pass") & (F.col(b) == "fail")) | ((F.col(a) == "fail") & (F.col(b) == "pass"))
    votes = F.filter(F.array(*[F.col(c) for c in CRITICS]), lambda x: x.isNotNull())
    a, b, c = (F.get(F.col("votes"), F.lit(k)) for k in range(3))
    majority = F.when(b.isNotNull() & c.isNotNull() & (b == c), b).otherwise(a)
    latest = latest.withColumn("votes", votes)
    found = labels(*[(pair(x, y), f"{x}_vs_{y}") for x, y in CRITIC_PAIRS], (F.col("final_adjudicator").isNotNull() & (F.size("votes") > 0) & (F.col("final_adjudicator") != majority), "final_adjudicator_overrides_majority"))
    return latest.select("id", *roles, found.alias("categories"))


def adjudication(structural: Column, support: Column, evidence: Column, unsupported: Column, ambiguous: Column, hard: Column) -> tuple[Column, Column]:
    """The decision before any adjudicator is asked, and what triggers it."""
    found = labels(
        (~structural, "citation_structural_failure"), (~support, "unsupported_claim"), (evidence.isin("insufficient", "irrelevant"), "insufficient_evidence"),
        (unsupported > 0, "unsupported_claim"), (ambiguous, "ambiguous_benchmark"), (hard, "hard_reviewer_disagreement"),
    )
    found = F.array_distinct(found)
    decision = F.when(F.array_contains(found, "ambiguous_benchmark"), "exclude").when(F.array_contains(found, "insufficient_evidence"), "abstain_or_reject")
    return decision.when(F.size(found) > 0, "repair_or_reject").otherwise("eligible_for_model_adjudication"), found


def repair_outcome(before: list[Column], after: list[Column]) -> Column:
    """Whether a repair fixed a gate, broke one, or changed nothing."""
    fixed = reduce(lambda a, b: a | b, [~x & y for x, y in zip(before, after, strict=True)])
    broke = reduce(lambda a, b: a | b, [x & ~y for x, y in zip(before, after, strict=True)])
    return F.when(fixed & ~broke, "fixed").when(broke, "introduced_new_issue").otherwise("unchanged")


def risk_categories(text: Column) -> Column:
    """The kinds of claim in a text that only a human may approve, in the order of their names."""
    return F.array_sort(labels(*[(text.rlike(f"(?i){pattern}"), name) for name, pattern in RISKS]))


def circular_warnings(producer: Column, producer_version: Column, reviewer: Column, reviewer_version: Column, correction: Column, validators: Column) -> Column:
    """What keeps a review from being independent."""
    same = (producer == reviewer) & (producer_version == reviewer_version) & (F.size(validators) == 0)
    again = F.coalesce((correction == producer) | (correction == reviewer), F.lit(False))
    return labels((same, "same_producer_and_reviewer_without_independent_validation"), (again, "correction_system_reuses_producer_or_reviewer"))


def sufficiency_grade(gold: Column, answer: Column, abstained: Column) -> dict[str, Column]:
    """How an answer's claim to be sufficient agrees with the gold label."""
    terms = T.tokens(answer)
    qualified = abstained | F.arrays_overlap(terms, T.literal_words(QUALIFIERS))
    outside = abstained | F.arrays_overlap(terms, T.literal_words(("external", "outside", "later")))
    predicted = F.when(abstained, "insufficient").when(outside & (gold == "external_required"), "external_required").when(qualified & (gold == "partially_sufficient"), "partially_sufficient").otherwise("sufficient")
    right = F.when((gold == "partially_sufficient") & predicted.isin("partially_sufficient", "sufficient"), qualified).otherwise(predicted == gold)
    return {
        "predicted": predicted, "correct": right.cast("int"), "false_answer": (gold.isin("insufficient", "external_required") & ~abstained & ~((gold == "external_required") & qualified)).cast("int"),
        "false_abstention": ((gold == "sufficient") & abstained).cast("int"), "external_recognized": ((gold != "external_required") | outside).cast("int"),
        "qualified": (~gold.isin("partially_sufficient", "external_required") | qualified).cast("int"),
    }


def evidence_errors(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(evidence_id, error): the first disagreement of an evidence with its document, null without one.

    evidence: evidence_id, doc_id, start, stop (0-based, behind the end), start_line, end_line, selected; documents: doc_id, text.
    """
    rows = evidence.join(documents.withColumn("known", F.lit(True)), "doc_id", "left")
    length = F.length("text")
    outside = (F.col("start") < 0) | (F.col("start") >= F.col("stop")) | (F.col("stop") > length)
    lines = (F.col("start_line") != T.line_of(F.col("text"), F.col("start"))) | (F.col("end_line") != T.line_of(F.col("text"), F.col("stop") - 1))
    other = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")) != F.col("selected")
    error = F.when(F.col("known").isNull(), "missing_document").when(outside, "range_outside_document").when(lines, "line_mismatch").when(other, "text_mismatch")
    return rows.select("evidence_id", error.alias("error"))
