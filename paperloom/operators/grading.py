"""Failure labels, root causes, claim support and instruction profiles as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T

# Failure groups, section policy, claim stop words, profile keywords.
GROUPS = (
    ("retrieval", ("retrieval_wrong_section", "retrieval_irrelevant_passage", "retrieval_missed_gold_evidence", "retrieval_boilerplate", "retrieval_redundant")),
    ("sufficiency", ("sufficiency_false_positive", "sufficiency_false_negative")),
    ("answer_construction", ("answer_not_relevant", "answer_incomplete", "answer_overgeneralized", "answer_wrong_entity_type", "answer_wrong_number", "answer_false_premise_accepted", "required_concept_missing", "prohibited_claim_present")),
    ("citation_validation", ("citation_invalid", "citation_irrelevant", "citation_wrong_location", "citation_incomplete")),
    ("audience_rendering", ("audience_too_technical", "audience_too_shallow")),
    ("generation", ("generation_malformed", "fallback_used")),
)
POLICY = {
    "metadata": (("title", "abstract"), ("references", "acknowledgments")), "motivation": (("abstract", "introduction"), ("references", "license")),
    "main_method": (("method", "methodology", "architecture"), ("references",)), "architecture": (("architecture", "method", "model"), ("references",)),
    "equation": (("method", "theory", "equation", "appendix"), ("references",)), "notation": (("method", "theory", "appendix"), ("references",)),
    "assumption": (("method", "theory", "discussion"), ("references",)), "methodology": (("method", "methodology"), ("references",)),
    "hyperparameter": (("experiment", "training", "implementation"), ("references",)), "experiment": (("experiment", "evaluation"), ("references",)),
    "result": (("result", "experiment"), ("references",)), "ablation": (("ablation", "experiment"), ("references",)),
    "limitation": (("limitation", "discussion", "conclusion"), ("references",)), "reproduction": (("method", "training", "experiment", "implementation"), ("references",)),
}
BACKGROUND = (
    ("researcher", ("phd", "professor", "researcher", "expert")), ("undergraduate", ("undergrad", "undergraduate", "college level")),
    ("high_school", ("high school", "beginner", "inexperienced", "new to", "eli5")),
)
SIMPLE = ("simple", "plain language", "intuitive", "eli5")
DEEP = ("more detail", "deep dive", "in depth", "thorough", "rigorous")
CONCISE = ("concise", "briefly", "short answer", "one paragraph")
DERIVE = ("derive", "derivation", "step by step", "show the math")
CRITIQUE = ("critique", "limitations", "weakness", "assumptions")
COMPARE = ("compare", "contrast", "versus", " vs ")
FORMATS = (("table", ("table", "matrix")), ("checklist", ("checklist", "implementation steps")), ("bullets", ("bullet", "list")))
FORMAL = ("formal proof", "formally")


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def labels(*tests: tuple[Column, str]) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*[F.when(c, n) for c, n in tests]), lambda x: x.isNotNull())


def failures() -> Column:
    """The failure labels of a row of grades; see the queries for its columns."""
    c = F.col
    return labels(
        (c("wrong_section") > 0, "retrieval_wrong_section"), (c("irrelevant_rate") > 0.5, "retrieval_irrelevant_passage"), (c("missed_gold") > 0, "retrieval_missed_gold_evidence"),
        (c("boilerplate") > 0, "retrieval_boilerplate"), (c("redundancy") > 0, "retrieval_redundant"), (c("false_answer"), "sufficiency_false_positive"),
        (c("false_abstention"), "sufficiency_false_negative"), (c("relevance") < 0.5, "answer_not_relevant"), (c("completeness") < 0.75, "answer_incomplete"),
        (c("prohibited") > 0, "answer_overgeneralized"), (c("prohibited") > 0, "prohibited_claim_present"), (c("numerical_accuracy") < 1, "answer_wrong_number"),
        (c("missing_required") > 0, "required_concept_missing"), (c("citation_coverage") < 1, "citation_incomplete"),
        ((c("appropriateness") < 0.6) & (c("audience") == "beginner"), "audience_too_technical"), ((c("appropriateness") < 0.6) & (c("audience") != "beginner"), "audience_too_shallow"),
        (c("external"), "external_context_required"),
    )


def root_cause(found: Column) -> tuple[Column, Column, Column]:
    """Primary cause, secondary causes joined by commas, and confidence."""
    causes = labels(*[(F.arrays_overlap(found, T.literal_words(ls)), name) for name, ls in GROUPS])
    none = F.when(F.array_contains(found, "external_context_required"), "benchmark_ambiguity").otherwise("none")
    primary = F.when(F.size(causes) > 0, F.get(causes, F.lit(0))).otherwise(none)
    confidence = F.when(F.size(causes) == 1, "high").when(F.size(causes) > 1, "medium").when(none == "benchmark_ambiguity", "high").otherwise("medium")
    return primary, F.array_join(F.slice(causes, 2, 10), ","), confidence


def claim_support(claim: Column, evidence: Column) -> dict[str, Column]:
    """Share of the claim's terms in the evidence, a shared run of three terms, and whether only one side negates."""
    c, e = F.array_distinct(T.tokens(claim)), F.array_distinct(T.tokens(evidence))
    share = F.when(F.size(c) > 0, F.size(F.array_intersect(c, e)) / F.size(c)).otherwise(0.0)
    exact = F.arrays_overlap(T.trigrams(T.tokens(claim)), T.trigrams(T.tokens(evidence)))
    mismatch = T.has_negation(c) != T.has_negation(e)
    score = 0.6 * share + F.when(exact, 0.2).otherwise(0.0)
    return {"term_share": F.round(share, 6), "shared_run": exact, "negation_mismatch": mismatch, "score": F.round(score, 6), "supported": (score >= 0.45) & ~mismatch}


def profile(prompt: Column, context: Column) -> dict[str, Column]:
    """Presentation wishes of a prompt and the user turns before it; the prompt wins over its context for the background."""
    now, before = T.casefold(prompt), T.casefold(F.coalesce(context, F.lit("")))
    has = lambda words: any_of(now, words) | any_of(before, words)
    first = lambda c: F.coalesce(*[F.when(any_of(c, words), name) for name, words in BACKGROUND])
    derive, simple, formal = has(DERIVE), has(SIMPLE), has(FORMAL)
    depth = F.when(has(CONCISE), "brief").when(has(DEEP), "deep").otherwise("standard")
    signals = [any_of(before, w) for _, w in BACKGROUND] + [any_of(now, w) for _, w in BACKGROUND]
    signals += [simple, has(DEEP), has(CONCISE), derive, has(CRITIQUE), has(COMPARE), formal, *[has(w) for _, w in FORMATS]]
    n = reduce(lambda a, b: a + b, [s.cast("int") for s in signals])
    form = F.coalesce(*[F.when(has(w), name) for name, w in FORMATS], F.when(derive, "derivation"), F.lit("prose"))
    return {
        "depth": depth, "mathematical_depth": F.when(derive | formal, "advanced").when(simple, "basic").otherwise("moderate"),
        "background": F.coalesce(first(now), first(before), F.lit("undergraduate")), "style": F.when(formal, "formal").when(simple, "intuitive").otherwise("direct"),
        "format": form, "critique": has(CRITIQUE), "comparison": has(COMPARE), "confidence": F.round(F.least(F.lit(1.0), 0.5 + 0.08 * n), 6),
    }
