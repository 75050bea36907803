"""Question candidates, topics, claim types, section roles and ingestion health as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import casefold
from paperloom.operators.answering import HEADINGS
from paperloom.operators.curation import PRIORITY

# Topic signals, answerability of question types, claim markers, health limits.
TOPICS = {
    "ablation": ("ablation", "ablate", "ablated", "component analysis", "variant", "without"), "architecture": ("architecture", "layer", "module", "network", "encoder", "decoder", "block"),
    "complexity": ("complexity", "runtime", "memory", "flops", "asymptotic", "computational cost"),
    "reproduction": ("optimizer", "learning rate", "batch size", "training", "epochs", "hardware"), "experiment": ("experiment", "dataset", "evaluation", "baseline", "metric"),
    "limitation": ("limitation", "drawback", "failure", "future work"), "derivation": ("equation", "lemma", "theorem", "proof", "objective", "derive"),
    "method": ("method", "model", "algorithm", "approach", "propose"),
}
ANSWERABILITY = {"insufficient_evidence": "abstain", "external_context": "external_required", "historical_impact": "external_required", "false_premise": "partial"}
CLAIM_TYPES = (
    ("numerical", r"[0-9]"), ("equation", r"[=∑∂√]|\\\("), ("causal", r"(?i)because|therefore|causes|leads to"), ("comparison", r"(?i)better|worse|faster|than"),
    ("limitation", r"(?i)limitation|cannot|fails|drawback"),
)
UNTITLED, DUPLICATE, SHORT = 0.25, 0.5, 20

#: Our own question templates: type and text, a few for each topic.
TEMPLATES = tuple((t, f"{lead} {t} in {{title}}?") for t in (*TOPICS, *ANSWERABILITY) for lead in ("What is said about the", "How strong is the case for the"))


def any_word(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def normalized_heading(heading: Column) -> Column:
    """Lower case, letters and spaces only, without a number in front or behind."""
    low = F.lower(F.coalesce(heading, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^[0-9.]+\s*", ""), "[^a-z ]", ""), " +", " "))


def canonical_role(heading: Column) -> Column:
    """The name that the heading is, else the longest name it holds as whole words; null without one."""
    flat = normalized_heading(heading)
    padded = F.concat(F.lit(" "), flat, F.lit(" "))
    ordered = sorted(HEADINGS, key=lambda h: (-len(h), HEADINGS.index(h)))
    return F.coalesce(*[F.when(flat == h, h) for h in HEADINGS], *[F.when(F.contains(padded, F.lit(f" {h} ")), h) for h in ordered])


def claim_type(text: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), name) for name, p in CLAIM_TYPES], F.lit("factual"))


def atomic_claims(texts: DataFrame) -> DataFrame:
    """(id, k, claim) of id and text: sentences, cut again at semicolons and before while, whereas and but; headings drop out."""
    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    rows = texts.select("id", F.posexplode(sentences).alias("s", "sentence")).where("not startswith(ltrim(sentence), '#')")
    parts = F.split(F.regexp_replace("sentence", r"\s*;\s*|\s*,\s+(while|whereas|but)\b", "\u0001$1"), "\u0001")
    rows = rows.select("id", "s", F.posexplode(parts).alias("p", "claim")).where("trim(claim) <> ''")
    order = Window.partitionBy("id").orderBy("s", "p")
    return rows.select("id", (F.row_number().over(order) - 1).cast("long").alias("k"), F.trim("claim").alias("claim"))


def candidates(papers: DataFrame, spark, most: int = 12) -> DataFrame:
    """(paper, position, question_type, answerability, question): templates in turn over their types, without topics that the paper lacks.

    papers: paper, title, text.
    """
    rows = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(TEMPLATES)], "n long, question_type string, template string")
    turn = rows.groupBy("question_type").agg(F.min("n").alias("first"))
    rows = rows.join(turn, "question_type").withColumn("turn", F.row_number().over(Window.partitionBy("question_type").orderBy("n")))
    low = casefold(F.col("text"))
    topic = reduce(lambda a, b: a & b, [(F.col("question_type") != t) | any_word(low, ws) for t, ws in TOPICS.items()])
    answer = F.coalesce(*[F.when(F.col("question_type") == k, v) for k, v in ANSWERABILITY.items()], F.lit("answerable"))
    grid = papers.crossJoin(F.broadcast(rows)).where(topic)  # a fixed list of templates
    position = F.row_number().over(Window.partitionBy("paper").orderBy("turn", "first"))
    out = grid.withColumn("position", position.cast("long")).where(F.col("position") <= most)
    return out.select("paper", "position", "question_type", answer.alias("answerability"), F.replace("template", F.lit("{title}"), F.col("title")).alias("question"))


def priority(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(7))


def ingestion_health(sections: DataFrame) -> DataFrame:
    """(paper, n_sections, untitled, duplicates, mean_length, healthy) of sections (paper, heading, text)."""
    sizes = sections.groupBy("paper", "text").agg(F.count("*").alias("n"), F.sum(F.when(F.trim(F.coalesce("heading", F.lit(""))) == "", 1).otherwise(0)).alias("bare"))
    rows = sizes.groupBy("paper").agg(F.sum("n").alias("n_sections"), F.sum("bare").alias("bare"), F.sum(F.col("n") - 1).alias("again"), F.sum(F.length("text") * F.col("n")).alias("chars"))
    untitled, again, mean = F.col("bare") / F.col("n_sections"), F.col("again") / F.col("n_sections"), F.col("chars") / F.col("n_sections")
    return rows.select(
        "paper", "n_sections", F.round(untitled, 6).alias("untitled"), F.round(again, 6).alias("duplicates"), F.round(mean, 6).alias("mean_length"),
        ((untitled <= UNTITLED) & (again <= DUPLICATE) & (mean >= SHORT)).alias("healthy"),
    )
