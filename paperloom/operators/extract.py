"""Typed facts of papers as one tagged table, and what is built on it: checklist, comparison and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import literal_words

# Section roles, patterns, lexicons and the checklist.
ROLES = (
    ("title", ("title",)), ("abstract", ("abstract", "summary")), ("introduction", ("introduction", "overview")), ("background", ("background", "preliminar")),
    ("related_work", ("related work", "prior work", "literature")), ("methodology", ("method", "approach", "model", "framework")),
    ("theory", ("theory", "theoretical analysis", "proof")), ("algorithm", ("algorithm", "procedure", "pseudocode")), ("data", ("data", "dataset", "corpus")),
    ("experiments", ("experiment", "evaluation", "empirical", "setup")), ("results", ("result", "finding")), ("ablation", ("ablation", "sensitivity", "component analysis")),
    ("discussion", ("discussion",)), ("limitations", ("limitation", "threats to validity")), ("conclusion", ("conclusion", "concluding")),
    ("references", ("references", "bibliography")), ("appendix", ("appendix", "supplement")),
)
_EQ, _REAL = r"(?:\s+(?:of|is)|\s*=|:)?\s*", r"([+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)"
HYPERPARAMETERS = (
    ("learning_rate", rf"(?i)\blearning\s+rate{_EQ}{_REAL}"), ("batch_size", rf"(?i)\bbatch\s+size{_EQ}(\d+)"), ("epochs", r"(?i)\b(\d+)\s+epochs?\b"),
    ("training_steps", r"(?i)\b(\d+)\s+(?:training\s+)?steps?\b"), ("weight_decay", rf"(?i)\bweight\s+decay{_EQ}{_REAL}"), ("dropout", rf"(?i)\bdropout{_EQ}([0-9.]*[0-9])"),
    ("random_seed", rf"(?i)\b(?:random\s+)?seed{_EQ}(\d+)"), ("hidden_dimension", rf"(?i)\bhidden\s+(?:size|dimension){_EQ}(\d+)"), ("layers", r"(?i)\b(\d+)[ -]layers?\b"),
    ("heads", r"(?i)\b(\d+)[ -](?:attention )?heads?\b"), ("trials", r"(?i)\b(\d+)\s+(?:runs?|trials?)\b"),
)
METHODS = (
    ("optimizer", r"(?i)\b(?:optimizer|optimized using|we use)\s+(AdamW?|SGD|momentum)\b"), ("objective_function", r"(?i)\b((?:objective|loss function|minimize|maximize)\b[^.\n]*)"),
    ("architecture", r"(?i)\b((?:architecture|encoder|decoder|network|regression model)\b[^.\n]*)"), ("preprocessing", r"(?i)\b((?:preprocess|normalize|standardize|tokenize|filter)\w*\b[^.\n]*)"),
    ("hardware", r"(?i)\b((?:GPU|CPU|TPU|NVIDIA|AMD|Apple M\d)\b[^.\n]*)"), ("software", r"(?i)\b((?:PyTorch|TensorFlow|JAX|NumPy|scikit-learn|R version)\b[^.\n]*)"),
    ("dataset", r"\b([A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*)*)\s+(?:dataset|corpus)\b"), ("sample_count", r"(?i)\b([0-9][0-9,]*)\s+(?:training|validation|test)\s+examples\b"),
    ("baseline", r"(?i)\b([A-Za-z][A-Za-z-]*)\s+baseline\b"),
)
METRICS = ("accuracy", "f1", "precision", "recall", "auroc", "perplexity", "bleu", "mean squared error", "mse", "sharpe ratio", "log loss", "calibration error")
CLAIMS = (
    ("contribution", r"(?i)\b(?:we introduce|we propose|our contribution)\b"), ("theoretical_result", r"(?i)\b(?:we prove|we show|theorem)\b"),
    ("comparative_result", r"(?i)\b(?:outperforms?|improves? over|better than)\b"), ("empirical_result", r"(?i)\b(?:we demonstrate|our results indicate|achieves?|reduces?)\b"),
    ("future_work", r"(?i)\b(?:future work|we plan to|remains to)\b"),
)
ASSUMPTION = (
    r"(?i)\b(?:we assume|under the assumption|suppose that|provided that|subject to|holds when|independent and identically distributed|finite variance|stationary|convex|Gaussian)\b"
)
LIMITATION = r"(?i)\b(?:limitation|does not|fails? when|restricted to|future work|computationally expensive|sensitive to|requires)\b"
CHECKLIST = (
    ("dataset", ("dataset",)), ("split", ("split",)), ("preprocessing", ("preprocessing",)), ("sample sizes", ("sample_count",)), ("architecture", ("architecture",)),
    ("dimensions", ("hidden_dimension",)), ("layers", ("layers",)), ("heads", ("heads",)), ("initialization", ("initialization",)), ("objective", ("objective_function",)),
    ("optimizer", ("optimizer",)), ("learning rate", ("learning_rate",)), ("schedule", ("learning_rate_schedule",)), ("batch size", ("batch_size",)),
    ("epochs or steps", ("epochs", "training_steps")), ("weight decay", ("weight_decay",)), ("dropout", ("dropout",)), ("random seeds", ("random_seed",)),
    ("stopping criteria", ("stopping_criteria",)), ("metrics", ("metric",)), ("baselines", ("baseline",)), ("evaluation protocol", ("evaluation_protocol",)),
    ("statistical tests", ("statistical_test",)), ("number of runs", ("trials",)), ("hardware", ("hardware",)), ("software", ("software",)),
)
RISKS = ("dataset", "split", "preprocessing", "random seeds", "epochs or steps", "evaluation protocol", "hardware", "number of runs")
DIMENSIONS = ("contribution", "assumption", "optimizer", "dataset", "metric", "baseline", "learning_rate", "limitation")


def roles(heading: Column, ordinal: Column, level: Column) -> Column:
    """Every role whose fragment the heading holds; a first level-one heading without one is the title."""
    low = F.lower(F.coalesce(heading, F.lit("")))
    found = F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(f)) for f in fs]), r) for r, fs in ROLES]), lambda x: x.isNotNull())
    other = F.when((ordinal == 0) & (level == 1) & (low != ""), F.array(F.lit("title"))).otherwise(F.array(F.lit("unknown")))
    return F.when(F.size(found) > 0, found).otherwise(other)


def sentences(sections: DataFrame) -> DataFrame:
    """(paper, ordinal, k, sentence): texts cut behind . ! or ? and white space, never across sections."""
    cut = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    rows = sections.select("paper", "ordinal", F.posexplode(cut).alias("k", "sentence"))
    return rows.select("paper", "ordinal", F.col("k").cast("long").alias("k"), F.trim("sentence").alias("sentence")).where("sentence <> ''")


def facts(sections: DataFrame) -> DataFrame:
    """(paper, ordinal, category, value), distinct: patterns, metrics, claims, assumptions and limitations."""
    patterns = F.array(*[F.struct(F.lit(c).alias("category"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("vs")) for c, p in (*HYPERPARAMETERS, *METHODS)])
    one = sections.select("paper", "ordinal", F.explode(patterns).alias("x")).select("paper", "ordinal", "x.category", F.explode("x.vs").alias("value"))
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "), F.lit(" "))
    named = F.filter(literal_words(METRICS), lambda m: F.contains(low, F.concat(F.lit(" "), m, F.lit(" "))))
    two = sections.select("paper", "ordinal", F.lit("metric").alias("category"), F.explode(named).alias("value"))
    said = sentences(sections)
    kinds = [*[F.when(F.rlike("sentence", F.lit(p)), t) for t, p in CLAIMS]]
    claim = F.coalesce(*kinds)
    tags = F.filter(F.array(claim, F.when(F.rlike("sentence", F.lit(ASSUMPTION)), "assumption"), F.when(F.rlike("sentence", F.lit(LIMITATION)), "limitation")), lambda x: x.isNotNull())
    three = said.select("paper", "ordinal", F.explode(tags).alias("category"), F.col("sentence").alias("value"))
    return one.union(two).union(three).distinct()


def checklist(found: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper, item, status, n_values) of every paper and item: not_found, conflicting (several values of one hyperparameter) or found."""
    spark = found.sparkSession
    items = spark.createDataFrame([(i, name, c) for i, (name, cs) in enumerate(CHECKLIST) for c in cs], "k int, item string, category string")
    values = found.groupBy("paper", "category").agg(F.countDistinct("value").alias("n"))
    clash = F.col("category").isin([c for c, _ in HYPERPARAMETERS]) & (F.col("n") > 1)
    grid = papers.select("paper").distinct().crossJoin(F.broadcast(items))  # a fixed list of items
    rows = grid.join(values, ["paper", "category"], "left").groupBy("paper", "item").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.max(F.coalesce(clash, F.lit(False))).alias("clash"))
    return rows.select("paper", "item", F.when(F.col("n") == 0, "not_found").when(F.col("clash"), "conflicting").otherwise("found").alias("status"), F.col("n").alias("n_values"))


def risk_flags(items: DataFrame) -> DataFrame:
    """(paper, item, reason) of absent and conflicting items."""
    absent = (F.col("status") == "not_found") & F.col("item").isin(list(RISKS))
    return items.where(absent | (F.col("status") == "conflicting")).select("paper", "item", F.when(absent, "missing").otherwise("conflicting").alias("reason"))


def comparison(found: DataFrame, papers: DataFrame) -> DataFrame:
    """(dimension, relationship, n_values): whether all papers have the same values, some lack any, or they differ."""
    spark = found.sparkSession
    names = spark.createDataFrame([(c,) for c in DIMENSIONS], "category string")
    grid = papers.select("paper").distinct().crossJoin(F.broadcast(names))  # a fixed list of dimensions
    sets = found.groupBy("paper", "category").agg(F.array_join(F.sort_array(F.collect_set("value")), "\u0001").alias("vs"))
    rows = grid.join(sets, ["paper", "category"], "left").groupBy("category").agg(F.count("vs").alias("have"), F.count("*").alias("n"), F.countDistinct("vs").alias("kinds"))
    relation = F.when(F.col("have") < F.col("n"), "missing").when(F.col("kinds") == 1, "shared").otherwise("different")
    return rows.select(F.col("category").alias("dimension"), relation.alias("relationship"), F.col("kinds").alias("n_values"))


def gaps(found: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper, kind, value): stated limitations and future work, and papers without an ablation section."""
    said = found.where("category in ('limitation', 'future_work')").select("paper", F.col("category").alias("kind"), "value")
    has = sections.groupBy("paper").agg(F.max(F.array_contains(roles(F.col("heading"), F.col("ordinal"), F.col("level")), "ablation")).alias("has"))
    return said.union(has.where(~F.col("has")).select("paper", F.lit("missing_ablation").alias("kind"), F.lit("no ablation section").alias("value"))).distinct()


def steps(sections: DataFrame) -> DataFrame:
    """(paper, ordinal, k, step): numbered and bulleted lines of algorithm and methodology sections."""
    wanted = F.arrays_overlap(roles(F.col("heading"), F.col("ordinal"), F.col("level")), literal_words(("algorithm", "methodology")))
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*(?:\d+[.)]|[-*])[ \t]+([^\n]+)$"), F.lit(1))
    return sections.where(wanted).select("paper", "ordinal", F.posexplode(lines).alias("k", "step")).select("paper", "ordinal", F.col("k").cast("long").alias("k"), "step")


def references(sections: DataFrame) -> DataFrame:
    """(paper, k, year, doi, line) of every line of a references section."""
    wanted = F.array_contains(roles(F.col("heading"), F.col("ordinal"), F.col("level")), "references")
    rows = sections.where(wanted).select("paper", F.posexplode(F.split("text", "\n")).alias("k", "line")).where("trim(line) <> ''")
    return rows.select("paper", F.col("k").cast("long").alias("k"), F.regexp_extract("line", r"\b((?:19|20)\d\d)\b", 1).alias("year"), F.regexp_extract("line", r"\b(10\.\d{4,9}/[^\s]*[^\s.,;])", 1).alias("doi"), F.trim("line").alias("line"))
