"""URL verdicts from host rules and, where no rule fits, from trust spread along links.

Trust is personalised PageRank from trusted hosts along links between hosts; distrust starts at
blocked hosts and runs against the links, since who links to bad hosts is suspect.  Both are
tables of hosts that a join and a sum advance; a written table ends each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch
from paperloom.llm.line_dedup import LOWER, UPPER

#: (verdict, rule) of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Steps end when less than the tolerance is on its way; each step damps it.
DAMPING, TOLERANCE = 0.85, 1e-5
#: A host is a seed if this share of its pages is allowed, or blocked by rules of whole hosts (a rule of one folder does
#: not speak for the host); it is blocked if distrust is over the second share of both scores.
SEED_SHARE, BLOCK_SHARE = 0.5, 0.5
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def spread(links: DataFrame, seeds: DataFrame, work: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust).  links: src, dst, weight between different hosts; seeds: host, kind (allow or block).

    The scores of a kind are the sum of what its seeds send along one, two and more links, each time
    damped, until less than the tolerance is on its way; they are scaled to sum to one.  That is
    personalised PageRank in which hosts without a way on give what they hold back to the seeds.
    """
    total = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows
    one = F.when(F.col("kind") == "allow", 1.0 / total.get("allow", 1)).otherwise(1.0 / total.get("block", 1))
    start = work.save(seeds.select("kind", "host", one.alias("score")), "seeds")
    ways = links.select(F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight")
    ways = ways.unionByName(links.select(F.lit("block").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight"))
    out = work.save(ways.groupBy("kind", "host").agg(F.sum("weight").alias("out")), "out")
    ways = work.save(ways.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("out")).alias("share")), "ways")
    steps = [start]
    while True:
        sent = ways.join(steps[-1], ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((DAMPING * F.sum(F.col("share") * F.col("score"))).alias("score"))
        steps.append(work.save(sent, "step"))
        if (steps[-1].agg(F.sum("score")).collect()[0][0] or 0) < tolerance:
            break
    summed = links.sparkSession.read.schema(start.schema).parquet(*[s._scratch for s in steps]).groupBy("kind", "host").agg(F.sum("score").alias("score"))
    summed = work.save(summed, "summed")
    work.drop(*steps, ways, out)
    mass = {r["kind"]: r["n"] for r in summed.groupBy("kind").agg(F.sum("score").alias("n")).collect()}  # two rows
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score") / mass.get(kind, 1.0)).otherwise(0.0))
    return summed.groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tolerance: float = TOLERANCE) -> DataFrame:
    """id, host, path, rule and verdict of every row, in one of the words allow and block.

    Hosts without any score are allowed, as are urls without a host.  A null html has no links.
    Repeated rows each give a row and weigh in the links as often; an empty table gives an empty result.
    """
    work = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    whole = F.instr("rule", "/") == F.length("rule")
    speaks = F.when(F.col("ruled") == "allow", F.lit("allow")).when((F.col("ruled") == "block") & whole, F.lit("block")).otherwise(F.lit(""))
    share = lambda kind: F.avg((speaks == kind).cast("double"))
    hosts = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block"))
    kind = F.when(F.col("allow") >= SEED_SHARE, F.lit("allow")).when(F.col("block") >= SEED_SHARE, F.lit("block"))
    seeds = hosts.select("host", kind.alias("kind")).where("kind is not null")
    there = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_HREF), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.select(host.alias("src"), F.explode(there).alias("dst")).where("src <> '' and src <> dst")
    links = work.save(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), "links")
    scores = spread(links, work.save(seeds, "seed-hosts"), work, tolerance)
    bad = F.col("distrust") > BLOCK_SHARE * (F.col("trust") + F.col("distrust"))
    blocked = work.save(scores.where(bad).select("host", F.lit("block").alias("spread")), "blocked")
    return rows.join(blocked, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict")
    )
