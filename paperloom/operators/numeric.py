"""Row-wise numerics of language models over arrays of logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body's own lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column, mask: Column | None = None) -> Column:
    """Probabilities, in time linear in the logits; masked entries (mask false) are exactly zero."""
    values = F.transform(logits, lambda x: x.cast("double"))
    if mask is not None:
        values = F.zip_with(values, mask, lambda x, m: F.when(m, x))
    shifted = let(values, lambda v: let(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda s: F.transform(s["v"], lambda x: F.coalesce(F.exp(x - s["top"]), F.lit(0.0)))))
    total = lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda s, x: s + x).alias("total"))
    return let(shifted, lambda p: let(total(p), lambda t: F.transform(t["p"], lambda x: x / t["total"])))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Minus the log probability of a 0-based target."""
    return -F.log(F.get(softmax(logits), target))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(709.782712893384)))


def top_k(rows: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """(id, rank, token_id, probability) of the k largest logits, ties to the lower id, renormalised; rows: id, logits."""
    scaled = F.transform("logits", lambda x: x.cast("double") / temperature)
    ordered = F.slice(F.sort_array(F.transform(scaled, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))), 1, k)
    best = rows.select("id", ordered.alias("best"))
    p = softmax(F.transform("best", lambda x: -x["neg"]))
    best = best.select("id", F.posexplode(F.arrays_zip(F.col("best.i").alias("i"), p.alias("p"))).alias("at", "x"))
    return best.select("id", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.i").cast("long").alias("token_id"), F.round("x.p", 6).alias("probability"))
