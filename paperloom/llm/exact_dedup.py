"""Exact duplicates by distributed MSD radix partitioning.

The first digit of a text is its length with its first bytes; each later digit is the next run of
bytes, sixteen times as wide as the one before.  A round counts the rows of each (group, digit),
gives every digit that several rows share a new group, and ends the rows that are alone.  Bytes
are compared as bytes: no digest decides equality.  Counting combines on the map side, so a group
that holds a third of all rows costs one row per task there; the join back is a sorted equi-join
against the keys that several rows share, which spills and which adaptive execution splits when
one key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch

#: Bytes of the first digit after the length, and the growth of later ones.
FIRST_DIGIT, GROWTH = 32, 16


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
    full_rows: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the columns of `keep`.

    Of equal texts the row with the largest id stays; null text counts as empty, and a null id is
    smaller than any other.  Of several rows with that id and text exactly one stays.  keep: named
    expressions over docs that are carried along.  full_rows: the original row as struct `row`,
    whatever its columns are called.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "exact")
    keep = keep or {}
    state = docs.select(
        F.col(id_col).alias("id"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("rest"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns] if full_rows else [F.lit(0).alias("none")]).alias("row"),
        F.struct(*[v.alias(k) for k, v in keep.items()] or [F.lit(0).alias("none")]).alias("kept_cols"),
    ).withColumn("gid", F.octet_length("rest").cast("long"))
    width, start, ended, tables = FIRST_DIGIT, 0, [], []
    first = True
    while True:
        digit = F.substring("rest", 1, width)
        keyed = state.withColumn("digit", digit)
        newest = F.lit(None).cast(f"struct<id:{docs.schema[id_col].dataType.simpleString()},rid:bigint>") if first else F.max(F.struct("id", "rid"))
        groups = keyed.groupBy("gid", "digit").agg(F.count("*").alias("n"), newest.alias("newest")).where("n > 1")
        groups = work.save(groups.withColumn("new_gid", F.monotonically_increasing_id()), "groups")
        # the same sorted join at every size: it spills, its cost follows the input, and a hot key can be split
        joined = keyed.join(groups.hint("merge"), ["gid", "digit"], "left")
        if first:
            joined = joined.withColumn("rid", F.monotonically_increasing_id())
        # rows of the first round have no number yet, so a group of theirs ends in the second one at the earliest
        done = F.col("n").isNull() if first else F.col("n").isNull() | (F.octet_length("rest") <= width)
        left = F.when(~done, F.expr(f"substring(rest, {width + 1})"))
        out = work.save(
            joined.select(
                "id", "rid", "kept_cols", "row", F.col("new_gid").alias("gid"), done.alias("done"), left.alias("rest"),
                F.coalesce("n", F.lit(1)).alias("n"),
                F.when(F.coalesce("n", F.lit(1)) == 1, F.col("id")).otherwise(F.col("newest.id")).alias("keep_id"),
                F.when(F.coalesce("n", F.lit(1)) == 1, F.lit(True)).otherwise(F.col("newest.rid") == F.col("rid")).alias("kept"),
            ),
            "round",
        )
        ended.append(out.where("done"))
        if not first:
            work.drop(*tables)
        tables = [groups]
        state = out.where("not done").select("id", "rid", "kept_cols", "row", "gid", "rest")
        if state.isEmpty():
            break
        start += width
        width *= GROWTH
        first = False
    result = ended[0]
    for more in ended[1:]:
        result = result.unionByName(more)
    extra = [F.col("row")] if full_rows else []
    return result.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"), "kept",
        *[F.col(f"kept_cols.{k}").alias(k) for k in keep], *extra,
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return exact_groups(docs, id_col, text_col, full_rows=True).where("kept").select("row.*")
