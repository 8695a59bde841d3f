"""Connected components of a link table, by alternating stars over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import cut, free

#: Links of a task from here on: small tables take few tasks, whatever number of shuffle partitions is set.
PER_TASK = 50_000


def in_tasks(df: DataFrame, rows: int, each: int = PER_TASK) -> DataFrame:
    """``df``, of some ``rows`` rows after a shuffle, in tasks of about ``each`` rows."""
    return df.coalesce(rows // each + 1)


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b) but the roots; a root is the least vertex of its component.

    Each round hangs a vertex's larger neighbours, then itself and its smaller ones, on the least neighbour; rounds grow
    with the logarithm of a component's diameter. Minima meet as one row per vertex and task, so a hub is no large group.
    Links of a vertex to itself and nulls are ignored; an empty table gives an empty result. The result is a table in the
    shared folder, for the caller to ``free``.
    """
    now = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(in_tasks(least, 2 * n), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(in_tasks(in_tasks(large, n).distinct(), n))
        least = in_tasks(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = in_tasks(small, n).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(in_tasks(small.distinct(), n))
        free(now, large)
        now = after
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            found = now.select(F.col("u").alias("v"), F.col("v").alias("root"))
            found.scratch_path = now.scratch_path
            return found
        seen, n = mark, mark["n"]
