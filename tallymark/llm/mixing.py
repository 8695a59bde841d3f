"""8. Mixing sources to target weights: Poisson replication.

A source's rate is its target share of the output over its documents, ``size * weight / sum of weights / n``. A document's
copies are the inverse of the Poisson distribution with that mean at a uniform number seeded by its id, so no state is
shared and a rerun gives the same. The cumulative probabilities are made once for each source. Copies are exploded and put in the order of a hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import let, whole
from tallymark.session import cut


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits from an md5 of key and seed; a null key counts as empty."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def cumulative(mean: Column) -> Column:
    """Cumulative Poisson probabilities at 0, 1, .. as far as they grow, for means up to 30."""

    def of(m: Column) -> Column:
        start = F.struct(F.exp(-m).alias("p"), F.array(F.exp(-m)).alias("c"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * m / k
            return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

        return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.lit(30 + 12 * 6 + 20)), start, step, lambda acc: acc["c"]))

    return let(mean, of)


def drawn(u: Column, parts: Column, table: Column) -> Column:
    """Sum of ``parts`` draws by inversion: u for the first, its hashes for the rest; a draw is how many of ``table`` are not above it."""
    one = lambda v, c: F.size(F.filter(c, lambda x: x <= v))
    rest = lambda x, i: let(F.struct(uniform(F.concat_ws("/", x["u"].cast("string"), i.cast("string")), "part").alias("v"), x["c"].alias("c")), lambda y: one(y["v"], y["c"]))
    many = lambda x: F.aggregate(F.sequence(F.lit(2), x["parts"]), one(x["u"], x["c"]), lambda a, i: a + rest(x, i))
    return let(F.struct(u.alias("u"), parts.alias("parts"), table.alias("c")), lambda x: F.when(x["parts"] == 1, one(x["u"], x["c"])).otherwise(many(x)))


def parts_of(rate: Column) -> Column:
    """A mean above 30 is a sum of this many independent ones of 30 or less each, so that no term underflows."""
    return F.greatest(F.ceil(rate / 30), F.lit(1)).cast("int")


def poisson(u: Column, rate: Column) -> Column:
    """Least k with u below the Poisson cumulative probability at k; 0 for rates not above 0."""
    return F.when(rate > 0, drawn(u, parts_of(rate), cumulative(rate / parts_of(rate)))).otherwise(F.lit(0))


def tempered(docs: DataFrame, source="source", power: float = 0.5) -> DataFrame:
    """Target weights (source, weight) proportional to a power of each source's documents; a null source is one too."""
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n")).select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame, doc_id="doc_id", source="source", size: int | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` as struct ``row`` with ``copy`` (from 1), the source's ``rate`` and ``place``, in the order of ``place``.

    ``size`` is the expected number of rows, by default that of ``docs``. A source without weight, or with weight null or
    not above 0, gives no rows; null sources match a null in ``weights``. A null doc_id is one key; rows that repeat a doc_id
    have equal copies. An empty table gives an empty result. Only counts per source are gathered; documents meet them in
    a join whose document side can be split at any row, so a hot source is no large group.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    found = counts.join(weights.select(F.col("source").alias("w"), "weight").filter("weight > 0"), F.col("source").eqNullSafe(F.col("w")))
    all_ = counts.agg(F.sum("n").alias("docs")).join(found.agg(F.sum("weight").alias("weights")), F.lit(True))
    target = F.lit(size) if size is not None else F.col("docs")
    rates = found.join(all_, F.lit(True)).select(F.col("source").alias("s"), (target * F.col("weight") / F.col("weights") / F.col("n")).alias("rate"))
    rates = cut(rates.withColumn("parts", parts_of(F.col("rate"))).withColumn("table", cumulative(F.col("rate") / F.col("parts"))))
    rows = whole(docs, F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").cast("string").alias("key"))
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("s")))
    copies = joined.withColumn("copies", drawn(uniform(F.col("key"), seed), F.col("parts"), F.col("table"))).filter("copies > 0")
    out = copies.select("row", "rate", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    place = F.md5(F.concat_ws(":", F.coalesce("key", F.lit("")), F.col("copy").cast("string"), F.lit(f"{seed} order")))
    # An md5 is uniform: its leading digits give the range without a first pass that samples.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")
    return out.select("row", "copy", "rate", place.alias("place")).repartitionById(n, part).sortWithinPartitions("place")
