"""2. URL filters: longest fitting rule, else logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark's own DataFrame-based logistic regression; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import indices, lower_ascii, whole

#: (action, host, path prefix) in the order of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DIM = 1 << 12
GRAMS = (3, 4)
#: Parts of host names from which the small training table is labelled.
BAD_PARTS = ("spam", "pills", "casino", "cheap", "bets", "porn", "loans", "warez", "viagra", "xxx")
TRAIN_ROWS = 20_000


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lowered, and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest fitting rule, null if none fits; of equally long rules a block wins.

    A handful of rules is a chain of conditions; it is part of the plan, not data.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = lambda h, p: (host.eqNullSafe(F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
    found = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))) for action, h, p in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,action:string>")


def _ngrams(framed: Column, n: int, side: str) -> Column:
    return F.transform(indices(F.length(framed) - (n - 1)), lambda i: F.concat(F.lit(side), F.substring(framed, i + 1, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, marked by the side that they come from."""
    found = []
    for side, c in (("h", host), ("p", path)):
        framed = F.concat(F.lit("^"), c, F.lit("$"))
        for n in GRAMS:
            found.append(_ngrams(framed, n, side))
    return F.concat(*found)


def labelled_urls(pages: DataFrame, url="url", rows=TRAIN_ROWS) -> DataFrame:
    """Small training table (host, path, label): the ``rows`` distinct URLs of least hash, label 1 for a host with a known bad part."""
    host, path = host_and_path(_text(url))
    bad = reduce(lambda a, b: a | b, [F.col("host").contains(p) for p in BAD_PARTS])
    found = pages.select(host.alias("host"), path.alias("path")).filter(F.col("host") != "").distinct()
    return found.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows).withColumn("label", bad.cast("double"))


def train(labelled: DataFrame, reg=1e-3, iterations=30) -> PipelineModel | None:
    """Fit on (host, path, label); None where a class is missing, as there is nothing to learn.

    The caller bounds ``labelled``; ``DIM`` coefficients are the most that reaches the driver.
    """
    if len(labelled.select("label").distinct().take(2)) < 2:
        return None
    hashed = HashingTF(numFeatures=DIM, binary=True, inputCol="grams", outputCol="features")
    fit = LogisticRegression(regParam=reg, maxIter=iterations, standardization=False)
    return Pipeline(stages=[hashed, fit]).fit(labelled.select(grams(F.col("host"), F.col("path")).alias("grams"), "label"))


def judge(pages: DataFrame, model: PipelineModel | None, url="url", rules=RULES, cutoff=0.5) -> DataFrame:
    """``pages`` as struct ``row`` with host, path, rule, score (chance of block) and verdict.

    Null URLs and those without ``://`` have empty host and path, fit no rule and get the model's verdict on empty
    strings; without a model the score is null and the verdict allow. Every row gets its own result, repeated or not;
    further columns stay inside ``row``; an empty table gives an empty result.
    """
    host, path = host_and_path(_text(url))
    found = whole(pages, host.alias("host"), path.alias("path")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    if model is None:
        found = found.withColumn("score", F.lit(None).cast("double"))
    else:
        kept = ["row", "host", "path", "fit"]
        found = model.transform(found.withColumn("grams", grams(F.col("host"), F.col("path")))).select(*kept, vector_to_array("probability")[1].alias("score"))
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("score") > cutoff, "block").otherwise("allow"))
    return found.select("row", "host", "path", F.col("fit.rule").alias("rule"), "score", verdict.alias("verdict"))
