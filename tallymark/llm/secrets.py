"""6. Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Candidates are runs of 20 or more characters of ``[A-Za-z0-9+/_=-]``. Each gets an encoding (hex, base32 or base64) and,
over its symbols' numbers in that alphabet, a chi-squared test of uniformity, a runs test about the middle and a lag-1
serial correlation; three times the least p-value is ``p_random``. Under the opposite null, ordinary text, the ratio of
the likelihood of its character classes as in the whole corpus to the uniform one is a p-value ``p_text`` (Markov's
inequality). A candidate is reported if randomness isn't rejected (``p_random >= alpha``) and ordinary text is, by
Benjamini-Hochberg at level ``q`` among the candidates of its own length band (powers of two).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.common import pick
from tallymark.session import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789"}
STEP = 2  # bins of p_text a power of ten


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): code point spans and texts of the leftmost non-overlapping matches.

    What stands between matches is ``split``'s result, so places are sums of lengths.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["h"])
        return F.struct(e.alias("at"), F.array_append(acc["found"], F.struct(s.alias("s"), e.alias("e"), x["h"].alias("m"))).alias("found"))

    folded = F.aggregate(F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("b"), hits.alias("h")), start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), folded).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _p_value(z: Column) -> Column:
    """Two-sided normal p-value by a rational approximation of erfc, good to about 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * F.lit(1.061405429)))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), poly * F.exp(-x * x)))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _battery(encoding: str, m: Column) -> Column:
    alphabet = ALPHABETS[encoding]
    k = len(alphabet)
    text = F.lower(m) if encoding == "hex" else F.rtrim(F.translate(m, "-_=", "+/ "))
    n = F.length(text).cast("double")
    numbers = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    counts = F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
    z_chi = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    pairs = F.arrays_zip(F.slice(numbers, 1, F.size(numbers) - 1).alias("a"), F.slice(numbers, 2, F.size(numbers) - 1).alias("b"))
    high = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + (v >= k // 2).cast("double"))
    runs = F.aggregate(pairs, F.lit(1.0), lambda a, p: a + ((p["a"] >= k // 2) != (p["b"] >= k // 2)).cast("double"))
    both = 2 * high * (n - high)
    z_runs = F.when(both > n, (runs - 1 - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(9.0))
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v * v) - n * mean * mean
    cov = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["a"] * p["b"])
    z_serial = F.when(var > 0, (cov - (n - 1) * mean * mean) / var * F.sqrt(n)).otherwise(F.lit(9.0))
    return F.least(F.lit(1.0), 3 * F.least(_p_value(z_chi), _p_value(z_runs), _p_value(z_serial)))


def _candidates(text: Column) -> Column:
    """Array of (s, e, p_random, n, lower, upper, digit, size): a candidate's place, p-value, class counts and alphabet size."""

    def one(x: Column) -> Column:
        m = x["m"]
        encoding = F.when(m.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "hex").when(m.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")
        p = F.when(encoding == "hex", _battery("hex", m)).when(encoding == "base32", _battery("base32", m)).otherwise(_battery("base64", m))
        size = F.when(encoding == "hex", 16).when(encoding == "base32", 32).otherwise(64)
        mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")  # neither numbers nor words
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(mixed, p).otherwise(F.lit(0.0)).alias("p_random"), F.length(m).alias("n"), *[_count(m, chars).alias(c) for c, chars in CLASSES.items()], size.alias("size"))

    return F.transform(_matches(text, CANDIDATE), one)


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    kind = lambda name, found: F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(name)).alias("k"), x["e"].alias("e")))
    assign = F.filter(_matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(kind("assign", assign), kind("access", _matches(text, ACCESS)), kind("hex", _matches(text, HEX))))
    return docs.select("doc_id", base.alias("base"), _candidates(text).alias("candidates"), F.length(text).alias("chars"), *[_count(text, chars).alias(c) for c, chars in CLASSES.items()])


def secret_spans(docs: DataFrame, doc_id="doc_id", text="text", alpha: float = 0.001, q: float = 0.01) -> DataFrame:
    """One row per input row: doc_id, ``base`` and ``spans``, arrays of (s, k, e) with k an index into ``KINDS``, in order.

    Null text counts as empty and has no spans; null and repeated ids and rows each get their row; an empty table gives an
    empty result; further columns are not read. A candidate that overlaps a base span adds nothing. Texts are read once;
    class totals (one row) and thresholds (one row per length band, 32 at most) come to the driver.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    found = cut(_scanned(rows))
    total = found.agg(F.sum("chars").alias("chars"), *[F.sum(c).alias(c) for c in CLASSES]).first()
    chars = (total["chars"] or 0) + 64
    share = {c: ((total[c] or 0) + 16) / chars for c in CLASSES}
    other = max(1 - sum(share.values()), 1 / chars)

    def binned(x: Column) -> Column:
        rest = x["n"] - sum((x[c] for c in list(CLASSES)[1:]), x["lower"])
        log_text = sum((x[c] * math.log10(share[c] / len(chars_)) for c, chars_ in CLASSES.items()), rest * math.log10(other / 4))
        p = log_text + x["n"] * F.log10(x["size"].cast("double"))
        return F.floor(F.least(F.greatest(-p, F.lit(0.0)), F.lit(99.0)) * STEP).cast("int")

    band = lambda x: F.floor(F.log2(x["n"].cast("double"))).cast("int")
    marked = found.withColumn("candidates", F.transform("candidates", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["p_random"].alias("p_random"), band(x).alias("band"), binned(x).alias("bin"))))
    bins = marked.select(F.explode("candidates").alias("x")).groupBy("x.band", "x.bin").agg(F.count("*").alias("n"))
    by_band = W.partitionBy("band")
    ranked = bins.withColumns({"rank": F.sum("n").over(by_band.orderBy(F.desc("bin"))), "m": F.sum("n").over(by_band)})
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / STEP) * F.col("m") <= q * F.col("rank"))
    least = {r["band"]: r["bin"] for r in passed.groupBy("band").agg(F.min("bin").alias("bin")).collect()}
    clear = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    over = lambda x: F.coalesce(*[F.when(x["band"] == b, x["bin"] >= v) for b, v in sorted(least.items())], F.lit(False))
    added = F.transform(F.filter("candidates", lambda x: (x["p_random"] >= alpha) & over(x) & clear(x)), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), x["e"].alias("e")))
    return marked.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")
