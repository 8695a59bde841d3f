"""7. Quality rules: thresholds from mergeable quantile sketches per language and source, then a joined filter.

The sketch of a metric is a histogram with a fixed bin width over a bounded integer range: at most ``BINS`` counters a
group, merged by adding counters, independent of order and partitioning. A (language, source) group with fewer than
``min_group`` documents merges into its language, that into the whole corpus. The fence of a group is its third quartile
(first for a lower one) plus (minus) ``reach`` times its interquartile range, which counts as ``spread`` at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.common import indices, pick, whole, words
from tallymark.session import cut

WIDTH, BINS = 5, 400
#: name: (numerator, denominator, scale, least interquartile range, fences used)
METRICS = {
    "symbols": ("n_symbols", "n_words", 1000, 60, ("hi",)),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 120, ("hi",)),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, ("hi",)),
    "word_len": ("word_chars", "n_words", 100, 120, ("lo", "hi")),
    "capitals": ("n_capitals", "word_chars", 1000, 80, ("hi",)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _repeat_words(trigrams: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: equal hashes stand together once sorted with their places."""
    placed = F.array_sort(F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    with_next = F.arrays_zip(placed.alias("a"), F.slice(placed, 2, F.size(placed)).alias("b"))
    pairs = F.filter(with_next, lambda x: x["a"]["h"] == x["b"]["h"])
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x["a"]["i"], x["b"]["i"])))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def measured(df: DataFrame, text: str) -> DataFrame:
    """Adds ``COUNTS`` (long) for the text column. Null text counts as empty; every count of an empty text is 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = df.columns
    df = df.withColumns({"__w": words(F.col(text)), "__l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumn("__t", F.transform(indices(F.size("__w") - 2), lambda i: F.xxhash64(*[F.get(F.col("__w"), i + j) for j in range(3)])))
    none = F.size(F.array_distinct("__t")) == F.size("__t")
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(none, F.lit(0)).otherwise(_repeat_words(F.col("__t"))),
        "n_lines": F.size("__l"),
        "n_capitals": F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    }
    return df.select(*[F.col(f"`{c}`") for c in keep], *[v.cast("long").alias(k) for k, v in counts.items()])


def _value(name: str) -> Column:
    top, under, scale, _, _ = METRICS[name]
    return F.least(F.floor(F.col(top) * scale / F.greatest(F.col(under), F.lit(1))), F.lit(WIDTH * BINS - 1)).cast("long")


def sketches(counted: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, metric, bin, n): partial counts meet per counter, so a hot source is a few rows a task."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.floor(_value(m) / WIDTH).alias("bin")) for m in METRICS])
    return counted.select("lang", "source", F.inline(values)).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, min_group: int = 100, reach: int = 3) -> DataFrame:
    """A row per (lang, source) with lo_/hi_ fences of each metric, from the finest level with ``min_group`` documents."""
    lv = [sketch.select("lang", "source", "metric", "bin", "n", F.lit(2).alias("level"))]
    lv.append(sketch.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "metric", "bin", "n", F.lit(1).alias("level")))
    lv.append(sketch.groupBy("metric", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "metric", "bin", "n", F.lit(0).alias("level")))
    group = W.partitionBy("level", "lang", "source", "metric")
    at = lv[0].unionByName(lv[1]).unionByName(lv[2]).withColumns({"upto": F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    q = at.groupBy("level", "lang", "source", "metric").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
    )
    spread = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v[3])) for m, v in METRICS.items()])
    far = F.lit(reach) * F.greatest((F.col("q3") - F.col("q1")) * WIDTH, spread)
    q = q.select("level", "lang", "source", "metric", "total", (F.col("q1") * WIDTH - far).alias("lo"), ((F.col("q3") + 1) * WIDTH + far).alias("hi"))
    wide = q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m, v in METRICS.items() for side in v[4]])
    fences = [f"{side}_{m}" for m, v in METRICS.items() for side in v[4]]
    at_level = lambda k, *keys: wide.filter(F.col("level") == k).select(*[F.col(x).alias(f"{x}_{k}") for x in keys], F.struct("total", *fences).alias(f"f{k}"))
    own, by_lang, all_ = at_level(2, "lang", "source"), at_level(1, "lang"), at_level(0)
    joined = own.join(by_lang, F.col("lang_2").eqNullSafe(F.col("lang_1")), "left").join(all_, F.lit(True), "left")
    use = F.when(F.col("f2")["total"] >= min_group, F.col("f2")).when(F.col("f1")["total"] >= min_group, F.col("f1")).otherwise(F.col("f0"))
    return joined.select(F.col("lang_2").alias("t_lang"), F.col("source_2").alias("t_source"), use.alias("f")).select("t_lang", "t_source", *[F.col("f")[x].alias(x) for x in fences])


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _within() -> Column:
    ok = F.lit(True)
    for m, v in METRICS.items():
        for side in v[4]:
            ok = ok & ((_value(m) >= F.col(f"lo_{m}")) if side == "lo" else (_value(m) <= F.col(f"hi_{m}")))
    return F.coalesce(ok, F.lit(True))


def _judged(counted: DataFrame, fences: DataFrame) -> DataFrame:
    joined = counted.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & _within())


def quality_report(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", source="source", min_group=100, reach=3) -> DataFrame:
    """One row per input row: id, counts, ``base_failed``, ``kept``.

    Null language or source is a group of its own; null or empty text has 0 words and fails the base rule; repeated ids
    and rows each get their row; an empty table gives an empty result; further columns are not read.
    """
    counted = cut(measured(pick(docs, doc_id=doc_id, text=text, lang=lang, source=source), "text").drop("text"))
    return _judged(counted, thresholds(sketches(counted), min_group, reach)).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])


def keep_quality(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", source="source", min_group=100, reach=3) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; cases as in ``quality_report``."""
    rows = whole(docs, F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    counted = cut(measured(rows, "text").drop("text"))
    return _judged(counted, thresholds(sketches(counted), min_group, reach)).filter("kept").select("row.*")
