"""10. Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted check.

Texts and items become words (A-Z lowered, ASCII punctuation at either end left out). An item of n words is met by
windows of n words; one that would reach over an edge of the text is moved inside, and a shorter text is one window. A window that shares no 5-word shingle with any item has weighted similarity 0 to all of them, and of
the windows over a shared passage those that put a shared shingle where the item has it overlap the item most; so just
these are fingerprinted, whatever the number of items. A fingerprint is the 64-bit SimHash of a window's words with their counts as weights. Fingerprints within ``radius`` agree in one of
``radius + 1`` blocks of bits at least, so an equality join per block finds all of them. What is found is kept if the
weighted Jaccard similarity of the 5-word shingle counts (sum of least over sum of greatest) is ``percent`` / 100 or more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import indices, let, lower_ascii, pick, shingles, whole, words
from tallymark.session import cut

BITS = 64
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
#: Shared shingles of all items that are sent to every task at most, about 100 MB; beyond that they are joined by shuffle.
FEW = 4_000_000


def _plain_words(text: Column) -> Column:
    bare = F.transform(words(lower_ascii(text)), lambda w: F.regexp_replace(w, f"^{PUNCTUATION}+|{PUNCTUATION}+$", ""))
    return F.filter(bare, lambda w: w != "")


def _hashed(df: DataFrame, k: int) -> DataFrame:
    """``text`` to arrays ``w`` (a 64-bit hash per word) and ``g`` (per k-word shingle, in order)."""
    keep = [c for c in df.columns if c != "text"]
    found = df.select(*keep, _plain_words(F.col("text")).alias("p"))
    found = found.select(*keep, F.transform("p", lambda x: F.xxhash64(x)).alias("w"), shingles(F.col("p"), k).alias("g"))
    return found.withColumn("g", F.when((F.size("w") > 0) & (F.size("w") < k), F.array(F.xxhash64("w"))).otherwise(F.col("g")))


def simhash(weights: dict[int, int]) -> int:
    """64-bit SimHash (signed) of hashed features with weights."""
    h = np.fromiter(weights.keys(), np.int64, len(weights)).view(np.uint64)
    v = np.fromiter(weights.values(), np.int64, len(weights))
    signs = ((h[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
    on = (signs * v[:, None]).sum(0) > 0
    return int((on.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, start, n, w, g of the window) to (key, start, n, g, words, f)."""
    for b in batches:
        yield b.drop(columns="w").assign(words=[len(w) for w in b["w"]], f=np.array([simhash(Counter(np.asarray(w).tolist())) for w in b["w"]], np.int64))


def _blocks(f: Column, radius: int) -> Column:
    """Array of (block number, value): radius + 1 runs of bits that make up the fingerprint."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    value = lambda a, z: F.shiftrightunsigned(f, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("i"), value(a, z).alias("v")) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))])


def _counts(g: Column) -> Column:
    """Distinct (shingle, count) of an array."""
    return let(g, lambda s: F.transform(F.array_distinct(s), lambda x: F.struct(x.alias("x"), F.size(F.filter(s, lambda y: y == x)).alias("n"))))


def _weighted(a: Column, b: Column) -> tuple[Column, Column]:
    """Sum of least and sum of greatest counts of two shingle arrays; both are item-sized."""
    least = F.aggregate(_counts(a), F.lit(0), lambda acc, x: acc + F.least(x["n"], F.size(F.filter(b, lambda y: y == x["x"]))))
    return least, F.size(a) + F.size(b) - least


def contaminated(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", k: int = 5, radius: int = 22, percent: int = 80) -> DataFrame:
    """Rows (doc_id, item_id, start, n_words, distance, similarity): windows of documents that repeat a benchmark item.

    ``start`` counts words; ``n_words`` is less than the item's where the whole text is shorter than the item. The radius finds
    0.999 and more of the windows at a similarity of 0.8, as measured for items of 13 to 200 words. Null and empty texts have no words: such documents and items meet nothing, and neither do
    items of no words; an item of fewer than k words is one shingle and is met wherever a text has just these words. Rows
    that repeat a doc_id or item_id are found each for itself and listed once. Null ids are kept as null. Empty tables
    give an empty result; further columns are not read.
    """
    wanted = cut(_hashed(pick(items, item_id=item_id, text=item_text), k).filter(F.size("w") > 0).withColumn("n", F.size("w")))
    places = wanted.select(F.posexplode("g").alias("q", "x"), "n").distinct().groupBy("x").agg(F.collect_set(F.struct("q", "n")).alias("at"))
    places = cut(places)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    few = places.count() <= FEW
    hashed = _hashed(own, k)
    short = [r["n"] for r in wanted.filter(F.col("n") < k).select("n").distinct().collect()]
    runs = [let(F.lit(m), lambda n: F.transform(indices(F.size("w") - n + 1), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice("w", i + 1, n)).alias("x")))) for m in sorted(short)]
    every = F.concat(F.transform("g", lambda x, i: F.struct(i.alias("p"), x.alias("x"))), *runs) if short else None
    parts = F.inline_outer(every) if short else F.posexplode_outer("g").alias("p", "x")
    met = hashed.select("doc_id", "tie", F.size("w").alias("size"), parts).join(F.broadcast(places) if few else places, "x")
    windows = met.select("doc_id", "tie", "size", "p", F.inline("at")).select("doc_id", "tie", (F.col("p") - F.col("q")).alias("start"), "n", "size")
    inside = F.greatest(F.least(F.col("start"), F.col("size") - F.col("n")), F.lit(0))
    windows = cut(windows.select("doc_id", "tie", inside.alias("start"), "n").distinct())
    spans = windows.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("at"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "at")
    texts = own.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "at", "text").dropDuplicates(["doc_id", "tie"])
    here = _hashed(texts, k).select("doc_id", "tie", F.explode("at").alias("s"), "w", "g")
    sizes = F.greatest(F.col("s.n") - (k - 1), F.lit(1))
    here = here.select("doc_id", "tie", "s.start", "s.n", F.slice("w", F.col("s.start") + 1, F.col("s.n")).alias("w"), F.slice("g", F.col("s.start") + 1, sizes).alias("g"))
    here = here.withColumn("g", F.when(F.col("n") < k, F.array(F.xxhash64("w"))).otherwise(F.col("g")))
    ids = docs.schema[doc_id].dataType.simpleString()
    here = cut(here.mapInPandas(_fingerprints, f"doc_id {ids}, tie long, start int, n int, g array<bigint>, words int, f long"))
    items_ids = items.schema[item_id].dataType.simpleString()
    keyed = cut(wanted.select("item_id", "n", "w", "g").mapInPandas(_fingerprints, f"item_id {items_ids}, n int, g array<bigint>, words int, f long"))
    # Equal windows of many documents are one row here.
    lone = here.select("n", "f", "g").distinct()
    a = lone.select("n", "f", "g", F.inline(_blocks(F.col("f"), radius)))
    b = keyed.select("item_id", "n", F.col("f").alias("f2"), F.col("g").alias("g2"), F.inline(_blocks(F.col("f"), radius)))
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("f2")))
    pairs = a.join(b, ["n", "i", "v"]).filter(distance <= radius).select("n", "f", "g", "item_id", "f2", "g2", distance.alias("distance")).distinct()
    least, most = _weighted(F.col("g"), F.col("g2"))
    sure = pairs.withColumns({"least": least, "most": most}).filter(F.col("least") * 100 >= F.col("most") * percent)
    sure = cut(sure.select("n", "f", "g", "item_id", "distance", (F.col("least") / F.col("most")).alias("similarity")))
    return here.drop("tie").join(sure, ["n", "f", "g"]).select("doc_id", "item_id", "start", F.col("words").alias("n_words"), "distance", "similarity").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id="doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no window found, all columns; a row with null doc_id goes if a null one was found."""
    bad = contaminated(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias("d")).distinct()
    rows = whole(docs, F.col(f"`{doc_id}`").alias("i"))
    return rows.join(bad, F.col("i").eqNullSafe(F.col("d")), "left_anti").select("row.*")
