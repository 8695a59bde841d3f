"""3. Line dedup by a log-template tree: lines whose template recurs across documents are dropped.

A line's tokens are its words, with ``<*>`` for one that holds a digit. The tree has a fixed depth: a line goes to the leaf
of its token count and its first ``lead`` tokens, and leaves that fewer than ``min_docs`` documents reach end there. In a
leaf a line that stands in ``min_docs`` documents is a template as it is. Beyond the leading tokens, one is constant where
at least ``min_docs`` different lines of the leaf, from two documents or more, have it at that place, however large the leaf
is, and a variable field (``<*>``) otherwise. A template with at least half of its tokens constant, all of whose lines
together stand in ``min_docs`` documents, recurs. Equal lines of a leaf are one row before any are compared token by token,
so a line that very many documents share is no large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import SPACES, let, whole
from tallymark.session import cut, free

FIELD = "<*>"
#: A whole word that holds a digit; possessive, so that words of any length take time in proportion.
DIGIT_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Leaves that are sent to every task at most, about 50 MB; beyond that they are joined by shuffle.
FEW = 2_000_000


def _lines(docs: DataFrame, lead: int) -> DataFrame:
    """(d, line, t, leaf) of all lines with a word, fields masked in t, for rows (d, text)."""
    masked = F.regexp_replace("text", DIGIT_WORD, FIELD)
    found = docs.select("d", F.posexplode_outer(F.split(masked, "\n")).alias("line", "t")).withColumn("t", F.btrim("t", F.lit(" \t\x0b\x0c\r")))
    leaf = let(F.split("t", SPACES), lambda w: F.xxhash64(F.size(w), F.slice(w, 1, lead)))
    return found.filter("t <> ''").select("d", "line", "t", leaf.alias("leaf"))


def recurring_lines(docs: DataFrame, lead: int = 4, min_docs: int = 5) -> DataFrame:
    """(d, line) of the lines to drop, for rows (d, text) with d a 64-bit document key."""
    lines = cut(_lines(docs, lead))
    # A template stands in no more documents than its leaf: all other lines go before any token moves.
    reached = lines.select("leaf", "d").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    reached = cut(reached.select("leaf"))
    shared = F.broadcast(reached) if reached.count() <= FEW else reached
    met = lines.join(shared, "leaf", "left_semi").select("d", "line", "leaf", F.split("t", SPACES).alias("tokens"))
    met = cut(met.withColumn("same", F.xxhash64("tokens")))
    free(lines, reached)
    per_doc = met.groupBy("leaf", "same", "d").agg(F.count("*").alias("n"))
    kinds = per_doc.groupBy("leaf", "same").agg(F.count("*").alias("docs"), F.min("d").alias("low"), F.max("d").alias("high"))
    kinds = cut(kinds)
    texts = met.select("leaf", "same", "tokens").join(kinds.select("leaf", "same", "low", "high"), ["leaf", "same"]).dropDuplicates(["leaf", "same"])
    # The leading tokens are the leaf's own: only what follows is compared, so that no place is one key for a whole leaf.
    lead_fixed, after = F.size(F.filter(F.slice("tokens", 1, lead), lambda x: x != FIELD)), F.slice("tokens", lead + 1, F.greatest(F.size("tokens") - lead, F.lit(0)))
    cells = texts.select("leaf", "same", "low", "high", F.size("tokens").alias("n"), lead_fixed.alias("lead_fixed"), F.posexplode_outer(after).alias("at", "token"))
    held = cells.filter((F.col("token") != FIELD)).groupBy("leaf", "at", "token").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    constant = held.filter((F.col("low") < F.col("high")) & (F.col("n") >= min_docs)).select("leaf", "at", "token", F.lit(True).alias("fixed"))
    filled = cells.join(constant, ["leaf", "at", "token"], "left").select("leaf", "same", "n", "lead_fixed", "at", F.when(F.col("at").isNotNull(), F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD))).alias("token"))
    template = filled.groupBy("leaf", "same", "n", "lead_fixed").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "token")))).alias("cells"))
    fixed = F.col("lead_fixed") + F.size(F.filter("cells", lambda x: x["token"] != FIELD))
    template = template.filter(fixed * 2 >= F.col("n")).select("leaf", "same", F.xxhash64("leaf", F.transform("cells", lambda x: x["token"])).alias("template"))
    template = cut(template)
    wide = met.select("leaf", "same", "d").distinct().join(template, ["leaf", "same"]).select("template", "d").distinct()
    often = wide.groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).select("template")
    drop = kinds.filter(F.col("docs") >= min_docs).select("leaf", "same").unionByName(template.join(often, "template", "left_semi").select("leaf", "same"))
    return met.select("d", "line", "leaf", "same").join(drop, ["leaf", "same"], "left_semi").select("d", "line")


def drop_templates(docs: DataFrame, doc_id="doc_id", text="text", lead: int = 4, min_docs: int = 5) -> DataFrame:
    """``docs`` with its own columns in struct ``row``, ``text`` without the recurring lines, ``n_lines`` and ``dropped`` (line numbers from 0).

    Null and empty texts stay as they are, with one line (null: none) and none dropped; lines without a word always stay.
    Rows equal in id and text are one document. A null id is an id. An empty table gives an empty result; further columns
    stay inside ``row``.
    """
    key = F.xxhash64(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    drop = recurring_lines(docs.select(key.alias("d"), F.col(f"`{text}`").alias("text")), lead, min_docs)
    marks = drop.groupBy("d").agg(F.sort_array(F.collect_set("line")).alias("dropped")).select(F.col("d").alias("k"), "dropped")
    rows = whole(docs, key.alias("d"), F.col(f"`{text}`").alias("text")).join(marks, F.col("d") == F.col("k"), "left")
    none = F.array().cast("array<int>")
    rows = rows.select("row", "text", F.coalesce("dropped", none).alias("dropped"), F.split("text", "\n").alias("lines"))
    kept = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("dropped", i)), "\n"))
    return rows.select("row", kept.alias("text"), F.coalesce(F.when(F.col("text").isNull(), 0), F.size("lines")).alias("n_lines"), "dropped")
