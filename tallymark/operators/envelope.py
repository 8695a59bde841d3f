"""The result inside a webhook reply: objects under known keys, one-element arrays and JSON within strings, at most five levels down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import cut

#: Keys that are looked under, in order, and the deepest level.
WRAPPERS, DEPTH = ("json", "body", "data", "ocr_result", "verification_result"), 5


def unwrap(replies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, status, verdict, reason_code, provider, error_code) of each reply.

    A decision has a status and a verdict or reason; an extraction has fields that are an object or null and a provider, raw text or
    confidence. At each object its own decision comes first, then one under ``verification``, then its own extraction, then what
    the wrappers hold. Levels are unfolded as rows; the first hit in that order is the result. A blank reply is
    N8N_EMPTY_RESPONSE, one without a hit N8N_INVALID_RESPONSE.
    """
    replies = cut(replies.select(key, body))
    text = F.col(f"`{body}`")
    rows = replies.select(F.col(f"`{key}`").alias("key"), F.lit("").alias("path"), F.lit(False).alias("under"), F.coalesce(F.try_parse_json(text), F.try_parse_json(F.to_json(F.struct(text.alias("s"))))).alias("v"), text.alias("text"))
    # A body that is no JSON is a string of its own, which nothing can be found in.
    hits = None
    for level in range(DEPTH + 1):
        rows = rows.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)).filter("v IS NOT NULL AND NOT is_variant_null(v)")
        get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
        is_text = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING"
        fields = F.schema_of_variant(F.try_variant_get("v", "$.fields", "variant"))
        an_object = F.col("kind") == "OBJECT"
        number = F.schema_of_variant(F.try_variant_get("v", "$.confidence", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        decision = F.coalesce(an_object & is_text("status") & (F.coalesce(is_text("verdict"), F.lit(False)) | F.coalesce(is_text("reason_code"), F.lit(False))), F.lit(False))
        extraction = F.coalesce(an_object & fields.rlike("^(OBJECT|VOID)") & (F.coalesce(is_text("provider"), F.lit(False)) | F.coalesce(is_text("raw_text"), F.lit(False)) | F.coalesce(number, F.lit(False))), F.lit(False)) & ~F.col("under")
        found = rows.withColumns({"d": decision, "e": extraction})
        out = found.filter("d OR e").select("key", F.concat("path", F.when(F.col("d"), "0").otherwise("2")).alias("path"), F.when(F.col("d"), "DECISION").otherwise("EXTRACTION").alias("kind"), get("status").alias("status"), get("verdict").alias("verdict"), get("reason_code").alias("reason_code"), get("provider").alias("provider"))
        hits = out if hits is None else hits.unionByName(out)
        if level == DEPTH:
            break
        child = lambda step, v, under=False: F.struct(F.concat("path", F.lit(step)).alias("path"), (F.col("under") | F.lit(under)).alias("under"), v.alias("v"))
        within = [child("1", F.try_variant_get("v", "$.verification", "variant"), True)] + [child(str(3 + i), F.try_variant_get("v", f"$.{w}", "variant")) for i, w in enumerate(WRAPPERS)]
        many = F.try_variant_get("v", "$", "array<variant>")
        inner = F.when(F.col("kind") == "STRING", F.array(child("3", F.try_parse_json(F.trim(F.try_variant_get("v", "$", "string"))))))
        inner = inner.when((F.col("kind") == "ARRAY") & (F.size(many) == 1), F.array(child("3", F.get(many, F.lit(0))))).when(an_object & ~decision, F.array(*within))
        rows = found.select("key", F.explode(inner).alias("c"), "text").select("key", "c.path", "c.under", "c.v", "text").filter("v IS NOT NULL")
    first = hits.groupBy(F.col("key").alias("k")).agg(F.min_by(F.struct("kind", "status", "verdict", "reason_code", "provider"), "path").alias("m"))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    every = replies.select(F.col(f"`{key}`").alias("key"), blank.alias("blank"))
    joined = every.join(first, F.col("key").eqNullSafe(F.col("k")), "left").withColumn("error_code", F.when(F.col("blank"), "N8N_EMPTY_RESPONSE").when(F.col("m").isNull(), "N8N_INVALID_RESPONSE"))
    return joined.select("key", "m.kind", "m.status", "m.verdict", "m.reason_code", "m.provider", "error_code")
