"""Media inside wrapped chat messages, and typed fields out of a model's reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.session import cut

#: Wrappers of a message in the order they are tried, and how many are peeled.
WRAPPERS, LEVELS = ("ephemeralMessage", "viewOnceMessage", "viewOnceMessageV2", "viewOnceMessageV2Extension", "documentWithCaptionMessage", "editedMessage", "albumMessage"), 4


def _peeled(content: Column) -> Column:
    """The message under up to ``LEVELS`` wrappers, each the first that holds a message."""
    for _ in range(LEVELS):
        content = F.coalesce(*[F.get_json_object(content, f"$.{w}.message") for w in WRAPPERS], content)
    return content


def message_media(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, mimetype, caption) of the image or document of each message, else of the one it quotes; null without one.

    ``mimetype`` is kept for images only.
    """
    own = cut(rows.select(key, _peeled(F.get_json_object(body, "$.message")).alias("own")))
    quoted = cut(own.withColumn("quoted", _peeled(F.get_json_object("own", "$.extendedTextMessage.contextInfo.quotedMessage"))))
    places = [(c, m) for c in ("own", "quoted") for m in ("imageMessage", "documentMessage")]
    found = F.coalesce(*[F.when(F.get_json_object(c, f"$.{m}").isNotNull(), F.struct(F.lit(f"{c} {m}").alias("kind"), F.get_json_object(c, f"$.{m}").alias("media"))) for c, m in places])
    mime = F.get_json_object("f.media", "$.mimetype")
    return quoted.withColumn("f", found).select(key, "f.kind", F.when(mime.startswith("image/"), mime).alias("mimetype"), F.get_json_object("f.media", "$.caption").alias("caption"))


def first_object(reply: Column) -> Column:
    """Text of the first JSON object of a reply without fences and thinking; null without one."""
    bare = F.regexp_replace(F.regexp_replace(reply, "```json|```", ""), r"(?s)<think>.*?</think>|<analysis>.*?</analysis>", "")
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # a lambda's variable is computed once a row

    def found(b: Column) -> Column:
        at = lambda mark: F.filter(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: F.substring(b, i, F.lit(1)) == mark)
        spans = lambda ends: F.flatten(F.transform(at("{"), lambda i: F.transform(F.filter(ends, lambda j: j > i), lambda j: F.substring(b, i, j - i + 1))))
        return once(at("}"), lambda ends: F.get(F.filter(spans(ends), lambda s: F.try_parse_json(s).isNotNull()), F.lit(0)))

    return once(bare, found)


def coerced(rows: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, fields ...): typed and bounded fields of a model's reply; what is out of bounds or no number is null."""
    parsed = cut(rows.select(key, first_object(F.col(reply)).alias("o")))
    got = lambda name: F.get_json_object("o", f"$.{name}")

    def bounded(name: str, low: int, high: int) -> Column:
        n = F.trim(got(name)).try_cast("int")  # true and false are no numbers
        return F.when(n.between(low, high), n).alias(name)

    ident = F.trim(F.coalesce(F.nullif(got("transaction_id"), F.lit("")), got("payment_identifier")))
    cents = (F.nullif(F.regexp_extract(got("amount"), r"\$?\s*(\d+(?:\.\d{2})?)", 1), F.lit("")).cast("decimal(14,2)") * 100).cast("long")
    return parsed.select(
        key, got("email").alias("email"), F.when(F.length(ident).between(4, 128), ident).alias("transaction_id"), F.substring(F.nullif(F.trim(got("description")), F.lit("")), 1, 1000).alias("description"), cents.alias("amount_cents"),
        got("minutes").alias("minutes"), bounded("payment_hour", 0, 23), got("payment_date").alias("payment_date"), bounded("payment_month", 1, 12), bounded("payment_day", 1, 31), got("customer_name").alias("customer_name"), got("status").alias("status"),
    )


def filled(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with amount, hour, minutes, month and day taken from ``text`` by the looser patterns where they are null."""
    cents, hour, minute, month, day = T.loose_fields(F.col(text))
    return rows.withColumns({"amount": F.coalesce("amount", cents), "payment_hour": F.coalesce("payment_hour", hour), "minutes": F.coalesce("minutes", minute), "payment_month": F.coalesce("payment_month", month), "payment_day": F.coalesce("payment_day", day)})
