"""Charges, customers, receipts and messages derived from ``events`` by arithmetic; all work grows with that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
ZONE = "UTC"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``at``, seconds since 1970 in UTC."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


def _address(user: Column) -> Column:
    return F.concat(F.lit("user"), user.cast("string"), F.lit("@example.com"))


def _name(user: Column) -> Column:
    return F.concat(F.lit("Payer "), F.translate(user.cast("string"), "0123456789", "abcdefghij"))


def _cents(value: Column) -> Column:
    return F.round(value).cast("long") * 100 + 100


def _provider(event_id: Column) -> Column:
    return F.upper(F.substring(F.sha2(F.concat(F.lit("t"), event_id.cast("string")), 256), 1, 10))


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment ledger: a charge per purchase and twins of some, at the same time or half an hour later."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    n = F.col("event_id")
    one = e.select(
        F.concat(F.lit("ch_"), n.cast("string")).alias("id"),
        _cents(F.col("value")).alias("amount"),
        F.when(n % 52 == 25, "EUR").otherwise("usd").alias("currency"),
        F.col("at").alias("created"),
        (n % 29 != 0).alias("paid"),
        (n % 31 == 0).alias("refunded"),
        F.when(n % 37 == 0, "pending").otherwise("succeeded").alias("status"),
        F.when(n % 23 == 0, "card").otherwise("cashapp").alias("method"),
        F.when(n % 3 != 0, F.concat(F.lit("cus_"), F.col("user_id").cast("string"))).alias("customer"),
        F.when(n % 3 == 1, _address(F.col("user_id"))).alias("receipt_email"),
        F.when(n % 3 == 0, _address(F.col("user_id"))).alias("billing_email"),
        _name(F.col("user_id")).alias("billing_name"),
        _provider(n).alias("provider_id"),
        n.alias("event_id"),
        F.when((n % 26 == 17) | (n % 5 == 0), F.concat(F.lit("order "), (n % 40).cast("string"))).alias("description"),
        F.concat(F.lit("pi_"), n.cast("string")).alias("payment_intent"),
        F.concat(F.lit("txn_"), n.cast("string")).alias("balance_transaction"),
        F.when(n % 2 == 0, F.concat(F.lit("R-"), n.cast("string"))).alias("receipt_number"),
        F.when(n % 4 == 0, F.concat(F.lit(" SRC_"), n.cast("string"))).alias("source"),
        F.when(n % 3 == 0, F.concat(F.lit("P"), _provider(n))).alias("payment_id"),
        F.when(n % 6 == 5, " ").otherwise(F.concat(F.lit("ref"), n.cast("string"))).alias("reference"),
        F.when(n % 26 == 22, F.create_map(F.lit("Payment_ID"), F.concat(F.lit("meta"), n.cast("string")), F.lit("note"), F.lit("n"))).when(n % 7 == 0, F.create_map(F.lit("order"), F.concat(F.lit("o"), n.cast("string")))).alias("metadata"),
    )
    twins = one.filter("event_id % 17 = 0").withColumns({"id": F.concat(F.lit("ch_x"), n.cast("string")), "created": F.col("created") + F.when(n % 2 == 0, 0).otherwise(1800), "provider_id": F.concat(F.lit("X"), F.col("provider_id"))})
    return one.unionByName(twins)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer ids and addresses."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    return e.select(F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_id"), _address(F.col("user_id")).alias("email")).distinct()


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perturbed receipt per purchase, ``k = event_id % 26`` says how; those of six kinds come again two hours later as another image."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    n, k = F.col("event_id"), F.col("event_id") % 26
    days = F.when(k == 4, 1).when(k == 22, 40).when(k == 23, 3).otherwise(0)
    shown = F.timestamp_seconds(F.col("at") - 86400 * days - F.when(k == 5, 18000).otherwise(0))
    clock = k.isin(0, 2, 5, 8, 9, 13, 18, 21, 25)
    own = _address(F.col("user_id"))
    text = lambda c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    one = e.select(
        F.concat(F.lit("r_"), n.cast("string")).alias("receipt_id"),
        n.alias("event_id"),
        k.cast("int").alias("k"),
        F.when(k.isin(0, 4, 5, 6, 8, 9, 10, 12, 13, 15, 16, 21, 23, 24, 25), own).when(k.isin(2, 7, 18), F.concat(F.lit("x"), own)).when(k == 20, "bad@@").alias("email"),
        F.when(k == 18, F.array(own)).alias("email_candidates"),
        F.when(~k.isin(13, 14, 24), _cents(F.col("value")) + F.when(k == 10, 1).when(k == 19, 500).otherwise(0)).alias("amount"),
        F.when(k == 25, "EUR").otherwise("usd").alias("currency"),
        F.when(k == 21, "card").otherwise("cashapp").alias("method"),
        F.when(k.isin(0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 13, 14, 17, 18, 20, 21, 22, 23, 25), F.to_date(shown)).alias("payment_date"),
        F.when(k == 15, F.month(shown)).when(k == 16, 2).alias("payment_month"),
        F.when(k == 15, F.day(shown)).when(k == 16, 30).alias("payment_day"),
        F.when(clock, F.hour(shown)).alias("payment_hour"),
        F.when(clock | k.isin(1, 14, 23), F.minute(shown)).when(k == 3, F.pmod(F.minute(shown) + 7, F.lit(60))).alias("minutes"),
        F.when(k.isin(3, 14, 18, 23), _name(F.col("user_id"))).alias("customer_name"),
        F.when(k == 7, _provider(n)).when(k == 19, text(("pi_", n.cast("string")))).when(k == 22, text(("meta", n.cast("string")))).alias("transaction_id"),
        F.when(k == 17, text((" Order  ", (n % 40).cast("string")))).alias("description"),
        (k == 12).alias("relative_today"),
        (F.col("at") + F.when(k == 8, 7200).otherwise(600)).alias("received_at"),
        F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("group_id"),
        F.sha2(F.when(k == 8, F.concat(F.lit("img"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("img"), n.cast("string"))), 256).alias("sha256"),
    )
    one = one.withColumn("phash", F.substring(F.sha2(F.concat(F.lit("px"), n.cast("string")), 256), 1, 16))
    first = F.timestamp_seconds(F.col("received_at") - 600)
    late = lambda c, v: F.when(k == 6, v).otherwise(F.col(c))
    again = one.filter(k.isin(0, 6, 7, 9, 10, 18)).withColumns(
        {
            "receipt_id": F.concat(F.lit("d_"), n.cast("string")),
            "sha256": F.sha2(F.concat(F.lit("again"), n.cast("string")), 256),
            "phash": _flipped("phash", "event_id"),
            "group_id": F.when(n % 5 == 0, "g9").otherwise(F.col("group_id")),
            "payment_date": late("payment_date", F.to_date(first)),
            "payment_hour": late("payment_hour", F.hour(first)),
            "minutes": late("minutes", F.minute(first)),
        }
    ).withColumn("received_at", F.col("received_at") + 7200)
    return one.unionByName(again)


def _flipped(digest: str, number: str) -> Column:
    """Hash with its first ``number % 9`` bits flipped."""
    flip = F.expr(f"((1 << cast({number} % 9 AS int)) - 1) << (16 - cast({number} % 9 AS int))").cast("int")
    top = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").bitwiseXOR(flip)
    return F.concat(F.lpad(F.lower(F.hex(top)), 4, "0"), F.substring(digest, 5, 12))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges that an earlier receipt holds, (charge_id, first_seen_at)."""
    return charges(spark, sf_dir).filter("event_id % 19 = 0").select(F.col("id").alias("charge_id"), F.col("created").alias("first_seen_at"))


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as text in five layouts, by ``event_id % 5``."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    n = F.col("event_id")
    t = F.timestamp_seconds("at")
    amount = F.concat(F.lit("$"), F.round("value").cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    label = F.when(n % 5 == 3, "Cystomer").otherwise("Customer")
    name = F.when(n % 5 == 1, F.concat(label, F.lit("\nPayment source\n"), _name(F.col("user_id")))).otherwise(F.concat(label, F.lit(": "), _name(F.col("user_id"))))
    ident = F.when(n % 5 == 2, F.concat(_provider(n), F.lit("\nPayment identifier"))).otherwise(F.concat(F.lit("Payment identifier: "), _provider(n)))
    day = F.when(n % 5 == 4, F.date_format(t, "MMM d")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    status = F.when(n % 7 == 0, "Pending").when(n % 7 == 1, "Failed").otherwise("Completed")
    text = F.concat_ws("\n", F.when(n % 3 == 0, "Mayor 4 Road, Mark 12"), name, _address(F.col("user_id")), F.concat(F.lit("Amount "), amount), F.concat(F.lit("Status "), status), day, F.concat(F.lit("Processed at "), F.date_format(t, "h:mm a")), ident)
    return e.select(F.concat(F.lit("r_"), n.cast("string")).alias("receipt_id"), text.alias("raw_text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat events: images (views) and texts with an address (clicks); every tenth is repeated."""
    e = events(spark, sf_dir).filter("event_type IN ('view', 'click')")
    n = F.col("event_id")
    one = e.select(
        F.concat(F.lit("m_"), n.cast("string")).alias("message_id"),
        F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("group_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"),
        F.col("at").alias("received_at"),
        (F.col("event_type") == "view").alias("is_image"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@example com"))).otherwise("").alias("body"),
        n.alias("event_id"),
    )
    return one.unionByName(one.filter("event_id % 10 = 0"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit visual hashes as 16 hex digits: sign bits of ``embeddings``; every seventh again, as -1 - vec_id, with its ``vec_id % 9`` first bits flipped."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    nibble = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), lambda a, j: a * 2 + (F.get("embedding", F.lit(4 * i) + j) > 0).cast("int"))
    digits = F.concat(*[F.lower(F.hex(nibble(i))) for i in range(16)])
    own = e.select("vec_id", digits.alias("phash"))
    near = own.filter("vec_id % 7 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), _flipped("phash", "vec_id").alias("phash"))
    return own.unionByName(near)
