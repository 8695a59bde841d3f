"""Further queries: candidate lists, duplicate evidence, descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.plans import evidence as E
from tallymark.plans import linkage as L
from tallymark.sources import fixtures as X


def distinct_candidates(spark, sf_dir):
    """Charges of each receipt listed once, whichever source names them first."""
    r, book, ids = L._prepared(spark, sf_dir)
    by_customer = L.cascade.customer_pairs(r.filter("early IS NULL"), book)
    return ids.select("receipt_id", "id").unionByName(by_customer.select("receipt_id", "id")).dropDuplicates(["receipt_id", "id"]).select("receipt_id", F.col("id").alias("charge_id"))


def duplicate_evidence(spark, sf_dir):
    """Receipt fields, else those of the matched charge."""
    v = L._verdicts(spark, sf_dir).select("receipt_id", "charge_id")
    c = X.charges(spark, sf_dir).select(F.col("id").alias("charge_id"), L.cascade.charge_email().alias("payer"), F.col("provider_id"), F.to_date(F.timestamp_seconds("created")).alias("charge_date"))
    j = X.receipts(spark, sf_dir).join(v, "receipt_id").join(c, "charge_id", "left")
    date = F.coalesce("payment_date", "charge_date")
    return j.select("receipt_id", F.coalesce("email", "payer").alias("email"), F.coalesce("transaction_id", "provider_id").alias("transaction_id"), F.date_format(date, "yyyy-MM-dd").alias("payment_date"), F.month(date).alias("payment_month"), F.day(date).alias("payment_day"))


def extract_description(spark, sf_dir):
    """Value after an explicit label, at most 1000 characters."""
    n = F.substring("receipt_id", 3, 20).cast("long")
    label = F.when(n % 4 == 0, "Description: ").when(n % 4 == 1, "description\n").when(n % 4 == 2, "Descriptions ").otherwise("DESCRIPTION - ")
    text = F.concat(F.col("raw_text"), F.lit("\n"), label, F.lit("Order "), F.col("receipt_id"), F.lit(" \n"))
    return X.receipt_texts(spark, sf_dir).select("receipt_id", F.substring(F.trim(T.found(text, r"(?i)\bdescription\b\s*[:=-]?\s*([^\n]+)", 1)), 1, 1000).alias("description"))


QUERIES = {f.__name__: f for f in (distinct_candidates, duplicate_evidence, extract_description)}
ORACLE_SQL = {
    "distinct_candidates": L._W + L._SOURCES + " SELECT receipt_id, id AS charge_id FROM by_id UNION SELECT receipt_id, id FROM by_customer",
    "duplicate_evidence": L._VERDICTS + f", j AS (SELECT r.receipt_id, coalesce(r.email, {L._EMAIL}) AS email, coalesce(r.transaction_id, c.provider_id) AS transaction_id, coalesce(r.payment_date, (to_timestamp(c.created) AT TIME ZONE 'UTC')::DATE) AS d FROM receipts r JOIN verdicts v USING (receipt_id) LEFT JOIN charges c ON c.id = v.charge_id) SELECT receipt_id, email, transaction_id, strftime(d, '%Y-%m-%d') AS payment_date, month(d)::INTEGER AS payment_month, day(d)::INTEGER AS payment_day FROM j",
    "extract_description": E._T + " SELECT receipt_id, nullif(substr(trim(regexp_extract(raw_text || chr(10) || CASE substr(receipt_id, 3)::BIGINT % 4 WHEN 0 THEN 'Description: ' WHEN 1 THEN 'description' || chr(10) WHEN 2 THEN 'Descriptions ' ELSE 'DESCRIPTION - ' END || 'Order ' || receipt_id || ' ' || chr(10), '(?i)\\bdescription\\b\\s*[:=-]?\\s*([^\\n]+)', 1)), 1, 1000), '') AS description FROM texts",
}
