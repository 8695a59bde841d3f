"""The tables of ``tallymark.sources.fixtures`` as DuckDB common table expressions."""

EVENTS = "e AS (SELECT *, epoch(ts)::DOUBLE AS t0, floor(epoch(ts))::BIGINT AS secs FROM events)"

CHARGES = (
    EVENTS
    + """,
one AS (
  SELECT 'ch_' || event_id AS id, round(value)::BIGINT * 100 + 100 AS amount, CASE WHEN event_id % 52 = 25 THEN 'EUR' ELSE 'usd' END AS currency, secs AS created,
    event_id % 29 <> 0 AS paid, event_id % 31 = 0 AS refunded,
    CASE WHEN event_id % 37 = 0 THEN 'pending' ELSE 'succeeded' END AS status,
    CASE WHEN event_id % 23 = 0 THEN 'card' ELSE 'cashapp' END AS method,
    CASE WHEN event_id % 3 <> 0 THEN 'cus_' || user_id END AS customer,
    CASE WHEN event_id % 3 = 1 THEN 'user' || user_id || '@example.com' END AS receipt_email,
    CASE WHEN event_id % 3 = 0 THEN 'user' || user_id || '@example.com' END AS billing_email,
    'Payer ' || translate(user_id::VARCHAR, '0123456789', 'abcdefghij') AS billing_name,
    upper(substr(sha256('t' || event_id), 1, 10)) AS provider_id, event_id,
    CASE WHEN event_id % 26 = 17 OR event_id % 5 = 0 THEN 'order ' || (event_id % 40) END AS description,
    'pi_' || event_id AS payment_intent, 'txn_' || event_id AS balance_transaction,
    CASE WHEN event_id % 2 = 0 THEN 'R-' || event_id END AS receipt_number, CASE WHEN event_id % 4 = 0 THEN ' SRC_' || event_id END AS source,
    CASE WHEN event_id % 3 = 0 THEN 'P' || upper(substr(sha256('t' || event_id), 1, 10)) END AS payment_id,
    CASE WHEN event_id % 6 = 5 THEN ' ' ELSE 'ref' || event_id END AS reference,
    CASE WHEN event_id % 26 = 22 THEN 'meta' || event_id END AS meta_id
  FROM e WHERE event_type = 'purchase'),
charges AS (
  SELECT * FROM one UNION ALL
  SELECT * REPLACE ('ch_x' || event_id AS id, created + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1800 END AS created, 'X' || provider_id AS provider_id)
  FROM one WHERE event_id % 17 = 0)"""
)

CUSTOMERS = "customers AS (SELECT DISTINCT 'cus_' || user_id AS customer_id, 'user' || user_id || '@example.com' AS email FROM e WHERE event_type = 'purchase')"

RECEIPTS = """
shown AS (
  SELECT *, event_id % 26 AS k, to_timestamp(secs - 86400 * CASE event_id % 26 WHEN 4 THEN 1 WHEN 22 THEN 40 WHEN 23 THEN 3 ELSE 0 END - CASE WHEN event_id % 26 = 5 THEN 18000 ELSE 0 END) AT TIME ZONE 'UTC' AS s,
    'user' || user_id || '@example.com' AS own, event_id % 26 IN (0, 2, 5, 8, 9, 13, 18, 21, 25) AS clocked
  FROM e WHERE event_type = 'purchase'),
r0 AS (
  SELECT 'r_' || event_id AS receipt_id, event_id, k::INTEGER AS k,
    CASE WHEN k IN (0, 4, 5, 6, 8, 9, 10, 12, 13, 15, 16, 21, 23, 24, 25) THEN own WHEN k IN (2, 7, 18) THEN 'x' || own WHEN k = 20 THEN 'bad@@' END AS email,
    CASE WHEN k = 18 THEN [own] END AS email_candidates,
    CASE WHEN k NOT IN (13, 14, 24) THEN round(value)::BIGINT * 100 + 100 + CASE k WHEN 10 THEN 1 WHEN 19 THEN 500 ELSE 0 END END AS amount,
    CASE WHEN k = 25 THEN 'EUR' ELSE 'usd' END AS currency, CASE WHEN k = 21 THEN 'card' ELSE 'cashapp' END AS method,
    CASE WHEN k IN (0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 13, 14, 17, 18, 20, 21, 22, 23, 25) THEN s::DATE END AS payment_date,
    CASE k WHEN 15 THEN month(s) WHEN 16 THEN 2 END::INTEGER AS payment_month, CASE k WHEN 15 THEN day(s) WHEN 16 THEN 30 END::INTEGER AS payment_day,
    CASE WHEN clocked THEN hour(s)::INTEGER END AS payment_hour,
    CASE WHEN clocked OR k IN (1, 14, 23) THEN minute(s)::INTEGER WHEN k = 3 THEN ((minute(s) + 7) % 60)::INTEGER END AS minutes,
    CASE WHEN k IN (3, 14, 18, 23) THEN 'Payer ' || translate(user_id::VARCHAR, '0123456789', 'abcdefghij') END AS customer_name,
    CASE k WHEN 7 THEN upper(substr(sha256('t' || event_id), 1, 10)) WHEN 19 THEN 'pi_' || event_id WHEN 22 THEN 'meta' || event_id END AS transaction_id,
    CASE WHEN k = 17 THEN ' Order  ' || (event_id % 40) END AS description,
    k = 12 AS relative_today, secs + CASE WHEN k = 8 THEN 7200 ELSE 600 END AS received_at,
    'g' || (user_id % 5) AS group_id,
    sha256('img' || CASE WHEN k = 8 THEN user_id ELSE event_id END) AS sha256, substr(sha256('px' || event_id), 1, 16) AS phash
  FROM shown),
receipts AS (
  SELECT * FROM r0 UNION ALL
  SELECT * REPLACE ('d_' || event_id AS receipt_id, received_at + 7200 AS received_at, sha256('again' || event_id) AS sha256, CASE WHEN event_id % 5 = 0 THEN 'g9' ELSE group_id END AS group_id,
    lpad(lower(to_hex(xor(('0x' || substr(phash, 1, 4))::INTEGER, (((1 << (event_id % 9)::INTEGER) - 1) << (16 - event_id % 9)::INTEGER)::INTEGER))), 4, '0') || substr(phash, 5) AS phash,
    CASE WHEN k = 6 THEN (to_timestamp(received_at - 600) AT TIME ZONE 'UTC')::DATE ELSE payment_date END AS payment_date,
    CASE WHEN k = 6 THEN hour(to_timestamp(received_at - 600) AT TIME ZONE 'UTC')::INTEGER ELSE payment_hour END AS payment_hour,
    CASE WHEN k = 6 THEN minute(to_timestamp(received_at - 600) AT TIME ZONE 'UTC')::INTEGER ELSE minutes END AS minutes)
  FROM r0 WHERE k IN (0, 6, 7, 9, 10, 18))"""

CLAIMED = "held AS (SELECT id AS charge_id, created AS first_seen_at FROM charges WHERE event_id % 19 = 0)"

TEXTS = """
texts AS (
  SELECT 'r_' || event_id AS receipt_id, concat_ws(chr(10),
    CASE WHEN event_id % 3 = 0 THEN 'Mayor 4 Road, Mark 12' END,
    CASE WHEN event_id % 5 = 1 THEN 'Customer' || chr(10) || 'Payment source' || chr(10) || n WHEN event_id % 5 = 3 THEN 'Cystomer: ' || n ELSE 'Customer: ' || n END,
    'user' || user_id || '@example.com',
    'Amount $' || round(value)::BIGINT || '.' || lpad((event_id % 100)::VARCHAR, 2, '0'),
    'Status ' || CASE WHEN event_id % 7 = 0 THEN 'Pending' WHEN event_id % 7 = 1 THEN 'Failed' ELSE 'Completed' END,
    CASE WHEN event_id % 5 = 4 THEN strftime(s, '%b %-d') ELSE strftime(s, '%Y-%m-%d') END,
    'Processed at ' || strftime(s, '%-I:%M %p'),
    CASE WHEN event_id % 5 = 2 THEN p || chr(10) || 'Payment identifier' ELSE 'Payment identifier: ' || p END) AS raw_text
  FROM (SELECT *, 'Payer ' || translate(user_id::VARCHAR, '0123456789', 'abcdefghij') AS n, upper(substr(sha256('t' || event_id), 1, 10)) AS p,
    to_timestamp(secs) AT TIME ZONE 'UTC' AS s FROM e WHERE event_type = 'purchase'))"""

MESSAGES = """
m1 AS (
  SELECT 'm_' || event_id AS message_id, 'g' || (user_id % 5) AS group_id, 'u' || user_id AS sender, secs AS received_at,
    event_type = 'view' AS is_image, CASE WHEN event_type = 'click' THEN 'User' || user_id || '@example com' ELSE '' END AS body, event_id
  FROM e WHERE event_type IN ('view', 'click')),
messages AS (SELECT * FROM m1 UNION ALL SELECT * FROM m1 WHERE event_id % 10 = 0)"""

HASHES = """
bits AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings),
own AS (
  SELECT vec_id, string_agg(lower(to_hex(d)), '' ORDER BY q) AS phash
  FROM (SELECT vec_id, i // 4 AS q, sum(CASE WHEN v > 0 THEN 1 << (3 - i % 4) ELSE 0 END)::INTEGER AS d FROM bits GROUP BY ALL) GROUP BY vec_id),
hashes AS (
  SELECT vec_id, phash FROM own UNION ALL
  SELECT -vec_id - 1, lpad(lower(to_hex(xor(('0x' || substr(phash, 1, 4))::INTEGER, (((1 << (vec_id % 9)::INTEGER) - 1) << (16 - vec_id % 9)::INTEGER)::INTEGER))), 4, '0') || substr(phash, 5) FROM own WHERE vec_id % 7 = 0)"""


def with_(*parts: str) -> str:
    """A WITH clause of the named expressions."""
    return "WITH " + ",\n".join(parts) + "\n"
