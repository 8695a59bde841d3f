"""Record linkage: receipts meet ledger charges through a cascade of tiers that approves only a unique charge.

Candidates are a union of equality joins, each with its own key: exploded identifiers, customers of the receipt's addresses,
amount and currency with address, customer or payer's name, and of receipts without an address amount, local date and minute;
for receipts without an amount payer, local date or what else is constrained. Pairs that no tier can take go before any
shuffle. What a tier may see is a flag on the candidate row: identifier hits, else the customers' charges, else those found by
amount, else the window. The visible set is widened in stages. Charges of other payers than the receipt's address are joined
only for receipts that are still open, by the date and minute they show. What a row says by itself is one number; all tiers
then are columns over windows of such narrow rows by receipt, one shuffle and one sort. Zero or several survivors never approve;
recency breaks no tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions import text as T
from tallymark.session import cut
from tallymark.session import free as delete

#: The widest gap between two time zones with a margin, the days a search looks back, and the charges that a
#: search reads at most (100 pages of 100).
WINDOW_SECONDS, LOOKBACK_DAYS, BUDGET = 93_900, 90, 10_000
METHOD, DAY = "cashapp", 86_400
#: Metadata keys that hold identifiers.
METADATA_KEYS = ("transaction_id", "transactionid", "payment_id", "payment_identifier", "cash_app_payment_id", "cashapp_payment_id", "cashapp_transaction_id", "external_transaction_id", "receipt_id")
#: Receipts, and charges, of one tile of pairs: a multiple of eight, so that the packed numbers of a file's column repeat by whole bytes.
TILE = 256
TIERS = ("strict", "zone_boundary", "day_requery", "day_boundary", "identity_minute", "identity_only", "customer_minute", "customer_only", "broad", "broad_boundary", "broad_minute", "broad_identity", "date_boundary", "identity_recovery", "date_name", "canonical")
BOUNDARY = ("zone_boundary", "day_boundary", "broad_boundary")
#: Columns of evidence and of charges that may be missing from a table: they count as null, or as given here.
EVIDENCE = {"email": "string", "email_candidates": "array<string>", "transaction_id": "string", "description": "string", "customer_name": "string", "amount": "long", "currency": "string", "method": "string", "payment_date": "date", "payment_month": "int", "payment_day": "int", "payment_hour": "int", "minutes": "int", "relative_today": "boolean", "received_at": "long"}
LEDGER = {"currency": "string", "description": "string", "payment_intent": "string", "balance_transaction": "string", "receipt_number": "string", "source": "string", "provider_id": "string", "payment_id": "string", "reference": "string", "metadata": "map<string,string>"}


def _filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def charge_email() -> Column:
    """Payer's address of a charge: the receipt's, else the billing one; blank counts as missing."""
    return F.coalesce(_blank(F.lower("receipt_email")), _blank(F.lower("billing_email")))


def payment_identifier() -> Column:
    """The provider's identifier of a charge, the first of three."""
    return F.coalesce(*[_blank(F.col(c)) for c in ("provider_id", "payment_id", "reference")])


def identifiers() -> Column:
    """All identifiers of a charge, lowered and distinct: its own, the provider's, and those under known metadata keys."""
    plain = [F.col(c) for c in ("id", "payment_intent", "balance_transaction", "receipt_number", "source", "provider_id", "payment_id", "reference")]
    meta = F.map_values(F.map_filter(F.coalesce("metadata", F.expr("map()").cast("map<string,string>")), lambda k, _: F.lower(k).isin(*METADATA_KEYS)))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(*plain), meta), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def is_eligible(method: str = METHOD) -> Column:
    return F.coalesce(F.col("paid") & ~F.coalesce("refunded", F.lit(False)) & (F.col("status") == "succeeded") & (F.lower("method") == method), F.lit(False))


def eligible(charges: DataFrame, method: str = METHOD) -> DataFrame:
    """Charges that can be approved: paid, not refunded, succeeded and by the policy's method."""
    return charges.filter(is_eligible(method))


def constraints(receipt_zone: str | None = None) -> Column:
    """Number of independent constraints of a receipt; a month and day is one, an hour only counts where the receipt's zone is known."""
    dated = F.col("payment_date").isNotNull() | (F.col("payment_month").isNotNull() & F.col("payment_day").isNotNull())
    given = [F.col(c).isNotNull() for c in ("amount", "description", "customer_name", "minutes")] + [dated] + ([F.col("payment_hour").isNotNull()] if receipt_zone else [])
    return sum((g.cast("int") for g in given[1:]), given[0].cast("int"))


def evidence(receipts: DataFrame, receipt_zone: str | None = None, method: str = METHOD) -> DataFrame:
    """Receipts in normal form with ``emails`` (primary and further), an inferred date, ``n_constraints`` and ``early``.

    ``early`` is the reason for which a receipt is not matched at all: a value that has no normal form, another method than the
    policy's, or fewer than two constraints without address and identifier.
    """
    r = _filled(receipts, EVIDENCE)
    given = F.filter(F.coalesce("email_candidates", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    plain = {"email": T.normal_email(_blank(F.col("email"))), "transaction_id": T.normal_identifier(_blank(F.col("transaction_id"))), "description": T.normal_description(_blank(F.col("description"))), "customer_name": T.normal_name(_blank(F.col("customer_name")))}
    bad = F.exists(given, lambda x: T.normal_email(x).isNull())
    for c, normal in plain.items():
        bad = bad | (_blank(F.col(c)).isNotNull() & normal.isNull())
    r = r.withColumn("bad", bad).withColumn("further", F.transform(given, T.normal_email)).withColumns(plain)
    inferred = T.infer_year(F.col("payment_month"), F.col("payment_day"), F.to_date(F.timestamp_seconds("received_at")))
    has_date = F.col("payment_date").isNotNull() | (F.col("payment_month").isNotNull() & F.col("payment_day").isNotNull())
    r = r.withColumns({"emails": F.array_distinct(F.array_compact(F.concat(F.array("email"), "further"))), "has_date": has_date, "payment_date": F.coalesce("payment_date", inferred), "currency": F.lower(F.coalesce("currency", F.lit("usd"))), "method": F.lower(F.coalesce("method", F.lit(method))), "relative_today": F.coalesce("relative_today", F.lit(False))})
    r = r.withColumn("n_constraints", constraints(receipt_zone))
    poor = (F.size("emails") == 0) & (F.col("n_constraints") < 2) & F.col("transaction_id").isNull()
    early = F.when(F.col("bad"), "INVALID_EVIDENCE").when(F.col("method") != method, "UNSUPPORTED_PAYMENT_METHOD_TYPE").when(poor, "INSUFFICIENT_STRIPE_EVIDENCE")
    return r.withColumn("early", early).drop("bad", "further")


def windows(receipts: DataFrame, as_of: int, zone: str = "UTC", lookback_days: int = LOOKBACK_DAYS, receipt_zone: str | None = None) -> DataFrame:
    """Adds search_lo/search_hi, day_lo/day_hi (seconds, inclusive), ``bounded`` and ``clock``, the shown instant.

    The end of a day is the next local midnight less a second. Where the receipt's zone is known the search is its minute
    less 60 and plus 120 seconds and the day is the local day; elsewhere both are the day and ``WINDOW_SECONDS`` either way.
    """
    own = receipt_zone or zone
    midnight = lambda d: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp"), own))
    start, end = midnight(F.col("payment_date")), midnight(F.date_add("payment_date", 1)) - 1
    clock = F.unix_timestamp(F.to_utc_timestamp(F.col("payment_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("payment_hour"), F.col("minutes")), own))
    today = F.coalesce(F.col("relative_today") & F.col("received_at").isNotNull(), F.lit(False))
    dated = F.col("payment_date").isNotNull()
    wide_lo, wide_hi = F.greatest(F.lit(0), start - WINDOW_SECONDS), end + WINDOW_SECONDS
    shown = clock.isNotNull() if receipt_zone else F.lit(False)
    lo = F.when(shown, clock - 60).when(dated, wide_lo).otherwise(F.lit(as_of - lookback_days * DAY))
    hi = F.when(shown, clock + 120).when(dated, wide_hi)
    day_lo, day_hi = (F.when(dated, start).otherwise(F.lit(0)), F.when(dated, end).otherwise(F.lit(0))) if receipt_zone else (lo, hi)
    near_lo, near_hi = F.greatest(F.lit(0), F.col("received_at") - WINDOW_SECONDS), F.col("received_at") + 7200
    found = {"search_lo": (near_lo, lo), "search_hi": (near_hi, hi), "day_lo": (near_lo, day_lo), "day_hi": (near_hi, day_hi)}
    return receipts.withColumns({k: F.when(today, a).otherwise(b).cast("long") for k, (a, b) in found.items()} | {"bounded": dated | today, "clock": clock})


def ledger(charges: DataFrame, claims: DataFrame | None = None, match_zone: str = "UTC", method: str = METHOD) -> DataFrame:
    """Charges as the cascade reads them, ``claimed`` where their id is in ``claims`` (charge_id)."""
    c = _filled(charges, LEDGER)
    at = F.from_utc_timestamp(F.timestamp_seconds("created"), match_zone)
    c = c.select("id", F.col("amount").alias("c_amount"), F.lower("currency").alias("c_currency"), "created", F.col("status").alias("c_status"), is_eligible(method).alias("eligible"), "customer", charge_email().alias("payer"), T.normal_name(F.col("billing_name")).alias("payer_name"), T.normal_description(F.col("description")).alias("c_description"), identifiers().alias("ids"), at.alias("local"))
    if claims is None:
        return c.withColumn("claimed", F.lit(False))
    held = claims.select(F.col("charge_id").alias("id")).distinct().withColumn("claimed", F.lit(True))
    return c.join(held, "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))


def id_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(receipt_id, charge columns, ``scan``) of charges of any amount with the receipt's identifier; ``scan``: in its window, else lookback."""
    back = F.col("created").between(as_of - lookback_days * DAY, as_of)
    key = r.filter("transaction_id IS NOT NULL").select("receipt_id", F.lower("transaction_id").alias("key"), "bounded", "day_lo", "day_hi")
    met = key.join(c.select("*", F.explode("ids").alias("key")), "key")
    scan = F.when(F.col("bounded"), F.col("created").between(F.col("day_lo"), F.col("day_hi"))).otherwise(back)
    return met.withColumn("scan", scan).filter(F.col("scan") | back).drop("key", "bounded", "day_lo", "day_hi")


def customers_of(r: DataFrame, customers: DataFrame) -> DataFrame:
    """(receipt_id, customer_ids) by any of the receipt's addresses."""
    mail = r.select("receipt_id", F.explode("emails").alias("mail"))
    return mail.join(customers.select("customer_id", F.lower("email").alias("mail")), "mail").groupBy("receipt_id").agg(F.collect_set("customer_id").alias("customer_ids"))


def customer_pairs(r: DataFrame, c: DataFrame, same_amount: bool = False) -> DataFrame:
    """(receipt_id, charge columns) of the customers' charges, in the receipt's day window if it has a date; of any amount unless ``same_amount``."""
    span = ["bounded", "day_lo", "day_hi", "payment_date", "amount", "currency"]
    key = r.filter("size(customer_ids) > 0").select("receipt_id", F.explode("customer_ids").alias("customer"), *span)
    agrees = F.col("amount").isNull() | ((F.col("amount") == F.col("c_amount")) & (F.col("currency") == F.col("c_currency")))
    near = F.col("payment_date").isNull() | F.col("created").between(F.col("day_lo"), F.col("day_hi"))
    return key.join(c, "customer").filter(near & agrees if same_amount else near).drop(*span)


def amount_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS, carry: tuple[str, ...] = (), shown: bool = False) -> DataFrame:
    """(receipt_id, columns of ``carry``, charge columns) of succeeded charges of the receipt's amount and currency.

    Receipts with a window are joined day by day within it, the others over the lookback. ``shown``: of dated receipts only
    charges of the local date, and of all with a window only of the minute, that they show (``carry`` has both): the others are never met.
    """
    c = c.filter("c_status = 'succeeded'")
    same = (F.col("amount") == F.col("c_amount")) & (F.col("currency") == F.col("c_currency"))
    kept, plain = ["receipt_id", *carry], ["amount", "currency", "bounded", "payment_date"]
    r = r.filter("amount IS NOT NULL").select(*kept, *[x for x in plain if x not in carry], F.least("search_lo", "day_lo").alias("lo"), F.greatest("search_hi", "day_hi").alias("hi"))
    by_day = c.withColumn("c_day", F.floor(F.col("created") / DAY))
    back = F.col("created").between(as_of - lookback_days * DAY, as_of)
    days, near, seen = F.sequence(F.floor(F.col("lo") / DAY), F.floor(F.col("hi") / DAY)), F.col("bounded"), F.col("created").between(F.col("lo"), F.col("hi"))
    on = F.col("day") == F.col("c_day")
    asked = r.filter(near)
    if shown:
        number = lambda d: F.concat(F.lit("d"), d.cast("string"))
        days = F.when(F.col("payment_date").isNotNull(), F.array(F.col("payment_date").cast("string"))).otherwise(F.transform(days, number))
        by_day = by_day.withColumn("c_day", F.explode(F.array(F.to_date("local").cast("string"), number(F.col("c_day"))))).withColumn("c_minute", F.explode(F.array(F.minute("local").cast("string"), F.lit("*"))))
        asked, on = asked.withColumn("minute", F.coalesce(F.col("minutes").cast("string"), F.lit("*"))), on & (F.col("minute") == F.col("c_minute"))
    found = asked.withColumn("day", F.explode(days)).join(by_day, same & on & seen).select(*kept, *c.columns)
    return found.unionByName(r.filter(~near).join(c.filter(back), same).select(*kept, *c.columns))


def listed_otherwise(as_of: int, lookback_days: int = LOOKBACK_DAYS) -> Column:
    """Is a row of receipt and charge also one of ``id_pairs`` or ``customer_pairs``?"""
    back, day = F.col("created").between(as_of - lookback_days * DAY, as_of), F.col("created").between(F.col("day_lo"), F.col("day_hi"))
    by_id = F.array_contains("ids", F.lower("transaction_id")) & (F.when(F.col("bounded"), day).otherwise(back) | back)
    by_customer = F.array_contains("customer_ids", F.col("customer")) & (F.col("payment_date").isNull() | day)
    return F.coalesce(by_id, F.lit(False)) | F.coalesce(by_customer, F.lit(False))


def tiled_pairs(r: DataFrame, c: DataFrame, *keys: str, spread: int = 1) -> DataFrame:
    """(receipt_id, id): all pairs of equal ``keys`` of receipts (receipt_id, lo, hi) and charges (id, at), ``at`` from ``lo`` to ``hi``; no nulls.

    Where many share a key the pairs are far more than the rows. Only tiles are joined, arrays of ``TILE`` receipts and of
    ``TILE`` charges by time, and pairs come tile by tile: a receipt in a run, the same charges for each of them. A columnar
    file keeps such runs in a fraction of the bytes of pairs in any order. Tiles out of reach are left out unread. Rows of a
    key are dealt into ``spread`` parts, and each part of the charges meets all receipts: for keys that most rows have.
    """
    parts = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = (*keys, "part") if spread > 1 else keys

    def tiles(rows: DataFrame, order: list[str], name: str, columns: list[str], **more: Column) -> DataFrame:
        if spread > 1:
            rows = rows.withColumn("part", F.pmod(F.xxhash64(order[-1]), F.lit(spread)).cast("int"))
        number = F.floor((F.row_number().over(W.partitionBy(*own).orderBy(*order)) - 1) / TILE)
        return rows.repartition(parts, *own).withColumn("tile", number).groupBy(*own, "tile").agg(F.collect_list(F.struct(*columns)).alias(name), *[v.alias(k) for k, v in more.items()]).drop("tile")

    charges = tiles(c, ["at", "id"], "cs", ["at", "id"], first=F.min("at"), last=F.max("at"))
    asked = tiles(r, ["lo", "hi", "receipt_id"], "rs", ["lo", "hi", "receipt_id"], least=F.min("lo"), most=F.max("hi"))
    if spread > 1:
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    met = charges.join(asked, list(own)).filter("last >= least AND first <= most")
    one = met.select("cs", "first", "last", F.inline("rs")).filter("last >= lo AND first <= hi")
    return one.select("receipt_id", "lo", "hi", F.inline("cs")).filter("at BETWEEN lo AND hi").select("receipt_id", "id")


def _in_reach(as_of: int, lookback_days: int) -> Column:
    """Is a charge in the lookback or, of receipts with a window, between ``lo`` and ``hi``?"""
    return F.col("created").between(as_of - lookback_days * DAY, as_of) | (F.col("bounded") & F.col("created").between(F.col("lo"), F.col("hi")))


def _reaching(r: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Receipts with an amount, ``carry`` and from where to where they can see charges."""
    plain = ["receipt_id", "amount", "currency", "bounded", "any_id", "emails", "customer_ids", "customer_name", "transaction_id", "payment_date", "payment_month", "payment_day", "has_date", "minutes", "description", "clock", "email"]
    return r.filter("amount IS NOT NULL").select(*plain, *[x for x in carry if x not in plain], F.least("search_lo", "day_lo").alias("lo"), F.greatest("search_hi", "day_hi").alias("hi"))


def _same_sum() -> Column:
    return (F.col("amount") == F.col("c_amount")) & (F.col("currency") == F.col("c_currency"))


def named_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(receipt_id, columns of ``carry``, charge columns) of eligible charges of the receipt's amount that have its address, customer, name or identifier.

    Of receipts with a hit by identifier only identifiers count. A pair that agrees in several comes several times.
    """
    told = lambda mark, x: F.transform(x, lambda v: F.concat(F.lit(mark), v))
    one = lambda x: F.array(F.col(x))
    ident = told("i", F.array(F.lower("transaction_id")))
    keys = F.concat(F.when(F.col("any_id"), F.array().cast("array<string>")).otherwise(F.concat(told("p", F.col("emails")), told("c", F.col("customer_ids")), told("n", one("customer_name")))), ident)
    mine = _reaching(r, carry).withColumn("key", F.explode(F.array_compact(keys)))
    found = F.array_compact(F.concat(told("p", one("payer")), told("c", one("customer")), told("n", one("payer_name")), told("i", F.col("ids"))))
    met = mine.join(c.filter("eligible").withColumn("c_key", F.explode(found)), _same_sum() & (F.col("key") == F.col("c_key")))
    return met.filter(_in_reach(as_of, lookback_days)).select("receipt_id", *carry, *c.columns)


def shown_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS, carry: tuple[str, ...] = (), around: bool = False) -> DataFrame:
    """(receipt_id, columns of ``carry``, charge columns) of eligible charges of the receipt's amount whose local date and minute are the ones it shows.

    What a receipt doesn't show is left open. ``around``: also charges of the days around, as far as a zone's difference or a
    boundary of dates reaches, and whatever the minute where a receipt with addresses shows no date.
    """
    loose = (F.size("emails") > 0) & ~F.col("has_date") if around else F.lit(False)
    reach = F.when(F.col("clock").isNotNull(), 2).when(F.col("minutes").isNotNull(), 1).otherwise(0) if around else F.lit(0)
    dates = F.transform(F.sequence(-reach, reach), lambda i: F.date_add("payment_date", i).cast("string"))
    short = lambda month, day: F.concat(month.cast("string"), F.lit("/"), day.cast("string"))
    month_day = F.col("payment_month").isNotNull() & F.col("payment_day").isNotNull()
    days = F.when(F.col("payment_date").isNotNull(), dates).when(month_day & ~loose, F.array(short(F.col("payment_month"), F.col("payment_day")))).otherwise(F.array(F.lit("*")))
    minute = F.when(~loose, F.col("minutes").cast("string"))
    mine = _reaching(r, carry).withColumns({"on": F.explode(days), "minute": F.coalesce(minute, F.lit("*"))})
    able = c.filter("eligible").withColumn("c_on", F.explode(F.array(F.to_date("local").cast("string"), short(F.month("local"), F.day("local")), F.lit("*"))))
    able = able.withColumn("c_minute", F.explode(F.array(F.minute("local").cast("string"), F.lit("*"))))
    told = F.col("description").isNull() | (F.col("description") == F.col("c_description"))
    met = mine.join(able, _same_sum() & (F.col("on") == F.col("c_on")) & (F.col("minute") == F.col("c_minute")) & told)
    return met.filter(_in_reach(as_of, lookback_days)).select("receipt_id", *carry, *c.columns)


def sights(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(receipt_id, searched, requeried, backed): is a succeeded charge of the receipt's amount in its search, its day, the lookback?"""
    c = c.filter("c_status = 'succeeded'").select(F.col("c_amount").alias("amount"), F.col("c_currency").alias("currency"), F.col("created").alias("at")).distinct()
    back = c.filter(F.col("at").between(as_of - lookback_days * DAY, as_of)).select("amount", "currency").distinct().withColumn("backed", F.lit(True))
    r = r.filter("amount IS NOT NULL").select("receipt_id", "amount", "currency", "bounded", "search_lo", "search_hi", "day_lo", "day_hi")
    # The next charge from where a span begins tells whether the span holds one: a single pass by time, no pairs.
    spans = F.inline(F.array(F.struct(F.lit("s").alias("span"), F.col("search_lo").alias("at"), F.col("search_hi").alias("until")), F.struct(F.lit("d").alias("span"), F.col("day_lo").alias("at"), F.col("day_hi").alias("until"))))
    asked = r.filter("bounded").select("receipt_id", "amount", "currency", spans).withColumn("charged", F.lit(None).cast("long"))
    given = c.select(F.lit(None).cast("string").alias("receipt_id"), "amount", "currency", F.lit(None).cast("string").alias("span"), "at", F.lit(None).cast("long").alias("until"), F.col("at").alias("charged"))
    later = W.partitionBy("amount", "currency").orderBy(F.desc("at"), F.col("charged").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    yes = lambda x: F.coalesce(x, F.lit(False))
    met = asked.unionByName(given).withColumn("next", F.last("charged", ignorenulls=True).over(later)).filter("receipt_id IS NOT NULL").withColumn("held", yes(F.col("next") <= F.col("until")))
    near = met.groupBy("receipt_id").agg(F.max(F.when(F.col("span") == "s", F.col("held"))).alias("s"), F.max(F.when(F.col("span") == "d", F.col("held"))).alias("requeried"))
    told = r.join(back, ["amount", "currency"], "left").join(near, "receipt_id", "left")
    # Without a window the search is the lookback.
    return told.select("receipt_id", F.when(F.col("bounded"), yes(F.col("s"))).otherwise(yes(F.col("backed"))).alias("searched"), yes(F.col("requeried")).alias("requeried"), yes(F.col("backed")).alias("backed"))


def window_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(receipt_id, charge columns) for receipts without an amount: by payer, local date, or what else must agree.

    Receipts without address and date are joined on description or minute; with neither, on nothing, which the fan-out
    guard bounds: it lets them through only where the whole lookback is within budget.
    """
    r = r.filter("amount IS NULL")
    return payer_pairs(r, c, as_of, lookback_days).unionByName(listed_pairs(r.filter("payment_date IS NOT NULL OR email IS NULL"), c, as_of, lookback_days))


def payer_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(receipt_id, charge columns) of eligible charges that were paid from one of the receipt's addresses."""
    back = F.col("created").between(as_of - lookback_days * DAY, as_of)
    seen = F.when(F.col("bounded"), F.col("created").between(F.col("day_lo"), F.col("day_hi"))).otherwise(back)
    span = ["bounded", "day_lo", "day_hi"]
    return r.select("receipt_id", *span, F.explode("emails").alias("payer")).join(c.filter("eligible"), "payer").filter(seen | back).drop(*span)


def listed_pairs(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(receipt_id, columns of ``carry``, charge columns) of eligible charges of the receipt's local date and minute or, without a date, of its description or minute.

    No tier takes a charge of another minute than a dated receipt shows; one without minutes meets the whole day.
    """
    back = F.col("created").between(as_of - lookback_days * DAY, as_of)
    kept = ["receipt_id", *carry]
    able = c.filter("eligible").withColumn("on", F.to_date("local"))
    day = r.filter("payment_date IS NOT NULL").select(*kept, F.col("payment_date").alias("on"), F.col("minutes").alias("minute"))
    dated = day.filter("minute IS NOT NULL").join(able.withColumn("minute", F.minute("local")), ["on", "minute"]).select(*kept, *c.columns)
    dated = dated.unionByName(day.filter("minute IS NULL").join(able, "on").select(*kept, *c.columns))
    key = F.when(F.col("description").isNotNull(), F.concat(F.lit("d"), "description")).when(F.col("minutes").isNotNull(), F.concat(F.lit("m"), F.col("minutes").cast("string"))).otherwise("*")
    keys = F.explode(F.array_compact(F.array(F.concat(F.lit("d"), "c_description"), F.concat(F.lit("m"), F.minute("local").cast("string")), F.lit("*"))))
    open_ = r.filter("payment_date IS NULL").select(*kept, key.alias("key"))
    return dated.unionByName(open_.join(c.filter("eligible").filter(back).withColumn("key", keys), "key").select(*kept, *c.columns))


def fan_out(r: DataFrame, c: DataFrame, as_of: int, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(receipt_id, n_candidates): charges that a receipt's search would read, counted on day totals before any join of rows.

    Whole days in UTC are counted: of its amount, or all where it has none.
    """
    day = F.floor(F.col("created") / DAY)
    first, last = (as_of - lookback_days * DAY) // DAY, as_of // DAY
    totals = c.filter("c_status = 'succeeded'").groupBy("c_amount", "c_currency", day.alias("day")).agg(F.count("*").alias("n"))
    every = totals.groupBy("day").agg(F.sum("n").alias("n"))
    span = r.select("receipt_id", "amount", "currency", "bounded", F.floor(F.least("search_lo", "day_lo") / DAY).alias("lo"), F.floor(F.greatest("search_hi", "day_hi") / DAY).alias("hi"))
    days = span.filter("bounded").withColumn("day", F.explode(F.sequence("lo", "hi")))
    same = (F.col("amount") == F.col("c_amount")) & (F.col("currency") == F.col("c_currency"))
    back = totals.filter(F.col("day").between(first, last)).groupBy("c_amount", "c_currency").agg(F.sum("n").alias("n"))
    all_ = every.filter(F.col("day").between(first, last)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    near = days.filter("amount IS NOT NULL").withColumnRenamed("day", "r_day").join(totals, same & (F.col("r_day") == F.col("day")))
    parts = [near, days.filter("amount IS NULL").join(every, "day"), span.filter("NOT bounded AND amount IS NOT NULL").join(back, same), span.filter("NOT bounded AND amount IS NULL").join(F.broadcast(all_))]
    counted = parts[0].select("receipt_id", "n")
    for p in parts[1:]:
        counted = counted.unionByName(p.select("receipt_id", "n"))
    counted = counted.groupBy("receipt_id").agg(F.sum("n").alias("n"))
    return r.select("receipt_id").join(counted, "receipt_id", "left").select("receipt_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def prepared(receipts: DataFrame, charges: DataFrame, customers: DataFrame, as_of: int, zone: str = "UTC", receipt_zone: str | None = None, lookback_days: int = LOOKBACK_DAYS, claims: DataFrame | None = None, budget: int | None = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, ledger, identifier pairs) as tables: receipts with windows, ``any_id``, ``customer_ids`` and ``early``; with no ``budget`` no search is limited."""
    r = cut(windows(evidence(receipts, receipt_zone), as_of, zone, lookback_days, receipt_zone))
    c = cut(ledger(charges, claims, receipt_zone or zone))
    ids = cut(id_pairs(r.filter("early IS NULL"), c, as_of, lookback_days))
    hits = ids.filter("scan").select("receipt_id").distinct().withColumn("any_id", F.lit(True))
    known = customers_of(r, customers)
    if budget is not None:
        r = r.join(fan_out(r, c, as_of, lookback_days), "receipt_id", "left")
    r = r.join(hits, "receipt_id", "left").join(known, "receipt_id", "left")
    any_id = F.coalesce("any_id", F.lit(False))
    none = F.array().cast("array<string>")
    r = r.withColumns({"any_id": any_id, "customer_ids": F.when(any_id, none).otherwise(F.coalesce("customer_ids", none))})
    if budget is None:
        return cut(r), c, ids
    lists = ~F.col("any_id") & (F.size("customer_ids") == 0) & (F.col("n_candidates") > budget)
    return cut(r.withColumn("early", F.coalesce("early", F.when(lists, "STRIPE_PAGINATION_LIMIT")))), c, ids


#: Columns of receipts that tiers read.
READ = ("email", "emails", "transaction_id", "description", "customer_name", "amount", "currency", "payment_date", "payment_month", "payment_day", "payment_hour", "minutes", "relative_today", "received_at", "search_lo", "search_hi", "day_lo", "day_hi", "bounded", "clock", "has_date", "n_constraints", "any_id", "customer_ids")
#: The answers of ``sights``.
SEEN = ("searched", "requeried", "backed")


def _told(p: DataFrame, as_of: int, lookback_days: int, receipt_zone: str | None) -> DataFrame:
    """Adds all that tiers decide on to rows of receipt and charge."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    agrees = lambda given, own: given.isNull() | yes(given == own)
    local_date = F.to_date("local")
    hour_ok = agrees(c("payment_hour"), F.hour("local")) if receipt_zone else F.lit(True)
    facts = {
        "has_customer": F.size("customer_ids") > 0,
        "customer_hit": yes(F.array_contains("customer_ids", c("customer"))),
        "identity": yes(F.array_contains("emails", c("payer"))) | yes(F.array_contains("customer_ids", c("customer"))),
        "same_name": yes(c("payer_name") == c("customer_name")),
        "id_hit": yes(F.array_contains("ids", F.lower("transaction_id"))),
        "by_amount": yes((c("amount") == c("c_amount")) & (c("currency") == c("c_currency")) & (c("c_status") == "succeeded")),
        "base": c("eligible") & yes(c("currency") == c("c_currency")) & agrees(c("amount"), c("c_amount")) & agrees(c("description"), c("c_description")),
        "minute_ok": agrees(c("minutes"), F.minute("local")),
        "date_ok": agrees(c("payment_date"), local_date) & agrees(c("payment_month"), F.month("local")) & agrees(c("payment_day"), F.day("local")),
        "hour_ok": hour_ok,
        "day_gap": F.abs(F.datediff(local_date, c("payment_date"))),
        "clock_gap": F.abs(c("created") - c("clock")),
        "in_search": (c("created") >= c("search_lo")) & (c("search_hi").isNull() | (c("created") <= c("search_hi"))),
        "in_day": yes(c("bounded") & c("created").between(c("day_lo"), c("day_hi"))),
        "in_date": yes(local_date == c("payment_date")),
        "in_back": c("created").between(as_of - lookback_days * DAY, as_of),
    }
    told = _once(p, facts).drop("ids", "local", "c_description", "c_currency", "c_status", "search_lo", "day_lo", "day_hi", "customer_ids")  # rows are many: only what tiers read goes on
    return _once(told, {"in_window": F.when(c("bounded"), c("in_day")).otherwise(c("in_back")), "who": c("email").isNull() | c("identity"), "time_ok": c("minute_ok") & c("date_ok") & c("hour_ok")})


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with ``columns``, each computed once a row and not copied into whatever filters or columns follow."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


_OWN = "OVER (PARTITION BY receipt_id)"
#: Receipts of which the day's boundary asks who paid.
_BY_WHO = "size(emails) > 0 OR transaction_id IS NOT NULL OR customer_name IS NOT NULL"
#: What is visible when identifiers are tried, by the tier that decided before.
_STAGES = {"0": TIERS[:2], "3": TIERS[2:6], "6": TIERS[6:8], "7": TIERS[8:]}
#: Tiers that run before identifiers are tried; those after see what the identifiers leave visible.
_EARLY = 12


def _with(rows: DataFrame, **columns: str) -> DataFrame:
    """``rows`` and SQL expressions over them."""
    return rows.selectExpr("*", *[f"{v} AS {k}" for k, v in columns.items()])


def _visible(rows: DataFrame) -> DataFrame:
    """Adds what a receipt sees: ``c0`` at first, ``c3`` after the day is searched again, ``c6`` after the lookback is listed, ``c7`` with
    the lookback by amount; each as it stands if no tier before has decided."""
    first = """CASE WHEN any_id THEN id_hit AND in_window WHEN has_customer THEN customer_hit AND (NOT bounded OR in_day)
      WHEN amount IS NOT NULL THEN by_amount AND CASE WHEN searched THEN in_search ELSE in_window END
      WHEN size(emails) > 0 THEN in_window WHEN payment_date IS NOT NULL THEN in_date ELSE in_back END"""
    again = "NOT has_customer AND NOT any_id AND amount IS NOT NULL AND payment_date IS NOT NULL AND search_hi IS NOT NULL AND requeried"
    broad = "NOT any_id AND amount IS NOT NULL AND (payment_date IS NOT NULL OR minutes IS NOT NULL OR transaction_id IS NOT NULL)"
    rows = _with(rows, c0=first, again=again, relist="has_customer AND NOT has_date", broad=broad, undated="size(emails) > 0 AND NOT has_date", named_only="size(emails) = 0 AND transaction_id IS NULL AND description IS NULL")
    rows = _with(rows, c3="CASE WHEN again THEN by_amount AND in_day ELSE c0 END")
    rows = _with(rows, c6="CASE WHEN relist THEN in_back ELSE c3 END")
    return _with(rows, c7="c6 OR (broad AND backed AND by_amount AND in_back)")


def _sets() -> dict[str, str]:
    """Rows of each tier in order, if no tier before has decided; of those after ``_EARLY``, if they are visible then."""
    who, strict = "base AND who", "base AND who AND time_ok"
    across = f"clock IS NOT NULL AND amount IS NOT NULL AND {who} AND minute_ok AND clock_gap <= {WINDOW_SECONDS} AND (NOT named_only OR same_name)"
    near = f"""CASE WHEN clock IS NOT NULL THEN clock_gap <= {WINDOW_SECONDS} WHEN payment_date IS NOT NULL THEN day_gap <= 1
      WHEN payment_month IS NOT NULL AND payment_day IS NOT NULL THEN date_ok WHEN relative_today THEN abs(created - received_at) <= {WINDOW_SECONDS} ELSE false END"""
    return {
        "strict": f"c0 AND {strict}",
        "zone_boundary": f"c0 AND {across}",
        "day_requery": f"again AND c3 AND {who} AND minute_ok AND (email IS NOT NULL OR (date_ok AND hour_ok))",
        "day_boundary": f"again AND c3 AND {across}",
        "identity_minute": f"undated AND c3 AND {who} AND minute_ok",
        "identity_only": f"undated AND c3 AND {who}",
        "customer_minute": f"relist AND c6 AND {who} AND minute_ok",
        "customer_only": f"relist AND undated AND c6 AND {who}",
        "broad": f"broad AND backed AND c7 AND {strict}",
        "broad_boundary": f"broad AND backed AND c7 AND {across}",
        "broad_minute": f"broad AND undated AND c7 AND {who} AND minute_ok",
        "broad_identity": f"broad AND undated AND c7 AND {who}",
        "date_boundary": f"payment_date IS NOT NULL AND amount IS NOT NULL AND base AND day_gap = 1 AND minute_ok AND hour_ok AND CASE WHEN {_BY_WHO} THEN identity OR id_hit OR same_name ELSE minutes IS NOT NULL END",
        "identity_recovery": "size(emails) > 0 AND n_constraints >= 2 AND base AND time_ok",
        "date_name": f"customer_name IS NOT NULL AND amount IS NOT NULL AND has_date AND {who} AND date_ok AND same_name",
        "canonical": f"amount IS NOT NULL AND eligible AND by_amount AND (id_hit OR identity OR same_name) AND {near}",
    }


def _facts() -> dict[str, str]:
    """What a row says by itself, without its receipt's other rows: the tiers' sets, and what the identifier rule asks."""
    told, listed = "id_hit AND base", "CASE WHEN payment_date IS NOT NULL THEN in_date ELSE in_back END"
    return _sets() | {
        # The day searched again takes other hours only where no row has the right one.
        "other_hour": "again AND c3 AND base AND who AND minute_ok AND email IS NULL AND date_ok",
        "exact": "again AND c3 AND base AND who AND CASE WHEN email IS NOT NULL THEN minute_ok ELSE time_ok END",
        **{f"c{v}": f"c{v}" for v in _STAGES},
        "listed": listed,
        "told": told,
        "timely": f"{told} AND time_ok",
        "id_back": "id_hit AND in_back",
        "swaps": "transaction_id IS NOT NULL AND has_customer",
        **{f"now{v}": f"c{v} AND {told} AND time_ok" for v in _STAGES},
        "now_listed": f"{listed} AND {told} AND time_ok",
        "shuts": f"transaction_id IS NULL AND c7 AND ({_sets()['date_boundary']})",
    }


def _bits(given: dict[str, str]) -> str:
    """One number of the truth of each of ``given``, the first in the lowest bit."""
    return " | ".join(f"CASE WHEN {v} THEN {1 << i}L ELSE 0L END" for i, v in enumerate(given.values()))


def _has(given: dict[str, str], *names: str, of: str = "facts") -> str:
    """Is one of ``names`` true in the number ``of``?"""
    return f"({of} & {sum(1 << list(given).index(n) for n in names)}L) <> 0"


#: Columns of candidate rows beside ``facts``.
_KEPT = ("receipt_id", "id", "created", "payer", "payer_name", "same_name", "claimed", "c_amount", "date_ok")


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows of receipt and charge as what is read later on: a number of ``facts`` and few columns. Rows are many, and wide ones cost a sort its memory."""
    return _visible(rows).selectExpr(*_KEPT, f"{_bits(_facts())} AS facts")


def _able() -> str:
    """Rows that some tier can take, whatever its receipt sees; implied by every set of ``_sets`` and by the identifier rule."""
    near = f"(clock IS NOT NULL AND clock_gap <= {WINDOW_SECONDS})"
    ways = (
        "base AND id_hit",
        "base AND who AND time_ok",
        f"base AND who AND minute_ok AND ({near} OR date_ok OR email IS NOT NULL)",
        "base AND who AND size(emails) > 0 AND NOT has_date",
        f"base AND minute_ok AND day_gap = 1 AND CASE WHEN {_BY_WHO} THEN identity OR id_hit OR same_name ELSE minutes IS NOT NULL END",
        "base AND time_ok AND size(emails) > 0 AND n_constraints >= 2",
        "base AND who AND date_ok AND same_name",
        "eligible AND by_amount AND (identity OR same_name OR id_hit)",
    )
    return f"CASE {' '.join(f'WHEN {w} THEN true' for w in ways)} ELSE false END"


def _decided(rows: DataFrame) -> DataFrame:
    """Candidate rows of whole receipts with ``first`` and ``taken`` (the deciding tier and if it takes the row), ``t_identifier``, ``tier``, ``tier_n`` and ``hit``.

    Only the first tier with a row decides, so only its rows are counted.
    """
    facts, case = _facts(), lambda pairs, rest: f"CASE {' '.join(f'WHEN {w} THEN {v}' for w, v in pairs)} ELSE {rest} END"
    own, any_ = (lambda *n: _has(facts, *n)), (lambda *n: _has(facts, *n, of="every"))
    rows = _with(rows, every=f"bit_or(facts) {_OWN}")
    # Identifiers: what is visible, then the day or lookback list, then all of the lookback by identifier and without times.
    swap = {v: f"(NOT {any_(f'now{v}')} AND {own('swaps')})" for v in _STAGES}
    sure = {v: f"({any_(f'now{v}')} OR ({swap[v]} AND {any_('now_listed')}))" for v in _STAGES}
    seen = {v: f"(CASE WHEN {swap[v]} THEN {own('listed')} ELSE {own(f'c{v}')} END OR (NOT {sure[v]} AND {own('id_back')}))" for v in _STAGES}
    sets = {t: own(t) if i < _EARLY else f"{own(t)} AND {seen['7']}" for i, t in enumerate(TIERS)}
    sets["day_requery"] = f"({own('day_requery')} OR ({own('other_hour')} AND NOT {any_('exact')}))"
    sets |= {f"id{v}": f"{seen[v]} AND CASE WHEN {sure[v]} THEN {own('timely')} ELSE {own('told')} END" for v in _STAGES}
    rows = _with(rows, sets=_bits(sets))
    rows = _with(rows, met=f"bit_or(sets) {_OWN}")
    rows = _with(rows, place=case([(_has(sets, t, of="met"), i) for i, t in enumerate(TIERS)], len(TIERS)))
    stages = [(f"place IN ({', '.join(str(TIERS.index(t)) for t in tiers)})", _has(sets, f"id{v}", of="sets")) for v, tiers in _STAGES.items()]
    rows = _with(rows, mine=f"place < {len(TIERS)} AND (sets & shiftleft(1L, place)) <> 0", t_identifier=case(stages, _has(sets, "id7", of="sets")))
    count = {"n": "mine", "fresh": "mine AND NOT claimed", "named": "mine AND same_name", "id_n": "t_identifier"}
    rows = _with(rows, **{k: f"count_if({v}) {_OWN}" for k, v in count.items()})
    fresh, named = "(n > 1 AND fresh = 1)", "(n > 1 AND named = 1)"
    rows = _with(rows, first=case([(f"place = {i}", f"'{t}'") for i, t in enumerate(TIERS)], "NULL"), taken=f"mine AND (place < {_EARLY} OR id_n = 0) AND CASE WHEN {fresh} THEN NOT claimed WHEN {named} THEN same_name ELSE true END")
    left_n = f"CASE WHEN first IS NULL THEN NULL WHEN {fresh} OR {named} THEN 1 ELSE n END"
    rows = _with(rows, tier="CASE WHEN id_n > 0 THEN 'identifier' ELSE first END", tier_n=f"CASE WHEN id_n > 0 THEN id_n ELSE {left_n} END")
    return rows.selectExpr(*_KEPT, "tier", "tier_n", "first", "taken", "t_identifier", "CASE WHEN id_n > 0 THEN t_identifier ELSE taken END AS hit")


def judged(receipts: DataFrame, charges: DataFrame, customers: DataFrame, as_of: int, zone: str = "UTC", receipt_zone: str | None = None, lookback_days: int = LOOKBACK_DAYS, claims: DataFrame | None = None, budget: int | None = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(receipts with ``early``, candidate rows as ``_decided`` leaves them), both tables in the shared folder."""
    r, book, ids = prepared(receipts, charges, customers, as_of, zone, receipt_zone, lookback_days, claims, budget)
    live = r.filter("early IS NULL")
    live = cut(live.join(sights(live, book, as_of, lookback_days), "receipt_id", "left"))
    able, told, facts = _able(), (as_of, lookback_days, receipt_zone), _facts()
    carry, free = (*READ, *SEEN), live.filter("NOT any_id")  # a hit by identifier hides all but identifiers
    few = ids.drop("scan")
    for more in (customer_pairs(live, book, True).filter("eligible"), payer_pairs(free.filter("amount IS NULL"), book, as_of, lookback_days)):
        few = few.unionByName(more)
    # Who paid, or where no address asks for it what the receipt shows, is part of the joins' keys: an amount alone meets too much.
    by_amount = named_pairs(live, book, as_of, lookback_days, carry).unionByName(shown_pairs(free.filter("email IS NULL"), book, as_of, lookback_days, carry, True))
    listed = listed_pairs(free.filter("amount IS NULL AND email IS NULL"), book, as_of, lookback_days, carry)
    full = live.select("receipt_id", *carry)
    near = cut(_narrow(_told(full.join(few, "receipt_id").unionByName(by_amount).unionByName(listed), *told).filter(able)))

    # Other payers' charges matter to one late tier: only receipts meet them that no tier before it has closed.
    shut = near.filter(_has(facts, *TIERS[:_EARLY], "other_hour", "shuts")).select("receipt_id").distinct()
    open_ = cut(free.filter("email IS NOT NULL AND n_constraints >= 2").join(shut, "receipt_id", "left_anti"))
    late = listed_pairs(open_.filter("amount IS NULL"), book, as_of, lookback_days, carry)
    late = _narrow(_told(late.unionByName(shown_pairs(open_, book, as_of, lookback_days, carry)), *told).filter(able))
    # A pair that several joins have met says the same each time.
    rows = near.unionByName(late).repartition("receipt_id").dropDuplicates(["receipt_id", "id"])
    found = cut(_decided(rows).filter("taken OR t_identifier"))  # every answer is read from these; a hit is one of them
    delete(live, book, ids, near, open_)
    return r, found


def tier(found: DataFrame, name: str) -> DataFrame:
    """(receipt_id, charge_id) pairs that survive one tier, of receipts that were open when it ran."""
    rule = "t_identifier" if name == "identifier" else f"taken AND first = '{name}'"
    return found.filter(rule).select("receipt_id", F.col("id").alias("charge_id"))


#: Reasons for one survivor and for several, by tier.
SEVERAL = {"identifier": "MULTIPLE_TRANSACTION_ID_MATCHES", "date_boundary": "MULTIPLE_DATE_BOUNDARY_MATCHES", "identity_recovery": "MULTIPLE_IDENTITY_RECOVERY_MATCHES", "date_name": "MULTIPLE_DATE_NAME_MATCHES", "canonical": "MULTIPLE_STRIPE_CANONICAL_MATCHES"}
ERRORS = ("INVALID_EVIDENCE", "UNSUPPORTED_PAYMENT_METHOD_TYPE")


def verdicts(r: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per receipt: status, verdict, reason_code, charge_id, candidate_count, tier.

    An identifier that names one charge overrides what came before; several stay unclear. A matched charge whose address is not
    the receipt's makes the reason a recovered identity.
    """
    c = F.col
    one = F.min(F.when(c("hit"), F.struct("id", "payer"))).alias("one")
    folded = rows.groupBy("receipt_id").agg(F.max("tier").alias("tier"), F.max("tier_n").alias("n"), one)
    d = r.select("receipt_id", "early", "email", "emails", "transaction_id", "n_constraints").join(folded, "receipt_id", "left")
    live = c("early").isNull()
    sole, several = F.coalesce(live & (c("n") == 1), F.lit(False)), F.coalesce(live & (c("n") > 1), F.lit(False))
    captionless = (F.size("emails") == 0) & c("transaction_id").isNull()
    other = F.coalesce(c("one.payer") != c("email"), F.lit(False))
    single = F.when(c("tier") == "identifier", "TRANSACTION_ID_MATCH").when(c("tier") == "date_boundary", "DATE_BOUNDARY_SINGLE_MATCH").when(c("tier").isin(*BOUNDARY), "TIMEZONE_BOUNDARY_SINGLE_MATCH")
    single = single.when((c("tier") == "date_name") & captionless, "CAPTIONLESS_DATE_NAME_SINGLE_MATCH").when(c("tier") == "canonical", "STRIPE_CANONICAL_RECOVERY_SINGLE_MATCH")
    single = single.when(c("tier").isin("identity_recovery", "date_name") | other, "IDENTITY_RECOVERED_FROM_STRIPE").when(c("n_constraints") > 0, "EXACT_SINGLE_MATCH").otherwise("EMAIL_SINGLE_MATCH")
    plural = F.coalesce(*[F.when(c("tier") == t, reason) for t, reason in SEVERAL.items()], F.lit("MULTIPLE_EXACT_MATCHES"))
    error, limited = c("early").isin(*ERRORS), c("early") == "STRIPE_PAGINATION_LIMIT"
    status = F.when(error, "ERROR").when(limited, "SEARCH_LIMITED").when(sole, "MATCHED").when(several, "AMBIGUOUS").otherwise("NO_MATCH")
    verdict = F.when(error, "ERROR").when(sole, "VALID").otherwise("UNCLEAR")
    reason = F.when(c("early").isNotNull(), c("early")).when(sole, single).when(several, plural).otherwise("NO_EXACT_MATCH")
    return d.select("receipt_id", status.alias("status"), verdict.alias("verdict"), reason.alias("reason_code"), F.when(sole, c("one.id")).alias("charge_id"), F.coalesce(F.when(live, c("n")), F.lit(0)).cast("long").alias("candidate_count"), F.when(live, c("tier")).alias("tier"))
