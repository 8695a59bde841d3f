"""Queries of extraction, normal forms, intake, duplicates, quality and bursts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions import text as T
from tallymark.operators import intake, replies
from tallymark.plans import fixtures_sql as S
from tallymark.plans import linkage as L
from tallymark.session import cut, free
from tallymark.sources import fixtures as X

AS_OF = X.AS_OF


def raw():
    """The receipt's text; a column needs a running session, so it is not made at import."""
    return F.col("raw_text")


def _texts(spark, sf_dir):
    return X.receipt_texts(spark, sf_dir)


def _extracted(spark, sf_dir):
    hour, minute = T.clock(raw())
    iso, month, day = T.calendar(raw())
    return _texts(spark, sf_dir).select(
        "receipt_id", T.found(raw(), T.EMAIL_INSIDE, 0).alias("email"), T.amount_cents(raw()).alias("amount_cents"), hour.alias("payment_hour"), minute.alias("minutes"),
        iso.alias("payment_date"), month.alias("payment_month"), day.alias("payment_day"), T.status(raw()).alias("status"), T.transaction_id(raw()).alias("transaction_id"), T.customer_name(raw()).alias("customer_name"),
    )


def extract_email(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "email")


def extract_amount_cents(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "amount_cents")


def extract_time(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "payment_hour", "minutes")


def extract_date(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "payment_date", "payment_month", "payment_day")


def extract_status(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "status")


def extract_transaction_id(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "transaction_id")


def extract_customer_name(spark, sf_dir):
    return _extracted(spark, sf_dir).select("receipt_id", "customer_name")


def field_confidence(spark, sf_dir):
    e = _extracted(spark, sf_dir)
    return e.select("receipt_id", T.confidence(F.col("email"), F.col("amount_cents"), F.col("minutes"), F.col("payment_date"), F.col("status")).alias("confidence"))


def text_field_quality(spark, sf_dir):
    shapes = [r"@", r"\$", r"[0-9]:[0-5][0-9]", T.ISO_DATE, T.IDENTIFIER_LABEL, T.PAYER_LABEL, r"(?i)\bcompleted\b"]
    return _texts(spark, sf_dir).select("receipt_id", sum((raw().rlike(p).cast("long") for p in shapes[1:]), raw().rlike(shapes[0]).cast("long")).alias("quality"))


def _expected(spark, sf_dir):
    e = X.events(spark, sf_dir).filter("event_type = 'purchase'")
    n, t = F.col("event_id"), F.timestamp_seconds("at")
    state = F.when(n % 7 == 0, "Pending").when(n % 7 == 1, "Failed").otherwise("Completed")
    return e.select(F.concat(F.lit("r_"), n.cast("string")).alias("receipt_id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("x_email"), (F.round("value").cast("long") * 100 + n % 100).alias("x_amount"), F.minute(t).alias("x_minutes"), F.date_format(t, "yyyy-MM-dd").alias("x_date"), state.alias("x_status"))


def _paired(spark, sf_dir):
    return _expected(spark, sf_dir).join(_extracted(spark, sf_dir), "receipt_id")


FIELDS = {"email": ("x_email", "email"), "amount_cents": ("x_amount", "amount_cents"), "minutes": ("x_minutes", "minutes"), "payment_date": ("x_date", "payment_date"), "status": ("x_status", "status")}


def join_expected_actual(spark, sf_dir):
    return _paired(spark, sf_dir).select("receipt_id", "x_amount", "amount_cents", "x_date", "payment_date")


def src_labelled_pairs(spark, sf_dir):
    e = _extracted(spark, sf_dir).filter("status <> 'Failed'").select("receipt_id", F.lit(1).alias("there"))
    j = _expected(spark, sf_dir).select("receipt_id").join(e, "receipt_id", "left")
    return j.agg(F.count("there").alias("evaluated"), F.count(F.when(F.col("there").isNull(), 1)).alias("skipped"))


def field_accuracy(spark, sf_dir):
    p = _paired(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(k).alias("field"), F.col(x).cast("string").eqNullSafe(F.col(a).cast("string")).alias("right"), (F.col(a).isNotNull() & ~F.col(x).cast("string").eqNullSafe(F.col(a).cast("string"))).alias("false_value")) for k, (x, a) in FIELDS.items()])
    return p.select(F.inline(each)).groupBy("field").agg(F.count("*").alias("total"), F.sum(F.col("right").cast("long")).alias("n_right"), F.sum(F.col("false_value").cast("long")).alias("n_false"))


def record_accuracy(spark, sf_dir):
    p = _paired(spark, sf_dir)
    whole = None
    for x, a in FIELDS.values():
        one = F.col(x).cast("string").eqNullSafe(F.col(a).cast("string"))
        whole = one if whole is None else whole & one
    return p.agg(F.count("*").alias("total"), F.sum(whole.cast("long")).alias("n_right"))


def _external(spark, sf_dir):
    """A second extraction, as from another provider: it knows other fields."""
    return _expected(spark, sf_dir).select("receipt_id", F.upper("x_email").alias("email2"), (F.col("x_amount") + 1).alias("amount2"), F.col("x_date").alias("date2"), F.lit("Paid").alias("status2"))


def fuse_extractions(spark, sf_dir):
    j = _extracted(spark, sf_dir).join(_external(spark, sf_dir), "receipt_id", "left")
    date = F.when(F.col("payment_date").isNotNull(), F.col("payment_date")).when(F.col("payment_month").isNotNull(), F.lit(None)).otherwise(F.col("date2"))
    return j.select("receipt_id", F.coalesce("email2", "email").alias("email"), F.coalesce("amount2", "amount_cents").alias("amount_cents"), date.alias("payment_date"), "payment_hour", "minutes", F.coalesce("status2", "status").alias("status"))


def fill_from_raw_text(spark, sf_dir):
    """Receipt fields, where missing from the text by the looser patterns; every third text shows its amount with a comma, every fourth with one decimal."""
    r = X.receipts(spark, sf_dir).select("receipt_id", "event_id", "amount", "payment_hour", "minutes", "payment_month", "payment_day").withColumn("amount", F.when(F.col("event_id") % 2 == 0, F.col("amount")))
    n = F.col("event_id")
    shown = F.when(n % 3 == 0, "Amount $1,250.00\n").when(n % 4 == 0, "Amount $10.5\n").otherwise("")
    j = r.join(_texts(spark, sf_dir), "receipt_id").withColumn("told", F.concat(shown, raw()))
    return replies.filled(j, "told").select("receipt_id", "amount", "payment_hour", "minutes", "payment_month", "payment_day")


def _score(r):
    given = [F.col("email").isNotNull(), F.coalesce(F.col("amount") > 0, F.lit(False)), F.col("payment_date").isNotNull(), F.col("minutes").isNotNull(), F.col("transaction_id").isNotNull()]
    return sum((g.cast("long") for g in given[1:]), given[0].cast("long"))


def evidence_score(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    v = L._verdicts(spark, sf_dir).select("receipt_id", "verdict")
    s = r.select("receipt_id", _score(r).alias("score")).join(v, "receipt_id")
    return s.select("receipt_id", "score", ((F.col("verdict") != "VALID") & (F.col("score") < 2)).alias("recover"))


def prefer_recovered(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    again = r.join(_extracted(spark, sf_dir).select("receipt_id", F.col("email").alias("e2"), F.col("minutes").alias("m2")), "receipt_id")
    second = sum((c.isNotNull().cast("long") for c in (F.col("m2"), F.col("payment_date"), F.col("transaction_id"))), F.col("e2").isNotNull().cast("long")) + 1
    return again.select("receipt_id", F.when(second > _score(r), "recovered").otherwise("first").alias("chosen"))


def build_evidence(spark, sf_dir):
    r = X.receipts(spark, sf_dir).select("receipt_id", F.col("email").alias("caption"), "received_at", "relative_today")
    e = _extracted(spark, sf_dir)
    j = r.join(e, "receipt_id")
    both = F.slice(F.array_distinct(F.array_compact(F.array(F.lower("caption"), F.col("email")))), 1, 8)
    return j.select("receipt_id", F.coalesce("caption", "email").alias("email"), F.array_join(both, ",").alias("email_candidates"), "amount_cents", F.when(F.col("minutes").between(0, 59), F.col("minutes")).alias("minutes"), F.when(F.col("payment_hour").between(0, 23), F.col("payment_hour")).alias("payment_hour"), "relative_today")


def email_candidate_set(spark, sf_dir):
    j = X.receipts(spark, sf_dir).select("receipt_id", F.col("email").alias("caption")).join(_extracted(spark, sf_dir), "receipt_id")
    mails = F.array(T.normal_email(F.col("caption")), T.normal_email(F.col("email")), T.normal_email(F.lit("not an address")))
    return j.select("receipt_id", F.array_join(F.sort_array(F.array_distinct(F.array_compact(mails))), ",").alias("emails"))


def cap_lists(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    return r.groupBy("group_id", "payment_date").agg(F.array_sort(F.collect_set("email")).alias("e")).select("group_id", "payment_date", F.array_join(F.slice("e", 1, 8), ",").alias("emails"))


def normalize_email(spark, sf_dir):
    r = X.receipts(spark, sf_dir).filter("email IS NOT NULL")
    return r.select("receipt_id", T.normal_email(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("  "), F.upper("email"))).when(F.col("event_id") % 4 == 1, F.replace("email", F.lit("."), F.lit(".."))).otherwise(F.col("email"))).alias("email"))


def normalize_ids_names(spark, sf_dir):
    c = X.charges(spark, sf_dir)
    return c.select("id", T.normal_name(F.concat(F.lit(" ."), F.replace("billing_name", F.lit(" "), F.lit("   ")), F.lit(",-"))).alias("name"), T.normal_identifier(F.when(F.col("event_id") % 5 == 0, F.lit("a b")).otherwise(F.concat(F.lit(" "), F.col("provider_id")))).alias("identifier"))


def bounded_values(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    value = F.when(F.col("event_id") % 3 == 0, F.concat((F.col("event_id") % 90).cast("string"), F.lit("x"))).otherwise((F.col("event_id") % 90).cast("string"))
    n = value.try_cast("int")
    return r.select("receipt_id", F.when(n.between(0, 59), n).alias("minutes"))


def infer_year(spark, sf_dir):
    e = X.events(spark, sf_dir).filter("event_type = 'purchase'")
    got = F.to_date(F.timestamp_seconds("at"))
    month, day = (F.col("event_id") % 12 + 1).cast("int"), (F.col("event_id") % 31 + 1).cast("int")
    return e.select("event_id", T.infer_year(month, day, got).alias("payment_date"))


def relative_today(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    return r.select("receipt_id", F.when(F.col("relative_today"), F.date_format(F.from_utc_timestamp(F.timestamp_seconds("received_at"), "America/New_York"), "yyyy-MM-dd")).alias("today"))


def identity_hashes(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    return m.select("message_id", F.substring(F.sha2("group_id", 256), 1, 12).alias("group_hash"), F.substring(F.sha2("sender", 256), 1, 10).alias("sender_hash"))


def _print(r):
    """Fingerprints of receipts: of all fields, without the name, and of what is visible."""
    mail = F.when(F.col("email").isNotNull(), F.substring(F.sha2("email", 256), 1, 16))
    date, when = F.date_format("payment_date", "yyyy-MM-dd"), F.col("payment_hour").isNotNull() & F.col("minutes").isNotNull()
    month, day = F.coalesce("payment_month", F.month("payment_date")), F.coalesce("payment_day", F.day("payment_date"))
    shown = (("payment_date", date), ("payment_month", month), ("payment_day", day), ("payment_hour", F.col("payment_hour")), ("minutes", F.col("minutes")))
    full = lambda name: T.fingerprint(("email", mail), ("amount_cents", F.col("amount")), ("transaction_id", F.lower("transaction_id")), ("customer_name", name), *shown)
    dated = F.col("payment_date").isNotNull() | (month.isNotNull() & day.isNotNull())
    told = F.col("transaction_id").isNotNull() | (dated & when)
    name = F.lower("customer_name")
    prints = {"full_print": F.when(told, full(name)), "legacy_print": F.when(told, full(F.lit(None).cast("string"))), "visual_print": F.when((F.col("amount") > 0) & dated & when, T.fingerprint(("amount_cents", F.col("amount")), *shown))}
    return r.withColumns(prints | {"mail": mail, "name": name, "tx": F.lower("transaction_id")})


def receipt_fingerprint(spark, sf_dir):
    return _print(X.receipts(spark, sf_dir)).select("receipt_id", F.col("full_print").alias("fingerprint"), F.col("legacy_print").alias("legacy_fingerprint"))


def visual_fingerprint(spark, sf_dir):
    return _print(X.receipts(spark, sf_dir)).select("receipt_id", F.col("visual_print").alias("fingerprint"))


def hamming64(spark, sf_dir):
    h = X.hashes(spark, sf_dir)
    w = W.partitionBy(F.col("vec_id") % 16).orderBy("vec_id")
    return h.select("vec_id", T.hamming64(F.col("phash"), F.lag("phash").over(w)).cast("long").alias("distance"))


def dup_phash_only(spark, sf_dir):
    return intake.near_hashes(X.hashes(spark, sf_dir), "vec_id", "phash", 6)


def src_message_events(spark, sf_dir):
    return X.messages(spark, sf_dir).select("message_id", "group_id", "sender", "received_at", "is_image")


def validate_events(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    mime = F.when(F.col("event_id") % 11 == 0, "image/gif").otherwise("image/png")
    return m.select("message_id", F.when(~F.length("message_id").between(1, 128) | ~F.length("group_id").between(1, 256), "INVALID_EVENT_IDENTITY").when(F.col("is_image") & ~mime.isin("image/jpeg", "image/png", "image/webp"), "INVALID_IMAGE_PAYLOAD").alias("reason_code"))


def filter_allowlist(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    allowed = m.filter("group_id <> 'g3'").select("group_id").distinct()
    return m.filter("is_image").join(allowed, "group_id", "left_semi").select("message_id", "group_id")


def parse_allowlist(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    lists = m.select(F.concat(F.lit(" "), F.col("group_id"), F.lit("@g.us , "), F.col("sender"), F.lit(",,")).alias("l"))
    each = lists.select(F.explode(F.split("l", ",")).alias("j")).select(F.trim("j").alias("jid")).filter("jid <> ''").distinct()
    return each.select("jid", F.col("jid").rlike(r"^[A-Za-z0-9-]+@g\.us$").alias("well_formed"))


def caption_email(spark, sf_dir):
    return X.messages(spark, sf_dir).filter("NOT is_image").select("message_id", T.caption_email(F.col("body")).alias("email"))


def join_caption_nearest(spark, sf_dir):
    m = X.messages(spark, sf_dir).dropDuplicates(["message_id"])
    return intake.nearest_caption(m.filter("is_image"), m.filter("NOT is_image"), 3600)


def ttl_anchor_dedup(spark, sf_dir):
    return intake.first_sightings(X.messages(spark, sf_dir).select("sender", "received_at"), "sender", "received_at", 3600)


def late_events(spark, sf_dir):
    w = W.partitionBy("group_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    delayed = X.messages(spark, sf_dir).dropDuplicates(["message_id"]).withColumn("arrived_for", F.col("received_at") - F.when(F.col("event_id") % 17 == 0, 7200).otherwise(0))
    return delayed.withColumn("mark", F.max("arrived_for").over(w)).filter("arrived_for < mark - 3600").select("message_id")


def job_status_summary(spark, sf_dir):
    m = X.messages(spark, sf_dir).filter("is_image").select("group_id", "sender", "received_at", "event_id", F.element_at(F.array(F.lit("pending"), F.lit("running"), F.lit("done")), (F.col("event_id") % 3 + 1).cast("int")).alias("state"))
    last = m.groupBy("group_id", "sender").agg(F.max_by("state", F.struct("received_at", "event_id")).alias("state"))
    return last.groupBy("group_id", "state").agg(F.count("*").alias("n"))


def fallback_rate(spark, sf_dir):
    """Share of texts that would go to an external extractor, by why: a missing address or amount, else a low confidence."""
    e = _extracted(spark, sf_dir)
    sure = T.confidence(F.col("email"), F.col("amount_cents"), F.col("minutes"), F.col("payment_date"), F.col("status"))
    why = F.when(F.col("email").isNull() | F.col("amount_cents").isNull(), "MISSING_FIELDS").when(sure < 1, "LOW_CONFIDENCE").otherwise("NONE")
    told = e.select(why.alias("fallback_reason"))
    n = told.groupBy("fallback_reason").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(told.agg(F.count("*").alias("total"))), how="inner").select("fallback_reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def best_extraction(spark, sf_dir):
    tries = _texts(spark, sf_dir).select("receipt_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    n = F.substring("receipt_id", 3, 20).cast("long")
    scored = tries.withColumns({"conf": (n * 7 + F.col("attempt") * 31) % 100, "quality": (n + F.col("attempt")) % 8})
    good = ((F.col("conf") >= 60) & (F.col("quality") >= 4)).cast("int")
    w = W.partitionBy("receipt_id").orderBy(F.desc("good"), F.when(F.col("good") == 1, F.col("attempt")).otherwise(-F.col("quality")), F.desc("conf"), "attempt")
    return scored.withColumn("good", good).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("receipt_id", F.col("attempt").cast("long").alias("attempt"))


def retain_newest(spark, sf_dir):
    return X.receipts(spark, sf_dir).orderBy(F.desc("received_at"), "receipt_id").limit(500).select("receipt_id")


def retain_window(spark, sf_dir):
    return X.receipts(spark, sf_dir).filter(F.col("received_at") >= AS_OF - 7 * 86400).select("receipt_id")


def _ambiguous(spark, sf_dir):
    """(receipts that the cascade left ambiguous but by date boundary, its candidate rows), both tables."""
    r, rows = L._judged(spark, sf_dir)
    v = L.cascade.verdicts(r, rows).filter("status = 'AMBIGUOUS' AND reason_code <> 'MULTIPLE_DATE_BOUNDARY_MATCHES'").select("receipt_id")
    receipts = cut(X.receipts(spark, sf_dir).join(v, "receipt_id", "left_semi"))
    free(r)
    return receipts, rows


def _open_receipts(spark, sf_dir):
    """(ambiguous receipts, their candidates in newest-first order), the first a table: it is read several times."""
    receipts, rows = _ambiguous(spark, sf_dir)
    listed = rows.filter("hit").select("receipt_id", F.col("id").alias("charge_id"), "created", "payer", "payer_name", "c_amount").join(receipts.select("receipt_id"), "receipt_id", "left_semi")
    place = F.row_number().over(W.partitionBy("receipt_id").orderBy(F.desc("created"), "charge_id"))
    return receipts, listed.withColumn("place", place.cast("long"))


def _bursts(receipts):
    return intake.bursts(receipts, "group_id", "received_at", 6 * 3600)


def _sized_bursts(spark, sf_dir):
    return _bursts(_ambiguous(spark, sf_dir)[0])


def _last8(bursts):
    w = W.partitionBy("group_id", "burst").orderBy(F.desc("received_at"), "receipt_id")
    return bursts.withColumn("rn", F.row_number().over(w)).select("receipt_id", (F.col("rn") <= 8).alias("kept"))


def batch_take_last8(spark, sf_dir):
    return _last8(_sized_bursts(spark, sf_dir))


def _verified():
    """Address that an earlier verification of a receipt without one had matched: of every second receipt."""
    return F.when(F.col("email").isNull() & (F.col("event_id") % 2 == 0), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")))


def _scored(spark, sf_dir, bursts, listed):
    """Identifier 10 000, address 1 000, name 500, up to 400 for minutes between the shown and the charge's clock, 100 for an address verified before, amount 1."""
    c = X.charges(spark, sf_dir).select(F.col("id").alias("charge_id"), L.cascade.payment_identifier().alias("pid"))
    users = X.events(spark, sf_dir).select("event_id", "user_id")
    b = bursts.join(users, "event_id").withColumn("verified", _verified())
    shown = F.unix_timestamp(F.col("payment_date").cast("timestamp")) + F.col("payment_hour") * 3600 + F.col("minutes") * 60
    gap = F.abs(shown - F.floor(F.col("created") / 60) * 60) / 60
    points = lambda same, n: F.coalesce(same.cast("long"), F.lit(0)) * n
    told = points(F.lower("pid") == F.lower("transaction_id"), 10000) + points(F.col("payer") == F.lower("email"), 1000) + points(F.col("payer_name") == F.lower("customer_name"), 500)
    told = told + F.coalesce(F.greatest(F.lit(0), 400 - F.least(F.lit(400), gap)), F.lit(0)) + points(F.col("verified") == F.col("payer"), 100)
    amount = points(F.col("amount") == F.col("c_amount"), 1)
    # Only receipts that show an identifier ask for the charge's: the other pairs, which are most, are not dealt by charge.
    j = b.filter("transaction_id IS NOT NULL").join(listed, "receipt_id").join(c, "charge_id")
    j = j.unionByName(b.filter("transaction_id IS NULL").join(listed, "receipt_id").withColumn("pid", F.lit(None).cast("string")))
    return j.select("group_id", "burst", "receipt_id", F.col("received_at").alias("arrived"), "charge_id", "place", (told + amount).cast("long").alias("score"), told.cast("long").alias("discriminator"))


def batch_pair_score(spark, sf_dir):
    """Scores of each ambiguous receipt's own candidates."""
    receipts, listed = _open_receipts(spark, sf_dir)
    return _scored(spark, sf_dir, _bursts(receipts), listed).select("receipt_id", "charge_id", "place", "score", "discriminator")


def redact_review(spark, sf_dir):
    c = X.charges(spark, sf_dir)
    mask = F.when(F.length("provider_id") > 8, F.concat(F.substring("provider_id", 1, 4), F.lit("..."), F.expr("right(provider_id, 4)"))).otherwise(F.lit("****"))
    return c.select("id", mask.alias("masked"), F.substring(F.regexp_replace("billing_name", r"[^\x20-\x7E]", ""), 1, 160).alias("name"), F.concat(F.lit("$"), F.floor(F.col("amount") / 100).cast("string"), F.lit("."), F.lpad((F.col("amount") % 100).cast("string"), 2, "0")).alias("amount_text"))


def redact_transport(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    line = F.concat(F.lit("failed:   "), F.col("url"), F.lit("\n\n retry"))
    return p.select("page_id", F.substring(F.trim(F.regexp_replace(F.regexp_replace(line, r"https?://[^\s]+", "<url>"), r"\s+", " ")), 1, 240).alias("message"))


def validate_image(spark, sf_dir):
    """Images rendered from page bytes: size limit and magic bytes."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    content = F.concat(F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("00"))), F.to_binary(F.coalesce("html", F.lit("")), F.lit("utf-8")))
    head = F.hex(F.substring(content, 1, 8))
    return p.select("page_id", F.octet_length(content).cast("long").alias("n_bytes"), F.when(F.octet_length(content) > 10 << 20, "TOO_LARGE").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG").otherwise("UNKNOWN").alias("kind"))


def content_sha256(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))


_T = S.with_(S.EVENTS, S.TEXTS.strip()).rstrip()
_R = S.with_(S.EVENTS, S.RECEIPTS.strip()).rstrip()
_RT = S.with_(S.EVENTS, S.RECEIPTS.strip(), S.TEXTS.strip()).rstrip()
_M = S.with_(S.EVENTS, S.MESSAGES.strip()).rstrip()
_H = S.with_(S.HASHES.strip()).rstrip()
_C = S.with_(S.CHARGES).rstrip()
_MAIL = "nullif(regexp_extract(raw_text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}'), '')"
_CENTS = "(nullif(regexp_extract(raw_text, '\\$\\s*([0-9]+(?:\\.[0-9]{2})?)', 1), '')::DECIMAL(14,2) * 100)::BIGINT"
_TIME = "'(?i)(?:time|at)\\s*[:=]?\\s*\\b([0-9]{1,2}):([0-5][0-9])(?:\\s*([AP]M))?\\b'"
_MIN = f"nullif(regexp_extract(raw_text, {_TIME}, 2), '')::INTEGER"
_HOUR0 = f"nullif(regexp_extract(raw_text, {_TIME}, 1), '')::INTEGER"
_HALF = f"upper(regexp_extract(raw_text, {_TIME}, 3))"
_HOUR = f"(CASE WHEN {_HALF} <> '' AND NOT {_HOUR0} BETWEEN 1 AND 12 THEN NULL WHEN {_HALF} = 'AM' THEN {_HOUR0} % 12 WHEN {_HALF} = 'PM' THEN {_HOUR0} % 12 + 12 WHEN {_HOUR0} <= 23 THEN {_HOUR0} END)"
_ISO = "nullif(regexp_extract(raw_text, '\\b((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))\\b', 1), '')"
_MD = "'(?i)\\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?\\s+([0-9]{1,2})\\b'"
_LOOSE = "'(?i)(?:today|payment|processed|at)[^\\n]{0,32}?\\b([0-9]{1,2}):([0-5][0-9])\\s*([ap]m)?\\b'"
_MON = f"CASE WHEN {_ISO} IS NOT NULL THEN substr({_ISO}, 6, 2)::INTEGER ELSE nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(regexp_extract(raw_text, {_MD}, 1)), 1, 3)), 0)::INTEGER END"
_DAY = f"CASE WHEN {_ISO} IS NOT NULL THEN substr({_ISO}, 9, 2)::INTEGER ELSE nullif(regexp_extract(raw_text, {_MD}, 2), '')::INTEGER END"
_STATE = "CASE " + " ".join(f"WHEN regexp_matches(raw_text, '(?i)\\b{s}\\b') THEN '{s}'" for s in T.STATUSES) + " END"
_ID = "coalesce(nullif(regexp_extract(raw_text, 'Payment identifier: ([A-Z0-9]+)', 1), ''), nullif(regexp_extract(raw_text, '([A-Z0-9]*[0-9][A-Z0-9]*)\\nPayment identifier', 1), ''))"
_NAME = "regexp_extract(raw_text, 'C(?:ustomer|ystomer):?\\s+(?:Payment source\\s+)?(Payer [a-j]+)', 1)"
_E = f"x AS (SELECT receipt_id, {_MAIL} AS email, {_CENTS} AS amount_cents, {_HOUR} AS payment_hour, {_MIN} AS minutes, {_ISO} AS payment_date, {_MON} AS payment_month, {_DAY} AS payment_day, {_STATE} AS status, {_ID} AS transaction_id, {_NAME} AS customer_name FROM texts)"
_WANT = """want AS (SELECT 'r_' || event_id AS receipt_id, 'user' || user_id || '@example.com' AS x_email, round(value)::BIGINT * 100 + event_id % 100 AS x_amount, minute(s)::INTEGER AS x_minutes, strftime(s, '%Y-%m-%d') AS x_date,
  CASE WHEN event_id % 7 = 0 THEN 'Pending' WHEN event_id % 7 = 1 THEN 'Failed' ELSE 'Completed' END AS x_status FROM (SELECT *, to_timestamp(secs) AT TIME ZONE 'UTC' AS s FROM e WHERE event_type = 'purchase'))"""
_P = f"{_RT},\n{_E},\n{_WANT}"
_RIGHT = " AND ".join(f"{x}::VARCHAR IS NOT DISTINCT FROM {a}::VARCHAR" for x, a in FIELDS.values())
_SCORE = "((email IS NOT NULL)::BIGINT + coalesce(amount > 0, false)::BIGINT + (payment_date IS NOT NULL)::BIGINT + (minutes IS NOT NULL)::BIGINT + (transaction_id IS NOT NULL)::BIGINT)"
_OK = "regexp_full_match({0}, '[a-zA-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?(?:\\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?)+')"
_J = lambda *f: "substr(sha256('{' || " + " || ',' || ".join(f"'\"{k}\":' || coalesce({v}, 'null')" for k, v in f) + " || '}'), 1, 32)"
_Q = lambda x: f"'\"' || {x} || '\"'"
_COMMON = (("payment_date", _Q("strftime(payment_date, '%Y-%m-%d')")), ("payment_month", "coalesce(payment_month, month(payment_date))::VARCHAR"), ("payment_day", "coalesce(payment_day, day(payment_date))::VARCHAR"), ("payment_hour", "payment_hour::VARCHAR"), ("minutes", "minutes::VARCHAR"))
_ALL = lambda name: _J(("email", _Q("substr(sha256(email), 1, 16)")), ("amount_cents", "amount::VARCHAR"), ("transaction_id", _Q("lower(transaction_id)")), ("customer_name", name), *_COMMON)
_SEEN = _J(("amount_cents", "amount::VARCHAR"), *_COMMON)
_WHEN = "(payment_date IS NOT NULL OR (payment_month IS NOT NULL AND payment_day IS NOT NULL)) AND payment_hour IS NOT NULL AND minutes IS NOT NULL"
_TOLD = f"transaction_id IS NOT NULL OR ({_WHEN})"
_PR = f"p AS (SELECT *, CASE WHEN {_TOLD} THEN {_ALL(_Q('lower(customer_name)'))} END AS full_print, CASE WHEN {_TOLD} THEN {_ALL('NULL')} END AS legacy_print, CASE WHEN amount > 0 AND {_WHEN} THEN {_SEEN} END AS visual_print, lower(customer_name) AS name, lower(transaction_id) AS tx, substr(sha256(email), 1, 16) AS mail FROM receipts)"
_PRINTS = f"{_R},\n{_PR}"
_HAM = "bit_count(xor(('0x' || substr({0}, 1, 8))::BIGINT, ('0x' || substr({1}, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr({0}, 9, 8))::BIGINT, ('0x' || substr({1}, 9, 8))::BIGINT))"
_OPEN = "SELECT receipt_id FROM verdicts WHERE status = 'AMBIGUOUS' AND reason_code <> 'MULTIPLE_DATE_BOUNDARY_MATCHES'"
_BURST = L._VERDICTS + f",\nb0 AS (SELECT *, received_at - lag(received_at) OVER (PARTITION BY group_id ORDER BY received_at, receipt_id) AS gap FROM receipts WHERE receipt_id IN ({_OPEN})),\nb AS (SELECT *, sum((coalesce(gap, 0) > 21600)::INT) OVER (PARTITION BY group_id ORDER BY received_at, receipt_id) AS burst FROM b0)"

_PLAIN = {
    extract_email: f"{_T},\n{_E} SELECT receipt_id, email FROM x",
    extract_amount_cents: f"{_T},\n{_E} SELECT receipt_id, amount_cents FROM x",
    extract_time: f"{_T},\n{_E} SELECT receipt_id, payment_hour, minutes FROM x",
    extract_date: f"{_T},\n{_E} SELECT receipt_id, payment_date, payment_month, payment_day FROM x",
    extract_status: f"{_T},\n{_E} SELECT receipt_id, status FROM x",
    extract_transaction_id: f"{_T},\n{_E} SELECT receipt_id, transaction_id FROM x",
    extract_customer_name: f"{_T},\n{_E} SELECT receipt_id, customer_name FROM x",
    field_confidence: f"{_T},\n{_E} SELECT receipt_id, (((email IS NOT NULL)::INT * 35 + (amount_cents IS NOT NULL)::INT * 35 + (minutes IS NOT NULL)::INT * 15 + (payment_date IS NOT NULL)::INT * 10 + (status IS NOT NULL)::INT * 5) / 100)::DECIMAL(4,2) AS confidence FROM x",
    text_field_quality: f"{_T} SELECT receipt_id, 1 + 1 + regexp_matches(raw_text, '[0-9]:[0-5][0-9]')::BIGINT + ({_ISO} IS NOT NULL)::BIGINT + 1 + 1 + regexp_matches(raw_text, '(?i)\\bcompleted\\b')::BIGINT AS quality FROM texts",
    join_expected_actual: f"{_P} SELECT receipt_id, x_amount, amount_cents, x_date, payment_date FROM want JOIN x USING (receipt_id)",
    src_labelled_pairs: f"{_P} SELECT count(*) FILTER (status <> 'Failed') AS evaluated, count(*) FILTER (status = 'Failed') AS skipped FROM want JOIN x USING (receipt_id)",
    field_accuracy: f"{_P} " + " UNION ALL ".join(f"SELECT '{k}' AS field, count(*) AS total, count(*) FILTER ({x}::VARCHAR IS NOT DISTINCT FROM {a}::VARCHAR) AS n_right, count(*) FILTER ({a} IS NOT NULL AND {x}::VARCHAR IS DISTINCT FROM {a}::VARCHAR) AS n_false FROM want JOIN x USING (receipt_id)" for k, (x, a) in FIELDS.items()),
    record_accuracy: f"{_P} SELECT count(*) AS total, count(*) FILTER ({_RIGHT}) AS n_right FROM want JOIN x USING (receipt_id)",
    fuse_extractions: f"{_P} SELECT receipt_id, upper(x_email) AS email, x_amount + 1 AS amount_cents, CASE WHEN payment_date IS NOT NULL THEN payment_date WHEN payment_month IS NOT NULL THEN NULL ELSE x_date END AS payment_date, payment_hour, minutes, 'Paid' AS status FROM x JOIN want USING (receipt_id)",
    fill_from_raw_text: f"{_RT}, j AS (SELECT r.receipt_id, CASE WHEN event_id % 2 = 0 THEN amount END AS amount, payment_hour, minutes, payment_month, payment_day, CASE WHEN event_id % 3 = 0 THEN 'Amount $1,250.00' || chr(10) WHEN event_id % 4 = 0 THEN 'Amount $10.5' || chr(10) ELSE '' END || raw_text AS raw_text FROM receipts r JOIN texts USING (receipt_id)), "
    f"l AS (SELECT *, replace(nullif(regexp_extract(raw_text, '\\$\\s*([0-9][0-9,]*(?:\\.[0-9]{{1,2}})?)', 1), ''), ',', '')::DECIMAL(14,2) AS a, nullif(regexp_extract(raw_text, {_LOOSE}, 1), '')::INTEGER AS h, nullif(regexp_extract(raw_text, {_LOOSE}, 2), '')::INTEGER AS m, upper(regexp_extract(raw_text, {_LOOSE}, 3)) AS half FROM j) "
    f"SELECT receipt_id, coalesce(amount, CASE WHEN a > 0 AND a <= 1000000 THEN (a * 100)::BIGINT END) AS amount, coalesce(payment_hour, CASE WHEN half = '' THEN CASE WHEN h <= 23 THEN h END WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END END) AS payment_hour, coalesce(minutes, m) AS minutes, "
    f"coalesce(payment_month, nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(regexp_extract(raw_text, {_MD}, 1)), 1, 3)), 0)::INTEGER) AS payment_month, coalesce(payment_day, nullif(regexp_extract(raw_text, {_MD}, 2), '')::INTEGER) AS payment_day FROM l",
    evidence_score: f"{L._VERDICTS} SELECT receipt_id, {_SCORE} AS score, v.verdict <> 'VALID' AND {_SCORE} < 2 AS recover FROM receipts w JOIN verdicts v USING (receipt_id)",
    prefer_recovered: f"{_P} SELECT receipt_id, CASE WHEN (x.email IS NOT NULL)::INT + (x.minutes IS NOT NULL)::INT + (r.payment_date IS NOT NULL)::INT + (r.transaction_id IS NOT NULL)::INT + 1 > (r.email IS NOT NULL)::INT + coalesce(r.amount > 0, false)::INT + (r.payment_date IS NOT NULL)::INT + (r.minutes IS NOT NULL)::INT + (r.transaction_id IS NOT NULL)::INT THEN 'recovered' ELSE 'first' END AS chosen FROM receipts r JOIN x USING (receipt_id)",
    build_evidence: f"{_P} SELECT receipt_id, coalesce(r.email, x.email) AS email, CASE WHEN r.email IS NULL OR lower(r.email) = x.email THEN x.email ELSE lower(r.email) || ',' || x.email END AS email_candidates, x.amount_cents, CASE WHEN x.minutes BETWEEN 0 AND 59 THEN x.minutes END AS minutes, x.payment_hour, relative_today FROM receipts r JOIN x USING (receipt_id)",
    email_candidate_set: f"{_P} SELECT receipt_id, array_to_string(list_sort(list_distinct([r.email, x.email])), ',') AS emails FROM receipts r JOIN x USING (receipt_id)".replace("[r.email, x.email]", f"[CASE WHEN {_OK.format('r.email')} THEN r.email END, x.email]"),
    cap_lists: f"{_R} SELECT group_id, payment_date, coalesce(array_to_string((list_sort(list_distinct(list(email))))[1:8], ','), '') AS emails FROM receipts GROUP BY 1, 2",
    normalize_email: f"{_R}, v AS (SELECT receipt_id, lower(trim(CASE WHEN event_id % 4 = 0 THEN '  ' || upper(email) WHEN event_id % 4 = 1 THEN replace(email, '.', '..') ELSE email END)) AS m FROM receipts WHERE email IS NOT NULL) SELECT receipt_id, CASE WHEN {_OK.format('m')} THEN m END AS email FROM v",
    normalize_ids_names: f"{_C} SELECT id, lower(billing_name) AS name, CASE WHEN event_id % 5 <> 0 THEN provider_id END AS identifier FROM charges",
    bounded_values: f"{_R} SELECT receipt_id, CASE WHEN event_id % 3 <> 0 AND event_id % 90 < 60 THEN (event_id % 90)::INTEGER END AS minutes FROM receipts",
    infer_year: f"{S.with_(S.EVENTS)}, d AS (SELECT event_id, (to_timestamp(secs) AT TIME ZONE 'UTC')::DATE AS g, event_id % 12 + 1 AS m, event_id % 31 + 1 AS y FROM e WHERE event_type = 'purchase'), c AS (SELECT *, try_cast(printf('%04d-%02d-%02d', year(g), m, y) AS DATE) AS a, try_cast(printf('%04d-%02d-%02d', year(g) - 1, m, y) AS DATE) AS b FROM d) SELECT event_id, CASE WHEN a <= g + 1 THEN a ELSE b END AS payment_date FROM c",
    relative_today: f"{_R} SELECT receipt_id, CASE WHEN relative_today THEN strftime(to_timestamp(received_at) AT TIME ZONE 'America/New_York', '%Y-%m-%d') END AS today FROM receipts",
    identity_hashes: f"{_M} SELECT message_id, substr(sha256(group_id), 1, 12) AS group_hash, substr(sha256(sender), 1, 10) AS sender_hash FROM messages",
    receipt_fingerprint: f"{_PRINTS} SELECT receipt_id, full_print AS fingerprint, legacy_print AS legacy_fingerprint FROM p",
    visual_fingerprint: f"{_PRINTS} SELECT receipt_id, visual_print AS fingerprint FROM p",
    hamming64: f"{_H}, l AS (SELECT vec_id, phash, lag(phash) OVER (PARTITION BY vec_id % 16 ORDER BY vec_id) AS q FROM hashes) SELECT vec_id, ({_HAM.format('phash', 'q')})::BIGINT AS distance FROM l",
    dup_phash_only: f"{_H}, j AS (SELECT a.vec_id AS low, b.vec_id AS high, ({_HAM.format('a.phash', 'b.phash')})::BIGINT AS distance FROM hashes a JOIN hashes b ON a.vec_id < b.vec_id) SELECT * FROM j WHERE distance <= 6",
    src_message_events: f"{_M} SELECT message_id, group_id, sender, received_at, is_image FROM messages",
    validate_events: f"{_M} SELECT message_id, CASE WHEN is_image AND event_id % 11 = 0 THEN 'INVALID_IMAGE_PAYLOAD' END AS reason_code FROM messages",
    filter_allowlist: f"{_M} SELECT message_id, group_id FROM messages WHERE is_image AND group_id <> 'g3'",
    parse_allowlist: f"{_M} SELECT DISTINCT jid, jid LIKE '%@g.us' AS well_formed FROM (SELECT group_id || '@g.us' AS jid FROM messages UNION ALL SELECT sender FROM messages)",
    caption_email: f"{_M} SELECT message_id, regexp_replace(lower(body), ' com$', '.com') AS email FROM messages WHERE NOT is_image",
    join_caption_nearest: f"{_M}, i AS (SELECT DISTINCT * FROM messages WHERE is_image), c AS (SELECT DISTINCT * FROM messages WHERE NOT is_image), p AS (SELECT i.message_id, c.message_id AS caption_id, abs(i.received_at - c.received_at) AS gap FROM i JOIN c ON i.group_id = c.group_id AND i.sender = c.sender AND abs(i.received_at - c.received_at) <= 3600), q AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY gap, caption_id) AS a, row_number() OVER (PARTITION BY caption_id ORDER BY gap, message_id) AS b FROM p) SELECT message_id, caption_id, gap FROM q WHERE a = 1 AND b = 1",
    ttl_anchor_dedup: f"{_M}, l AS (SELECT sender, list_sort(list(received_at)) AS t FROM messages GROUP BY 1), f AS (SELECT sender, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 3600 THEN list_append(acc, x[1]) ELSE acc END) AS k FROM l) SELECT sender, unnest(k) AS received_at FROM f",
    late_events: f"{_M}, d AS (SELECT DISTINCT message_id, group_id, event_id, received_at - CASE WHEN event_id % 17 = 0 THEN 7200 ELSE 0 END AS a FROM messages) SELECT message_id FROM (SELECT *, max(a) OVER (PARTITION BY group_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM d) WHERE a < mark - 3600",
    job_status_summary: f"{_M}, s AS (SELECT group_id, sender, arg_max(['pending', 'running', 'done'][event_id % 3 + 1], (received_at, event_id)) AS state FROM messages WHERE is_image GROUP BY 1, 2) SELECT group_id, state, count(*) AS n FROM s GROUP BY ALL",
    fallback_rate: f"{_T},\n{_E}, r AS (SELECT CASE WHEN email IS NULL OR amount_cents IS NULL THEN 'MISSING_FIELDS' WHEN minutes IS NULL OR payment_date IS NULL OR status IS NULL THEN 'LOW_CONFIDENCE' ELSE 'NONE' END AS fallback_reason FROM x) SELECT fallback_reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS rate FROM r GROUP BY 1",
    best_extraction: f"{_R}, s AS (SELECT receipt_id, a AS attempt, (event_id * 7 + a * 31) % 100 AS conf, (event_id + a) % 8 AS q FROM r0, range(1, 4) r(a)), g AS (SELECT *, (conf >= 60 AND q >= 4)::INT AS good FROM s) SELECT receipt_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY good DESC, CASE WHEN good = 1 THEN attempt ELSE -q END, conf DESC, attempt) AS rn FROM g) WHERE rn = 1",
    retain_newest: f"{_R} SELECT receipt_id FROM receipts ORDER BY received_at DESC, receipt_id LIMIT 500",
    retain_window: f"{_R} SELECT receipt_id FROM receipts WHERE received_at >= {AS_OF - 7 * 86400}",
    batch_take_last8: f"{_BURST} SELECT receipt_id, row_number() OVER (PARTITION BY group_id, burst ORDER BY received_at DESC, receipt_id) <= 8 AS kept FROM b",
    batch_pair_score: _BURST
    + f""", lst AS (SELECT receipt_id, id AS charge_id, created, payer, payer_name, c_amount, row_number() OVER (PARTITION BY receipt_id ORDER BY created DESC, id) AS place FROM flags WHERE hit),
s AS (
  SELECT b.receipt_id, l.charge_id, l.place, coalesce(b.amount = l.c_amount, false)::BIGINT AS one,
    (coalesce(lower({L._IDENTIFIER}) = lower(b.transaction_id), false)::INT * 10000 + coalesce(l.payer = lower(b.email), false)::INT * 1000 + coalesce(l.payer_name = lower(b.customer_name), false)::INT * 500
    + coalesce(greatest(0, 400 - least(400, abs(epoch(b.payment_date)::BIGINT + b.payment_hour * 3600 + b.minutes * 60 - l.created // 60 * 60) // 60)), 0)
    + (b.email IS NULL AND b.event_id % 2 = 0 AND coalesce(l.payer = 'user' || e.user_id || '@example.com', false))::INT * 100)::BIGINT AS discriminator
  FROM b JOIN lst l USING (receipt_id) JOIN charges c ON c.id = l.charge_id JOIN e ON e.event_id = b.event_id)
SELECT receipt_id, charge_id, place, discriminator + one AS score, discriminator FROM s""",
    redact_review: f"{_C} SELECT id, CASE WHEN length(provider_id) > 8 THEN substr(provider_id, 1, 4) || '...' || right(provider_id, 4) ELSE '****' END AS masked, billing_name AS name, '$' || (amount // 100) || '.' || lpad((amount % 100)::VARCHAR, 2, '0') AS amount_text FROM charges",
    redact_transport: "SELECT page_id, CASE WHEN url IS NOT NULL THEN 'failed: <url> retry' END AS message FROM pages",
    validate_image: "SELECT page_id, strlen(coalesce(html, '')) + CASE WHEN page_id % 3 = 0 THEN 8 WHEN page_id % 3 = 1 THEN 3 ELSE 1 END AS n_bytes, CASE WHEN strlen(coalesce(html, '')) + CASE WHEN page_id % 3 = 0 THEN 8 WHEN page_id % 3 = 1 THEN 3 ELSE 1 END > 10485760 THEN 'TOO_LARGE' WHEN page_id % 3 = 0 THEN 'PNG' WHEN page_id % 3 = 1 THEN 'JPEG' ELSE 'UNKNOWN' END AS kind FROM pages",
    content_sha256: "SELECT page_id, sha256(coalesce(html, '')) AS sha256 FROM pages",
}

QUERIES = {f.__name__: f for f in _PLAIN}
ORACLE_SQL = {f.__name__: v for f, v in _PLAIN.items()}
