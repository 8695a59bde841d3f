"""Column expressions over receipt and chat text: typed fields, normal forms, fingerprints, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, labels and limits that results depend on.
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"
EMAIL_INSIDE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
ADDRESS_TYPO = r"@([a-z0-9-]+)[\s,]+(com|net|org|edu|gov|io|co|ai|me)\b"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_-]{3,127}$"
AMOUNT = r"\$\s*([0-9]+(?:\.[0-9]{2})?)"
TIME = r"(?i)(?:time|at)\s*[:=]?\s*\b([0-9]{1,2}):([0-5][0-9])(?:\s*([AP]M))?\b"
LOOSE_AMOUNT = r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
LOOSE_TIME = r"(?i)(?:today|payment|processed|at)[^\n]{0,32}?\b([0-9]{1,2}):([0-5][0-9])\s*([ap]m)?\b"
ISO_DATE = r"\b((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))\b"
MONTH_DAY = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+([0-9]{1,2})\b"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
STATUSES = ("Completed", "Success", "Paid", "Failed", "Pending", "Declined")
PAYER_LABEL = r"(?i)\b(?:customer|cystomer|customor|cust0mer)\b"
#: Lines that are labels, states or brands, never a payer; so is a line that begins as a purchase.
NO_PAYER = ("payment amount", "payment date", "payment source", "payment identifier", "completed", "cash app", "cash app pay")
PURCHASE = r"(?i)^purchase from "
TOKEN, TOKEN_NEAR = r"[A-Za-z0-9][A-Za-z0-9_-]{3,127}", 140
IDENTIFIER_LABEL = r"(?i)\b(?:payment|transaction)\s+(?:identifier|id)\b"


def found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without one or where the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normal_email(c: Column) -> Column:
    """Trimmed and lowered address, null if malformed."""
    x = F.lower(F.trim(c))
    return F.when(x.rlike(EMAIL), x)


def normal_identifier(c: Column) -> Column:
    x = F.trim(c)
    return F.when(x.rlike(IDENTIFIER), x)


def normal_name(c: Column) -> Column:
    """Edge punctuation dropped, blanks collapsed, lowered; null if empty or above 256."""
    x = F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), r"^[.,;:!?\-]+|[.,;:!?\-]+$", "")), r"\s+", " "))
    return F.when((x != "") & (F.length(x) <= 256), x)


def normal_description(c: Column) -> Column:
    """Blanks collapsed, lowered; null if empty or above 1000."""
    x = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when((x != "") & (F.length(x) <= 1000), x)


def caption_email(c: Column) -> Column:
    """The only address of a caption, after mending a blank or comma before a common ending."""
    x = F.regexp_replace(F.lower(F.trim(c)), ADDRESS_TYPO, "@$1.$2")
    all_ = F.array_distinct(F.regexp_extract_all(x, F.lit(EMAIL[1:-1]), F.lit(0)))
    return F.when(x.rlike(EMAIL), x).when(F.size(all_) == 1, F.get(all_, F.lit(0)))


def amount_cents(text: Column) -> Column:
    """Cents of the first dollar amount; whole dollars or two decimals, never through a double."""
    return (found(text, AMOUNT, 1).cast("decimal(14,2)") * 100).cast("long")


def loose_fields(text: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(cents, hour, minute, month, day) by looser patterns: thousands commas and one decimal, times near a payment word, named months."""
    amount = F.replace(found(text, LOOSE_AMOUNT, 1), F.lit(","), F.lit("")).cast("decimal(14,2)")
    h, half = found(text, LOOSE_TIME, 1).cast("int"), F.upper(found(text, LOOSE_TIME, 3))
    hour = F.when(half.isNull(), F.when(h <= 23, h)).when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(found(text, MONTH_DAY, 1)), 1, 3)).cast("int")
    return F.when((amount > 0) & (amount <= 1_000_000), (amount * 100).cast("long")), hour.cast("int"), found(text, LOOSE_TIME, 2).cast("int"), month, found(text, MONTH_DAY, 2).cast("int")


def clock(text: Column) -> tuple[Column, Column]:
    """(hour 0-23, minute) right after a payment-time word; the hour is null for an invalid 12-hour time."""
    h, half = found(text, TIME, 1).cast("int"), F.upper(found(text, TIME, 3))
    hour = F.when(half.isNotNull() & ~h.between(1, 12), F.lit(None)).when(half == "AM", h % 12).when(half == "PM", h % 12 + 12).when(h <= 23, h)
    return hour.cast("int"), found(text, TIME, 2).cast("int")


def calendar(text: Column) -> tuple[Column, Column, Column]:
    """(ISO date or null, month, day)."""
    iso = found(text, ISO_DATE, 1)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(found(text, MONTH_DAY, 1)), 1, 3)).cast("int")
    month = F.when(iso.isNotNull(), F.substring(iso, 6, 2).cast("int")).otherwise(named)
    day = F.when(iso.isNotNull(), F.substring(iso, 9, 2).cast("int")).otherwise(found(text, MONTH_DAY, 2).cast("int"))
    return iso, month, day


def status(text: Column) -> Column:
    """First of ``STATUSES``, in their order, that is a word of the text."""
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b{s}\b"), s) for s in STATUSES])


def _payer(line: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(line, r"\s+", " "), r"^[ :#=\-()<>|]+|[ :#=\-()<>|]+$", "")
    return F.when(x.rlike(r"^[^ ]*[A-Za-z][^ ]*( [^ ]*[A-Za-z][^ ]*)+$") & ~x.rlike(r"[0-9@$]|https?://") & (F.length(x) <= 256) & ~F.lower(x).isin(*NO_PAYER) & ~x.rlike(PURCHASE), x)


def customer_name(text: Column) -> Column:
    """Name beside a payer label, or on one of the next two lines."""
    lines = F.split(text, "\n")
    near = lambda i: F.coalesce(_payer(F.regexp_replace(F.get(lines, i), rf"^.*?{PAYER_LABEL}".replace("^.*?(?i)", "(?i)^.*?"), "")), _payer(F.get(lines, i + 1)), _payer(F.get(lines, i + 2)))
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(PAYER_LABEL), near(i))), lambda x: x.isNotNull())
    return F.get(at, F.lit(0))


def transaction_id(text: Column) -> Column:
    """Identifier of the first label that has one.

    For a label that is the next token after ``: # = -`` within ``TOKEN_NEAR`` characters; else the first token with a digit
    on the rest of its line; else a line that is just such a token, of the lines +1, -1, +2, -2.
    """
    lines, parts, labels = F.split(text, "\n"), F.split(text, IDENTIFIER_LABEL), F.regexp_extract_all(text, F.lit(IDENTIFIER_LABEL), F.lit(0))
    upto = lambda found, n: F.aggregate(F.slice(found, 1, n), F.lit(0), lambda acc, x: acc + F.length(x))
    telling = lambda c: F.when(c.rlike("[0-9]"), c)
    alone = lambda c: F.when(c.rlike(f"^{TOKEN}$"), telling(c))
    line = lambda i: F.when(i >= 0, alone(F.btrim(F.btrim(F.get(lines, i), F.lit(" \t\r")), F.lit(":#=-"))))

    def of(k: Column) -> Column:
        start = upto(parts, k + 1) + upto(labels, k)
        end = upto(parts, k + 1) + upto(labels, k + 1)
        after = F.substring(text, end + 1, F.length(text))
        row = F.length(F.substring(text, F.lit(1), start)) - F.length(F.translate(F.substring(text, F.lit(1), start), "\n", ""))
        beside = F.filter(F.regexp_extract_all(F.regexp_extract(after, r"^[^\n]*", 0), F.lit(TOKEN), F.lit(0)), lambda x: x.rlike("[0-9]"))
        return F.coalesce(found(F.substring(after, F.lit(1), F.lit(TOKEN_NEAR)), rf"\s*[:#=-]\s*({TOKEN})", 1), F.get(beside, F.lit(0)), *[line(row + d) for d in (1, -1, 2, -2)])

    at = F.filter(F.transform(F.sequence(F.lit(0), F.size(labels) - 1), of), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, F.get(at, F.lit(0)))


def confidence(email: Column, cents: Column, minute: Column, date: Column, state: Column) -> Column:
    """Weighted presence of fields, exact decimals, at most 1."""
    part = lambda c, w: F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0))
    return ((part(email, 35) + part(cents, 35) + part(minute, 15) + part(date, 10) + part(state, 5)) / F.lit(100)).cast("decimal(4,2)")


def fingerprint(*fields: tuple[str, Column]) -> Column:
    """First 32 hex digits of the sha256 of ordered JSON with nulls kept."""
    return F.substring(F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in fields]), {"ignoreNullFields": "false"}), 256), 1, 32)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex strings; null if either is malformed."""
    half = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("long")
    ok = a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$")
    return F.when(ok, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))))


def infer_year(month: Column, day: Column, received: Column) -> Column:
    """Date of a month and day: the received year, or the one before if that lies more than a day ahead; invalid days are null."""
    at = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day)) if hasattr(F, "try_to_date") else F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, month, day), F.lit("yyyy-MM-dd")).cast("date")
    this = at(F.year(received))
    return F.when(month.isNotNull() & day.isNotNull(), F.when(this <= F.date_add(received, 1), this).otherwise(at(F.year(received) - 1)))
