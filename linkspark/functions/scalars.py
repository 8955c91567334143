"""Scalar rules as Column functions: phones, numbers, dates, keys, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null where a text is empty after trimming."""
    return F.nullif(F.trim(c), F.lit(""))


def destination(account: Column, name: Column) -> Column:
    """Where money goes: the account if there is one, else the name."""
    return F.coalesce(blank(account), blank(name))


def name_or_account(account: Column, name: Column) -> Column:
    return F.coalesce(blank(name), blank(account))


def outgoing(direction: Column) -> Column:
    return F.upper(direction).isin("DR", "DEBIT", "OUT")


def incoming(direction: Column) -> Column:
    return F.upper(direction).isin("CR", "CREDIT", "IN")


def shown_direction(direction: Column) -> Column:
    """CREDIT / DEBIT for display, by what the text contains."""
    up = F.upper(direction)
    return F.when(up.isin("CR", "IN") | up.contains("CREDIT") | up.contains("INCOMING"), "CREDIT").when(up.isin("DR", "OUT") | up.contains("DEBIT") | up.contains("OUTGOING"), "DEBIT").otherwise(up)


def norm_phone(phone: Column) -> Column:
    """Ten digits from 6 to 9 on where the text has them, by length; else the text."""
    t = F.regexp_replace(F.substring_index(F.trim(phone), ".", 1), r"[^0-9A-Za-z]", "")
    t = F.when(t.rlike(r"^91[6-9]\d{9}$"), F.substring(t, 3, 10)).when(t.rlike(r"^0+[6-9]\d{9}$"), F.right(t, F.lit(10))).otherwise(t)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^([6-9]\d{9})$", 1), F.lit("")), t)


def norm_phone_legacy(phone: Column) -> Column:
    """As the older rule, which takes 91 off any number that begins with it."""
    t = F.regexp_replace(F.regexp_replace(F.substring_index(F.trim(phone), ".", 1), r"^\+?91", ""), "^0+", "")
    return F.coalesce(F.nullif(F.regexp_extract(t, r"([6-9]\d{9})", 1), F.lit("")), t)


def party_phone(phone: Column) -> Column:
    """A call record's party: letters, digits, underscores and hyphens; of digits alone
    the country code or trunk zero is taken off by length."""
    t = F.regexp_replace(F.regexp_replace(F.trim(phone), r"\.0$", ""), r"[^\w-]", "")
    code = (F.length(t) == 12) & t.startswith("91") | (F.length(t) == 11) & t.startswith("0")
    return blank(F.when(t.rlike(r"^\d+$") & code, F.right(t, F.lit(10))).otherwise(t))


def strict_msisdn(phone: Column) -> Column:
    t = norm_phone(phone)
    return F.when(t.rlike(r"^[6-9]\d{9}$"), t)


def imei(text: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(text, r"\(\d+\)\s*$", ""), r"[^0-9]", "")
    return F.when(F.length(d) == 15, d)


def imsi(text: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(text, r"\(\d+\)\s*$", ""), r"[^0-9]", "")
    return F.when(F.length(d).between(14, 15), d)


def seconds(text: Column) -> Column:
    """Whole seconds from ``75``, ``MM:SS`` or ``HH:MM:SS``; else null."""
    t = F.trim(text)
    p = F.split(t, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(t.rlike(r"^\d+(\.0+)?$"), F.substring_index(t, ".", 1).try_cast("int")).when(t.rlike(r"^\d+:\d{1,2}:\d{1,2}$"), n(0) * 3600 + n(1) * 60 + n(2)).when(t.rlike(r"^\d+:\d{1,2}$"), n(0) * 60 + n(1))


def number(text: Column) -> Column:
    """A number with thousands commas; what is none counts as 0."""
    return F.coalesce(F.nanvl(F.regexp_replace(F.trim(text), "[,₹ ]", "").try_cast("double"), F.lit(0.0)), F.lit(0.0))


# The ten date layouts, day first, tried in this order.
DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "dd.MM.yyyy", "yyyyMMdd")


def moment(text: Column, clock: Column | None = None) -> Column:
    """A timestamp from a date text (and a clock text), by the first layout that fits."""
    t = F.trim(text)
    both = t if clock is None else F.trim(F.concat_ws(" ", t, F.coalesce(blank(clock), F.lit("00:00:00"))))
    layouts = DATE_LAYOUTS if clock is None else tuple(f"{x} HH:mm:ss" for x in DATE_LAYOUTS if "HH" not in x)
    return F.coalesce(*[F.try_to_timestamp(both, F.lit(x)) for x in layouts], t.try_cast("timestamp"))


def day_fraction(date: Column, fraction: Column) -> Column:
    """A spreadsheet's clock: the fraction of a day after a date."""
    return F.timestamp_add("SECOND", F.bround(fraction.cast("double") * 86400, 0).cast("int"), date.cast("timestamp"))


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` from day-first or year-first digits; else null."""
    p = lambda pattern, i: F.regexp_extract(text, pattern, i)
    y, d = r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
    return F.when(text.rlike(y), F.concat_ws("-", p(y, 1), F.lpad(p(y, 2), 2, "0"), F.lpad(p(y, 3), 2, "0"))).when(text.rlike(d), F.concat_ws("-", p(d, 3), F.lpad(p(d, 2), 2, "0"), F.lpad(p(d, 1), 2, "0")))


def phone_list(text: Column) -> Column:
    """Distinct last ten digits of every number in a list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;/|\s]+"), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: F.length(x) >= 10), lambda x: F.right(x, F.lit(10))))


def missing_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin("<NA>", "nan", "None", "NaT", "NaN", ""), F.trim(c))


def two_places(x: Column) -> Column:
    """A number with two decimals, as text, by the number's exact value; only a value that
    is exactly in the middle goes to the even cent. Where the third decimal seems to be a
    5, the error of the product by a thousand, which is known exactly, decides."""
    x = x.cast("double")
    v = F.abs(x)
    p = v * 1000
    n = F.rint(p)
    high = v * 134217729.0 - (v * 134217729.0 - v)
    error = (high * 1000 - p) + (v - high) * 1000
    beside, down = (p - n) + error, F.floor(n / 10)
    middle = F.when(beside < 0, down).when(beside > 0, down + 1).otherwise(down + down % 2)
    cents = F.when(n % 10 == 5, middle).otherwise(F.rint(v * 100)).cast("long")
    return F.concat(F.when((x < 0) & (cents > 0), "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def rupees(amount: Column) -> Column:
    """An amount in crores, lakhs or rupees, as text."""
    sign = F.lit("₹")
    whole = F.concat(sign, F.format_number(F.bround(amount, 0), 0))
    return F.when(amount >= 1e7, F.concat(sign, two_places(amount / 1e7), F.lit(" Cr"))).when(amount >= 1e5, F.concat(sign, two_places(amount / 1e5), F.lit(" L"))).otherwise(whole)


def header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def scrub(text: Column) -> Column:
    """Without quotes and equals signs at the ends."""
    return F.trim(F.regexp_replace(text, r"""^['"=]+|['"=]+$""", ""))


def call_type(text: Column) -> Column:
    """Operators' words for a call's kind."""
    # Their codes and what these mean.
    names = {"IN": "INCOMING", "OUT": "OUTGOING", "SMT": "SMS INCOMING", "SMO": "SMS OUTGOING", "A2P_SMSIN": "SMS INCOMING"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(text))), F.upper(F.trim(text)))


def lat_long(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, r"\s*[/,|;]\s*")
    return blank(F.get(parts, F.lit(0))), blank(F.get(parts, F.lit(1)))


def is_round(amount: Column) -> Column:
    """5 000 or more, and a multiple of it once rounded half to even."""
    return (amount >= 5000) & (F.bround(amount, 0) % 5000 == 0)


def has_clock(ts: Column) -> Column:
    return ~((F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0))


def shown_time(ts: Column) -> Column:
    return F.when(has_clock(ts), F.date_format(ts, "dd-MMM-yyyy HH:mm:ss")).otherwise(F.date_format(ts, "dd-MMM-yyyy"))


# The fields of a ledger row that may hold a clock, in the order they are read.
CLOCK_FIELDS = ("narration", "description", "reference_number", "derived_reference_number", "counterparty_upi_id", "mode")


def clock_text(columns: list[str]) -> Column:
    """The fields of a row that may hold a clock, side by side; absent and null ones count
    as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("") for c in CLOCK_FIELDS])


def clock_from_text(text: Column, anchor: Column) -> Column:
    """A clock in a text that agrees with the anchor's date, by the first stage that has
    one: H:MM(:SS); ddmmyyyyHHMMSS from 2020 on; yyyymmddHHMMSS; the first place of the
    anchor's date with six digits in the twelve characters after it. Without an anchor
    the two stages that hold a date count as they are."""
    day = F.to_date(anchor)
    digits = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{14})(?!\d)"), F.lit(1))
    fits = lambda t: F.coalesce(F.to_date(t) == day, F.to_date(t).isNotNull() & day.isNull())
    stamp = lambda layout, since: F.get(F.filter(F.transform(digits, lambda x: F.try_to_timestamp(x, F.lit(layout))), lambda t: fits(t) & F.year(t).between(since, 2099 if since == 2000 else 9999)), F.lit(0))
    h, m, s = (F.regexp_extract(text, r"\b([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?\b", i) for i in (1, 2, 3))
    plain = F.when(h != "", F.try_to_timestamp(F.concat(F.date_format(anchor, "yyyy-MM-dd "), F.lpad(h, 2, "0"), F.lit(":"), m, F.lit(":"), F.when(s == "", "00").otherwise(s)), F.lit("yyyy-MM-dd HH:mm:ss")))
    key = F.date_format(anchor, "yyyyMMdd")
    after = F.when(F.contains(text, key), F.substring(text, F.call_function("instr", text, key) + 8, F.lit(12)))
    late = F.try_to_timestamp(F.concat(key, F.substring(F.regexp_replace(after, "[^0-9]", ""), 1, 6)), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(plain, stamp("ddMMyyyyHHmmss", 2020), stamp("yyyyMMddHHmmss", 2000), late)


def half_even(x: Column) -> Column:
    return F.bround(x, 0)
