"""Text, money, date and label functions as Column expressions: all of it runs inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, functions as F

from .. import fixed as X


def lookup(values: dict, key: Column) -> Column:
    """A small fixed dictionary as a map literal; null for an unknown or null key."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])
    return F.try_element_at(table, key)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """All letters up to U+1EFF that decompose to one base character and marks."""
    pairs = []
    for code in chain(range(0xA0, 0x250), range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}+", "")


def fold_case(c: Column) -> Column:
    """Lower case without accents: both sides of an accent-insensitive search."""
    return strip_accents(F.lower(F.coalesce(c, F.lit(""))))


def norm_key(c: Column) -> Column:
    """Key for comparing names: no accents, case, legal forms or punctuation; null becomes empty."""
    bare = F.regexp_replace(fold_case(c), f"(?U){X.LEGAL_FORM}", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def executor_key(c: Column) -> Column:
    """Name key without titles, words in order, so swapped names agree."""
    words = F.filter(F.split(norm_key(c), " "), lambda w: (w != "") & ~w.isin(*X.EXECUTOR_WORDS))
    return F.array_join(F.array_sort(words), " ")


def parse_money(c: Column) -> Column:
    """Amount in a text: a bare number, else the number before a euro sign, else the first number."""
    s = strip(F.translate(c, "\u00a0", " "))
    currency = f"(?iuU){X.MONEY_CURRENCY}"
    found = F.when(s.rlike(currency), F.regexp_extract(s, currency, 1)).otherwise(s)
    whole = F.regexp_replace(F.regexp_extract(found, X.MONEY_NUMBER, 1), "[ .\u00a0]", "")
    cents = F.coalesce(F.nullif(F.regexp_extract(found, X.MONEY_NUMBER, 2), F.lit("")), F.lit("0"))
    return F.when(s.rlike(f"^{X.MONEY_BARE}$"), s.try_cast("double")).when(whole != "", F.concat(whole, F.lit("."), cents).try_cast("double"))


def _amount(written: Column) -> Column:
    """The first number of a text as an amount; null without one."""
    whole_ = F.regexp_replace(F.regexp_extract(written, X.MONEY_NUMBER, 1), "[ .\u00a0]", "")
    cents = F.regexp_extract(written, X.MONEY_NUMBER, 2)
    return F.concat(whole_, F.lit("."), F.when(cents == "", "0").otherwise(cents)).try_cast("double")


def _next_end(n: int):
    """Appends the end of the next occurrence of a label of n characters."""
    return lambda ends, part: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + F.length(part) + n))


def find_money_after(text: Column, *labels: str, window: int = 160) -> Column:
    """First amount that isn't zero within `window` characters after a label; labels in order, then places."""
    tries = []
    for label in labels:
        parts = F.split(F.lower(text), rf"\Q{label.lower()}\E", -1)
        nothing = F.array().cast("array<int>")
        ends = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), nothing, _next_end(len(label)))
        # the number before a euro sign is cut out once, and its parts are read from that
        near = F.transform(ends, lambda e: F.regexp_extract(F.substring(text, e + 1, F.lit(window)), f"(?iuU){X.MONEY_CURRENCY}", 1))
        amounts = F.transform(F.filter(near, lambda g: g != ""), _amount)
        tries.append(F.try_element_at(F.filter(amounts, lambda v: v > 0), F.lit(1)))
    return F.coalesce(*tries)


def parse_date(c: Column) -> Column:
    """ISO, else d.m.yyyy, else a named month; the first form found decides, and an invalid date is null."""
    s = strip(c)
    part = lambda p, k: F.regexp_extract(s, p, k)
    named = f"(?iu){X.DATE_NAMED}"
    month = lookup(X.MONTHS, fold_case(part(named, 2))).cast("string")
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")
    return (
        F.when(s.rlike(X.DATE_ISO), made(part(X.DATE_ISO, 1), part(X.DATE_ISO, 2), part(X.DATE_ISO, 3)))
        .when(s.rlike(f"(?U){X.DATE_DOTS}"), made(part(f"(?U){X.DATE_DOTS}", 3), part(f"(?U){X.DATE_DOTS}", 2), part(f"(?U){X.DATE_DOTS}", 1)))
        .when(s.rlike(named) & month.isNotNull(), made(part(named, 3), month, part(named, 1)))
    )


def parse_time(c: Column) -> Column:
    """HH:MM of the first H:MM, H.MM or H,MM if it is a time of day, else of the first "H hod"."""
    digits, hour = f"(?U){X.TIME_DIGITS}", f"(?U){X.TIME_HOUR}"
    number = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    return F.when((number(digits, 1) < 24) & (number(digits, 2) < 60), F.concat(F.lpad(F.regexp_extract(c, digits, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, digits, 2))).when(
        number(hour, 1) < 24, F.concat(F.lpad(F.regexp_extract(c, hour, 1), 2, "0"), F.lit(":00"))
    )


def combine(day: Column, time: Column) -> Column:
    """ISO date, or date and time where the time is known; "no time" is not midnight."""
    iso = day.cast("string")
    return F.when(time.isNull(), iso).otherwise(F.concat(iso, F.lit("T"), time, F.lit(":00")))


def parse_datetime(c: Column) -> Column:
    clock = r"(\d{1,2}):(\d{2})"
    time = F.when(c.rlike(clock), F.concat(F.lpad(F.regexp_extract(c, clock, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, clock, 2)))
    return combine(parse_date(c), time)


def parse_round(c: Column) -> Column:
    """Round number: a leading number or an ordinal word; "repeated" adds one."""
    low = strip(F.lower(c))
    ordinal = F.coalesce(*[F.when(low.startswith(w) | F.contains(F.concat(F.lit(" "), low), F.lit(f" {w}")), F.lit(n)) for w, n in X.ORDINALS.items()])
    base = F.when(low.rlike(r"^\d+"), F.regexp_extract(low, r"^(\d+)", 1).try_cast("int")).otherwise(ordinal)
    again = F.coalesce(F.nullif(base, F.lit(0)), F.lit(1)) + 1
    return F.when(low == "", None).when(F.contains(low, F.lit("opakov")), again).otherwise(base)


def property_type(c: Column) -> Column:
    """Type of real estate that a description names; rules in order."""
    t = fold_case(c)
    has = lambda p: t.rlike(f"(?U){p}")
    return (
        F.when(has(X.TYPE_BYT_NUMBERED), "byt")
        .when(has(X.TYPE_BYT_WORD) & F.contains(t, F.lit("bytov")) & ~F.contains(t, F.lit("rodinn")), "byt")
        .when(has(X.TYPE_DOM), "dom").when(has(X.TYPE_REKREACNY), "rekreacny").when(has(X.TYPE_NEBYTOVY), "nebytovy").when(has(X.TYPE_GARAZ), "garaz")
        .when(has(X.TYPE_BUILDING), F.when(has(X.TYPE_DWELLING), "dom").otherwise("nebytovy"))
        .when(has(X.TYPE_POZEMOK), "pozemok").otherwise("ine")
    )


def redact(c: Column) -> Column:
    """Hide birth dates, personal numbers, home addresses and the names beside them, in this order."""
    safe = X.REDACTED.replace("$", r"\$")
    for pattern, put in (
        (f"(?iuU){X.REDACT_NAME_AFTER}", f"$1{safe}"), (f"(?U){X.REDACT_NAME_BEFORE}", safe), (f"(?iuU){X.REDACT_ADDRESS}", f"$1 {safe}"),
        (f"(?U){X.REDACT_MAIDEN}", ""), (f"(?iuU){X.REDACT_BIRTH}", f"(nar. {safe})"), (f"(?iuU){X.REDACT_NUMBER}", f"r. č. {safe}"),
    ):
        c = F.regexp_replace(c, pattern, put)
    return c


def html_to_text(c: Column) -> Column:
    """Tags to line breaks or spaces, the common entities decoded (twice escaped too), white space collapsed.

    Entities beyond these and NFC need a table that SQL doesn't have; `sources.parse.html_to_text` covers them.
    """
    for _ in range(3):
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"(?i)</?(p|div|li|ul|ol|br|tr|h\d|table)\b[^>]*>", "\n")
    c = F.translate(F.regexp_replace(c, "<[^>]+>", " "), "\u00a0\u200b", " ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \t\r\f\u000b]+", " "), " *\n *", "\n"), "\n{2,}", "\n")
    return F.coalesce(strip(c), F.lit(""))


def valid_place(c: Column) -> Column:
    """Whether a value can be a place name and not a label or part of a sentence."""
    s = strip(c)
    bad = (F.length(s) > 45) | F.contains(s, F.lit(":")) | s.rlike(r"\d{3,}") | s.rlike(f"(?iu){X.PLACE_FORBIDDEN}")
    return F.coalesce((c != "") & ~bad, F.lit(False))


def company_id(c: Column) -> Column:
    """Six to eight digits, spaces dropped; else null."""
    bare = F.regexp_replace(c, r"(?U)\s", "")
    return F.when(bare.rlike(r"^\d{6,8}$"), bare)


def public_id(group_key: Column) -> Column:
    """Stable code of an auction, the same after every rebuild."""
    return F.substring(F.sha1(group_key), 1, 10)


def whole(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(c).cast("long")


def discount(price: Column, value: Column) -> Column:
    return F.when((price != 0) & (value > price), 1 - price / value).otherwise(F.lit(0.0))


def discount_percent(price: Column, value: Column) -> Column:
    """Whole percents, halves up; null where there is no discount of 5 % to show."""
    percent = F.floor(discount(price, value) * 100 + 0.5).cast("long")
    return F.when(percent >= 5, percent)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    return F.when(n == 1, one).when(n.between(2, 4), few).otherwise(many)


def area_text(area: Column) -> Column:
    """A number as %g writes it (six significant digits), with a decimal comma."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(area, F.lit(1.0)))).cast("int"))
    spelled = F.format_string("%.5f", area)
    rounded = F.coalesce(*[F.when(digits == k, F.format_string(f"%.{k}f", area)) for k in range(6)], spelled)
    return F.translate(F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", ""), ".", ",")


def short_title(kind: Column, place: Column, area: Column) -> Column:
    """Type label, place if known, and the area of flats, houses and business space."""
    label = F.coalesce(lookup(X.TYPE_LABELS, F.coalesce(kind, F.lit("ine"))), F.lit("Nehnuteľnosť"))
    with_area = kind.isin("byt", "dom", "nebytovy") & (area > 0)
    return F.concat(label, F.when(place != "", F.concat(F.lit(", "), place)).otherwise(""), F.when(with_area, F.concat(F.lit(", "), area_text(area), F.lit(" m²"))).otherwise(""))


def _thousands(c: Column, space: str) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(space))


def money_text(c: Column, space: str = "\u00a0") -> Column:
    """Whole euros, a space between thousands; a dash for null."""
    return F.when(c.isNull(), "—").otherwise(F.concat(_thousands(F.bround(c), space), F.lit(f"{space}€")))


def money_short(c: Column) -> Column:
    """Map label: millions with up to two decimals, thousands from 10 000 on, else whole euros; empty for null."""
    millions = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(c / 1_000_000, 2)), "0+$", ""), r"\.$", "")
    return (
        F.when(c.isNull(), "").when(c >= 1_000_000, F.concat(F.translate(millions, ".", ","), F.lit(" mil. €")))
        .when(c >= 10_000, F.concat(_thousands(F.floor(c / 1000 + 0.5), "\u00a0"), F.lit(" tis. €"))).otherwise(money_text(c))
    )


def days_text(day: Column, today: Column) -> Column:
    """How far a day is from today, in words; empty for null."""
    n = F.date_diff(day, today)
    return (
        F.when(n.isNull(), "").when(n == 0, "dnes").when(n == 1, "zajtra").when(n == -1, "včera")
        .when(n.between(2, 4), F.concat(F.lit("o "), n, F.lit(" dni"))).when(n >= 5, F.concat(F.lit("o "), n, F.lit(" dní")))
        .otherwise(F.concat(F.lit("pred "), -n, F.lit(" dňami")))
    )


def day_text(c: Column) -> Column:
    """An ISO date or date-time as "d. m. yyyy", with " o HH:MM" where a time is known; a dash for null."""
    day = F.date_format(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), "d. M. yyyy")
    written = F.when(F.length(c) > 10, F.concat(day, F.lit(" o "), F.substring(c, 12, 5))).otherwise(day)
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(F.coalesce(written, c))


def value_text(c: Column) -> Column:
    """How a value is written in the change history: whole numbers without decimals."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def differs(a: Column, b: Column) -> Column:
    """Null-safe difference of amounts, with the tolerance for money."""
    return F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).otherwise(F.abs(a - b) > X.MONEY_TOLERANCE)
