"""Dates as statements print them, as YYYY-MM-DD strings (MM-DD without a year)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DATE_PATTERNS = (
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b[A-Za-z]{3,9}\.?\s+\d{1,2}\b",
    r"\b\d{1,2}\s+[A-Za-z]{3,9}\b",
)
NUMERIC_RANGE = r"\b(\d{1,2})[/-](\d{1,2})[/-](20\d{2})\b\s*(?:to|through|-|–|—|−)\s*\b(\d{1,2})[/-](\d{1,2})[/-](20\d{2})\b"
NAMED_RANGE = r"(?i)([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:,?\s*(\d{4}))?\s*(?:to|through|-|–|—)\s*([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:,?\s*(\d{4}))?"
LEADING_DATE = r"^\s*([A-Za-z]{3,9})\.?\s+(\d{1,2})(?!\d)(.*)$"


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name or its first letters, else null."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _built(year: Column, month: Column, day: Column) -> Column:
    sound = month.between(1, 12) & day.between(1, 31)
    short = F.concat(_two(month), F.lit("-"), _two(day))
    return F.when(sound, F.when(year.isNull(), short).otherwise(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), short)))


def _no_year() -> Column:
    return F.lit(None).cast("int")


def normalize_date(raw: Column, year: Column | None = None) -> Column:
    """A date token in one of five forms, tried in order; null if it is none.

    Year first; month/day/year, swapped where only the other order is possible; the same with two year digits, never
    swapped; month name and day; day and month name. The last two take the given year, or none.
    """
    s, year = F.trim(raw), _no_year() if year is None else year
    g = lambda p, k: F.regexp_extract(s, p, k)
    iso, full, short = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$"
    name_day, day_name = r"^([A-Za-z]{3,})\.?\s+(\d{1,2})$", r"^(\d{1,2})\s+([A-Za-z]{3,})\.?$"
    a, b = _int(g(full, 1)), _int(g(full, 2))
    swap = (a > 12) & (b <= 12)
    return (
        F.when(s.rlike(iso), F.concat(g(iso, 1), F.lit("-"), _two(_int(g(iso, 2))), F.lit("-"), _two(_int(g(iso, 3)))))
        .when(s.rlike(full), _built(_int(g(full, 3)), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)))
        .when(s.rlike(short), _built(_int(g(short, 3)) + 2000, _int(g(short, 1)), _int(g(short, 2))))
        .when(s.rlike(name_day), _built(year, month_number(g(name_day, 1)), _int(g(name_day, 2))))
        .when(s.rlike(day_name), _built(year, month_number(g(day_name, 2)), _int(g(day_name, 1))))
    )


DAY_MONTH = r"^(\d{1,2})[/-](\d{1,2})$"


def day_month_date(raw: Column, year: Column | None = None) -> Column:
    """A bare 5/12: month first, swapped where only the other order is possible."""
    s = F.trim(raw)
    a, b = _int(F.regexp_extract(s, DAY_MONTH, 1)), _int(F.regexp_extract(s, DAY_MONTH, 2))
    swap = (a > 12) & (b <= 12)
    return F.when(s.rlike(DAY_MONTH), _built(_no_year() if year is None else year, F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)))


def resolve_day_month(raw: Column, context: Column, day_first: Column, year: Column) -> Column:
    """A bare day and month with the order and the year that the statement's date context (or the given year) implies."""
    s = F.trim(raw)
    a, b = _int(F.regexp_extract(s, DAY_MONTH, 1)), _int(F.regexp_extract(s, DAY_MONTH, 2))
    day, month = F.when(day_first, a).otherwise(b), F.when(day_first, b).otherwise(a)
    wrong = ~month.between(1, 12)
    day, month = F.when(wrong, month).otherwise(day), F.when(wrong, day).otherwise(month)
    crossing = F.when(month >= context["start_month"], context["start_year"]).otherwise(context["end_year"])
    chosen = F.when(context.isNull(), year).when(context["crosses_year"], crossing).otherwise(context["start_year"])
    return F.when(s.rlike(DAY_MONTH), _built(chosen, month, day))


def date_context(text: Column) -> Column:
    """struct(start_year, start_month, end_year, end_month, crosses_year, day_first) of a printed period, or null."""
    g = lambda k: _int(F.regexp_extract(text, NUMERIC_RANGE, k))
    day_first = (g(1) > 12) | (g(4) > 12)
    first, last = F.when(day_first, g(2)).otherwise(g(1)), F.when(day_first, g(5)).otherwise(g(4))
    numeric = F.struct(
        g(3).alias("start_year"), first.alias("start_month"), g(6).alias("end_year"), last.alias("end_month"),
        ((g(3) != g(6)) | (first > last)).alias("crosses_year"), day_first.alias("day_first"),
    )
    named_range = r"(?i)([A-Za-z]{3,9})\.?\s+\d{1,2}\s*(?:to|through|-|–|—|−)\s*([A-Za-z]{3,9})\.?\s+\d{1,2}(?:,)?\s*(20\d{2})"
    h = lambda k: F.regexp_extract(text, named_range, k)
    one, two, year = month_number(h(1)), month_number(h(2)), _int(h(3))
    named = F.struct(
        F.when(one > two, year - 1).otherwise(year).alias("start_year"), one.alias("start_month"), year.alias("end_year"), two.alias("end_month"),
        (one > two).alias("crosses_year"), F.lit(False).alias("day_first"),
    )
    return F.when(text.rlike(NUMERIC_RANGE), F.when(first.between(1, 12) & last.between(1, 12), numeric)).when(one.isNotNull() & two.isNotNull(), named)


def ordinal(month: Column, day: Column) -> Column:
    return (month - 1) * 31 + day


def statement_period(text: Column) -> Column:
    """struct(start_ord, end_ord, crosses_year, start_month, end_month, start_year, end_year) of a named-month period."""
    g = lambda k: F.regexp_extract(text, NAMED_RANGE, k)
    m1, m2, d1, d2 = month_number(g(1)), month_number(g(4)), _int(g(2)), _int(g(5))
    one, two = ordinal(m1, d1), ordinal(m2, d2)
    sound = m1.isNotNull() & m2.isNotNull() & d1.between(1, 31) & d2.between(1, 31)
    return F.when(
        sound,
        F.struct(
            one.alias("start_ord"), two.alias("end_ord"), (one > two).alias("crosses_year"), m1.alias("start_month"), m2.alias("end_month"),
            _int(g(3)).alias("start_year"), _int(g(6)).alias("end_year"),
        ),
    )


def row_year(period: Column, month: Column, fallback: Column) -> Column:
    """The year of a month in a period that may cross a year's end."""
    start, end = period["start_year"], period["end_year"]
    early = F.when(month >= period["start_month"], F.coalesce(start, end - 1))
    late = F.when(month <= period["end_month"], F.coalesce(end, start + 1))
    return F.when(period.isNull(), fallback).when(~period["crosses_year"], F.coalesce(start, end, fallback)).otherwise(F.coalesce(early, late, end, start, fallback))


def in_period(period: Column, month: Column, day: Column, buffer: int = 10) -> Column:
    at = ordinal(month, day)
    after, before = at >= period["start_ord"] - buffer, at <= period["end_ord"] + buffer
    return F.when(period["crosses_year"], after | before).otherwise(after & before)


PERIOD_YEAR, ANY_YEAR = r"(?i)statement\s+(?:from|period)[^\n]*?(20\d{2})", r"\b(20\d{2})\b"


def fallback_year(text: Column) -> Column:
    return _int(F.regexp_extract(text, ANY_YEAR, 1))


def period_year(text: Column) -> Column:
    """The year on a statement-period line, else the first year found."""
    return F.coalesce(_int(F.regexp_extract(text, PERIOD_YEAR, 1)), fallback_year(text))


def find_date(line: Column) -> Column:
    """The earliest token of a line that reads as a date and is no part of a number; null if there is none."""

    # What can still be wrong with a token of each pattern is less than normalize_date checks.
    def sound(order: int, token: Column) -> Column:
        if order == 0:
            return F.lit(True)
        if order == 1:
            part = F.split(token, "[/-]")
            a, b, long = _int(part[0]), _int(part[1]), F.length(part[2]) == 4
            swap = long & (a > 12) & (b <= 12)
            month, day = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
            return (long | (F.length(part[2]) == 2)) & month.between(1, 12) & day.between(1, 31)
        name, day = F.regexp_extract(token, "[A-Za-z]{3}", 0), _int(F.regexp_extract(token, r"\d+", 0))
        return month_number(name).isNotNull() & day.between(1, 31)

    def hits(order: int, pattern: str) -> Column:
        found = F.regexp_extract_all(line, F.lit(pattern if order == 2 else rf"(?<![.,\d]){pattern}"), F.lit(0))
        return F.transform(
            F.filter(found, lambda t: sound(order, t)),
            lambda t: F.struct(F.position(t, line).alias("at"), F.lit(order).alias("order"), t.alias("token")),
        )

    # most lines begin with such a token or hold no digit; a pattern is tried only where what it needs is in the line
    front, none = rf"^\s*({DATE_PATTERNS[0]})", F.array().cast("array<struct<at:int,order:int,token:string>>")
    needs = [r"\d[/-]\d", r"\d[/-]\d", rf"(?i){'|'.join(MONTHS)}", rf"(?i){'|'.join(MONTHS)}"]
    every = F.concat(*[F.when(line.rlike(needs[k]), hits(k, p)).otherwise(none) for k, p in enumerate(DATE_PATTERNS)])
    return F.when(line.rlike(front), F.regexp_extract(line, front, 1)).when(line.rlike("[0-9]"), F.array_min(every)["token"])
