"""Money as integer cents: conversion, presence, display, and scanning text for amounts. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an amount looks like. Groups: 1 opening parenthesis, 2 minus, 3 dollar, 4 character before the digits,
# 5 digits, 6 decimals, 7 digit or percent after, 8 closing minus, 9 closing parenthesis.
AMOUNT = r"(\()?\s*(-)?\s*(\$)?\s*(?<=((?:^|.)))(\d{1,3}(?:,\d{3})+|\d+)(\.\d{2})?(?=([\d%]?))(-)?\s*(\))?"
DOLLAR_AMOUNT = r"(-)?\(?\$\s?(\d{1,3}(?:,\d{3})*|\d+)(\.\d{2})?(\))?"
AMOUNT_LINE = r"^\(?\s*(-)?\s*(\$)?\s*(\d{1,3}(?:,\d{3})*|\d+)(\.\d{2})?\s*(-)?\)?$"
#: File-size estimate: bytes of one page.
PAGE_BYTES = 45 * 1024


def cents(amount: Column) -> Column:
    """Whole cents of a decimal amount; halves go up, also below zero."""
    return F.floor(amount * 100 + 0.5).cast("long")


def has_amount(c: Column) -> Column:
    """Whether a side holds a real amount: zero counts as empty."""
    return F.coalesce(c != 0, F.lit(False))


def normalize_money(c: Column) -> Column:
    return F.when(has_amount(c), c)


def derive_amount(debit: Column, credit: Column) -> Column:
    """Signed amount: debits negative; null if both sides or neither are filled."""
    return F.when(has_amount(debit) & ~has_amount(credit), -debit).when(has_amount(credit) & ~has_amount(debit), credit)


def money_string(c: Column) -> Column:
    """Two decimals from cents, without grouping."""
    whole, part = F.floor(F.abs(c) / 100).cast("long"), F.abs(c) % 100
    return F.concat(F.when(c < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 2, "0"))


def format_money(c: Column) -> Column:
    """-$1,234.56; a dash for null."""
    whole, part = F.floor(F.abs(c) / 100).cast("long"), F.abs(c) % 100
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(whole, 0), F.lit("."), F.lpad(part.cast("string"), 2, "0"))
    return F.coalesce(text, F.lit("—"))


def format_bytes(n: Column) -> Column:
    kb = F.floor((n + 512) / 1024).cast("long")
    tenths = F.floor((n * 10 + 524288) / 1048576).cast("long")
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(mb)


def estimate_pages(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / PAGE_BYTES + 0.5).cast("long"))


def _digits_to_cents(digits: Column, decimals: Column) -> Column:
    whole = F.translate(digits, ",", "").try_cast("long") * 100
    return whole + F.coalesce(F.translate(decimals, ".", "").try_cast("long"), F.lit(0))


def scan_money(text: Column, require_dollar: bool = False) -> Column:
    """Array of the amounts in a line, in order, as struct(cents, text, dollar, negative).

    An amount needs a dollar sign, two decimals or a thousands comma; percentages and parts of longer digit runs are none.
    Negative by parentheses or by a minus on either side, which a zero shows too. One pass marks each match with its groups, which are then cut out.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "  "), AMOUNT, "\x01" + "\x02".join(f"${k}" for k in range(10)) + "\x01")
    parts = F.filter(F.split(marked, "\x01"), lambda p: F.contains(p, F.lit("\x02")))
    groups = F.transform(parts, lambda p: F.split(p, "\x02"))

    def money(g: Column) -> Column:
        signal = (g[3] != "") if require_dollar else (g[3] != "") | (g[6] != "") | F.contains(g[5], F.lit(","))
        return signal & (g[7] == "") & ~g[4].rlike("[0-9]")

    def value(g: Column) -> Column:
        amount = _digits_to_cents(g[5], g[6])
        negative = ((g[1] != "") & (g[9] != "")) | (g[2] != "") | (g[8] != "")
        return F.struct(F.when(negative, -amount).otherwise(amount).alias("cents"), g[0].alias("text"), (g[3] != "").alias("dollar"), negative.alias("negative"))

    none = F.array().cast("array<struct<cents:bigint,text:string,dollar:boolean,negative:boolean>>")
    return F.when(text.rlike("[0-9]") & text.rlike("[$.,]"), F.transform(F.filter(groups, money), value)).when(text.isNotNull(), none)


def money_values(text: Column, require_dollar: bool = False) -> Column:
    return F.transform(scan_money(text, require_dollar), lambda m: m["cents"])


def last_of(values: Column) -> Column:
    """Last element, null for an empty array."""
    return F.try_element_at(values, F.lit(-1))


def inline_dollar(text: Column) -> Column:
    """struct(cents, negative) of the last dollar amount of a line; a minus before it or a closing parenthesis makes it negative."""
    at = lambda k: last_of(F.regexp_extract_all(text, F.lit(DOLLAR_AMOUNT), F.lit(k)))
    value, negative = _digits_to_cents(at(2), at(3)), (at(1) != "") | (at(4) != "")
    return F.when(F.contains(text, F.lit("$")) & value.isNotNull(), F.struct(F.when(negative, -value).otherwise(value).alias("cents"), negative.alias("negative")))


def amount_line(line: Column) -> Column:
    """Cents of a line that is one amount and nothing else; a bare whole number is none."""
    t = F.trim(line)
    at = lambda k: F.regexp_extract(t, AMOUNT_LINE, k)
    value = _digits_to_cents(at(3), at(4))
    return F.when(t.rlike(AMOUNT_LINE) & ((at(2) != "") | (at(4) != "")), F.when(minus_line(line), -value).otherwise(value))


def minus_line(line: Column) -> Column:
    """Whether the amount of such a line has a minus or parentheses."""
    t = F.trim(line)
    at = lambda k: F.regexp_extract(t, AMOUNT_LINE, k)
    return (at(1) != "") | (at(5) != "") | t.rlike(r"^\(.*\)$")


def card_amount(rest: Column) -> Column:
    """struct(cents, credit): the dollar amount of a card line's rest, else its last amount; credit if negative or before CR."""
    dollar, last = inline_dollar(rest), last_of(scan_money(rest))
    tail = F.split_part(rest, last["text"], F.lit(-1))
    plain = F.struct(last["cents"].alias("cents"), (last["negative"] | tail.rlike(r"(?i)\bcr\b")).alias("credit"))
    return F.when(dollar.isNotNull(), F.struct(dollar["cents"].alias("cents"), dollar["negative"].alias("credit"))).when(last.isNotNull(), plain)


# Fixed value: a clause of a fee formula, such as "14 Drs @ 1.25": count, side, rate.
FEE_CLAUSE = r"(?i)(\d+)\s*(?:drs?|crs?)\b\s*@\s*\$?\s*(\d+(?:\.\d{1,2})?)"


def fee_total(text: Column) -> Column:
    """Cents of count times rate over the clauses of a fee formula; null without one."""
    counts = F.regexp_extract_all(text, F.lit(FEE_CLAUSE), F.lit(1))
    rates = F.regexp_extract_all(text, F.lit(FEE_CLAUSE), F.lit(2))
    each = F.zip_with(counts, rates, lambda n, r: n.try_cast("long") * cents(r.try_cast("double")))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.contains(text, F.lit("@")) & (F.size(rates) > 0), total)


def estimate_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost in dollars at prices for a million tokens; null where a count is unknown."""
    return (input_tokens * input_price + output_tokens * output_price) / 1_000_000
