"""Descriptions and labels of statement lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that statements share.
CREDIT_WORDS = ["deposit", "credit", "payroll", "refund", "interest", "e-transfer received", "transfer in", "reversal", "rebate", "cashback"]
DEBIT_WORDS = ["purchase", "payment", "withdrawal", "pos", "fee", "debit", "pre-auth", "bill", "atm", "transfer out", "cheque", "check"]
PAYMENT_PHRASES = ["payment - thank you", "paiement - merci", "payment received", "online payment"]
REFUND_PHRASES = ["refund", "reversal", "returned purchase", "credit adjustment", "merchant credit", "cashback", "rebate"]
SPEND_CATEGORIES = [
    "retail and grocery",
    "health and education",
    "professional and financial services",
    "professional and financial",
    "personal and household expenses",
    "personal and household",
    "hotel, entertainment and recreation",
    "hotel entertainment and recreation",
    "entertainment and recreation",
    "home and office improvement",
    "home and office",
    "foreign currency transactions",
    "gas and automotive",
    "recreation and entertainment",
]
AMBIGUOUS_CATEGORIES = ["restaurants", "transportation", "transport", "groceries", "merchandise", "healthcare"]
TRANSFER = r"(?i)e-?transfer|interac|autodeposit|online (?:transfer|banking)(?: payment)?|transfer (?:sent|received|in|out)"
LEADING_MARKS = r"(?U)^[\sÝ�•·°†‡◦▪●○■□★☆∙*]+"
AGGREGATE = (
    r"(?i)\bsummary\b|sub-?total|total (?:debits?|credits?|purchases?|payments?|charges?|fees?|interest)\b|aggregate|net (?:purchases|charges)|balance summary"
    r"|remaining (?:balance|charges|purchases)|purchases?\s*(?:&|and|\/|\\)?\s*charges|charges?\s*(?:&|and|\/|\\)?\s*purchases"
)
PLACEHOLDER = (
    r"(?i)\bunspecified\b|missing transactions?|placeholder|other charges|\bvarious\b|miscellaneous|to be determined|\btbd\b|\bn\/a\b|reconcil"
)


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def clean_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")


def clean_description(text: Column) -> Column:
    """Single spaces, no decorative marks in front."""
    return clean_space(F.regexp_replace(clean_space(text), LEADING_MARKS, ""))


def recover_description(line: Column, date: Column) -> Column:
    """What a line says besides its date token and its amounts; empty without a word."""
    s = F.when(date.isNull() | (date == ""), line).otherwise(F.replace(line, date, F.lit(" ")))
    s = F.regexp_replace(s, r"\(?-?\$?\s*\d{1,3}(?:,\d{3})+(?:\.\d{2})?\)?-?", " ")
    s = clean_space(F.regexp_replace(s, r"\(?-?\$?\s*\d+\.\d{2}\)?-?", " "))
    return F.when(s.rlike("[A-Za-z]{2,}"), clean_description(s)).otherwise("")


def split_category(text: Column, allow_ambiguous: Column | bool = False) -> Column:
    """struct(description, category): a spend category at the end, taken off where enough of a merchant remains."""
    allow = F.lit(allow_ambiguous) if isinstance(allow_ambiguous, bool) else allow_ambiguous

    def cut(labels: list[str]) -> Column:
        pattern = r"(?i)\s+(" + "|".join(labels) + r")\s*$"
        return F.struct(F.trim(F.regexp_replace(text, pattern, "")).alias("head"), F.regexp_extract(text, pattern, 1).alias("label"))

    part = F.when(allow, cut(SPEND_CATEGORIES + AMBIGUOUS_CATEGORIES)).otherwise(cut(SPEND_CATEGORIES))
    short = F.lower(part["label"]).isin(AMBIGUOUS_CATEGORIES) & (F.size(F.split(part["head"], r"\s+")) < 2)
    good = (part["label"] != "") & (F.length(part["head"]) >= 3) & part["head"].rlike("[A-Za-z]{2,}") & ~short
    return F.when(good, F.struct(part["head"].alias("description"), part["label"].alias("category"))).otherwise(F.struct(text.alias("description"), F.lit("").alias("category")))


def is_reference_token(token: Column) -> Column:
    """A confirmation code (letters with two digits or more) or a long number."""
    t = F.regexp_replace(token, r"^[#:*-]+|[#:*-]+$", "")
    letters, digits = t.rlike("[A-Za-z]"), F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (F.length(t) >= 8) & F.when(letters, (digits >= 2) & t.rlike("^[A-Za-z0-9]+$")).otherwise(digits >= 12)


def normalize_transfer(text: Column) -> Column:
    """struct(description, removed): a transfer's wording without reference codes, if a word remains."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    kept = F.filter(tokens, lambda t: ~is_reference_token(t))
    cleaned = clean_description(F.array_join(kept, " "))
    changed = text.rlike(TRANSFER) & (F.size(kept) < F.size(tokens)) & cleaned.rlike("[A-Za-z]{2,}")
    return F.struct(F.when(changed, cleaned).otherwise(text).alias("description"), F.coalesce(changed, F.lit(False)).alias("removed"))


def strip_references(text: Column) -> Column:
    """Without runs of ten digits or more, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b\d{10,}\b", " "), r"\s+", " "))


def strip_fee_formula(text: Column) -> Column:
    """Without the clauses of a fee formula and the marks between them."""
    s = F.regexp_replace(text, r"(?i)\b\d+\s*(?:drs?|crs?)\b\s*@\s*\$?\s*\d+(?:\.\d{1,2})?", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"@\s*\$?\s*\d+(?:\.\d{1,2})?", " "), r"(?i)\b\d+\s*(?:drs?|crs?)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*[@/]\s*", " "), r"\s{2,}", " "))


def direction_from_words(text: Column) -> Column:
    """credit, debit or null by the first list with a word in the text; credit is tried first."""
    low = F.lower(text)
    return F.when(any_of(low, CREDIT_WORDS), "credit").when(any_of(low, DEBIT_WORDS), "debit")


def card_credit_phrase(description: Column) -> Column:
    low = F.lower(description)
    return any_of(low, PAYMENT_PHRASES) | any_of(low, REFUND_PHRASES)


def is_aggregate(description: Column) -> Column:
    """A summary, a total or a placeholder instead of one transaction."""
    d = F.coalesce(description, F.lit(""))
    return d.rlike(AGGREGATE) | d.rlike(PLACEHOLDER)


def hash_subject(pepper: str, raw: Column) -> Column:
    return F.sha2(F.concat(F.lit(pepper + "|"), raw), 256)


def email_list(text: Column) -> Column:
    """Lower-case addresses of a list separated by commas, semicolons or white space."""
    return F.filter(F.transform(F.split(text, r"[,;\s]+"), lambda e: F.lower(F.trim(e))), lambda e: e != "")


def export_base_name(name: Column) -> Column:
    s = F.regexp_replace(name, r"(?i)\.pdf$", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", "statement").otherwise(s)


def safe_count(x: Column) -> Column:
    """A whole number of at least 0 from untrusted text, else 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.floor(x.try_cast("double")).cast("long"), F.lit(0)))


def safe_code(x: Column) -> Column:
    """An identifier of letters, digits, dash, dot, colon and underscore up to 64 characters, else null."""
    return F.when(x.rlike(r"^[A-Za-z0-9_.:-]{1,64}\z"), x)
