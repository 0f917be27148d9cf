"""Scalar functions on single values, quirks included."""

import pytest
from ledgerweave.functions import dates, money, text
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "cents"),
    [
        ("$1,234.56", [123456]),
        ("-$84.20 and (84.20) and 84.20-", [-8420, -8420, -8420]),
        ("20.99% of 2024, ref 12345", []),
        ("1,000 points", [100000]),
        ("2024-05-02 Shop 214 -84.20", [-8420]),
        ("84.2012", []),
        ("", []),
    ],
)
def test_money_values(spark, line, cents):
    assert value(spark, money.money_values(F.lit(line))) == cents


@pytest.mark.parametrize(("x", "cents"), [(-0.025, -2), (0.025, 3), (1.005, 100), (-1.5, -150), (2.675, 268)])
def test_cents_round_halves_up(spark, x, cents):
    assert value(spark, money.cents(F.lit(x))) == cents


@pytest.mark.parametrize(
    ("token", "date"),
    [
        ("2026/5/2", "2026-05-02"), ("2026-02-30", "2026-02-30"), ("23/01/2026", "2026-01-23"), ("13/13/2026", None), ("05/02/26", "2026-05-02"), ("23/01/26", None),
        ("May 2", "2024-05-02"), ("Sept. 14", "2024-09-14"), ("14 January", "2024-01-14"), ("Foo 3", None), ("May 32", None), ("x", None),
    ],
)
def test_normalize_date(spark, token, date):
    assert value(spark, dates.normalize_date(F.lit(token), F.lit(2024))) == date


def test_date_without_year(spark):
    assert value(spark, dates.normalize_date(F.lit("Jan. 4"))) == "01-04"


@pytest.mark.parametrize(
    ("line", "token"),
    [("Deposit 16,336.25 JAN 2 27,094.52", "JAN 2"), ("ref 10/11/123 on 3/4/24", "3/4/24"), ("nothing here", None), ("5 May and 2024-01-02", "5 May")],
)
def test_find_date(spark, line, token):
    assert value(spark, dates.find_date(F.lit(line))) == token


def test_card_amount_prefers_dollars_and_reads_cr(spark):
    assert value(spark, money.card_amount(F.lit("SHOP 12.00 -$150.00"))).asDict() == {"cents": -15000, "credit": True}
    assert value(spark, money.card_amount(F.lit("SHOP 12.00 CR"))).asDict() == {"cents": 1200, "credit": True}
    assert value(spark, money.card_amount(F.lit("SHOP"))) is None


def test_amount_line_needs_a_sign_of_money(spark):
    assert value(spark, money.amount_line(F.lit(" -$150.00 "))) == -15000
    assert value(spark, money.amount_line(F.lit("(25.25)"))) == -2525
    assert value(spark, money.amount_line(F.lit("214"))) is None


def test_fee_formula(spark):
    line = "Electronic transaction fee 1 Dr @ 0.75 / 1 Cr @ 0.75"
    assert value(spark, money.fee_total(F.lit(line))) == 150
    assert value(spark, text.strip_fee_formula(F.lit(line))) == "Electronic transaction fee"
    assert value(spark, money.fee_total(F.lit("1 @ 5.00"))) is None


def test_categories_need_enough_merchant(spark):
    part = lambda s, allow: value(spark, text.split_category(F.lit(s), allow)).asDict()
    assert part("JOEY RESTAURANTS", True)["category"] == ""
    assert part("Joey Toronto Restaurants", True) == {"description": "Joey Toronto", "category": "Restaurants"}
    assert part("Joey Toronto Restaurants", False)["category"] == ""
    assert part("Shop retail and grocery", False)["description"] == "Shop"


def test_null_text_gives_null_or_empty(spark):
    nothing = F.lit(None).cast("string")
    assert value(spark, money.money_values(nothing)) is None
    assert value(spark, dates.find_date(nothing)) is None
    assert value(spark, text.is_aggregate(nothing)) is False
