"""Positioned pages written from events, four layouts by account, each with what a reader must get past; and the rows to be read back.

0: two sides and a balance, a heading on every page, bare day/month dates, wraps, foreign detail, fees by count and rate.
1: a card's single amount with a category column on odd pages only, whose categories end the wording on the others.
2: amounts and balances under a heading on two lines, then a table of rewards that is none of the account's.
3: amounts and balances without any heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.builders import amount_text
from ..session import materialised
from .derived import transactions

ROWS_A_PAGE, PITCH, TOP = 22, 8.0, 790.0
CATEGORIES = ("Restaurants", "Foreign Currency Transactions", "Home and Office")

#: SQL: pages(statement_id, n, date, description, category, debit_c, credit_c, balance_c), n numbering an account's rows.
PAGES_SQL = f"""
pages AS (
  SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY seq) AS n, date,
    CASE WHEN statement_id % 4 = 0 AND seq % 9 = 4 AND debit_c % 2 = 0 THEN 'Fee for ' || event_type ELSE 'Entry ' || event_type END
      || CASE WHEN statement_id % 4 < 2 AND seq % 5 = 0 THEN CASE WHEN statement_id % 4 = 0 THEN ' of the account' ELSE ' abroad' END ELSE '' END AS description,
    CASE WHEN statement_id % 4 <> 1 THEN '' WHEN ((seq - 1) // {ROWS_A_PAGE}) % 2 = 0 THEN ['{"', '".join(CATEGORIES)}'][seq % 3 + 1] WHEN seq % 5 <> 0 THEN 'Groceries' ELSE '' END AS category,
    debit_c, credit_c, CASE WHEN statement_id % 4 >= 2 OR (statement_id % 4 = 0 AND seq % 3 <> 1) THEN running_c END AS balance_c
  FROM tx WHERE amount_c > 0
)"""


def cell(s: Column | str, x: float) -> Column:
    return F.struct((s if isinstance(s, Column) else F.lit(s)).alias("str"), F.lit(x).alias("x"))


def line(sub: int, *cells: Column) -> Column:
    return F.struct(F.lit(sub).alias("sub"), F.filter(F.array(*cells), lambda c: c["str"].isNotNull()).alias("cells"))


def placed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(text lines, items) of all accounts."""
    c = F.col
    tx = transactions(spark, sf_dir).where("amount_c > 0")
    shape, page = c("statement_id") % 4, F.floor((c("seq") - 1) / ROWS_A_PAGE + 1).cast("int")
    named, odd = F.concat(F.lit("Entry "), "event_type"), page % 2 == 1
    amount, running = amount_text(c("amount_c")), amount_text(c("running_c"))
    fee = (c("seq") % 9 == 4) & (c("debit_c") % 2 == 0)
    half = F.format_string("%d.%02d", F.floor(c("amount_c") / 200), F.floor(c("amount_c") / 2) % 100)
    wrap, foreign = c("seq") % 5 == 0, c("seq") % 7 == 3
    some = lambda when, of: F.when(when, of)
    sides = F.array(
        line(
            0, cell(F.date_format(c("date"), "dd/MM"), 20.0), cell(F.when(F.coalesce(fee, F.lit(False)), F.concat(F.lit("Fee for "), "event_type", F.lit(" 2 Drs @ "), half)).otherwise(named), 90.0),
            cell(F.when(F.coalesce(fee, F.lit(False)), half).when(c("debit_c").isNotNull(), amount), 330.0), cell(some(c("credit_c").isNotNull(), amount), 420.0), cell(some(c("seq") % 3 != 1, running), 510.0),
        ),
        line(1, cell(some(wrap, F.lit("of the account")), 90.0)), line(2, cell(some(foreign, F.lit("1250 JPY")), 90.0)),
    )
    label = F.element_at(F.array(*map(F.lit, CATEGORIES)), (c("seq") % 3 + 1).cast("int"))
    lead, sign = F.when(c("credit_c").isNotNull() & (c("seq") % 2 == 1), "-").otherwise(""), F.when(c("credit_c").isNotNull() & (c("seq") % 2 == 0), " CR").otherwise("")
    card = F.array(
        line(0, cell("date", 20.0), cell(F.when(odd | wrap, named).otherwise(F.concat(named, F.lit(" Groceries"))), 100.0), cell(some(odd, label), 270.0), cell(F.concat(lead, amount, sign), 460.0)),
        line(1, cell(some(wrap, F.lit("abroad")), 100.0)), line(2, cell(some(foreign, F.lit("Foreign currency 12.00 USD @ 1.35")), 100.0)),
    )
    card = F.transform(card, lambda x: F.struct(x["sub"].alias("sub"), F.transform(x["cells"], lambda y: F.struct(F.when(y["str"] == "date", c("date")).otherwise(y["str"]).alias("str"), y["x"].alias("x"))).alias("cells")))
    # without a heading, wording counts as such where it lies nearer to the middle between dates and amounts than to the dates
    plain = F.array(line(0, cell(c("date"), 20.0), cell(some(shape == 2, named), 110.0), cell(some(shape == 3, named), 160.0), cell(amount, 400.0), cell(running, 510.0)))
    body = tx.select("statement_id", page.alias("page"), (c("seq") * 10).alias("pos"), F.explode(F.when(shape == 0, sides).when(shape == 1, card).otherwise(plain)).alias("l"))

    sums = tx.groupBy("statement_id").agg(F.min("opening_c").alias("opening_c"), F.max_by("running_c", "seq").alias("closing_c"), F.max(page).alias("pages"))
    owed = amount_text(c("opening_c") * 2 - c("closing_c"))  # what a card's balance comes to
    opening, closing = amount_text(c("opening_c")), amount_text(c("closing_c"))
    each = sums.withColumn("page", F.explode(F.sequence(F.lit(1), "pages")))
    first, last = c("page") == 1, c("page") == c("pages")
    head = lambda *cells: [cell(some(cond, F.lit(title)), x) for title, x, cond in cells]
    always = F.lit(True)
    top = F.array(
        line(0, cell(F.when(shape == 1, F.concat(F.lit("Previous Balance $"), opening)).otherwise(F.concat(F.lit("Opening Balance $"), opening)), 20.0)),
        line(1, cell(F.when(shape == 1, F.concat(F.lit("New Balance $"), owed)).when(shape == 0, "Statement from our branch, 2024"), 20.0)),
    )
    shown = F.array(
        line(2, cell(some(shape == 0, F.lit("Printed 28/01")), 20.0)),
        line(3, *head(("Date", 20.0, (shape == 2) & first), ("Description", 110.0, (shape == 2) & first))),
        line(
            4, *head(("Date", 20.0, shape < 2), ("Description", 90.0, shape == 0), ("Withdrawals", 330.0, shape == 0), ("Deposits (CAD)", 420.0, shape == 0), ("Balance", 510.0, shape == 0)),
            *head(("Description", 100.0, shape == 1), ("Category", 270.0, (shape == 1) & (c("page") % 2 == 1)), ("Amount ($)", 460.0, shape == 1)),
            *head(("Amount ($)", 400.0, (shape == 2) & first), ("Balance", 510.0, (shape == 2) & first)),
        ),
    )
    foot = F.array(
        line(0, cell(some((shape == 0) | (shape == 2), F.when(last, F.concat(F.lit("Closing Balance $"), closing))), 20.0)),
        line(1, *head(("Date", 20.0, (shape == 2) & last), ("Description", 110.0, (shape == 2) & last), ("Amount", 300.0, (shape == 2) & last))),
        line(2, *head(("2024-01-05", 20.0, (shape == 2) & last), ("Bonus earned", 110.0, (shape == 2) & last), ("1.00", 300.0, (shape == 2) & last))),
        line(3, *head(("2024-01-06", 20.0, (shape == 2) & last), ("Bonus earned", 110.0, (shape == 2) & last), ("2.00", 300.0, (shape == 2) & last))),
        line(4, cell(some(shape == 0, F.concat(F.lit("Page "), c("page").cast("string"), F.lit(" of "), c("pages").cast("string"))), 20.0)),
    )
    frame = lambda of, pos, cond: each.where(cond).select("statement_id", "page", F.lit(pos).cast("int").alias("pos"), F.explode(of).alias("l"))
    every = body.unionByName(frame(top, 0, first)).unionByName(frame(shown, 1, always)).unionByName(frame(foot, 1_000_000_000, always))
    every = every.where(F.size("l.cells") > 0)
    height = F.row_number().over(Window.partitionBy("statement_id", "page").orderBy("pos", "l.sub"))
    number = F.row_number().over(Window.partitionBy("statement_id").orderBy("page", "pos", "l.sub"))
    every = materialised(every.select("statement_id", "page", number.alias("line_no"), (F.lit(TOP) - height * PITCH).alias("y"), "l.cells"), "printed")
    text = every.select("statement_id", "line_no", F.array_join("cells.str", " ").alias("line"))
    items = every.select("statement_id", "page", "line_no", "y", F.posexplode("cells").alias("k", "i"))
    return text, items.select("statement_id", "page", (c("line_no") * 10 + c("k")).cast("int").alias("item_seq"), "i.str", "i.x", "y", (F.length("i.str") * 5.0).cast("double").alias("width"))
