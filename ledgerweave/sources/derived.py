"""Statement-shaped tables derived from the given ones, each with the SQL that derives the same rows.

A user of events is an account: its events are transactions, dated and valued by the event, credits for two of the five
types. Printed balances are the running sums; lines of text are written from events by a table of line shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..session import table

CREDIT_TYPES = ("purchase", "signup")

#: SQL: tx(statement_id, row_no, seq, date, event_type, amount_c, debit_c, credit_c, signed_c, opening_c, running_c)
TX_SQL = """
e AS (
  SELECT user_id AS statement_id, event_id AS row_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS seq,
         strftime(ts, '%Y-%m-%d') AS date, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount_c
  FROM events
), tx0 AS (
  SELECT *, CASE WHEN event_type NOT IN ('purchase', 'signup') THEN amount_c END AS debit_c,
         CASE WHEN event_type IN ('purchase', 'signup') THEN amount_c END AS credit_c,
         CASE WHEN event_type IN ('purchase', 'signup') THEN amount_c ELSE -amount_c END AS signed_c,
         CAST(5000000 + statement_id * 1000 AS BIGINT) AS opening_c
  FROM e
), tx AS (
  SELECT *, opening_c + CAST(sum(signed_c) OVER (PARTITION BY statement_id ORDER BY seq) AS BIGINT) AS running_c FROM tx0
)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, in order of event_id within a user; see TX_SQL."""
    by_user = Window.partitionBy("statement_id").orderBy("row_no")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("statement_id"),
        F.col("event_id").alias("row_no"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        "event_type",
        cents(F.col("value")).alias("amount_c"),
    )
    credit = F.col("event_type").isin(*CREDIT_TYPES)
    rows = rows.withColumns(
        {
            "seq": F.row_number().over(by_user),
            "debit_c": F.when(~credit, F.col("amount_c")),
            "credit_c": F.when(credit, F.col("amount_c")),
            "signed_c": F.when(credit, F.col("amount_c")).otherwise(-F.col("amount_c")),
            "opening_c": F.lit(5000000).cast("long") + F.col("statement_id") * 1000,
        }
    )
    return rows.withColumn("running_c", F.col("opening_c") + F.sum("signed_c").over(by_user))


#: SQL: head(statement_id, mode, opening_c, closing_c, sum_credits_c, sum_debits_c): the printed figures of each account.
#: Some accounts miss the closing balance, print one that is off, or print summary totals that are off.
HEAD_SQL = """
head AS (
  SELECT statement_id, CASE WHEN statement_id % 4 = 3 THEN 'credit-card' ELSE 'bank-account' END AS mode,
         CASE WHEN statement_id % 11 <> 0 THEN min(opening_c) END AS opening_c,
         CASE WHEN statement_id % 7 <> 0 THEN CAST(min(opening_c)
           + CASE WHEN statement_id % 4 = 3 THEN -1 ELSE 1 END * sum(signed_c)
           + CASE statement_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2500 ELSE 0 END AS BIGINT) END AS closing_c,
         CASE WHEN statement_id % 3 = 0 THEN CAST(sum(credit_c) AS BIGINT) WHEN statement_id % 3 = 1 THEN CAST(sum(credit_c) * 2 AS BIGINT) END AS sum_credits_c,
         CASE WHEN statement_id % 3 = 0 THEN CAST(sum(debit_c) + 2 AS BIGINT) END AS sum_debits_c
  FROM tx GROUP BY statement_id
)"""


def headers(tx: DataFrame) -> DataFrame:
    """The printed figures of each account of transactions(); see HEAD_SQL."""
    s = F.col("statement_id")
    sums = tx.groupBy("statement_id").agg(
        F.min("opening_c").alias("o"), F.sum("signed_c").alias("n"), F.sum("credit_c").alias("c"), F.sum("debit_c").alias("d")
    )
    off = F.when(s % 5 == 0, 1).when(s % 5 == 1, 2500).otherwise(0)
    card = s % 4 == 3
    return sums.select(
        "statement_id",
        F.when(card, "credit-card").otherwise("bank-account").alias("mode"),
        F.when(s % 11 != 0, F.col("o")).alias("opening_c"),
        F.when(s % 7 != 0, F.col("o") + F.when(card, -F.col("n")).otherwise(F.col("n")) + off).alias("closing_c"),
        F.when(s % 3 == 0, F.col("c")).when(s % 3 == 1, F.col("c") * 2).alias("sum_credits_c"),
        F.when(s % 3 == 0, F.col("d") + 2).alias("sum_debits_c"),
    )


#: Line shapes: {d} is the date, {a} the amount, {n} the event's number. Own wording, one shape per kind of line.
SHAPES = (
    "{d} Coffee at the corner {a}",
    "{d} Payroll deposit {a} {a}",
    "Opening balance {a}",
    "Closing balance on {d} ${a}",
    "Account activity for {n}",
    "Trans date Post date Activity description",
    "Minimum payment ${a} due {d}",
    "Your payments",
    "Your new charges and credits",
    "Rewards summary {n} points",
    "Total account balance ${a}",
    "Foreign currency 12.00 USD @ 1.357",
    "Total deposits {a}",
    "Cheque - {n}122 {a} {a}",
    "Account number 00{n}-99",
    "How to contact us about account {n}",
    "Regular transaction fee 2 Drs @ 1.25 {a}",
    "e-Transfer sent CA00{n}9ABC45 to Robin {a}",
    "Date Description Category Amount",
    "Previous balance {a}",
    "Important account information and terms and conditions",
    "   Grocery   store    groceries  ",
    "Total interest for this period ${a}",
    "MasterCard purchase 451234567890{n} refund -${a}",
    "Balance forward {a}",
    "VISA credit card new balance ${a}",
    "Interest charged on purchases 20.99%",
    "{d} ATM withdrawal {a} -",
    "Statement from APR 24 to MAY 25, 2026",
    "Reference 123456789012345 from {d} to {d}, 2026",
    "Interest paid {a} rebate",
    "Gift certificate ({a})",
)
PAGE_LINES = 8

LINES_SQL = (
    """
shapes AS (SELECT * FROM (VALUES """
    + ", ".join(f"({k}, '{s.replace(chr(39), chr(39) * 2)}')" for k, s in enumerate(SHAPES))
    + f""") v(shape, form)), lines AS (
  SELECT statement_id, seq AS line_no, (seq - 1) // {PAGE_LINES} + 1 AS page, shape,
         amount_c, date,
         replace(replace(replace(form, '{{d}}', date), '{{a}}', format('{{:,}}', amount_c // 100) || '.' || lpad(CAST(amount_c % 100 AS VARCHAR), 2, '0')), '{{n}}', CAST(row_no AS VARCHAR)) AS line
  FROM tx JOIN shapes ON shape = (row_no * 7 + statement_id) % {len(SHAPES)}
)"""
)


def text_lines(tx: DataFrame) -> DataFrame:
    """One line of statement text per event: statement_id, line_no, page, shape, amount_c, date, line; see LINES_SQL."""
    shape = ((F.col("row_no") * 7 + F.col("statement_id")) % len(SHAPES)).cast("int")
    form = F.element_at(F.array(*map(F.lit, SHAPES)), shape + 1)
    amount = F.concat(F.format_number(F.floor(F.col("amount_c") / 100), 0), F.lit("."), F.lpad((F.col("amount_c") % 100).cast("string"), 2, "0"))
    line = F.replace(F.replace(F.replace(form, F.lit("{d}"), F.col("date")), F.lit("{a}"), amount), F.lit("{n}"), F.col("row_no").cast("string"))
    return tx.select(
        "statement_id",
        F.col("seq").alias("line_no"),
        F.floor((F.col("seq") - 1) / PAGE_LINES + 1).cast("int").alias("page"),
        shape.alias("shape"),
        "amount_c",
        "date",
        line.alias("line"),
    )


def sql(*parts: str, select: str) -> str:
    """One statement of the named parts and a closing select, which may start with more parts after a comma."""
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n" + select.strip()
