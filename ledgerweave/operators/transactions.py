"""Row-level operators on transactions: amounts, balances, running context, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money
from ..session import table
from ..sources.derived import HEAD_SQL, TX_SQL, headers, sql, transactions

#: Rows below this confidence are doubtful. Fixed value.
LOW_CONFIDENCE = 0.7


def ordered(partition: str = "statement_id", order: str = "seq"):
    return Window.partitionBy(partition).orderBy(order)


def reconcile(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The balance check of each statement: totals, expected closing, difference, and whether it passes to the cent.

    Bank accounts: opening + credits - debits; cards: opening + debits - credits. A missing balance leaves the check
    unavailable.
    """
    sums = rows.groupBy("statement_id").agg(
        F.coalesce(F.sum("credit_c"), F.lit(0)).alias("total_credits_c"),
        F.coalesce(F.sum("debit_c"), F.lit(0)).alias("total_debits_c"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    out = heads.join(sums, "statement_id", "left").fillna(0, ["total_credits_c", "total_debits_c", "n_rows"])
    net = F.col("total_credits_c") - F.col("total_debits_c")
    out = out.withColumn("expected_c", F.col("opening_c") + F.when(F.col("mode") == "credit-card", -net).otherwise(net))
    out = out.withColumn("difference_c", F.col("expected_c") - F.col("closing_c"))
    return out.withColumns(
        {
            "available": F.col("opening_c").isNotNull() & F.col("closing_c").isNotNull(),
            "passed": F.coalesce(F.col("difference_c") == 0, F.lit(False)),
        }
    )


def balance_status(available, passed, validation=None):
    """passed, review or limited; a validation that needs review beats the arithmetic."""
    validation = F.lit(None).cast("string") if validation is None else validation
    return (
        F.when(validation == "needs-review", "review").when(~available | (F.coalesce(validation, F.lit("")) == "limited"), "limited").when(passed, "passed").otherwise("review")
    )


def reconcile_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    out = reconcile(tx, headers(tx))
    return out.select(
        "statement_id", "mode", "total_credits_c", "total_debits_c", "expected_c", "closing_c", "difference_c", "passed",
        balance_status(F.col("available"), F.col("passed")).alias("status"),
    )


RECONCILED = """
rec AS (
  SELECT h.*, t.total_credits_c, t.total_debits_c, t.n_rows,
         opening_c + CASE WHEN mode = 'credit-card' THEN total_debits_c - total_credits_c ELSE total_credits_c - total_debits_c END AS expected_c
  FROM head h JOIN (SELECT statement_id, CAST(coalesce(sum(credit_c), 0) AS BIGINT) AS total_credits_c,
                           CAST(coalesce(sum(debit_c), 0) AS BIGINT) AS total_debits_c, count(*) AS n_rows FROM tx GROUP BY statement_id) t USING (statement_id)
)"""


def carry_forward(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Empty dates filled with the last date before them in the statement; inherited tells which were."""
    past = ordered(order=order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.trim("date") != "", F.col("date"))
    filled = F.coalesce(F.last(own, ignorenulls=True).over(past), F.lit(""))
    return rows.withColumn("inherited", own.isNull() & (filled != "")).withColumn("date", filled)


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions whose date is printed on every third row only."""
    return transactions(spark, sf_dir).withColumn("date", F.when(F.col("row_no") % 3 == 0, F.col("date")).otherwise(""))


def with_printed_balance(tx: DataFrame) -> DataFrame:
    """balance_c on every third row only."""
    return tx.withColumn("balance_c", F.when(F.col("seq") % 3 == 0, F.col("running_c")))


PRINTED = "pb AS (SELECT *, CASE WHEN seq % 3 = 0 THEN running_c END AS balance_c FROM tx)"


def previous_balance(opening: str = "opening_c"):
    """The last printed balance before a row, seeded with the opening balance."""
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last("balance_c", ignorenulls=True).over(before), F.col(opening))


def delta_direction(rows: DataFrame) -> DataFrame:
    """direction of rows with a printed balance: credit where it rose above the one before."""
    before = previous_balance()
    return rows.withColumn("direction", F.when(F.col("balance_c") > before, "credit").when(F.col("balance_c").isNotNull(), "debit"))


def fee_continuity(rows: DataFrame) -> DataFrame:
    """continues: the printed balance is the one before plus or minus this row's amount."""
    before = previous_balance()
    return rows.withColumn("continues", F.coalesce(F.abs(F.col("balance_c") - before) == F.col("amount_c"), F.lit(False)))


def near_flag(rows: DataFrame, flag, reach: int = 3) -> DataFrame:
    """near: whether any row within reach rows on either side carries the flag."""
    return rows.withColumn("near", F.max(flag).over(ordered().rowsBetween(-reach, reach)))


def closing_from_rows(rows: DataFrame) -> DataFrame:
    """The last printed balance of each statement."""
    return rows.groupBy("statement_id").agg(F.max_by("balance_c", F.when(F.col("balance_c").isNotNull(), F.col("seq"))).alias("closing_c"))


def warnings_of(rows: DataFrame) -> DataFrame:
    """warnings (in display order) and severity: none, minor (doubt or the row's own note alone) or material."""
    debit, credit = money.has_amount(F.col("debit_c")), money.has_amount(F.col("credit_c"))
    low = F.lit("Low confidence — please review.")
    texts = [
        F.when(F.trim("date") == "", "Missing date."),
        F.when(F.trim("description") == "", "Missing description."),
        F.when(debit & credit, "Debit and credit cannot both be filled."),
        F.when(~debit & ~credit, "Add a debit or credit amount."),
        F.when(F.coalesce(F.col("debit_c") < 0, F.lit(False)) | F.coalesce(F.col("credit_c") < 0, F.lit(False)), "Money values cannot be negative."),
        F.when(F.col("confidence") < LOW_CONFIDENCE, low),
        F.when(F.coalesce("warning", F.lit("")) != "", F.col("warning")),
    ]
    rows = rows.withColumn("warnings", F.filter(F.array(*texts), lambda w: w.isNotNull()))
    note = F.coalesce("warning", F.lit(""))
    hard = F.exists("warnings", lambda w: (w != low) & (w != note))
    return rows.withColumn("severity", F.when(F.size("warnings") == 0, "none").when(hard, "material").otherwise("minor"))


def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the faults that rows can have, spread over them."""
    n = F.col("row_no")
    tx = transactions(spark, sf_dir)
    return tx.select(
        "statement_id", "row_no", "seq",
        F.when(n % 13 == 0, "").otherwise(F.col("date")).alias("date"),
        F.when(n % 17 == 0, "").when(n % 29 == 0, "Sub-total of purchases").otherwise(F.col("event_type")).alias("description"),
        F.when(n % 19 == 0, F.col("amount_c")).when(n % 23 == 0, F.lit(None)).when(n % 31 == 0, -F.col("amount_c")).otherwise(F.col("debit_c")).cast("long").alias("debit_c"),
        F.when(n % 19 == 0, F.col("amount_c")).when(n % 23 == 0, F.lit(None)).when(n % 37 == 0, F.lit(0)).otherwise(F.col("credit_c")).cast("long").alias("credit_c"),
        F.when(n % 7 == 0, 0.6).otherwise(0.9).alias("confidence"),
        F.when(n % 41 == 0, "Year was not found on this line.").alias("warning"),
    )


EDITED = """
ed AS (
  SELECT statement_id, row_no, seq, CASE WHEN row_no % 13 = 0 THEN '' ELSE date END AS date,
         CASE WHEN row_no % 17 = 0 THEN '' WHEN row_no % 29 = 0 THEN 'Sub-total of purchases' ELSE event_type END AS description,
         CASE WHEN row_no % 19 = 0 THEN amount_c WHEN row_no % 23 = 0 THEN NULL WHEN row_no % 31 = 0 THEN -amount_c ELSE debit_c END AS debit_c,
         CASE WHEN row_no % 19 = 0 THEN amount_c WHEN row_no % 23 = 0 THEN NULL WHEN row_no % 37 = 0 THEN 0 ELSE credit_c END AS credit_c,
         CASE WHEN row_no % 7 = 0 THEN 0.6 ELSE 0.9 END AS confidence,
         CASE WHEN row_no % 41 = 0 THEN 'Year was not found on this line.' END AS warning
  FROM tx
), wr AS (
  SELECT *, list_filter([
    CASE WHEN trim(date) = '' THEN 'Missing date.' END, CASE WHEN trim(description) = '' THEN 'Missing description.' END,
    CASE WHEN coalesce(debit_c, 0) <> 0 AND coalesce(credit_c, 0) <> 0 THEN 'Debit and credit cannot both be filled.' END,
    CASE WHEN coalesce(debit_c, 0) = 0 AND coalesce(credit_c, 0) = 0 THEN 'Add a debit or credit amount.' END,
    CASE WHEN coalesce(debit_c, 0) < 0 OR coalesce(credit_c, 0) < 0 THEN 'Money values cannot be negative.' END,
    CASE WHEN confidence < 0.7 THEN 'Low confidence — please review.' END, warning], lambda w: w IS NOT NULL) AS warnings
  FROM ed
), sv AS (
  SELECT *, CASE WHEN len(warnings) = 0 THEN 'none'
    WHEN len(list_filter(warnings, lambda w: w <> 'Low confidence — please review.' AND w <> coalesce(warning, ''))) > 0 THEN 'material' ELSE 'minor' END AS severity
  FROM wr
)"""


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows after edits (statement_id, row_no, action update or delete, debit_c, credit_c) by key."""
    gone = edits.where("action = 'delete'").select("statement_id", "row_no")
    new = edits.where("action = 'update'").select("statement_id", "row_no", F.col("debit_c").alias("nd"), F.col("credit_c").alias("nc"), F.lit(True).alias("hit"))
    left = rows.join(gone, ["statement_id", "row_no"], "left_anti").join(new, ["statement_id", "row_no"], "left")
    return left.withColumns({"debit_c": F.when(F.col("hit"), F.col("nd")).otherwise(F.col("debit_c")), "credit_c": F.when(F.col("hit"), F.col("nc")).otherwise(F.col("credit_c"))}).drop("nd", "nc", "hit")


def _edit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir).select("statement_id", "row_no", "debit_c", "credit_c")
    edits = tx.where("row_no % 10 in (3, 4)").select(
        "statement_id", "row_no", F.when(F.col("row_no") % 10 == 3, "delete").otherwise("update").alias("action"), F.lit(100).cast("long").alias("debit_c"), F.lit(None).cast("long").alias("credit_c")
    )
    out = apply_edits(tx, edits)
    return out.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("debit_c").alias("debits_c"), F.sum("credit_c").alias("credits_c"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_rows(spark, sf_dir)
    return rows.select(
        "row_no",
        money.normalize_money(F.col("debit_c")).alias("debit_c"),
        money.normalize_money(F.col("credit_c")).alias("credit_c"),
        money.derive_amount(F.col("debit_c"), F.col("credit_c")).alias("amount_c"),
    )


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    c = money.cents(F.col("o_totalprice"))
    return orders.groupBy("o_custkey").agg(F.sum(c).alias("total_c"), F.min(c).alias("least_c"), F.max(c).alias("most_c"), F.count(F.lit(1)).alias("n"))


def _format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = money.cents(F.col("c_acctbal"))
    shown = F.when(F.col("c_custkey") % 50 == 0, F.lit(None)).otherwise(c).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", money.format_money(shown).alias("shown"), money.money_string(c).alias("plain"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * (F.col("doc_id") % 300 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", money.format_bytes(n).alias("size"), money.estimate_pages(n).alias("pages"), (n <= 10 * 1024 * 1024).alias("accepted"))


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 2.5, 10.0), ("view", 0.15, 0.6)], "model string, price_in double, price_out double")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 5000).alias("n_in"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 700).alias("n_out"))
    e = e.join(F.broadcast(prices), "model", "left")  # a fixed price list
    cost = money.estimate_cost(F.col("n_in"), F.col("n_out"), F.coalesce("price_in", F.lit(5.0)), F.coalesce("price_out", F.lit(15.0)))
    return e.select("event_id", F.floor(cost * 1e9 + 0.5).cast("long").alias("nano_usd"))


DOLLARS = "CASE WHEN {c} < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0')"

QUERIES = {
    "reconcile_users": (
        reconcile_users,
        sql(TX_SQL, HEAD_SQL, RECONCILED, select="""
SELECT statement_id, mode, total_credits_c, total_debits_c, expected_c, closing_c, expected_c - closing_c AS difference_c,
       coalesce(expected_c = closing_c, FALSE) AS passed,
       CASE WHEN opening_c IS NULL OR closing_c IS NULL THEN 'limited' WHEN expected_c = closing_c THEN 'passed' ELSE 'review' END AS status
FROM rec"""),
    ),
    "derive_amount": (
        _amounts,
        sql(TX_SQL, EDITED, select="""
SELECT row_no, nullif(debit_c, 0) AS debit_c, nullif(credit_c, 0) AS credit_c,
       CASE WHEN coalesce(debit_c, 0) <> 0 AND coalesce(credit_c, 0) = 0 THEN -debit_c
            WHEN coalesce(credit_c, 0) <> 0 AND coalesce(debit_c, 0) = 0 THEN credit_c END AS amount_c FROM ed"""),
    ),
    "cents_totals": (
        _cents,
        """SELECT o_custkey, CAST(sum(c) AS BIGINT) AS total_c, min(c) AS least_c, max(c) AS most_c, count(*) AS n
FROM (SELECT o_custkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders) GROUP BY o_custkey""",
    ),
    "format_money": (
        _format,
        f"""SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '—' ELSE {DOLLARS.format(c='c')} END AS shown,
       CASE WHEN c < 0 THEN '-' ELSE '' END || CAST(abs(c) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS plain
FROM (SELECT c_custkey, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS c FROM customer)""",
    ),
    "format_bytes": (
        _sizes,
        """SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN CAST((n + 512) // 1024 AS VARCHAR) || ' KB'
       ELSE CAST(((n * 10 + 524288) // 1048576) // 10 AS VARCHAR) || '.' || CAST(((n * 10 + 524288) // 1048576) % 10 AS VARCHAR) || ' MB' END AS size,
       greatest(1, CAST(floor(n / 46080 + 0.5) AS BIGINT)) AS pages, n <= 10485760 AS accepted
FROM (SELECT doc_id, n_chars * (doc_id % 300 + 1) AS n FROM documents)""",
    ),
    "estimate_cost": (
        _cost,
        """SELECT event_id, CAST(floor((event_id % 5000 * CASE event_type WHEN 'click' THEN 2.5::DOUBLE WHEN 'view' THEN 0.15::DOUBLE ELSE 5.0::DOUBLE END
  + CASE WHEN event_id % 9 <> 0 THEN event_id % 700 END * CASE event_type WHEN 'click' THEN 10.0::DOUBLE WHEN 'view' THEN 0.6::DOUBLE ELSE 15.0::DOUBLE END) / 1000000 * 1e9 + 0.5) AS BIGINT) AS nano_usd
FROM events""",
    ),
    "running_balance": (
        lambda s, d: transactions(s, d).select("statement_id", "row_no", "running_c"),
        sql(TX_SQL, select="SELECT statement_id, row_no, running_c FROM tx"),
    ),
    "carry_forward_dates": (
        lambda s, d: carry_forward(_gappy(s, d)).select("row_no", "date", "inherited"),
        sql(TX_SQL, select="""
, g AS (SELECT *, CASE WHEN row_no % 3 = 0 THEN date END AS own FROM tx),
f AS (SELECT row_no, own, last_value(own IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM g)
SELECT row_no, coalesce(v, '') AS date, own IS NULL AND v IS NOT NULL AS inherited FROM f"""),
    ),
    "balance_delta_direction": (
        lambda s, d: delta_direction(with_printed_balance(transactions(s, d))).select("row_no", "direction"),
        sql(TX_SQL, PRINTED, select="""
, f AS (SELECT *, coalesce(last_value(balance_c IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening_c) AS b FROM pb)
SELECT row_no, CASE WHEN balance_c > b THEN 'credit' WHEN balance_c IS NOT NULL THEN 'debit' END AS direction FROM f"""),
    ),
    "running_fee_rows": (
        lambda s, d: fee_continuity(with_printed_balance(transactions(s, d)).withColumn("amount_c", F.when(F.col("seq") % 2 == 0, F.col("amount_c")).otherwise(F.abs(F.col("running_c") - F.col("opening_c"))))).select("row_no", "continues"),
        sql(TX_SQL, PRINTED, select="""
, f AS (SELECT *, CASE WHEN seq % 2 = 0 THEN amount_c ELSE abs(running_c - opening_c) END AS a, coalesce(last_value(balance_c IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening_c) AS b FROM pb)
SELECT row_no, coalesce(abs(balance_c - b) = a, FALSE) AS continues FROM f"""),
    ),
    "context_window_flags": (
        lambda s, d: near_flag(transactions(s, d), F.col("event_type") == "error").select("row_no", "near"),
        sql(TX_SQL, select="SELECT row_no, bool_or(event_type = 'error') OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM tx"),
    ),
    "last_running_balance": (
        lambda s, d: closing_from_rows(with_printed_balance(transactions(s, d))),
        sql(TX_SQL, PRINTED, select="SELECT statement_id, arg_max(balance_c, seq) FILTER (WHERE balance_c IS NOT NULL) AS closing_c FROM pb GROUP BY statement_id"),
    ),
    "row_warnings": (
        lambda s, d: warnings_of(edited_rows(s, d)).select("row_no", F.array_join("warnings", "|").alias("warnings")),
        sql(TX_SQL, EDITED, select="SELECT row_no, array_to_string(warnings, '|') AS warnings FROM wr"),
    ),
    "warning_severity": (
        lambda s, d: warnings_of(edited_rows(s, d)).groupBy("statement_id").agg(
            F.count_if(F.col("severity") == "material").alias("material"), F.count_if(F.col("severity") == "minor").alias("minor"),
            F.count_if(F.size("warnings") > 0).alias("flagged"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"),
        ),
        sql(TX_SQL, EDITED, select="""
SELECT statement_id, count(*) FILTER (WHERE severity = 'material') AS material, count(*) FILTER (WHERE severity = 'minor') AS minor,
       count(*) FILTER (WHERE len(warnings) > 0) AS flagged, count(*) FILTER (WHERE confidence < 0.7) AS low_confidence FROM sv GROUP BY statement_id"""),
    ),
    "parse_counters": (
        lambda s, d: edited_rows(s, d).groupBy("statement_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(money.has_amount(F.col("debit_c"))).alias("debit_rows"), F.count_if(money.has_amount(F.col("credit_c"))).alias("credit_rows"),
            F.count_if(F.col("date") == "").alias("missing_date"), F.count_if((F.col("date") != "") & ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("malformed_date"),
            F.count_if(F.col("description") == "").alias("missing_description"),
        ),
        sql(TX_SQL, EDITED, select="""
SELECT statement_id, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(debit_c, 0) <> 0) AS debit_rows, count(*) FILTER (WHERE coalesce(credit_c, 0) <> 0) AS credit_rows,
       count(*) FILTER (WHERE date = '') AS missing_date, count(*) FILTER (WHERE date <> '' AND NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}')) AS malformed_date,
       count(*) FILTER (WHERE description = '') AS missing_description FROM ed GROUP BY statement_id"""),
    ),
    "row_edits": (
        _edit_query,
        sql(TX_SQL, select="""
SELECT statement_id, count(*) AS n_rows, CAST(sum(CASE WHEN row_no % 10 = 4 THEN 100 ELSE debit_c END) AS BIGINT) AS debits_c,
       CAST(sum(CASE WHEN row_no % 10 = 4 THEN NULL ELSE credit_c END) AS BIGINT) AS credits_c
FROM tx WHERE row_no % 10 <> 3 GROUP BY statement_id"""),
    ),
}
