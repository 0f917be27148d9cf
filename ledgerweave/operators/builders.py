"""Row builders: transactions from the lines of bank and card statements.

What a line is (dates, amounts, classes) comes from native columns. Only the walk over a statement's lines, where a line's
meaning depends on those before it, is a Python fold; it holds one statement's running state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dates, money, text
from ..functions import patterns as P
from ..session import growing, materialised
from ..sources.derived import CREDIT_TYPES, TX_SQL, sql, transactions
from .lines import bank_balances, bank_classes, card_balances, card_classes, card_section, scanned
from .segments import sign_rows

#: Rows dated in or after this year are misread. Fixed value.
LAST_YEAR = 2090


def walk(lines: DataFrame, order: str, start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Rows that a walk over each statement's lines emits; step(state, line) -> rows, finish(state) -> rows at its end."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for line in batch.to_pylist():
                if line["statement_id"] != held:
                    if state is not None:
                        out += finish(state)
                    held, state = line["statement_id"], start(line)
                out += step(state, line)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if state is not None and (rest := finish(state)):
            yield pa.RecordBatch.from_pylist(rest, schema=target)

    return lines.repartition("statement_id").sortWithinPartitions("statement_id", order).mapInArrow(run, schema)


# Bank tables


def bank_lines(lines: DataFrame) -> DataFrame:
    """What the bank walk needs to know of each line."""
    line = F.col("line")
    flagged = scanned(lines).withColumns({"fee_c": money.fee_total(line), **bank_classes(line)})
    first = F.try_element_at("scan", F.lit(1))["text"]
    end = F.when(F.col("token").isNotNull(), F.position("token", line) + F.length("token")).otherwise(1)
    at = F.when(F.size("scan") > 0, F.position(first, line)).otherwise(F.length(line) + 1)
    leads = F.col("token").isNotNull() & (F.position("token", line) < at)
    begin = F.when(leads, end).otherwise(1)
    rows = flagged.withColumn("head", text.clean_space(F.substr(line, begin, F.greatest(F.lit(0), at - begin))))
    rates = F.transform(F.regexp_extract_all(line, F.lit(money.FEE_CLAUSE), F.lit(2)), lambda r: money.cents(r.try_cast("double")))
    return rows.select(
        "statement_id", "line_no", "line", *[c for c in ("opening_c",) if c in lines.columns], "starts", "stops", "summary_row", "itemized", "ignored", "fee_c", "head",
        dates.normalize_date(F.col("token"), F.col("year")).alias("date"), leads.alias("leads"), F.when(F.col("token").isNotNull(), text.clean_space(F.substr(line, end, F.length(line)))).alias("tail"),
        F.when(F.col("fee_c").isNotNull(), rates).alias("rates"), F.col("scan.cents").alias("values"), F.col("b").isNotNull().alias("balance"),
        F.when(F.col("head") == "", text.recover_description(line, F.col("token"))).alias("recovered"), F.max(F.col("starts")).over(Window.partitionBy("statement_id")).alias("has_start"),
    )


ENTRY = "statement_id long, line_no int, date string, description string, amount_c long, balance_c long, fee boolean"


def bank_entries(lines: DataFrame) -> DataFrame:
    """Entries of bank tables: date, description, amount and printed balance of each posted row, unsigned.

    The walk begins at the activity heading (at once without one) and ends at closing sections. Dates carry forward, wrapped
    descriptions are joined, rates of a fee formula are no amounts, and dateless summary rows are passed over unless their
    balance continues the running one.
    """

    def start(line: dict) -> dict:
        return {"live": not line["has_start"], "done": False, "date": None, "text": "", "fee": None, "balance": line["opening_c"], "id": line["statement_id"], "at": 0}

    def entry(s: dict, date, description: str, amount: int, balance, fee: bool) -> dict:
        return {"statement_id": s["id"], "line_no": s["at"], "date": date or "", "description": description, "amount_c": amount, "balance_c": balance, "fee": fee}

    def flush_fee(s: dict, date) -> list[dict]:
        made = [entry(s, date, s["text"] or "Service fee", s["fee"], None, True)] if s["fee"] else []
        s["text"], s["fee"] = "", None
        return made

    def continues(s: dict, balance: int, amount: int) -> bool:
        return s["balance"] is not None and abs(balance - s["balance"]) == amount

    def step(s: dict, line: dict) -> list[dict]:
        if s["done"]:
            return []
        s["at"] = line["line_no"]
        if line["stops"]:
            s["done"] = s["live"]
            return []
        if not s["live"]:
            s["live"] = line["starts"]
            return []
        if line["ignored"]:
            s["text"], s["fee"] = "", None
            return []
        if line["balance"]:
            return []
        values, rates = list(line["values"]), list(line["rates"] or [])
        if line["date"] is None and line["summary_row"] and not line["itemized"]:
            if not (len(values) >= 2 and continues(s, values[-1], abs(values[-2]))):
                s["text"], s["fee"] = "", None
                return []
        before, s["date"] = s["date"], line["date"] or s["date"]
        posted = list(values)
        for rate in rates:  # amounts that are rates of a fee formula aren't posted
            if rate in posted:
                posted.remove(rate)
        made = flush_fee(s, before) if posted and line["leads"] and s["fee"] is not None else []
        if values and not posted:
            s["fee"] = (s["fee"] or 0) + (line["fee_c"] or 0)
            piece = line["tail"] if line["leads"] else line["line"].strip()  # with its rates, by which a formula is known as one
            s["text"] = " ".join(x for x in (s["text"], piece) if x)
            return made
        if not posted:
            piece = line["tail"] if line["date"] else line["line"].strip() if s["text"] else ""
            s["text"] = " ".join(x for x in (s["text"], piece) if x)
            return made
        total = (s["fee"] or 0) + (line["fee_c"] or 0) if s["fee"] is not None or line["fee_c"] is not None else None
        description = " ".join(x for x in (s["text"], line["head"]) if x) or line["recovered"]
        amount, balance = (abs(posted[-2]), posted[-1]) if len(posted) >= 2 else (abs(posted[0]), None)
        if total is not None and balance is None and continues(s, posted[0], total):
            amount, balance = total, posted[0]
        s["text"], s["fee"] = "", None
        if (not s["date"] and not description) or (s["date"] or "")[:4] >= str(LAST_YEAR):
            return made
        if balance is not None:
            s["balance"] = balance
        return [*made, entry(s, s["date"], description, amount, balance, total is not None)]

    return walk(bank_lines(lines), "line_no", start, step, lambda s: flush_fee(s, s["date"]), ENTRY)


def bank_rows(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Signed rows of bank statements (lines: statement_id, line_no, line, year): the balances (ends, where they are known) decide the sides."""
    ends = (bank_balances(lines) if ends is None else ends).select("statement_id", "opening_c", "closing_c")
    entries = bank_entries(lines.join(growing(ends.select("statement_id", "opening_c")), "statement_id", "left"))
    low = F.lower("description")
    prior = F.when(F.col("fee"), -1).when(low.rlike(P.BANK_CREDIT_PRIOR), 1).when(low.rlike(P.BANK_DEBIT_PRIOR), -1).otherwise(0)
    entries = entries.withColumns({"seq": F.row_number().over(Window.partitionBy("statement_id").orderBy("line_no", F.desc("fee"))), "prior": prior})
    signed = sign_rows(materialised(entries, "posted"), ends)  # read more than once, and a walk behind it
    clean = text.clean_description(F.when(F.col("fee"), F.coalesce(F.nullif(text.strip_fee_formula(F.col("description")), F.lit("")), F.col("description"))).otherwise(F.col("description")))
    return signed.select(
        "statement_id", "seq", "line_no", "date", clean.alias("description"),
        F.when(~F.col("credit"), F.col("amount_c")).alias("debit_c"), F.when(F.col("credit"), F.col("amount_c")).alias("credit_c"), "balance_c",
        (F.greatest(F.lit(30), 90 - F.when(F.col("date") == "", 10).otherwise(0) - F.when(F.col("description") == "", 20).otherwise(0)) / 100).alias("confidence"), "solved",
    )


# Card statements


def leading(line, prefix: str) -> dict:
    """Month, day and rest of a leading date."""
    g = lambda k: F.regexp_extract(line, dates.LEADING_DATE, k)
    month, day = dates.month_number(g(1)), g(2).try_cast("int")
    sound = month.isNotNull() & day.between(1, 31)
    return {f"{prefix}_month": F.when(sound, month), f"{prefix}_day": F.when(sound, day), f"{prefix}_rest": F.when(sound, g(3))}


def card_lines(lines: DataFrame) -> DataFrame:
    """What the card walk needs to know of each line, its neighbours included."""
    line = F.col("line")
    order = Window.partitionBy("statement_id").orderBy("line_no")
    rows = scanned(lines).withColumns({**card_classes(line), **leading(line, "a")}).withColumns(leading(F.col("a_rest"), "b"))
    rest = F.trim(F.coalesce("b_rest", "a_rest", F.lit("")))
    rows = rows.withColumns(
        {
            "rest": rest,
            "double": F.col("b_month").isNotNull(),
            "section": card_section(line),
            "has_money": F.size("scan") > 0,
            "inline": money.card_amount(rest),
            "alone_c": money.amount_line(line),
            "alone_minus": money.minus_line(line),
            "plain": text.strip_references(line),
            "near": F.max("remittance_near").over(order.rowsBetween(-3, 3)),
            "next_dated": F.coalesce(F.lead("a_month").over(order).isNotNull(), F.lit(False)),
        }
    )
    starts = F.col("double") | (F.col("a_month").isNotNull() & (F.col("rest") == "") & F.col("next_dated"))
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    next_start = F.min(F.when(starts, F.col("line_no"))).over(ahead)
    next_stop = F.min(F.when(F.col("hard_stop"), F.col("line_no"))).over(ahead)
    period = F.col("period")
    inside = F.coalesce(dates.in_period(period, F.col("a_month"), F.col("a_day")), F.lit(True))
    first_amount = F.element_at(money.scan_money(F.col("rest")), -1)["text"]
    head = F.when(F.col("inline").isNull(), F.col("rest")).otherwise(
        F.coalesce(F.nullif(F.regexp_replace("rest", r"-?\(?\$\s?[\d,]+(\.\d{2})?\)?.*$", ""), F.col("rest")), F.split_part(F.col("rest"), first_amount, F.lit(1)))
    )
    return rows.withColumns({"start_ahead": F.coalesce(next_start < F.coalesce(next_stop, F.lit(1 << 30)), F.lit(False)), "inside": inside, "head": text.strip_references(head), "row_year": dates.row_year(period, F.col("a_month"), F.col("year"))})


CARD = "statement_id long, line_no int, date string, description string, amount_c long, credit boolean, section boolean, foreign boolean"
# What the card walk reads of a line.
CARD_LINE = (
    "statement_id", "line_no", "soft_stop", "hard_stop", "ignored", "foreign", "reference", "header", "spend_report", "summary_label", "section", "has_money", "alone_c", "alone_minus", "plain", "near", "next_dated", "start_ahead",
    "a_month", "a_day", "row_year", "double", "rest", "inside", "inline", "head",
)


def card_entries(lines: DataFrame) -> DataFrame:
    """Posted rows of card statements, by a walk that finds a start line (two dates, or one inside a section), its amount on
    that line or on one of the following, and the end of the block.

    Hard stops end a statement; a total balance does so only without a start ahead. Dates outside the period, summary and
    remittance lines make no rows, nor do amounts without wording near a remittance slip. credit is what a row's own sign
    says, section whether it stands in one of credits.
    """

    def start(line: dict) -> dict:
        return {"done": False, "inside": False, "pending": None, "credit": False, "open": None}

    def iso(month: int, day: int, year) -> str:
        return f"{year}-{month:02d}-{day:02d}" if year else f"{month:02d}-{day:02d}"

    def close(s: dict) -> list[dict]:
        block, s["open"] = s["open"], None
        if block is None:
            return []
        amount, minus = block["amount"] if block["amount"] is not None else block["fx_amount"]
        if amount is None:
            return []
        description = " ".join(block["parts"])
        worded = sum(c.isascii() and c.isalpha() for c in description) >= 3
        if not worded and block["near"]:
            return []
        return [{"statement_id": block["id"], "line_no": block["at"], "date": block["date"], "description": description, "amount_c": abs(amount), "credit": minus, "section": block["section"], "foreign": block["fx"]}]

    def step(s: dict, line: dict) -> list[dict]:
        if s["done"]:
            return []
        block, dated = s["open"], line["a_month"] is not None
        if block is not None:  # gathering the amount of an open block
            if line["soft_stop"]:
                return []
            if not (line["hard_stop"] or line["ignored"] or dated):
                if line["foreign"]:
                    block["fx"] = True
                elif line["alone_c"] is not None and block["fx"]:
                    block["fx_amount"] = (line["alone_c"], line["alone_minus"])
                elif line["alone_c"] is not None:
                    block["amount"] = (line["alone_c"], line["alone_minus"])
                    return close(s)
                elif line["reference"]:
                    block["reference"] = True
                elif not block["reference"] and line["plain"]:
                    block["parts"].append(line["plain"])
                return []
        made = close(s)
        if s["inside"] and line["hard_stop"]:
            s["done"] = True
            return made
        if s["inside"] and line["soft_stop"]:
            s["done"] = not line["start_ahead"]
            return made
        if line["header"]:
            s["inside"] = True
            return made
        if not dated:
            if not line["has_money"] and line["section"]:
                s["credit"], s["inside"] = line["section"] == "credit", True
                return made
            if not (line["spend_report"] or line["summary_label"] or line["ignored"]):
                s["pending"] = None
            return made
        if line["ignored"]:
            return made
        if not line["double"] and line["rest"] == "":
            if s["inside"] or line["next_dated"]:
                s["pending"] = line
            return made
        if not line["double"] and not s["inside"] and s["pending"] is None:
            return made
        s["inside"] = True
        when, s["pending"] = s["pending"] or line, None
        if not when["inside"]:
            return made
        inline = line["inline"]
        s["open"] = {
            "id": line["statement_id"], "at": line["line_no"], "date": iso(when["a_month"], when["a_day"], when["row_year"]), "parts": [line["head"]] if line["head"] else [],
            "amount": (inline["cents"], inline["credit"]) if inline else None, "section": s["credit"], "near": line["near"], "fx": False, "fx_amount": (None, False), "reference": False,
        }
        return made + close(s) if inline else made

    return walk(card_lines(lines).select(*CARD_LINE), "line_no", start, step, close, CARD)


def card_rows(lines: DataFrame, use_sections: bool = False) -> DataFrame:
    """Signed rows of card statements (lines: statement_id, line_no, line, year, period)."""
    return card_signed(card_entries(lines), use_sections)


def card_signed(rows: DataFrame, use_sections: bool = False) -> DataFrame:
    """Signed rows of entries; sections count as signs where they are used."""
    description = text.clean_description(F.col("description"))
    credit = F.col("credit") | (F.col("section") & F.lit(use_sections)) | text.card_credit_phrase(description)
    lost = F.when(F.col("foreign"), 5).otherwise(0) + F.when(description == "", 20).otherwise(0) + F.when(F.col("date").rlike(r"^\d{4}-"), 0).otherwise(10)
    return rows.select(
        "statement_id", "line_no", "date", description.alias("description"), F.when(~credit, F.col("amount_c")).alias("debit_c"), F.when(credit, F.col("amount_c")).alias("credit_c"), ((92 - lost) / 100).alias("confidence")
    )


# Statements written from events, and read again


def amount_text(c):
    return F.concat(F.format_number(F.floor(c / 100), 0), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def _stacked(parts: DataFrame) -> DataFrame:
    order = Window.partitionBy("statement_id").orderBy("k", "sub")
    return parts.select("statement_id", F.row_number().over(order).alias("line_no"), "line", F.lit(2024).alias("year"))


def bank_statement(tx: DataFrame) -> DataFrame:
    """Bank statements of transactions: dates and balances on some rows only, wrapped descriptions, a page line, a footer."""
    credit = F.col("event_type").isin(*CREDIT_TYPES)
    word = F.when(credit, "Payroll deposit").otherwise("Card purchase")
    shown = F.when((F.col("seq") % 4 == 1) | (F.col("seq") == 1), F.concat("date", F.lit(" "))).otherwise("")
    tail = F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" "), amount_text(F.col("running_c")))).otherwise("")
    body = F.when((F.col("seq") % 5 == 0) & (F.col("seq") % 4 == 1), F.array(F.concat(shown, word), F.concat(F.lit("at shop "), amount_text(F.col("amount_c")), tail))).otherwise(
        F.array(F.concat(shown, word, F.lit(" at shop "), amount_text(F.col("amount_c")), tail))
    )
    body = F.when(F.col("seq") % 6 == 0, F.concat(body, F.array(F.lit("Page 1 of 9")))).otherwise(body)
    rows = tx.select("statement_id", (F.col("seq") + 10).cast("long").alias("k"), F.posexplode(body).alias("sub", "line"))
    ends = tx.groupBy("statement_id").agg(F.min("opening_c").alias("o"), F.max_by("running_c", "seq").alias("c"))
    head = ends.select("statement_id", F.lit(0).cast("long").alias("k"), F.posexplode(F.array(F.concat(F.lit("Opening balance "), amount_text(F.col("o"))), F.lit("Account activity"))).alias("sub", "line"))
    foot = ends.select("statement_id", F.lit(1 << 40).cast("long").alias("k"), F.posexplode(F.array(F.concat(F.lit("Closing balance "), amount_text(F.col("c"))), F.lit("How to contact us"), F.lit("2024-01-02 Offer 9.99"))).alias("sub", "line"))
    return _stacked(head.unionByName(rows).unionByName(foot))


def card_statement(tx: DataFrame) -> DataFrame:
    """Card statements of transactions: two dates, amounts inline or on a later line, foreign detail, sidebars, slips."""
    credit = F.col("event_type").isin(*CREDIT_TYPES)
    day = F.upper(F.date_format(F.to_date("date"), "MMM dd"))
    dollars = F.concat(F.when(credit, "-$").otherwise("$"), amount_text(F.col("amount_c")))
    first = F.concat(day, F.lit(" "), day, F.lit(" Corner shop"))
    n = F.col("seq")
    body = (
        F.when(n % 4 == 0, F.array(F.concat(first, F.lit(" 7451234567890123 "), dollars)))
        .when(n % 4 == 1, F.array(first, F.lit("7451234567890123"), dollars))
        .when(n % 4 == 2, F.array(F.concat(first, F.lit(" "), dollars), F.lit("Total account balance $1.00"), F.lit("Minimum payment $10.00")))
        .otherwise(F.array(day, F.concat(day, F.lit(" Corner shop "), dollars)))
    )
    rows = tx.select("statement_id", (n + 10).cast("long").alias("k"), F.posexplode(body).alias("sub", "line"))
    ends = tx.groupBy("statement_id").agg(F.min("opening_c").alias("o"), (F.min("opening_c") - F.sum("signed_c")).alias("c"))
    top = F.array(F.lit("STATEMENT FROM JAN 01 TO JAN 31, 2024"), F.concat(F.lit("Previous account balance $"), amount_text(F.col("o"))), F.concat(F.lit("New balance $"), amount_text(F.col("c"))), F.lit("Transaction date Posting date Activity description"))
    head = ends.select("statement_id", F.lit(0).cast("long").alias("k"), F.posexplode(top).alias("sub", "line"))
    foot = ends.select("statement_id", F.lit(1 << 40).cast("long").alias("k"), F.posexplode(F.array(F.lit("Time to pay"), F.lit("JAN 30 JAN 30 Not a row $5.00"))).alias("sub", "line"))
    lines = _stacked(head.unionByName(rows).unionByName(foot))
    period = lines.where("line_no = 1").select("statement_id", dates.statement_period(F.col("line")).alias("period"))
    return lines.join(growing(period), "statement_id")


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = materialised(bank_statement(transactions(spark, sf_dir)), "body")
    return bank_rows(body).select("statement_id", "seq", "date", "description", "debit_c", "credit_c", "balance_c", "solved")


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = card_rows(materialised(card_statement(transactions(spark, sf_dir)), "body"))
    seq = F.row_number().over(Window.partitionBy("statement_id").orderBy("line_no"))
    return rows.select("statement_id", seq.alias("seq"), "date", "description", "debit_c", "credit_c")


def _card_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_balances(card_statement(transactions(spark, sf_dir))).select("statement_id", "opening_c", "closing_c")


def _bank_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_balances(bank_statement(transactions(spark, sf_dir))).select("statement_id", "opening_c", "closing_c")


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import parse_line

    tx = transactions(spark, sf_dir)
    word = F.when(F.col("event_type").isin(*CREDIT_TYPES), "Payroll deposit").when(F.col("event_type") == "view", "Something").otherwise("Card purchase")
    tail = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" "), amount_text(F.col("running_c")))).otherwise("")
    lines = tx.select("statement_id", F.col("seq").alias("line_no"), F.concat("date", F.lit("  "), word, F.lit(" "), amount_text(F.col("amount_c")), tail).alias("line"))
    return parse_line(lines)


QUERIES = {
    "bank_table_roundtrip": (
        _bank,
        sql(TX_SQL, select="""
, d AS (SELECT *, last_value(CASE WHEN seq % 4 = 1 THEN date END IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM tx)
SELECT statement_id, seq, shown AS date, CASE WHEN credit_c IS NOT NULL THEN 'Payroll deposit' ELSE 'Card purchase' END || ' at shop' AS description, debit_c, credit_c,
  CASE WHEN seq % 3 = 0 THEN running_c END AS balance_c, TRUE AS solved FROM d"""),
    ),
    "cc_parse_roundtrip": (
        _card,
        sql(TX_SQL, select="SELECT statement_id, seq, date, 'Corner shop' AS description, debit_c, credit_c FROM tx"),
    ),
    "card_balance_roundtrip": (_card_ends, sql(TX_SQL, select="SELECT statement_id, min(opening_c) AS opening_c, CAST(min(opening_c) - sum(signed_c) AS BIGINT) AS closing_c FROM tx GROUP BY statement_id")),
    "bank_balance_roundtrip": (_bank_ends, sql(TX_SQL, select="SELECT statement_id, min(opening_c) AS opening_c, arg_max(running_c, seq) AS closing_c FROM tx GROUP BY statement_id")),
    "fallback_parse_roundtrip": (
        _fallback,
        sql(TX_SQL, select="""
SELECT statement_id, seq AS line_no, date, CASE WHEN credit_c IS NOT NULL THEN 'Payroll deposit' WHEN event_type = 'view' THEN 'Something' ELSE 'Card purchase' END AS description,
  debit_c, credit_c, CASE WHEN seq % 2 = 0 THEN running_c END AS balance_c, CASE WHEN event_type = 'view' THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM tx"""),
    ),
}
