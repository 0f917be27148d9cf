"""From statement text (and positioned items) to checked transactions: competing readings, one score, one choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import patterns as P
from ..operators import builders, layout, lines, statements, tables
from ..operators.transactions import carry_forward
from ..session import growing, materialised
from ..sources.derived import TX_SQL, sql, transactions
from ..sources.pages import PAGES_SQL, placed_pages

#: Lines that print the statement's period.
PERIOD_LINE = r"(?i)[^\n]*(?:statement (?:from|period)|period)[^\n]*"

ROW = ("statement_id", "seq", "date", "description", "debit_c", "credit_c", "balance_c", "confidence")


def _rows(df: DataFrame, number: int, name: str, source: str, mode: str) -> DataFrame:
    for column in ("seq", "balance_c"):
        if column not in df.columns:
            df = df.withColumn(column, F.col("line_no") if column == "seq" else F.lit(None).cast("long"))
    if "confidence" not in df.columns:
        df = df.withColumn("confidence", F.lit(0.92))
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(""))
    return df.select(*ROW, "category", F.lit(number).alias("cand_no"), F.lit(name).alias("name"), F.lit(source).alias("source"), F.lit(mode).alias("mode"))


def facts_of(body: DataFrame) -> DataFrame:
    """Per statement: kind, signals, year and period, from its lines."""
    patterns = tuple(dict.fromkeys((*lines.KIND_PATTERNS, *lines.FAMILY_PATTERNS, P.SECTIONED)))
    firsts = {
        "period_year": (dates.PERIOD_YEAR, lambda t: F.regexp_extract(t, dates.PERIOD_YEAR, 1).cast("int"), "statement"),
        "any_year": (dates.ANY_YEAR, dates.fallback_year),
        "period": (dates.NAMED_RANGE, dates.statement_period),
        "period_text": (PERIOD_LINE, lambda t: F.regexp_extract(t, PERIOD_LINE, 0), "statement", "period"),
    }
    has = lines.has_mark
    card = lines.hits(has, P.CARD_FAMILY) > 0
    bank = (lines.hits(has, P.BANK_FAMILY) > 0) | (has("withdrawals?") & has("deposits?"))
    return lines.marks(body, patterns, firsts).select(
        "statement_id", lines.statement_kind(has).alias("kind"), lines.layout_family(has).alias("family"), card.alias("looks_card"), bank.alias("looks_bank"),
        has(P.SECTIONED).alias("sectioned"), F.coalesce("period_year", "any_year").alias("year"), "period", F.coalesce("period_text", F.lit("")).alias("period_text"),
    )


def candidates(body: DataFrame, facts: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of all readings, balances of all readings). Only statements with a layout's signals are read that way."""
    full = materialised(lines.scanned(body.join(growing(facts), "statement_id")), "lines")  # every reading scans it
    card, bank = full.where("looks_card"), full.where("looks_bank")
    all_ends = materialised(lines.bank_balances(full), "ends")
    card_ends, bank_ends = lines.card_balances(card), all_ends.join(growing(facts.where("looks_bank").select("statement_id")), "statement_id")
    of = ("statement_id", "line_no", "line", "year", "token", "scan", "b")
    scoped = materialised(lines.scope_block(bank.select(*of)).where("scoped").select(*of), "scoped")
    entries = materialised(builders.card_entries(card.select(*of, "period")), "entries")  # two readings
    readings = [
        (builders.card_signed(entries), 1, "credit-card-simple", "text-parser", "credit-card", card_ends),
        (builders.card_signed(entries, True), 2, "credit-card-sectioned", "text-parser", "credit-card", card_ends),
        (builders.bank_rows(bank.select(*of), bank_ends), 3, "bank-account", "text-parser", "bank-account", bank_ends),
        (builders.bank_rows(scoped), 4, "bank-account", "text-parser", "bank-account", lines.bank_balances(scoped)),
        (lines.parse_line(full.select(*of)), 5, "fallback", "fallback", "bank-account", all_ends.select("statement_id", "opening_c", "closing_c", F.lit(None).cast("long").alias("sum_credits_c"), F.lit(None).cast("long").alias("sum_debits_c"))),
    ]
    rows = reduce(DataFrame.unionByName, [_rows(*r[:5]) for r in readings])
    ends = reduce(DataFrame.unionByName, [r[5].withColumn("cand_no", F.lit(r[1])) for r in readings])
    if items is not None:
        visual = materialised(layout.visual_lines(items), "visual")
        known = facts.select("statement_id", "year", dates.date_context(F.col("period_text")).alias("context"))
        placed, balances = tables.placed_readings(visual, known)
        placed = placed.select(*ROW, "category", "cand_no", F.lit("coordinate-table").alias("name"), F.lit("coordinate-table").alias("source"), F.col("kind").alias("mode"))
        rows, ends = placed.unionByName(rows), balances.unionByName(ends.select(balances.columns))
    rows = materialised(rows, "readings")
    last = rows.where("cand_no in (3, 4)").groupBy("statement_id", "cand_no").agg(F.max_by("balance_c", F.when(F.col("balance_c").isNotNull(), F.col("seq"))).alias("last_c"))
    ends = ends.join(growing(last), ["statement_id", "cand_no"], "left")
    return rows, ends.withColumn("closing_c", F.coalesce("closing_c", "last_c")).drop("last_c")


def described(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """rows with categories off their descriptions, and transfers without reference codes.

    On cards, distinctive categories leave a description anywhere. Ambiguous ones, which may be a merchant's words, do so only
    where the statement has a category column: one is declared, or two rows have a category of their own or a distinctive one.
    """
    card, bare = F.col("mode") == "credit-card", F.col("category") == ""
    plain = text.split_category(F.col("description"))
    rows = rows.withColumn("plain", F.when(card & bare, plain))
    proof = rows.where(card).groupBy("statement_id").agg(F.count_if(~bare | (F.col("plain.category") != "")).alias("proofs"))
    context = proof.join(growing(declared), "statement_id", "left").select("statement_id", ((F.col("proofs") >= 2) | F.coalesce("declared", F.lit(False))).alias("context"))
    rows = rows.join(growing(context), "statement_id", "left")
    wide = text.split_category(F.col("description"), F.lit(True))
    split = F.when(card & bare, F.when(F.col("context"), wide).otherwise(F.col("plain")))
    rows = rows.withColumn("split", split)
    rows = rows.withColumns({"description": F.coalesce("split.description", "description"), "category": F.when(card, F.coalesce("split.category", "category")).otherwise("")})
    return rows.withColumn("description", text.normalize_transfer(F.col("description"))["description"]).drop("plain", "split", "context")


def parse_statements(body: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, transactions) of text lines (statement_id, line_no, line) and, if given, positioned items.

    Every reading is reconciled and scored; the best is kept, dates are carried forward on bank rows, categories and
    reference codes leave the descriptions, and the result is validated.
    """
    body = materialised(body.select("statement_id", "line_no", "line"), "body")
    facts = materialised(facts_of(body), "facts")
    rows, ends = candidates(body, facts, items)
    ends = materialised(ends, "balances")
    sums = rows.groupBy("statement_id", "cand_no", "name", "source", "mode").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("credit_c"), F.lit(0)).alias("total_credits_c"), F.coalesce(F.sum("debit_c"), F.lit(0)).alias("total_debits_c"),
        F.count_if((F.trim("date") == "") | (F.trim("description") == "") | (F.col("debit_c").isNull() & F.col("credit_c").isNull())).alias("junk"), F.count_if(F.col("confidence") < statements.LOW_CONFIDENCE).alias("low_confidence"),
    )
    scored = statements.score(sums.join(growing(ends), ["statement_id", "cand_no"]).join(growing(facts.select("statement_id", "sectioned")), "statement_id"))
    best = statements.pick(scored)
    kept = rows.join(growing(best.select("statement_id", "cand_no")), ["statement_id", "cand_no"])
    bank = carry_forward(kept.where("mode = 'bank-account'")).drop("inherited")
    kept = bank.unionByName(kept.where("mode <> 'bank-account'"))
    final = described(kept, lines.category_context(body).withColumnRenamed("category_column", "declared"))
    final = final.select("statement_id", "seq", "date", "description", "category", "debit_c", "credit_c", "balance_c", "confidence", F.lit(None).cast("string").alias("warning"))
    row_facts = statements.row_facts(final)
    heads = best.select("statement_id", "name", "mode", "opening_c", "closing_c", "sum_credits_c", "sum_debits_c", "score", (F.col("source") == "fallback").alias("fallback"))
    return statements.validate(heads.join(growing(row_facts), "statement_id")), final


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    bank = builders.bank_statement(tx.where("statement_id % 2 = 0")).select("statement_id", "line_no", "line")
    return bank.unionByName(builders.card_statement(tx.where("statement_id % 2 = 1")).select("statement_id", "line_no", "line"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = parse_statements(_mixed(spark, sf_dir))
    return found.select("statement_id", "name", "status", "n_rows", "total_credits_c", "total_debits_c", "difference_c")


def _placed(spark: SparkSession, sf_dir: str, kind: str, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(text lines, items) of positioned statements: a title, a printed opening balance, a heading and one line per event.

    Card tables print one amount, with a minus or CR for credits by turns; bank tables one amount and a balance, or two sides.
    """
    tx = transactions(spark, sf_dir)
    place = {"date": 20.0, "description": 110.0, "debit": 330.0, "credit": 420.0, "amount": 400.0, "balance": 510.0}
    titles = {"date": "Date", "description": "Description", "debit": "Withdrawals", "credit": "Deposits", "amount": "Amount ($)", "balance": "Balance"}
    sign = F.when(F.col("credit_c").isNull(), F.lit("")).when(F.col("seq") % 2 == 0, F.lit(" CR")).otherwise(F.lit(""))
    lead = F.when(F.col("credit_c").isNotNull() & (F.col("seq") % 2 == 1), F.lit("-")).otherwise(F.lit(""))
    money_text = {
        "date": F.col("date"), "description": F.concat(F.lit("Entry "), F.element_at(F.split("event_type", "_"), 1)), "debit": builders.amount_text(F.col("debit_c")), "credit": builders.amount_text(F.col("credit_c")),
        "amount": F.concat(lead, builders.amount_text(F.col("amount_c")), sign) if kind == "card" else builders.amount_text(F.col("amount_c")), "balance": builders.amount_text(F.col("running_c")),
    }
    cell = lambda s, x, k: F.struct(s.alias("str"), F.lit(x).alias("x"), F.lit(k).alias("k"))
    body = tx.select("statement_id", (F.col("seq") + 2).alias("n"), F.explode(F.array(*[cell(money_text[c], place[c], k) for k, c in enumerate(columns)])).alias("i")).where("i.str is not null")
    first = tx.groupBy("statement_id").agg(F.min("opening_c").alias("opening_c"), F.max_by("running_c", "seq").alias("closing_c"), F.count(F.lit(1)).alias("rows_n"))
    owed = F.col("opening_c") * 2 - F.col("closing_c") if kind == "card" else F.col("closing_c")  # what a card's balance comes to
    names = ("Previous Balance", "New Balance") if kind == "card" else ("Opening Balance", "Closing Balance")
    ends = F.array(
        F.struct(F.lit(1).alias("n"), F.concat(F.lit(f"{names[0]} $"), builders.amount_text(F.col("opening_c"))).alias("str"), F.lit(20.0).alias("x"), F.lit(0).alias("k")),
        *[F.struct(F.lit(2).alias("n"), F.lit(titles[c]).alias("str"), F.lit(place[c]).alias("x"), F.lit(k).alias("k")) for k, c in enumerate(columns)],
        F.struct((F.col("rows_n") + 3).cast("int").alias("n"), F.concat(F.lit(f"{names[1]} $"), builders.amount_text(owed)).alias("str"), F.lit(20.0).alias("x"), F.lit(0).alias("k")),
    )
    frame = first.select("statement_id", F.explode(ends).alias("e")).select("statement_id", "e.n", F.struct("e.str", "e.x", "e.k").alias("i"))
    every = materialised(body.select("statement_id", "n", "i").unionByName(frame), "printed")
    page = F.floor((F.col("n") - 1) / 45 + 1).cast("int")
    y = (F.lit(780.0) - 14 * ((F.col("n") - 1) % 45)).cast("double")
    items = every.select("statement_id", page.alias("page"), (F.col("n") * 10 + F.col("i.k")).cast("int").alias("item_seq"), "i.str", "i.x", y.alias("y"), (F.length("i.str") * 5.0).cast("double").alias("width"))
    text_lines = every.groupBy("statement_id", F.col("n").cast("int").alias("line_no")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("i.k", "i.str"))).getField("str"), " ").alias("line"))
    return text_lines, items


#: The positioned variants: kind, columns.
PLACED = {
    "parse_placed_amounts": ("bank", ("date", "description", "amount", "balance")),
    "parse_placed_sides": ("bank", ("date", "description", "debit", "credit", "balance")),
    "parse_placed_cards": ("card", ("date", "description", "amount")),
}


def _parse_placed(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body, items = _placed(spark, sf_dir, *PLACED[name])
        found, rows = parse_statements(body, items)
        ends = rows.groupBy("statement_id").agg(F.min("description").alias("first_words"), F.min("date").alias("first_date"))
        kept = found.select("statement_id", F.col("mode"), "status", "n_rows", "total_credits_c", "total_debits_c", "difference_c")
        return kept.join(growing(ends), "statement_id")

    return run


def _placed_sql(name: str) -> str:
    kind = "credit-card" if PLACED[name][0] == "card" else "bank-account"
    return sql(TX_SQL, select=f"""
SELECT statement_id, '{kind}' AS mode, 'passed' AS status, count(*) AS n_rows, CAST(coalesce(sum(credit_c), 0) AS BIGINT) AS total_credits_c, CAST(coalesce(sum(debit_c), 0) AS BIGINT) AS total_debits_c,
  CAST(0 AS BIGINT) AS difference_c, min('Entry ' || event_type) AS first_words, min(date) AS first_date FROM tx GROUP BY statement_id""")


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the positioned pages, as read back by whichever reading wins."""
    _, rows = parse_statements(*placed_pages(spark, sf_dir))
    n = F.row_number().over(Window.partitionBy("statement_id").orderBy("seq"))
    return rows.select("statement_id", n.cast("long").alias("n"), "date", "description", "category", "debit_c", "credit_c", "balance_c")


def _page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of the positioned pages: how many rows each has, its balances, and whether it is the one kept."""
    body, items = placed_pages(spark, sf_dir)
    visual = materialised(layout.visual_lines(items), "visual")
    facts = facts_of(body)
    known = facts.select("statement_id", "year", dates.date_context(F.col("period_text")).alias("context"))
    rows, ends = tables.placed_readings(visual, known)
    counts = rows.groupBy("statement_id", "cand_no", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
    run = F.col("cand_no") >= tables.RUN_BASE
    base = F.when(run, tables.RUN_BASE).otherwise(tables.TABLE_BASE)
    return counts.join(growing(ends), ["statement_id", "cand_no"]).select("statement_id", run.alias("is_run"), (F.col("cand_no") - base).cast("long").alias("number"), "kind", "n_rows", "opening_c", "closing_c")


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the positioned pages, from an observed run."""
    _, items = placed_pages(spark, sf_dir)
    visual = materialised(layout.visual_lines(items), "visual")
    found, _ = tables.tables_of(visual)
    seen = Observation("headers")
    out = tables.probe(visual, found, seen)
    every = F.create_map(*[x for name in tables.COUNTERS for x in (F.lit(name), F.lit(seen.get[name] or 0).cast("long"))])
    return out.select("statement_id", *tables.COUNTERS, F.to_json("reasons").alias("reasons"), every["visual_lines"].alias("all_lines"), every["tables"].alias("all_tables"))


QUERIES = {
    "header_probe": (
        _probe,
        sql(TX_SQL, select="""
, p AS (SELECT *, statement_id % 4 AS shape, (seq - 1) // 22 + 1 AS page FROM tx WHERE amount_c > 0),
s AS (SELECT statement_id, shape, max(page) AS pages, count(*) AS n, count(*) FILTER (WHERE seq % 5 = 0) AS wraps, count(*) FILTER (WHERE seq % 7 = 3) AS details FROM p GROUP BY ALL),
c AS (SELECT statement_id, CASE shape WHEN 0 THEN n + wraps + details + 3 + 3 * pages WHEN 1 THEN n + wraps + details + 2 + pages WHEN 2 THEN n + 7 ELSE n + 1 END AS visual_lines,
  CASE shape WHEN 0 THEN 5 ELSE 4 END AS most_items, CASE shape WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE pages END AS heading_lines, CASE shape WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 0 END AS most_meanings,
  CASE shape WHEN 2 THEN 1 ELSE 0 END AS anchor_only, CASE shape WHEN 2 THEN 1 ELSE 0 END AS value_only, CASE shape WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE pages END AS tables,
  CASE shape WHEN 0 THEN pages ELSE 0 END AS relaxed_headings, CASE shape WHEN 2 THEN 1 ELSE 0 END AS stacked_headers, CASE shape WHEN 3 THEN 1 ELSE 0 END AS headless_tables, CASE WHEN shape < 2 AND pages > 1 THEN 1 ELSE 0 END AS runs,
  CASE WHEN shape < 2 AND pages > 1 THEN pages ELSE 0 END AS run_tables, CASE shape WHEN 2 THEN 1 ELSE 0 END AS rejected, CASE shape WHEN 1 THEN pages - 1 ELSE 0 END AS relaxed_joins,
  CASE shape WHEN 2 THEN '{"kind-mismatch":1}' ELSE '{}' END AS reasons FROM s)
SELECT *, CAST(sum(visual_lines) OVER () AS BIGINT) AS all_lines, CAST(sum(tables) OVER () AS BIGINT) AS all_tables FROM c"""),
    ),
    "parse_placed_rows": (
        _page_rows,
        sql(TX_SQL, PAGES_SQL, select="SELECT * FROM pages"),
    ),
    "placed_readings": (
        _page_readings,
        sql(TX_SQL, select=f"""
, p AS (SELECT *, (seq - 1) // 22 + 1 AS page FROM tx WHERE amount_c > 0),
s AS (SELECT statement_id, max(page) AS pages, min(opening_c) AS o, max_by(running_c, seq) AS c, count(*) AS n FROM p GROUP BY statement_id),
t AS (SELECT statement_id, page, count(*) AS n, max_by(running_c, seq) FILTER (WHERE seq % 3 <> 1) AS shown_c FROM p GROUP BY ALL)
SELECT statement_id, FALSE AS is_run, page AS number, 'bank-account' AS kind, t.n AS n_rows, CASE WHEN page = 1 THEN o END AS opening_c, CASE WHEN page = pages THEN c END AS closing_c
  FROM t JOIN s USING (statement_id) WHERE statement_id % 4 = 0
UNION ALL SELECT statement_id, TRUE, 1, 'bank-account', n, o, c FROM s WHERE statement_id % 4 = 0 AND pages > 1
UNION ALL SELECT statement_id, FALSE, page, 'credit-card', t.n, o, 2 * o - c FROM t JOIN s USING (statement_id) WHERE statement_id % 4 = 1
UNION ALL SELECT statement_id, TRUE, 1, 'credit-card', n, o, 2 * o - c FROM s WHERE statement_id % 4 = 1 AND pages > 1
UNION ALL SELECT statement_id, FALSE, 1, 'bank-account', n, o, c FROM s WHERE statement_id % 4 >= 2
UNION ALL SELECT statement_id, FALSE, 2, 'credit-card', 2, o, NULL FROM s WHERE statement_id % 4 = 2"""),
    ),
    "parse_statements": (
        _parsed,
        sql(TX_SQL, select="""
SELECT statement_id, CASE WHEN statement_id % 2 = 0 THEN 'bank-account' ELSE 'credit-card-sectioned' END AS name, 'passed' AS status, count(*) AS n_rows,
  CAST(coalesce(sum(credit_c), 0) AS BIGINT) AS total_credits_c, CAST(coalesce(sum(debit_c), 0) AS BIGINT) AS total_debits_c, CAST(0 AS BIGINT) AS difference_c FROM tx GROUP BY statement_id"""),
    ),
    **{name: (_parse_placed(name), _placed_sql(name)) for name in PLACED},
}
