"""Operators on small hand-made statements."""

import json
import random
import re

import pytest
from ledgerweave.functions import dates
from ledgerweave.functions import patterns as P
from ledgerweave.operators import builders, layout, ledger, segments, statements, tables
from ledgerweave.operators import lines as ll
from ledgerweave.plans.statement import parse_statements
from ledgerweave.sources import sinks
from pyspark.sql import functions as F


def lines(spark, *texts, year=2024):
    rows = [(1, k + 1, t, year) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "statement_id long, line_no int, line string, year int")


def test_bank_table_with_wraps_fees_and_footer(spark):
    body = lines(
        spark, "Opening balance 1,000.00", "Account activity", "2024-01-02 Payroll", "deposit 500.00 1,500.00", "Groceries 40.00 1,460.00", "2024-01-03 Service fee 2 Drs @ 1.25 1,457.50",
        "Total withdrawals 99.00", "Cheque - 122 7.50 1,450.00", "Closing balance 1,450.00", "How to contact us", "2024-01-09 Offer 100,000.00",
    )
    rows = builders.bank_rows(body).orderBy("seq").collect()
    assert [(r.date, r.description, r.debit_c, r.credit_c, r.balance_c) for r in rows] == [
        ("2024-01-02", "Payroll deposit", None, 50000, 150000),
        ("2024-01-02", "Groceries", 4000, None, 146000),
        ("2024-01-03", "Service fee", 250, None, 145750),
        ("2024-01-03", "Cheque - 122", 750, None, 145000),
    ]
    assert all(r.solved for r in rows)


def test_card_rows_with_split_dates_sidebar_and_slip(spark):
    body = lines(
        spark, "Transaction date Posting date Activity description", "APR 22 APR 24 CORNER SHOP", "7451234567890123", "$25.25", "APR 23", "APR 25 PAYMENT - THANK YOU -$150.00",
        "TOTAL ACCOUNT BALANCE $1.00", "APR 26 APR 27 ABROAD", "12.00 USD @ 1.357", "$9.00", "$16.28", "TIME TO PAY", "APR 28 APR 29 NEVER $1.00",
    ).withColumn("period", F.lit(None).cast("struct<start_ord:int,end_ord:int,crosses_year:boolean,start_month:int,end_month:int,start_year:int,end_year:int>"))
    rows = builders.card_rows(body).orderBy("line_no").collect()
    assert [(r.date, r.description, r.debit_c, r.credit_c) for r in rows] == [
        ("2024-04-22", "CORNER SHOP", 2525, None),
        ("2024-04-23", "PAYMENT - THANK YOU", None, 15000),
        ("2024-04-26", "ABROAD", 1628, None),
    ]


def test_card_rows_of_zero_keep_the_side_of_their_sign(spark):
    body = lines(
        spark, "Transaction date Posting date Activity description", "APR 22 APR 24 CORNER SHOP -$0.00", "APR 23 APR 24 CORNER SHOP", "7451234567890123", "-$0.00", "APR 25 APR 25 CORNER SHOP 0.00 CR", "APR 26 APR 26 CORNER SHOP $0.00",
        "APR 26 APR 27 ABROAD", "12.00 USD @ 1.357", "(0.00)", "TIME TO PAY",
    ).withColumn("period", F.lit(None).cast("struct<start_ord:int,end_ord:int,crosses_year:boolean,start_month:int,end_month:int,start_year:int,end_year:int>"))
    assert [(r.date[5:], r.debit_c, r.credit_c) for r in builders.card_rows(body).orderBy("line_no").collect()] == [
        ("04-22", None, 0), ("04-23", None, 0), ("04-25", None, 0), ("04-26", 0, None), ("04-26", None, 0),
    ]


ITEM = "statement_id long, page int, item_seq int, str string, x double, y double, width double"


def placed(spark, places, *rows):
    """Items of rows of texts at the given places; None leaves a place out."""
    cells = [(1, 1, 10 * k + i, t, x, 700.0 - 14 * k, len(t) * 5.0) for k, row in enumerate(rows) for i, (t, x) in enumerate(zip(row, places, strict=False)) if t]
    return spark.createDataFrame(cells, ITEM)


def test_zero_amounts_with_a_date_or_balance_are_rows(spark):
    bank = placed(
        spark, (20.0, 110.0, 330.0, 420.0, 510.0), ("Date", "Description", "Withdrawals", "Deposits", "Balance"), ("2024-01-02", "Shop", "5.00", None, "95.00"), ("2024-01-03", "Voucher", "0.00", None, None),
        (None, "Bonus", None, "0.00", "95.00"), (None, "Nothing", "0.00", None, None), (None, "for free", None, None, None), ("2024-01-05", "Account fee", "0.00", None, None), ("2024-01-06", "Gift", "0.00", "7.00", "102.00"),
    )
    got = layout.coordinate_rows(bank).orderBy("seq").collect()
    assert [(r.date, r.description, r.debit_c, r.credit_c, r.balance_c) for r in got] == [
        ("2024-01-02", "Shop", 500, None, 9500), ("2024-01-03", "Voucher", 0, None, None), ("2024-01-03", "Bonus for free", None, 0, 9500), ("2024-01-06", "Gift", None, 700, 10200),
    ]
    card = placed(
        spark, (20.0, 110.0, 400.0), ("Date", "Description", "Amount ($)"), ("2024-01-02", "Shop", "5.00"), ("2024-01-03", "Voucher", "-0.00"), ("2024-01-04", "Voucher", "0.00 CR"), ("2024-01-04", "Voucher", "0.00"),
        ("2024-01-29", "Interest Charge on Cash Advances", "0.00"),
    )
    assert [(r.debit_c, r.credit_c) for r in layout.coordinate_rows(card).orderBy("seq").collect()] == [(500, None), (None, 0), (None, 0), (0, None)]


def test_a_zero_amount_takes_the_side_of_its_wording(spark):
    items = placed(
        spark, (20.0, 120.0, 330.0, 500.0), ("2024-01-02", "Salary", "5.00", "105.00"), ("2024-01-03", "Salary", "0.00", "105.00"), ("2024-01-04", "Shop", "2.00", "103.00"), ("2024-01-05", "Shop", "0.00", "103.00"),
        ("2024-01-06", "Other", "0.00", "103.00"), ("2024-01-07", "Salary", "1.00", "104.00"),
    )
    got = layout.headerless_rows(items, spark.createDataFrame([(1, 10000)], "statement_id long, opening_c long")).orderBy("seq").collect()
    assert [(r.description, r.debit_c, r.credit_c) for r in got] == [("Salary", None, 500), ("Salary", None, 0), ("Shop", 200, None), ("Shop", 0, None), ("Other", 0, None), ("Salary", None, 100)]


def test_a_parse_walks_the_lines_of_cards_once(spark, monkeypatch):
    seen, walk = [], builders.walk
    monkeypatch.setattr(builders, "walk", lambda *args: seen.append(args[-1]) or walk(*args))
    body = lines(spark, "Transaction date Posting date Activity description", "Previous balance $10.00", "New balance $12.00", "APR 22 APR 24 CORNER SHOP $2.00").drop("year")
    assert parse_statements(body)[0].first()["n_rows"] == 1
    assert seen.count(builders.CARD) == 1


def test_placed_readings_broadcast_no_growing_table(spark):
    items = placed(spark, (20.0, 110.0, 400.0), ("Date", "Description", "Amount ($)"), ("2024-01-02", "Shop", "5.00"), ("2024-01-03", "Other", "7.00"))
    known = spark.createDataFrame([(1, 2024, None)], f"statement_id long, year int, context {layout.CONTEXT}")
    rows, balances = tables.placed_readings(layout.visual_lines(items), known)
    assert rows.count() == 2 and balances.count() == 1
    assert not [df for df in (rows.join(balances.hint("merge"), ["statement_id", "cand_no"]), balances) if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]


def test_solver_ties_take_the_lowest_mask_and_long_segments_the_priors(spark):
    rows = [([100, 100], [0, 0], 0), ([100, 100], [1, -1], 0), ([100], [0], 7), ([1] * 17, [1] * 17, 17), ([], [], 0)]
    df = spark.createDataFrame(rows, "amounts array<long>, priors array<int>, delta_c long")
    signs = [r.signs for r in segments.solve(df.coalesce(1)).collect()]
    assert signs == [[True, False], [True, False], None, [True] * 17, None]


def plain_signs(amounts, priors, delta):
    n = len(amounts)
    if n > 16:
        return [p == 1 for p in priors] if sum(a if p == 1 else -a for a, p in zip(amounts, priors, strict=True)) == delta else None
    best = None
    for mask in range(1 << n):
        on = [mask >> k & 1 for k in range(n)]
        if n and sum(a if b else -a for a, b in zip(amounts, on, strict=True)) == delta:
            score = sum(0 if p == 0 else 1 if (p == 1) == bool(b) else -1 for p, b in zip(priors, on, strict=True))
            if best is None or score > best[0]:
                best = (score, [bool(b) for b in on])
    return best and best[1]


def test_solver_by_brute_force_on_all_lengths(spark):
    r = random.Random(6)
    rows = []
    for n in [*range(1, 13), *range(1, 13), 14, 16, 17, 20]:
        amounts = [r.choice([r.randrange(1, 40), 5, 5, 0]) for _ in range(n)]
        priors = [r.choice([-1, 0, 1]) for _ in range(n)]
        held = sum(a if p == 1 else -a for a, p in zip(amounts, priors, strict=True))
        rows.append((amounts, priors, r.choice([held, sum(a * r.choice([1, -1]) for a in amounts), 1])))
    df = spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], "amounts array<long>, priors array<int>, delta_c long, k int")
    found = [s.signs for s in segments.solve(df).orderBy("k").collect()]
    assert found == [plain_signs(*row) for row in rows]


def test_signs_of_long_segments_are_the_priors(spark):
    rows = [(1, k, 100, 1 if k % 3 == 0 else -1, None) for k in range(1, 40)] + [(2, k, 100, 0, 700 if k == 3 else None) for k in range(1, 30)]
    heads = spark.createDataFrame([(1, 0, -1300), (2, 1000, 5)], "statement_id long, opening_c long, closing_c long")
    got = segments.sign_rows(spark.createDataFrame(rows, "statement_id long, seq int, amount_c long, prior int, balance_c long"), heads).collect()
    assert {(r.statement_id, r.solved, r.credit == (r.prior == 1)) for r in got if r.statement_id == 1} == {(1, True, True)}
    assert {(r.segment, r.solved, r.credit) for r in got if r.statement_id == 2} == {(0, True, False), (1, False, False)}


def test_visual_lines_join_the_first_line_in_reach(spark):
    items = [(1, 1, k, s, x, y, 10.0) for k, (s, x, y) in enumerate([("b", 50.0, 100.0), ("a", 10.0, 102.0), ("c", 90.0, 98.0), ("d", 10.0, 95.0), (" ", 1.0, 100.0)])]
    df = spark.createDataFrame(items, "statement_id long, page int, item_seq int, str string, x double, y double, width double")
    assert [r.text for r in layout.visual_lines(df).orderBy("line_no").collect()] == ["a b c", "d"]


def test_header_meanings():
    assert layout.header_meaning("Amount ($)") == "amount"
    assert layout.header_meaning("Withdrawals (CAD):") == "debit"
    assert layout.header_meaning("Cheque / Debit") == "debit"
    assert layout.header_meaning("A date to remember") is None


def test_empty_statements(spark):
    empty = lines(spark, "x").where("false").select("statement_id", "line_no", "line")
    found, rows = parse_statements(empty)
    assert found.count() == 0
    assert rows.count() == 0


EXPORT = "statement_id long, seq int, date string, description string, debit_c long, credit_c long, balance_c long"


def test_workbook_is_the_same_every_time(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-02", "a & b", 100, None, None)], EXPORT)
    one, two = (sinks.workbooks(rows).first()["content"] for _ in range(2))
    assert bytes(one) == bytes(two)
    assert bytes(one)[:2] == b"PK"


def export_rows(spark, n):
    """n rows of account 1, and a few of two others with what needs escaping."""
    few = [(2, 1, "2024-01-02", 'a "b" & <c>', 100, None, -5), (2, 2, "", "", None, 0, None), (3, 7, None, None, None, None, None)]
    hot = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("statement_id"), F.col("id").cast("int").alias("seq"), F.lit("2024-01-02").alias("date"), F.concat(F.lit("row "), "id").alias("description"), (F.col("id") % 999).alias("debit_c"), F.lit(None).cast("long").alias("credit_c"), F.col("id").alias("balance_c"))
    return hot.unionByName(spark.createDataFrame(few, EXPORT)).repartition(6)


def test_chunks_of_a_large_account_make_one_document(spark, tmp_path):
    rows = export_rows(spark, 30_000)
    chunks = sinks.csv_chunks(rows, 1000)
    sizes = chunks.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("content")).alias("longest")).collect()
    assert {r.statement_id: r.n for r in sizes} == {1: 31, 2: 2, 3: 2} and max(r.longest for r in sizes) < 60_000
    sinks.write_documents(chunks, f"{tmp_path}/csv")
    text = lambda k: "".join(f.read_text(newline="") for f in sorted((tmp_path / "csv" / f"statement={k}").iterdir()))
    assert text(2) == 'Date,Description,Debit,Credit,Amount,Balance\r\n"2024-01-02","a ""b"" & <c>",1.00,,-1.00,-0.05\r\n"","",,0.00,,'
    assert text(1).count("\r\n") == 30_000 and text(1).endswith('"row 30000",0.30,,-0.30,300.00')
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    heads = spark.createDataFrame([(1, 5, None), (2, None, None), (3, 0, 700), (4, 1, 1)], "statement_id long, opening_c long, closing_c long")
    sinks.write_documents(sinks.json_chunks(rows, heads, 1000), f"{tmp_path}/json", "json")
    found = {k: json.loads("".join(f.read_text() for f in sorted((tmp_path / "json" / f"statement={k}").iterdir()))) for k in (1, 2, 3)}
    assert [r["seq"] for r in found[1]["rows"]] == list(range(1, 30_001)) and found[1]["opening"] == "0.05"
    assert found[2]["rows"][0]["description"] == 'a "b" & <c>' and found[3] == {"opening": "0.00", "closing": "7.00", "rows": [{"seq": 7}]}
    assert not (tmp_path / "json" / "statement=4").exists()


def test_a_failed_export_leaves_nothing_and_an_export_is_replaced_as_a_whole(spark, tmp_path):
    rows = export_rows(spark, 20)
    sinks.write_documents(sinks.csv_chunks(rows), f"{tmp_path}/out")
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_documents(sinks.csv_chunks(rows), f"{tmp_path}/out")
    bad = sinks.csv_chunks(rows).withColumn("content", F.when(F.col("statement_id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        sinks.write_documents(bad, f"{tmp_path}/out", mode="overwrite")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and len(list((tmp_path / "out").iterdir())) == 3
    sinks.write_documents(sinks.csv_chunks(rows.where("statement_id = 2")), f"{tmp_path}/out", mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["statement=2"]


def test_workbooks_past_a_sheet_hold_every_cell(spark):
    rows = export_rows(spark, 1000)
    books = sinks.workbooks(rows, 300)
    assert {(r.statement_id, r.book_no): r.n_rows for r in books.collect()} == {(1, 0): 300, (1, 1): 300, (1, 2): 300, (1, 3): 100, (2, 0): 2, (3, 0): 1}
    cells = sinks.read_workbooks(books)
    two = {r.row_no: r.cells for r in cells.where("statement_id = 2").collect()}
    assert two[0] == list(sinks.HEADERS) and two[1] == ["2024-01-02", 'a "b" & <c>', "1.00", None, "-1.00", "-0.05"] and two[2] == [None] * 6
    assert cells.where("statement_id = 1 and row_no > 0").select(F.countDistinct(F.col("cells")[1])).first()[0] == 1000


def test_a_conversion_is_charged_once_however_far_its_repeats_are(spark):
    asked = [("a", 5), ("b", 9), ("a", 5), ("c", 3), ("b", 4), ("a", 5), ("b", 4), ("d", 2), ("a", 5)]
    rows = [(1, c, k, k, pages, 12, 0) for k, (c, pages) in enumerate(asked)] + [(2, "a", 0, 0, 5, 12, 0)]
    df = spark.createDataFrame(rows, "user_id long, conversion_id string, request_id long, at long, pages long, allowance long, used long")
    found = ledger.charge(df).orderBy("user_id", "request_id").collect()
    assert [(r.outcome, r.used_after) for r in found] == [
        ("charged", 5), ("insufficient", 5), ("already-charged", 5), ("charged", 8), ("charged", 12), ("already-charged", 12),
        ("already-charged", 12), ("insufficient", 12), ("already-charged", 12), ("charged", 5),
    ]
    assert "_again" not in found[0].asDict()


def test_adoption_takes_only_safe_candidates(spark):
    names = "status string, confidence double, n_rows long, difference_c long, n_issues int, sum_credits_c long, sum_debits_c long, total_credits_c long, total_debits_c long"
    schema = ", ".join(f"{side}_{part}" for side in "pq" for part in names.split(", ")) + ", k int, dropped long"
    side = lambda status, rows, off: (status, 0.5, rows, off, 1, None, None, 0, 0)
    poor = side("needs-review", 5, 900)
    cases = [
        (poor, side("passed", 2, 0), 3, (True, "ai-full-reconstruction-reconciled")),
        (poor, side("needs-review", 5, 100), 1, (True, "ai-nearly-reconciled-keeps-rows")),
        (poor, side("needs-review", 5, 101), 0, (False, "ai-unreconciled-not-adopted")),
        (poor, side("needs-review", 6, 101), 1, (False, "ai-drops-parser-rows-without-reconciling")),
        (poor, side("needs-review", 4, 100), 0, (False, "candidate-worse-than-parser")),
        (side("needs-review", 1, 900), side("needs-review", 4, 500), 1, (True, "parser-missed-table-ai-rebuilt")),
        (side("needs-review", 1, 900), side("needs-review", 3, 500), 1, (False, "ai-unreconciled-not-adopted")),
    ]
    df = spark.createDataFrame([(*p, *q, k, dropped) for k, (p, q, dropped, _) in enumerate(cases)], schema)
    found = df.orderBy("k").select(statements.adoption("p", "q", F.col("dropped")).alias("a")).collect()
    assert [tuple(r.a) for r in found] == [want for *_, want in cases]


def test_marks_of_a_statement_are_those_of_its_whole_text(spark):
    """Wordings that go on over the ends of lines, and the first period, as one regex over the joined text finds them."""
    parts = ["transactions", "of", "(", "continued)", "amount", "($)", "statement", "period to 2031", "statement from A 2029", "JAN", "3", "to", "FEB 9, 2027", "new", "balance", "visa", "x" * 130, "1999", "cheque", "/ debit", "credit card"]
    r = random.Random(8)
    texts = {k: [r.choice(parts) for _ in range(r.choice([1, 3, 8, 30]))] for k in range(60)}
    texts[60] = ["transactions", *"abcdefghijklmnopqrs", "(continued)"]
    body = spark.createDataFrame([(k, n, t) for k, ts in texts.items() for n, t in enumerate(ts)], "statement_id long, line_no int, line string").repartition(3)
    patterns = ll.KIND_PATTERNS + ll.FAMILY_PATTERNS + ll.PROFILE_PATTERNS + (P.SECTIONED,)
    firsts = {"year": (dates.PERIOD_YEAR, lambda t: F.regexp_extract(t, dates.PERIOD_YEAR, 1)), "named": (dates.NAMED_RANGE, lambda t: F.regexp_extract(t, dates.NAMED_RANGE, 0))}
    for row in ll.marks(body, patterns, firsts).collect():
        whole = "\n".join(texts[row.statement_id])
        assert [row[ll.mark_of(p)] for p in patterns] == [bool(re.search(p, whole.lower())) for p in patterns]
        year, named = re.search(dates.PERIOD_YEAR, whole), re.search(dates.NAMED_RANGE, whole)
        assert (row.year, row.named) == (year and year[1], named and named[0]), whole
