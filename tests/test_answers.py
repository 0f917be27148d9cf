"""Untrusted answers field by field, packets without text, and file checks."""

import json

from ledgerweave.operators import answers, layout, packets, tables
from ledgerweave.sources import corpus
from pyspark.sql import functions as F


def read(spark, *texts):
    rows = [(k, t if isinstance(t, str) or t is None else json.dumps(t)) for k, t in enumerate(texts)]
    return answers.read_answers(spark.createDataFrame(rows, "statement_id long, answer string"))


def test_forms_of_answers(spark):
    texts = [None, "", "{", "5", "null", "[]", {}, {"candidate": []}, {"candidate": {}}, {"candidate": 1, "reconstructedTransactions": []}, {"reconstructedTransactions": {"a": 1}, "repairPlan": {}},
             {"repairPlan": [], "noSafeReconstruction": 5, "noSafeReconstructionReason": "dim"}, {"noSafeReconstruction": {"reason": "x"}, "detectedTransactionSections": "fees", "sectionTotalsMatch": 1}]
    got = read(spark, *texts).orderBy("statement_id").collect()
    assert [r.form for r in got] == ["invalid"] * 8 + ["candidate", "candidate", "repair-plan", "no-safe-reconstruction", "no-safe-reconstruction"]
    assert got[11].unsafe == "dim" and got[12].unsafe == "x" and got[12].sections == [] and got[12].totals_match is None


def test_rows_of_answers_check_every_type(spark):
    good = {"transactionDate": 5, "description": "  a ", "debit": -2.5, "credit": "3", "balance": None, "confidence": 7, "issues": ["x", 1, *"abcdefghijkl"]}
    rows = [good, None, "row", [], {"description": "no amount", "debit": 0.001}, {"credit": 1, "amount": 9, "description": 4}, {"amount": True, "debit": 1e20}]
    got = answers.answer_rows(read(spark, {"candidate": {"transactions": rows}}, {"candidate": {"transactions": [good] * 2001}}, {"candidate": {"transactions": "none"}})).orderBy("seq").collect()
    assert {r.statement_id for r in got} == {0}
    assert (got[0].date, got[0].description, got[0].debit_c, got[0].credit_c, got[0].amount_c, got[0].confidence) == (None, "a", 250, None, -250, 1.0)
    assert got[0].issues == ["x", *"abcdefghi"]
    assert (got[1].description, got[1].credit_c, got[1].amount_c) == ("", 100, 900)


def test_an_image_backs_a_balance(spark):
    body = {"candidate": {"openingBalance": 5, "closingBalance": 7, "visualEvidenceReference": "p1", "transactions": [{"debit": 1}, {"credit": 3}]}}
    found = read(spark, body, body)
    parser = spark.createDataFrame([(k, "bank-account", 100, 700, 300, 100, False) for k in (0, 1)], "statement_id long, kind string, opening_c long, closing_c long, sum_credits_c long, sum_debits_c long, missed boolean")
    detected = spark.createDataFrame([(0, 700), (1, 700)], "statement_id long, balance_c long")
    refs = spark.createDataFrame([(1, "p1"), (1, "p1"), (0, "p2")], "statement_id long, ref string")
    got = {r.statement_id: (r.opening_c, r.closing_c, r.reason) for r in answers.independent_candidates(found, answers.answer_rows(found), parser, detected, refs).collect()}
    assert got == {0: (100, 700, "unsupported-balance"), 1: (500, 700, None)}


def test_no_text_of_a_row_gets_into_a_packet(spark):
    facts = "statement_id long, mode string, status string, confidence double, n_rows long, difference_c long, opening_c long, closing_c long, sum_credits_c long, sum_debits_c long, total_credits_c long, total_debits_c long, issues array<string>"
    heads = spark.createDataFrame([(1, "credit-card", "needs-review", 0.5, 1, 300, None, 900, 200, 400, 0, 0, ["SECRET ISSUE"])], facts)
    rows = spark.createDataFrame([(1, k, 100 * (k % 600), f"SECRET SHOP {k}") for k in range(1, 1200)], "statement_id long, seq int, balance_c long, description string")
    packet = packets.evidence_packets(heads, rows).first()["packet"]
    assert "SECRET" not in packet
    held = json.loads(packet)
    assert held["detectedBalances"][:4] == [9.0, 2.0, 4.0, 7.0] and len(held["detectedBalances"]) == 400 and held["detectedBalancesCount"] == 600
    assert held["parserLikelyMissedTransactions"] and held["likelyMissingDirection"] == "credit" and held["transactions"] == [] and held["openingAnchor"] is None


def test_foreign_detail_and_a_second_table(spark):
    """A bank table that goes on over a page, a detail line, and a small card table that is none of the account's."""
    cells = [
        (1, 700, "Opening Balance $100.00", 20), (1, 690, "Date", 20), (1, 690, "Description", 90), (1, 690, "Withdrawals", 330), (1, 690, "Deposits", 420), (1, 690, "Balance", 510),
        (1, 680, "2024-01-03", 20), (1, 680, "Shop abroad", 90), (1, 680, "40.00", 330), (1, 680, "60.00", 510), (1, 670, "1250 JPY", 90),
        (2, 700, "Date", 20), (2, 700, "Description", 90), (2, 700, "Withdrawals", 330), (2, 700, "Deposits", 420), (2, 700, "Balance", 510),
        (2, 690, "2024-01-04", 20), (2, 690, "Pay", 90), (2, 690, "5.00", 420), (2, 690, "65.00", 510),
        (2, 600, "Date", 20), (2, 600, "Description", 90), (2, 600, "Amount", 330), (2, 590, "2024-01-05", 20), (2, 590, "Bonus", 90), (2, 590, "1.00", 330),
    ]
    items = spark.createDataFrame([(7, p, k, s, float(x), float(y), 5.0 * len(s)) for k, (p, y, s, x) in enumerate(cells)], "statement_id long, page int, item_seq int, str string, x double, y double, width double")
    known = spark.createDataFrame([(7, 2024, None)], f"statement_id long, year int, context {layout.CONTEXT}")
    rows, ends = tables.placed_readings(layout.visual_lines(items), known)
    found = {(r.cand_no, r.seq): (r.date, r.description, r.debit_c, r.credit_c) for r in rows.collect()}
    run = tables.RUN_BASE + 1
    assert [found[run, k] for k in (1, 2)] == [("2024-01-03", "Shop abroad", 4000, None), ("2024-01-04", "Pay", None, 500)]
    held = {r.cand_no: (r.opening_c, r.closing_c) for r in ends.collect()}
    # the opening balance stands within eight lines above the second header too, and the third table's is the statement's
    assert held == {tables.TABLE_BASE + 1: (10000, None), tables.TABLE_BASE + 2: (10000, None), tables.TABLE_BASE + 3: (10000, None), run: (10000, 6500)}


def test_file_checks_in_order(spark):
    rows = [("a.PDF", None, 1), (None, "application/pdf", 5), ("a.txt", "text/plain", 1 << 30), ("a.pdf", "text/plain", 10 * 1024 * 1024), ("a.pdf", None, 10 * 1024 * 1024 + 1), (None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, name string, kind string, size long")
    got = [r.r for r in df.orderBy("k").select(corpus.file_check(F.col("name"), F.col("kind"), F.col("size")).alias("r")).collect()]
    assert got == [None, None, corpus.NOT_PDF, None, corpus.TOO_LARGE, corpus.NOT_PDF]


def test_corpus_scan_of_nested_folders(spark, tmp_path):
    for name in ("b.pdf", "x/y/a.PDF", "x/y/b.pdf", "x/n.txt", "x/c.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = corpus.scan_corpus(spark, f"file://{tmp_path}")
    assert sorted((r.folder, r.label, r.n_bytes) for r in got.collect()) == [(".", ".#0", 5), ("x", "x#0", 5), ("x/y", "x/y#0", 5), ("x/y", "x/y#1", 5)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].splitlines()[0]
