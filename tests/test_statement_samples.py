"""Whole statements, worked out by hand: the rows, balances and status that a reader of each would write down.

No expectation is taken from the library's patterns; all statements are parsed in one run.
"""

import pytest
from ledgerweave.plans.statement import parse_statements

CARD = "MAPLE VISA CARD\nSTATEMENT FROM APR 24 TO MAY 25, 2026\nMINIMUM PAYMENT $10.00\nTRANSACTION DATE POSTING DATE ACTIVITY DESCRIPTION AMOUNT ($)\n"

#: name: (text, mode, (opening, closing) in cents, rows of (date, description, debit, credit, balance))
SAMPLES = {
    "a debit with its balance": ("2025-02-03 Corner Bakery Purchase 12.40 987.60", "bank-account", (None, None), [("2025-02-03", "Corner Bakery Purchase", 1240, None, 98760)]),
    "a deposit by its wording": ("2025-02-04 Salary Deposit 1,300.00 2,287.60", "bank-account", (None, None), [("2025-02-04", "Salary Deposit", None, 130000, 228760)]),
    "a month's name and the year of a heading": ("Statement period 2025\nMar 7 Tea House Purchase 6.50 411.00", "bank-account", (None, None), [("2025-03-07", "Tea House Purchase", 650, None, 41100)]),
    "a small bank statement": (
        "Yearly Account Statement 2025\nOpening Balance 500.00\n2025-01-02 Salary Deposit 1,000.00 1,500.00\n2025-01-04 Bookshop Purchase 30.25 1,469.75\n2025-01-09 Tea House Purchase 4.75 1,465.00\nClosing Balance 1,465.00",
        "bank-account", (50000, 146500),
        [("2025-01-02", "Salary Deposit", None, 100000, 150000), ("2025-01-04", "Bookshop Purchase", 3025, None, 146975), ("2025-01-09", "Tea House Purchase", 475, None, 146500)],
    ),
    "a purchase in four lines": (CARD + "APR 28\nAPR 30 HILLTOP GROCER OTTAWA ON\n74514206113043605100001\n$41.07", "credit-card", (None, None), [("2026-04-28", "HILLTOP GROCER OTTAWA ON", 4107, None, None)]),
    "a payment in four lines": (CARD + "MAY 01\nMAY 02 PAYMENT - THANK YOU\n74514206113043605100002\n-$75.00", "credit-card", (None, None), [("2026-05-01", "PAYMENT - THANK YOU", None, 7500, None)]),
    "a merchant over two lines": (CARD + "MAY 04\nMAY 05 NOODLE DELIVERY DOWNTOWN\nTOROON\n74514206113043605100003\n$22.30", "credit-card", (None, None), [("2026-05-04", "NOODLE DELIVERY DOWNTOWN TOROON", 2230, None, None)]),
    "foreign detail is no row": (CARD + "MAY 06\nMAY 07 STREAMING.EXAMPLE\nUSD 8.99\nEXCHANGE RATE 1.36\n74514206113043605100004\n$12.23", "credit-card", (None, None), [("2026-05-06", "STREAMING.EXAMPLE", 1223, None, None)]),
    "dates, wording and amount in one line": (CARD + "MAY 08 MAY 09 HILLTOP GROCER $10.00\nMAY 10 MAY 11 TEA HOUSE $5.50", "credit-card", (None, None), [("2026-05-08", "HILLTOP GROCER", 1000, None, None), ("2026-05-10", "TEA HOUSE", 550, None, None)]),
    "a merchant's word credit keeps a charge a charge": (CARD + "MAY 12 MAY 13 SMART CREDIT EXAMPLE.COM CA\n12345678901234567890\n$64.01", "credit-card", (None, None), [("2026-05-12", "SMART CREDIT EXAMPLE.COM CA", 6401, None, None)]),
    "a total beside the table doesn't end it": (
        CARD + "Previous Account Balance $0.00\nAPR 25 APR 26 SHOP ONE\n12345678901234567890\n$15.00\nTOTAL ACCOUNT BALANCE $60.00\nAPR 27 APR 28 SHOP TWO\n12345678901234567890\n$45.00\nNew Balance $60.00\nTOTAL ACCOUNT BALANCE $60.00\nTime to Pay",
        "credit-card", (0, 6000), [("2026-04-25", "SHOP ONE", 1500, None, None), ("2026-04-27", "SHOP TWO", 4500, None, None)],
    ),
    "nothing is read behind the end": (CARD + "APR 25 APR 26 SHOP ONE\n12345678901234567890\n$15.00\nTOTAL ACCOUNT BALANCE $640.00\nTime to Pay\nINTEREST RATE CHART", "credit-card", (None, 64000), [("2026-04-25", "SHOP ONE", 1500, None, None)]),
    "a whole card statement": (
        CARD + "Previous Account Balance $80.00\nAPR 25\nAPR 26 HILLTOP GROCER\n74000000000000000000010\n$20.00\nAPR 29\nAPR 29 PAYMENT - THANK YOU\n74000000000000000000011\n-$45.00\nNew Balance $55.00\nTotal Account Balance $55.00\nTIME TO PAY",
        "credit-card", (8000, 5500), [("2026-04-25", "HILLTOP GROCER", 2000, None, None), ("2026-04-29", "PAYMENT - THANK YOU", None, 4500, None)],
    ),
    "a heading beside the table turns no purchase": (
        "MAPLE VISA CARD\nSTATEMENT FROM APR 24 TO MAY 25, 2026\nPrevious Account Balance $70.00\nPayments & credits\nAPR 25 APR 26 SHOP ONE $20.00\nAPR 26 APR 27 SHOP TWO $15.00\nAPR 27 APR 28 PAYMENT - THANK YOU -$35.00\nNew Balance $70.00\nTIME TO PAY",
        "credit-card", (7000, 7000), [("2026-04-25", "SHOP ONE", 2000, None, None), ("2026-04-26", "SHOP TWO", 1500, None, None), ("2026-04-27", "PAYMENT - THANK YOU", None, 3500, None)],
    ),
    "sections with categories, a slip and a report": (
        "VALLEY CREDIT UNION MASTERCARD\nStatement period January 1 to February 9, 2026\nPrevious Balance $60.00\nMinimum payment due by MAR 05, 2026 $31.00\nTrans date Post date Description Spend Categories Amount($)\n"
        "Your payments\nJAN 05 JAN 06 PAYMENT THANK YOU Payment 60.00\nYour new charges and credits\nJAN 07 JAN 08 VALLEY FOODS Groceries 25.00\nJAN 09 JAN 10 LAKE DINER Restaurants 12.00\nYour interest\nJAN 31 JAN 31 INTEREST ON PURCHASES Interest 3.00\n"
        "Total balance $40.00\nMAR 05 MAR 05 , 2026 31.00\nSpend Report\nTime to Pay",
        "credit-card-sectioned", (6000, 4000),
        [("2026-01-05", "PAYMENT THANK YOU Payment", None, 6000, None), ("2026-01-07", "VALLEY FOODS", 2500, None, None), ("2026-01-09", "LAKE DINER", 1200, None, None), ("2026-01-31", "INTEREST ON PURCHASES Interest", 300, None, None)],
    ),
    "withdrawals, deposits, carried dates, a wrap and a footer": (
        "RIVER BANK CHEQUING ACCOUNT\nStatement period January 1 to January 31, 2026\nAccount number 12345 678 9\n1-800-555-0100\nDetails of your account activity\nDate Description Withdrawals Deposits Balance\nOpening Balance 800.00\n"
        "Jan 3 Payroll Deposit 700.00 1,500.00\nJan 5 Power Company 60.00 1,440.00\nGrocery Store 40.00 1,400.00\nJan 9 Pre-Authorized\nInsurance Payment 100.00 1,300.00\nJan 12 e-Transfer Received 50.00 1,350.00\nClosing Balance 1,350.00\nImportant information about your account\nFooter wording with a 555.00 number.",
        "bank-account", (80000, 135000),
        [("2026-01-03", "Payroll Deposit", None, 70000, 150000), ("2026-01-05", "Power Company", 6000, None, 144000), ("2026-01-05", "Grocery Store", 4000, None, 140000), ("2026-01-09", "Pre-Authorized Insurance Payment", 10000, None, 130000), ("2026-01-12", "e-Transfer Received", None, 5000, 135000)],
    ),
    "amounts between printed balances": (
        "RIVER BANK CHEQUING ACCOUNT\nFrom June 1 to June 30, 2026\nDetails of your account activity\nDate Description Withdrawals Deposits Balance\nOpening Balance 400.00\nJun 2 Payroll Deposit 900.00\nInterac Received 200.00 1,500.00\nJun 5 Pre-Authorized\nPower Payment 70.00\nGrocery Purchase 30.00 1,400.00\n"
        "Jun 8 e-Transfer Received 110.00\nJun 9 ATM Withdrawal 60.00 1,450.00\nClosing Balance 1,450.00\nImportant information about your account\nFooter 999.00",
        "bank-account", (40000, 145000),
        [("2026-06-02", "Payroll Deposit", None, 90000, None), ("2026-06-02", "Interac Received", None, 20000, 150000), ("2026-06-05", "Pre-Authorized Power Payment", 7000, None, None), ("2026-06-05", "Grocery Purchase", 3000, None, 140000), ("2026-06-08", "e-Transfer Received", None, 11000, None), ("2026-06-09", "ATM Withdrawal", 6000, None, 145000)],
    ),
    "several accounts, of which one has rows": (
        "VALLEY CREDIT UNION\nStatement period January 1 to January 31, 2026\nEquity Shares\nOpening Balance 5.00\nClosing Balance 5.00\nSurplus Equity Share\nOpening Balance 0.00\nClosing Balance 0.00\nBUSINESS 20\nLOC LIMIT: 45,000.00 EXP: 12/31/2099\nOpening Balance 1,816.50\n"
        "Jan 3 Client Deposit 2,000.00 3,816.50\nJan 10 Supplier Payment 1,000.00 2,816.50\nJan 20 Client Deposit 50.00 2,866.50\nJan 28 Loan Payment 335.10 2,531.40\nTotal 1,335.10-\nInterest 0\nClosing Balance 2,531.40",
        "bank-account", (181650, 253140), [("2026-01-03", "Client Deposit", None, 200000, 381650), ("2026-01-10", "Supplier Payment", 100000, None, 281650), ("2026-01-20", "Client Deposit", None, 5000, 286650), ("2026-01-28", "Loan Payment", 33510, None, 253140)],
    ),
    "a summary, a continued table and period totals": (
        "COLLABRIA CREDIT CARD\nStatement period January 1 to January 31, 2026\nNew Balance 380.00\nMinimum Payment Due 10.00\nAmount Past Due 0.00\nPayment Due Date FEB 21, 2026\nPrevious Balance 160.00\nPayments 150.00\nPurchases 300.00\nInterest Charged 30.00\nOther Debits 40.00\nTotal Credits 150.00\nTotal Debits 370.00\n"
        "Credit Limit 3,000.00\nAvailable Credit 2,620.00\nINFORMATION ABOUT YOUR ACCOUNT\nSome legal text about your account.\nTRANSACTIONS\nJAN 05 JAN 06 GROCERY STORE 300.00\nJAN 10 JAN 11 PAYMENT THANK YOU 150.00-\nTRANSACTIONS (Continued)\nJAN 31 JAN 31 INTEREST 30.00\nJAN 31 JAN 31 ANNUAL FEE 40.00\nTOTAL FEES FOR THIS PERIOD 40.00\nTOTAL INTEREST FOR THIS PERIOD 30.00",
        "credit-card", (16000, 38000), [("2026-01-05", "GROCERY STORE", 30000, None, None), ("2026-01-10", "PAYMENT THANK YOU", None, 15000, None), ("2026-01-31", "INTEREST", 3000, None, None), ("2026-01-31", "ANNUAL FEE", 4000, None, None)],
    ),
    "closing totals and an offer behind them": (
        "BMO BUSINESS ACCOUNT\nStatement period January 1 to January 31, 2026\nOpening balance 398.60\nJan 5 Customer Deposit 1,500.00\nJan 10 Supplier Payment 911.60\nClosing totals\nTotal amounts debited 911.60\nTotal amounts credited 1,500.00\nClosing balance 987.00\nNumber of items processed 26\nImportant information about your account\nJan 31 Your daily transfer limit is now 100,000.00",
        "bank-account", (39860, 98700), [("2026-01-05", "Customer Deposit", None, 150000, None), ("2026-01-10", "Supplier Payment", 91160, None, None)],
    ),
    "a balance forward, dates in the fourth column, statistics": (
        "TD BUSINESS ACCOUNT\nStatement from DEC 31 to JAN 31, 2025\nDESCRIPTION CHEQUE/DEBIT DEPOSIT/CREDIT DATE BALANCE\nBALANCE FORWARD 758.20\nDeposit 336.25 JAN 2 1,094.45\nCheque 862.10 JAN 3 232.35\nDeposit 775.00 JAN 10 1,007.35\nWithdrawal 170.35 JAN 15 837.00\nCredits 2 1,111.25\nDebits 2 1,032.45\nMONTHLY AVER. CR. BAL. 7,366.85\nMONTHLY MIN. BAL. 345.67\nCHQS enclosed 2",
        "bank-account", (75820, 83700),
        [("2025-01-02", "Deposit", None, 33625, 109445), ("2025-01-03", "Cheque", 86210, None, 23235), ("2025-01-10", "Deposit", None, 77500, 100735), ("2025-01-15", "Withdrawal", 17035, None, 83700)],
    ),
    "two cards, subtotals and an amount abroad": (
        "MAPLE BUSINESS VISA\nStatement period APR 1 to APR 30, 2026\nPrevious Statement Balance 205.00\nPayments & credits 205.00\nPurchases & debits 94.60\nNew Balance 94.60\nCard 1234\nAPR 5 APR 6 PAYMENT - THANK YOU -205.00\nSUBTOTAL OF MONTHLY ACTIVITY 205.00-\nCard 5678\nAPR 10 APR 11 OFFICE SUPPLIES 70.15\nAPR 12 APR 13 WORLD WEBSHOP USA\nForeign Currency USD\n17.50\nExchange rate 1.397143\n24.45\nSUBTOTAL OF MONTHLY ACTIVITY 94.60",
        "credit-card", (20500, 9460), [("2026-04-05", "PAYMENT - THANK YOU", None, 20500, None), ("2026-04-10", "OFFICE SUPPLIES", 7015, None, None), ("2026-04-12", "WORLD WEBSHOP USA", 2445, None, None)],
    ),
    "fees of count and rate": (
        "MAPLE BUSINESS ACCOUNT 2026\nDetails of your account activity\nOpening Balance 2,242.50\nJun 3 Customer Deposit 312.00 2,554.50\nJun 10 Supplier Payment 1,000.00 1,554.50\nJun 20 Regular transaction fee 2 Drs @ 1.25 1,552.00\nJun 20 Electronic transaction fee 1 Dr @ 0.75 1,551.25\nJun 30 Monthly Plan Fee 81.85 1,469.40\nClosing Balance 1,469.40\nImportant Account Information\nAccount Fees: $17.50",
        "bank-account", (224250, 146940),
        [("2026-06-03", "Customer Deposit", None, 31200, 255450), ("2026-06-10", "Supplier Payment", 100000, None, 155450), ("2026-06-20", "Regular transaction fee", 250, None, 155200), ("2026-06-20", "Electronic transaction fee", 75, None, 155125), ("2026-06-30", "Monthly Plan Fee", 8185, None, 146940)],
    ),
    "a wrapped fee and a cheque at a page's end": (
        "MAPLE BUSINESS ACCOUNT 2026\nDetails of your account activity\nOpening Balance 600.00\nJun 3 Customer Deposit 300.00 900.00\nJun 20 Electronic transaction fee 1 Dr @ 0.75\n1 Cr @ 0.75 1.50\nJun 25 Cheque - 123 545.47\nClosing Balance 353.03",
        "bank-account", (60000, 35303), [("2026-06-03", "Customer Deposit", None, 30000, 90000), ("2026-06-20", "Electronic transaction fee", 150, None, None), ("2026-06-25", "Cheque - 123", 54547, None, None)],
    ),
    "cheques without dates": (
        "Maple Bank of Canada 2025\nAccount Activity Details\nOpening balance 2,242.50\n01 Dec Online Banking transfer - 5026 79.02\nBill Payment PAY-FILE FEES 2.00\nCheque - 122 500.00 1,661.48\nMonthly fee 7.00\nPaper statement with images fee 1 @ 5.00\nElectronic transaction fee 1 Dr @ 0.75\n1 Cr @ 0.75 1.50 1,647.98\n09 Dec Carbon Rebate CANADA 312.00 1,959.98\n12 Dec Interac purchase - 0694 CAR SHOP 141.06\nCheque - 123 345.47\n12 Dec Cheque - 124 1,000.00 473.45\nClosing balance 473.45\nAccount Fees: $17.50",
        "bank-account", (224250, 47345),
        [
            ("2025-12-01", "Online Banking transfer - 5026", 7902, None, None), ("2025-12-01", "Bill Payment PAY-FILE FEES", 200, None, None), ("2025-12-01", "Cheque - 122", 50000, None, 166148), ("2025-12-01", "Monthly fee", 700, None, None),
            ("2025-12-01", "Paper statement with images fee 1 @", 500, None, None), ("2025-12-01", "Electronic transaction fee", 150, None, 164798), ("2025-12-09", "Carbon Rebate CANADA", None, 31200, 195998),
            ("2025-12-12", "Interac purchase - 0694 CAR SHOP", 14106, None, None), ("2025-12-12", "Cheque - 123", 34547, None, None), ("2025-12-12", "Cheque - 124", 100000, None, 47345),
        ],
    ),
    "balances alone": ("MAPLE VISA CARD\nSTATEMENT FROM APR 24 TO MAY 25, 2026\nPrevious Account Balance $1,000.00\nNew Balance $1,234.56", "credit-card", (100000, 123456), []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, n, line) for k, (body, *_) in enumerate(SAMPLES.values()) for n, line in enumerate(body.split("\n"), 1)]
    found, transactions = parse_statements(spark.createDataFrame(rows, "statement_id long, line_no int, line string"))
    heads = {r.statement_id: r for r in found.collect()}
    by_statement = {}
    for r in transactions.orderBy("statement_id", "seq").collect():
        by_statement.setdefault(r.statement_id, []).append((r.date, r.description, r.debit_c, r.credit_c, r.balance_c))
    return heads, by_statement


@pytest.mark.parametrize("name", SAMPLES)
def test_statement_is_read_as_by_hand(parsed, name):
    k = list(SAMPLES).index(name)
    _, mode, (opening, closing), rows = SAMPLES[name]
    assert parsed[1].get(k, []) == rows
    if not rows:
        return
    head = parsed[0][k]
    assert (head.mode if mode != "credit-card-sectioned" else head.name) == mode
    if opening is not None and closing is not None:
        debits, credits = (sum(r[side] or 0 for r in rows) for side in (2, 3))
        assert opening + (debits - credits if head.mode == "credit-card" else credits - debits) == closing  # the sample itself adds up
        assert (head.status, head.opening_c, head.closing_c, head.difference_c) == ("passed", opening, closing, 0)
    else:
        assert head.status != "passed"
