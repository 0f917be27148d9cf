"""Wording by which lines, pages and whole statements are told apart. All patterns are fixed values.

They keep to what both Java and RE2 understand, so that the same pattern serves the engine and its SQL checks.
"""

# Statement kind and layout family, on lower-case text.
CARD_STRONG = r"previous account balance|total account balance|minimum payment|payment due date"
CARD_WEAK = (r"\bvisa\b", "mastercard", "credit card", "new balance")
BANK_WORDS = "opening balance|closing balance|withdrawals|deposits|balance forward|beginning balance|ending balance"
CARD_FAMILY = (
    r"previous (account )?balance",
    "minimum payment",
    "payment due date",
    "new balance",
    "total account balance",
    r"trans(?:\.|action)? date",
    r"post(?:ing)? date",
    r"\bvisa\b",
    "mastercard",
    "credit card",
    "cash advances?",
    "interest charged|interest charge",
)
BANK_FAMILY = ("opening balance", "closing balance", "account activity", "balance forward", "beginning balance", "ending balance")
SECTIONED = r"(?i)your payments|your interest|your new charges|spend categor|trans(?:\.|action)? date|post(?:ing)? date|amount\s*\(\s*\$\s*\)|total balance"

# Profiles in order: name, kind, matchers.
PROFILES = (
    ("collabria-style-credit-card", "credit-card", (r"(?i)collabria", r"(?i)\btransactions\b[\s\S]{0,40}\(continued\)", r"(?i)total (?:fees|interest) for this period")),
    ("sectioned-credit-card", "credit-card", (r"(?i)your payments|your interest|your new charges", r"(?i)spend categor", r"(?i)amount\s*\(\s*\$\s*\)")),
    ("generic-credit-card", "credit-card", (r"(?i)\bvisa\b|mastercard|credit card", r"(?i)payment due date")),
    ("multi-account-bank-statement", "bank-account", (r"(?i)equity shares|surplus|\bbusiness \d+\b",)),
    ("balance-forward-bank-account", "bank-account", (r"(?i)balance forward", r"(?i)cheque\s*\/?\s*debit|deposit\s*\/?\s*credit")),
    ("business-bank-account", "bank-account", (r"(?i)business (?:account|chequing)", r"(?i)closing totals|number of items processed", r"(?i)transaction fee")),
    ("generic-bank-account", "bank-account", (r"(?i)opening balance|closing balance|withdrawals|deposits|account activity",)),
)

# Card lines.
CARD_HARD_STOP = r"(?i)time to pay|interest rate chart|important information about your rbc royal bank credit card statement"
CARD_SOFT_STOP = r"(?i)total account balance"
CARD_HEADER = (
    r"activity description",
    r"amount\s*\(\s*\$\s*\)",
)
CARD_SPEND_REPORT = (
    r"(?i)spend(?:ing)? report|spend categor(?:y|ies)|rewards? (?:summary|earned|certificate|program)|gift certificate"
    r"|cash[\s-]?back (?:certificate|reward|summary)|reward certificate|creditsmart|budget|message cent(?:re|er)|points? (?:summary|balance|earned)"
)
CARD_REMITTANCE_NEAR = (
    r"(?i)minimum payment|amount due|amount past due|payment due|payment due date|please pay (?:this amount )?by|please pay by|total payment enclosed"
    r"|payment (?:slip|coupon|options)|remittance|tear[\s-]?off|mail (?:your )?payment|amount enclosed"
)
CARD_SUMMARY_LABEL = r"(?i)previous (?:account )?balance|minimum payment|payment due date|credit limit|available credit|new balance|total (?:account )?balance"
CARD_IGNORE = (
    r"(?i)minimum payment|amount due|amount past due|payment due|payment slip|payment options|total payment enclosed|please pay|remittance"
    r"|subtotal of monthly activity|total (?:debits|credits)|other (?:debits|credits)|cash advances|fees charged|interest charged"
    r"|total fees for this period|total interest for this period|credit limit|available credit|\bloc limit\b"
)
CARD_REMITTANCE = r"(?i)minimum payment|amount due|amount past due|payment due|payment slip|payment options|total payment enclosed|please pay|remittance"
FOREIGN_WORDS = r"(?i)foreign currenc|exchange rate|currency conversion|conversion rate"
FOREIGN_START = r"(?i)^(usd|us\$|eur|gbp|aud|jpy|mxn|cad)\b"
FOREIGN_CODE = r"(?i)\b(usd|eur|gbp|aud|jpy|mxn)\b"
FOREIGN_RATE = r"(?i)@|exchange|rate"
YEAR_TO_DATE = r"(?i)year[\s-]?to[\s-]?date|\bytd\b|\bin 20\d\d\b|20\d\d totals|totals? year"
FEE_ITEM = r"(?i)interest charge(?:d)? on |finance charge|service charge|annual fee|over[\s-]?limit fee|cash advance fee|late (?:payment )?fee|\bfee\b"

# Bank lines.
BANK_START = r"(?i)details of your account activity|account activity|transaction details|details of account"
BANK_STOP = (
    r"(?i)important information about your account|important account information|how to (?:reach|contact) us|trade ?-?marks?|^member\b|closing notice|closing totals"
)
BANK_SUMMARY_ROW = (
    r"(?i)^(?:total|sub-?total|interest\b|service charge|deposits?\b|withdrawals?\b|credits?\b|debits?\b|cheques?\b|chqs?\b|number of|no\.? of items"
    r"|monthly (?:aver|min|average|minimum)|average (?:cr|dr|daily)?\.? ?bal|minimum (?:cr|dr)?\.? ?bal|cash content|next statement|statement date"
    r"|items? (?:processed|enclosed|deposited)|transaction totals?)\b"
)
BANK_ITEMIZED = r"(?i)\b(?:cheque|chq|ch[eè]que|draft|voucher|item|ref(?:erence)?|serial)\b\s*(?:[-#:]\s*|no\.?\s*|number\s*)\d{2,}"
BANK_IGNORE = (
    r"(?i)statement period|account number|card number|page \d+ of \d+|p\.?o\.? box|customer service|www\.|royal bank of canada|how to reach"
    r"|\b1[-\s]?8\d{2}[-\s]?\d{3}[-\s]?\d{4}\b|\bfrom\b[^\n]{0,40}\bto\b[^\n]{0,30}20\d{2}|closing totals|total amounts? (?:debited|credited)"
    r"|number of items processed|^account fees?\b|\bloc limit\b|minimum payment|payment due date"
)
BANK_CREDIT_PRIOR = r"received|deposit|payroll|\bei\b|\bcredit\b|refund|interest paid|rebate|gov|gst|transfer in"
BANK_DEBIT_PRIOR = r"sent|payment|purchase|loan|\bfee\b|withdrawal|\batm\b|\bdebit\b|bill|cheque|service charge|transfer out|pre-?auth"
OPENING_LABEL = r"\b(opening balance|beginning balance|previous balance|balance forward)\b"
CLOSING_LABEL = r"\b(closing balance|ending balance|new balance)\b"
ANCHOR = r"(?i)\b(opening balance|balance forward)\b"

# Label ladders, the most specific first.
CARD_OPENING = (
    r"(?i)previous (?:account |statement )?balance",
    r"(?i)prior (?:account |statement )?balance",
    r"(?i)balance from (?:your )?previous statement",
    r"(?i)opening balance",
)
CARD_CLOSING = (r"(?i)\bnew balance\b", r"(?i)total account balance", r"(?i)total balance", r"(?i)statement balance", r"(?i)total amount due", r"(?i)\bbalance due\b")
CARD_CLOSING_NOT = r"(?i)minimum|past due|previous|prior|available"
PAYMENT_NOT = r"(?i)minimum|payment due|past due|please pay|payment enclosed|payment options|how to|available"
CARD_PAYMENTS = r"(?i)your payments|payments? (?:&|and|\/) ?credits"
CARD_PURCHASES = r"(?i)your new charges|new charges (?:&|and|\/) ?credits|purchases (?:&|and|\/) ?debits"
CARD_INTEREST = r"(?i)your interest|interest charged"
CARD_TOTAL_CREDITS = (r"(?i)total payments? ?(?:&|and|\/) ?credits", r"(?i)total credits", r"(?i)total payments?\b")
CARD_TOTAL_DEBITS = (r"(?i)total purchases? ?(?:&|and|\/) ?debits?", r"(?i)total (?:debits?|charges?|purchases?)\b")
BANK_TOTAL_CREDITS = (r"(?i)total amounts? credited", r"(?i)total deposits")
BANK_TOTAL_DEBITS = (r"(?i)total amounts? debited", r"(?i)total withdrawals")

# Pages.
PAGE_MONEY = r"(?:\$\s*)?\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\$\s*\d+(?:\.\d{2})?|\d+\.\d{2}"
PAGE_DATE = r"(?i)\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b|\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
PAGE_HEADER = (
    r"(?i)\btransactions?\b|(?:\btran(?:s|saction)?\.?\s*date\b[\s\S]{0,40}\bpost(?:ing)?\.?\s*date\b)|(?:description[\s\S]{0,40}amount)|reference (?:number|no)"
)
PAGE_SUMMARY = r"(?i)previous (?:account |statement )?balance|new balance|total (?:credits?|debits?|payments?|purchases?)|minimum payment|payment due"
PAGE_LEGAL = r"(?i)important (?:information|account information)|how to (?:reach|contact)|trade ?-?marks?|disclosure|cardholder agreement|terms and conditions|protecting your"
PAGE_WARNING = r"(?i)rewards?|points|interest rate chart|annual interest rate|message cent(?:re|er)"
CATEGORY_HEADER = r"(?i)\b(?:spend|merchant|transaction|purchase)\s+categor(?:y|ies)\b"
CATEGORY_WORD = r"(?i)\bcategor(?:y|ies)\b"
CATEGORY_BESIDE = r"(?i)\b(?:amount|debit|credit|balance|trans(?:action)?\.?\s*date|post(?:ing)?\.?\s*date|date)\b"

# Positioned tables: lines that are never rows, and wording by which an unsigned card amount is a credit.
TABLE_IGNORE = (
    r"(?i)credit limit|available credit|minimum payment|amount past due|payment due|payment slip|payment options|remittance|please pay|total payment enclosed"
    r"|new balance|previous (?:account |statement )?balance|opening balance|closing balance|balance forward|beginning balance|ending balance|total (?:account )?balance"
    r"|statement balance|total (?:debits?|credits?|withdrawals?|deposits?|purchases?|charges?|payments?|fees?|interest)|amounts? (?:debited|credited)|number of items"
    r"|no\.? of items|monthly (?:aver|min|average|minimum)|average (?:cr|dr|daily)?\.? ?bal|next statement|statement date|subtotal of monthly activity"
    r"|total fees for this period|total interest for this period|interest charged|fees charged|page \d+ of \d+"
)
TABLE_CREDIT = r"(?i)\bpayment\b|thank ?you|paiement|\bmerci\b|\brefund\b|\breturn(?:ed)?\b|credit voucher|\breversal\b|\brebate\b|cash ?back|\badjustment\b|\bcredit\b"
