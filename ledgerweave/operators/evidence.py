"""Which pages to show as evidence, and what to tell about a conversion: regions, messages, notes, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import patterns as P
from ..functions.text import safe_code, safe_count
from ..session import table
from ..sources.derived import LINES_SQL, TX_SQL, sql, text_lines, transactions
from .ledger import ACCOUNTS, accounts, preview_access, remaining
from .lines import _MONEY_SQL, _shape_list, m, page_texts

# A small document's pages, pages shown at most, regions shown at most, and a blank page's characters.
SMALL_PAGES, MOST_PAGES, MOST_REGIONS, TRANSACTION_PAGES, BLANK_CHARS = 6, 12, 8, 4, 40
ANCHOR_PAGE = (
    r"(?i)previous (?:account |statement )?balance|new balance|opening balance|closing balance|balance forward|amount due|minimum payment|payment due"
    r"|total (?:credits?|debits?|payments?|purchases?|deposits?|withdrawals?|cheques?|fees?|interest)"
)


def page_roles(lines: DataFrame) -> DataFrame:
    """statement_id, page, role: blank, transactions (a header, or two lines with money and one with a date), anchor or other."""
    line = F.col("line")
    signals = lines.groupBy("statement_id", "page").agg(
        F.count_if(F.size(money.money_values(line)) > 0).alias("money_lines"), F.count_if(dates.find_date(line).isNotNull()).alias("date_lines")
    )
    pages = page_texts(lines).join(signals, ["statement_id", "page"])
    t = F.col("text")
    tx = (F.col("money_lines") >= 2) & (F.col("date_lines") >= 1) | (t.rlike(P.PAGE_HEADER) & (F.col("money_lines") >= 1))
    return pages.select("statement_id", "page", F.when(F.length(F.trim("text")) < BLANK_CHARS, "blank").when(tx, "transactions").when(t.rlike(ANCHOR_PAGE), "anchor").otherwise("other").alias("role"))


def plan_pages(roles: DataFrame) -> DataFrame:
    """Per statement the pages to show and how complete they are.

    Small documents show their meaningful pages (all that aren't blank where none has transactions), others the transaction
    and anchor pages, twelve at most.
    """
    of = lambda *names: F.array_sort(F.collect_list(F.when(F.col("role").isin(*names), F.col("page"))))
    sets = roles.groupBy("statement_id").agg(F.max("page").alias("pages"), of("transactions").alias("tx"), of("anchor").alias("anchor"), of("transactions", "anchor", "other").alias("any"), of("other").alias("other"))
    wanted = F.array_sort(F.array_union("tx", "anchor"))
    meant = F.when((F.col("pages") <= SMALL_PAGES) & (F.size("tx") == 0), F.col("any")).otherwise(wanted)
    shown = F.slice(meant, 1, MOST_PAGES)
    out = sets.withColumns({"meant": meant, "shown": shown})
    return out.select(
        "statement_id", F.array_join("shown", ",").alias("shown"), F.size("shown").alias("n_shown"), (F.col("pages") - F.size("shown")).alias("skipped"),
        F.when(F.size("meant") > 0, F.floor(F.size("shown") * 100 / F.size("meant") + 0.5)).otherwise(0).cast("int").alias("complete_percent"),
        F.when(F.size("shown") == 0, "none").when(F.size("shown") == F.col("pages"), "all-pages").when(F.size("shown") == F.size("meant"), "transaction-and-anchors").otherwise("partial").alias("coverage"),
    )


def regions(roles: DataFrame) -> DataFrame:
    """statement_id, region, rank: upper and lower halves of the first transaction pages; without one the first page's
    halves and the last page's lower half. Repeats are left out, eight remain at most."""
    sets = roles.groupBy("statement_id").agg(F.max("page").alias("last"), F.slice(F.array_sort(F.collect_list(F.when(F.col("role") == "transactions", F.col("page")))), 1, TRANSACTION_PAGES).alias("tx"))
    halves = lambda p: F.array(F.concat(F.lit("p"), p.cast("string"), F.lit("-top")), F.concat(F.lit("p"), p.cast("string"), F.lit("-bottom")))
    plain = F.concat(halves(F.lit(1)), F.array(F.concat(F.lit("p"), F.col("last").cast("string"), F.lit("-bottom"))))
    chosen = F.slice(F.array_distinct(F.when(F.size("tx") > 0, F.flatten(F.transform("tx", halves))).otherwise(plain)), 1, MOST_REGIONS)
    return sets.select("statement_id", F.posexplode(chosen).alias("rank", "region"))


def credit_note(mode: Column, status: Column, charged: Column) -> Column:
    """What a conversion took from the allowance, in words."""
    pages = F.concat(charged.cast("string"), F.when(charged == 1, " page").otherwise(" pages"))
    return (
        F.when(mode == "preview", F.concat(F.lit("Free preview used "), pages, F.lit(".")))
        .when(status == "failed", "No page credits were used.")
        .when(status == "review", F.concat(F.lit("Exporting will use "), pages, F.lit(".")))
        .otherwise(F.concat(F.lit("Used "), pages, F.lit(".")))
    )


# The review screen's banner by what an assisted reading came to: variant, title, body.
BANNERS = (
    ("reconciled", "success", "AI-assisted review completed", "Balance check passed — please review the rows before export."),
    ("improved", "warning", "AI-assisted review improved this conversion", "It still needs review — check the highlighted rows before export."),
    ("no-improvement", "warning", "AI-assisted review completed", "This conversion still needs review. Check the highlighted rows before export."),
)
FAILED_STATES = ("call-failed", "invalid-response", "no-usable-result")
FAILED_BANNER = ("warning", "Automatic review could not fully repair this conversion", "Please review the highlighted rows before export.")
REVIEW_BANNER = ("warning", "This conversion needs review", "Check the highlighted rows before export.")
PASSED_BANNER = ("success", "Balance check passed", "Please review the rows before export.")


def review_message(status: Column, needs_review: Column) -> Column:
    """The banner (variant, title, body); states in which no assisted reading was used say nothing of one."""
    banner = lambda b: F.struct(*[F.lit(v).alias(n) for n, v in zip(("variant", "title", "body"), b, strict=True)])
    out = F.when(status.isin(*FAILED_STATES), banner(FAILED_BANNER))
    for name, *shown in BANNERS:
        out = out.when(status == name, banner(shown))
    return out.when(needs_review, banner(REVIEW_BANNER)).otherwise(banner(PASSED_BANNER))


def image_summary(images: DataFrame) -> DataFrame:
    """Per statement of images (statement_id, kind, bytes, height): how many, which kinds are among them, the largest, the lowest."""
    kind = F.col("kind")
    most = F.max("bytes")
    return images.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("images"), F.bool_or(F.coalesce(kind.isin("table-header", "table-body", "final-rows"), F.lit(False))).alias("has_transactions"),
        F.bool_or(F.coalesce(kind.isin("summary", "totals"), F.lit(False))).alias("has_summary"), F.when(most > 0, most).alias("max_bytes"), F.min("height").alias("min_height"),
    )


def review_reasons(warnings: Column, issues: Column, low: Column) -> Column:
    """Warnings and issues in order without repeats, then how many rows are doubtful."""
    count = F.when(low > 0, F.array(F.concat(low.cast("string"), F.lit(" low-confidence rows")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_union(F.array_distinct(warnings), issues), count)


def diagnostics(raw: DataFrame) -> DataFrame:
    """A whitelist of safe values from untrusted ones: counts, codes, and whether the row deserves a look."""
    n, code = safe_count(F.col("rows")), safe_code(F.col("code"))
    return raw.select("id", n.alias("rows"), code.alias("code"), ((n == 0) | code.isNull()).alias("flagged"))


# Wordings of sections that hold no transactions, the first that matches wins.
OTHER_SECTIONS = (
    ("minimum-payment", "minimum payment"),
    ("amount-due", "amount due|amount past due|new balance"),
    ("payment-due", "payment due|due date"),
    ("remittance", r"remittance|payment slip|tear[\s-]?off"),
    ("payment-coupon", "coupon"),
    ("payment-options", "payment option"),
    ("account-summary", "account summary|statement summary"),
    ("rewards", "reward|points"),
    ("spend-report", "spend report|spend categor"),
    ("cashback", "cash ?back|gift certificate|certificate"),
    ("legal", "legal|disclosure|terms"),
    ("message", "message|notice"),
    ("marketing", "marketing|promo|offer"),
    ("summary", "summary|total"),
)


def other_section(label: Column) -> Column:
    """The fixed name of a section without transactions, or null."""
    low = F.lower(label)
    out = F.when(low.rlike(OTHER_SECTIONS[0][1]), OTHER_SECTIONS[0][0])
    for name, pattern in OTHER_SECTIONS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out


def day_first(texts: DataFrame, key: str | list[str], body: str) -> DataFrame:
    """key, day_first: true or false where the numeric dates of a key's texts are evidence for one order only, else null."""
    keys = [key] if isinstance(key, str) else key
    token = r"\b(\d{1,2})[/-](\d{1,2})\b"
    pair = F.arrays_zip(F.regexp_extract_all(body, F.lit(token), F.lit(1)).alias("a"), F.regexp_extract_all(body, F.lit(token), F.lit(2)).alias("b"))
    each = texts.select(*keys, F.explode(pair).alias("p")).select(*keys, F.col("p.a").cast("int").alias("a"), F.col("p.b").cast("int").alias("b"))
    votes = each.groupBy(*keys).agg(F.count_if((F.col("a") > 12) & (F.col("b") <= 12)).alias("day"), F.count_if((F.col("b") > 12) & (F.col("a") <= 12)).alias("month"))
    return votes.select(*keys, F.when((F.col("day") > 0) & (F.col("month") == 0), True).when((F.col("month") > 0) & (F.col("day") == 0), False).alias("day_first"))


def rows_by_page(lines: DataFrame) -> DataFrame:
    """statement_id, pages: map of page to how many of its lines hold both a date and money."""
    tx = F.col("line").rlike(P.PAGE_DATE) & F.col("line").rlike(P.PAGE_MONEY)
    counts = lines.where(tx).groupBy("statement_id", "page").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("statement_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "n")))).alias("pages"))


def _day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    form = F.when(k % 2 == 0, F.date_format("o_orderdate", "d/M")).otherwise(F.date_format("o_orderdate", "M/d"))
    return day_first(table(spark, sf_dir, "orders").select((k * 100 + F.month("o_orderdate")).alias("customer"), F.concat(F.lit("on "), form, F.lit(" paid")).alias("body")), "customer", "body")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_roles(text_lines(transactions(spark, sf_dir)))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", credit_note(F.when(k % 4 == 0, "preview").otherwise("paid"), F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "review").otherwise("failed"), k % 3 + 1).alias("note"))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, "many").otherwise((k % 7 - 1).cast("string")).alias("rows"), F.when(k % 6 == 0, "two words").otherwise(F.concat(F.lit("E-"), k.cast("string"))).alias("code"))
    return diagnostics(raw)


def _banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    states = [name for name, *_ in BANNERS] + list(FAILED_STATES) + ["not-eligible", "disabled", None]
    status = F.element_at(F.array(*[F.lit(s).cast("string") for s in states]), (k % len(states) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", review_message(status, F.col("o_orderstatus") == "O").alias("m")).select("o_orderkey", "m.*")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images of their user's statement."""
    n, kinds = F.col("event_id"), ["page", "table-header", "totals", "page", "final-rows", "summary", "table-body", "page", None]
    kind = F.element_at(F.array(*[F.lit(k).cast("string") for k in kinds]), (n * 31 % 97 % len(kinds) + 1).cast("int"))
    images = table(spark, sf_dir, "events").where(n % 5 == 0).select(F.col("user_id").alias("statement_id"), kind.alias("kind"), (n % 3 * (n % 1000)).alias("bytes"), (n % 640).alias("height"))
    return image_summary(images)


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user sees: remaining pages of a plan, or the preview's state without one."""
    a = accounts(spark, sf_dir)
    paid = F.col("allowance") > 0
    return a.select("user_id", F.when(paid, "paid").otherwise("preview").alias("mode"), F.when(paid, remaining(F.col("allowance"), F.col("used"))).otherwise(F.greatest(F.lit(0), 6 - F.col("user_id") % 8)).cast("long").alias("left"), F.when(~paid, preview_access(F.col("user_id") % 8, F.col("user_id") % 7, F.lit(1))).alias("access"))


_PAGES = f"""
pgs AS (SELECT statement_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) FILTER (WHERE len({_MONEY_SQL}) > 0) AS ml, count(*) FILTER (WHERE shape IN ({_shape_list(lambda s: '{d}' in s or 'APR' in s)})) AS dl FROM lines GROUP BY statement_id, page),
roles AS (SELECT statement_id, page, CASE WHEN length(trim(text)) < {BLANK_CHARS} THEN 'blank' WHEN (ml >= 2 AND dl >= 1) OR ({m(P.PAGE_HEADER, 'text')} AND ml >= 1) THEN 'transactions' WHEN {m(ANCHOR_PAGE, 'text')} THEN 'anchor' ELSE 'other' END AS role FROM pgs)"""

def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of rows whose number's bits say which warnings and issues they have; one warning comes twice, one issue is a warning too."""
    n = F.col("event_id")
    bit = lambda k, text: F.when(F.shiftright(n, k).bitwiseAND(F.lit(1)) == 1, text)
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    reasons = review_reasons(some(bit(0, "Missing date."), bit(1, "Missing amount."), bit(2, "Missing date.")), some(bit(3, "Not balanced."), bit(4, "Missing date.")), n % 3)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(reasons, "|").alias("reasons"))


QUERIES = {
    "review_reasons": (
        _review,
        """WITH b AS (SELECT event_id, event_id & 1 = 1 AS b0, event_id & 2 = 2 AS b1, event_id & 4 = 4 AS b2, event_id & 8 = 8 AS b3, event_id & 16 = 16 AS b4 FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN b0 THEN 'Missing date.' END, CASE WHEN b1 THEN 'Missing amount.' END, CASE WHEN b2 AND NOT b0 THEN 'Missing date.' END, CASE WHEN b3 THEN 'Not balanced.' END,
  CASE WHEN b4 AND NOT b0 AND NOT b2 THEN 'Missing date.' END, CASE WHEN event_id % 3 > 0 THEN (event_id % 3) || ' low-confidence rows' END], lambda x: x IS NOT NULL), '|') AS reasons FROM b""",
    ),
    "page_roles": (_roles, sql(TX_SQL, LINES_SQL, _PAGES, select="SELECT statement_id, page, role FROM roles")),
    "evidence_plan": (
        lambda s, d: plan_pages(_roles(s, d)).select("statement_id", "shown", "n_shown", "skipped", "complete_percent", "coverage"),
        sql(TX_SQL, LINES_SQL, _PAGES, select="""
, g AS (SELECT statement_id, max(page) AS pages, list_sort(coalesce(list(page) FILTER (WHERE role = 'transactions'), [])) AS tx, list_sort(coalesce(list(page) FILTER (WHERE role IN ('transactions', 'anchor')), [])) AS want, list_sort(coalesce(list(page) FILTER (WHERE role <> 'blank'), [])) AS every FROM roles GROUP BY 1),
h AS (SELECT *, CASE WHEN pages <= 6 AND len(tx) = 0 THEN every ELSE want END AS meant FROM g), k AS (SELECT *, meant[1:12] AS shown_ FROM h)
SELECT statement_id, array_to_string(shown_, ',') AS shown, CAST(len(shown_) AS INT) AS n_shown, CAST(pages - len(shown_) AS INT) AS skipped, CASE WHEN len(meant) > 0 THEN CAST(floor(len(shown_) * 100 / len(meant) + 0.5) AS INT) ELSE 0 END AS complete_percent,
  CASE WHEN len(shown_) = 0 THEN 'none' WHEN len(shown_) = pages THEN 'all-pages' WHEN len(shown_) = len(meant) THEN 'transaction-and-anchors' ELSE 'partial' END AS coverage FROM k"""),
    ),
    "evidence_regions": (
        lambda s, d: regions(_roles(s, d)),
        sql(TX_SQL, LINES_SQL, _PAGES, select="""
, g AS (SELECT statement_id, max(page) AS last, (list_sort(coalesce(list(page) FILTER (WHERE role = 'transactions'), [])))[1:4] AS tx FROM roles GROUP BY 1),
r AS (SELECT statement_id, CASE WHEN len(tx) > 0 THEN flatten(list_transform(tx, lambda p: ['p' || p || '-top', 'p' || p || '-bottom'])) WHEN last = 1 THEN ['p1-top', 'p1-bottom'] ELSE ['p1-top', 'p1-bottom', 'p' || last || '-bottom'] END AS regs FROM g)
SELECT statement_id, CAST(i - 1 AS INT) AS rank, regs[i] AS region FROM (SELECT statement_id, regs, unnest(generate_series(1, len(regs))) AS i FROM r)"""),
    ),
    "other_sections": (
        lambda s, d: text_lines(transactions(s, d)).select("statement_id", "line_no", other_section(F.col("line")).alias("section")).where("section is not null"),
        sql(TX_SQL, LINES_SQL, select="SELECT * FROM (SELECT statement_id, line_no, CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{n}'" for n, p in OTHER_SECTIONS) + " END AS section FROM lines) WHERE section IS NOT NULL"),
    ),
    "day_first_votes": (
        _day_first,
        """WITH t AS (SELECT o_custkey * 100 + month(o_orderdate) AS customer, CASE WHEN o_custkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS a, CASE WHEN o_custkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS b FROM orders),
v AS (SELECT customer, count(*) FILTER (WHERE a > 12 AND b <= 12) AS d, count(*) FILTER (WHERE b > 12 AND a <= 12) AS m FROM t GROUP BY customer)
SELECT customer, CASE WHEN d > 0 AND m = 0 THEN TRUE WHEN m > 0 AND d = 0 THEN FALSE END AS day_first FROM v""",
    ),
    "rows_by_page": (
        lambda s, d: rows_by_page(text_lines(transactions(s, d))).select("statement_id", F.size("pages").alias("n_pages"), F.to_json("pages").alias("pages")),
        sql(TX_SQL, LINES_SQL, select=f"""
, c AS (SELECT statement_id, page, count(*) AS n FROM lines WHERE {m(P.PAGE_DATE)} AND {m(P.PAGE_MONEY)} GROUP BY ALL)
SELECT statement_id, CAST(count(*) AS INT) AS n_pages, '{{' || string_agg('"' || page || '":' || n, ',' ORDER BY page) || '}}' AS pages FROM c GROUP BY statement_id"""),
    ),
    "credit_notes": (
        _notes,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Free preview used ' || p || '.' WHEN o_orderstatus = 'F' THEN 'Used ' || p || '.' WHEN o_orderstatus = 'O' THEN 'Exporting will use ' || p || '.' ELSE 'No page credits were used.' END AS note
FROM (SELECT *, CAST(o_orderkey % 3 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' page' ELSE ' pages' END AS p FROM orders)""",
    ),
    "review_messages": (
        _banners,
        """SELECT o_orderkey, variant, title, body FROM orders JOIN (VALUES
  (0, 'success', 'AI-assisted review completed', 'Balance check passed — please review the rows before export.'),
  (1, 'warning', 'AI-assisted review improved this conversion', 'It still needs review — check the highlighted rows before export.'),
  (2, 'warning', 'AI-assisted review completed', 'This conversion still needs review. Check the highlighted rows before export.'),
  (3, 'warning', 'Automatic review could not fully repair this conversion', 'Please review the highlighted rows before export.'),
  (4, 'warning', 'This conversion needs review', 'Check the highlighted rows before export.'),
  (5, 'success', 'Balance check passed', 'Please review the rows before export.')) b(k, variant, title, body)
ON k = CASE WHEN o_orderkey % 9 < 3 THEN o_orderkey % 9 WHEN o_orderkey % 9 < 6 THEN 3 WHEN o_orderstatus = 'O' THEN 4 ELSE 5 END""",
    ),
    "image_summary": (
        _images,
        """SELECT statement_id, count(*) AS images, coalesce(bool_or(k IN (1, 4, 6)), FALSE) AS has_transactions, coalesce(bool_or(k IN (2, 5)), FALSE) AS has_summary, nullif(max(bytes), 0) AS max_bytes, min(height) AS min_height
FROM (SELECT user_id AS statement_id, event_id * 31 % 97 % 9 AS k, event_id % 3 * (event_id % 1000) AS bytes, event_id % 640 AS height FROM events WHERE event_id % 5 = 0) GROUP BY statement_id""",
    ),
    "safe_diagnostics": (
        _diagnostics,
        """SELECT id, rows, code, rows = 0 OR code IS NULL AS flagged FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE greatest(0, o_orderkey % 7 - 1) END AS rows, CASE WHEN o_orderkey % 6 <> 0 THEN 'E-' || o_orderkey END AS code FROM orders)""",
    ),
    "preview_status": (
        _preview,
        sql(ACCOUNTS, select="SELECT user_id, CASE WHEN allowance > 0 THEN 'paid' ELSE 'preview' END AS mode, CASE WHEN allowance > 0 THEN greatest(0, allowance - used) ELSE greatest(0, 6 - user_id % 8) END AS left, CASE WHEN allowance <= 0 THEN CASE WHEN user_id % 7 >= 5 THEN 'PREVIEW_ATTEMPT_LIMIT' WHEN 1 > greatest(0, 6 - user_id % 8) THEN 'PREVIEW_PAGE_LIMIT' ELSE 'allowed' END END AS access FROM acc").replace(" AS left,", ' AS "left",'),
    ),
}
