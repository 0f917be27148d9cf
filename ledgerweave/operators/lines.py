"""Operators on statement lines, pages and whole texts: splitting, kinds, profiles, line classes, page signals, balances."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions import patterns as P
from ..session import growing, table
from ..sources.derived import LINES_SQL, SHAPES, TX_SQL, sql, text_lines, transactions

#: Lines handed on as evidence for a statement. Fixed value.
EVIDENCE_LINES = 400


def split_lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, line_no (from 1, blank lines not counted), line: trimmed lines in order."""
    parts = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


#: Lines behind a line among which a wording that begins in it may end, and characters of them past the next line.
AHEAD_LINES, AHEAD_CHARS = 24, 120

#: Tells whether a text has a pattern.
Has = Callable[[str], Column]


def has_in(body: Column) -> Has:
    low = F.lower(body)
    return low.rlike


def has_mark(pattern: str) -> Column:
    """Whether a statement has a pattern, of the columns of `marks`."""
    return F.col(mark_of(pattern))


def mark_of(pattern: str) -> str:
    return f"mark_{zlib.crc32(pattern.encode()):08x}"


def with_ahead(lines: DataFrame) -> DataFrame:
    """ahead: each line and what stands behind it, as far as a wording that begins in the line can reach."""
    order = Window.partitionBy("statement_id").orderBy("line_no")
    further = F.left(F.concat_ws("\n", *[F.lead("line", k).over(order) for k in range(2, AHEAD_LINES + 1)]), F.lit(AHEAD_CHARS))
    return lines.withColumn("ahead", F.concat_ws("\n", "line", F.lead("line", 1).over(order), F.nullif(further, F.lit(""))))


def marks(lines: DataFrame, patterns: tuple[str, ...], firsts: dict[str, tuple] | None = None) -> DataFrame:
    """statement_id, a flag for each pattern that some of its lines has (see has_mark), and firsts: what is read at a
    pattern's first place in the statement, as {name: (pattern, reader, *words)}; where words are given, each match has one.

    No text is joined: only patterns that take white space can go on in the next lines, and those look a bounded way ahead.
    A first place counts in the line in which it begins.
    """
    firsts = firsts or {}
    rows = with_ahead(lines.select("statement_id", "line_no", "line"))
    low = {False: F.lower("line"), True: F.lower("ahead")}
    flags = {mark_of(p): low[r"\s" in p].rlike(p) for p in patterns}
    places = {}
    for name, (pattern, reader, *words) in firsts.items():
        at = F.regexp_instr("ahead", F.lit(pattern))
        if words:
            at = F.when(text.any_of(low[True], words), at).otherwise(0)
        places[name] = F.when((at > 0) & (at <= F.length("line")), F.struct(reader(F.col("ahead")).alias("found")))
    rows = rows.select("statement_id", "line_no", *[c.alias(n) for n, c in (flags | places).items()])
    return rows.groupBy("statement_id").agg(
        *[F.bool_or(n).alias(n) for n in flags], *[F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("line_no")))["found"].alias(n) for n in places]
    )


def hits(has: Has, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a text has."""
    return reduce(lambda a, b: a + b, [has(p).cast("int") for p in patterns])


KIND_PATTERNS = (P.CARD_STRONG, *P.CARD_WEAK, P.BANK_WORDS)
FAMILY_PATTERNS = (*P.CARD_FAMILY, *P.BANK_FAMILY, "withdrawals?", "deposits?")
PROFILE_PATTERNS = tuple(p for *_, matchers in P.PROFILES for p in matchers)


def statement_kind(has: Has) -> Column:
    card = has(P.CARD_STRONG) | (hits(has, P.CARD_WEAK) >= 2)
    return F.when(card, "credit-card").when(has(P.BANK_WORDS), "bank-account").otherwise("unknown")


def layout_family(has: Has) -> Column:
    """The layout by its signals; withdrawals beside deposits make a bank table at once."""
    card, bank = hits(has, P.CARD_FAMILY), hits(has, P.BANK_FAMILY)
    table_words = has("withdrawals?") & has("deposits?")
    return (
        F.when(table_words | ((bank >= 2) & (bank >= card)), "bank-account-table")
        .when(card >= 2, "credit-card-table")
        .when(bank >= 1, "bank-account-table")
        .otherwise("unknown")
    )


def best_profile(statements: DataFrame, has: Has) -> DataFrame:
    """statement_id, profile, hits, confidence: the profile of the statement's kind with most matchers; the first wins ties."""
    kind = statement_kind(has)
    scored = F.array(
        *[F.struct(F.lit(k).alias("pos"), F.lit(name).alias("name"), F.lit(of).alias("kind"), hits(has, matchers).alias("hits")) for k, (name, of, matchers) in enumerate(P.PROFILES)]
    )
    rows = statements.select("statement_id", kind.alias("kind"), scored.alias("p"))
    mine = F.filter("p", lambda p: (F.col("kind") == "unknown") | (p["kind"] == F.col("kind")))
    best = F.array_max(F.transform(mine, lambda p: F.struct(p["hits"].alias("hits"), (-p["pos"]).alias("pos"), p["name"].alias("name"))))
    rows = rows.withColumn("best", best)
    some = F.col("best.hits") > 0
    generic = F.when(F.col("kind") == "credit-card", "generic-credit-card").when(F.col("kind") == "bank-account", "generic-bank-account").otherwise("unknown")
    return rows.select(
        "statement_id",
        F.when(some, F.col("best.name")).otherwise(generic).alias("profile"),
        F.when(some, F.col("best.hits")).otherwise(0).alias("hits"),
        F.when(some, F.least(F.lit(10), 5 + F.col("best.hits") * 2)).when(F.col("kind") == "unknown", 1).otherwise(3).alias("confidence_tenths"),
    )


def is_card_header(line: Column) -> Column:
    low = F.lower(line)
    both = (low.rlike(r"\btransaction\b") & low.rlike(r"\bposting\b")) | (low.rlike(r"trans(?:\.|action)? date") & low.rlike(r"post(?:ing)? date"))
    return low.rlike(P.CARD_HEADER[0]) | low.rlike(P.CARD_HEADER[1]) | both


def card_section(line: Column) -> Column:
    """The direction a section heading sets: debit, credit or null. Charge sections are tried first."""
    low = F.lower(F.trim(line))
    return (
        F.when(low.rlike("(new charges|charges and credits|purchases|cash advances?)"), "debit")
        .when(low.rlike(r"^(your )?interest\b") | low.rlike(r"^(fees|service charges?)\b"), "debit")
        .when(low.rlike(r"^(your )?payments?\b") & ~low.rlike("due|minimum"), "credit")
        .when(low.rlike(r"^(your )?credits?\b") | low.rlike(r"payments?\s*(?:&|and)\s*credits"), "credit")
    )


def is_foreign(line: Column) -> Column:
    return line.rlike(P.FOREIGN_WORDS) | line.rlike(P.FOREIGN_START) | (line.rlike(P.FOREIGN_CODE) & line.rlike(P.FOREIGN_RATE))


def is_reference(line: Column, digits: int = 12) -> Column:
    """A line of digits alone; card text asks for 12, positioned text for 8."""
    return F.regexp_replace(line, r"\s", "").rlike(rf"^\d{{{digits},}}$") & ~F.contains(line, F.lit("$"))


def card_classes(line: Column) -> dict[str, Column]:
    """Flags of a card line."""
    return {
        "header": is_card_header(line),
        "ignored": line.rlike(P.CARD_IGNORE),
        "remittance": line.rlike(P.CARD_REMITTANCE),
        "remittance_near": line.rlike(P.CARD_REMITTANCE_NEAR),
        "spend_report": line.rlike(P.CARD_SPEND_REPORT),
        "summary_label": line.rlike(P.CARD_SUMMARY_LABEL),
        "hard_stop": line.rlike(P.CARD_HARD_STOP),
        "soft_stop": line.rlike(P.CARD_SOFT_STOP),
        "reference": is_reference(line),
        "foreign": is_foreign(line),
        "year_to_date": line.rlike(P.YEAR_TO_DATE),
    }


def bank_classes(line: Column) -> dict[str, Column]:
    """Flags of a bank line."""
    return {
        "starts": line.rlike(P.BANK_START),
        "stops": line.rlike(P.BANK_STOP),
        "summary_row": line.rlike(P.BANK_SUMMARY_ROW),
        "itemized": line.rlike(P.BANK_ITEMIZED),
        "ignored": line.rlike(P.BANK_IGNORE),
        "anchor": line.rlike(P.ANCHOR),
    }


def balance_line(line: Column, scan: Column | None = None) -> Column:
    """struct(kind, cents) of an opening or closing balance line: its last amount; opening wins. Null otherwise."""
    low = F.lower(line)
    opening, closing = low.rlike(P.OPENING_LABEL), low.rlike(P.CLOSING_LABEL)
    last = money.last_of(money.scan_money(line) if scan is None else scan)["cents"]
    return F.when((opening | closing) & last.isNotNull(), F.struct(F.when(opening, "opening").otherwise("closing").alias("kind"), last.alias("cents")))


def scanned(lines: DataFrame) -> DataFrame:
    """lines with what several readings need of each: its date token, its amounts (scan) and its balance (b), unless they are there."""
    line = F.col("line")
    new = {"token": dates.find_date(line), "scan": money.scan_money(line)}
    lines = lines.withColumns({n: c for n, c in new.items() if n not in lines.columns})
    return lines if "b" in lines.columns else lines.withColumn("b", balance_line(line, F.col("scan")))


def labelled(lines: DataFrame, name: str, pattern: str, but: str | None = None) -> DataFrame:
    """statement_id, name: the amount of the first labelled line that has one.

    On the line its last dollar amount, else its last amount, else an amount alone on one of the next two lines.
    """
    order = Window.partitionBy("statement_id").orderBy("line_no")
    line = F.col("line")
    found = F.coalesce(
        money.last_of(money.money_values(line, require_dollar=True)),
        money.last_of(money.money_values(line)),
        money.amount_line(F.lead("line", 1).over(order)),
        money.amount_line(F.lead("line", 2).over(order)),
    )
    match = line.rlike(pattern) & (F.lit(True) if but is None else ~line.rlike(but))
    return lines.withColumn("found", F.when(match, found)).groupBy("statement_id").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("line_no"))).alias(name))


def ladder(lines: DataFrame, ladders: dict[str, list[tuple[str, str | None]]], keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """One column per name: the first label of its ladder that has an amount. All labels are read in one pass over the lines of each key."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    line = F.col("line")
    flags = {
        f"{name}_{k}": line.rlike(pattern) & (F.lit(True) if but is None else ~line.rlike(but))
        for name, steps in ladders.items()
        for k, (pattern, but) in enumerate(steps)
    }
    hit = reduce(lambda x, y: x | y, [F.col(f) for f in flags])
    rows = lines.withColumns(flags).withColumn("hit", hit)
    scan = F.col("scan") if "scan" in lines.columns else money.scan_money(line)
    rows = rows.withColumns({"scan": F.when(F.col("hit"), scan), "alone": money.amount_line(line)})
    own = F.coalesce(money.last_of(F.filter("scan", lambda m: m["dollar"]))["cents"], money.last_of(F.col("scan"))["cents"])
    rows = rows.withColumn("found", F.when(F.col("hit"), F.coalesce(own, F.lead("alone", 1).over(order), F.lead("alone", 2).over(order))))
    aggregates = [F.min_by("found", F.when(F.col(f) & F.col("found").isNotNull(), F.col("line_no"))).alias(f) for f in flags]
    columns = [F.coalesce(*[f"{name}_{k}" for k in range(len(steps))]).alias(name) for name, steps in ladders.items()]
    return rows.groupBy(*keys).agg(*aggregates).select(*keys, *columns)


def bank_totals(lines: DataFrame, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """sum_credits_c, sum_debits_c: the printed totals of bank lines."""
    return ladder(lines, {"sum_credits_c": [(p, None) for p in P.BANK_TOTAL_CREDITS], "sum_debits_c": [(p, None) for p in P.BANK_TOTAL_DEBITS]}, keys)


def card_balances(lines: DataFrame) -> DataFrame:
    """opening_c, closing_c, sum_credits_c, sum_debits_c of card statements by their labels."""
    close = [(p, P.CARD_CLOSING_NOT) for p in P.CARD_CLOSING]
    out = ladder(
        lines,
        {
            "opening_c": [(p, None) for p in P.CARD_OPENING],
            "closing_c": close,
            "payments": [(P.CARD_PAYMENTS, P.PAYMENT_NOT)],
            "purchases": [(P.CARD_PURCHASES, None)],
            "interest": [(P.CARD_INTEREST, None)],
            "credits": [(p, P.PAYMENT_NOT) for p in P.CARD_TOTAL_CREDITS],
            "debits": [(p, None) for p in P.CARD_TOTAL_DEBITS],
        },
    )
    parts = F.when(F.col("purchases").isNotNull() | F.col("interest").isNotNull(), F.coalesce("purchases", F.lit(0)) + F.coalesce("interest", F.lit(0)))
    return out.select("statement_id", "opening_c", "closing_c", F.coalesce("credits", "payments").alias("sum_credits_c"), F.coalesce("debits", parts).alias("sum_debits_c"))


def bank_balances(lines: DataFrame) -> DataFrame:
    """opening_c (first), closing_c (last), sum_credits_c, sum_debits_c of bank statements."""
    marked = scanned(lines)
    ends = marked.groupBy("statement_id").agg(
        F.min_by("b.cents", F.when(F.col("b.kind") == "opening", F.col("line_no"))).alias("opening_c"),
        F.max_by("b.cents", F.when(F.col("b.kind") == "closing", F.col("line_no"))).alias("closing_c"),
    )
    return ends.join(growing(bank_totals(lines)), "statement_id")


def interest_and_fees(lines: DataFrame) -> DataFrame:
    """statement_id, line_no, amount_c of the current period's non-zero interest and fee lines."""
    line = F.col("line")
    value = F.abs(money.last_of(money.money_values(line)))
    keep = line.rlike(P.FEE_ITEM) & ~line.rlike(P.YEAR_TO_DATE) & ~line.rlike("(?i)total (?:fees|interest) (?:for this period|charged)") & ~F.contains(line, F.lit("%"))
    return lines.where(keep).select("statement_id", "line_no", value.alias("amount_c")).where("amount_c >= 1")


def scope_block(lines: DataFrame) -> DataFrame:
    """The lines of the one account block that clearly has the most transactions; all lines where none does.

    Blocks start at opening balances. A block is chosen if the next best has at most a quarter of its transaction lines.
    """
    order = Window.partitionBy("statement_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("block", F.sum(F.col("line").rlike(P.ANCHOR).cast("int")).over(order))
    rows = scanned(rows.withColumn("several", F.max("block").over(Window.partitionBy("statement_id")) >= 2))
    n = F.size("scan")
    rows = rows.withColumn("tx", F.when(F.col("several"), ((n >= 2) | ((n >= 1) & F.col("token").isNotNull())).cast("int")).otherwise(0))
    counts = rows.where("block > 0").groupBy("statement_id", "block").agg(F.sum("tx").alias("tx"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc("tx"), "block")))
    top = ranked.groupBy("statement_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("block"))).alias("chosen"),
        F.max(F.when(F.col("rank") == 1, F.col("tx"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("tx"))).alias("second"),
        F.max("block").alias("blocks"),
    )
    top = top.where("blocks >= 2 and first > 0 and second * 4 <= first").select("statement_id", "chosen")
    out = rows.join(growing(top), "statement_id", "left")
    return out.where("chosen is null or block = chosen").withColumn("scoped", F.col("chosen").isNotNull())


def parse_line(rows: DataFrame) -> DataFrame:
    """The line parser: date, description, debit_c, credit_c, balance_c, confidence of dated money lines.

    With two amounts or more the last is the balance and the one before it the amount. A negative amount is a debit, then
    wording decides, then debit is assumed with less confidence.
    """
    line = F.trim("line")
    rows = scanned(rows).withColumnRenamed("scan", "m")
    rows = rows.where(F.col("token").isNotNull() & (F.size("m") > 0) & F.col("b").isNull())
    date = dates.normalize_date(F.col("token"), F.col("year") if "year" in rows.columns else None)
    end = F.position(F.col("token"), line) + F.length("token")
    after = F.substr(line, end, F.length(line))
    head = F.coalesce(F.split_part(after, F.try_element_at(money.scan_money(after), F.lit(1))["text"], F.lit(1)), after)
    several = F.size("m") >= 2
    amount = F.when(several, F.element_at("m", -2)["cents"]).otherwise(F.element_at("m", 1)["cents"])
    direction = F.when(amount < 0, "debit").otherwise(text.direction_from_words(line))
    description = text.clean_description(head)
    lost = F.when(direction.isNull(), 30).otherwise(0) + F.when(description == "", 20).otherwise(0) + F.when(date.rlike(r"\d{4}"), 0).otherwise(10)
    return rows.select(
        "statement_id", "line_no", date.alias("date"), description.alias("description"),
        F.when(F.coalesce(direction, F.lit("debit")) == "debit", F.abs(amount)).alias("debit_c"),
        F.when(direction == "credit", F.abs(amount)).alias("credit_c"),
        F.when(several, F.element_at("m", -1)["cents"]).alias("balance_c"),
        (F.greatest(F.lit(30), F.least(F.lit(95), 90 - lost)) / 100).alias("confidence"),
    )


def page_texts(lines: DataFrame) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("statement_id", "page").agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("text"), F.max("line_no").alias("last_line"))


def meaningful_pages(lines: DataFrame) -> DataFrame:
    """statement_id, page of the pages with at least two lines that hold both a date and money."""
    tx = F.col("line").rlike(P.PAGE_DATE) & F.col("line").rlike(P.PAGE_MONEY)
    return lines.groupBy("statement_id", "page").agg(F.count_if(tx).alias("n")).where("n >= 2").select("statement_id", "page")


def preview_limit(lines: DataFrame, processed: int) -> DataFrame:
    """Whether a preview of the first pages leaves out meaningful ones, and why."""
    tx = F.col("line").rlike(P.PAGE_DATE) & F.col("line").rlike(P.PAGE_MONEY)
    pages = lines.groupBy("statement_id", "page").agg((F.count_if(tx) >= 2).alias("good"))
    out = pages.groupBy("statement_id").agg(
        F.max("page").alias("pages"), F.count_if("good").alias("meaningful"), F.count_if(F.col("good") & (F.col("page") > processed)).alias("skipped")
    )
    cut = F.col("pages") > processed
    reason = F.when(~cut, "no-truncation").when(F.col("skipped") > 0, "skipped-meaningful-pages").otherwise("skipped-pages-not-meaningful")
    return out.select("statement_id", "meaningful", F.when(cut, F.col("skipped")).otherwise(0).alias("skipped"), reason.alias("reason"))


def page_classes(pages: DataFrame) -> DataFrame:
    """transactions, summary, legal and warning flags of pages; the last two only without the first two."""
    t = F.col("text")
    tx, summary = t.rlike(P.PAGE_HEADER), t.rlike(P.PAGE_SUMMARY)
    plain = ~tx & ~summary
    return pages.select("statement_id", "page", tx.alias("transactions"), summary.alias("summary"), (plain & t.rlike(P.PAGE_LEGAL)).alias("legal"), (plain & t.rlike(P.PAGE_WARNING)).alias("warning"))


def evidence_lines(lines: DataFrame, limit: int = EVIDENCE_LINES) -> DataFrame:
    """The first lines with two amounts, or with one and a date."""
    n = F.size(money.money_values(F.col("line")))
    keep = lines.where((n >= 2) | ((n >= 1) & dates.find_date(F.col("line")).isNotNull()))
    rank = F.row_number().over(Window.partitionBy("statement_id").orderBy("line_no"))
    return keep.withColumn("rank", rank).where(F.col("rank") <= limit)


def category_context(lines: DataFrame) -> DataFrame:
    """Whether any line of a statement declares a category column."""
    line = F.col("line")
    declared = line.rlike(P.CATEGORY_HEADER) | (line.rlike(P.CATEGORY_WORD) & line.rlike(r"(?i)\bdescription\b") & line.rlike(P.CATEGORY_BESIDE))
    return lines.groupBy("statement_id").agg(F.bool_or(declared).alias("category_column"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(transactions(spark, sf_dir))


def _sheets(spark: SparkSession, sf_dir: str, pages: int = 1) -> DataFrame:
    """Each page (or run of pages) of the statements as a statement of its own, so that kinds and profiles vary."""
    number = F.col("statement_id") * 1000 + F.floor((F.col("page") - 1) / pages)
    return _lines(spark, sf_dir).withColumn("statement_id", number.cast("long"))


def _flags(classes) -> object:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lines(spark, sf_dir).select("statement_id", "line_no", *[c.alias(n) for n, c in classes(F.col("line")).items()])

    return run


def m(pattern: str, column: str = "line") -> str:
    """SQL for a match anywhere."""
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def count_sql(column: str, patterns: tuple[str, ...]) -> str:
    return " + ".join(f"CAST({m(p, column)} AS INT)" for p in patterns)


# SQL of the shapes: how many amounts each has and which number is the last, as text_lines writes them.
def _shape_list(test) -> str:
    return ", ".join(str(k) for k, s in enumerate(SHAPES) if test(s)) or "-1"


SHEETS = "sheets AS (SELECT * REPLACE (CAST(statement_id * 1000 + page - 1 AS BIGINT) AS statement_id) FROM lines)"
SHEETS3 = "sheets AS (SELECT * REPLACE (CAST(statement_id * 1000 + (page - 1) // 3 AS BIGINT) AS statement_id) FROM lines)"
TEXTS = "txt AS (SELECT statement_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY statement_id)"
PAGES = "pg AS (SELECT statement_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY statement_id, page)"
KIND = f"CASE WHEN {m(P.CARD_STRONG, 'lower(text)')} OR {count_sql('lower(text)', P.CARD_WEAK)} >= 2 THEN 'credit-card' WHEN {m(P.BANK_WORDS, 'lower(text)')} THEN 'bank-account' ELSE 'unknown' END"

_header_sql = f"({m(P.CARD_HEADER[0], 'lower(line)')} OR {m(P.CARD_HEADER[1], 'lower(line)')} OR ({m('\\btransaction\\b', 'lower(line)')} AND {m('\\bposting\\b', 'lower(line)')}) OR ({m('trans(?:\\.|action)? date', 'lower(line)')} AND {m('post(?:ing)? date', 'lower(line)')}))"
_ref_sql = "(regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^\\d{12,}$') AND line NOT LIKE '%$%')"
_foreign_sql = f"({m(P.FOREIGN_WORDS)} OR {m(P.FOREIGN_START)} OR ({m(P.FOREIGN_CODE)} AND {m(P.FOREIGN_RATE)}))"
LINES_ALL = (TX_SQL, LINES_SQL)
_tx_line = f"({m(P.PAGE_DATE)} AND {m(P.PAGE_MONEY)})"

#: Amounts that text_lines writes into a shape, as SQL: [(sign, unit)] in order; fixed ones in cents.
_LISTS = {k: ["-amount_c" if "-${a}" in s or "({a})" in s else "amount_c"] * s.count("{a}") for k, s in enumerate(SHAPES)}
_LISTS[11] = ["1200"]  # the foreign-currency line; its rate has three decimals
_LISTS[16] = ["125", "amount_c"]  # the fee rate, then the fee
_MONEY_SQL = "CASE shape " + " ".join(f"WHEN {k} THEN [{', '.join(f'CAST({x} AS BIGINT)' for x in v)}]" for k, v in _LISTS.items() if v) + " ELSE CAST([] AS BIGINT[]) END"

QUERIES = {
    "split_lines": (
        lambda s, d: split_lines(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.max("line_no").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max_by("line", "line_no").alias("last_line")),
        """SELECT doc_id, CAST(max(n) AS INT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, arg_max(line, n) AS last_line
FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
      FROM (SELECT doc_id, pos, trim(parts[pos]) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts, unnest(generate_series(1, len(regexp_split_to_array(text, '\\r?\\n')))) AS pos FROM documents)) WHERE line <> '')
GROUP BY doc_id""",
    ),
    "statement_kind": (
        lambda s, d: marks(_sheets(s, d), KIND_PATTERNS).select("statement_id", statement_kind(has_mark).alias("kind")),
        sql(*LINES_ALL, SHEETS, TEXTS.replace("FROM lines", "FROM sheets"), select=f"SELECT statement_id, {KIND} AS kind FROM txt"),
    ),
    "document_kind": (
        lambda s, d: table(s, d, "documents").groupBy(statement_kind(has_in(F.col("text"))).alias("kind"), layout_family(has_in(F.col("text"))).alias("family")).agg(F.count(F.lit(1)).alias("n")),
        f"""SELECT {KIND} AS kind, CASE WHEN ({m('withdrawals?', 'lower(text)')} AND {m('deposits?', 'lower(text)')}) OR ({count_sql('lower(text)', P.BANK_FAMILY)} >= 2 AND {count_sql('lower(text)', P.BANK_FAMILY)} >= {count_sql('lower(text)', P.CARD_FAMILY)}) THEN 'bank-account-table'
 WHEN {count_sql('lower(text)', P.CARD_FAMILY)} >= 2 THEN 'credit-card-table' WHEN {count_sql('lower(text)', P.BANK_FAMILY)} >= 1 THEN 'bank-account-table' ELSE 'unknown' END AS family, count(*) AS n FROM documents GROUP BY ALL""",
    ),
    "layout_family": (
        lambda s, d: marks(_sheets(s, d), FAMILY_PATTERNS).select("statement_id", layout_family(has_mark).alias("family")),
        sql(*LINES_ALL, SHEETS, TEXTS.replace("FROM lines", "FROM sheets"), select=f"""
, sc AS (SELECT statement_id, lower(text) AS low, {count_sql('lower(text)', P.CARD_FAMILY)} AS card, {count_sql('lower(text)', P.BANK_FAMILY)} AS bank FROM txt)
SELECT statement_id, CASE WHEN ({m('withdrawals?', 'low')} AND {m('deposits?', 'low')}) OR (bank >= 2 AND bank >= card) THEN 'bank-account-table'
  WHEN card >= 2 THEN 'credit-card-table' WHEN bank >= 1 THEN 'bank-account-table' ELSE 'unknown' END AS family FROM sc"""),
    ),
    "profile_rank": (
        lambda s, d: best_profile(marks(_sheets(s, d), KIND_PATTERNS + PROFILE_PATTERNS), has_mark),
        sql(*LINES_ALL, SHEETS, TEXTS.replace("FROM lines", "FROM sheets"), select=f"""
, k AS (SELECT *, {KIND} AS kind FROM txt), p AS ("""
            + " UNION ALL ".join(f"SELECT statement_id, kind, {pos} AS pos, '{name}' AS name, '{of}' AS of, {count_sql('text', marks)} AS hits FROM k" for pos, (name, of, marks) in enumerate(P.PROFILES))
            + """), r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY hits DESC, pos) AS n FROM p WHERE kind = 'unknown' OR kind = of)
SELECT statement_id, CASE WHEN hits > 0 THEN name WHEN kind = 'credit-card' THEN 'generic-credit-card' WHEN kind = 'bank-account' THEN 'generic-bank-account' ELSE 'unknown' END AS profile,
  hits, CASE WHEN hits > 0 THEN least(10, 5 + 2 * hits) WHEN kind = 'unknown' THEN 1 ELSE 3 END AS confidence_tenths FROM r WHERE n = 1"""),
    ),
    "card_line_classes": (
        _flags(card_classes),
        sql(*LINES_ALL, select=f"""
SELECT statement_id, line_no, {_header_sql} AS header, {m(P.CARD_IGNORE)} AS ignored, {m(P.CARD_REMITTANCE)} AS remittance, {m(P.CARD_REMITTANCE_NEAR)} AS remittance_near,
  {m(P.CARD_SPEND_REPORT)} AS spend_report, {m(P.CARD_SUMMARY_LABEL)} AS summary_label, {m(P.CARD_HARD_STOP)} AS hard_stop, {m(P.CARD_SOFT_STOP)} AS soft_stop,
  {_ref_sql} AS reference, {_foreign_sql} AS "foreign", {m(P.YEAR_TO_DATE)} AS year_to_date FROM lines"""),
    ),
    "bank_line_classes": (
        _flags(bank_classes),
        sql(*LINES_ALL, select=f"""
SELECT statement_id, line_no, {m(P.BANK_START)} AS starts, {m(P.BANK_STOP)} AS stops, {m(P.BANK_SUMMARY_ROW)} AS summary_row, {m(P.BANK_ITEMIZED)} AS itemized,
  {m(P.BANK_IGNORE)} AS ignored, {m(P.ANCHOR)} AS anchor FROM lines"""),
    ),
    "card_sections": (
        lambda s, d: _lines(s, d).select("statement_id", "line_no", card_section(F.col("line")).alias("section")).where("section is not null"),
        sql(*LINES_ALL, select=f"""
, s AS (SELECT statement_id, line_no, lower(trim(line)) AS low FROM lines), c AS (
SELECT statement_id, line_no, CASE WHEN {m('(new charges|charges and credits|purchases|cash advances?)', 'low')} OR {m('^(your )?interest\\b', 'low')} OR {m('^(fees|service charges?)\\b', 'low')} THEN 'debit'
  WHEN ({m('^(your )?payments?\\b', 'low')} AND NOT {m('due|minimum', 'low')}) OR {m('^(your )?credits?\\b', 'low')} OR {m('payments?\\s*(?:&|and)\\s*credits', 'low')} THEN 'credit' END AS section FROM s)
SELECT * FROM c WHERE section IS NOT NULL"""),
    ),
    "category_context": (
        lambda s, d: category_context(_sheets(s, d)),
        sql(*LINES_ALL, SHEETS, select=f"SELECT statement_id, bool_or({m(P.CATEGORY_HEADER)} OR ({m(P.CATEGORY_WORD)} AND {m('(?i)\\bdescription\\b')} AND {m(P.CATEGORY_BESIDE)})) AS category_column FROM sheets GROUP BY statement_id"),
    ),
    "meaningful_pages": (
        lambda s, d: meaningful_pages(_lines(s, d)),
        sql(*LINES_ALL, select=f"SELECT statement_id, page FROM lines GROUP BY statement_id, page HAVING count(*) FILTER (WHERE {_tx_line}) >= 2"),
    ),
    "preview_limit": (
        lambda s, d: preview_limit(_lines(s, d), 6),
        sql(*LINES_ALL, select=f"""
, p AS (SELECT statement_id, page, count(*) FILTER (WHERE {_tx_line}) >= 2 AS good FROM lines GROUP BY statement_id, page),
q AS (SELECT statement_id, max(page) AS pages, count(*) FILTER (WHERE good) AS meaningful, count(*) FILTER (WHERE good AND page > 6) AS skipped FROM p GROUP BY statement_id)
SELECT statement_id, meaningful, CASE WHEN pages > 6 THEN skipped ELSE 0 END AS skipped,
  CASE WHEN pages <= 6 THEN 'no-truncation' WHEN skipped > 0 THEN 'skipped-meaningful-pages' ELSE 'skipped-pages-not-meaningful' END AS reason FROM q"""),
    ),
    "page_classes": (
        lambda s, d: page_classes(page_texts(_lines(s, d))),
        sql(*LINES_ALL, PAGES, select=f"""
, f AS (SELECT statement_id, page, {m(P.PAGE_HEADER, 'text')} AS t, {m(P.PAGE_SUMMARY, 'text')} AS s, {m(P.PAGE_LEGAL, 'text')} AS l, {m(P.PAGE_WARNING, 'text')} AS w FROM pg)
SELECT statement_id, page, t AS transactions, s AS summary, NOT t AND NOT s AND l AS legal, NOT t AND NOT s AND w AS warning FROM f"""),
    ),
    "money_scan_roundtrip": (
        lambda s, d: _lines(s, d).select("statement_id", "line_no", money.money_values(F.col("line")).alias("v")).select("statement_id", "line_no", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_c"), money.last_of(F.col("v")).alias("last_c")),
        sql(*LINES_ALL, select=f"""
, v AS (SELECT statement_id, line_no, {_MONEY_SQL} AS v FROM lines)
SELECT statement_id, line_no, CAST(len(v) AS INT) AS n, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS total_c, v[len(v)] AS last_c FROM v"""),
    ),
    "page_signals": (
        lambda s, d: _lines(s, d).groupBy("statement_id", "page").agg(
            F.count_if(F.size(money.money_values(F.col("line"))) > 0).alias("money_lines"), F.count_if(dates.find_date(F.col("line")).isNotNull()).alias("date_lines"), F.bool_or(F.col("line").rlike(P.PAGE_HEADER)).alias("header")),
        sql(*LINES_ALL, select=f"""
SELECT statement_id, page, count(*) FILTER (WHERE len({_MONEY_SQL}) > 0) AS money_lines, count(*) FILTER (WHERE shape IN ({_shape_list(lambda s: '{d}' in s or 'APR' in s)})) AS date_lines,
  bool_or({m(P.PAGE_HEADER)}) AS header FROM lines GROUP BY statement_id, page"""),
    ),
    "balance_lines": (
        lambda s, d: _lines(s, d).select("statement_id", "line_no", balance_line(F.col("line")).alias("b")).where("b is not null").select("statement_id", "line_no", "b.kind", "b.cents"),
        sql(*LINES_ALL, select=f"""
SELECT statement_id, line_no, CASE WHEN {m(P.OPENING_LABEL, 'lower(line)')} THEN 'opening' ELSE 'closing' END AS kind, amount_c AS cents
FROM lines WHERE ({m(P.OPENING_LABEL, 'lower(line)')} OR {m(P.CLOSING_LABEL, 'lower(line)')}) AND len({_MONEY_SQL}) > 0"""),
    ),
    "labeled_balances": (
        lambda s, d: card_balances(_lines(s, d)).join(bank_balances(_lines(s, d)).select("statement_id", F.col("opening_c").alias("bank_opening_c"), F.col("closing_c").alias("bank_closing_c"), F.col("sum_credits_c").alias("bank_credits_c")), "statement_id").select("statement_id", "opening_c", "closing_c", "bank_opening_c", "bank_closing_c", "bank_credits_c"),
        sql(*LINES_ALL, select=f"""
, v AS (SELECT statement_id, line_no, line, shape, {_MONEY_SQL} AS v FROM lines),
pick AS (SELECT statement_id,
  coalesce(arg_min(v[len(v)], line_no) FILTER (WHERE shape = 19), arg_min(v[len(v)], line_no) FILTER (WHERE shape = 2)) AS opening_c,
  coalesce(arg_min(v[len(v)], line_no) FILTER (WHERE shape = 25), arg_min(v[len(v)], line_no) FILTER (WHERE shape = 10)) AS closing_c,
  arg_min(v[len(v)], line_no) FILTER (WHERE shape IN (2, 19, 24)) AS bank_opening_c,
  arg_max(v[len(v)], line_no) FILTER (WHERE shape IN (3, 25)) AS bank_closing_c,
  arg_min(v[len(v)], line_no) FILTER (WHERE shape = 12) AS bank_credits_c
  FROM v GROUP BY statement_id)
SELECT * FROM pick"""),
    ),
    "interest_fee_lines": (
        lambda s, d: interest_and_fees(_lines(s, d)),
        sql(*LINES_ALL, select=f"""
SELECT statement_id, line_no, abs(({_MONEY_SQL})[-1]) AS amount_c FROM lines
WHERE {m(P.FEE_ITEM)} AND NOT {m(P.YEAR_TO_DATE)} AND NOT {m('(?i)total (?:fees|interest) (?:for this period|charged)')} AND line NOT LIKE '%\\%%' ESCAPE '\\' AND len({_MONEY_SQL}) > 0 AND amount_c >= 1"""),
    ),
    "section_scope": (
        lambda s, d: scope_block(_sheets(s, d, 3)).groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_lines"), F.bool_or("scoped").alias("scoped")),
        sql(*LINES_ALL, SHEETS3, select=f"""
, r AS (SELECT *, sum(CAST({m(P.ANCHOR)} AS INT)) OVER (PARTITION BY statement_id ORDER BY line_no) AS block,
   CAST(len({_MONEY_SQL}) >= 2 OR (len({_MONEY_SQL}) >= 1 AND shape IN ({_shape_list(lambda s: '{d}' in s or 'APR' in s)})) AS INT) AS tx FROM sheets),
c AS (SELECT statement_id, block, sum(tx) AS tx FROM r WHERE block > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY tx DESC, block) AS n, max(block) OVER (PARTITION BY statement_id) AS blocks FROM c),
t AS (SELECT a.statement_id, a.block AS chosen FROM k a JOIN k b ON a.statement_id = b.statement_id AND a.n = 1 AND b.n = 2 WHERE a.blocks >= 2 AND a.tx > 0 AND b.tx * 4 <= a.tx)
SELECT r.statement_id, count(*) AS n_lines, bool_or(chosen IS NOT NULL) AS scoped FROM r LEFT JOIN t USING (statement_id) WHERE chosen IS NULL OR block = chosen GROUP BY r.statement_id"""),
    ),
    "evidence_lines": (
        lambda s, d: evidence_lines(_lines(s, d)).select("statement_id", "line_no", "rank"),
        sql(*LINES_ALL, select=f"""
, k AS (SELECT statement_id, line_no, row_number() OVER (PARTITION BY statement_id ORDER BY line_no) AS rank FROM lines
  WHERE len({_MONEY_SQL}) >= 2 OR (len({_MONEY_SQL}) >= 1 AND shape IN ({_shape_list(lambda s: '{d}' in s or 'APR' in s)})))
SELECT statement_id, line_no, CAST(rank AS INT) AS rank FROM k WHERE rank <= 400"""),
    ),
    "fee_formula_roundtrip": (
        lambda s, d: _lines(s, d).where(money.fee_total(F.col("line")).isNotNull()).select("statement_id", "line_no", money.fee_total(F.col("line")).alias("fee_c"), text.strip_fee_formula(F.regexp_replace("line", r" [\d,]+\.\d{2}$", "")).alias("label")),
        sql(*LINES_ALL, select="SELECT statement_id, line_no, CAST(250 AS BIGINT) AS fee_c, 'Regular transaction fee' AS label FROM lines WHERE shape = 16"),
    ),
}
