"""Tables from positioned text: visual lines, header columns, cells by column bounds, rows, clusters and stitching.

Items are (statement_id, page, item_seq, str, x, y, width), y growing upwards.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions import patterns as P
from ..session import growing, materialised
from ..sources.derived import TX_SQL, sql, transactions
from .builders import amount_text
from .ledger import fold
from .lines import balance_line

# Tolerances in points, and header wordings in order.
LINE_TOLERANCE, ZONE_TOLERANCE, ALIGN, ANCHOR_ALIGN = 2.2, 18.0, 30.0, 50.0
HEADERS = (
    ("postDate", r"posting date|post date|post\.? date"),
    ("date", r"transaction date|trans\.? date|tran\.? date|date"),
    ("description", r"activity description|transaction details|description|details|particulars|merchant|payee"),
    ("debit", r"cheque\s*/?\s*debit|chq\s*/?\s*debit|withdrawals?|amounts?\s+debited|debits?|payments?\s*/?\s*debits?|charges?\s*/?\s*debits?"),
    ("credit", r"deposits?\s*/?\s*credits?|amounts?\s+credited|deposits?|credits?"),
    ("amount", r"amount\s*\(\s*\$\s*\)|amount\s*\$|amount"),
    ("balance", r"running balance|balance"),
    ("category", r"spend categor(?:y|ies)|merchant categor(?:y|ies)|transaction categor(?:y|ies)|categor(?:y|ies)"),
    ("reference", r"reference(?:\s*(?:number|no\.?|#))?|ref(?:erence)?\.?\s*(?:no\.?|#)|ref\.?\s*#?"),
    ("type", r"transaction type|trans\.? type|tran\.? type|type"),
    ("metadata", r"rewards?|reward (?:points?|indicator)|points?|points? earned|card\s*(?:number|no\.?|#)|account\s*(?:number|no\.?|#)|budget|difference|year[-\s]?to[-\s]?date|ytd"),
)
#: A word that some heading has: a line without any is no header.
HEADING = "date|description|details|particulars|merchant|payee|cheque|chq|withdraw|debit|deposit|credit|payment|charge|amount|balance|categor|ref|type|reward|point|card|account|budget|difference|year|ytd"
OPTIONAL = ("category", "postDate", "reference", "type", "metadata")
MAX_HEADER_ITEMS = 4
STOP = r"(?i)important (?:information about your account|account information)|how to (?:reach|contact) us|trade ?-?marks?|closing notice|protecting your|interest rate chart|time to pay"
BARRIER = STOP + r"|payment slip|remittance|please pay|amount past due|total payment enclosed"
# Details of foreign amounts under a row of a positioned table. Any currency code counts beside a rate or a digit.
FOREIGN_DETAIL = r"(?i)foreign currenc|exchange rate|currency conversion|conversion rate"
FOREIGN_NAME, FOREIGN_BESIDE = r"(?i)\b(usd|eur|gbp|aud|jpy|mxn|cad)\b", r"(?i)@|exchange|rate|\d"
CURRENCY_TAIL = re.compile(r"\s*[:•·]+\s*$|\s*\(\s*(?:\$|cad|usd|c\$|us\$)\s*\)\s*$|\s+(?:cad|usd|c\$|us\$)\s*$")


def line_classes(line: Column) -> dict[str, Column]:
    """Flags of a positioned line: a stop ends its table, a barrier parts two tables, ignored lines are furniture or summaries,
    foreign and reference lines are details of the row above."""
    return {
        "stop": line.rlike(STOP),
        "barrier": line.rlike(BARRIER),
        "ignored": line.rlike(P.TABLE_IGNORE) | balance_line(line).isNotNull(),
        "foreign": line.rlike(FOREIGN_DETAIL) | (line.rlike(FOREIGN_NAME) & line.rlike(FOREIGN_BESIDE)),
        "reference": F.regexp_replace(line, r"\s", "").rlike(r"^\d{8,}$"),
    }


def structured(items: DataFrame) -> DataFrame:
    """Items with text and a place."""
    return items.where((F.trim("str") != "") & F.col("x").isNotNull() & F.col("y").isNotNull())


def with_lines(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """line_y: the height of the line an item joins, which is the first line made whose first item lies within the tolerance.

    A page's heights are folded in order into those that open a line. An item's line is then the first of these in its
    reach: it opened one itself where none was made before, and lines made later stand behind.
    """
    rows = structured(items)
    page = rows.groupBy("statement_id", "page").agg(F.array_sort(F.collect_list(F.struct("item_seq", *[c for c in rows.columns if c not in ("statement_id", "page", "item_seq")]))).alias("i"))
    near = lambda line, y: F.abs(line - y) <= tolerance
    opened = F.aggregate("i", F.array().cast("array<double>"), lambda lines, i: F.when(F.exists(lines, lambda line: near(line, i["y"])), lines).otherwise(F.array_append(lines, i["y"])))
    each = page.withColumn("opened", opened).select("statement_id", "page", "opened", F.explode("i").alias("i")).select("statement_id", "page", "opened", "i.*")
    return each.withColumn("line_y", F.element_at(F.filter("opened", lambda line: near(line, F.col("y"))), 1)).drop("opened").select(*rows.columns, "line_y")


def visual_lines(items: DataFrame) -> DataFrame:
    """statement_id, line_no (pages up, heights down), page, line_y, items by x, text."""
    rows = with_lines(items).groupBy("statement_id", "page", "line_y").agg(F.array_sort(F.collect_list(F.struct("x", "item_seq", "width", "str"))).alias("items"))
    rows = rows.withColumn("text", text.clean_space(F.array_join("items.str", " "))).where("text <> ''")
    order = Window.partitionBy("statement_id").orderBy("page", F.desc("line_y"))
    return rows.withColumn("line_no", F.row_number().over(order))


def header_match(label: str) -> tuple[str | None, bool]:
    """(the meaning of a header text, whether it shows only without what stands at its end: a currency or a colon)."""
    raw = low = re.sub(r"\s+", " ", label.lower()).strip()
    for _ in range(3):
        low = CURRENCY_TAIL.sub("", low).strip()
    name, pattern = next(((n, p) for n, p in HEADERS if re.fullmatch(p, low)), (None, ""))
    return name, name is not None and low != raw and not re.fullmatch(pattern, raw)


def header_meaning(label: str) -> str | None:
    return header_match(label)[0]


ANCHORS, VALUES = ("date", "description"), ("amount", "debit", "credit", "balance")


def has_any(columns: str, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.col(columns)["meaning"], F.array(*map(F.lit, names)))


def headings(lines: DataFrame) -> DataFrame:
    """Lines with a heading's word: the columns (meaning, center) that they head by x, one per meaning, how many headings
    show only without a currency or colon (relaxed), and whether a line is the lower (stacked) or upper one of a header on
    two lines, the columns of which are both.

    Up to four neighbouring items are read together, the most first. Two lines of a page are one header where each has
    headings and both together more than either.
    """
    item = pa.struct([("center", pa.float64()), ("meaning", pa.string())])

    def columns_of(items: list[dict]) -> tuple[list[dict], int]:
        found, at, relaxed = {}, 0, 0
        while at < len(items):
            took = 1
            for n in range(min(MAX_HEADER_ITEMS, len(items) - at), 0, -1):
                part = items[at : at + n]
                meaning, bare = header_match(" ".join(i["str"] for i in part))
                relaxed += bare
                if meaning and meaning not in found:
                    found[meaning] = (part[0]["x"] + part[-1]["x"] + (part[-1]["width"] or 0)) / 2
                    took = n
                    break
            at += took
        return [{"center": c, "meaning": m} for m, c in sorted(found.items(), key=lambda f: f[1])], relaxed

    def run(batches):
        for batch in batches:
            read = [[columns_of(i or []) for i in column.to_pylist()] for column in batch.columns[2:4]]
            made = [[columns for columns, _ in each] for each in read]
            both = [columns_of(sorted([*a, *b], key=lambda i: i["x"]))[0] if a and one and two else [] for a, b, one, two in zip(*[c.to_pylist() for c in batch.columns[2:4]], *made, strict=True)]
            columns = [pa.array(m, pa.list_(item)) for m in (*made, both)]
            relaxed = pa.array([n for _, n in read[1]], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, relaxed], ["statement_id", "line_no", "above", "columns", "both", "relaxed"])

    word = F.lower("text").rlike(HEADING)
    order = Window.partitionBy("statement_id", "page").orderBy("line_no")
    before = F.when(F.lag(word).over(order), F.lag("items").over(order))
    likely = lines.select("statement_id", "line_no", before.alias("above"), "items", word.alias("word")).where("word").drop("word")
    kind = "array<struct<center:double,meaning:string>>"
    out = likely.mapInArrow(run, f"statement_id long, line_no int, above {kind}, columns {kind}, both {kind}, relaxed int")
    order = Window.partitionBy("statement_id").orderBy("line_no")
    stacked = is_header("both") & (F.size("both") > F.size("columns")) & (F.size("both") > F.size("above"))
    out = out.withColumn("stacked", F.coalesce(stacked, F.lit(False)))
    # the lower line of a pair heads the table, and a line already taken as a lower one is no upper one
    out = out.withColumn("stacked", F.col("stacked") & ~((F.lag("line_no").over(order) == F.col("line_no") - 1) & F.coalesce(F.lag("stacked").over(order), F.lit(False))))
    upper = (F.lead("line_no").over(order) == F.col("line_no") + 1) & F.lead("stacked").over(order)
    return out.withColumn("upper", F.coalesce(upper, F.lit(False))).drop("above")


def is_header(columns: str) -> Column:
    """A header has a date or description and a value column."""
    return (F.size(columns) >= 2) & has_any(columns, ANCHORS) & has_any(columns, VALUES)


def header_columns(lines: DataFrame) -> DataFrame:
    """Lines that head a table, with columns (meaning, center) by x; of a header on two lines the lower one."""
    out = headings(lines)
    return out.where(F.col("stacked") | (~F.col("upper") & is_header("columns"))).select("statement_id", "line_no", F.when(F.col("stacked"), F.col("both")).otherwise(F.col("columns")).alias("columns"))


def kind_of(meanings: Column) -> Column:
    has = lambda m: F.array_contains(meanings, m)
    return (
        F.when((has("debit") | has("credit")) & ~has("amount"), "bank-account").when(has("postDate"), "credit-card").when(has("balance"), "bank-account").when(has("amount"), "credit-card").otherwise("bank-account")
    )


def bounds(columns: DataFrame, keys: list[str]) -> DataFrame:
    """lo and hi of columns (keys, meaning, center): halfway to the neighbours; the outer ones are open."""
    order = Window.partitionBy(*keys).orderBy("center")
    lo, hi = (F.lag("center").over(order) + F.col("center")) / 2, (F.lead("center").over(order) + F.col("center")) / 2
    return columns.withColumns({"lo": F.coalesce(lo, F.lit(float("-inf"))), "hi": F.coalesce(hi, F.lit(float("inf")))})


def marked_regions(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines with their region's number (0 before the first header), whether they head it, and whether a stop came before or on them."""
    order = Window.partitionBy("statement_id").orderBy("line_no")
    marked = lines.join(growing(headers.select("statement_id", "line_no", F.lit(True).alias("heads"))), ["statement_id", "line_no"], "left")
    marked = marked.withColumn("heads", F.coalesce("heads", F.lit(False)))
    marked = marked.withColumn("region", F.coalesce(F.sum(F.col("heads").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    within = Window.partitionBy("statement_id", "region").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("stopped", F.max(F.col("text").rlike(STOP) & ~F.col("heads")).over(within))


def regions(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines below a header up to the next one or a stop line, with their region's number."""
    return marked_regions(lines, headers).where("region > 0 and not heads and not stopped")


def cells(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per line with its text and the text of each meaning: an item belongs to the column its center falls into.

    The ranges of a region's few columns are joined to its lines, which hold their items. columns: statement_id, region, kind, meaning, center.
    """
    names = [m for m, _ in HEADERS]
    b = bounds(columns, ["statement_id", "region"]).groupBy("statement_id", "region", "kind")
    b = b.agg(*[F.max(F.when(F.col("meaning") == m, F.struct("lo", "hi"))).alias(f"at_{m}") for m in names])
    rows = lines.select("statement_id", "region", "line_no", "text", "items").join(growing(b), ["statement_id", "region"])

    def held(m: str) -> Column:
        center = lambda i: i["x"] + F.coalesce(i["width"], F.lit(0.0)) / 2
        found = F.filter("items", lambda i: (center(i) >= F.col(f"at_{m}.lo")) & (center(i) < F.col(f"at_{m}.hi")))
        return F.when(F.col(f"at_{m}").isNotNull(), found)

    rows = rows.withColumns({f"in_{m}": held(m) for m in names})
    cell = lambda m: F.when(F.size(f"in_{m}") > 0, text.clean_space(F.array_join(F.col(f"in_{m}")["str"], " ")))
    return rows.select("statement_id", "region", "kind", "line_no", "text", *[cell(m).alias(m) for m in names])


def with_cell_money(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """For each new name a struct(cents, negative) of a cell's last amount: its size, and whether it has a minus, parentheses or CR behind it."""
    last = {f"last_{new}": money.last_of(money.scan_money(F.col(cell))) for new, cell in columns.items()}
    rows = rows.withColumns(last)

    def read(new: str, cell: str) -> Column:
        found = F.col(f"last_{new}")
        behind = F.split_part(F.col(cell), found["text"], F.lit(-1))
        return F.when(found.isNotNull(), F.struct(F.abs(found["cents"]).alias("cents"), (found["negative"] | behind.rlike(r"(?i)\bcr\b")).alias("negative")))

    return rows.withColumns({new: read(new, cell) for new, cell in columns.items()}).drop(*last)


def with_cell_date(rows: DataFrame, cell: str, new: str) -> DataFrame:
    """new: the first date of a cell: a whole date, else a date in it, else its first day and month in the statement's order
    and year (year, context and day_first are columns of rows)."""
    raw, year, context = F.col(cell), F.col("year"), F.col("context")
    rows = rows.withColumn("full", dates.normalize_date(raw, year))
    part = F.col("full").isNull()  # most cells are a whole date
    rows = rows.withColumns({"token": F.when(part, dates.find_date(raw)), "pair": F.when(part, F.nullif(F.regexp_extract(raw, r"\b(\d{1,2}[/-]\d{1,2})\b", 1), F.lit("")))})
    known = context.isNotNull() | F.col("day_first").isNotNull()
    order = F.coalesce("day_first", context["day_first"], F.lit(False))
    bare = F.when(known, dates.resolve_day_month(F.col("pair"), context, order, year)).otherwise(dates.day_month_date(F.col("pair"), year))
    return rows.withColumn(new, F.coalesce("full", dates.normalize_date(F.col("token"), year), bare)).drop("full", "token", "pair")


#: What is known of a statement beside its positioned items.
CONTEXT = "struct<start_year:int,start_month:int,end_year:int,end_month:int,crosses_year:boolean,day_first:boolean>"
FACTS = f"statement_id long, year int, context {CONTEXT}, day_first boolean, opening_c long, category_column boolean"


def region_rows(grid: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Rows of tables, from the cells of their lines (statement_id, region, kind, line_no, text, one column per meaning).

    A line with an amount in a money column is a row. Wording before it belongs to it if it starts with a date (or nothing
    was built yet), else to the row above. Furniture and summaries are passed over and end such wording; details of foreign
    amounts and reference numbers are left out, as are amounts outside the money columns. Single amounts are credits by
    sign or CR, on bank tables by a rise of the balance (the opening balance first), on card tables by payment wording.
    A zero amount is a row only with a date or a balance, and never as a fee or interest item; where its balance doesn't move,
    it takes the side that the table's rows of the same wording have by theirs. A fee formula's total replaces its rate. Bank rows take the last date; card rows need a date or wording of their own.
    A card row's category is its cell, else a spend category at the end of its wording (an ambiguous one only where the table
    has a category column). facts are given by statement, or by statement and region.
    """
    known = grid.sparkSession.createDataFrame([], FACTS) if facts is None else facts
    rows = grid.join(growing(known), ["statement_id", *(["region"] if "region" in known.columns else [])], "left")
    flat = Window.partitionBy("statement_id", "region").orderBy("line_no")
    upto, before = flat.rowsBetween(Window.unboundedPreceding, 0), flat.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("statement_id", "region", "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    card, line = F.col("kind") == "credit-card", F.col("text")
    rows = with_cell_date(with_cell_money(rows, {"d": "debit", "c": "credit", "a": "amount", "b": "balance"}), "date", "own")
    classes, none = line_classes(line), F.coalesce("d", "c", "a").isNull()  # lines with an amount need no more
    rows = rows.withColumns(
        {
            "ignored": classes["ignored"],
            "detail": none & (classes["foreign"] | classes["reference"]),
            "words": F.coalesce("description", F.lit("")),
            "money": none & (F.size(money.scan_money(line)) > 0),
            "fee_c": money.fee_total(line),
        }
    )
    # written: the windows below read these columns again and again
    rows = materialised(rows.drop("date", "description", "debit", "credit", "amount", "balance"), "cells")
    rows = rows.withColumn("has", ~F.col("ignored") & F.coalesce("d", "c", "a").isNotNull())
    rows = rows.where(F.col("has") | F.col("ignored") | ~F.col("detail"))
    rows = rows.withColumn("group", F.coalesce(F.sum((F.col("has") | F.col("ignored")).cast("int")).over(before), F.lit(0)))
    loose, stray = ~F.col("has") & ~F.col("ignored"), F.col("money") & F.col("fee_c").isNull()
    built_before = F.coalesce(F.max(F.col("has") & (F.col("own").isNotNull() | ~card)).over(before), F.lit(False))
    starts = loose & (F.col("words") != "") & ~stray & (F.col("own").isNotNull() | ~built_before | F.col("fee_c").isNotNull())
    rows = rows.withColumns({"built_before": built_before, "starts": starts})
    rows = rows.withColumn("open", F.max("starts").over(group))
    pending = loose & F.col("open") & (F.col("words") != "")
    dated = loose & F.col("own").isNotNull() & (F.col("open") | ~stray)
    # a group is the wording before one line with an amount: gathered once and joined to that line
    rows = materialised(rows.withColumn("wording", F.when(pending, F.col("words"))).withColumn("dated", F.when(dated, F.col("own"))), "wording")
    keys = ["statement_id", "region", "group"]
    gathered = rows.where("wording is not null or dated is not null").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("wording").isNotNull(), F.struct("line_no", "wording"))))["wording"].alias("ahead"),
        F.max_by("dated", F.when(F.col("dated").isNotNull(), F.col("line_no"))).alias("ahead_date"), F.lit(True).alias("has"),
    )
    rows = rows.join(growing(gathered), [*keys, "has"], "left").withColumn("ahead", F.coalesce("ahead", F.array().cast("array<string>")))
    alone = F.col("own").isNull() & F.col("ahead_date").isNull() & (F.size("ahead") == 0)
    rows = rows.withColumn("posts", F.col("has") & ~(card & alone))
    carried = F.last(F.when(F.col("posts"), F.col("own")), ignorenulls=True).over(before)
    last_c = F.last(F.when(F.col("posts"), F.col("b.cents")), ignorenulls=True).over(before)
    rows = rows.withColumns({"day": F.coalesce("own", "ahead_date", F.when(~card, carried), F.lit("")), "before_c": F.coalesce(last_c, "opening_c")})
    head = text.clean_description(F.concat_ws(" ", "ahead", F.nullif("words", F.lit(""))))
    rows = rows.withColumn("head", head).withColumn("split", F.when(card & (F.coalesce("category", F.lit("")) == ""), text.split_category(F.col("head"), F.coalesce("category_column", F.lit(False)))))
    rows = rows.withColumns({"head": F.coalesce("split.description", "head"), "label": F.coalesce(F.nullif("category", F.lit("")), "split.category", F.lit(""))})
    by_balance = ~card & F.col("b").isNotNull() & F.col("before_c").isNotNull()
    credit = F.when(by_balance, F.col("b.cents") > F.col("before_c")).otherwise(F.col("a.negative") | (card & F.col("head").rlike(P.TABLE_CREDIT)))
    sides = (~card & F.coalesce("d", "c").isNotNull()) | F.col("a").isNull()
    still = by_balance & ~sides & (F.col("a.cents") == 0) & (F.col("b.cents") == F.col("before_c"))
    moved = F.when(by_balance & ~sides & ~still, F.when(credit, 1).otherwise(-1))
    debit_c = F.when(sides, F.when(~card | F.col("d").isNotNull(), F.col("d.cents"))).when(~credit, F.col("a.cents"))
    credit_c = F.when(sides, F.when(~card | F.col("d").isNull(), F.col("c.cents"))).when(credit, F.col("a.cents"))
    rows = rows.withColumns({"debit_c": debit_c, "credit_c": credit_c, "still": F.coalesce(still, F.lit(False)), "moved": moved})
    size = F.greatest(F.coalesce("debit_c", F.lit(0)), F.coalesce("credit_c", F.lit(0)))
    rates = F.transform(F.regexp_extract_all(line, F.lit(money.FEE_CLAUSE), F.lit(2)), lambda r: money.cents(r.try_cast("double")))
    fee = ~card & F.coalesce(F.col("fee_c") > 0, F.lit(False))
    fixed = fee & ((size == 0) | (F.array_contains(rates, size) & (size != F.col("fee_c"))))
    plain = text.strip_fee_formula(F.col("head"))
    rows = rows.withColumns(
        {
            "debit_c": F.when(fixed, F.col("fee_c")).when(money.has_amount(F.col("debit_c")) | ~money.has_amount(F.col("credit_c")), F.col("debit_c")),
            "credit_c": F.when(~fixed & (money.has_amount(F.col("credit_c")) | F.col("debit_c").isNull()), F.col("credit_c")),
            "head": F.when(fee & (plain != ""), plain).otherwise(F.col("head")),
        }
    )
    amount = F.coalesce("debit_c", "credit_c")
    shown = (F.col("own").isNotNull() | F.col("ahead_date").isNotNull() | F.col("b").isNotNull()) & ~F.col("head").rlike(P.FEE_ITEM)
    rows = rows.withColumn("built", F.col("posts") & amount.isNotNull() & ((amount != 0) | shown))
    rows = rows.withColumn("row", F.sum(F.col("built").cast("int")).over(upto))
    wraps = loose & ~F.col("open") & F.col("built_before") & (F.col("words") != "") & F.col("own").isNull() & ~stray
    # so are the lines that go on with a row's wording
    rows = materialised(rows.withColumn("wrap", F.when(wraps, F.col("words"))), "built")
    behind = rows.where("wrap is not null").groupBy("statement_id", "region", "row").agg(F.array_sort(F.collect_list(F.struct("line_no", "wrap")))["wrap"].alias("behind"))
    rows = rows.where("built").join(growing(behind), ["statement_id", "region", "row"], "left")
    alike = F.sum("moved").over(Window.partitionBy("statement_id", "region", "head"))
    rises = F.coalesce(F.col("still") & (alike > 0), F.lit(False))
    rows = rows.withColumns({"debit_c": F.when(~rises, F.col("debit_c")), "credit_c": F.when(rises, F.col("debit_c")).otherwise(F.col("credit_c"))})
    rows = rows.withColumn("described", text.clean_description(F.concat_ws(" ", F.nullif("head", F.lit("")), F.coalesce("behind", F.array().cast("array<string>")))))
    described = F.col("described")
    sure = F.lit(0.92) - F.when(F.col("day") == "", 0.1).otherwise(0.0) - F.when(described == "", 0.2).otherwise(0.0)
    return rows.select(
        "statement_id", "region", F.row_number().over(Window.partitionBy("statement_id").orderBy("line_no")).alias("seq"), F.col("day").alias("date"),
        described.alias("description"), "debit_c", "credit_c", F.col("b.cents").alias("balance_c"), F.round(sure, 2).alias("confidence"), "kind", F.col("label").alias("category"),
    )


def coordinate_rows(items: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Transactions of all headed tables of positioned statements; facts (see FACTS) where they are known."""
    return table_rows(materialised(visual_lines(items), "visual"), facts)


def headed(lines: DataFrame) -> DataFrame:
    """The header of each table: statement_id, line_no, region, kind, columns."""
    order = Window.partitionBy("statement_id").orderBy("line_no")
    return header_columns(lines).withColumns({"region": F.row_number().over(order).cast("long"), "kind": kind_of(F.col("columns.meaning"))})


def column_list(tables: DataFrame) -> DataFrame:
    return tables.select("statement_id", "region", "kind", F.explode("columns").alias("k")).select("statement_id", "region", "kind", "k.meaning", "k.center")


def table_rows(lines: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    heads = headed(lines)
    return region_rows(cells(regions(lines, heads), column_list(heads)), facts)


def cluster(values: DataFrame, tolerance: float = ZONE_TOLERANCE) -> DataFrame:
    """Zones (key, zone, center, count) of values: in order, a value joins the last zone if it lies within the tolerance of
    that zone's running mean, else it opens one. A fold over sorted values."""

    def step(zone, row):
        if zone is None or row["value"] - zone[1] / zone[2] > tolerance:
            zone = ((zone[0] if zone else 0) + 1, 0.0, 0)
        zone = (zone[0], zone[1] + row["value"], zone[2] + 1)
        return zone, {"zone": zone[0]}

    placed = fold(values, "key", ["value"], lambda r: None, step, "zone int")
    return placed.groupBy("key", "zone").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


# Items that are an amount or a date alone, lines needed, and the shares of them that make a zone a column.
MONEY_ITEM = r"^\(?\$?\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?-?\)?$|^\(?\$?\s?\d+\.\d{2}-?\)?$"
DATE_ITEM = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})$"
LEAST_LINES, MONEY_SHARE, DATE_SHARE, MOST_ZONES = 4, 0.4, 0.5, 3


def transaction_like(lines: DataFrame) -> DataFrame:
    """Lines before a stop that hold an amount and a date or wording, with the centers of their amounts and date."""
    order = Window.partitionBy("statement_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    centers = lambda pattern: F.transform(F.filter("items", lambda i: F.trim(i["str"]).rlike(pattern)), lambda i: i["x"] + F.coalesce(i["width"], F.lit(0.0)) / 2)
    rows = lines.withColumns({"stopped": F.max(F.col("text").rlike(STOP)).over(order), "amounts": centers(MONEY_ITEM), "dated": F.try_element_at(centers(DATE_ITEM), F.lit(1))})
    worded = F.exists("items", lambda i: i["str"].rlike("[A-Za-z]{3,}"))
    return rows.where(~F.col("stopped") & (F.size("amounts") > 0) & (F.col("dated").isNotNull() | worded) & balance_line(F.col("text")).isNull())


def headerless_columns(lines: DataFrame) -> DataFrame:
    """statement_id, meaning, center, first and last line of tables without a header, from zones of amounts and dates.

    One zone of amounts is the amount, two are amount and balance, three debit, credit and balance; the wording lies between
    the dates and the first of them.
    """
    like = transaction_like(lines)
    size = like.groupBy("statement_id").agg(F.count(F.lit(1)).alias("lines_n"), F.min("line_no").alias("first"), F.max("line_no").alias("last")).where(F.col("lines_n") >= LEAST_LINES)
    key = F.col("statement_id").alias("key")
    zone = lambda v: cluster(v).select(F.col("key").alias("statement_id"), "n", (F.col("total") / F.col("n")).alias("center")).join(growing(size), "statement_id")
    amounts = zone(like.select(key, F.explode("amounts").alias("value"))).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("lines_n") * MONEY_SHARE)))
    rank = F.row_number().over(Window.partitionBy("statement_id").orderBy("center"))
    amounts = amounts.withColumns({"rank": rank, "zones": F.count(F.lit(1)).over(Window.partitionBy("statement_id"))}).where(F.col("zones") <= MOST_ZONES)
    names = F.when(F.col("zones") == 1, F.array(F.lit("amount"))).when(F.col("zones") == 2, F.array(F.lit("amount"), F.lit("balance"))).otherwise(F.array(F.lit("debit"), F.lit("credit"), F.lit("balance")))
    money_columns = amounts.select("statement_id", F.element_at(names, F.col("rank")).alias("meaning"), "center", "first", "last")
    days = zone(like.where("dated is not null").select(key, F.col("dated").alias("value"))).where(F.col("n") >= F.col("lines_n") * DATE_SHARE)
    days = days.groupBy("statement_id").agg(F.min("center").alias("center"))
    start = money_columns.groupBy("statement_id", "first", "last").agg(F.min("center").alias("money"))
    words = start.join(growing(days), "statement_id", "left").select("statement_id", F.lit("description").alias("meaning"), F.coalesce((F.col("center") + F.col("money")) / 2, F.col("money") / 2).alias("center"), "first", "last")
    dated = start.join(growing(days), "statement_id").select("statement_id", F.lit("date").alias("meaning"), "center", "first", "last")
    return money_columns.unionByName(words).unionByName(dated)


def headerless_rows(items: DataFrame, openings: DataFrame) -> DataFrame:
    """Rows of statements without a header; single amounts are credits where the balance rose above the one before
    (the opening balance first) and debits otherwise."""
    lines = materialised(visual_lines(items), "visual")
    found = materialised(headerless_columns(lines), "columns")
    span = found.select("statement_id", "first", "last").distinct()
    body = lines.join(growing(span), "statement_id").where("line_no between first and last").withColumn("region", F.lit(1).cast("long"))
    balance = F.max(F.col("meaning") == "balance").over(Window.partitionBy("statement_id"))
    kind = F.when(balance, "bank-account").otherwise("credit-card").alias("kind")
    columns = found.select("statement_id", F.lit(1).cast("long").alias("region"), kind, "meaning", "center")
    known = {c: F.lit(None).cast(t) for c, t in (("year", "int"), ("context", CONTEXT), ("day_first", "boolean"), ("category_column", "boolean"))}
    return region_rows(cells(body, columns), openings.select("statement_id", *[v.alias(c) for c, v in known.items()], "opening_c"))


def _headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of four columns (date, wording, amount, balance) without a header."""
    tx = transactions(spark, sf_dir)
    y = F.lit(740.0) - 14.0 * ((F.col("seq") - 1) % ROWS_PER_PAGE)
    item = lambda s, x, k: F.struct(s.alias("str"), F.lit(x).alias("x"), (F.length(s) * 5.2).cast("double").alias("width"), F.lit(k).alias("k"))
    parts = F.array(item(F.col("date"), 20.0, 0), item(F.col("event_type"), 120.0, 1), item(amount_text(F.col("amount_c")), 330.0, 2), item(amount_text(F.col("running_c")), 500.0, 3))
    items = tx.select("statement_id", F.floor((F.col("seq") - 1) / ROWS_PER_PAGE + 1).cast("int").alias("page"), F.explode(parts).alias("i"), y.alias("y"), "seq")
    items = items.select("statement_id", "page", (F.col("seq") * 10 + F.col("i.k")).cast("int").alias("item_seq"), "i.str", "i.x", "y", "i.width")
    openings = tx.groupBy("statement_id").agg(F.min("opening_c").alias("opening_c"))
    return headerless_rows(items, openings).select("statement_id", "seq", "date", "description", "debit_c", "credit_c", "balance_c")


def stitch(tables: DataFrame) -> DataFrame:
    """reason a table doesn't continue the one before it (null: it does), whether it does so for all but its optional columns
    only (relaxed), and the group it belongs to.

    tables: statement_id, pos, page, kind, columns array of (meaning, center), barrier, opening (text between them).
    """
    order = Window.partitionBy("statement_id").orderBy("pos")
    before = F.lag(F.struct("page", "kind", "columns")).over(order)
    t = tables.withColumn("p", before)
    names = lambda c: F.array_sort(F.transform(c, lambda x: x["meaning"]))
    core = lambda c: F.array_sort(F.filter(F.transform(c, lambda x: x["meaning"]), lambda m: ~m.isin(*OPTIONAL)))
    center = lambda c, m: F.try_element_at(F.filter(c, lambda x: x["meaning"] == m), F.lit(1))["center"]
    mine, theirs = F.col("columns"), F.col("p.columns")
    aligned = F.forall(mine, lambda x: F.coalesce(F.abs(F.try_element_at(F.filter(theirs, lambda y: y["meaning"] == x["meaning"]), F.lit(1))["center"] - x["center"]) <= ALIGN, F.lit(False)))
    strict = (names(mine) == names(theirs)) & aligned
    shape = lambda c: F.when(F.exists(c, lambda x: x["meaning"] == "amount"), "amount").when(F.exists(c, lambda x: x["meaning"].isin("debit", "credit")), "debit-credit").otherwise("none")
    described = F.exists(mine, lambda x: x["meaning"] == "description") & F.exists(theirs, lambda x: x["meaning"] == "description")
    same = (shape(mine) == shape(theirs)) & (shape(mine) != "none") & described & (core(mine) == core(theirs))
    far = F.coalesce(F.abs(center(mine, "date") - center(theirs, "date")) > ANCHOR_ALIGN, F.lit(False)) | F.coalesce(F.abs(center(mine, "description") - center(theirs, "description")) > ANCHOR_ALIGN, F.lit(False))
    gap = F.col("page") - F.col("p.page")
    reason = (
        F.when(F.col("p").isNull(), "first")
        .when(F.col("kind") != F.col("p.kind"), "kind-mismatch")
        .when(~strict & ~same, "columns-mismatch")
        .when(~strict & far, "centers-misaligned")
        .when((gap < 0) | (gap > 1), "page-gap")
        .when(F.col("barrier"), "hard-stop")
        .when((F.col("kind") == "bank-account") & F.col("opening"), "new-account")
    )
    t = t.withColumn("reason", reason).withColumn("relaxed", F.col("reason").isNull() & ~strict)
    return t.withColumn("group", F.sum(F.col("reason").isNotNull().cast("int")).over(order)).withColumn("reason", F.nullif("reason", F.lit("first")))


# Positioned statements written from events

PLACES = (("date", 40.0), ("description", 120.0), ("debit", 330.0), ("credit", 420.0), ("balance", 510.0))
TITLES = {"date": "Date", "description": "Description", "debit": "Withdrawals ($)", "credit": "Deposits", "balance": "Balance"}
ROWS_PER_PAGE = 40


def positioned(tx: DataFrame) -> DataFrame:
    """Items of transactions laid out in five columns, forty rows a page, a header on each; some wording wraps."""
    page = F.floor((F.col("seq") - 1) / ROWS_PER_PAGE + 1).cast("int")
    place = (F.col("seq") - 1) % ROWS_PER_PAGE
    y = (F.lit(740.0) - 14 * place).cast("double")
    item = lambda s, x, up, k: F.struct(s.alias("str"), F.lit(x).alias("x"), (y + up).alias("y"), F.greatest(F.lit(8.0), F.length(s) * 5.2).alias("width"), F.lit(k).alias("k"))
    money_at = lambda c, x, k: F.when(F.col(c).isNotNull(), item(amount_text(F.col(c)), x, 0.7, k))
    tx = tx.withColumn("shown_c", F.when(F.col("seq") % 3 != 1, F.col("running_c")))
    parts = F.array(
        F.when((F.col("seq") % 3 == 1) | (place == 0), item(F.col("date"), 20.0, 0.0, 0)), item(F.col("event_type"), 100.0, -0.6, 1), money_at("debit_c", 330.0, 2), money_at("credit_c", 425.0, 3), money_at("shown_c", 500.0, 4),
        F.when(F.col("seq") % 5 == 0, item(F.lit("of the account"), 100.0, -7.0, 5)),
    )
    body = tx.select("statement_id", page.alias("page"), F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("i"), (F.col("seq") * 10).alias("base"))
    body = body.select("statement_id", "page", (F.col("base") + F.col("i.k")).cast("int").alias("item_seq"), "i.str", "i.x", "i.y", "i.width")
    titles = F.array(*[F.struct(F.lit(TITLES[m]).alias("str"), F.lit(x).alias("x"), F.lit(k).alias("k")) for k, (m, x) in enumerate(PLACES)])
    head = tx.select("statement_id", page.alias("page")).distinct().select("*", F.explode(titles).alias("t"))
    head = head.select("statement_id", "page", F.col("t.k").cast("int").alias("item_seq"), "t.str", "t.x", F.lit(760.0).alias("y"), (F.length("t.str") * 5.2).cast("double").alias("width"))
    return head.unionByName(body)


def _coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinate_rows(positioned(transactions(spark, sf_dir))).select("statement_id", "seq", "date", "description", "debit_c", "credit_c", "balance_c")


def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_lines(positioned(transactions(spark, sf_dir))).groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("items")).alias("n_items"), F.max("page").alias("pages"))


def _assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items assigned to the columns of one header, by center."""
    items = positioned(transactions(spark, sf_dir)).where("y < 745").withColumn("c", F.col("x") + F.col("width") / 2)
    cols = spark.createDataFrame([(m, x + len(TITLES[m]) * 2.6) for m, x in PLACES], "meaning string, center double").withColumn("one", F.lit(1))
    b = bounds(cols, ["one"])
    return items.join(F.broadcast(b), (F.col("c") >= F.col("lo")) & (F.col("c") < F.col("hi"))).groupBy("statement_id", "meaning").agg(F.count(F.lit(1)).alias("n"))  # five fixed columns


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = transactions(spark, sf_dir).select(F.col("statement_id").alias("key"), (F.col("amount_c") % 60000).cast("double").alias("value"))
    return cluster(v, 150.0).select("key", "zone", F.col("total").cast("long").alias("total"), "n")


def _stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables derived from events: each event is a table of a user, with the layout its number implies."""
    n = F.col("row_no")
    col = lambda m, c: F.struct(F.lit(m).alias("meaning"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("center"))
    move = F.when(n % 7 == 0, 40.0).when(n % 11 == 0, 60.0).otherwise(0.0)
    base = F.array(col("date", F.lit(40.0) + move), col("description", F.lit(140.0)), col("amount", F.lit(430.0)))
    columns = F.when(n % 5 == 0, F.concat(base, F.array(col("category", F.lit(300.0))))).when(n % 13 == 0, F.array(col("date", 40.0), col("description", 140.0), col("debit", 430.0))).otherwise(base)
    t = transactions(spark, sf_dir).select("statement_id", "row_no", F.col("seq").alias("pos"), F.floor(F.col("seq") / 6 + (n % 17 == 0).cast("int") * 2).cast("int").alias("page"), F.when(n % 19 == 0, "bank-account").otherwise("credit-card").alias("kind"), columns.alias("columns"), (n % 23 == 0).alias("barrier"), (n % 29 == 0).alias("opening"))
    return stitch(t).select("row_no", "reason", F.col("group").alias("team"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [m for m, _ in HEADERS]
    bits = F.filter(F.array(*[F.when(F.expr(f"shiftright(event_id, {k}) & 1 = 1"), m) for k, m in enumerate(names)]), lambda m: m.isNotNull())
    from ..session import table

    return table(spark, sf_dir, "events").select("event_id", kind_of(bits).alias("kind"), F.array_join(F.array_sort(bits), ",").alias("signature"))


_CENTERS = {m: x + len(TITLES[m]) * 2.6 for m, x in PLACES}
QUERIES = {
    "visual_lines": (
        _visual,
        sql(TX_SQL, select="""
SELECT statement_id, count(*) + count(*) FILTER (WHERE seq % 5 = 0) + CAST(ceil(count(*) / 40) AS BIGINT) AS n_lines,
  CAST(sum(2 + CASE WHEN seq % 3 <> 1 THEN 1 ELSE 0 END + CASE WHEN seq % 3 = 1 OR (seq - 1) % 40 = 0 THEN 1 ELSE 0 END + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) + 5 * ceil(count(*) / 40) AS BIGINT) AS n_items,
  CAST(ceil(count(*) / 40) AS INT) AS pages FROM tx GROUP BY statement_id"""),
    ),
    "coord_roundtrip": (
        _coord,
        sql(TX_SQL, select="""
, d AS (SELECT *, (seq - 1) // 40 AS pg, CASE WHEN seq % 3 = 1 OR (seq - 1) % 40 = 0 THEN date END AS own FROM tx)
SELECT statement_id, seq, last_value(own IGNORE NULLS) OVER (PARTITION BY statement_id, pg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS date,
  event_type || CASE WHEN seq % 5 = 0 THEN ' of the account' ELSE '' END AS description, debit_c, credit_c, CASE WHEN seq % 3 <> 1 THEN running_c END AS balance_c FROM d"""),
    ),
    "headerless_roundtrip": (
        _headerless,
        sql(TX_SQL, select="SELECT statement_id, seq, date, event_type AS description, debit_c, credit_c, running_c AS balance_c FROM tx WHERE statement_id IN (SELECT statement_id FROM tx GROUP BY 1 HAVING count(*) >= 4)"),
    ),
    "assign_cells": (
        _assign,
        sql(TX_SQL, select="""
, s AS (SELECT *, format('{:,}', amount_c // 100) AS a, format('{:,}', running_c // 100) AS r FROM tx),
i AS (SELECT statement_id, 20.0 + greatest(8, 10 * 5.2) / 2 AS c FROM s WHERE seq % 3 = 1 OR (seq - 1) % 40 = 0 UNION ALL SELECT statement_id, 100.0 + greatest(8, length(event_type) * 5.2) / 2 FROM s
  UNION ALL SELECT statement_id, CASE WHEN debit_c IS NOT NULL THEN 330.0 ELSE 425.0 END + greatest(8, (length(a) + 3) * 5.2) / 2 FROM s
  UNION ALL SELECT statement_id, 500.0 + greatest(8, (length(r) + 3) * 5.2) / 2 FROM s WHERE seq % 3 <> 1 UNION ALL SELECT statement_id, 100.0 + 14 * 5.2 / 2 FROM s WHERE seq % 5 = 0)
SELECT statement_id, CASE """ + " ".join(f"WHEN c < {(_CENTERS[PLACES[k][0]] + _CENTERS[PLACES[k + 1][0]]) / 2} THEN '{PLACES[k][0]}'" for k in range(4)) + " ELSE 'balance' END AS meaning, count(*) AS n FROM i GROUP BY ALL"),
    ),
    "cluster_centers": (
        _clusters,
        "WITH RECURSIVE " + TX_SQL.strip() + """, v AS (SELECT statement_id AS key, CAST(amount_c % 60000 AS DOUBLE) AS value, row_number() OVER (PARTITION BY statement_id ORDER BY amount_c % 60000, row_no) AS n FROM tx),
f AS (SELECT key, n, 1 AS zone, value AS total, 1 AS k FROM v WHERE n = 1
  UNION ALL SELECT v.key, v.n, CASE WHEN v.value - f.total / f.k > 150 THEN f.zone + 1 ELSE f.zone END, CASE WHEN v.value - f.total / f.k > 150 THEN v.value ELSE f.total + v.value END, CASE WHEN v.value - f.total / f.k > 150 THEN 1 ELSE f.k + 1 END
  FROM f JOIN v ON v.key = f.key AND v.n = f.n + 1)
SELECT key, CAST(zone AS INT) AS zone, CAST(max(total) AS BIGINT) AS total, CAST(max(k) AS BIGINT) AS n FROM f GROUP BY key, zone""",
    ),
    "stitch_groups": (
        _stitch,
        sql(TX_SQL, select="""
, t AS (SELECT statement_id, row_no, seq AS pos, CAST(seq // 6 AS INT) + CASE WHEN row_no % 17 = 0 THEN 2 ELSE 0 END AS page, row_no % 19 = 0 AS bank, row_no % 5 = 0 AS cat, row_no % 5 <> 0 AND row_no % 13 = 0 AS deb,
   CASE WHEN row_no % 5 <> 0 AND row_no % 13 = 0 THEN 40.0 WHEN row_no % 7 = 0 THEN 80.0 WHEN row_no % 11 = 0 THEN 100.0 ELSE 40.0 END AS dc FROM tx),
p AS (SELECT *, lag(page) OVER w AS ppage, lag(bank) OVER w AS pbank, lag(cat) OVER w AS pcat, lag(deb) OVER w AS pdeb, lag(dc) OVER w AS pdc FROM t WINDOW w AS (PARTITION BY statement_id ORDER BY pos)),
r AS (SELECT *, CASE WHEN ppage IS NULL THEN 'first' WHEN bank <> pbank THEN 'kind-mismatch' WHEN deb <> pdeb THEN 'columns-mismatch'
  WHEN NOT (cat = pcat AND abs(dc - pdc) <= 30) AND abs(dc - pdc) > 50 THEN 'centers-misaligned' WHEN page < ppage OR page - ppage > 1 THEN 'page-gap' WHEN row_no % 23 = 0 THEN 'hard-stop' WHEN bank AND row_no % 29 = 0 THEN 'new-account' END AS reason FROM p)
SELECT row_no, nullif(reason, 'first') AS reason, CAST(sum(CAST(reason IS NOT NULL AS INT)) OVER (PARTITION BY statement_id ORDER BY pos) AS BIGINT) AS team FROM r"""),
    ),
    "column_kinds": (
        _kinds,
        """WITH b AS (SELECT event_id, list_filter([""" + ", ".join(f"CASE WHEN (event_id >> {k}) & 1 = 1 THEN '{m}' END" for k, (m, _) in enumerate(HEADERS)) + """], lambda x: x IS NOT NULL) AS m FROM events)
SELECT event_id, CASE WHEN (list_contains(m, 'debit') OR list_contains(m, 'credit')) AND NOT list_contains(m, 'amount') THEN 'bank-account' WHEN list_contains(m, 'postDate') THEN 'credit-card'
  WHEN list_contains(m, 'balance') THEN 'bank-account' WHEN list_contains(m, 'amount') THEN 'credit-card' ELSE 'bank-account' END AS kind, array_to_string(list_sort(m), ',') AS signature FROM b""",
    ),
}
