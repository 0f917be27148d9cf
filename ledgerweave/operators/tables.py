"""Readings of positioned statements: one of each headed table, one of each run of tables that go on, one without a header.

They compete with the text readings: a reading is keyed by statement and cand_no, its rows and its balances are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import growing, materialised
from . import layout, lines, statements
from .evidence import day_first

#: Numbers of readings: tables come in their order, then runs of tables, both before the text readings, as ties go to the first.
TABLE_BASE, RUN_BASE = -(1 << 30), -(1 << 29)
# Lines above a header that belong to its table's texts, and those searched for an opening balance.
TEXT_LINES, BALANCE_LINES, ACCOUNT_LINES = 10, 8, 4
NEW_ACCOUNT, NOT_NEW = r"(?i)\b(opening|beginning) balance\b", r"(?i)balance forward"


def headless(visual: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, columns) of statements without any header, in the form of headed ones; the header stands above the first line."""
    rest = visual.join(growing(heads.select("statement_id").distinct()), "statement_id", "left_anti")
    found = materialised(layout.headerless_columns(rest), "columns")
    balance = F.bool_or(F.col("meaning") == "balance")
    kind = F.when(balance, "bank-account").otherwise("credit-card")
    each = F.sort_array(F.collect_list(F.struct("center", "meaning")))  # six columns at most
    table = found.groupBy("statement_id").agg(kind.alias("kind"), (F.min("first") - 1).alias("line_no"), (F.max("last") + 1).alias("end"), each.alias("columns"))
    return table.select("statement_id", "line_no", F.lit(1).cast("long").alias("region"), "kind", "columns", "end")


def tables_of(visual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, body): each table with its header's line, end (the line after its last), columns, reason and group of `stitch`;
    and the lines below its header."""
    heads = materialised(layout.headed(visual), "heads")
    marked = materialised(layout.marked_regions(visual, heads).where("region > 0").drop("items"), "marked")
    ends = marked.groupBy("statement_id", "region").agg(
        F.coalesce(F.min(F.when(F.col("stopped"), F.col("line_no"))), F.max("line_no") + 1).alias("end"), F.bool_or("stopped").alias("stopped"), F.min_by("page", "line_no").alias("page"),
    )
    near = heads.select("statement_id", "region", F.explode(F.sequence("line_no", F.col("line_no") + ACCOUNT_LINES - 1)).alias("line_no"))
    fresh = near.join(growing(visual.where(F.col("text").rlike(NEW_ACCOUNT) & ~F.col("text").rlike(NOT_NEW)).select("statement_id", "line_no")), ["statement_id", "line_no"])
    fresh = fresh.select("statement_id", "region", F.lit(True).alias("opening")).distinct()
    tables = heads.join(growing(ends), ["statement_id", "region"]).join(growing(fresh), ["statement_id", "region"], "left").withColumn("opening", F.coalesce("opening", F.lit(False)))
    # what lies between a table's end and the next header begins with a stop line, which is a barrier
    barrier = F.coalesce(F.lag("stopped").over(Window.partitionBy("statement_id").orderBy("region")), F.lit(False))
    joined = layout.stitch(tables.select("statement_id", F.col("region").alias("pos"), "page", "kind", "columns", barrier.alias("barrier"), "opening"))
    tables = tables.select("statement_id", "region", "line_no", "kind", "columns", "end").join(growing(joined.select("statement_id", F.col("pos").alias("region"), "reason", "relaxed", "group", F.lit(True).alias("headed"))), ["statement_id", "region"])
    bare = headless(visual, heads).withColumns({"reason": F.lit(None).cast("string"), "relaxed": F.lit(False), "group": F.lit(1).cast("long"), "headed": F.lit(False)})
    tables = materialised(tables.unionByName(bare.select(tables.columns)), "tables")
    below = visual.join(growing(marked.where("not heads and not stopped").select("statement_id", "line_no", "region")), ["statement_id", "line_no"])
    spans = bare.select("statement_id", "line_no", "end")
    plain = visual.join(growing(spans.select("statement_id", F.col("line_no").alias("first"), "end")), "statement_id").where("line_no > first and line_no < end").drop("first", "end")
    return tables, below.unionByName(plain.withColumn("region", F.lit(1).cast("long")))


def above(visual: DataFrame, tables: DataFrame, n: int) -> DataFrame:
    """statement_id, region, line_no, text of the n lines above each header."""
    near = tables.select("statement_id", "region", F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") - 1)).alias("line_no"))
    return near.join(growing(visual.select("statement_id", "line_no", "text")), ["statement_id", "line_no"])


def region_facts(visual: DataFrame, tables: DataFrame, body: DataFrame, known: DataFrame) -> DataFrame:
    """What is known of each table: year, context, day_first, category_column, opening_c, closing_c, sum_credits_c, sum_debits_c.

    A bank table's balances are those printed in it; an opening balance may stand a few lines above its header. Day first is
    the period's order, else what the table's own dates prove. known: statement_id, year, context.
    """
    keys = ["statement_id", "region"]
    head = tables.select(*keys, "line_no").join(growing(visual.select("statement_id", "line_no", "text")), ["statement_id", "line_no"])
    inner = body.select(*keys, "line_no", "text").unionByName(head.select(*keys, "line_no", "text"))
    texts = materialised(inner.unionByName(above(visual, tables, TEXT_LINES).select(*keys, "line_no", "text")).withColumn("b", lines.balance_line(F.col("text"))), "texts")
    placed = texts.where("b is not null").join(growing(tables.select(*keys, F.col("line_no").alias("head"))), keys)
    opens, inside = F.col("b.kind") == "opening", F.col("line_no") >= F.col("head")
    near = ~inside & (F.col("line_no") >= F.col("head") - BALANCE_LINES)
    ends = placed.groupBy(*keys).agg(
        F.min_by("b.cents", F.when(opens & inside, F.col("line_no"))).alias("own_c"), F.max_by("b.cents", F.when(opens & near, F.col("line_no"))).alias("above_c"),
        F.max_by("b.cents", F.when(~opens & inside, F.col("line_no"))).alias("closing_c"),
    )
    votes = day_first(texts, keys, "text").withColumnRenamed("day_first", "proved")
    totals = lines.bank_totals(texts.withColumnRenamed("text", "line"), tuple(keys))
    has = F.exists("columns", lambda c: c["meaning"] == "category")
    out = tables.select(*keys, "kind", has.alias("category_column")).join(growing(known.select("statement_id", "year", "context")), "statement_id", "left")
    out = out.join(growing(ends), keys, "left").join(growing(votes), keys, "left").join(growing(totals), keys, "left")
    return out.select(
        *keys, "kind", "year", "context", F.coalesce(F.col("context.day_first"), F.col("proved"), F.lit(False)).alias("day_first"), "category_column",
        F.coalesce("own_c", "above_c").alias("opening_c"), "closing_c", "sum_credits_c", "sum_debits_c",
    )


def run_totals(visual: DataFrame, runs: DataFrame) -> DataFrame:
    """statement_id, group, sum_credits_c, sum_debits_c over the lines of each run (statement_id, group, line_no, end), those above its header included."""
    order = Window.partitionBy("statement_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = runs.select("statement_id", "line_no", "group", "end")
    within = visual.select("statement_id", "line_no", "text").join(growing(starts), ["statement_id", "line_no"], "left")
    within = within.withColumns({"group": F.last("group", ignorenulls=True).over(order), "end": F.last("end", ignorenulls=True).over(order)}).where("line_no < end")
    over = above(visual, runs.withColumnRenamed("group", "region"), TEXT_LINES).withColumnRenamed("region", "group")
    texts = within.select("statement_id", "group", "line_no", "text").unionByName(over.select("statement_id", "group", "line_no", "text"))
    return lines.bank_totals(texts.withColumnRenamed("text", "line"), ("statement_id", "group"))


def placed_readings(visual: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, balances) of all readings of positioned statements, keyed by statement_id and cand_no.

    A table reads as it stands: with its own balances, and its last running balance as the closing one only where it is the
    statement's sole table (a part of a longer one would seem to reconcile). A run of tables takes the opening balance of
    its first and the closing one of its last table, or its last running balance. Card balances and totals are those of the
    whole statement. Tables without rows read as nothing and are no part of a run.
    """
    tables, body = tables_of(visual)
    facts = materialised(region_facts(visual, tables, body, known), "regions")
    rows = materialised(layout.region_rows(layout.cells(body, layout.column_list(tables)), facts.drop("kind", "closing_c", "sum_credits_c", "sum_debits_c")), "placed")
    keys = ["statement_id", "region"]
    built = rows.groupBy(*keys).agg(F.max_by("balance_c", F.when(F.col("balance_c").isNotNull(), F.col("seq"))).alias("last_c"))
    sole = F.count(F.lit(1)).over(Window.partitionBy("statement_id")) == 1
    every = tables.select(*keys, "line_no", "end", "group", sole.alias("sole")).join(growing(facts), keys).join(growing(built), keys)
    every = materialised(every, "readings")
    seen = visual.select("statement_id", "line_no", F.col("text").alias("line")).join(growing(every.where("kind = 'credit-card'").select("statement_id").distinct()), "statement_id", "left_semi")
    card = lines.card_balances(seen)
    card = card.withColumn("opening_c", statements.open_close(F.col("opening_c"), F.col("closing_c"), F.col("sum_credits_c"), F.col("sum_debits_c")))
    one = every.select(
        "statement_id", (F.col("region") + TABLE_BASE).cast("int").alias("cand_no"), "kind", "opening_c",
        F.coalesce("closing_c", F.when(F.col("sole"), F.col("last_c"))).alias("closing_c"), "sum_credits_c", "sum_debits_c",
    )
    runs = every.groupBy("statement_id", "group").agg(
        F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"), F.min("line_no").alias("line_no"), F.max("end").alias("end"),
        F.min_by("opening_c", "region").alias("opening_c"), F.max_by("closing_c", "region").alias("printed_c"), F.max_by("last_c", F.when(F.col("last_c").isNotNull(), F.col("region"))).alias("last_c"),
    ).where("n > 1")
    runs = materialised(runs, "runs")
    totals = run_totals(visual, runs.where("kind = 'bank-account'"))
    many = runs.join(growing(totals), ["statement_id", "group"], "left").select(
        "statement_id", (F.col("group") + RUN_BASE).cast("int").alias("cand_no"), "kind", "opening_c", F.coalesce("printed_c", "last_c").alias("closing_c"), "sum_credits_c", "sum_debits_c",
    )
    balances = one.unionByName(many)
    names = ("opening_c", "closing_c", "sum_credits_c", "sum_debits_c")
    whole = card.select("statement_id", *[F.col(c).alias(f"card_{c}") for c in names])
    pick = lambda c: F.when(F.col("kind") == "credit-card", F.col(f"card_{c}")).otherwise(F.col(c)).alias(c)
    balances = balances.join(growing(whole), "statement_id", "left").select("statement_id", "cand_no", *map(pick, names))
    member = every.join(growing(runs.select("statement_id", "group")), ["statement_id", "group"]).select(*keys, (F.col("group") + RUN_BASE).cast("int").alias("cand_no"))
    own = rows.withColumn("cand_no", (F.col("region") + TABLE_BASE).cast("int"))
    return own.unionByName(rows.join(growing(member), keys).select(own.columns)), balances


COUNTERS = (
    "visual_lines", "most_items", "heading_lines", "most_meanings", "anchor_only", "value_only", "tables", "relaxed_headings", "stacked_headers", "headless_tables", "runs", "run_tables", "rejected", "relaxed_joins",
)


def probe(visual: DataFrame, tables: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Why tables were found or not: counters of each statement, and reasons (a map of how often a table went on no longer).

    visual: lines of `visual_lines`, tables: of `tables_of`. Numbers only, no text. An observation gets the sums over all
    statements (the largest for most_items and most_meanings) while the result is written, without another scan.
    """
    c = F.col
    key = ["statement_id"]
    words = layout.headings(visual)
    anchor, value = layout.has_any("columns", layout.ANCHORS), layout.has_any("columns", layout.VALUES)
    found = words.groupBy(*key).agg(
        F.count_if(F.size("columns") > 0).alias("heading_lines"), F.max(F.size("columns")).alias("most_meanings"), F.count_if(anchor & ~value).alias("anchor_only"), F.count_if(value & ~anchor).alias("value_only"),
        F.sum(F.when(~c("stacked"), c("relaxed")).otherwise(0)).alias("relaxed_headings"), F.count_if("stacked").alias("stacked_headers"),
    )
    groups = tables.groupBy(*key, "group").agg(F.count(F.lit(1)).alias("n"), F.count_if("headed").alias("headed"), F.count_if(~c("headed")).alias("bare"), F.count_if(c("reason").isNotNull()).alias("no"), F.count_if("relaxed").alias("relaxed"))
    runs = groups.groupBy(*key).agg(
        F.sum("headed").alias("tables"), F.sum("bare").alias("headless_tables"), F.count_if(c("n") > 1).alias("runs"), F.sum(F.when(c("n") > 1, c("n")).otherwise(0)).alias("run_tables"),
        F.sum("no").alias("rejected"), F.sum("relaxed").alias("relaxed_joins"),
    )
    why = tables.where("reason is not null").groupBy(*key, "reason").agg(F.count(F.lit(1)).alias("n"))
    why = why.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))  # five reasons
    out = visual.groupBy(*key).agg(F.count(F.lit(1)).alias("visual_lines"), F.max(F.size("items")).alias("most_items"))
    out = out.join(growing(found), key, "left").join(growing(runs), key, "left").join(growing(why), key, "left")
    out = out.select(*key, *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in COUNTERS], F.coalesce("reasons", F.create_map().cast("map<string,bigint>")).alias("reasons"))
    if observation is None:
        return out
    whole = [(F.max if name.startswith("most_") else F.sum)(name).alias(name) for name in COUNTERS]
    return materialised(out.observe(observation, *whole), "probe")
