"""What a model is shown of a statement: one nested packet of figures and fixed words without any row's text, and the images to render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.derived import HEAD_SQL, TX_SQL, sql, transactions
from .statements import FACTS, _facts, meaningful, validate
from .transactions import EDITED, with_printed_balance

#: Balances of a packet: the first that the statement shows; how many there are is told beside them.
MOST_BALANCES = 400
# Where rows may and may not come from, pages with regions, regions with and without known pages, pages shown in full.
ALLOWED = ("transactions", "transactions-continued", "current-period-fees-interest")
EXCLUDED = ("summary", "totals", "balance-summary", "payment-summary", "remittance", "rewards", "points", "year-to-date", "legal", "warning", "marketing")
REGION_PAGES, MOST_REGIONS, MOST_PLAIN, MOST_FULL = 4, 8, 6, 5


def dollars(c: Column) -> Column:
    return (c / 100).cast("decimal(20,2)")


def evidence_packets(statements: DataFrame, rows: DataFrame, fees: DataFrame | None = None) -> DataFrame:
    """(statement_id, packet): JSON of validated statements (see `validate`) and the balances of their rows (statement_id, seq, balance_c).

    A packet holds the parser's figures as context, the detected balances (each once, in the order of rows; a card's opening
    balance by its totals among them), the printed totals, the side that a difference leaves open, and a card's expected
    section totals (fees: statement_id, fees_c, interest_c). It takes no column with a row's text, so none can get in.
    """
    c = F.col
    own = statements.select("statement_id", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), v.alias("balance_c")) for k, v in enumerate((
        c("opening_c"), c("closing_c"), c("sum_credits_c"), c("sum_debits_c"), F.when(c("mode") == "credit-card", c("closing_c") - c("sum_debits_c") + c("sum_credits_c"))
    ))])).alias("b")).select("statement_id", (c("b.seq") - 10).cast("long").alias("seq"), "b.balance_c")
    seen = own.unionByName(rows.select("statement_id", c("seq").cast("long").alias("seq"), "balance_c")).where("balance_c is not null")
    once = seen.groupBy("statement_id", "balance_c").agg(F.min("seq").alias("seq"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("statement_id").orderBy("seq", "balance_c")))
    kept = F.collect_list(F.when(c("rank") <= MOST_BALANCES, F.struct("rank", dollars(c("balance_c")).alias("b"))))
    balances = once.groupBy("statement_id").agg(F.transform(F.array_sort(kept), lambda x: x["b"]).alias("balances"), F.count(F.lit(1)).alias("n_balances"))
    s = statements.join(balances, "statement_id", "left")
    if fees is not None:
        s = s.join(fees, "statement_id", "left")
    else:
        s = s.withColumns({"fees_c": F.lit(None).cast("long"), "interest_c": F.lit(None).cast("long")})
    active = meaningful(c("sum_credits_c")) | meaningful(c("sum_debits_c"))
    quiet = (F.abs("total_credits_c") < 1) & (F.abs("total_debits_c") < 1)
    card = c("mode") == "credit-card"
    off = c("difference_c")
    side = F.when(F.coalesce(F.abs(off), F.lit(0)) >= 1, F.when(card == (off > 0), "credit").otherwise("debit"))
    money_of = lambda name: dollars(c(name))
    packet = F.struct(
        F.lit("full-reconstruction").alias("mode"), c("mode").alias("statementKind"), (active & (quiet | (c("n_rows") <= 1))).alias("parserLikelyMissedTransactions"),
        F.struct(c("n_rows").alias("rowCount"), money_of("total_credits_c").alias("totalCredits"), money_of("total_debits_c").alias("totalDebits"), c("status").alias("validationStatus"), c("confidence").alias("confidence")).alias("parserContext"),
        money_of("opening_c").alias("openingAnchor"), money_of("closing_c").alias("closingAnchor"), money_of("sum_credits_c").alias("totalCreditsTarget"), money_of("sum_debits_c").alias("totalDebitsTarget"),
        dollars(off).alias("residual"), side.alias("likelyMissingDirection"), F.coalesce("balances", F.array().cast("array<decimal(20,2)>")).alias("detectedBalances"), F.coalesce("n_balances", F.lit(0)).alias("detectedBalancesCount"),
        F.when(card, F.struct(money_of("sum_credits_c").alias("payments"), money_of("sum_debits_c").alias("charges"), money_of("fees_c").alias("fees"), money_of("interest_c").alias("interest"))).alias("expectedSectionTotals"),
        F.array(*map(F.lit, ALLOWED)).alias("allowedRegions"), F.array(*map(F.lit, EXCLUDED)).alias("excludedRegions"), F.array().cast("array<string>").alias("transactions"),
    )
    return s.select("statement_id", F.to_json(packet, {"ignoreNullFields": "false"}).alias("packet"))


PACKET = (
    "mode string, statementKind string, parserLikelyMissedTransactions boolean, parserContext struct<rowCount:bigint,totalCredits:decimal(20,2),totalDebits:decimal(20,2),validationStatus:string,confidence:double>,"
    " openingAnchor decimal(20,2), closingAnchor decimal(20,2), residual decimal(20,2), likelyMissingDirection string, detectedBalances array<decimal(20,2)>, detectedBalancesCount bigint,"
    " expectedSectionTotals struct<payments:decimal(20,2),charges:decimal(20,2)>, transactions array<string>"
)


def vision_regions(pages: DataFrame) -> DataFrame:
    """statement_id, rank, region, kind, page, band of images for statements (pages, headers, failures, legal: arrays of pages).

    Both halves of the first pages with a table's header that aren't legal text, then pages that failed before in full;
    without such pages the first page's halves and the end of the last. Where every one of these is legal text, whole pages
    are shown: those with a header, else those that aren't legal, else all.
    """
    c = F.col
    none = F.array().cast("array<int>")
    legal, last = F.coalesce("legal", none), F.greatest(F.lit(1), F.coalesce("pages", F.lit(1)))
    rows = pages.withColumns({"last": last, "legal": legal, "failures": F.coalesce("failures", none)})
    inside = lambda name: F.filter(F.coalesce(name, none), lambda p: (p >= 1) & (p <= c("last")))
    rows = rows.withColumn("known", inside("headers"))
    rows = rows.withColumn("open", F.filter("known", lambda p: ~F.array_contains("legal", p)))
    one = lambda kind, p, band: F.struct(F.concat(F.lit(f"{kind}-p"), p.cast("string"), F.lit(f"-{band}")).alias("region"), F.lit(kind).alias("kind"), p.cast("int").alias("page"), F.lit(band).alias("band"))
    halves = F.flatten(F.transform(F.slice("open", 1, REGION_PAGES), lambda p: F.array(one("table-header", p, "upper"), one("table-body", p, "lower"))))
    again = F.transform("failures", lambda p: one("table-body", p, "full"))
    plain = F.array(one("table-header", F.lit(1), "upper"), one("table-body", F.lit(1), "lower"), one("final-rows", c("last"), "bottom"))
    some = F.size("open") > 0
    wanted = F.filter(F.when(some, F.concat(halves, again)).otherwise(plain), lambda r: (r["page"] >= 1) & (r["page"] <= c("last")) & ~F.array_contains("legal", r["page"]))
    targeted = F.slice(F.array_distinct(wanted), 1, F.when(some, MOST_REGIONS).otherwise(MOST_PLAIN))
    every = F.sequence(F.lit(1), c("last"))
    free = F.filter(every, lambda p: ~F.array_contains("legal", p))
    full = F.when(F.size("known") > 0, c("known")).when(F.size(free) > 0, free).otherwise(every)
    whole = F.transform(F.slice(full, 1, MOST_FULL), lambda p: F.struct(F.concat(F.lit("full-page-p"), p.cast("string"), F.lit("-full")).alias("region"), F.lit("table-body").alias("kind"), p.cast("int").alias("page"), F.lit("full").alias("band")))
    chosen = F.when(F.size(targeted) > 0, targeted).otherwise(whole)
    return rows.select("statement_id", F.posexplode(chosen).alias("rank", "r")).select("statement_id", "rank", "r.region", "r.kind", "r.page", "r.band")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = with_printed_balance(transactions(spark, sf_dir)).select("statement_id", "seq", "balance_c")
    p = F.from_json("packet", PACKET)
    out = evidence_packets(validate(_facts(spark, sf_dir)), tx).select("statement_id", F.length("packet").alias("n"), p.alias("p"))
    cents = lambda c: (c * 100).cast("long")
    return out.select(
        "statement_id", F.col("p.statementKind").alias("kind"), F.col("p.parserLikelyMissedTransactions").alias("missed"), F.col("p.parserContext.rowCount").alias("n_rows"), cents(F.col("p.parserContext.totalDebits")).alias("debits_c"),
        F.col("p.parserContext.validationStatus").alias("status"), cents(F.col("p.residual")).alias("residual_c"), F.col("p.likelyMissingDirection").alias("side"), F.col("p.detectedBalancesCount").alias("n_balances"),
        F.aggregate("p.detectedBalances", F.lit(0).cast("long"), lambda a, x: a + cents(x)).alias("balances_c"), cents(F.col("p.expectedSectionTotals.charges")).alias("charges_c"), F.size("p.transactions").alias("n_texts"),
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the numbers of orders: headers on every third page, legal text on others, some failed."""
    from ..session import table

    k = F.col("o_orderkey")
    last = (k % 9 + 1).cast("int")
    every = F.sequence(F.lit(1), last)
    pick = lambda n, r, cond: F.when(cond, F.filter(every, lambda p: (p + k) % n == r))
    o = table(spark, sf_dir, "orders").select(k.alias("statement_id"), last.alias("pages"), pick(3, 0, k % 5 != 0).alias("headers"), pick(4, 1, k % 2 == 0).alias("failures"), F.when(k % 7 == 0, every).otherwise(pick(5, 2, k % 3 == 0)).alias("legal"))
    return vision_regions(o)


QUERIES = {
    "evidence_packet": (
        _packets,
        sql(TX_SQL, HEAD_SQL, EDITED, FACTS, select="""
, bal AS (SELECT statement_id, running_c AS b FROM tx WHERE seq % 3 = 0 UNION SELECT statement_id, unnest([opening_c, closing_c, sum_credits_c, sum_debits_c, CASE WHEN mode = 'credit-card' THEN closing_c - sum_debits_c + sum_credits_c END]) FROM head),
n AS (SELECT statement_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS total FROM bal WHERE b IS NOT NULL GROUP BY statement_id)
SELECT statement_id, mode AS kind, (mc OR md) AND (quiet OR n_rows <= 1) AS missed, n_rows, td AS debits_c, status, diff AS residual_c,
  CASE WHEN abs(coalesce(diff, 0)) >= 1 THEN CASE WHEN (mode = 'credit-card') = (diff > 0) THEN 'credit' ELSE 'debit' END END AS side, n.n AS n_balances, total AS balances_c,
  CASE WHEN mode = 'credit-card' THEN sum_debits_c END AS charges_c, 0 AS n_texts FROM va JOIN n USING (statement_id)"""),
    ),
    "vision_regions": (
        _regions,
        """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 9 + 1 AS INT) AS last FROM orders),
p AS (SELECT k, last, unnest(range(1, last + 1)) AS p FROM o),
f AS (SELECT *, k % 5 <> 0 AND (p + k) % 3 = 0 AS header, k % 2 = 0 AND (p + k) % 4 = 1 AS failed, k % 7 = 0 OR (k % 3 = 0 AND (p + k) % 5 = 2) AS legal FROM p),
h AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM f WHERE header AND NOT legal),
s AS (SELECT k, last, EXISTS (SELECT 1 FROM h WHERE h.k = o.k) AS any_open FROM o),
r AS (SELECT k, n * 2 AS ord, 'table-header' AS kind, p, 'upper' AS band FROM h WHERE n <= 4 UNION ALL SELECT k, n * 2 + 1, 'table-body', p, 'lower' FROM h WHERE n <= 4
  UNION ALL SELECT k, 100 + p, 'table-body', p, 'full' FROM f JOIN s USING (k) WHERE any_open AND failed AND NOT legal
  UNION ALL SELECT k, 1, 'table-header', p, 'upper' FROM f JOIN s USING (k) WHERE NOT any_open AND NOT legal AND p = 1 UNION ALL SELECT k, 2, 'table-body', p, 'lower' FROM f JOIN s USING (k) WHERE NOT any_open AND NOT legal AND p = 1
  UNION ALL SELECT k, 3, 'final-rows', p, 'bottom' FROM f JOIN s USING (k) WHERE NOT any_open AND NOT legal AND p = f.last),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS rank FROM r),
w AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS rank FROM f JOIN (SELECT k, bool_or(header) AS any_h, bool_or(NOT legal) AS any_free FROM f GROUP BY k) a USING (k)
  WHERE k NOT IN (SELECT k FROM t) AND CASE WHEN any_h THEN header WHEN any_free THEN NOT legal ELSE TRUE END)
SELECT k AS statement_id, CAST(rank AS INT) AS rank, kind || '-p' || p || '-' || band AS region, kind, CAST(p AS INT) AS page, band FROM t WHERE rank < 8
UNION ALL SELECT k, CAST(rank AS INT), 'full-page-p' || p || '-full', 'table-body', CAST(p AS INT), 'full' FROM w WHERE rank < 5""",
    ),
}
