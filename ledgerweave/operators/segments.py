"""Debits and credits from running balances: rows between two printed balances are signed so that the balances hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import growing
from ..sources.derived import TX_SQL, sql, transactions

#: Longest segment whose signs are all tried. Fixed value.
MOST_SIGNS = 16


def islands(rows: DataFrame) -> DataFrame:
    """segment: rows up to and with a printed balance belong together; what follows the last balance is a segment too."""
    before = Window.partitionBy("statement_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("segment", F.coalesce(F.sum(F.col("balance_c").isNotNull().cast("int")).over(before), F.lit(0)).cast("int"))


#: The fold over both halves' sums in order: the best of the lower half at a key, and the best whole assignment so far.
_NONE = "named_struct('key', cast(null as bigint), 'score', 0, 'mask', 0, 'best', cast(null as struct<score:int,mask:int>))"
_LOWER = "named_struct('key', e.key, 'score', e.score, 'mask', e.mask, 'best', acc.best)"
_WHOLE = "named_struct('score', acc.score + e.score, 'mask', -(acc.mask + e.mask))"
_UPPER = f"named_struct('key', acc.key, 'score', acc.score, 'mask', acc.mask, 'best', greatest(acc.best, {_WHOLE}))"
_STEP = f"case when e.side = 0 and not (e.key <=> acc.key) then {_LOWER} when e.side = 1 and e.key <=> acc.key then {_UPPER} else acc end"


def subset_sums(items: str) -> str:
    """All subsets of items (amount, prior, bit): sum of amounts and priors, and mask; each item doubles them."""
    more = "transform(acc, s -> named_struct('total', s.total + x.amount, 'score', s.score + x.prior, 'mask', s.mask + x.bit))"
    return f"aggregate({items}, array(named_struct('total', 0L, 'score', 0, 'mask', 0)), (acc, x) -> concat(acc, {more}))"


def solve(segments: DataFrame) -> DataFrame:
    """signs (true: credit) of segments (amounts, priors, delta_c): the assignment with credits - debits = delta that agrees
    best with the priors (1 credit, -1 debit, 0 none), the lowest bit mask on ties; null if none holds.

    Longer segments than MOST_SIGNS take the priors (debit without one) if those hold. Two halves meet in the middle: the
    subset sums of the lower half and what those of the upper half leave of the target are sorted together, so that equal ones
    stand side by side, best first, and one fold over at most 2 x 2^8 of them finds the best whole assignment.
    """
    n, half = "size(amounts)", MOST_SIGNS // 2
    items = "transform(amounts, (x, i) -> named_struct('amount', x, 'prior', priors[i], 'bit', cast(shiftleft(1, i) as int)))"
    key = lambda side, value: f"transform({{}}, s -> named_struct('key', {value}, 'side', {side}, 'rank', -s.score, 'mask', s.mask, 'score', s.score))"
    fits = f"{n} between 1 and {MOST_SIGNS} and delta_c is not null"
    rows = segments.withColumn("total", F.expr("aggregate(amounts, 0L, (a, x) -> a + x)"))
    rows = rows.withColumn("items", F.expr(f"case when {fits} and (delta_c + total) % 2 = 0 then {items} end"))
    rows = rows.withColumns({"lower": F.expr(subset_sums(f"slice(items, 1, {half})")), "upper": F.expr(subset_sums(f"slice(items, {half + 1}, {half})"))})
    both = f"array_sort(concat({key(0, 's.total').format('lower')}, {key(1, '(delta_c + total) div 2 - s.total').format('upper')}))"
    rows = rows.withColumn("best", F.expr(f"aggregate({both}, {_NONE}, (acc, e) -> {_STEP}).best"))
    short = "transform(amounts, (x, i) -> (shiftright(-best.mask, i) & 1) = 1)"
    held = "aggregate(zip_with(amounts, priors, (x, p) -> if(p = 1, x, -x)), 0L, (a, x) -> a + x) = delta_c"
    signs = F.expr(f"case when best is not null then {short} when {n} > {MOST_SIGNS} and {held} then transform(priors, p -> p = 1) end")
    return rows.withColumn("signs", signs).drop("best", "total", "items", "lower", "upper")


def sign_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows (statement_id, seq, amount_c, prior, balance_c) with credit (boolean) and solved, given heads' opening and closing.

    A segment starts from the balance printed before it (the opening first) and ends at its own, or at the closing balance.
    Where no signs hold, wording decides and debit is assumed. At most MOST_SIGNS rows of a segment are gathered in an
    array; of a longer one, whose signs can only be the priors', only sums are.
    """
    own = Window.partitionBy("statement_id", "segment").orderBy("seq")
    marked = islands(rows).withColumn("at", F.row_number().over(own))
    item = F.when(F.col("at") <= MOST_SIGNS, F.struct("at", "amount_c", "prior"))
    as_worded = F.when(F.col("prior") == 1, F.col("amount_c")).otherwise(-F.col("amount_c"))
    segs = marked.groupBy("statement_id", "segment").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n"), F.sum(as_worded).alias("worded_c"), F.max_by("balance_c", "seq").alias("end_c")
    )
    order = Window.partitionBy("statement_id").orderBy("segment")
    segs = segs.join(growing(heads.select("statement_id", "opening_c", "closing_c")), "statement_id", "left")
    start = F.when(F.col("segment") == 0, F.col("opening_c")).otherwise(F.lag("end_c").over(order))
    segs = segs.withColumn("delta_c", F.coalesce("end_c", "closing_c") - start)
    few = F.col("n") <= MOST_SIGNS
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    segs = segs.withColumns({"amounts": F.when(few, F.col("items.amount_c")).otherwise(empty("bigint")), "priors": F.when(few, F.col("items.prior")).otherwise(empty("int"))})
    solved = solve(segs).withColumn("solved", F.coalesce(F.when(few, F.col("signs").isNotNull()).otherwise(F.col("worded_c") == F.col("delta_c")), F.lit(False)))
    flat = marked.join(growing(solved.select("statement_id", "segment", "signs", "solved")), ["statement_id", "segment"])
    credit = F.coalesce(F.get("signs", F.col("at") - 1), F.col("prior") == 1)
    return flat.select(*[flat[c] for c in rows.columns], "segment", credit.alias("credit"), "solved")


def _printed(tx: DataFrame) -> DataFrame:
    """Balances after 1, 2, 3 ... rows; in every fiftieth account after 16 and 17 by turns."""
    k = F.floor((F.sqrt(8 * F.col("seq") + 1) - 1) / 2)
    long = F.col("seq") % 33
    shown = F.when(F.col("statement_id") % 50 == 0, (long == 0) | (long == 16)).otherwise(k * (k + 1) / 2 == F.col("seq"))
    return tx.withColumn("balance_c", F.when(shown, F.col("running_c")))


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tx = _printed(transactions(spark, sf_dir))
    prior = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    heads = tx.groupBy("statement_id").agg(F.min("opening_c").alias("opening_c"), F.max_by("running_c", "seq").alias("closing_c"))
    return tx.withColumn("prior", prior).select("statement_id", "seq", "row_no", "amount_c", "prior", "balance_c"), heads


def _solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, heads = _rows(spark, sf_dir)
    return sign_rows(rows, heads).select("row_no", "segment", "credit", "solved")


SEGMENTS_SQL = """
shown AS (SELECT *, CASE WHEN statement_id % 50 = 0 THEN seq % 33 IN (0, 16) ELSE seq IN (SELECT CAST(k * (k + 1) / 2 AS INT) FROM range(1, 2000) r(k)) END AS shown FROM tx),
s AS (SELECT *, CAST(coalesce(sum(CAST(shown AS INT)) OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS segment FROM shown)"""

QUERIES = {
    "segment_islands": (
        lambda s, d: islands(_rows(s, d)[0]).groupBy("statement_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_c").alias("total_c")),
        sql(TX_SQL, SEGMENTS_SQL, select="SELECT statement_id, segment, count(*) AS n, CAST(sum(amount_c) AS BIGINT) AS total_c FROM s GROUP BY ALL"),
    ),
    "segment_solver": (
        _solver,
        sql(TX_SQL, SEGMENTS_SQL, select="""
, bits AS (SELECT *, row_number() OVER (PARTITION BY statement_id, segment ORDER BY seq) - 1 AS bit, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS prior FROM s),
g AS (SELECT statement_id, segment, count(*) AS n, sum(signed_c) AS delta, sum(CASE WHEN prior = 1 THEN amount_c ELSE -amount_c END) AS worded FROM bits GROUP BY ALL),
masks AS (SELECT g.*, unnest(generate_series(0, CAST(1 << n AS BIGINT) - 1)) AS mask FROM g WHERE n <= 16),
sc AS (SELECT m.statement_id, m.segment, mask, sum(CASE WHEN (mask >> bit) & 1 = 1 THEN amount_c ELSE -amount_c END) AS net, min(delta) AS delta,
   sum(CASE WHEN prior = 0 THEN 0 WHEN (prior = 1) = ((mask >> bit) & 1 = 1) THEN 1 ELSE -1 END) AS score
   FROM masks m JOIN bits b USING (statement_id, segment) GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY statement_id, segment ORDER BY score DESC, mask) AS k FROM sc WHERE net = delta)
SELECT row_no, b.segment, (mask >> bit) & 1 = 1 AS credit, TRUE AS solved FROM bits b JOIN w ON w.k = 1 AND w.statement_id = b.statement_id AND w.segment = b.segment
UNION ALL SELECT row_no, b.segment, prior = 1, worded = delta FROM bits b JOIN g USING (statement_id, segment) WHERE n > 16"""),
    ),
}
