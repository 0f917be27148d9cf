"""Statement-level decisions: validation, confidence, states, candidate scoring and comparison, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..session import table
from ..sources.derived import HEAD_SQL, LINES_SQL, TX_SQL, headers, sql, text_lines, transactions
from .transactions import EDITED, LOW_CONFIDENCE, edited_rows, reconcile, warnings_of, with_printed_balance

#: Cents from which a printed total means activity. Fixed value.
MEANINGFUL = 1


def meaningful(c: Column) -> Column:
    return F.coalesce(F.abs(c) >= MEANINGFUL, F.lit(False))


def gross(parsed: Column, printed: Column) -> Column:
    """More than a dollar apart, and either nothing parsed or more than a quarter of the printed total off."""
    off = F.abs(parsed - printed)
    return meaningful(printed) & (off > 100) & ((F.abs(parsed) < 1) | (off * 4 > F.abs(printed)))


def row_facts(rows: DataFrame) -> DataFrame:
    """Per statement: totals and the counts that decisions are made from."""
    rows = warnings_of(rows)
    aggregate = text.is_aggregate(F.col("description"))
    debit = F.abs(F.coalesce("debit_c", F.lit(0)))
    return rows.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("credit_c"), F.lit(0)).alias("total_credits_c"),
        F.coalesce(F.sum("debit_c"), F.lit(0)).alias("total_debits_c"),
        F.count_if(F.size("warnings") > 0).alias("flagged"),
        F.count_if(F.col("severity") == "material").alias("material"),
        F.count_if(F.col("severity") == "minor").alias("minor"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"),
        F.count_if(~aggregate).alias("itemized"),
        F.count_if(F.col("description").rlike(text.AGGREGATE)).alias("aggregates"),
        F.count_if(F.trim("date") == "").alias("missing_date"),
        F.count_if((F.trim("date") == "") | (F.trim("description") == "")).alias("missing_meta"),
        F.count_if(~money.has_amount(F.col("debit_c")) & ~money.has_amount(F.col("credit_c"))).alias("missing_amount"),
        F.count_if((F.trim("date") == "") | (F.trim("description") == "") | (F.col("debit_c").isNull() & F.col("credit_c").isNull())).alias("junk"),
        F.max(debit).alias("largest_debit_c"),
        F.sum(debit).alias("abs_debits_c"),
    )


def validate(facts: DataFrame) -> DataFrame:
    """status, confidence and issues of statements (facts with mode, opening_c, closing_c, sum_credits_c, sum_debits_c, fallback).

    Reconciliation is the backbone; missing balances, the fallback parser, printed totals that differ and doubtful rows each
    take confidence away. Activity that misses the printed totals forces a review, unless the balances hold exactly over
    at least two itemised rows.
    """
    c = F.col
    net = c("total_credits_c") - c("total_debits_c")
    f = facts.withColumn("difference_c", c("opening_c") + F.when(c("mode") == "credit-card", -net).otherwise(net) - c("closing_c"))
    available, passed = c("difference_c").isNotNull(), F.coalesce(c("difference_c") == 0, F.lit(False))
    quiet = (F.abs("total_credits_c") < 1) & (F.abs("total_debits_c") < 1)
    active = meaningful(c("sum_credits_c")) | meaningful(c("sum_debits_c"))
    sound = passed & ~quiet & (c("itemized") >= 2)
    missing = ~sound & (gross(c("total_credits_c"), c("sum_credits_c")) | gross(c("total_debits_c"), c("sum_debits_c")) | (active & (c("n_rows") <= 1) & quiet))
    credit_gap = meaningful(c("sum_credits_c")) & (F.abs(c("total_credits_c") - c("sum_credits_c")) > 1)
    debit_gap = meaningful(c("sum_debits_c")) & (F.abs(c("total_debits_c") - c("sum_debits_c")) > 1)
    f = f.withColumns({"sound": sound, "missing": missing, "credit_gap": F.coalesce(credit_gap, F.lit(False)), "debit_gap": F.coalesce(debit_gap, F.lit(False)), "available": available, "passed": passed})
    conf = F.when(c("n_rows") == 0, 0.1).otherwise(1.0)
    conf = conf - F.when(available, 0.0).otherwise(0.3)
    conf = conf - F.when(available & ~passed, F.when(F.abs("difference_c") >= 1000, 0.4).otherwise(0.2)).otherwise(0.0)
    conf = conf - F.when(c("fallback"), 0.2).otherwise(0.0)
    minor = conf - F.when(c("credit_gap"), 0.15).otherwise(0.0) - F.when(c("debit_gap"), 0.15).otherwise(0.0)
    exact = conf - F.when(c("credit_gap") | c("debit_gap"), 0.05).otherwise(0.0)
    conf = F.when(c("missing"), F.least(conf, F.lit(0.4)) - 0.1).when(~c("sound"), minor).otherwise(exact)
    share = lambda n: F.when(c("n_rows") > 0, c(n) / c("n_rows")).otherwise(0.0)
    conf = conf - F.least(F.lit(0.3), share("flagged") * 0.3) - F.least(F.lit(0.2), share("low_confidence") * 0.2)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(conf * 100 + 0.5) / 100))
    issues = [
        F.when(c("n_rows") == 0, "No transaction rows were detected."),
        F.when(~available, "Opening or closing statement balance was not found."),
        F.when(available & ~passed, F.concat(F.lit("Balance check did not reconcile (off by "), money.money_string(F.abs("difference_c")), F.lit(")."))),
        F.when(c("fallback"), "Rows came from the fallback parser, not a detected table."),
        F.when(c("missing"), "Parsed activity does not match the statement summary totals; transactions appear to be missing."),
        F.when(~c("missing") & ~c("sound") & c("credit_gap"), "Parsed credits do not exactly match the statement's summary total."),
        F.when(~c("missing") & ~c("sound") & c("debit_gap"), "Parsed debits do not exactly match the statement's summary total."),
    ]
    status = F.when(c("missing"), "needs-review").when(~available, "limited").when(passed, "passed").otherwise("needs-review")
    return f.withColumns({"status": status, "confidence": conf, "issues": F.filter(F.array(*issues), lambda x: x.isNotNull())})


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of edited rows beside the headers of the unedited ones; statements 8k + 2 keep clean rows."""
    rows, tx = edited_rows(spark, sf_dir), transactions(spark, sf_dir)
    clean = tx.select("statement_id", "row_no", "seq", "date", F.col("event_type").alias("description"), "debit_c", "credit_c", F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("warning"))
    rows = rows.where("statement_id % 8 <> 2").unionByName(clean.where("statement_id % 8 = 2"))
    return headers(tx).join(row_facts(rows), "statement_id").withColumn("fallback", F.col("statement_id") % 6 == 0)


FACTS = f"""
mix AS (
  SELECT statement_id, date, description, debit_c, credit_c, confidence, warning FROM ed WHERE statement_id % 8 <> 2
  UNION ALL SELECT statement_id, date, event_type, debit_c, credit_c, 0.9, NULL FROM tx WHERE statement_id % 8 = 2
), mw AS (
  SELECT *, (CASE WHEN date = '' THEN 1 ELSE 0 END) + (CASE WHEN description = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(debit_c, 0) <> 0 AND coalesce(credit_c, 0) <> 0 THEN 1 ELSE 0 END)
    + (CASE WHEN coalesce(debit_c, 0) = 0 AND coalesce(credit_c, 0) = 0 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(debit_c, 0) < 0 OR coalesce(credit_c, 0) < 0 THEN 1 ELSE 0 END) AS hard,
    confidence < 0.7 AS low, regexp_matches(description, '{text.AGGREGATE}') AS agg, regexp_matches(description, '{text.AGGREGATE}') OR regexp_matches(description, '{text.PLACEHOLDER}') AS noitem FROM mix
), fa AS (
  SELECT statement_id, count(*) AS n_rows, CAST(coalesce(sum(credit_c), 0) AS BIGINT) AS tc, CAST(coalesce(sum(debit_c), 0) AS BIGINT) AS td,
    count(*) FILTER (WHERE hard > 0 OR low OR warning IS NOT NULL) AS flagged, count(*) FILTER (WHERE hard > 0) AS material, count(*) FILTER (WHERE hard = 0 AND (low OR warning IS NOT NULL)) AS minor,
    count(*) FILTER (WHERE low) AS lowc, count(*) FILTER (WHERE NOT noitem) AS itemized, count(*) FILTER (WHERE agg) AS aggregates,
    count(*) FILTER (WHERE date = '') AS missing_date, count(*) FILTER (WHERE date = '' OR description = '') AS missing_meta,
    count(*) FILTER (WHERE coalesce(debit_c, 0) = 0 AND coalesce(credit_c, 0) = 0) AS missing_amount,
    count(*) FILTER (WHERE date = '' OR description = '' OR (debit_c IS NULL AND credit_c IS NULL)) AS junk,
    max(abs(coalesce(debit_c, 0))) AS largest, CAST(sum(abs(coalesce(debit_c, 0))) AS BIGINT) AS absd
  FROM mw GROUP BY statement_id
), va0 AS (
  SELECT h.*, fa.* EXCLUDE (statement_id), statement_id % 6 = 0 AS fallback,
    opening_c + CASE WHEN mode = 'credit-card' THEN td - tc ELSE tc - td END - closing_c AS diff, coalesce(abs(sum_credits_c) >= 1, FALSE) AS mc, coalesce(abs(sum_debits_c) >= 1, FALSE) AS md
  FROM head h JOIN fa USING (statement_id)
), va1 AS (
  SELECT *, diff IS NOT NULL AS available, coalesce(diff = 0, FALSE) AS passed, abs(tc) < 1 AND abs(td) < 1 AS quiet,
    mc AND abs(tc - sum_credits_c) > 100 AND (abs(tc) < 1 OR abs(tc - sum_credits_c) * 4 > abs(sum_credits_c)) AS gc,
    md AND abs(td - sum_debits_c) > 100 AND (abs(td) < 1 OR abs(td - sum_debits_c) * 4 > abs(sum_debits_c)) AS gd,
    coalesce(mc AND abs(tc - sum_credits_c) > 1, FALSE) AS cg, coalesce(md AND abs(td - sum_debits_c) > 1, FALSE) AS dg FROM va0
), va2 AS (
  SELECT *, passed AND NOT quiet AND itemized >= 2 AS sound FROM va1
), va3 AS (
  SELECT *, NOT sound AND (coalesce(gc, FALSE) OR coalesce(gd, FALSE) OR ((mc OR md) AND n_rows <= 1 AND quiet)) AS missing,
    1.0::DOUBLE - CASE WHEN available THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END - CASE WHEN available AND NOT passed THEN CASE WHEN abs(diff) >= 1000 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.0::DOUBLE END
    - CASE WHEN fallback THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS c0 FROM va2
), va4 AS (
  SELECT *, CASE WHEN missing THEN least(c0, 0.4::DOUBLE) - 0.1::DOUBLE
      WHEN NOT sound THEN c0 - CASE WHEN cg THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN dg THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      ELSE c0 - CASE WHEN cg OR dg THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END END
      - least(0.3::DOUBLE, flagged / n_rows * 0.3::DOUBLE) - least(0.2::DOUBLE, lowc / n_rows * 0.2::DOUBLE) AS c1 FROM va3
), va AS (
  SELECT *, CASE WHEN missing THEN 'needs-review' WHEN NOT available THEN 'limited' WHEN passed THEN 'passed' ELSE 'needs-review' END AS status,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, floor(c1 * 100 + 0.5) / 100)) AS conf,
    CAST(NOT available AS INT) + CAST(available AND NOT passed AS INT) + CAST(fallback AS INT) + CAST(missing AS INT) + CAST(NOT missing AND NOT sound AND cg AS INT) + CAST(NOT missing AND NOT sound AND dg AS INT) AS n_issues FROM va4
)"""

# When warnings count as localised, and the confidence of a verified conversion.
VERIFIED_CONFIDENCE, LOCAL_COUNT, LOCAL_RATE = 0.7, 3, 0.05


def conversion_state(rows: Column, status: Column, confidence: Column, material: Column, minor: Column, unsupported: Column, preview: Column) -> Column:
    """verified, review-recommended, needs-review, preview-limited or unsupported."""
    local = (material <= LOCAL_COUNT) & (material <= rows * LOCAL_RATE)
    review = (rows == 0) | (status != "passed") | ((material > 0) & ~local)
    clean = (material == 0) & (minor == 0) & (confidence >= VERIFIED_CONFIDENCE)
    return F.when(unsupported, "unsupported").when(review, "needs-review").when(preview, "preview-limited").when(clean, "verified").otherwise("review-recommended")


def assist_reasons(v: DataFrame) -> DataFrame:
    """Why a statement needs help; none if it is verified."""
    c = F.col
    verified = (c("status") == "passed") & (c("confidence") >= LOW_CONFIDENCE) & (c("n_rows") > 0) & (c("missing_amount") == 0)
    reasons = F.filter(
        F.array(
            F.when(c("status") != "passed", "validation-not-passed"),
            F.when(c("confidence") < LOW_CONFIDENCE, "low-confidence"),
            F.when(c("n_rows") == 0, "no-transactions"),
            F.when(c("missing_amount") > 0, "row-missing-amount"),
            F.when(c("missing_meta") * 10 > c("n_rows"), "rows-missing-date-or-description"),
        ),
        lambda r: r.isNotNull(),
    )
    return v.withColumn("reasons", F.when(verified, F.array().cast("array<string>")).otherwise(reasons))


def quality_reasons(v: DataFrame) -> DataFrame:
    """quality reasons of a candidate and whether a hard one rejects it."""
    c = F.col
    share = F.when(c("abs_debits_c") > 0, c("largest_debit_c") * 100 / c("abs_debits_c")).otherwise(0.0)
    sole = (c("n_rows") >= 2) & meaningful(c("sum_debits_c")) & (c("largest_debit_c") >= 1) & (c("abs_debits_c") - c("largest_debit_c") < 1) & (F.abs(c("largest_debit_c") - c("sum_debits_c")) <= 1)
    hard = [F.when(c("aggregates") > 0, "aggregate-row"), F.when(sole, "summary-row-as-transaction"), F.when(meaningful(c("sum_debits_c")) & (c("itemized") < 3) & (share >= 85), "too-few-itemized-rows")]
    soft = [F.when(c("missing_date") * 2 > c("n_rows"), "high-missing-date-rate"), F.when(c("low_confidence") * 2 > c("n_rows"), "many-low-confidence-rows")]
    some = lambda xs: F.filter(F.array(*xs), lambda r: r.isNotNull())
    return v.select("statement_id", F.array_join(some(hard + soft), ",").alias("reasons"), (F.size(some(hard)) > 0).alias("rejected"))


def score(c: DataFrame) -> DataFrame:
    """Score of candidates in tenths: reconciliation dominates, then balances, printed totals, completeness and faults."""
    col = F.col
    net = col("total_credits_c") - col("total_debits_c")
    diff = col("opening_c") + F.when(col("mode") == "credit-card", -net).otherwise(net) - col("closing_c")
    points = F.when(diff == 0, 1000).when(F.abs(diff) <= 100, 450).when(F.abs(diff) <= 1000, 150).otherwise(0)
    points += F.when(col("closing_c").isNotNull(), 150).otherwise(0) + F.when(col("opening_c").isNotNull(), 100).otherwise(0)
    for printed, total in (("sum_credits_c", "total_credits_c"), ("sum_debits_c", "total_debits_c")):
        points += F.when(F.abs(col(total) - col(printed)) <= 1, 200).otherwise(0)
    points += F.least(col("n_rows"), F.lit(50)) * 4 - col("junk") * 40 - col("low_confidence") * 10
    alone = (col("n_rows") <= 1) & (meaningful(col("sum_credits_c")) | meaningful(col("sum_debits_c"))) & (col("opening_c") == col("closing_c"))
    points -= F.when(alone, 1500).otherwise(0)
    sectioned = F.when(~col("sectioned"), 0).when(col("name") == "credit-card-sectioned", 300).when((col("name") == "credit-card-simple") & ~F.coalesce(diff == 0, F.lit(False)), -400).otherwise(0)
    grid = F.when(col("source") == "coordinate-table", 60 + F.when(diff == 0, 300).otherwise(0)).otherwise(0)
    return c.withColumns({"difference_c": diff, "score": F.when(col("n_rows") == 0, -10000).otherwise(points) + sectioned + grid})


def pick(scored: DataFrame) -> DataFrame:
    """The best candidate of each statement: highest score, the first on ties; those with rows go before those without."""
    order = Window.partitionBy("statement_id").orderBy((F.col("n_rows") == 0).cast("int"), F.desc("score"), "cand_no")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five competing readings of each account: some lose rows, some swap sides, the last has none."""
    tx = transactions(spark, sf_dir)
    kinds = [
        (0, "coordinate-table", "coordinate-table", F.col("row_no") % 9 != 0),
        (1, "credit-card-simple", "text-parser", F.col("row_no") % 5 != 0),
        (2, "credit-card-sectioned", "text-parser", F.lit(True)),
        (3, "bank-account", "text-parser", F.lit(True)),
        (4, "fallback", "fallback", F.lit(False)),
    ]
    parts = None
    for k, name, source, keep in kinds:
        swap = (F.col("statement_id") % 3 == 0) if k == 3 else F.lit(False)
        rows = tx.where(keep) if k != 4 else tx
        agg = rows.groupBy("statement_id").agg(
            (F.count(F.lit(1)) if k != 4 else F.lit(0)).cast("long").alias("n_rows"),
            F.coalesce(F.sum(F.when(swap, F.col("debit_c")).otherwise(F.col("credit_c"))), F.lit(0)).alias("total_credits_c"),
            F.coalesce(F.sum(F.when(swap, F.col("credit_c")).otherwise(F.col("debit_c"))), F.lit(0)).alias("total_debits_c"),
            F.count_if(F.col("row_no") % 50 == k).alias("junk"),
            F.count_if(F.col("row_no") % 20 == k).alias("low_confidence"),
        ).select("statement_id", F.lit(k).alias("cand_no"), F.lit(name).alias("name"), F.lit(source).alias("source"), "n_rows", "total_credits_c", "total_debits_c", "junk", "low_confidence")
        parts = agg if parts is None else parts.unionByName(agg)
    return parts.join(headers(tx), "statement_id").withColumn("sectioned", F.col("statement_id") % 2 == 0)


def _cand_sql() -> str:
    parts = []
    for k, name, source, keep in ((0, "coordinate-table", "coordinate-table", "row_no % 9 <> 0"), (1, "credit-card-simple", "text-parser", "row_no % 5 <> 0"), (2, "credit-card-sectioned", "text-parser", "TRUE"), (3, "bank-account", "text-parser", "TRUE"), (4, "fallback", "fallback", "TRUE")):
        credit, debit = ("CASE WHEN statement_id % 3 = 0 THEN debit_c ELSE credit_c END", "CASE WHEN statement_id % 3 = 0 THEN credit_c ELSE debit_c END") if k == 3 else ("credit_c", "debit_c")
        parts.append(f"SELECT statement_id, {k} AS cand_no, '{name}' AS name, '{source}' AS source, {'count(*)' if k != 4 else 'CAST(0 AS BIGINT)'} AS n_rows, CAST(coalesce(sum({credit}), 0) AS BIGINT) AS tc, CAST(coalesce(sum({debit}), 0) AS BIGINT) AS td, count(*) FILTER (WHERE row_no % 50 = {k}) AS junk, count(*) FILTER (WHERE row_no % 20 = {k}) AS lowc FROM tx WHERE {keep} GROUP BY statement_id")
    return "cand AS (" + " UNION ALL ".join(parts) + """), cs AS (
SELECT c.*, h.* EXCLUDE (statement_id), statement_id % 2 = 0 AS sectioned, opening_c + CASE WHEN mode = 'credit-card' THEN td - tc ELSE tc - td END - closing_c AS diff FROM cand c JOIN head h USING (statement_id)
), sc AS (SELECT *, CASE WHEN n_rows = 0 THEN -10000 ELSE
  CASE WHEN diff = 0 THEN 1000 WHEN abs(diff) <= 100 THEN 450 WHEN abs(diff) <= 1000 THEN 150 ELSE 0 END + CASE WHEN closing_c IS NOT NULL THEN 150 ELSE 0 END + CASE WHEN opening_c IS NOT NULL THEN 100 ELSE 0 END
  + CASE WHEN abs(tc - sum_credits_c) <= 1 THEN 200 ELSE 0 END + CASE WHEN abs(td - sum_debits_c) <= 1 THEN 200 ELSE 0 END + least(n_rows, 50) * 4 - junk * 40 - lowc * 10
  - CASE WHEN n_rows <= 1 AND (coalesce(abs(sum_credits_c) >= 1, FALSE) OR coalesce(abs(sum_debits_c) >= 1, FALSE)) AND coalesce(opening_c = closing_c, FALSE) THEN 1500 ELSE 0 END END
  + CASE WHEN NOT sectioned THEN 0 WHEN name = 'credit-card-sectioned' THEN 300 WHEN name = 'credit-card-simple' AND NOT coalesce(diff = 0, FALSE) THEN -400 ELSE 0 END
  + CASE WHEN source = 'coordinate-table' THEN 60 + CASE WHEN coalesce(diff = 0, FALSE) THEN 300 ELSE 0 END ELSE 0 END AS score FROM cs)"""


def multiset_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """dropped, added, corrected: signed amounts of left against those of right as multisets, per statement."""
    count = lambda d, name: d.groupBy("statement_id", "signed_c").agg(F.count(F.lit(1)).alias(name))
    both = count(left, "l").join(count(right, "r"), ["statement_id", "signed_c"], "full").fillna(0, ["l", "r"])
    out = both.groupBy("statement_id").agg(F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("dropped"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("added"))
    size = right.select("statement_id", F.abs("signed_c").alias("size_c")).distinct()
    lost = both.where("l > 0 and r = 0").withColumn("size_c", F.abs("signed_c")).join(size, ["statement_id", "size_c"], "left_semi")
    return out.join(lost.groupBy("statement_id").agg(F.sum("l").alias("corrected")), "statement_id", "left").fillna(0, ["corrected"])


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir).select("statement_id", "row_no", "signed_c")
    other = tx.where("row_no % 10 <> 0").select("statement_id", "row_no", F.when(F.col("row_no") % 10 == 1, -F.col("signed_c")).otherwise(F.col("signed_c")).alias("signed_c"))
    return multiset_compare(tx, other.unionByName(tx.where("row_no % 25 = 7")))


def repair(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows after a repair plan: deletions and changes by row number, additions at the end."""
    key = ["statement_id", "row_no"]
    new = plan.where("action = 'change'").select(*key, F.col("signed_c").alias("new_c"))
    kept = rows.join(plan.where("action = 'delete'").select(*key), key, "left_anti").join(new, key, "left")
    kept = kept.select(*key, F.coalesce("new_c", "signed_c").alias("signed_c"))
    return kept.unionByName(plan.where("action = 'add'").select(*key, "signed_c"))


def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir).select("statement_id", "row_no", "signed_c")
    n = F.col("row_no")
    plan = tx.where(n % 10 < 3).select("statement_id", F.when(n % 10 == 2, n + 1_000_000_000).otherwise(n).alias("row_no"), F.when(n % 10 == 0, "delete").when(n % 10 == 1, "change").otherwise("add").alias("action"), F.when(n % 10 == 1, F.lit(-5)).otherwise(F.lit(7)).cast("long").alias("signed_c"))
    return repair(tx, plan).groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("signed_c").alias("net_c"))


def beats(p: str, q: str) -> Column:
    """Whether candidate q is better than the parser's result p; columns are prefixed."""
    c = lambda side, name: F.col(f"{side}_{name}")
    apart = lambda side: F.when(meaningful(c(side, "sum_credits_c")), F.abs(c(side, "total_credits_c") - c(side, "sum_credits_c"))).otherwise(0) + F.when(meaningful(c(side, "sum_debits_c")), F.abs(c(side, "total_debits_c") - c(side, "sum_debits_c"))).otherwise(0)
    known = meaningful(c(p, "sum_credits_c")) | meaningful(c(p, "sum_debits_c"))
    off = lambda side: F.abs(c(side, "difference_c"))
    far = lambda side: F.coalesce(off(side), F.lit(1 << 60))
    closer = known & (c(q, "n_rows") > c(p, "n_rows")) & (apart(q) < apart(p) - 50) & (apart(q) * 2 < apart(p))
    nearer = F.coalesce((off(q) < off(p)) & (c(q, "n_issues") <= c(p, "n_issues")) & (c(q, "n_rows") >= c(p, "n_rows")), F.lit(False))
    surer = (c(q, "confidence") > c(p, "confidence") + 1e-9) & (far(q) <= far(p))
    return F.when(c(q, "status") == "passed", (c(p, "status") != "passed") | (c(q, "confidence") > c(p, "confidence") + 1e-9)).otherwise(closer | nearer | surer)


#: Cents that a candidate may be off and still be adopted if it keeps all rows; rows more that it needs where the parser found one at most. Fixed values.
STRICT_RESIDUAL, MANY_MORE = 100, 3


def adoption(p: str, q: str, dropped: Column) -> Column:
    """(adopted, reason) of candidate q against the parser's result p, dropped being how many of p's amounts q lacks.

    A better candidate is adopted only if it reconciles, or is nearly there and keeps all rows, or rebuilds a table that the
    parser missed; and never if it drops rows without bringing the balance back.
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    better = F.coalesce(beats(p, q), F.lit(False))
    full = c(q, "status") == "passed"
    near = F.coalesce(F.abs(c(q, "difference_c")) <= STRICT_RESIDUAL, F.lit(False))
    missed = c(p, "n_rows") <= 1
    rebuilt = missed & (c(q, "n_rows") >= c(p, "n_rows") + MANY_MORE)
    unexplained = (dropped > 0) & ~full & ~near & ~missed
    adopted = better & (full | near & (c(q, "n_rows") >= c(p, "n_rows")) | rebuilt) & ~unexplained
    why = F.when(full, "ai-full-reconstruction-reconciled").when(missed, "parser-missed-table-ai-rebuilt").otherwise("ai-nearly-reconciled-keeps-rows")
    why_not = F.when(~better, "candidate-worse-than-parser").when(unexplained, "ai-drops-parser-rows-without-reconciling").otherwise("ai-unreconciled-not-adopted")
    return F.struct(adopted.alias("adopted"), F.when(adopted, why).otherwise(why_not).alias("reason"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated statement against the next one's figures, as a candidate for it."""
    v = validate(_facts(spark, sf_dir)).select("statement_id", "status", "confidence", "n_rows", "difference_c", F.size("issues").alias("n_issues"), "sum_credits_c", "sum_debits_c", "total_credits_c", "total_debits_c")
    left = v.select(*[F.col(c).alias(f"p_{c}") for c in v.columns])
    right = v.select((F.col("statement_id") - 1).alias("key"), *[F.col(c).alias(f"q_{c}") for c in v.columns])
    return left.join(right, F.col("p_statement_id") == F.col("key"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements ranked within groups of four: passed first, smallest difference, most confident, first."""
    v = validate(_facts(spark, sf_dir)).withColumn("team", F.floor(F.col("statement_id") / 4))
    order = Window.partitionBy("team").orderBy((F.col("status") != "passed").cast("int"), F.abs("difference_c").asc_nulls_last(), F.desc("confidence"), "statement_id")
    return v.select("statement_id", F.row_number().over(order).alias("rank"))


def fee_repair(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Card statements whose debits fall short by exactly their detected interest and fee items (two cents off at most)."""
    total = items.groupBy("statement_id").agg(F.sum("amount_c").alias("items_c"), F.count(F.lit(1)).alias("n_items"))
    f = facts.where((F.col("mode") == "credit-card") & meaningful(F.col("sum_debits_c"))).join(total, "statement_id")
    short = F.col("sum_debits_c") - F.col("total_debits_c")
    fine = ~meaningful(F.col("sum_credits_c")) | (F.abs(F.col("total_credits_c") - F.col("sum_credits_c")) <= 2)
    return f.select("statement_id", short.alias("short_c"), (fine & (short > 1) & (F.abs(F.col("items_c") - short) <= 2)).alias("applied"), F.col("n_items"))


def _fee_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    fee = F.col("row_no") % 40 == 3
    full = tx.groupBy("statement_id").agg(F.sum("debit_c").alias("sum_debits_c"), F.sum("credit_c").alias("sum_credits_c"))
    seen = tx.where(~(fee & F.col("debit_c").isNotNull())).groupBy("statement_id").agg(F.coalesce(F.sum("debit_c"), F.lit(0)).alias("total_debits_c"), F.coalesce(F.sum("credit_c"), F.lit(0)).alias("total_credits_c"))
    facts = full.join(seen, "statement_id").withColumn("mode", F.lit("credit-card"))
    items = tx.where(fee & F.col("debit_c").isNotNull()).select("statement_id", F.when(F.col("statement_id") % 3 == 0, F.col("debit_c") + 5).otherwise(F.col("debit_c")).alias("amount_c"))
    return fee_repair(facts, items)


def supported(values: DataFrame, detected: DataFrame, tolerance: int = 1) -> DataFrame:
    """Rows of values whose balance lies within the tolerance of a detected one of the statement.

    The band join is an equi join on balance buckets as wide as the tolerance, looking at three buckets.
    """
    width = tolerance + 1
    near = values.withColumn("b", F.floor(F.col("balance_c") / width)).withColumn("bucket", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    seen = detected.select("statement_id", F.col("balance_c").alias("seen_c"), F.floor(F.col("balance_c") / width).alias("bucket"))
    hit = (near["statement_id"] == seen["statement_id"]) & (near["bucket"] == seen["bucket"]) & (F.abs(near["balance_c"] - seen["seen_c"]) <= tolerance)
    return near.join(seen, hit, "left_semi").select("statement_id", "row_no", "balance_c").distinct()


def _supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return supported(tx.select("statement_id", "row_no", (F.col("running_c") + F.col("row_no") % 4).alias("balance_c")), with_printed_balance(tx).where("balance_c is not null").select("statement_id", "balance_c"))


def open_close(opening: Column, closing: Column, credits_: Column, debits: Column) -> Column:
    """A card's opening balance, derived from the totals where it is missing or equals the closing one."""
    derive = closing.isNotNull() & credits_.isNotNull() & debits.isNotNull() & (opening.isNull() | (opening == closing))
    return F.when(derive, closing - debits + credits_).otherwise(opening)


# Section wordings, the first that matches wins.
TRANSACTION_SECTIONS = (
    ("refunds", "refund|reversal|return"),
    ("interest", "interest"),
    ("fees", r"\bfee|service charge"),
    ("cash-advances", "cash advance"),
    ("balance-transfers", "balance transfer"),
    ("purchases", r"purchase|new charge|\bcharge"),
    ("credits", "credit"),
)


def section_token(label: Column) -> Column:
    """The fixed name of a transaction section, or null."""
    low = F.lower(label)
    out = F.when(low.rlike("payment") & ~low.rlike("due|minimum|coupon|option|enclosed|slip"), "payments")
    for name, pattern in TRANSACTION_SECTIONS:
        out = out.when(low.rlike(pattern), name)
    return out


def section_tokens(labels: Column) -> Column:
    """Distinct known sections among the first thirty labels, in order."""
    return F.array_distinct(F.filter(F.transform(F.slice(labels, 1, 30), section_token), lambda t: t.isNotNull()))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("statement_id").orderBy("line_no")) <= 30
    rows = text_lines(transactions(spark, sf_dir)).withColumn("first", first).where("first").groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return rows.select("statement_id", F.array_join(section_tokens(F.col("l.line")), ",").alias("sections"))


def sanitize(rows: DataFrame) -> DataFrame:
    """Rows of untrusted answers (statement_id, row), one each: absolute sides, a signed amount, confidence within 0 and 1;
    rows without amounts drop out.
    """
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    debit, credit = finite("row.debit"), finite("row.credit")
    amount = F.coalesce(finite("row.amount"), -F.abs(debit), F.abs(credit), F.lit(0.0))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("row.confidence", F.lit(0.7))))
    clean = rows.select("statement_id", F.trim(F.coalesce("row.description", F.lit(""))).alias("description"), money.cents(F.abs(debit)).alias("debit_c"), money.cents(F.abs(credit)).alias("credit_c"), money.cents(amount).alias("amount_c"), conf.alias("confidence"))
    return clean.where(money.has_amount(F.col("debit_c")) | money.has_amount(F.col("credit_c")) | money.has_amount(F.col("amount_c")))


ANSWER = "description string, debit double, credit double, amount double, confidence double"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as JSON from events, a line for each row, parsed back, sanitised and summed: no account is held in one cell."""
    tx = transactions(spark, sf_dir)
    row = F.struct(F.concat(F.lit(" "), "event_type").alias("description"), (F.when(F.col("row_no") % 6 == 0, 0.0).otherwise(-F.col("debit_c") / 100)).alias("debit"), (F.col("credit_c") / 100).alias("credit"), F.when(F.col("row_no") % 4 == 0, 1.7).alias("confidence"))
    body = tx.select("statement_id", F.to_json(row).alias("answer"))
    body = body.withColumn("answer", F.when(F.col("statement_id") % 10 == 0, F.concat(F.lit("{oops"), "answer")).otherwise(F.col("answer")))
    rows = sanitize(body.select("statement_id", F.from_json("answer", ANSWER).alias("row")))
    add = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy("statement_id").agg(F.count(F.lit(1)).cast("int").alias("n_rows"), add("debit_c").alias("debits_c"), add("credit_c").alias("credits_c"), add("amount_c").alias("net_c"))


H = (TX_SQL, HEAD_SQL)
V = (TX_SQL, HEAD_SQL, EDITED, FACTS)

QUERIES = {
    "validation_status": (
        lambda s, d: validate(_facts(s, d)).select("statement_id", "status", "confidence", F.size("issues").alias("n_issues"), "difference_c"),
        sql(*V, select="SELECT statement_id, status, conf AS confidence, n_issues, diff AS difference_c FROM va"),
    ),
    "conversion_state": (
        lambda s, d: validate(_facts(s, d)).select("statement_id", conversion_state(F.col("n_rows"), F.col("status"), F.col("confidence"), F.col("material"), F.col("minor"), F.col("statement_id") % 13 == 0, F.col("statement_id") % 9 == 0).alias("state")),
        sql(*V, select="""
SELECT statement_id, CASE WHEN statement_id % 13 = 0 THEN 'unsupported' WHEN n_rows = 0 OR status <> 'passed' OR (material > 0 AND NOT (material <= 3 AND material <= n_rows * 0.05)) THEN 'needs-review'
  WHEN statement_id % 9 = 0 THEN 'preview-limited' WHEN material = 0 AND minor = 0 AND conf >= 0.7 THEN 'verified' ELSE 'review-recommended' END AS state FROM va"""),
    ),
    "ai_eligibility": (
        lambda s, d: assist_reasons(validate(_facts(s, d))).select("statement_id", F.array_join("reasons", ",").alias("reasons")),
        sql(*V, select="""
SELECT statement_id, CASE WHEN status = 'passed' AND conf >= 0.7 AND n_rows > 0 AND missing_amount = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN status <> 'passed' THEN 'validation-not-passed' END,
  CASE WHEN conf < 0.7 THEN 'low-confidence' END, CASE WHEN missing_amount > 0 THEN 'row-missing-amount' END, CASE WHEN missing_meta * 10 > n_rows THEN 'rows-missing-date-or-description' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM va"""),
    ),
    "candidate_quality": (
        lambda s, d: quality_reasons(_facts(s, d)),
        sql(*V, select="""
, q AS (SELECT statement_id, [CASE WHEN aggregates > 0 THEN 'aggregate-row' END, CASE WHEN n_rows >= 2 AND md AND largest >= 1 AND absd - largest < 1 AND abs(largest - sum_debits_c) <= 1 THEN 'summary-row-as-transaction' END,
  CASE WHEN md AND itemized < 3 AND absd > 0 AND largest * 100 / absd >= 85 THEN 'too-few-itemized-rows' END] AS hard,
  [CASE WHEN missing_date * 2 > n_rows THEN 'high-missing-date-rate' END, CASE WHEN lowc * 2 > n_rows THEN 'many-low-confidence-rows' END] AS soft FROM va0)
SELECT statement_id, array_to_string(list_filter(list_concat(hard, soft), lambda x: x IS NOT NULL), ',') AS reasons, len(list_filter(hard, lambda x: x IS NOT NULL)) > 0 AS rejected FROM q"""),
    ),
    "summary_mismatch": (
        lambda s, d: _facts(s, d).where(meaningful(F.col("sum_credits_c")) | meaningful(F.col("sum_debits_c"))).select("statement_id", (F.when(meaningful(F.col("sum_credits_c")), F.abs(F.col("total_credits_c") - F.col("sum_credits_c"))).otherwise(0) + F.when(meaningful(F.col("sum_debits_c")), F.abs(F.col("total_debits_c") - F.col("sum_debits_c"))).otherwise(0)).alias("mismatch_c")),
        sql(*V, select="SELECT statement_id, CASE WHEN mc THEN abs(tc - sum_credits_c) ELSE 0 END + CASE WHEN md THEN abs(td - sum_debits_c) ELSE 0 END AS mismatch_c FROM va0 WHERE mc OR md"),
    ),
    "parser_quality": (
        lambda s, d: validate(_facts(s, d)).select("statement_id", F.when((F.col("status") == "passed") & (F.col("flagged") * 10 <= F.col("n_rows")), "good").when((F.col("n_rows") == 0) | (F.col("confidence") < 0.3), "poor").otherwise("needs-review").alias("quality"), "flagged", "low_confidence"),
        sql(*V, select="SELECT statement_id, CASE WHEN status = 'passed' AND flagged * 10 <= n_rows THEN 'good' WHEN n_rows = 0 OR conf < 0.3 THEN 'poor' ELSE 'needs-review' END AS quality, flagged, lowc AS low_confidence FROM va"),
    ),
    "residual_side": (
        lambda s, d: reconcile(transactions(s, d), headers(transactions(s, d))).select("statement_id", F.when(F.coalesce(F.abs("difference_c"), F.lit(0)) < 1, F.lit(None)).when((F.col("mode") == "credit-card") == (F.col("difference_c") > 0), "credit").otherwise("debit").alias("side")),
        sql(*H, select="""
, r AS (SELECT h.statement_id, mode, opening_c + CASE WHEN mode = 'credit-card' THEN -1 ELSE 1 END * t.n - closing_c AS diff FROM head h JOIN (SELECT statement_id, CAST(sum(signed_c) AS BIGINT) AS n FROM tx GROUP BY 1) t USING (statement_id))
SELECT statement_id, CASE WHEN diff IS NULL OR diff = 0 THEN NULL WHEN (mode = 'credit-card') = (diff > 0) THEN 'credit' ELSE 'debit' END AS side FROM r"""),
    ),
    "candidate_score": (
        lambda s, d: score(candidates(s, d)).select("statement_id", "cand_no", "name", "difference_c", "score"),
        sql(*H, _cand_sql(), select="SELECT statement_id, cand_no, name, diff AS difference_c, score FROM sc"),
    ),
    "candidate_pick": (
        lambda s, d: pick(score(candidates(s, d))).select("statement_id", "cand_no", "name", "score"),
        sql(*H, _cand_sql(), select="SELECT statement_id, cand_no, name, score FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY n_rows = 0, score DESC, cand_no) AS k FROM sc) WHERE k = 1"),
    ),
    "candidate_rank": (
        _ranked,
        sql(*V, select="SELECT statement_id, CAST(row_number() OVER (PARTITION BY statement_id // 4 ORDER BY status <> 'passed', abs(diff) ASC NULLS LAST, conf DESC, statement_id) AS INT) AS rank FROM va"),
    ),
    "candidate_beats": (
        lambda s, d: _pairs(s, d).select(F.col("p_statement_id").alias("statement_id"), beats("p", "q").alias("better")),
        sql(*V, select="""
, m AS (SELECT *, CASE WHEN mc THEN abs(tc - sum_credits_c) ELSE 0 END + CASE WHEN md THEN abs(td - sum_debits_c) ELSE 0 END AS apart FROM va)
SELECT p.statement_id, CASE WHEN q.status = 'passed' THEN p.status <> 'passed' OR q.conf > p.conf + 1e-9
  ELSE ((p.mc OR p.md) AND q.n_rows > p.n_rows AND q.apart < p.apart - 50 AND q.apart * 2 < p.apart)
    OR coalesce(abs(q.diff) < abs(p.diff) AND q.n_issues <= p.n_issues AND q.n_rows >= p.n_rows, FALSE)
    OR (q.conf > p.conf + 1e-9 AND coalesce(abs(q.diff), 1152921504606846976) <= coalesce(abs(p.diff), 1152921504606846976)) END AS better
FROM m p JOIN m q ON q.statement_id = p.statement_id + 1"""),
    ),
    "candidate_adoption": (
        lambda s, d: _pairs(s, d).select(F.col("p_statement_id").alias("statement_id"), adoption("p", "q", F.col("p_statement_id") % 3).alias("a")).select("statement_id", "a.*"),
        sql(*V, select="""
, m AS (SELECT *, CASE WHEN mc THEN abs(tc - sum_credits_c) ELSE 0 END + CASE WHEN md THEN abs(td - sum_debits_c) ELSE 0 END AS apart FROM va),
k AS (SELECT p.statement_id, p.n_rows AS pn, q.n_rows AS qn, q.status = 'passed' AS whole, coalesce(abs(q.diff) <= 100, FALSE) AS near, coalesce(CASE WHEN q.status = 'passed' THEN p.status <> 'passed' OR q.conf > p.conf + 1e-9
  ELSE ((p.mc OR p.md) AND q.n_rows > p.n_rows AND q.apart < p.apart - 50 AND q.apart * 2 < p.apart)
    OR coalesce(abs(q.diff) < abs(p.diff) AND q.n_issues <= p.n_issues AND q.n_rows >= p.n_rows, FALSE)
    OR (q.conf > p.conf + 1e-9 AND coalesce(abs(q.diff), 1152921504606846976) <= coalesce(abs(p.diff), 1152921504606846976)) END, FALSE) AS better
  FROM m p JOIN m q ON q.statement_id = p.statement_id + 1),
j AS (SELECT *, statement_id % 3 > 0 AND NOT whole AND NOT near AND pn > 1 AS lost FROM k),
a AS (SELECT *, better AND (whole OR (near AND qn >= pn) OR (pn <= 1 AND qn >= pn + 3)) AND NOT lost AS adopted FROM j)
SELECT statement_id, adopted, CASE WHEN adopted AND whole THEN 'ai-full-reconstruction-reconciled' WHEN adopted AND pn <= 1 THEN 'parser-missed-table-ai-rebuilt' WHEN adopted THEN 'ai-nearly-reconciled-keeps-rows'
  WHEN NOT better THEN 'candidate-worse-than-parser' WHEN lost THEN 'ai-drops-parser-rows-without-reconciling' ELSE 'ai-unreconciled-not-adopted' END AS reason FROM a"""),
    ),
    "multiset_compare": (
        _compare,
        sql(TX_SQL, select="""
, r AS (SELECT statement_id, CASE WHEN row_no % 10 = 1 THEN -signed_c ELSE signed_c END AS v FROM tx WHERE row_no % 10 <> 0 UNION ALL SELECT statement_id, signed_c FROM tx WHERE row_no % 25 = 7),
a AS (SELECT statement_id, signed_c AS v, count(*) AS l FROM tx GROUP BY ALL), b AS (SELECT statement_id, v, count(*) AS r FROM r GROUP BY ALL),
j AS (SELECT coalesce(a.statement_id, b.statement_id) AS statement_id, coalesce(a.v, b.v) AS v, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM a FULL JOIN b ON a.statement_id = b.statement_id AND a.v = b.v)
SELECT statement_id, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS dropped, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS added,
  CAST(coalesce(sum(l) FILTER (WHERE l > 0 AND r = 0 AND EXISTS (SELECT 1 FROM b WHERE b.statement_id = j.statement_id AND abs(b.v) = abs(j.v))), 0) AS BIGINT) AS corrected FROM j GROUP BY statement_id"""),
    ),
    "repair_plan": (
        _repair,
        sql(TX_SQL, select="SELECT statement_id, count(*) FILTER (WHERE row_no % 10 <> 0) + count(*) FILTER (WHERE row_no % 10 = 2) AS n_rows, CAST(coalesce(sum(CASE row_no % 10 WHEN 0 THEN 0 WHEN 1 THEN -5 WHEN 2 THEN signed_c + 7 ELSE signed_c END), 0) AS BIGINT) AS net_c FROM tx GROUP BY statement_id"),
    ),
    "supported_balance": (
        _supported,
        sql(TX_SQL, select="SELECT statement_id, row_no, running_c + row_no % 4 AS balance_c FROM tx t WHERE EXISTS (SELECT 1 FROM tx o WHERE o.seq % 3 = 0 AND o.statement_id = t.statement_id AND abs(o.running_c - (t.running_c + t.row_no % 4)) <= 1)"),
    ),
    "interest_fee_repair": (
        _fee_repair,
        sql(TX_SQL, select="""
, i AS (SELECT statement_id, count(*) AS n_items, sum(debit_c) AS short, sum(debit_c + CASE WHEN statement_id % 3 = 0 THEN 5 ELSE 0 END) AS items FROM tx WHERE row_no % 40 = 3 AND debit_c IS NOT NULL GROUP BY statement_id)
SELECT statement_id, CAST(short AS BIGINT) AS short_c, short > 1 AND abs(items - short) <= 2 AS applied, n_items FROM i"""),
    ),
    "resolve_open_close": (
        lambda s, d: headers(transactions(s, d)).select("statement_id", open_close(F.when(F.col("statement_id") % 2 == 0, F.col("closing_c")).otherwise(F.col("opening_c")), F.col("closing_c"), F.col("sum_credits_c"), F.col("sum_debits_c")).alias("opening_c")),
        sql(*H, select="""
SELECT statement_id, CASE WHEN closing_c IS NOT NULL AND sum_credits_c IS NOT NULL AND sum_debits_c IS NOT NULL AND (o IS NULL OR o = closing_c) THEN closing_c - sum_debits_c + sum_credits_c ELSE o END AS opening_c
FROM (SELECT *, CASE WHEN statement_id % 2 = 0 THEN closing_c ELSE opening_c END AS o FROM head)"""),
    ),
    "section_tokens": (
        _sections,
        sql(TX_SQL, LINES_SQL, select="""
, t AS (SELECT statement_id, line_no, CASE WHEN regexp_matches(low, 'payment') AND NOT regexp_matches(low, 'due|minimum|coupon|option|enclosed|slip') THEN 'payments' """
            + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in TRANSACTION_SECTIONS)
            + """ END AS tok FROM (SELECT *, lower(line) AS low FROM lines WHERE line_no <= 30)),
f AS (SELECT statement_id, tok, min(line_no) AS at_ FROM t GROUP BY ALL)
SELECT statement_id, coalesce(string_agg(tok, ',' ORDER BY at_) FILTER (WHERE tok IS NOT NULL), '') AS sections FROM f GROUP BY statement_id"""),
    ),
    "sanitize_rows": (
        _answers,
        sql(TX_SQL, select="""
, r AS (SELECT statement_id, CASE WHEN row_no % 6 = 0 THEN 0 ELSE debit_c END AS d, credit_c AS c FROM tx WHERE statement_id % 10 <> 0),
k AS (SELECT statement_id, d, c, CASE WHEN d IS NOT NULL THEN -d ELSE c END AS a FROM r WHERE coalesce(d, 0) <> 0 OR coalesce(c, 0) <> 0)
SELECT statement_id, CAST(count(*) AS INT) AS n_rows, CAST(sum(coalesce(d, 0)) AS BIGINT) AS debits_c, CAST(sum(coalesce(c, 0)) AS BIGINT) AS credits_c, CAST(sum(a) AS BIGINT) AS net_c FROM k GROUP BY statement_id"""),
    ),
    "order_gates": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.length(F.regexp_replace("text", r"\s", "")) < 24, "scanned").when(F.floor(F.col("n_chars") / 300) > 100, "too-many-pages").otherwise("ok").alias("gate")),
        r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '\s', '', 'g')) < 24 THEN 'scanned' WHEN n_chars // 300 > 100 THEN 'too-many-pages' ELSE 'ok' END AS gate FROM documents",
    ),
}
