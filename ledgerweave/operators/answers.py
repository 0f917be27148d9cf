"""A model's answers: JSON of several shapes, read field by field with every type checked, and the candidate they make.

An answer is untrusted: what has another type than asked for counts as absent, labels become fixed tokens, and a balance
counts only where the statement shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..session import materialised
from ..sources.derived import TX_SQL, sql, transactions
from .evidence import other_section
from .statements import meaningful, section_token, supported

# Rows of a usable answer, labels read of a list, issues kept of a row, the kinds of statements.
MOST_ROWS, MOST_LABELS, MOST_ISSUES = 2000, 30, 10
KINDS = ("bank-account", "credit-card", "unknown")
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(type_of(v), F.lit("OBJECT")), F.lit(False))


def string_at(v: Column, path: str) -> Column:
    return F.when(type_of(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "double")
    return F.when(type_of(at(v, path)).rlike(NUMBER) & ~F.isnan(found) & (F.abs(found) < float("inf")), found)


def flag_at(v: Column, path: str) -> Column:
    return F.when(type_of(at(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def list_at(v: Column, path: str) -> Column:
    return F.when(F.startswith(type_of(at(v, path)), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>"))


def tokens_at(v: Column, path: str, token) -> Column:
    """Distinct tokens of the first labels of a list, in order; no free text gets through."""
    labels = F.slice(F.coalesce(list_at(v, path), F.array().cast("array<variant>")), 1, MOST_LABELS)
    return F.array_distinct(F.filter(F.transform(labels, lambda x: token(string_at(x, "$"))), lambda t: t.isNotNull()))


def read_answers(answers: DataFrame) -> DataFrame:
    """(statement_id, answer) as a tagged union: form, candidate, repair_plan, unsafe, and what is said of sections.

    form is what the answer gives: candidate (also as a list of rows beside the statement's fields), repair-plan,
    no-safe-reconstruction (the first of these that it has) or invalid: broken JSON, no object, or none of the three.
    """
    v = F.col("v")
    alias = F.struct(
        *[at(v, f"$.{k}").alias(k) for k in ("statementKind", "selectedSectionIndex", "openingBalance", "closingBalance", "summaryTotals", "confidence", "issues")],
        at(v, "$.reconstructedTransactions").alias("transactions"),
    )
    rows = answers.select("statement_id", F.try_parse_json("answer").alias("v"))
    rows = materialised(rows.withColumn("v", F.when(is_object(v), v)), "answers")  # parsed once, whatever is read of it
    own = at(v, "$.candidate")
    candidate = F.when(is_object(own), own).when(list_at(v, "$.reconstructedTransactions").isNotNull(), F.parse_json(F.to_json(alias)))
    plan = at(v, "$.repairPlan")
    unsafe = F.coalesce(string_at(v, "$.noSafeReconstruction"), string_at(v, "$.noSafeReconstruction.reason"), string_at(v, "$.noSafeReconstructionReason"))
    rows = rows.withColumns({"candidate": candidate, "repair_plan": F.when(is_object(plan), plan), "unsafe": F.nullif(unsafe, F.lit(""))})
    rows = materialised(rows, "shapes")
    form = F.when(F.col("candidate").isNotNull(), "candidate").when(F.col("repair_plan").isNotNull(), "repair-plan").when(F.col("unsafe").isNotNull(), "no-safe-reconstruction").otherwise("invalid")
    said = F.when(form != "invalid", v)
    return rows.select(
        "statement_id", form.alias("form"), "candidate", "repair_plan", "unsafe", tokens_at(said, "$.detectedTransactionSections", section_token).alias("sections"),
        tokens_at(said, "$.ignoredNonTransactionSections", other_section).alias("other_sections"), flag_at(said, "$.sectionTotalsMatch").alias("totals_match"),
        section_token(string_at(said, "$.possibleMissingSection")).alias("missing_section"), money.cents(number_at(said, "$.possibleMissingAmount")).alias("missing_c"),
    )


def answer_rows(read: DataFrame) -> DataFrame:
    """The rows of candidates: statement_id, seq, dates, description, debit_c, credit_c, amount_c, balance_c, confidence, issues.

    An answer without rows, or with more than MOST_ROWS of them, has none; entries that are no objects, and rows without an
    amount on any side, drop out. Sides are absolute; the amount is signed, from the sides where it isn't given.
    """
    listed = list_at(F.col("candidate"), "$.transactions")
    rows = read.select("statement_id", F.when(F.size(listed) <= MOST_ROWS, listed).alias("listed"))
    rows = rows.select("statement_id", F.posexplode("listed").alias("seq", "v"))
    v = F.col("v")
    rows = materialised(rows.where(is_object(v)), "entries").withColumns({k: number_at(v, f"$.{k}") for k in ("debit", "credit", "amount", "balance", "confidence")})
    amount = F.coalesce("amount", -F.abs("debit"), F.abs("credit"), F.lit(0.0))
    issues = F.filter(F.transform(F.coalesce(list_at(v, "$.issues"), F.array().cast("array<variant>")), lambda x: string_at(x, "$")), lambda x: x.isNotNull())
    rows = rows.select(
        "statement_id", "seq", string_at(v, "$.transactionDate").alias("date"), string_at(v, "$.postingDate").alias("posted"), F.trim(F.coalesce(string_at(v, "$.description"), F.lit(""))).alias("description"),
        money.cents(F.abs("debit")).alias("debit_c"), money.cents(F.abs("credit")).alias("credit_c"), money.cents(amount).alias("amount_c"), money.cents(F.col("balance")).alias("balance_c"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)))).alias("confidence"), F.slice(issues, 1, MOST_ISSUES).alias("issues"),
    )
    return rows.where(money.has_amount(F.col("debit_c")) | money.has_amount(F.col("credit_c")) | money.has_amount(F.col("amount_c")))


def independent_candidates(read: DataFrame, rows: DataFrame, parser: DataFrame, detected: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Candidates of answers on their own: kind, balances, totals and why one can't be used (reason, null: it can).

    parser: statement_id, kind, opening_c, closing_c, sum_credits_c, sum_debits_c, missed (whether the parser likely missed
    the table). A balance that the answer gives counts if it is within a cent of a detected one, or if the answer names an
    image that was shown (refs: statement_id, ref); else the parser's is taken and the candidate is unsupported.
    """
    c = F.col("candidate")
    said = read.where("form = 'candidate'").select(
        "statement_id", string_at(c, "$.statementKind").alias("said_kind"), money.cents(number_at(c, "$.openingBalance")).alias("said_open"), money.cents(number_at(c, "$.closingBalance")).alias("said_close"),
        money.cents(number_at(c, "$.summaryTotals.totalCredits")).alias("said_credits"), money.cents(number_at(c, "$.summaryTotals.totalDebits")).alias("said_debits"),
        number_at(c, "$.selectedSectionIndex").cast("int").alias("section_index"), string_at(c, "$.visualEvidenceReference").alias("ref"),
    )
    ends = said.select("statement_id", F.explode(F.array(*[F.struct(F.lit(k).alias("row_no"), F.col(n).alias("balance_c")) for k, n in enumerate(("said_open", "said_close"))])).alias("e")).select("statement_id", "e.*")
    shown = supported(ends.where("balance_c is not null"), detected).groupBy("statement_id").agg(F.bool_or(F.col("row_no") == 0).alias("open_shown"), F.bool_or(F.col("row_no") == 1).alias("close_shown"))
    sums = rows.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("debit_c"), F.lit(0)).alias("debits_c"), F.coalesce(F.sum("credit_c"), F.lit(0)).alias("credits_c"))
    out = said.join(parser, "statement_id").join(shown, "statement_id", "left").join(sums, "statement_id", "left")
    backed = F.lit(False)
    if refs is not None:
        out = out.join(refs.select("statement_id", "ref", F.lit(True).alias("backed")).distinct(), ["statement_id", "ref"], "left")
        backed = F.coalesce("backed", F.lit(False))
    fine = lambda given, seen: F.col(given).isNull() | F.coalesce(seen, F.lit(False)) | backed
    out = out.withColumns({"open_fine": fine("said_open", "open_shown"), "close_fine": fine("said_close", "close_shown")})
    pick = lambda ok, given, own: F.when(F.col(ok), F.coalesce(given, own)).otherwise(F.col(own))
    out = out.withColumns(
        {
            "opening": pick("open_fine", "said_open", "opening_c"), "closing": pick("close_fine", "said_close", "closing_c"),
            "sum_credits_c": F.coalesce("said_credits", "sum_credits_c"), "sum_debits_c": F.coalesce("said_debits", "sum_debits_c"),
        }
    )
    active = meaningful(F.col("sum_credits_c")) | meaningful(F.col("sum_debits_c"))
    none = (F.col("credits_c") < 1) & (F.col("debits_c") < 1)
    reason = (
        F.when(F.col("n_rows").isNull(), F.when(F.col("missed"), "no-transaction-table-candidate").otherwise("no-usable-rows"))
        .when(~F.col("open_fine") | ~F.col("close_fine"), "unsupported-balance")
        .when(active & (none | (F.col("n_rows") <= 1)), "ai-returned-near-zero-rows")
        .when(active & (F.col("opening") == F.col("closing")), "ai-ignored-summary-totals")
    )
    kind = F.when(F.col("said_kind").isin(*KINDS), F.col("said_kind")).otherwise(F.col("kind"))
    return out.select(
        "statement_id", kind.alias("kind"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("credits_c", F.lit(0)).alias("credits_c"), F.coalesce("debits_c", F.lit(0)).alias("debits_c"),
        F.col("opening").alias("opening_c"), F.col("closing").alias("closing_c"), "sum_credits_c", "sum_debits_c", "section_index", reason.alias("reason"),
    )


#: Events of an answer in the queries.
PAGE = 20


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every page of an account's events, of a shape that the page's number implies: id, answer and the page's figures."""
    tx = transactions(spark, sf_dir).withColumn("id", F.col("statement_id") * 1000 + F.floor((F.col("seq") - 1) / PAGE))
    dollars = lambda c: F.col(c) / 100
    odd = F.col("row_no") % 5 == 0  # a side that is no number
    item = F.to_json(
        F.struct(
            F.col("date").alias("transactionDate"), F.when(F.col("row_no") % 7 != 0, F.concat(F.lit(" "), "event_type")).alias("description"), F.when(odd, F.lit(None)).otherwise(dollars("debit_c")).alias("debit"),
            dollars("credit_c").alias("credit"), F.when(odd, F.lit("12")).alias("amount"), F.when(F.col("row_no") % 4 == 0, 1.7).alias("confidence"),
        )
    )
    pages = tx.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("l"), F.min_by(F.col("running_c") - F.col("signed_c"), "seq").alias("opening_c"), F.max_by("running_c", "seq").alias("closing_c"),
        F.sum("credit_c").alias("sum_credits_c"), F.sum("debit_c").alias("sum_debits_c"),
    )
    k, rows = F.col("id") % 9, F.concat(F.lit("["), F.array_join("l.item", ","), F.lit(',5,"x",null]'))
    ends = F.format_string('"statementKind":"%s","openingBalance":%s,"closingBalance":%s', F.when(F.col("id") % 2 == 0, "bank-account").otherwise("other"), dollars("opening_c") + F.when(F.col("id") % 4 == 0, 0.02).otherwise(0.01), dollars("closing_c"))
    sections = '"detectedTransactionSections":["Your payments",3,"Interest","payments due"," new charges","INTEREST"],"ignoredNonTransactionSections":["Rewards","nothing known"],"sectionTotalsMatch":%s,"possibleMissingSection":"Fees","possibleMissingAmount":%s'
    said = F.format_string(sections, F.when(F.col("id") % 3 == 0, "true").otherwise('"yes"'), F.when(F.col("id") % 5 == 0, '"1"').otherwise("1.25"))
    wrap = lambda *parts: F.concat(F.lit("{"), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("}"))
    answer = (
        F.when(k <= 2, wrap('"candidate":{', ends, ',"selectedSectionIndex":2,"transactions":', rows, "},", said))
        .when(k == 3, wrap(ends, ',"reconstructedTransactions":', rows, ",", said))
        .when(k == 4, wrap('"repairPlan":{"steps":[]},"noSafeReconstruction":"","candidate":[],', said))
        .when(k == 5, wrap('"noSafeReconstruction":{"reason":"too faint"},', said))
        .when(k == 6, wrap('"noSafeReconstructionReason":"blurred"'))
        .when(k == 7, F.concat(F.lit("["), rows, F.lit("]")))
        .otherwise(F.concat(F.lit('{"candidate":{'), ends))
    )
    return pages.select(F.col("id").alias("statement_id"), answer.alias("answer"), "opening_c", "closing_c", "sum_credits_c", "sum_debits_c")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_answers(_answers(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return read.select("statement_id", "form", "unsafe", joined("sections"), joined("other_sections"), "totals_match", "missing_section", "missing_c")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against the parser's figures; a third of the parsers has missed the table, every fifth knows no balance."""
    raw = _answers(spark, sf_dir)
    read = read_answers(raw)
    none = F.col("statement_id") % 5 == 0
    parser = raw.select("statement_id", F.lit("credit-card").alias("kind"), "opening_c", F.when(~none, F.col("closing_c")).alias("closing_c"), "sum_credits_c", "sum_debits_c", (F.col("statement_id") % 3 == 0).alias("missed"))
    detected = parser.select("statement_id", F.explode(F.array("opening_c", "closing_c")).alias("balance_c")).where("balance_c is not null")
    return independent_candidates(read, answer_rows(read), parser, detected)


_PAGES = f"""
pg AS (SELECT *, statement_id * 1000 + (seq - 1) // {PAGE} AS id FROM tx),
p AS (SELECT id, id % 9 AS k, arg_min(running_c - signed_c, seq) AS o, arg_max(running_c, seq) AS c, CAST(sum(credit_c) AS BIGINT) AS sc, CAST(sum(debit_c) AS BIGINT) AS sd FROM pg GROUP BY id),
rw AS (SELECT id, CASE WHEN row_no % 5 <> 0 THEN debit_c END AS d, credit_c AS c FROM pg WHERE (row_no % 5 <> 0 AND debit_c > 0) OR credit_c > 0),
su AS (SELECT id, count(*) AS n, CAST(coalesce(sum(d), 0) AS BIGINT) AS d, CAST(coalesce(sum(c), 0) AS BIGINT) AS cr FROM rw GROUP BY id)"""

QUERIES = {
    "answer_forms": (
        _forms,
        sql(TX_SQL, _PAGES, select="""
SELECT id AS statement_id, CASE WHEN k <= 3 THEN 'candidate' WHEN k = 4 THEN 'repair-plan' WHEN k <= 6 THEN 'no-safe-reconstruction' ELSE 'invalid' END AS form, CASE k WHEN 5 THEN 'too faint' WHEN 6 THEN 'blurred' END AS unsafe,
  CASE WHEN k <= 5 THEN 'payments,interest,purchases' ELSE '' END AS sections, CASE WHEN k <= 5 THEN 'rewards' ELSE '' END AS other_sections, CASE WHEN k <= 5 AND id % 3 = 0 THEN TRUE END AS totals_match,
  CASE WHEN k <= 5 THEN 'fees' END AS missing_section, CASE WHEN k <= 5 AND id % 5 <> 0 THEN CAST(125 AS BIGINT) END AS missing_c FROM p"""),
    ),
    "answer_rows": (
        lambda s, d: answer_rows(read_answers(_answers(s, d))).select("statement_id", "date", "description", "debit_c", "credit_c", "amount_c", "confidence"),
        sql(TX_SQL, _PAGES, select="""
SELECT id AS statement_id, date, CASE WHEN row_no % 7 <> 0 THEN event_type ELSE '' END AS description, CASE WHEN row_no % 5 <> 0 THEN debit_c END AS debit_c, credit_c, coalesce(credit_c, -debit_c) AS amount_c, CAST(CASE WHEN row_no % 4 = 0 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence
FROM pg WHERE id % 9 <= 3 AND ((row_no % 5 <> 0 AND debit_c > 0) OR credit_c > 0)"""),
    ),
    "independent_candidates": (
        _candidates,
        sql(TX_SQL, _PAGES, select="""
, f AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(su.d, 0) AS d, coalesce(cr, 0) AS cr, id % 4 <> 0 AS open_fine, id % 5 <> 0 OR abs(p.c - o) <= 1 AS close_fine FROM p LEFT JOIN su USING (id) WHERE k <= 3),
g AS (SELECT *, CASE WHEN open_fine THEN o + 1 ELSE o END AS opening, CASE WHEN close_fine THEN c END AS closing FROM f)
SELECT id AS statement_id, CASE WHEN id % 2 = 0 THEN 'bank-account' ELSE 'credit-card' END AS kind, n AS n_rows, cr AS credits_c, d AS debits_c, opening AS opening_c, closing AS closing_c, sc AS sum_credits_c, sd AS sum_debits_c,
  CASE WHEN k <= 2 THEN 2 END AS section_index,
  CASE WHEN n = 0 THEN CASE WHEN id % 3 = 0 THEN 'no-transaction-table-candidate' ELSE 'no-usable-rows' END WHEN NOT open_fine OR NOT close_fine THEN 'unsupported-balance'
    WHEN (coalesce(sc, 0) > 0 OR coalesce(sd, 0) > 0) AND (n <= 1 OR (cr < 1 AND d < 1)) THEN 'ai-returned-near-zero-rows' WHEN (coalesce(sc, 0) > 0 OR coalesce(sd, 0) > 0) AND opening = closing THEN 'ai-ignored-summary-totals' END AS reason FROM g"""),
    ),
}
