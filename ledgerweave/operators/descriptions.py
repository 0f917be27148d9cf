"""Queries over descriptions and printed dates: cleaning, categories, transfers, directions, date forms and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..session import table
from ..sources.derived import LINES_SQL, TX_SQL, sql, text_lines, transactions

LABELS = ("Restaurants", "retail and grocery", "Transportation", "Home and Office", "of things", "health and education")
PLACES = ("Corner Store Toronto ON", "Joe", "AB", "Big Market 24")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, description: a merchant, a place and a trailing label, by the event's number."""
    n = F.col("row_no")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return transactions(spark, sf_dir).select("statement_id", "row_no", "seq", F.concat(pick(PLACES, n), F.lit(" "), pick(LABELS, F.floor(n / 4))).alias("description"))


DESCRIBED = (
    "ds AS (SELECT statement_id, row_no, seq, ["
    + ", ".join(f"'{x}'" for x in PLACES)
    + f"][row_no % {len(PLACES)} + 1] AS place, ["
    + ", ".join(f"'{x}'" for x in LABELS)
    + f"][(row_no // 4) % {len(LABELS)} + 1] AS label FROM tx)"
)


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("row_no")
    code = F.when(n % 4 == 0, F.concat(F.lit("CA00"), n.cast("string"), F.lit("9ABC45"))).when(n % 4 == 1, F.lit("123456789012")).when(n % 4 == 2, F.lit("Robin")).otherwise("1234567")
    kind = F.when(n % 3 == 0, "e-Transfer sent").when(n % 3 == 1, "Interac transfer received").otherwise("Invoice paid")
    return transactions(spark, sf_dir).select("row_no", F.concat(kind, F.lit(" "), code, F.lit("  to Kim")).alias("description"))


def categories(rows: DataFrame) -> DataFrame:
    """Descriptions with trailing categories taken off; ambiguous ones where the statement shows a category column.

    That is shown by at least two rows of the statement that end in a distinctive category.
    """
    sure = text.split_category(F.col("description"))
    evidence = F.sum((sure["category"] != "").cast("int")).over(Window.partitionBy("statement_id"))
    rows = rows.withColumn("allow", evidence >= 2)
    return rows.withColumn("s", text.split_category(F.col("description"), F.col("allow"))).select("row_no", "s.description", "s.category")


def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, token: the order's date in one of eight printed forms."""
    n, d = F.col("o_orderkey"), F.col("o_orderdate")
    form = lambda p: F.date_format(d, p)
    token = (
        F.when(n % 8 == 0, form("yyyy-MM-dd")).when(n % 8 == 1, form("yyyy/M/d")).when(n % 8 == 2, form("MM/dd/yyyy")).when(n % 8 == 3, form("dd/MM/yyyy"))
        .when(n % 8 == 4, form("M/d/yy")).when(n % 8 == 5, form("MMM d")).when(n % 8 == 6, form("dd MMM")).otherwise(F.concat(form("MMM"), F.lit(". 45")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), token.alias("token"), (n % 3 == 0).alias("with_year"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("with_year"), F.lit(2026))
    return date_tokens(spark, sf_dir).select("o_orderkey", dates.normalize_date(F.col("token"), year).alias("date"))


def _day_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    token = F.when(n % 2 == 0, F.date_format("o_orderdate", "d/M")).otherwise(F.date_format("o_orderdate", "M-d"))
    context = F.when(n % 5 == 0, F.lit(None)).otherwise(
        F.struct(F.lit(2024).alias("start_year"), F.lit(11).alias("start_month"), F.lit(2025).alias("end_year"), F.lit(2).alias("end_month"), (n % 3 == 0).alias("crosses_year"), F.lit(False).alias("day_first"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.day_month_date(token, F.lit(2026)).alias("bare"),
        dates.resolve_day_month(token, context, n % 2 == 0, F.lit(2026)).alias("resolved"),
    )


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("o_orderkey"), F.col("o_orderdate")
    end = F.expr("o_orderdate + INTERVAL 30 DAYS")
    named = F.concat(F.date_format(d, "MMMM d"), F.when(n % 3 == 0, F.date_format(d, ", yyyy")).otherwise(""), F.lit(" to "), F.date_format(end, "MMMM d"), F.when(n % 3 != 2, F.date_format(end, ", yyyy")).otherwise(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.statement_period(named).alias("p"), F.month(d).alias("m"), F.month(end).alias("m2"), F.dayofmonth(end).alias("d2"))
    return rows.select(
        "o_orderkey", "p.start_ord", "p.end_ord", "p.crosses_year",
        dates.row_year(F.col("p"), F.col("m"), F.lit(1990)).alias("start_year"), dates.row_year(F.col("p"), F.col("m2"), F.lit(1990)).alias("end_year"),
        dates.in_period(F.col("p"), F.col("m2"), F.col("d2")).alias("inside"), dates.in_period(F.col("p"), F.lit(7), F.lit(15)).alias("july"),
    )


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("o_orderkey"), F.col("o_orderdate")
    end = F.expr("o_orderdate + INTERVAL 30 DAYS")
    body = F.concat(F.lit("Period "), F.when(n % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")), F.lit(" - "), F.when(n % 2 == 0, F.date_format(end, "dd/MM/yyyy")).otherwise(F.date_format(end, "MM/dd/yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_context(body).alias("c"), dates.period_year(body).alias("year")).select("o_orderkey", "c.start_year", "c.start_month", "c.end_month", "c.crosses_year", "c.day_first", "year")


def next_period_end(start):
    """One calendar month later at the same time of day, clamped to the month's length."""
    return F.add_months(start, 1).cast("timestamp_ntz") + (start - F.date_trunc("day", start).cast("timestamp_ntz"))


def _period_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = next_period_end(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", end.alias("ends"), (F.lit("2024-02-10").cast("timestamp_ntz") >= end).alias("expired"))


TOKENS = """
tk AS (SELECT o_orderkey, o_orderdate AS d, CAST(month(o_orderdate) AS INT) AS mo, CAST(day(o_orderdate) AS INT) AS dy, CAST(year(o_orderdate) AS INT) AS yr,
  CASE WHEN o_orderkey % 3 = 0 THEN '2026-' ELSE '' END AS pre FROM orders)"""

QUERIES = {
    "normalize_dates": (
        _normalized,
        sql(TOKENS, select="""
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2) THEN strftime(d, '%Y-%m-%d')
  WHEN o_orderkey % 8 = 3 THEN CASE WHEN dy > 12 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%d-%m') END
  WHEN o_orderkey % 8 = 4 THEN CAST(2000 + yr % 100 AS VARCHAR) || strftime(d, '-%m-%d')
  WHEN o_orderkey % 8 IN (5, 6) THEN pre || strftime(d, '%m-%d') END AS date FROM tk"""),
    ),
    "daymonth_dates": (
        _day_month,
        sql(TOKENS, select="""
, f AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 AND dy <= 12 THEN dy ELSE mo END AS bm, CASE WHEN o_orderkey % 2 = 0 AND dy <= 12 THEN mo ELSE dy END AS bd FROM tk)
SELECT o_orderkey, '2026-' || lpad(CAST(bm AS VARCHAR), 2, '0') || '-' || lpad(CAST(bd AS VARCHAR), 2, '0') AS bare,
  CASE WHEN o_orderkey % 5 = 0 THEN '2026' WHEN o_orderkey % 3 = 0 AND mo < 11 THEN '2025' ELSE '2024' END || strftime(d, '-%m-%d') AS resolved FROM f"""),
    ),
    "statement_period": (
        _periods,
        """WITH t AS (SELECT *, d + INTERVAL 30 DAYS AS e FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)),
u AS (SELECT o_orderkey, CAST((month(d) - 1) * 31 + day(d) AS INT) AS s, CAST((month(e) - 1) * 31 + day(e) AS INT) AS n, CAST(month(d) AS INT) AS m, CAST(month(e) AS INT) AS m2,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(d) AS INT) END AS ys, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(year(e) AS INT) END AS ye FROM t)
SELECT o_orderkey, s AS start_ord, n AS end_ord, s > n AS crosses_year,
  CASE WHEN s <= n THEN coalesce(ys, ye, 1990) ELSE coalesce(ys, ye - 1, ye, ys, 1990) END AS start_year,
  CASE WHEN s <= n THEN coalesce(ys, ye, 1990) WHEN m2 >= m THEN coalesce(ys, ye - 1, 1990) ELSE coalesce(ye, ys + 1, 1990) END AS end_year,
  TRUE AS inside, CASE WHEN s > n THEN 201 >= s - 10 OR 201 <= n + 10 ELSE 201 >= s - 10 AND 201 <= n + 10 END AS july FROM u""",
    ),
    "date_context": (
        _contexts,
        """WITH t AS (SELECT o_orderkey, o_orderdate AS d, o_orderdate + INTERVAL 30 DAYS AS e FROM orders),
u AS (SELECT o_orderkey, CAST(year(d) AS INT) AS y1, CAST(year(e) AS INT) AS y2,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN day(d) ELSE month(d) END AS INT) AS a1, CAST(CASE WHEN o_orderkey % 2 = 0 THEN month(d) ELSE day(d) END AS INT) AS b1,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN day(e) ELSE month(e) END AS INT) AS a2, CAST(CASE WHEN o_orderkey % 2 = 0 THEN month(e) ELSE day(e) END AS INT) AS b2 FROM t),
v AS (SELECT *, a1 > 12 OR a2 > 12 AS f FROM u),
w AS (SELECT *, CASE WHEN f THEN b1 ELSE a1 END AS sm, CASE WHEN f THEN b2 ELSE a2 END AS em FROM v)
SELECT o_orderkey, CASE WHEN ok THEN y1 END AS start_year, CASE WHEN ok THEN sm END AS start_month, CASE WHEN ok THEN em END AS end_month,
  CASE WHEN ok THEN y1 <> y2 OR sm > em END AS crosses_year, CASE WHEN ok THEN f END AS day_first,
  CASE WHEN y1 >= 2000 THEN y1 WHEN y2 >= 2000 THEN y2 END AS year
FROM (SELECT *, y1 >= 2000 AND y2 >= 2000 AND sm BETWEEN 1 AND 12 AND em BETWEEN 1 AND 12 AS ok FROM w)""",
    ),
    "next_period_end": (
        _period_ends,
        "SELECT event_id, ts + INTERVAL 1 MONTH AS ends, TIMESTAMP '2024-02-10' >= ts + INTERVAL 1 MONTH AS expired FROM events",
    ),
    "find_date_roundtrip": (
        lambda s, d: text_lines(transactions(s, d)).select("statement_id", "line_no", dates.normalize_date(dates.find_date(F.col("line")), F.lit(2026)).alias("found")),
        sql(TX_SQL, LINES_SQL, select="""
SELECT statement_id, line_no, CASE WHEN line LIKE '%' || date || '%' THEN date WHEN shape = 28 THEN '2026-04-24' END AS found FROM lines"""),
    ),
    "split_spend_category": (
        lambda s, d: categories(described(s, d)),
        sql(TX_SQL, DESCRIBED, select="""
, f AS (SELECT *, lower(label) IN ('retail and grocery', 'home and office', 'health and education') AND length(place) >= 3 AS sure,
  lower(label) IN ('restaurants', 'transportation') AND length(place) >= 3 AND place LIKE '% %' AS maybe FROM ds),
g AS (SELECT *, sure OR (maybe AND sum(CAST(sure AS INT)) OVER (PARTITION BY statement_id) >= 2) AS cut FROM f)
SELECT row_no, CASE WHEN cut THEN place ELSE place || ' ' || label END AS description, CASE WHEN cut THEN label ELSE '' END AS category FROM g"""),
    ),
    "normalize_transfer": (
        lambda s, d: transfers(s, d).select("row_no", text.normalize_transfer(F.col("description")).alias("t")).select("row_no", "t.description", "t.removed"),
        sql(TX_SQL, select="""
SELECT row_no, CASE WHEN row_no % 3 < 2 AND row_no % 4 < 2 THEN k || ' to Kim' ELSE k || ' ' || c || '  to Kim' END AS description, row_no % 3 < 2 AND row_no % 4 < 2 AS removed
FROM (SELECT row_no, CASE row_no % 3 WHEN 0 THEN 'e-Transfer sent' WHEN 1 THEN 'Interac transfer received' ELSE 'Invoice paid' END AS k,
  CASE row_no % 4 WHEN 0 THEN 'CA00' || row_no || '9ABC45' WHEN 1 THEN '123456789012' WHEN 2 THEN 'Robin' ELSE '1234567' END AS c FROM tx)"""),
    ),
    "strip_reference_numbers": (
        lambda s, d: table(s, d, "documents").select("doc_id", text.strip_references(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest")),
        r"SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\b\d{10,}\b', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)",
    ),
    "direction_prior": (
        lambda s, d: text_lines(transactions(s, d)).select("statement_id", "line_no", text.direction_from_words(F.col("line")).alias("direction"), text.card_credit_phrase(F.col("line")).alias("card_credit"), text.is_aggregate(F.col("line")).alias("aggregate")),
        sql(TX_SQL, LINES_SQL, select="SELECT statement_id, line_no, CASE WHEN " + " OR ".join(f"contains(lower(line), '{w}')" for w in text.CREDIT_WORDS) + " THEN 'credit' WHEN "
            + " OR ".join(f"contains(lower(line), '{w}')" for w in text.DEBIT_WORDS) + " THEN 'debit' END AS direction, "
            + " OR ".join(f"contains(lower(line), '{w}')" for w in text.PAYMENT_PHRASES + text.REFUND_PHRASES) + f" AS card_credit, regexp_matches(line, '{text.AGGREGATE}') OR regexp_matches(line, '{text.PLACEHOLDER}') AS aggregate FROM lines"),
    ),
    "clean_description": (
        lambda s, d: text_lines(transactions(s, d)).select("statement_id", "line_no", text.clean_description(F.concat(F.lit(" ★ • "), F.col("line"), F.lit(" "))).alias("cleaned")),
        sql(TX_SQL, LINES_SQL, select=r"SELECT statement_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS cleaned FROM lines"),
    ),
    "hash_subject": (
        lambda s, d: table(s, d, "customer").select("c_custkey", text.hash_subject("pepper", F.col("c_name")).alias("subject"), text.export_base_name(F.concat("c_name", F.lit(" Über (1).PDF"))).alias("base_name")),
        r"SELECT c_custkey, sha256('pepper|' || c_name) AS subject, regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' Über (1)'), '[^a-z0-9._-]+', '_', 'g'), '^_+', ''), '_+$', '') AS base_name FROM customer",
    ),
    "allow_list": (
        lambda s, d: table(s, d, "customer").select("c_custkey", F.concat(F.lower("c_name"), F.lit("@Example.com")).alias("email")).join(
            s.createDataFrame([("Customer#000000003@example.com; CUSTOMER#000000010@example.com, x@y.z",)], "raw string").select(F.explode(text.email_list(F.col("raw"))).alias("allowed")), F.lower("email") == F.col("allowed"), "left_semi").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE lower(c_name) IN ('customer#000000003', 'customer#000000010')",
    ),
    "safe_values": (  # every word of a text as an untrusted code
        lambda s, d: table(s, d, "documents").withColumn("words", F.split("text", " ")).select("doc_id", F.size(F.filter("words", lambda w: text.safe_code(w).isNotNull())).cast("long").alias("accepted"), F.size(F.filter("words", lambda w: text.safe_code(w).isNull())).cast("long").alias("refused"), text.safe_count((F.col("doc_id") * 1.5 - 3).cast("string")).alias("m")),
        "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[A-Za-z0-9_.:-]{1,64}'))) AS accepted, len(list_filter(string_split(text, ' '), lambda w: NOT regexp_full_match(w, '[A-Za-z0-9_.:-]{1,64}'))) AS refused, greatest(0, CAST(floor(doc_id * 1.5 - 3) AS BIGINT)) AS m FROM documents",
    ),
}
