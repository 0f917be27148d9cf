"""The page-credit ledger: plans, access decisions, charges, quota windows and subscriptions.

Folds that depend on what an earlier row of the same key did (charges, quota windows) run over rows partitioned by key and
sorted within partitions, one batch after another; only a key's running state is held, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..sources.derived import sql

# Monthly pages of the plans, and the preview's limits.
PLANS = (("free", 0), ("minimum", 100), ("plus", 500), ("pro", 1000), ("pro_plus_2000", 2000), ("pro_plus_3000", 3000))
PREVIEW_PAGES, PREVIEW_HOURS, PREVIEW_ATTEMPTS = 6, 12, 5
TESTER_ALLOWANCE = 100000
# A payment provider's states -> the account's.
STATUS = (("active", "active"), ("trialing", "active"), ("past_due", "past_due"), ("unpaid", "past_due"), ("canceled", "canceled"), ("incomplete_expired", "canceled"))
# A payment provider's event types that change an account -> how.
EVENT_KINDS = (
    ("checkout.session.completed", "update"),
    ("customer.subscription.created", "update"),
    ("customer.subscription.updated", "update"),
    ("customer.subscription.deleted", "delete"),
    ("invoice.payment_succeeded", "update"),
    ("invoice.payment_failed", "fail"),
)


def allowance(plan: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, pages in PLANS:
        out = F.when(plan == name, pages).otherwise(out)
    return out


def remaining(allowed: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), allowed - used)


def upload_access(allowed: Column, used: Column, pages: Column) -> Column:
    """allowed, PLAN_REQUIRED or INSUFFICIENT_PAGE_CREDITS."""
    need = F.greatest(F.lit(0), F.floor(pages))
    return F.when(allowed <= 0, "PLAN_REQUIRED").when(need > remaining(allowed, used), "INSUFFICIENT_PAGE_CREDITS").otherwise("allowed")


def effective_allowance(allowed: Column, tester: Column) -> Column:
    return F.when(tester, F.greatest(F.lit(TESTER_ALLOWANCE), allowed)).otherwise(allowed)


def preview_access(pages_used: Column, attempts: Column, pages: Column) -> Column:
    """Attempts are looked at before pages."""
    need = F.greatest(F.lit(0), F.floor(pages))
    return F.when(attempts >= PREVIEW_ATTEMPTS, "PREVIEW_ATTEMPT_LIMIT").when(need > F.greatest(F.lit(0), PREVIEW_PAGES - pages_used), "PREVIEW_PAGE_LIMIT").otherwise("allowed")


def chargeable_pages(status: Column, pages: Column, exported: Column) -> Column:
    """Verified conversions count at once, reviewed ones when exported, failed ones never."""
    return F.when((status == "verified") | ((status == "review") & exported), F.greatest(F.lit(0), F.floor(pages))).otherwise(0)


def charge_status(known: Column, owner: Column, charged: Column, status: Column, enough: Column) -> Column:
    """HTTP-like code of a review export's charge."""
    return F.when(~known, 404).when(~owner, 403).when(charged, 200).when(status != "review", 400).when(~enough, 402).otherwise(200)


def plan_of(segment: Column) -> Column:
    names = [n for n, _ in PLANS]
    return F.element_at(F.array(*map(F.lit, names)), (segment % len(names) + 1).cast("int"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per customer: plan, allowance, pages used, period."""
    k = F.col("c_custkey")
    plan = plan_of(k)
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), plan.alias("plan"), allowance(plan).cast("long").alias("allowance"), (k * 7 % 600).alias("used"), (k % 10 == 0).alias("tester"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversion per order: its customer, pages, status and time."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "review").otherwise("failed")
    return table(spark, sf_dir, "orders").select(k.alias("conversion_id"), F.col("o_custkey").alias("user_id"), (k % 90 + 1).alias("pages"), status.alias("status"), (k % 3 == 0).alias("exported"), F.col("o_orderdate").alias("created"))


PLAN_ARRAY = "[" + ", ".join(f"'{n}'" for n, _ in PLANS) + "]"
PAGES_ARRAY = "[" + ", ".join(str(p) for _, p in PLANS) + "]"
ACCOUNTS = f"acc AS (SELECT c_custkey AS user_id, {PLAN_ARRAY}[c_custkey % 6 + 1] AS plan, CAST({PAGES_ARRAY}[c_custkey % 6 + 1] AS BIGINT) AS allowance, c_custkey * 7 % 600 AS used, c_custkey % 10 = 0 AS tester FROM customer)"
CONVERSIONS = """conv AS (SELECT o_orderkey AS conversion_id, o_custkey AS user_id, o_orderkey % 90 + 1 AS pages, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'review' ELSE 'failed' END AS status,
  o_orderkey % 3 = 0 AS exported, o_orderdate AS created FROM orders)"""


def fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows with what step(state, row) -> (state, outputs) makes of them in order within each key; state begins at start(row).

    Outputs are appended to the row's columns; schema lists them.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != held:
                    held, state = row[key], start(row)
                state, made = step(state, row)
                out.append({**row, **made})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType([*rows.schema.fields, *StructType.fromDDL(schema).fields])
    target = to_arrow_schema(full)
    return rows.repartition(key).sortWithinPartitions(key, *order).select(*names).mapInArrow(run, full)


def charge(requests: DataFrame) -> DataFrame:
    """charged pages and used_after of requests (user_id, conversion_id, at, pages, allowance, used), in order of time.

    A conversion is charged once; a repeated request is answered without a charge. A request that the remaining pages
    can't serve is refused and changes nothing. A conversion is remembered from its charge to its last request only, so
    a user's state holds the repeats still to come, not all that was charged before.
    """
    repeats = Window.partitionBy("user_id", "conversion_id").orderBy("at", "request_id")

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        if row["conversion_id"] in state["open"]:
            if not row["_again"]:
                state["open"].remove(row["conversion_id"])
            return state, {"outcome": "already-charged", "charged": 0, "used_after": state["used"]}
        if max(0, row["allowance"] - state["used"]) < row["pages"]:
            return state, {"outcome": "insufficient", "charged": 0, "used_after": state["used"]}
        state["used"] += row["pages"]
        if row["_again"]:
            state["open"].add(row["conversion_id"])
        return state, {"outcome": "charged", "charged": row["pages"], "used_after": state["used"]}

    rows = requests.withColumn("_again", F.lead(F.lit(True)).over(repeats).isNotNull())
    return fold(rows, "user_id", ["at", "request_id"], lambda r: {"used": r["used"], "open": set()}, step, "outcome string, charged long, used_after long").drop("_again")


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth conversion is requested again after some 500 days, with others' requests in between."""
    c = conversions(spark, sf_dir).where("status <> 'failed'")
    twice = c.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("try")).where("try = 0 or conversion_id % 4 = 0")
    at = F.date_add(F.col("created").cast("date"), F.col("try") * 500)
    reqs = twice.join(accounts(spark, sf_dir).select("user_id", "allowance", "used"), "user_id").select(
        "user_id", "conversion_id", (F.col("conversion_id") * 2 + F.col("try")).alias("request_id"), at.alias("at"), "pages", "allowance", "used"
    )
    return charge(reqs).select("user_id", "request_id", "outcome", "charged", "used_after")


def quota_windows(attempts: DataFrame, hours: int = PREVIEW_HOURS) -> DataFrame:
    """window_start, window_attempts and window_pages of attempts (subject, at, event_id, pages), as of each attempt.

    A subject's first attempt opens a window of fixed length; one at or after its end opens the next. So windows are neither
    aligned nor sessions.
    """

    def step(state, row):
        at = row["at"]
        if state is None or (at - state[0]).total_seconds() >= hours * 3600:
            state = (at, 0, 0)
        state = (state[0], state[1] + 1, state[2] + row["pages"])
        return state, {"window_start": state[0], "window_attempts": state[1], "window_pages": state[2]}

    return fold(attempts, "subject", ["at", "event_id"], lambda r: None, step, "window_start timestamp_ntz, window_attempts int, window_pages long")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("ts").alias("at"), "event_id", (F.col("event_id") % 4).alias("pages"))


def subscription_fold(events: DataFrame) -> DataFrame:
    """Per subscription event (user_id, event_id, plan, kind, period_start): the account's state after it, and a ledger
    credit where the period advances. Updates set plan and period, failures mark past due, deletions fall back to free.
    An update sets the status to what its provider's state (column state) means, or to active where there is no such column."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    update = F.col("kind") == "update"
    start = F.when(update, F.col("period_start"))
    plan = F.when(update, F.col("plan")).when(F.col("kind") == "delete", "free")
    updated = status_map(F.col("state")) if "state" in events.columns else F.lit("active")
    state = F.when(update, updated).when(F.col("kind") == "fail", "past_due").otherwise("canceled")
    before = F.last(start, ignorenulls=True).over(past)  # an account's start is its last update's
    advanced = update & F.coalesce(F.col("period_start") > before, F.lit(True))
    now = F.coalesce(F.last(plan, ignorenulls=True).over(until), F.lit("free"))
    return events.select("user_id", "event_id", now.alias("plan"), state.alias("status"), allowance(now).alias("allowance"), F.when(advanced, allowance(F.col("plan"))).otherwise(0).alias("credit_pages"), F.coalesce(advanced, F.lit(False)).alias("reset"))


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "delete").otherwise("update")
    return table(spark, sf_dir, "events").select("user_id", "event_id", plan_of(F.col("event_id")).alias("plan"), kind.alias("kind"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("period_start"))


def subscription_changes(events: DataFrame) -> DataFrame:
    """Provider events (event_id, type, user_id, plan, period_start, state) as subscription_fold takes them.

    Left out are types that change no account, events of no known user, and updates without a plan or a period.
    """
    kind = F.lit(None).cast("string")
    for theirs, ours in EVENT_KINDS:
        kind = F.when(F.col("type") == theirs, ours).otherwise(kind)
    usable = F.col("user_id").isNotNull() & ((F.col("kind") != "update") | F.col("plan").isNotNull() & F.col("period_start").isNotNull())
    return events.withColumn("kind", kind).where(F.col("kind").isNotNull() & usable)


def _provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    one_of = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    raw = table(spark, sf_dir, "events").select(
        "event_id", one_of([t for t, _ in EVENT_KINDS] + ["customer.updated"]).alias("type"), F.when(n % 17 != 0, F.col("user_id")).alias("user_id"),
        F.when(n % 11 != 0, plan_of(n)).alias("plan"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("period_start"), one_of([s for s, _ in STATUS[:5]]).alias("state"),
    )
    return subscription_fold(subscription_changes(raw))


def status_map(state: Column) -> Column:
    out = F.lit("free")
    for theirs, ours in STATUS:
        out = F.when(state == theirs, ours).otherwise(out)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in the place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = accounts(spark, sf_dir).select("user_id", "plan", "used")
    new = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id")).distinct().select((F.col("user_id") + 1).alias("user_id"), F.lit("pro").alias("plan"), F.lit(0).cast("long").alias("used"))
    return upsert(acc, new, "user_id")


def _ledger_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions with their account: charge state by ownership, and the ledger's sum per account."""
    c, a = conversions(spark, sf_dir), accounts(spark, sf_dir)
    lines = c.withColumn("delta", -chargeable_pages(F.col("status"), F.col("pages"), F.col("exported"))).where("delta <> 0")
    sums = lines.groupBy("user_id").agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("n_lines"))
    return a.join(sums, "user_id", "left").select("user_id", "plan", F.coalesce("delta", F.lit(0)).cast("long").alias("delta"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def resolve_user(events: DataFrame, by_customer: DataFrame) -> DataFrame:
    """user_id by the event's own metadata, else by its customer."""
    return events.join(by_customer, "customer", "left").select("event_id", F.coalesce("meta_user", "known_user").alias("user_id"))


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    ev = table(spark, sf_dir, "events").select("event_id", F.when(n % 3 == 0, F.col("user_id")).alias("meta_user"), F.col("user_id").alias("customer"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("customer"), (F.col("c_custkey") + 100000).alias("known_user"))
    return resolve_user(ev, known)


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = accounts(spark, sf_dir)
    c, allowed = F.col, F.col("allowance")
    wide = effective_allowance(allowed, c("tester"))
    return a.select(
        "user_id", "plan", "allowance", remaining(allowed, c("used")).alias("remaining"), upload_access(allowed, c("used"), c("user_id") % 400).alias("access"),
        upload_access(wide, c("used"), c("user_id") % 400).alias("effective_access"), remaining(wide, c("used")).alias("effective_remaining"),
        preview_access(c("user_id") % 7, c("user_id") % 6, c("user_id") % 5).alias("preview"),
    )


def _chargeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversions(spark, sf_dir)
    owner = F.col("user_id") % 5 != 0
    code = charge_status(F.col("conversion_id") % 11 != 0, owner, F.col("conversion_id") % 7 == 0, F.col("status"), F.col("pages") < 60)
    return c.select("conversion_id", chargeable_pages(F.col("status"), F.col("pages"), F.col("exported")).cast("long").alias("pages"), code.alias("code"))


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest window of each subject that is active at a moment."""
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    w = quota_windows(_attempts(spark, sf_dir)).where(F.col("at") <= now).where(F.col("window_start") + F.expr(f"INTERVAL {PREVIEW_HOURS} HOURS") > now)
    last = w.groupBy("subject").agg(F.max_by(F.struct("window_start", "window_attempts", "window_pages"), F.struct("at", "event_id")).alias("w"))
    return last.select("subject", "w.*")


WINDOWS = """
o AS (SELECT user_id AS subject, ts AS at_, event_id, event_id % 4 AS pages, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (
  SELECT subject, n, at_, event_id, pages, at_ AS window_start, 1 AS window_attempts, CAST(pages AS BIGINT) AS window_pages FROM o WHERE n = 1
  UNION ALL
  SELECT o.subject, o.n, o.at_, o.event_id, o.pages, CASE WHEN o.at_ >= w.window_start + INTERVAL 12 HOURS THEN o.at_ ELSE w.window_start END,
    CASE WHEN o.at_ >= w.window_start + INTERVAL 12 HOURS THEN 1 ELSE w.window_attempts + 1 END, CASE WHEN o.at_ >= w.window_start + INTERVAL 12 HOURS THEN o.pages ELSE w.window_pages + o.pages END
  FROM w JOIN o ON o.subject = w.subject AND o.n = w.n + 1
)"""

QUERIES = {
    "account_access": (
        _access,
        sql(ACCOUNTS, select="""
, w AS (SELECT *, CASE WHEN tester THEN greatest(100000, allowance) ELSE allowance END AS wide, user_id % 400 AS need FROM acc)
SELECT user_id, plan, allowance, greatest(0, allowance - used) AS remaining,
  CASE WHEN allowance <= 0 THEN 'PLAN_REQUIRED' WHEN need > greatest(0, allowance - used) THEN 'INSUFFICIENT_PAGE_CREDITS' ELSE 'allowed' END AS access,
  CASE WHEN wide <= 0 THEN 'PLAN_REQUIRED' WHEN need > greatest(0, wide - used) THEN 'INSUFFICIENT_PAGE_CREDITS' ELSE 'allowed' END AS effective_access, greatest(0, wide - used) AS effective_remaining,
  CASE WHEN user_id % 6 >= 5 THEN 'PREVIEW_ATTEMPT_LIMIT' WHEN user_id % 5 > greatest(0, 6 - user_id % 7) THEN 'PREVIEW_PAGE_LIMIT' ELSE 'allowed' END AS preview FROM w"""),
    ),
    "chargeable_pages": (
        _chargeable,
        sql(CONVERSIONS, select="""
SELECT conversion_id, CASE WHEN status = 'verified' OR (status = 'review' AND exported) THEN pages ELSE 0 END AS pages,
  CASE WHEN conversion_id % 11 = 0 THEN 404 WHEN user_id % 5 = 0 THEN 403 WHEN conversion_id % 7 = 0 THEN 200 WHEN status <> 'review' THEN 400 WHEN pages >= 60 THEN 402 ELSE 200 END AS code FROM conv"""),
    ),
    "charge_ledger": (
        _charges,
        sql(CONVERSIONS, ACCOUNTS, select="""
, t AS (SELECT *, unnest([0, 1]) AS try FROM conv WHERE status <> 'failed'),
r AS (SELECT t.user_id, conversion_id, conversion_id * 2 + try AS request_id, pages, allowance, used,
    row_number() OVER (PARTITION BY t.user_id ORDER BY CAST(created AS DATE) + CAST(try * 500 AS INTEGER), conversion_id * 2 + try) AS n
  FROM t JOIN acc USING (user_id) WHERE try = 0 OR conversion_id % 4 = 0),
f AS (
  SELECT user_id, request_id, n, CASE WHEN e THEN 'charged' ELSE 'insufficient' END AS outcome, CASE WHEN e THEN pages ELSE 0 END AS charged,
    used + CASE WHEN e THEN pages ELSE 0 END AS used_after, CASE WHEN e THEN [conversion_id] ELSE [] END AS done
  FROM (SELECT *, greatest(0, allowance - used) >= pages AS e FROM r WHERE n = 1)
  UNION ALL
  SELECT user_id, request_id, n, CASE WHEN d THEN 'already-charged' WHEN e THEN 'charged' ELSE 'insufficient' END, CASE WHEN e AND NOT d THEN pages ELSE 0 END,
    had + CASE WHEN e AND NOT d THEN pages ELSE 0 END, CASE WHEN e AND NOT d THEN list_append(done, conversion_id) ELSE done END
  FROM (SELECT r.user_id, r.request_id, r.n, r.conversion_id, r.pages, f.used_after AS had, f.done, list_contains(f.done, r.conversion_id) AS d, greatest(0, r.allowance - f.used_after) >= r.pages AS e
    FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
)
SELECT user_id, request_id, outcome, CAST(charged AS BIGINT) AS charged, CAST(used_after AS BIGINT) AS used_after FROM f""").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "quota_windows": (
        lambda s, d: quota_windows(_attempts(s, d)).select("event_id", "window_start", "window_attempts", "window_pages"),
        "WITH RECURSIVE " + WINDOWS.strip() + " SELECT event_id, window_start, CAST(window_attempts AS INT) AS window_attempts, window_pages FROM w",
    ),
    "active_window": (
        _active,
        "WITH RECURSIVE " + WINDOWS.strip() + """ SELECT subject, arg_max(window_start, n) AS window_start, CAST(arg_max(window_attempts, n) AS INT) AS window_attempts, arg_max(window_pages, n) AS window_pages
FROM w WHERE at_ <= TIMESTAMP '2024-01-20 12:00:00' AND window_start + INTERVAL 12 HOURS > TIMESTAMP '2024-01-20 12:00:00' GROUP BY subject""",
    ),
    "subscription_fold": (
        lambda s, d: subscription_fold(_subscriptions(s, d)),
        f"""WITH s AS (SELECT user_id, event_id, {PLAN_ARRAY}[event_id % 6 + 1] AS plan, {PAGES_ARRAY}[event_id % 6 + 1] AS pages, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'delete' ELSE 'update' END AS kind, CAST(date_trunc('week', ts) AS TIMESTAMP) AS period_start FROM events),
t AS (SELECT *, last_value(CASE WHEN kind = 'update' THEN period_start END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  coalesce(last_value(CASE WHEN kind = 'update' THEN plan WHEN kind = 'delete' THEN 'free' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'free') AS now FROM s)
SELECT user_id, event_id, now AS plan, CASE kind WHEN 'update' THEN 'active' WHEN 'fail' THEN 'past_due' ELSE 'canceled' END AS status,
  CAST({PAGES_ARRAY}[list_position({PLAN_ARRAY}, now)] AS INT) AS allowance, CAST(CASE WHEN kind = 'update' AND coalesce(period_start > b, TRUE) THEN pages ELSE 0 END AS INT) AS credit_pages,
  kind = 'update' AND coalesce(period_start > b, TRUE) AS reset FROM t""",
    ),
    "subscription_events": (
        _provider_events,
        f"""WITH s AS (SELECT user_id, event_id, {PLAN_ARRAY}[event_id % 6 + 1] AS plan, {PAGES_ARRAY}[event_id % 6 + 1] AS pages, ['update', 'update', 'update', 'delete', 'update', 'fail', NULL][event_id % 7 + 1] AS kind,
    ['active', 'active', 'past_due', 'past_due', 'canceled'][event_id % 5 + 1] AS state, CAST(date_trunc('week', ts) AS TIMESTAMP) AS period_start FROM events WHERE event_id % 17 <> 0 AND user_id IS NOT NULL),
u AS (SELECT * FROM s WHERE kind IN ('delete', 'fail') OR (kind = 'update' AND event_id % 11 <> 0 AND period_start IS NOT NULL)),
t AS (SELECT *, last_value(CASE WHEN kind = 'update' THEN period_start END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  coalesce(last_value(CASE WHEN kind = 'update' THEN plan WHEN kind = 'delete' THEN 'free' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'free') AS now FROM u)
SELECT user_id, event_id, now AS plan, CASE kind WHEN 'update' THEN state WHEN 'fail' THEN 'past_due' ELSE 'canceled' END AS status,
  CAST({PAGES_ARRAY}[list_position({PLAN_ARRAY}, now)] AS INT) AS allowance, CAST(CASE WHEN kind = 'update' AND coalesce(period_start > b, TRUE) THEN pages ELSE 0 END AS INT) AS credit_pages,
  kind = 'update' AND coalesce(period_start > b, TRUE) AS reset FROM t""",
    ),
    "status_map": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", status_map(F.element_at(F.array(*[F.lit(t) for t, _ in STATUS], F.lit("other")), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("status")),
        "SELECT o_orderkey, ['active', 'active', 'past_due', 'past_due', 'canceled', 'canceled', 'free'][o_orderkey % 7 + 1] AS status FROM orders",
    ),
    "account_upsert": (
        _upsert,
        sql(ACCOUNTS, select="""
, n AS (SELECT DISTINCT o_custkey + 1 AS user_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT user_id, plan, used FROM acc WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT user_id, 'pro', 0 FROM n"""),
    ),
    "ledger_join": (
        _ledger_join,
        sql(CONVERSIONS, ACCOUNTS, select="""
, l AS (SELECT user_id, -CASE WHEN status = 'verified' OR (status = 'review' AND exported) THEN pages ELSE 0 END AS delta FROM conv)
SELECT user_id, plan, CAST(coalesce((SELECT sum(delta) FROM l WHERE l.user_id = a.user_id AND delta <> 0), 0) AS BIGINT) AS delta, coalesce((SELECT count(*) FROM l WHERE l.user_id = a.user_id AND delta <> 0), 0) AS n_lines FROM acc a"""),
    ),
    "resolve_user": (
        _resolve,
        "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN user_id + 100000 END AS user_id FROM events",
    ),
    "table_counts": (
        lambda s, d: accounts(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("accounts").alias("name"), "n").unionByName(conversions(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("conversions").alias("name"), "n")),
        "SELECT 'accounts' AS name, count(*) AS n FROM customer UNION ALL SELECT 'conversions', count(*) FROM orders",
    ),
}
