"""Subscription events as a stream into a log and a table of accounts, both on files in the shared folder.

A batch is applied once however often it is played, and an event once however often it comes; a late one takes its place in
its account's history. So the end state is that of the batch fold over all events, for any split into batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.descriptions import next_period_end
from ..operators.ledger import EVENT_KINDS, PLAN_ARRAY, PAGES_ARRAY, STATUS, plan_of, subscription_changes, subscription_fold
from ..session import shared_folder, table

EVENT = "event_id long, type string, user_id long, plan string, period_start timestamp_ntz, state string"
LOG = f"{EVENT}, kind string, batch long, bucket int"
STATE = "user_id long, event_id long, plan string, status string, allowance int, credited_pages long, resets long, period_start timestamp_ntz, period_end timestamp_ntz, batch long, bucket int"


class SubscriptionStore:
    """Events seen, by bucket of accounts and batch, and the accounts' states after them.

    A batch writes its new events and the states of the accounts in its buckets as one folder each, named by its number and
    overwritten when the batch is played again; a bucket's states are those of its last batch. Only buckets that a batch
    touches are read: more buckets make smaller reads, and an account is a group of its own events only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    def stored(self, name: str, schema: str) -> DataFrame:
        """The table so far; empty before its first batch."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        return self.stored("log", LOG)

    def apply(self, events: DataFrame, batch: int) -> None:
        """One micro-batch of provider events; for foreachBatch."""
        new = subscription_changes(events).dropDuplicates(["event_id"]).withColumn("bucket", self.bucket())
        before = self.log().where(F.col("batch") != batch)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        known = before.where(F.col("bucket").isin(touched)).select("event_id")
        new.join(known, "event_id", "left_anti").select(*[c.split(" ")[0] for c in EVENT.split(", ")], "kind", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch}")
        history = self.log().where(F.col("bucket").isin(touched))
        self.states(history).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/batch={batch}")

    def states(self, history: DataFrame) -> DataFrame:
        """Each account's plan, status, allowance, credits and current period after its last event."""
        folded = subscription_fold(history).join(history.select("event_id", "bucket", F.when(F.col("kind") == "update", F.col("period_start")).alias("period_start")), "event_id")
        last = lambda c: F.max_by(c, "event_id").alias(c)
        start = F.max_by("period_start", F.when(F.col("period_start").isNotNull(), F.col("event_id")))
        out = folded.groupBy("user_id").agg(
            F.max("event_id").alias("event_id"), last("plan"), last("status"), last("allowance"), F.sum("credit_pages").alias("credited_pages"), F.count_if("reset").alias("resets"),
            start.alias("period_start"), F.first("bucket").alias("bucket"),
        )
        return out.withColumn("period_end", next_period_end(F.col("period_start")).cast("timestamp_ntz"))

    def accounts(self) -> DataFrame:
        """The state of every account."""
        every = self.stored("state", STATE)
        newest = every.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return every.join(F.broadcast(newest), ["bucket", "batch"]).drop("bucket", "batch")  # one row a bucket


def resets(history: DataFrame) -> DataFrame:
    """The reset record of each advanced period: user_id, event_id, reason, allowance, used_pages, period_start, period_end."""
    folded = subscription_fold(history).where("reset").select("event_id", "user_id", "credit_pages")
    rows = folded.join(history.select("event_id", "period_start"), "event_id")
    return rows.select(
        "user_id", "event_id", F.lit("monthly_reset").alias("reason"), F.col("credit_pages").alias("allowance"), F.lit(0).alias("used_pages"), "period_start",
        next_period_end(F.col("period_start")).cast("timestamp_ntz").alias("period_end"),
    )


def follow(events: DataFrame, store: SubscriptionStore, checkpoint: str) -> None:
    """Apply all that a stream of provider events holds now."""
    query = events.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    one_of = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", one_of([t for t, _ in EVENT_KINDS] + ["customer.updated"]).alias("type"), F.when(n % 17 != 0, F.col("user_id")).alias("user_id"),
        F.when(n % 11 != 0, plan_of(n)).alias("plan"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("period_start"), one_of([s for s, _ in STATUS[:5]]).alias("state"),
    )


#: Files that the query's stream reads one by one.
FILES = 4


def _streamed(spark: SparkSession, sf_dir: str) -> SubscriptionStore:
    """All events in files out of order, a third of them twice, played as a stream of one file a batch."""
    base = f"{shared_folder(spark).rstrip('/')}/subscriptions-{uuid.uuid4().hex}"
    events = provider_events(spark, sf_dir)
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = events.withColumn("turn", F.explode(again)).withColumn("file", F.pmod(F.xxhash64("event_id", "turn"), F.lit(FILES)))
    spread.drop("turn").repartitionByRange(FILES, "file").drop("file").write.parquet(f"{base}/in")
    store = SubscriptionStore(spark, f"{base}/store", 8)
    follow(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), store, f"{base}/checkpoint")
    return store


_FOLDED = f"""s AS (SELECT user_id, event_id, {PLAN_ARRAY}[event_id % 6 + 1] AS plan, {PAGES_ARRAY}[event_id % 6 + 1] AS pages, ['update', 'update', 'update', 'delete', 'update', 'fail', NULL][event_id % 7 + 1] AS kind,
  ['active', 'active', 'past_due', 'past_due', 'canceled'][event_id % 5 + 1] AS state, CAST(date_trunc('week', ts) AS TIMESTAMP) AS period_start FROM events WHERE event_id % 17 <> 0 AND user_id IS NOT NULL),
u AS (SELECT * FROM s WHERE kind IN ('delete', 'fail') OR (kind = 'update' AND event_id % 11 <> 0 AND period_start IS NOT NULL)),
t AS (SELECT *, kind = 'update' AND coalesce(period_start > last_value(CASE WHEN kind = 'update' THEN period_start END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS reset FROM u)"""

QUERIES = {
    "stream_subscriptions": (
        lambda s, d: _streamed(s, d).accounts(),
        f"""WITH {_FOLDED}, a AS (SELECT user_id, max(event_id) AS event_id, coalesce(arg_max(CASE WHEN kind = 'update' THEN plan ELSE 'free' END, event_id) FILTER (WHERE kind <> 'fail'), 'free') AS plan,
  arg_max(CASE kind WHEN 'update' THEN state WHEN 'fail' THEN 'past_due' ELSE 'canceled' END, event_id) AS status, CAST(coalesce(sum(pages) FILTER (WHERE reset), 0) AS BIGINT) AS credited_pages, count(*) FILTER (WHERE reset) AS resets,
  arg_max(period_start, event_id) FILTER (WHERE kind = 'update') AS period_start FROM t GROUP BY user_id)
SELECT user_id, event_id, plan, status, CAST({PAGES_ARRAY}[list_position({PLAN_ARRAY}, plan)] AS INT) AS allowance, credited_pages, resets, period_start, CAST(period_start + INTERVAL 1 MONTH AS TIMESTAMP) AS period_end FROM a""",
    ),
    "period_resets": (
        lambda s, d: resets(subscription_changes(provider_events(s, d))),
        f"WITH {_FOLDED} SELECT user_id, event_id, 'monthly_reset' AS reason, CAST(pages AS INT) AS allowance, 0 AS used_pages, period_start, CAST(period_start + INTERVAL 1 MONTH AS TIMESTAMP) AS period_end FROM t WHERE reset",
    ),
}
