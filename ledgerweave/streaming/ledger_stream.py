"""Quota windows and once-only charges over streams of files.

State is kept by subject: a window's start and counts. Within a micro-batch rows are taken in time order; across batches
they are taken as they come, as the service that this follows does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import CONVERSIONS, PREVIEW_HOURS, WINDOWS
from ..session import shared_folder, table
from ..sources.derived import sql

OUT = "event_id long, window_start timestamp, window_attempts int, window_pages long"
STATE = "start long, attempts int, pages long"


def quota_stream(attempts: DataFrame, hours: int = PREVIEW_HOURS) -> DataFrame:
    """Windows as of each attempt of a stream (subject, at, event_id, pages)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count, pages = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event, at, n in zip(rows["event_id"], rows["at"], rows["pages"], strict=True):
            micros = at.value // 1000
            if start is None or micros - start >= hours * 3_600_000_000:
                start, count, pages = micros, 0, 0
            count, pages = count + 1, pages + int(n)
            out.append((event, pd.Timestamp(start * 1000), count, pages))
        state.update((start, count, pages))
        yield pd.DataFrame(out, columns=["event_id", "window_start", "window_attempts", "window_pages"])

    return attempts.groupBy("subject").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def charges_once(requests: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first request of each conversion of a stream (conversion_id, at, pages); repeats within the delay are dropped."""
    return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["conversion_id"])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream yields from what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the glob lets a single file stand for a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = file_stream(spark, sf_dir, "events")
    rows = ev.select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("at"), "event_id", (F.col("event_id") % 4).alias("pages"))
    return drained(quota_stream(rows)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = file_stream(spark, sf_dir, "orders").select(k.alias("conversion_id"), F.col("o_orderdate").cast("timestamp").alias("at"), (k % 90 + 1).alias("pages"))
    twice = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("try")).where("try = 0 or conversion_id % 4 = 0").drop("try")
    return drained(charges_once(twice, "10000 days")).select("conversion_id", "pages")


QUERIES = {
    "stream_quota_windows": (
        _quota,
        "WITH RECURSIVE " + WINDOWS.strip() + " SELECT event_id, window_start, CAST(window_attempts AS INT) AS window_attempts, window_pages FROM w",
    ),
    "stream_charges_once": (_once, sql(CONVERSIONS, select="SELECT conversion_id, pages FROM conv")),
}
