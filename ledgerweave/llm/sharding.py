"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets take another bit."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, text_mark, written

#: Bits of the hash, from the first twelve hex digits of md5.
HASH_BITS = 48
#: Bits by which a pass looks deeper than the mean bucket needs.
AHEAD_BITS = 4
DEFAULT_LIMIT = 64 << 20
#: The query's limit: small objects for loaders that shuffle finely.
QUERY_LIMIT = 1 << 20


def assign_shards(docs: DataFrame, limit_bytes: int = DEFAULT_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (its prefix bits), depth, shard_bytes, shard_docs, over_limit, for every row of docs.

    The directory starts with one bucket of all rows; a bucket above limit_bytes splits on the next bit of the hash of
    doc_id, until each fits. A pass sums the bytes of fine cells once and of all their prefixes from those cells; a
    prefix that fits, of a parent that doesn't, is a bucket, and the directory lists its cells. Cells that are too large
    themselves go to a deeper pass.

    Defined cases: a null text has no bytes, a null doc_id hashes as the empty string; rows of one doc_id stay together,
    so a single document (or the rows of one id) larger than the limit is a shard of its own at full depth, flagged
    over_limit; an empty table gives an empty result; other columns are ignored.
    """
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), bits.alias("h")), "hashes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total) / limit_bytes))) + AHEAD_BITS)
    prefix = lambda column, d: F.shiftright(F.col(column), HASH_BITS - d)
    live, shards, start = rows, None, 0
    while True:
        cells = live.groupBy(prefix("h", depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        cells = written(cells, "cells")
        levels = F.explode(F.sequence(F.lit(max(0, start - 1)), F.lit(depth))).alias("depth")
        at = cells.select("bytes", "docs", "cell", levels).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        sums = written(sums, "prefixes")
        # a bucket is a prefix that fits and whose parent doesn't; a parent has two children, so no key is hot here
        large = sums.where(f"shard_bytes > {limit_bytes}").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = sums.where((F.col("shard_bytes") <= limit_bytes) | (F.col("depth") == HASH_BITS))
        leaf = fits.withColumn("parent", F.shiftright("prefix", 1)).join(large, ["depth", "parent"], "left_semi").drop("parent")
        if start == 0:
            leaf = leaf.unionByName(fits.where("depth = 0"))
        span = F.expr(f"shiftleft(1L, {depth} - depth)")
        own = F.sequence(F.col("prefix") * span, F.col("prefix") * span + span - 1)
        leaf = leaf.select(F.explode(own).alias("cell"), "prefix", "depth", "shard_bytes", "shard_docs").join(cells.select("cell"), "cell", "left_semi")
        leaf = written(leaf, "directory")
        discard(sums)
        placed = live.withColumn("cell", prefix("h", depth)).join(leaf, "cell")
        shards = placed if shards is None else shards.unionByName(placed)
        if depth == HASH_BITS:
            break
        rest = cells.join(leaf, "cell", "left_anti").select("cell")
        if rest.isEmpty():
            break
        live = written(live.withColumn("cell", prefix("h", depth)).join(rest, "cell", "left_semi").drop("cell"), "hashes")
        start, depth = depth + 1, min(HASH_BITS, depth + 2 * AHEAD_BITS)
    return shards.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        "shard_bytes",
        "shard_docs",
        (F.col("shard_bytes") > limit_bytes).alias("over_limit"),
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = DEFAULT_LIMIT) -> str:
    """docs written as one folder per shard, its name in the partition column, whose name is returned.

    That column is `shard`, with underscores behind where docs has such a column itself. A shard is written by one task,
    as it fits the limit; the rows of one id that don't fit make as many files as they need.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    tag = uuid.uuid4().hex  # no column of docs has such a name
    there, parts = f"__id_{tag}", f"__parts_{tag}"
    where = assign_shards(docs, limit_bytes).select(
        F.col("doc_id").alias(there), F.concat(F.lit("s"), "shard").alias(name), F.ceil(F.col("shard_bytes") / limit_bytes).alias(parts)
    )
    joined = docs.join(where.distinct(), docs["doc_id"].eqNullSafe(F.col(there))).drop(there)
    salt = F.pmod(text_mark("text"), F.greatest(F.col(parts), F.lit(1)))
    joined.repartition(name, salt).drop(parts).write.partitionBy(name).parquet(path)
    return name


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_LIMIT)


ORACLE = {
    "op5_extendible_shards": f"""
WITH t AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), pre AS (
  SELECT t.*, d.depth, h >> (48 - d.depth) AS prefix
  FROM t, (SELECT unnest(generate_series(0, 48)) AS depth) d
), sums AS (
  SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM pre GROUP BY depth, prefix
), leaf AS (
  SELECT pre.doc_id, min(pre.depth) AS depth FROM pre JOIN sums USING (depth, prefix)
  WHERE sums.b <= {QUERY_LIMIT} OR depth = 48 GROUP BY pre.doc_id
)
SELECT t.doc_id, t.n_bytes,
       CASE WHEN l.depth = 0 THEN '' ELSE right(repeat('0', 48) || bin(h >> (48 - l.depth)), CAST(l.depth AS INT)) END AS shard,
       CAST(l.depth AS INT) AS depth, CAST(s.b AS BIGINT) AS shard_bytes, s.n AS shard_docs, s.b > {QUERY_LIMIT} AS over_limit
FROM t JOIN leaf l USING (doc_id) JOIN sums s ON s.depth = l.depth AND s.prefix = h >> (48 - l.depth)"""
}
