"""Product quantisation of vectors in whole numbers: nearest entries by limb-split exact matrix products.

The driver holds the codebooks (parts x entries x positions); vectors are assigned and summed in tasks, and Spark adds the
sums of the tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_short, slices, with_package, written
from .vectors import floored, is_sound

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose distances to all entries are held at a time.
ROWS = 1024


def limbs(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Whole numbers as count limbs of so many bits, lowest first; the last one carries the sign."""
    lower = [(values >> bits * k & (1 << bits) - 1).astype(np.float64) for k in range(count - 1)]
    return [*lower, (values >> bits * (count - 1)).astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y of int64 matrices (any leading axes), exact wherever the result fits an int64.

    Numbers are broken into limbs short enough for a float64 product of matrices to stay below 2^53; the products of limbs
    are shifted to their places and added in int64.
    """
    inner = x.shape[-1]
    bits = (53 - max(1, inner).bit_length()) // 2
    count = lambda m: max(1, -(-(int(np.abs(m).max(initial=0)).bit_length() + 1) // bits))
    total = np.zeros((*np.broadcast_shapes(x.shape[:-2], y.shape[:-2]), x.shape[-2], y.shape[-1]), dtype=np.int64)
    right = limbs(y, bits, count(y))
    for a, p in enumerate(limbs(x, bits, count(x))):
        for b, q in enumerate(right):
            if bits * (a + b) < 64:
                total += (p @ q).astype(np.int64) << bits * (a + b)
    return total


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for x (parts, rows, positions) in books (parts, entries, positions)."""
    far = (books * books).sum(axis=2)[:, None, :] - 2 * exact_products(x, books.transpose(0, 2, 1))
    index = far.argmin(axis=2)  # the first of equal ones
    return index, np.take_along_axis(far, index[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)


class Shape:
    """How vectors become parts of whole numbers."""

    def __init__(self, width: int, parts: int, scale: int):
        self.parts, self.scale, self.each = parts, scale, -(-width // parts)
        self.width = self.parts * self.each
        # so bounded, the distances of a vector add up to less than 2^62
        self.largest = math.isqrt((1 << 62) // max(1, self.width)) // 2

    def split(self, column: pa.Array) -> np.ndarray:
        whole = floored(column, self.scale, self.width, self.largest)
        return np.ascontiguousarray(whole.reshape(len(whole), self.parts, self.each).transpose(1, 0, 2))


def refined(vectors: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floored mean of the parts nearest to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, each = books.shape

    def run(batches):
        books = sent.value
        counts, sums = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, each), dtype=np.int64)
        for batch in slices(batches, ROWS):
            x = shape.split(batch.column(2))
            flat = (nearest(x, books)[0] + np.arange(parts)[:, None] * entries).ravel()
            counts += np.bincount(flat, minlength=parts * entries)
            np.add.at(sums, flat, x.reshape(len(flat), each))
        at = np.repeat(np.flatnonzero(counts), each)
        place = np.tile(np.arange(each), len(at) // max(1, each))
        yield pa.RecordBatch.from_pydict({"entry": pa.array(at, pa.int32()), "place": pa.array(place, pa.int32()), "n": counts[at], "total": sums[at, place]})

    found = vectors.mapInArrow(run, "entry int, place int, n long, total long").groupBy("entry", "place")
    found = found.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = books.copy().reshape(parts * entries, each)
    for r in found:  # at most one row for each number of the codebooks
        new[r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new.reshape(books.shape)


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of the sound rows of (vec_id, embedding, label) as a written table, the codebooks).

    A component counts as floor(scale * component). Each part position's codebook starts as that part of the vectors of the
    smallest vec_ids and is refined in rounds. code has two hex digits a part; codebooks are (parts, entries, positions).

    Defined cases: null vectors and those with a null or non-finite component are dropped; vectors that don't divide into equal
    parts, or are shorter than the longest, count as filled up with zeros; fewer sound vectors than entries make codebooks
    of as many entries, and none make empty ones; of rows that repeat a vec_id the smaller vector comes first, and null
    vec_ids last; whole numbers are bounded so that a vector's distances add up to less than 2^62 (2^27 for 64 components);
    other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold the index of 1 to 256 entries")
    with_package(rows.sparkSession)
    vectors = rows.where(is_sound("embedding"))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    shape = Shape(width, parts, scale)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    column = pa.array([r["embedding"] for r in first], pa.list_(pa.float64()))
    books = shape.split(column)
    for _ in range(rounds if first else 0):
        books = refined(vectors, shape, books)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in slices(batches, ROWS):
            index, far = nearest(shape.split(batch.column(2)), sent.value)
            text = index.T.astype(np.uint8).tobytes().hex()
            code = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(far.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return written(vectors.mapInArrow(run, "vec_id long, label string, code string, error long"), "codes"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    errors = codes.groupBy("label").agg(F.try_sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    errors = errors.select(F.col("label").alias("same"), F.expr("try_cast(label_error AS long)").alias("label_error"))
    errors = broadcast_if_short(errors, "same")
    joined = codes.join(errors, codes["label"].eqNullSafe(errors["same"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


ORACLE = {
    "op13_vector_codes": """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), shape AS (SELECT (max(len(e)) + 15) // 16 AS each FROM kept
), ranked AS (
  SELECT vec_id, label, e, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS r FROM kept
), x AS MATERIALIZED (
  SELECT r, (p - 1) // each AS part, (p - 1) % each AS pos, CAST(floor(256 * coalesce(e[p], 0)) AS BIGINT) AS v
  FROM (SELECT r, e, each, unnest(range(1, 16 * each + 1)) AS p FROM ranked, shape)
), c0 AS MATERIALIZED (SELECT part, r AS entry, pos, v FROM x WHERE r < 64
), a0 AS MATERIALIZED (
  SELECT r, part, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT x.r, x.part, c0.entry, sum((x.v - c0.v) * (x.v - c0.v)) AS d FROM x JOIN c0 USING (part, pos) GROUP BY ALL) GROUP BY ALL
), c1 AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, v) AS v FROM c0 LEFT JOIN (
    SELECT part, entry, pos, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM x JOIN a0 USING (r, part) GROUP BY ALL) USING (part, entry, pos)
), a1 AS MATERIALIZED (
  SELECT r, part, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT x.r, x.part, c1.entry, sum((x.v - c1.v) * (x.v - c1.v)) AS d FROM x JOIN c1 USING (part, pos) GROUP BY ALL) GROUP BY ALL
), c2 AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, v) AS v FROM c1 LEFT JOIN (
    SELECT part, entry, pos, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM x JOIN a1 USING (r, part) GROUP BY ALL) USING (part, entry, pos)
), a2 AS MATERIALIZED (
  SELECT r, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT x.r, x.part, c2.entry, sum((x.v - c2.v) * (x.v - c2.v)) AS d FROM x JOIN c2 USING (part, pos) GROUP BY ALL) GROUP BY ALL
), coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
FROM coded JOIN ranked USING (r)"""
}
