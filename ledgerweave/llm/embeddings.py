"""Near-dedup of embeddings: sign hashing by random hyperplanes in several tables, exact cosine, connected components."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, with_package, written

THRESHOLD = 0.98
#: Signs in a table's key.
BITS = 16
#: Keys that a long holds; its top bits stay free, so that sums of keys don't overflow.
KEYS_A_WORD = 3
#: Probability that a pair at the threshold meets in no table.
MISS = 1e-7
SEED = 7


def tables_for(threshold: float, bits: int = BITS, miss: float = MISS) -> int:
    """Tables so that a pair at the threshold is missed with at most the given probability: a sign agrees with 1 - angle / pi."""
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - meets))


@functools.lru_cache(maxsize=8)
def planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((dim, count))


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Finite, non-zero vectors in double precision, scaled by a power of two that brings the largest component near 1; None for any other.

    The scaling is exact and leaves directions as they are, so that no square under- or overflows.
    """
    if not isinstance(column, pa.ListArray):
        column = column.cast(pa.list_(column.type.value_type))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for k in range(len(column)):
        v = values[offsets[k] : offsets[k + 1]] if valid[k] else values[:0]
        if not len(v) or not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
        out.append(v + 0.0)  # -0.0 becomes 0.0
    return out


def packed_keys(vectors: np.ndarray, tables: int) -> np.ndarray:
    """The tables' keys of many vectors, from one product: KEYS_A_WORD keys of BITS bits in each of words_for(tables) longs."""
    signs = vectors @ planes(vectors.shape[1], tables * BITS) > 0
    words, width = words_for(tables), KEYS_A_WORD * BITS
    dense = np.zeros((len(vectors), words * width), dtype=np.uint8)
    dense[:, : tables * BITS] = signs
    padded = np.zeros((len(vectors), words, 64), dtype=np.uint8)
    padded[:, :, :width] = dense.reshape(len(vectors), words, width)
    return np.packbits(padded, axis=2, bitorder="little").reshape(len(vectors), -1).view("<i8")


def words_for(tables: int) -> int:
    return -(-tables // KEYS_A_WORD)


def hashed(rows: DataFrame, threshold: float) -> DataFrame:
    """vec_id, label, the vector's 128-bit hash (null if it can't link), its doubles and its tables' keys, packed."""
    with_package(rows.sparkSession)
    tables = tables_for(threshold)

    def run(batches):
        for batch in batches:
            vectors = vectors_of(batch.column(2))
            high, low, keys, raw = ([None] * len(vectors) for _ in range(4))
            by_width: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                if v is not None:
                    raw[k] = v.tobytes()
                    high[k], low[k] = np.frombuffer(xxhash.xxh3_128_digest(raw[k]), dtype=">i8").tolist()
                    by_width.setdefault(len(v), []).append(k)
            for places in by_width.values():
                for k, found in zip(places, packed_keys(np.stack([vectors[k] for k in places]), tables), strict=True):
                    keys[k] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["vec_id", "label", "hi", "lo", "raw", "keys"],
            )

    return rows.mapInArrow(run, "vec_id long, label string, hi long, lo long, raw binary, keys array<long>")


def key_at(words: str, at: int):
    """The key of one table out of the packed words."""
    return F.shiftrightunsigned(F.element_at(words, at // KEYS_A_WORD + 1), at % KEYS_A_WORD * BITS).bitwiseAND((1 << BITS) - 1)


def first_shared(one: str, two: str, tables: int):
    """The first table in which two packed rows of keys agree, null if there is none.

    In the difference d of two words, a key plus 7FFF (its top bit left out) reaches the top bit unless it is zero.
    """
    tops = sum(1 << k for k in range(BITS - 1, KEYS_A_WORD * BITS, BITS))
    rest = (1 << KEYS_A_WORD * BITS) - 1 - tops
    found = []
    for w in range(words_for(tables)):
        d = F.element_at(one, w + 1).bitwiseXOR(F.element_at(two, w + 1))
        used = min(KEYS_A_WORD, tables - w * KEYS_A_WORD) * BITS
        hit = F.bitwise_not((d.bitwiseAND(F.lit(rest)) + F.lit(rest)).bitwiseOR(d)).bitwiseAND(F.lit(tops & (1 << used) - 1))
        lowest = F.bit_count(hit.bitwiseAND(-hit) - 1)
        found.append(F.when(hit != 0, w * KEYS_A_WORD + F.floor(lowest / BITS).cast("int")))
    return F.coalesce(*found)


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding, label).

    Equal vectors of a label form a class; only classes are hashed, compared and linked, and a class counts with its
    size, so copies are never expanded into pairs. Classes that meet in a table are compared by cosine in double precision.

    Defined cases: vectors of a null label, null vectors, zero vectors, empty ones and those with null or non-finite
    components link with nothing; vectors of different lengths don't link; components of any size are scaled exactly;
    rows that repeat a vec_id are vectors of their own that link with each other; a null vec_id is never the smallest;
    other columns are ignored.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    tables = tables_for(threshold)
    found = written(hashed(rows, threshold), "hashed")
    sound = found.where("hi is not null and label is not null")
    classes = sound.groupBy("label", "hi", "lo").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("raw").alias("raw"), F.first("keys").alias("keys")
    )
    # numbered as written: ids of one table never repeat, whichever attempt of a task has written its part
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), key_at("keys", k).alias("key")) for k in range(tables)])).alias("t")
    keyed = classes.select("label", "cls", F.length("raw").alias("width"), each).select("label", "cls", "width", "t.at", "t.key")
    full = keyed.groupBy("label", "width", "at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keyed = keyed.join(written(full, "shared"), ["label", "width", "at", "key"], "left_semi")
    keyed = written(keyed.join(classes.select("cls", F.col("keys").alias("words")), "cls"), "keyed")
    other = keyed.select("label", "width", "at", "key", F.col("cls").alias("cls2"), F.col("words").alias("words2"))
    # a pair counts in the first table that it shares, so none comes twice
    pairs = keyed.join(other, ["label", "width", "at", "key"]).where((F.col("cls") < F.col("cls2")) & (first_shared("words", "words2", tables) == F.col("at")))
    pairs = written(pairs.select(F.col("cls").alias("x"), F.col("cls2").alias("y")), "pairs")
    both = pairs.join(classes.select(F.col("cls").alias("x"), F.col("raw").alias("rx"), F.col("size").alias("sx")), "x")
    both = both.join(classes.select(F.col("cls").alias("y"), F.col("raw").alias("ry"), F.col("size").alias("sy")), "y")
    both = both.select("x", "y", "sx", "sy", "rx", "ry")

    def compare(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(one.as_buffer()), np.frombuffer(two.as_buffer())
                keep.append(float(p @ q) / (math.sqrt(p @ p) * math.sqrt(q @ q)) >= threshold)
            yield batch.select(["x", "y", "sx", "sy"]).filter(pa.array(keep, pa.bool_()))

    links = written(both.mapInArrow(compare, "x long, y long, sx long, sy long"), "links")
    degree = links.select(F.col("x").alias("cls"), F.col("sy").alias("d")).unionByName(links.select(F.col("y").alias("cls"), F.col("sx").alias("d")))
    degree = degree.groupBy("cls").agg(F.sum("d").alias("d"))
    # classes stand for themselves in the graph, as a repeated vec_id may be the smallest of several classes
    graph = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    parts = connected_components(graph).select(F.col("vertex").alias("cls"), F.col("component").alias("part"))
    state = classes.select("label", "hi", "lo", "cls", "rep", "size").join(degree, "cls", "left").join(parts, "cls", "left")
    state = state.withColumn("part", F.coalesce("part", "cls"))
    least = state.groupBy("part").agg(F.min("rep").alias("component"))
    state = state.join(least, "part").select("label", "hi", "lo", "component", (F.coalesce("d", F.lit(0)) + F.col("size") - 1).alias("links"))
    state = written(state, "state")
    discard(classes, keyed, pairs, links)
    answer = found.select("vec_id", "label", "hi", "lo").join(state, ["label", "hi", "lo"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return answer.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS MATERIALIZED (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)"""
}
