"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Sums and products over vectors are whole numbers, so they depend on no order of rows and a lost task is repeated to the
same value. The driver holds one dimensions x dimensions matrix, whatever the number of vectors.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_package, written
from .vectors import floored, is_sound

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Whole numbers of components beyond this become this; a long can't hold deviations from far below it on.
LARGEST = 1 << 40
#: A remaining diagonal of the scatter below this share of the largest one is rounding, not variance.
RANK_SHARE = 1e-13
SWEEPS = 60


def sums_of(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and the sum of floor(SCALE * component) at each position up to the longest vector's."""

    def run(batches):
        n, sums = 0, np.zeros(0, dtype=object)
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            width = max(len(sums), int(lengths.max(initial=0)))
            whole = floored(batch.column(1), SCALE, width, LARGEST)
            n += len(whole)
            sums = np.concatenate([sums, np.zeros(width - len(sums), dtype=object)]) + whole.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array(range(-1, len(sums)), pa.int32()), "part": pa.array(map(decimal.Decimal, [n, *sums]), pa.decimal128(38, 0))}
            )

    found = {r["at"]: int(r["total"]) for r in vectors.mapInArrow(run, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("total")).collect()}
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def gram(z: np.ndarray) -> np.ndarray:
    """z'z in whole numbers: by float64 products where they stay below 2^53, else number by number."""
    top = int(np.abs(z).max(initial=0))
    if top * top * max(1, len(z)) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def scatter_of(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The centred scatter, sum of (x - mean)(x - mean)', each entry rounded once.

    Vectors are centred to the nearest whole numbers before they are multiplied; what is left of the mean, at most one half
    in a position, is taken off exactly.
    """
    width = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    rows, columns = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            total = total + gram(floored(batch.column(1), SCALE, width, LARGEST) - middle)
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(rows, pa.int32()), "j": pa.array(columns, pa.int32()), "part": pa.array(map(decimal.Decimal, total[rows, columns]), pa.decimal128(38, 0))}
        )

    out = np.zeros((width, width))
    for r in vectors.mapInArrow(run, "i int, j int, part decimal(38,0)").groupBy("i", "j").agg(F.sum("part").alias("total")).collect():
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / n
    return out


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with scatter[order][:, order] = L L', L lower trapezoidal with as many columns as the numerical rank."""
    a = scatter.astype(np.float64).copy()
    size = len(a)
    order, factor = np.arange(size), np.zeros((size, size))
    limit = RANK_SHARE * a.diagonal().max(initial=0.0)
    for k in range(size):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= limit:
            return order, factor[:, :k]
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return order, factor


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated until every two are orthogonal to double precision.

    A sweep meets every two columns once, in rounds of disjoint pairs that turn together.
    """
    size, columns = factor.shape
    even = columns + columns % 2
    a = np.zeros((size, even))
    a[:, :columns] = factor
    seats = np.arange(even)
    for _ in range(SWEEPS):
        turned = 0.0
        for _ in range(even - 1):
            left, right = seats[: even // 2], seats[even // 2 :][::-1]
            p, q = a[:, left], a[:, right]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            norm = np.sqrt(pp * qq)
            cosine = np.divide(np.abs(pq), norm, out=np.zeros_like(norm), where=norm > 0)
            turned = max(turned, float(cosine.max(initial=0.0)))
            live = cosine > 1e-16
            zeta = np.divide(qq - pp, 2 * pq, out=np.zeros_like(pq), where=live)
            t = np.where(live, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, left], a[:, right] = c * p - c * t * q, c * t * p + c * q
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if turned < 1e-15 * max(1, size):
            break
    return a[:, :columns]


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    order, factor = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[order] = turned[:, falling] / norms[falling]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return norms[falling] ** 2, vectors * sign


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for rows (vec_id, embedding).

    A component c counts as x = floor(1024 c) + 100000. Covariances have the divisor n, the number of sound vectors.

    Defined cases: null vectors and those with a null or non-finite component are dropped; a vector shorter than the longest
    counts as filled up with zeros; a direction without variance can't be whitened, so no more components come back than the
    covariance's numerical rank (none for an empty table, a single vector or equal vectors); equal eigenvalues share a plane,
    whose axes are then any; |floor(1024 c)| counts as at most 2^40, and a deviation that no long holds is null; rows that
    repeat a vec_id, or have a null one, count each for itself; other columns are ignored.
    """
    spark = rows.sparkSession
    with_package(spark)
    vectors = rows.where(is_sound("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n, sums = sums_of(vectors)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    scatter = scatter_of(vectors, n, sums) if n and sums else np.zeros((0, 0))
    values, axes = principal(scatter)
    values, axes = values[:components] / n if n else values, axes[:, :components]
    if not len(values):
        return spark.createDataFrame([], kind)
    width = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], dtype=object)
    maps = axes / np.sqrt(values)

    def run(batches):
        for batch in batches:
            z = floored(batch.column(1), SCALE, width, LARGEST) - middle
            top = n * (int(np.abs(z).max(initial=0)) + 1)
            exact = np.int64 if top * top * width < 1 << 63 else object
            off = n * z.astype(exact) - rest.astype(exact)
            deviation = [d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]
            white = (z - (rest / n).astype(np.float64)) @ maps
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * len(values)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "white"])

    white = written(vectors.mapInArrow(run, "vec_id long, deviation long, white array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    moments = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(float(v * n / np.trace(scatter))) for v in values])
    each = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
