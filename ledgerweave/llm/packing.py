"""Packing documents into sequences: patterns of few lengths fitted by non-negative least squares, then best fit.

Every quantity on the driver is a histogram over the 1..limit lengths or a plan over patterns of such lengths, so its
size depends on the sequence limit alone. Documents are matched to the plan's slots in tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, with_package, written
from .tokens import packed_ids, word_ids

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
SEPARATOR = 0
#: Rows that share a length are numbered in up to this many groups, and a further one for each GROUP_ROWS of them, so that one
#: frequent length is no single task, however many rows it has.
GROUPS, GROUP_ROWS = 64, 50_000
NNLS_STEPS = 150

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of each document: its ids and a separator, cut at every limit ids."""
    with_package(docs.sparkSession)

    def pieces(batches):
        memo, separator = word_ids(vocabulary), np.asarray([SEPARATOR], dtype="<u4").tobytes()
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [t.split() if t else [] for t in batch.column(1).to_pylist()]
            memo.fill(texts)
            out = []
            for doc, words in zip(ids, texts, strict=True):
                packed = packed_ids(words, memo) + separator
                for k, lo in enumerate(range(0, len(packed), 4 * limit)):
                    part = packed[lo : lo + 4 * limit]
                    out.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(pieces, PIECES)


def patterns_of(limit: int) -> np.ndarray:
    """All patterns of one, two or three lengths that add up to the limit, as rows (a >= b >= c, 0: none)."""
    found = [np.array([[limit, 0, 0]], dtype=np.int32)]
    a = np.arange((limit + 1) // 2, limit, dtype=np.int32)
    found.append(np.stack([a, limit - a, np.zeros_like(a)], axis=1))
    for a in range((limit + 2) // 3, limit - 1):
        rest = limit - a
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1, dtype=np.int32)
        found.append(np.stack([np.full_like(b, a), b, rest - b], axis=1))
    return np.concatenate(found)


def fit_counts(histogram: np.ndarray, patterns: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - h||, A being the length counts of the patterns.

    Accelerated projected gradients with restarts; A is applied by gathers and bincounts and is never built.
    """
    h = histogram.astype(np.float64)
    size = len(h)
    used = np.all(h[patterns] > 0, axis=1) | (patterns[:, 1] == 0) & (h[patterns[:, 0]] > 0)
    used |= (patterns[:, 2] == 0) & (h[patterns[:, 0]] > 0) & (h[patterns[:, 1]] > 0)
    live = patterns[used]
    x = np.zeros(len(live))
    full = np.zeros(len(patterns))
    if not len(live):
        return full
    flat, width = live.ravel(), live.shape[1]

    def forward(v):
        out = np.bincount(flat, np.repeat(v, width), minlength=size)
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[live].sum(axis=1)

    norm = 1.0
    v = np.ones(len(live))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(forward(y) - h) / (1.02 * norm))
        if np.dot(y - new, new - x) > 0:
            t, y = 1.0, new
        else:
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = new + (t - 1) / nt * (new - x)
            t = nt
        x = new
    full[used] = x
    return full


def round_counts(histogram: np.ndarray, patterns: np.ndarray, x: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts within the histogram, and what they leave of it.

    Fractions are carried along the patterns, so the rounded counts add up as the fitted ones do; a pattern that the
    remaining lengths can't serve so often is cut back.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    carried = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    counts = np.diff(carried, prepend=0)
    order = np.argsort(-counts, kind="stable")
    plan = []
    for k in order[: int((counts > 0).sum())]:
        lengths = tuple(int(v) for v in patterns[k] if v)
        need: dict[int, int] = defaultdict(int)
        for v in lengths:
            need[v] += 1
        n = min(int(counts[k]), *(int(left[v]) // m for v, m in need.items()))
        if n > 0:
            for v, m in need.items():
                left[v] -= n * m
            plan.append((lengths, n))
    return plan, left


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: groups of equal sequences take many equal lengths at once."""
    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    roomy = np.zeros(limit + 1, dtype=np.int64)
    for length in range(limit, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(roomy[length:])
            if not len(fits):
                per = limit // length
                for times in (per, n % per) if n >= per else (n,):
                    if times:
                        many = n // per if times == per and n >= per else 1
                        free = limit - times * length
                        spaces[free].append(((length,) * times, many))
                        roomy[free] += 1
                n = 0
                break
            free = length + int(fits[0])
            pattern, have = spaces[free].pop()
            roomy[free] -= 1
            times = min(free // length, n)
            take = min(have, n // times)
            if take < have:
                spaces[free].append((pattern, have - take))
                roomy[free] += 1
            rest = free - times * length
            spaces[rest].append((pattern + (length,) * times, take))
            roomy[rest] += 1
            n -= take * times
    return [group for groups in spaces.values() for group in groups]


def plan_sequences(histogram: np.ndarray, limit: int = LIMIT, steps: int = NNLS_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences for a histogram of lengths 0..limit."""
    h = histogram.astype(np.int64).copy()
    full, h[limit] = int(h[limit]), 0
    plan = [((limit,), full)] if full else []
    if h[1:].any():
        patterns = patterns_of(limit)[1:]
        fitted, left = round_counts(h, patterns, fit_counts(h, patterns, steps))
        plan += fitted + best_fit(left, limit)
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of slots, sorted by length and first rank: key (length << 40 | first rank), first sequence, offset, repeats.

    A run of one length lists how a pattern's repeats take the documents of that length one after another.
    """
    per: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, repeats in plan:
        offset = 0
        for length in lengths:
            per[length].append((sequence, offset, repeats))
            offset += length
        sequence += repeats
    keys, firsts, offsets = [], [], []
    for length in sorted(per):
        rank = 0
        for first, offset, repeats in per[length]:
            keys.append(length << 40 | rank)
            firsts.append(first)
            offsets.append(offset)
            rank += repeats
    return np.asarray(keys, np.int64), np.asarray(firsts, np.int64), np.asarray(offsets, np.int64), np.asarray([sequence], np.int64)


def groups_of(count):
    """In how many groups so many rows of one length are numbered."""
    return count // GROUP_ROWS + np.clip(count // GROUPS, 1, GROUPS)


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (a written table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A piece's rank among those of its length is its number in a salted group plus the sizes of the groups before; a
    length has as many groups as its pieces need. Pieces of the whole limit, which long documents have most of, fill a
    sequence each and need no rank: their sequences are numbered downwards from -1 where they are read.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == limit).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < limit)
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for row in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row for each length
        histogram[row["length"]] = row["n"]
    keys, firsts, offsets, _ = slots_of(plan_sequences(histogram, limit))
    plan = spark.sparkContext.broadcast((keys, firsts, offsets))
    salts = F.element_at(F.lit(groups_of(histogram).tolist()), F.col("length").cast("int") + 1)
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(_window("length", "salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = salted.withColumn("number", F.row_number().over(_window(("length", "salt"), ("doc_id", "piece", "ids_crc32"))))
    groups = int(groups_of(histogram[histogram > 0]).sum())
    ranked = numbered.join(broadcast_if_small(sizes, groups), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number") - 1).alias("rank"))

    def assign(batches):
        keys, firsts, offsets = plan.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = firsts[at] + rank - (keys[at] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long").unionByName(full)


def _window(partition, order):
    many = lambda x: (x,) if isinstance(x, str) else x
    return Window.partitionBy(*many(partition)).orderBy(*many(order))


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is the separator alone; only documents longer than the limit are cut; rows that
    repeat a doc_id are packed each for itself; equal lengths are interchangeable and ordered by doc_id, piece and
    checksum; an empty table packs into nothing; other columns are ignored.
    """
    return place(written(cut(docs, limit, vocabulary), "pieces"), limit)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
