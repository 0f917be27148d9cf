"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted one feature after another, add up to a lookup table for each feature; then trees over pairs of
features add up to a table for each chosen pair. A score is a sum of table entries.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, text_mark, with_package, without_rows, written

#: Labelled rows that the model is fitted on at most; the rest have larger hashes of their doc_id.
MAX_ROWS = 40_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 200
PAIR_ROUNDS = 60
RATE = 0.1
SMOOTH = 1.0

FEATURES = (
    "words word_length distinct repeated top_word bigrams upper digits symbols stops non_ascii entropy lines same_lines bars bangs tails vowels"
).split()
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~!?"
_VOWELS = b"aeiouyAEIOUY"


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    many = lambda chars: int(counts[list(chars)].sum())
    times = Counter(words)
    share = counts[counts > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tails = sum(counts_ for w, counts_ in times.items() if w[-1:] in b"#$%&*!|")
    return [
        math.log1p(n),
        sum(map(len, words)) / n,
        len(times) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(times.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        many(_UPPER) / size,
        many(_DIGITS) / size,
        many(_SYMBOLS) / size,
        many(b".,;:") / n,
        int(counts[128:].sum()) / size,
        float(-(share * np.log2(share)).sum()),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        many(b"|") / n,
        many(b"!") / n,
        tails / n,
        many(_VOWELS) / size,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, mark, text) -> doc_id, held_out, mark, x: the features of the whole text."""
    with_package(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            rows = [features(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "held_out", "mark", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "mark", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, mark long, x array<double>")


def best_cuts(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree of at most three leaves over ordered bins with gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    pieces = [(0, len(g))]
    for _ in range(2):
        best = (1e-12, None)
        for lo, hi in pieces:
            if hi - lo > 1:
                left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
                total_g, total_h = g[lo:hi].sum(), h[lo:hi].sum()
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - total_g**2 / (total_h + SMOOTH)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (lo, lo + k + 1, hi))
        if best[1] is None:
            break
        lo, cut, hi = best[1]
        pieces.remove((lo, hi))
        pieces += [(lo, cut), (cut, hi)]
    for lo, hi in pieces:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SMOOTH)
    return out


def best_cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values and gain of one cut of the rows with a cut of the columns on either side."""
    cum_g, cum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = -1.0, None
    for r in range(g.shape[0] - 1):
        gain, cuts = 0.0, []
        for top_g, top_h in ((cum_g[r], cum_h[r]), (cum_g[-1] - cum_g[r], cum_h[-1] - cum_h[r])):
            rest_g, rest_h = top_g[-1] - top_g[:-1], top_h[-1] - top_h[:-1]
            each = top_g[:-1] ** 2 / (top_h[:-1] + SMOOTH) + rest_g**2 / (rest_h + SMOOTH)
            c = int(each.argmax())
            gain += each[c]
            cuts.append(c + 1)
        if gain > best:
            best, where = gain, (r + 1, *cuts)
    out = np.zeros_like(g)
    if where:
        r, c1, c2 = where
        for rows, c in ((slice(0, r), c1), (slice(r, None), c2)):
            for columns in (slice(0, c), slice(c, None)):
                out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + SMOOTH)
    return out, best


class AdditiveModel:
    """Cut points, a table for each feature, tables for chosen pairs, and an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        positive = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(positive / (1 - positive)))
        if len(y) and 0 < y.sum() < len(y):
            self.fit(self.bins(x), y)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    def coarse(self, bins: np.ndarray, f: int) -> np.ndarray:
        return bins[:, f] * PAIR_BINS // len(self.tables[f])

    def fit(self, bins: np.ndarray, y: np.ndarray) -> None:
        logit = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                g = np.bincount(bins[:, f], y - p, minlength=len(table))
                h = np.bincount(bins[:, f], p * (1 - p), minlength=len(table))
                step = RATE * best_cuts(g, h)
                table += step
                logit += step[bins[:, f]]

        def sums(a, b):
            p = 1 / (1 + np.exp(-logit))
            cell = self.coarse(bins, a) * PAIR_BINS + self.coarse(bins, b)
            shape = PAIR_BINS, PAIR_BINS
            return np.bincount(cell, y - p, minlength=PAIR_BINS**2).reshape(shape), np.bincount(cell, p * (1 - p), minlength=PAIR_BINS**2).reshape(shape), cell

        gains = {(a, b): best_cross(*sums(a, b)[:2])[1] for a in range(len(FEATURES)) for b in range(a)}
        self.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                g, h, cell = sums(a, b)
                step = RATE * best_cross(g, h)[0]
                table += step
                logit += step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, from additions of table entries."""
        bins = self.bins(x)
        logit = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            logit += table[bins[:, f]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            logit += table[self.coarse(bins, a), self.coarse(bins, b)]
        return 1 / (1 + np.exp(-logit))


def fit_model(scored: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """The model of at most max_rows labelled rows of scored (doc_id, held_out, x), those of the smallest hashes.

    Rows of large hashes are left out before the sort, by a bound that the number of labelled rows gives.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    marks = marks.where("y <> 0.5").select(F.col("doc_id").alias("__id"), F.col("y"))
    rows = scored.where("not held_out").join(marks, scored["doc_id"] == F.col("__id"))
    rows = rows.select("x", F.when(F.col("y") > 0.5, 1.0).otherwise(0.0).alias("y"), F.xxhash64("doc_id").alias("h"))
    rows = written(rows, "labelled")
    total, share = rows.count(), 1.0
    part = rows
    if total > max_rows:
        share = min(1.0, 1.1 * max_rows / total)
        while True:
            part = rows.where(F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
            if share >= 1 or part.count() >= max_rows:
                break
            share = min(1.0, 2 * share)
    found = part.orderBy("h", "x", "y").limit(max_rows).select("x", "y").toArrow()  # bounded by max_rows
    discard(rows)
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return AdditiveModel(x, np.array(found.column("y").to_pylist(), dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = MAX_ROWS, marks: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (and the text's mark) for every row of docs (doc_id, text), learned from the labels of rows not held out.

    Defined cases: null and empty texts have zero features and a score like any other; without usable labels (both
    classes) every score is the labels' smoothed share of ones; null labels teach nothing, and neither does a doc_id
    labelled 0 as often as 1; a null doc_id isn't held out; repeated rows are scored each; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), text_mark("text").alias("mark"))
    scored = written(with_features(docs), "features")
    model = scored.sparkSession.sparkContext.broadcast(fit_model(scored, labels, max_rows))

    def run(batches):
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "mark", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = scored.mapInArrow(run, f"doc_id {kind}, held_out boolean, mark long, score double, predicted int")
    return out if marks else out.drop("mark")


def held_out_third() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted 0, each judged by its own text; all columns stay as they are.

    Defined cases: null and empty texts are judged by zero features; very long texts are read whole; rows that repeat a
    doc_id are dropped each by its own text, and rows repeated as a whole all or none; a null doc_id is an id like any other;
    without usable labels, or in an empty table, all rows stay.
    """
    bad = score_quality(docs, labels, held_out_third(), marks=True).where("predicted = 0")
    return without_rows(docs, bad.select("doc_id", "mark", F.lit(False).alias("once")).distinct())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels, held_out_third())
