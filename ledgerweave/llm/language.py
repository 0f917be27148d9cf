"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +-1; a trigram's vector binds (multiplies) its letters' vectors, each rotated by its
place. A text's vector bundles (adds) its trigrams' vectors, a language's prototype those of its texts, and a text is
given the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, with_package, written

DIM = 1024
#: Letter codes: 0 stands for anything but letters, 1 to 26 for a to z; other letters share the rest by a hash.
CODES = 64
GRAMS = CODES**3
SEED = 11
#: Weight of a text in its language's prototype, dealt to its trigrams in whole numbers.
WEIGHT = 1_000_000
#: Languages whose sums a task holds at once.
HELD = 16
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The letter code of every code point."""
    points = np.arange(0x110000, dtype=np.uint64)
    codes = (points * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(CODES - 27) + np.uint64(27)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(letter, codes, 0).astype(np.uint8)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of a text's trigrams; runs of other characters count as one gap, as do both ends. Empty without letters."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    code = letter_codes()[points]
    if not code.any():
        return np.zeros(0, np.int64)
    code = np.concatenate(([0], code, [0]))
    code = code[np.concatenate(([True], (code[1:] > 0) | (code[:-1] > 0)))].astype(np.int64)
    return (code[:-2] * CODES + code[1:-1]) * CODES + code[2:]


class Vectors:
    """Trigram vectors, bound on demand."""

    def __init__(self):
        letters = np.random.default_rng(SEED).integers(0, 2, (CODES, DIM)).astype(np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.bound = np.zeros((GRAMS, DIM), dtype=np.int8)  # memory is taken only for rows in use
        self.known = np.zeros(GRAMS, dtype=bool)

    def __getitem__(self, grams: np.ndarray) -> np.ndarray:
        new = grams[~self.known[grams]]
        if len(new):
            self.bound[new] = self.first[new // CODES**2] * self.second[new // CODES % CODES] * self.third[new % CODES]
            self.known[new] = True
        return self.bound[grams]

    def bundle(self, texts: list[np.ndarray], columns: int = 8192) -> np.ndarray:
        """The vectors of many texts: their trigram counts times the trigrams' vectors."""
        out = np.zeros((len(texts), DIM), dtype=np.float32)
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum():
            return out
        codes, rows = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
        place = np.cumsum(np.bincount(codes, minlength=GRAMS) > 0) - 1
        grams = np.flatnonzero(np.diff(place, prepend=-1))
        at = place[codes]
        for lo in range(0, len(grams), columns):
            part = grams[lo : lo + columns]
            inside = (at >= lo) & (at < lo + len(part)) if len(grams) > columns else slice(None)
            counts = np.bincount(rows[inside] * len(part) + at[inside] - lo, minlength=len(texts) * len(part))
            out += counts.reshape(len(texts), len(part)).astype(np.float32) @ self[part].astype(np.float32)
        return out


@functools.lru_cache(maxsize=1)
def vectors() -> Vectors:
    return Vectors()


def fit_prototypes(texts: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of the languages in texts (text, lang). Only languages x DIM numbers reach the driver."""
    with_package(texts.sparkSession)

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, sums in held.items():
                grams = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(sums[grams])], ["lang", "gram", "weight"])
            held.clear()

        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = trigrams(text)
                if len(grams):
                    if lang not in held and len(held) >= HELD:
                        yield from flush()
                    found, n = np.unique(grams, return_counts=True)
                    held.setdefault(lang, np.zeros(GRAMS, np.int64))[found] += n * WEIGHT // len(grams)
        yield from flush()

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, grams, weights = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for lang in dict.fromkeys(langs):
                mine = np.flatnonzero(langs == lang)
                total = sums.setdefault(lang, np.zeros(DIM, np.int64))
                for lo in range(0, len(mine), 4096):
                    part = mine[lo : lo + 4096]
                    total += weights[part] @ vectors()[grams[part]].astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM)), pa.array(total)], ["lang", "at", "value"])

    counted = texts.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, weight long")
    counted = written(counted.groupBy("lang", "gram").agg(F.sum("weight").alias("weight")), "grams")
    summed = counted.mapInArrow(add, "lang string, at long, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages x DIM rows
        out.setdefault(row["lang"], np.zeros(DIM))[row["at"]] = row["value"]
    return {lang: out[lang] for lang in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, lang_pred, score: the largest cosine, 0 at least.

    Ties go to the first language in alphabetical order.
    """
    with_package(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], dtype=np.float64).reshape(len(names), DIM)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1)

    def run(batches):
        for batch in slices(batches, 256):
            grams = [trigrams(t) for t in batch.column(2).to_pylist()]
            bundled = vectors().bundle(grams).astype(np.float64)
            lengths = np.linalg.norm(bundled, axis=1)
            cosine = bundled @ matrix.T / np.where(lengths > 0, lengths, 1)[:, None]
            found = np.array([len(g) > 0 for g in grams]) & (len(names) > 0)
            best = cosine.argmax(axis=1) if names else np.zeros(len(grams), int)
            lang = [names[k] if ok else UNKNOWN for k, ok in zip(best, found, strict=True)]
            score = np.where(found, np.clip(cosine[np.arange(len(grams)), best] if names else 0.0, 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out) -> DataFrame:
    """Predictions for every row of docs (doc_id, text, lang), learned from the rows where held_out is false.

    Defined cases: null texts and texts without a letter are `und` with score 0, and so is everything where no labelled
    text is left to learn from; rows with a null language teach nothing; a null doc_id isn't held out; other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return predict(docs, fit_prototypes(docs.where("not held_out")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
