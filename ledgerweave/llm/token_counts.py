"""Token counts from a compiled finite-state tokenizer.

Texts become one stream of symbols (the bytes of their pieces, the last of each marked as closing). The stream is cut into
chunks at any place, the chunks' state maps are worked out side by side and composed, and a text's count is the sum of the
count's changes at its symbols.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, with_package
from .tokens import library
from .transducer import CLOSING, transducer

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Bytes of texts that a task turns into symbols at once; a longer text is cut at white space, where it has any.
BLOCK = 1 << 20
# Fixed values of the vocabulary's file: its special strings, its splitting pattern.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

# Words of Latin letters, digits and common marks fall apart where the kind of the bytes changes; a digit stands alone.
MARKS = b".,!?*$%&#;:|+-_()=/@"
BLANK, LETTER, MARK, DIGIT, OTHER = 0, 1, 2, 3, 4
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = LETTER
KINDS[0xC3] = KINDS[0x80:0xC0] = LETTER  # the letters from U+00C0 to U+00FF
KINDS[[*MARKS]] = MARK
KINDS[[*b"0123456789"]] = DIGIT
KINDS[[*b"\t\n\v\f\r "]] = BLANK
LOWER = np.arange(256, dtype=np.int16)
LOWER[65:91] += 32
def odd_symbols(word: str) -> tuple[list[int], int]:
    """(symbols, special strings) of any word, by the vocabulary's own normaliser and pattern."""
    out: list[int] = []
    normal = library(VOCABULARY).normalizer
    for part in SPECIAL.split(word):
        for piece in SPLIT.findall(normal.normalize_str(part)):
            out += piece.encode("utf-8", "replace")
            out[-1] += CLOSING
    return out, len(SPECIAL.findall(word))


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the transducer's input for texts in a row, where each text begins in it, how many special strings each holds).

    The vocabulary's normaliser and pattern never look across ASCII white space, so words may be treated apart: plain ones
    all at once, the others each by odd_symbols.
    """
    joined = b" ".join([*texts, b""])
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    special = np.zeros(len(texts), dtype=np.int64)
    raw = np.frombuffer(joined, dtype=np.uint8)
    kinds, symbols = KINDS[raw], LOWER[raw]
    odd = kinds == OTHER
    follows = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(follows):
        second = raw[follows]
        odd[follows[(second == 0x97) | (second == 0xB7)]] = True  # the multiplication and division signs
        symbols[follows[second <= 0x9E]] += 32  # capitals from U+00C0 to U+00DE
    closing = np.ones(len(raw), dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=closing[:-1])
    symbols[closing | (kinds == DIGIT)] += CLOSING
    plain = kinds != BLANK
    sizes = np.add.reduceat(plain, starts, dtype=np.int64)
    found, at = [], 0
    if odd.any():
        blanks = np.flatnonzero(kinds == BLANK)
        place = np.unique(np.searchsorted(blanks, np.flatnonzero(odd)))  # one entry for each odd word
        for lo, hi in zip(np.where(place > 0, blanks[place - 1] + 1, 0).tolist(), blanks[place].tolist(), strict=True):
            made, n = odd_symbols(joined[lo:hi].decode("utf-8", "replace"))
            found += [symbols[at:lo][plain[at:lo]], np.array(made, dtype=np.int16)]
            text = np.searchsorted(starts, lo, side="right") - 1
            sizes[text] += len(made) - (hi - lo)
            special[text] += n
            at = hi
    found.append(symbols[at:][plain[at:]])
    return np.concatenate(found), np.cumsum(sizes) - sizes, special


def blocks(text: bytes):
    """The text in blocks of about BLOCK bytes that end before white space."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(c, at + 1, at + BLOCK) for c in (b" ", b"\n"))
        if cut < 0:  # one long word: up to its end
            ends = [e for c in (b" ", b"\n") if (e := text.find(c, at + BLOCK)) >= 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(texts: list[bytes | None], vocabulary: str = VOCABULARY) -> np.ndarray:
    """Tokens of whole texts."""
    machine, totals = transducer(vocabulary), np.zeros(len(texts), dtype=np.int64)
    held: list[bytes] = []
    rows: list[int] = []

    def flush() -> None:
        machine.trim()
        symbols, starts, special = symbols_of(held)
        some = np.append(starts[1:], len(symbols)) > starts
        if some.any():
            special[some] += np.add.reduceat(machine.changes(symbols), starts[some], dtype=np.int64)
        np.add.at(totals, rows, special)
        held.clear()
        rows.clear()

    size = 0
    for row, text in enumerate(texts):
        for block in blocks(text or b""):
            held.append(block)
            rows.append(row)
            size += len(block)
            if size >= BLOCK:
                flush()
                size = 0
    if held:
        flush()
    return totals


def count_tokens(docs: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Defined cases: null and empty texts have no tokens; special strings inside texts count as one token, as the library
    does by default; rows that repeat are counted each; other columns are ignored.
    """
    with_package(docs.sparkSession)

    def count(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            tokens = token_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
