"""Token ids of whole texts, as the tokenizers library gives them, with a bounded memo for repeated words."""

from __future__ import annotations

import functools
import itertools
import os
import struct

import numpy as np
import public_tokenizers

#: Words whose ids a Python worker remembers; when the memo is full, the first half of them stays: the earliest met, so the frequent ones.
MEMO_WORDS = 700_000
#: Words given to the library at once.
CALL_WORDS = 4096

#: Byte kinds for counting the splitter's pieces of a plain word: 1 letter, 2 mark, 3 digit (a piece each), 9 anything else.
LETTER, MARK, DIGIT, OTHER = 1, 2, 3, 9
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = LETTER
MARKS = b".,!?*$%&#;:|+-_()=/@\"[]{}~^>"
KINDS[[*MARKS]] = MARK
KINDS[[*b"0123456789"]] = DIGIT
# Two-byte letters from U+00C0 to U+00FF; the multiplication and division signs among them are not letters.
KINDS[0xC3] = LETTER
KINDS[0x80:0xC0] = LETTER
KINDS[[0x97, 0xB7]] = OTHER
KINDS[0x20] = 0


@functools.lru_cache(maxsize=4)
def library(name: str):
    """The library's tokenizer for a vocabulary file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def piece_counts(joined: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For words joined by single spaces: how many pieces the splitter makes of each, and whether that is sure."""
    kinds = KINDS[np.frombuffer(joined, dtype=np.uint8)]
    starts = np.concatenate(([0], np.flatnonzero(kinds == 0) + 1))
    fresh = np.ones(len(kinds), dtype=np.int64)
    fresh[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    fresh[kinds == 0] = 0
    return np.add.reduceat(fresh, starts)[:words], np.maximum.reduceat(kinds, starts)[:words] < OTHER


class WordIds(dict):
    """Word (UTF-8 bytes without ASCII white space) -> its ids as packed little-endian uint32.

    The vocabulary's normaliser and splitter never look across ASCII white space, so a text's ids are its words' ids.
    """

    def __init__(self, name: str):
        self.name = name
        self.model = library(name).model
        self.ends = np.zeros(library(name).get_vocab_size(), dtype=bool)
        self.ends[[i for piece, i in library(name).get_vocab().items() if piece.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.shorten()
        ids = library(self.name).encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        packed = self[word] = np.asarray(ids, dtype="<u4").tobytes()
        return packed

    def shorten(self) -> None:
        stay = list(itertools.islice(self.items(), MEMO_WORDS // 2))
        self.clear()
        self.update(stay)

    def fill(self, texts: list[list[bytes]]) -> None:
        """Look up the unknown words of many texts, given as their words, in few library calls.

        The library lower-cases words and splits them between letters and marks. So letters of ASCII are one piece that
        nothing else changes: they go to its model once for all their cases and marks at the end. Many other plain words
        go to the library as one text; each piece of a word ends with the one token that ends a piece, so the ids fall
        apart into words by counting such tokens. Other words go one by one.
        """
        wanted = set()
        for text in texts:
            wanted.update(text)
        unknown = wanted.difference(self)
        if len(self) + len(unknown) > MEMO_WORDS:
            self.shorten()
            unknown = wanted.difference(self)  # words of these texts that have just gone are looked up again with the others
        words, rest = self.fill_letters(unknown), []
        for lo in range(0, len(words), CALL_WORDS):
            part = words[lo : lo + CALL_WORDS]
            pieces, sure = piece_counts(b" ".join(part), len(part))
            if not sure.all():
                rest += [w for w, ok in zip(part, sure.tolist(), strict=True) if not ok]
                part = [w for w, ok in zip(part, sure.tolist(), strict=True) if ok]
                pieces = pieces[sure]
            ids = library(self.name).encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids
            ids = np.asarray(ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != pieces.sum():
                rest += part
                continue
            packed, at = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends[np.cumsum(pieces) - 1]).tolist(), strict=True):
                self[word] = packed[at:end]
                at = end
        for lo in range(0, len(rest), CALL_WORDS):
            part = rest[lo : lo + CALL_WORDS]
            texts = [w.decode("utf-8", "replace") for w in part]
            found = library(self.name).encode_batch_fast(texts, add_special_tokens=False)
            for word, enc in zip(part, found, strict=True):
                self[word] = np.asarray(enc.ids, dtype="<u4").tobytes()


    def fill_letters(self, unknown: set[bytes]) -> list[bytes]:
        """Look up the words of ASCII letters with or without marks at their end; the others are returned."""
        others, cores, tails = [], {}, {b"": b""}
        for word in unknown:
            core = word.rstrip(MARKS)
            if not core.isalpha():
                others.append(word)
                continue
            low = core.lower()
            ids = self.get(low) or cores.get(low)
            if ids is None:
                found = [token.id for token in self.model.tokenize(low.decode())]
                ids = cores[low] = struct.pack(f"<{len(found)}I", *found)
            tail = word[len(core) :]
            if tail not in tails:
                found = library(self.name).encode(tail.decode(), add_special_tokens=False).ids
                tails[tail] = struct.pack(f"<{len(found)}I", *found)
            self[word] = ids + tails[tail]
        return others


@functools.lru_cache(maxsize=4)
def word_ids(name: str) -> WordIds:
    return WordIds(name)


def packed_ids(words: list[bytes], memo: WordIds) -> bytes:
    """All ids of a text, given as its words, packed."""
    return b"".join(map(memo.__getitem__, words))
