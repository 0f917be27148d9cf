"""A byte-pair vocabulary as a deterministic transducer whose transitions carry token-count changes.

The input symbols of a word are its bytes, the last one marked as closing (+256), because the vocabulary has word-end
tokens. Let count(n) be the number of tokens of the word's first n symbols as the merges would leave them, and last(n) the
last of these tokens. The tokens of a prefix are those of a shorter prefix plus last(n), and last(n + 1) is the one token
ending there that stands unmerged beside the token before it. So what can still matter of a prefix is bounded: the longest
suffix that begins some token, and last and the relative count at each position of that suffix. That is a state.
States are compiled when a text first reaches them; a transition gives the next state and count(n + 1) - count(n).
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers

#: Transitions a worker keeps; beyond it the transducer is compiled afresh.
MAX_TRANSITIONS = 600_000
CLOSING = 256
#: A transition is packed as next state << SHIFT | change of the count + OFFSET, its key as state << 9 | symbol.
SHIFT, OFFSET = 12, 2048
#: The table's copy in arrays has 2 ** SLOT_BITS slots at first and twice as many when it is half full.
SLOT_BITS = 20
MIX = 0x9E3779B97F4A7C15
#: Symbols of a chunk.
CHUNK = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary's file -> the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """State 0 is the start of a word; a closing symbol leads back to it."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, suffix = byte_letters(), model["end_of_word_suffix"]

        def symbols(piece: str) -> str:
            closing = piece.endswith(suffix) and piece != suffix
            out = [letters[c] for c in (piece[: -len(suffix)] if closing else piece)]
            if closing:
                out[-1] += CLOSING
            return "".join(map(chr, out))

        vocabulary = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the pair it is merged from
        for k, (left, right) in enumerate(tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]):
            pair = vocabulary[left], vocabulary[right]
            self.rank[pair] = k
            self.parts.setdefault(vocabulary[left + right], pair)
        pieces = {p: i for p, i in vocabulary.items() if i in self.parts or len(p.removesuffix(suffix)) == 1}
        self.token = {symbols(p): i for p, i in pieces.items()}
        self.length = {i: len(s) for s, i in self.token.items()}
        self.begins = {s[:k] for s in self.token for k in range(len(s) + 1)}
        self.sound: dict[int, bool] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all states; the numbers of states that a caller holds end with them."""
        self.beside.clear()
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # one object for equal entries of histories
        self.set_slots(SLOT_BITS)
        self.state_of("", ((-1, 0),))

    def set_slots(self, bits: int) -> None:
        self.slot_bits, self.slot_mask = bits, (1 << bits) - 1
        self.slot_keys = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_steps = np.zeros(1 << bits, dtype=np.int64)
        for key, step in self.table.items():
            self.fill_slot(key, step)

    def fill_slot(self, key: int, step: int) -> None:
        slot = (key * MIX & (1 << 64) - 1) >> 64 - self.slot_bits
        while self.slot_keys[slot] >= 0:
            slot = slot + 1 & self.slot_mask
        self.slot_keys[slot], self.slot_steps[slot] = key, step

    def trim(self) -> None:
        """Start afresh if there are many transitions."""
        if len(self.table) >= MAX_TRANSITIONS:
            self.restart()

    def state_of(self, suffix: str, history: tuple[tuple[int, int], ...]) -> int:
        """history: (last token, count less the newest count) for the newest position and as many before it as suffix has."""
        key = suffix, history
        at = self.keys.get(key)
        if at is None:
            at = self.keys[key] = len(self.states)
            self.states.append(key)
        return at

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that used it up) of the parts that were once at a token's left (0) or right (1) edge."""
        out, end = [(token, 1 << 60)], None
        while (pair := self.parts.get(token)) is not None:
            end = self.rank[pair]
            token = pair[side]
            out.append((token, end))
        return out

    def apart(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether no merge ranked under below joins two neighbouring tokens while they are being built."""
        for a, used_a in self.edge(left, 1):
            for b, used_b in self.edge(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < below and r < used_a and r <= used_b:
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Whether the merges leave the token's own symbols as that token."""
        known = self.sound.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = pair is None or (self.whole(pair[0]) and self.whole(pair[1]) and self.apart(*pair, below=self.rank[pair]))
            self.sound[token] = known
        return known

    def pair_stands(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self.beside.get((left, right))
        if known is None:
            known = self.beside[left, right] = self.apart(left, right)
        return known

    def last_token(self, state: int, symbol: int) -> int:
        """The token that ends with a symbol read in a state."""
        suffix, history = self.states[state]
        text = suffix + chr(symbol)
        for size in range(len(text), 0, -1):
            token = self.token.get(text[-size:])
            if token is not None and self.whole(token) and self.pair_stands(history[size - 1][0], token):
                return token
        raise ValueError(f"no token ends with symbol {symbol}")

    def compile(self, key: int) -> int:
        """One transition."""
        state, symbol = key >> 9, key & 511
        suffix, history = self.states[state]
        token = self.last_token(state, symbol)
        change = history[self.length[token] - 1][1] + 1
        if symbol >= CLOSING:
            step = OFFSET + change
        else:
            text = suffix + chr(symbol)
            keep = next(k for k in range(len(text), -1, -1) if text[len(text) - k :] in self.begins)
            shared = self.pairs.setdefault
            newer = tuple([shared(e, e) for e in ((token, 0), *((t, c - change) for t, c in history[:keep]))])
            step = self.state_of(text[len(text) - keep :], newer) << SHIFT | OFFSET + change
        self.table[key] = step
        if 2 * len(self.table) > self.slot_mask:
            self.set_slots(self.slot_bits + 1)
        else:
            self.fill_slot(key, step)
        return step

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of many keys; unknown ones are compiled."""
        mixed = keys.view(np.uint64) * np.uint64(MIX)
        slots = (mixed >> np.uint64(64 - self.slot_bits)).view(np.int64)
        found, out = self.slot_keys[slots], self.slot_steps[slots]
        open_ = np.flatnonzero(found != keys)
        while len(open_):
            empty, bits = found[open_] < 0, self.slot_bits
            for key in np.unique(keys[open_[empty]]).tolist():
                if key not in self.table:
                    self.compile(key)
            if self.slot_bits != bits:
                return self.steps(keys)
            further = open_[~empty]
            slots[further] = slots[further] + 1 & self.slot_mask
            found[open_], out[open_] = self.slot_keys[slots[open_]], self.slot_steps[slots[open_]]
            open_ = open_[found[open_] != keys[open_]]
        return out

    def run(self, symbols, state: int = 0, changes: list[int] | None = None) -> tuple[int, int]:
        """(last state, tokens) of reading symbols from a state; changes takes the count's change at each symbol."""
        get, compile_, total = self.table.get, self.compile, 0
        for symbol in symbols:
            key = state << 9 | symbol
            step = get(key)
            if step is None:
                step = compile_(key)
            state = step >> SHIFT
            change = (step & 4095) - OFFSET
            total += change
            if changes is not None:
                changes.append(change)
        return state, total

    def changes(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The count's change at each symbol of a stream of whole words, which is cut into chunks at any place.

        A chunk's map leads each entry state to an exit state. Behind its first closing symbol all entries are in the
        start, so there the maps of all chunks are worked out at once, a symbol of every chunk in a step. A chunk with a
        closing symbol thus has one exit for all entries, and the composition of all chunks before another is known from
        the nearest such chunk: the heads, up to the first closing symbols, are then read from these exits, again all at
        once. Chunks without a closing symbol pass their entry on; they are read in order from the exit before them.
        """
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int16)
        count = -(-n // chunk)
        grid = np.full(count * chunk, CLOSING, dtype=np.int16)  # padded behind the last closing symbol
        grid[:n] = symbols
        grid = grid.reshape(count, chunk)
        closing = grid >= CLOSING
        closed = closing.any(axis=1)
        first = np.where(closed, closing.argmax(axis=1), chunk)
        out = np.zeros((count, chunk), dtype=np.int16)
        exits = np.zeros(count, dtype=np.int64)
        order = np.argsort(first, kind="stable")  # chunks that start early come first
        begins = first[order]
        for t in range(1, chunk):
            live = order[: np.searchsorted(begins, t)]
            if len(live):
                step = self.steps(exits[live] << 9 | grid[live, t])
                exits[live] = step >> SHIFT
                out[live, t] = (step & 4095) - OFFSET
        known = np.concatenate(([True], closed[:-1]))  # the entry is the start or an exit found above
        entries = np.concatenate(([0], exits[:-1]))
        order = np.flatnonzero(known & closed)
        order = order[np.argsort(-first[order], kind="stable")]
        ends = -first[order]
        state = entries[order]
        for t in range(chunk):
            live = np.searchsorted(ends, -t, side="right")
            if not live:
                break
            step = self.steps(state[:live] << 9 | grid[order[:live], t])
            state[:live] = step >> SHIFT
            out[order[:live], t] = (step & 4095) - OFFSET
        # runs of chunks without a closing symbol, up to the first closing symbol behind them
        heads = np.flatnonzero(known & ~closed)
        held = [self.states[k] for k in entries[heads].tolist()]
        flat, line = out.reshape(-1), grid.reshape(-1)
        for at, key in zip(heads.tolist(), held, strict=True):
            while True:
                self.trim()
                state, got = self.state_of(*key), []
                end = at * chunk + min(first[at] + 1, chunk)
                state, _ = self.run(line[at * chunk : end].tolist(), state, got)
                flat[at * chunk : end] = got
                if closed[at] or at + 1 == count:
                    break
                key, at = self.states[state], at + 1  # noqa: PLW2901  the run goes on
        return flat[:n]

    def count_word(self, word: bytes) -> int:
        """Tokens of one word piece (no splitting inside)."""
        state, total = self.run(word[:-1])
        return total + self.run((word[-1] + CLOSING,), state)[1]

    def word_tokens(self, word: bytes) -> list[int]:
        """Tokens of one word piece: the last tokens are read back along the states."""
        state, path = 0, []
        for symbol in word[:-1]:
            state = self.run((symbol,), state)[0]
            path.append(self.states[state][1][0][0])
        token = self.last_token(state, word[-1] + CLOSING)
        out, at = [token], len(word) - self.length[token]
        while at:
            token = path[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]


@functools.lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    return Transducer(name)
