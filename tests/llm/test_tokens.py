"""Token counts, pieces and packing against the libraries."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from ledgerweave.llm import packing, pieces, token_counts, tokens, transducer
from ledgerweave.llm.tokens import library, packed_ids, word_ids

from .conftest import awkward_rows, words

ODD = [
    "", "  ", "İstanbul ΣΑΣ Σ", "<|endoftext|>abc <|ENDOFTEXT|> x<|startoftext|>y", "don't 'tis we'll I'M it''s !!'s a's", "日本語 テキスト", "é é", "١٢٣ ½ ²", "a b c\u0085d", "\x1cx\x1dy", "👍🏽 ok", "ﬁ ﬂ",
    "a" * 9000 + "日" * 3000, "x▁y ▁ z", " lead", "trail ", "\n\n a\tb", "\x00\x01", "ａ①", "a\rb\x0bc\x0cd", "naïve—dash “q” ….", "straße ß#", "w" * 5000,
]


def texts():
    r = random.Random(5)
    alphabet = [chr(x) for x in (*range(32, 127), 0xE9, 0xDF, 0xC9, 0x301, 0xA0, 0x3A3, 0x4E00, 0x1F600, 0x660, 0x2019, 9, 10)]
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(1500)]


def counted(found: list[str]) -> list[int]:
    return token_counts.token_counts([t.encode() for t in found]).tolist()


def by_library(found: list[str]) -> list[int]:
    return [len(e.ids) for e in library(token_counts.VOCABULARY).encode_batch(found, add_special_tokens=False)]


def test_counts_and_ids_equal_the_library():
    name = token_counts.VOCABULARY
    memo = word_ids(name)
    memo.fill([t.encode().split() for t in texts()])
    assert counted(texts()) == by_library(texts())
    for t in texts():
        assert np.frombuffer(packed_ids(t.encode().split(), memo), "<u4").tolist() == library(name).encode(t, add_special_tokens=False).ids, t


def test_a_full_memo_keeps_what_its_texts_need(monkeypatch):
    """Words of a batch are looked up in few calls even where the memo is shortened for them, never one by one."""
    monkeypatch.setattr(tokens, "MEMO_WORDS", 40)
    memo, missed = tokens.WordIds(token_counts.VOCABULARY), []
    plain = tokens.WordIds.__missing__
    monkeypatch.setattr(tokens.WordIds, "__missing__", lambda self, word: missed.append(word) or plain(self, word))
    for lo in range(0, 60, 10):
        text = [f"word{k}".encode() for k in (*range(lo, lo + 20), 0, 1)]
        memo.fill([text])
        got = np.frombuffer(packed_ids(text, memo), "<u4").tolist()
        assert got == library(token_counts.VOCABULARY).encode(b" ".join(text).decode(), add_special_tokens=False).ids
        assert len(memo) <= 40
    assert not missed


def test_letters_are_encoded_once_for_all_their_cases_and_marks(monkeypatch):
    memo, given = tokens.WordIds(token_counts.VOCABULARY), []
    class Model:
        tokenize = staticmethod(lambda word, plain=memo.model.tokenize: given.append(word) or plain(word))
    memo.model = Model
    text = [f"{w}{tail}".encode() for k in range(30) for w in (f"Kor{'abcde'[k % 5]}n{'xyz' * (k % 3)}", f"KOR{'ABCDE'[k % 5]}n") for tail in ("", ",", "...", "?!", ">", "$$$", "-", "é", "7.", "'s")]
    memo.fill([text])
    for word in text:
        assert np.frombuffer(memo[word], "<u4").tolist() == library(token_counts.VOCABULARY).encode(word.decode(), add_special_tokens=False).ids, word
    assert given and len(given) == len(set(given)) and set(given) == {w.decode().lower() for w in text if w.isalpha()}


def test_counts_of_all_code_points():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = [f"aB{c}Cd1 {c} x{c}" for c in points[:0x20000:3] + points[0x20000::97]]
    found += [" ".join(f"q{c}R" for c in points[lo : lo + 64]) for lo in range(0, 0x20000, 64)]
    assert counted(found) == by_library(found)


def test_texts_fall_apart_in_blocks(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 50)
    found = [" ".join(texts()[:400]), "x" * 500, "", words(300, 9), *texts()[:200]]
    assert counted(found) == by_library(found)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 4096])
def test_chunk_maps_compose_at_any_cut(chunk):
    machine = transducer.transducer(token_counts.VOCABULARY)
    for t in ["", words(50, 3), "a" * 300, "antidisestablishmentarianism " * 5, "b " * 40 + "c" * 200 + " d" * 30 + "e" * 64, words(800, 2)]:
        symbols, *_ = token_counts.symbols_of([t.encode()])
        one_by_one = []
        machine.run(symbols.tolist(), 0, one_by_one)
        assert machine.changes(symbols, chunk).tolist() == one_by_one


@pytest.mark.parametrize(("most", "length"), [(None, 3_000_000), (500, 30_000)])
def test_a_letter_run_of_3_mb_takes_linear_memory(monkeypatch, most, length):
    import tracemalloc

    machine = transducer.Transducer(token_counts.VOCABULARY)
    if most:  # states are forgotten and made again within the run
        monkeypatch.setattr(transducer, "MAX_TRANSITIONS", most)
    r = random.Random(9)
    word = ("".join(r.choice("acgt") for _ in range(500)) * 6000)[:length].encode()
    tracemalloc.start()
    symbols, starts, special = token_counts.symbols_of([b"one two", word, b"three"])
    got = machine.changes(symbols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(symbols) == length + 11 and starts.tolist() == [0, 6, length + 6] and not special.any()
    assert int(got.sum()) == machine.run(symbols.tolist())[1]
    assert peak < 60 * length + 60_000_000
    small = word[:20_000].decode()
    assert counted([small]) == by_library([small])


def test_slots_grow(monkeypatch):
    monkeypatch.setattr(transducer, "SLOT_BITS", 4)
    machine = transducer.Transducer(token_counts.VOCABULARY)
    symbols, *_ = token_counts.symbols_of([words(60, 8).encode()])
    assert int(machine.changes(symbols).sum()) == sum(by_library([words(60, 8)]))
    assert machine.slot_bits > 4 and (machine.slot_keys >= 0).sum() == len(machine.table)


def test_restarted_transducer_counts_alike():
    machine = transducer.transducer(token_counts.VOCABULARY)
    before = [machine.count_word(w.encode()) for w in words(40, 6).split()]
    machine.restart()
    assert [machine.count_word(w.encode()) for w in words(40, 6).split()] == before


def test_count_operator(docs, no_docs):
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, limit=100).collect()), key=str)
    want = []
    for i, t, *_ in awkward_rows():
        n = len(library(token_counts.VOCABULARY).encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_pieces_equal_the_library_and_cover_the_text(docs, no_docs):
    held = pieces.pieces(pieces.MODEL)
    for t, (ids, decimal, ends) in zip(texts(), held.encode([t.encode() for t in texts()]), strict=True):
        assert ids.tolist() == held.library.encode(t), t
        assert decimal.decode() == ",".join(map(str, ids.tolist()))
        assert (np.diff(ends) >= 0).all()
        if t:
            assert ends[-1] == len(t.encode())
    rows = pieces.encode_pieces(docs).collect()
    assert len(rows) == len(awkward_rows())
    assert {(r.doc_id, r.n_tokens) for r in rows if r.doc_id in (0, 1)} == {(0, 0), (1, 0)}
    assert pieces.encode_pieces(no_docs).count() == 0


def test_spans_equal_the_library_s_own():
    """Against the byte offsets of the library; it gives a character of several byte pieces to the last of them."""
    held = pieces.pieces(pieces.MODEL)
    compared = 0
    for t in [*texts(), "naïve  日本 ok", "  two", "a▁b c", words(200, 4)]:
        raw = t.encode()
        found = held.library.encode(t, return_type="proto").pieces
        ids, _, ends = held.encode([raw])[0]
        assert [p.id for p in found] == ids.tolist()
        for k, p in enumerate(found):
            if not held.library.is_byte(p.id):
                begin = int(ends[k - 1]) if k else 0
                assert (begin, int(ends[k])) == (p.begin, p.end), (t, k)
                compared += 1
    assert compared > 10_000


def test_model_with_a_map_of_its_own():
    """Units are normalised by the map before they are encoded, and spans go back to the unnormalised bytes."""
    held = pieces.Pieces(pieces.MODEL)
    held.normalise.map = pieces.CharacterMap(darts({"ﬁ".encode(): b"fi", b"\t": b" ", b"~~": b"-"}))
    normal, source = held.normalise("ﬁne~~a\tb".encode())
    assert normal.decode() == "▁fine-a▁b"
    ids = np.asarray(held.library.encode("fine-a b"))
    assert held.projected(ids, normal, source, "fine-a b")[-1] == len("ﬁne~~a\tb".encode())
    unit, start = held.normalise(" ﬁx".encode(), prefix=False)
    assert unit.decode() == "▁fix" and start == [0, 0, 0, 1, 1, 4, 5]


def darts(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map of short keys, laid out plainly: every node has a block of 256 units."""
    replacements = b"".join(v + b"\0" for v in entries.values())
    starts, at = {}, 0
    for k, v in entries.items():
        starts[k] = at
        at += len(v) + 1
    nodes = sorted({k[:n] for k in entries for n in range(len(k) + 1)})
    block = {node: 256 * (n + 1) for n, node in enumerate(nodes)}
    units = [0] * (256 * (len(nodes) + 1))

    def offset(frm: int, to: int) -> int:
        return (frm ^ to) << 10 if (frm ^ to) < 1 << 21 else 0

    units[0] = offset(0, block[b""])
    for node in nodes:
        for child in nodes:
            if len(child) == len(node) + 1 and child.startswith(node):
                place = block[node] ^ child[-1]
                units[place] = offset(place, block[child]) | child[-1] | (1 << 8 if child in entries else 0)
        if node in entries:
            units[block[node]] = starts[node] | 1 << 31
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + replacements


def test_longest_prefix_of_a_compiled_map():
    table = pieces.CharacterMap(darts({b"a": b"1", b"ab": b"22", b"abcd": b""}))
    assert table.longest(b"abc", 0) == (2, b"22")
    assert table.longest(b"abcd", 0) == (4, b"")
    assert table.longest(b"xa", 1) == (1, b"1")
    assert table.longest(b"xa", 0) is None


def test_normaliser_records_sources():
    held = pieces.Normaliser(b"")
    held.map, held.prefix, held.squeeze, held.escape = pieces.CharacterMap(darts({b"ab": b"X"})), True, True, True
    normal, source = held(b"  ab  c ")
    assert normal.decode() == "▁X▁c"
    assert source == [2, 2, 2, 2, 4, 4, 4, 6, 7]
    assert held(b"   ") == (b"", [3])


def test_units_side_by_side_normalise_as_one_by_one():
    held = pieces.pieces(pieces.MODEL)
    units = [b" " + t.encode() for t in ("", "a", "naïve", "日本", "🙂x", "  two", "\n\t", "<s>")]
    stream = b"\0".join(units)
    normal, source = held.normalise.spaces(stream)
    begin = at = 0
    for unit in units:
        form, of = held.normalise(unit, prefix=False)
        assert normal[at : at + len(form)] == form
        assert [begin + o for o in of] == source[at : at + len(form) + 1].tolist()
        begin, at = begin + len(unit) + 1, at + len(form) + 1


def test_pieces_of_bytes_that_are_no_utf8():
    held = pieces.pieces(pieces.MODEL)
    for raw in (b"\xff\xfe a", b"a \xe6 b", b"\x80", b"a\xf0\x9f b \xc3"):
        ids, _, ends = held.encode([raw])[0]
        assert ids.tolist() == held.library.encode(raw.decode("utf-8", "replace"))
        assert (np.diff(ends) >= 0).all()
        assert 0 <= ends[0] and ends[-1] <= len(raw)


def check_packing(rows, limit):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for members in by_sequence.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= limit
    return len(by_sequence)


@pytest.mark.parametrize("group", [packing.GROUP_ROWS, 2])
def test_packing(docs, no_docs, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    rows = packing.pack(docs).collect()
    full = [r for r in rows if r.length == packing.LIMIT]
    assert full and all(r.sequence_id < 0 and r.offset == 0 for r in full)
    check_packing(rows, packing.LIMIT)
    found = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    want = []
    for i, t, *_ in awkward_rows():
        ids = [*library(packing.VOCABULARY).encode(t or "", add_special_tokens=False).ids, 0]
        for k, lo in enumerate(range(0, len(ids), packing.LIMIT)):
            part = ids[lo : lo + packing.LIMIT]
            want.append((i, k, lo, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert found == sorted(want, key=str)
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_length_once_and_few_sequences(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(3.5, 1.0, 3000).astype(int), 1, 256)
    histogram = np.bincount(lengths, minlength=257)
    plan = packing.plan_sequences(histogram, 256)
    used = np.zeros(257, int)
    for pattern, n in plan:
        assert sum(pattern) <= 256 and n > 0
        for v in pattern:
            used[v] += n
    assert (used == histogram).all()
    total, lower = sum(n for _, n in plan), -(-int(lengths.sum()) // 256)
    assert total <= lower * 1.01 + 2


def test_fit_is_non_negative_and_close():
    histogram = np.zeros(65, int)
    histogram[[40, 24, 32, 10, 54]] = [100, 100, 60, 30, 30]
    patterns = packing.patterns_of(64)
    x = packing.fit_counts(histogram, patterns, 400)
    assert (x >= 0).all()
    a = np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=65)
    assert np.abs(a[1:] - histogram[1:]).max() < 2
