"""Mixing: apportionment against a plain one seat at a time, targets by exact fractions, spans against the texts."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from ledgerweave.llm import mixing

from .conftest import words

KIND = "doc_id long, text string, source string, size long, sid long, shard long, quota long, mark long, draw string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "d") for r in rows], KIND).repartition(3)


def seat_by_seat(parties, seats):
    quota = dict.fromkeys(parties, 0)
    for _ in range(seats):
        party = min((p for p in parties if quota[p] < parties[p][1]), key=lambda p: (-Fraction(parties[p][0]) / (2 * quota[p] + 1), p))
        quota[party] += 1
    return quota


def test_apportionment_seat_by_seat(spark):
    r = random.Random(4)
    groups, seats = {}, {}
    for grp in range(40):
        n = r.choice([1, 2, 5, 30])
        votes = [float(r.choice([1, 2, r.randint(1, 2000), r.random() * 50])) for _ in range(n)]
        most = [r.choice([1, 3, 2 * int(v) + 2]) for v in votes]
        groups[grp] = {p: (v, m) for p, (v, m) in enumerate(zip(votes, most, strict=True))}
        seats[grp] = min(sum(most), r.choice([0, 1, n, int(sum(votes)), sum(most), sum(most) // 2]))
    parties = spark.createDataFrame([(g, p, v, m) for g, ps in groups.items() for p, (v, m) in ps.items()], "grp long, party long, votes double, most long")
    got = mixing.apportioned(parties, spark.createDataFrame(list(seats.items()), "grp long, seats long")).collect()
    found = defaultdict(dict)
    for row in got:
        found[row.grp][row.party] = row.quota
    assert {g: seat_by_seat(ps, seats[g]) for g, ps in groups.items()} == found


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest} | {s: Fraction(2 * sizes[s]) for s in full}
        above = {s for s in rest if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def plain_words(text):
    return [w for w in re.split("[ \t\n\v\f\r]+", text or "") if w]


def check_mix(rows, got, block):
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(plain_words(text))
    assert len(got) == len(rows) and sum(len(v) for v in by.values()) == len(rows)
    for source, want in plain_targets(sizes).items():
        taken = sum(r.taken for r in by[source])
        assert all(r.source_size == sizes[source] and abs(r.target - want) <= 1e-9 * max(1, want) for r in by[source])
        assert abs(taken - want) <= block + 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for r in got:
        held = [0] * r.size
        for s in r.spans:
            assert s.times in (1, 2) and s.length > 0
            for k in range(s.start, s.start + s.length):
                held[k] += s.times
        assert sum(held) == r.taken and max(held, default=0) <= 2


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = [(k, words(r.choice([1, 5, 40, 300]), k), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(300)]
    out += [(400, None, "s1"), (401, "", None), (402, " \n\t ", "empty"), (403, words(3, 1), None), (404, words(2, 5), "tiny"), (405, "x" * 9000, "é"), (406, words(30_000, 8), "long")]
    return out + [(None, words(50, 6), "s2"), out[4], out[4], (7, words(9, 2), "Z")]


def test_mix_meets_targets(spark, rows):
    got = mixing.mix(table(spark, rows)).collect()
    total = sum(r.size for r in got)
    check_mix(rows, got, min(256, 3 * total // (2 * 1000 * len({r[2] for r in rows}))))
    again = mixing.mix(table(spark, rows[::-1])).collect()
    assert Counter((r.doc_id, r.mark, r.taken) for r in got) == Counter((r.doc_id, r.mark, r.taken) for r in again)


def test_mix_in_many_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1500)
    got = mixing.mix(table(spark, rows), shards=40, seed=3).collect()
    assert len({(r.source, r.shard) for r in got}) > 20
    check_mix(rows, got, 40)


def test_mixed_texts_are_the_taken_words(spark, rows):
    docs = table(spark, rows)
    mixed = mixing.mix(docs)
    texts = mixing.cut_texts(docs, mixed).collect()
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.doc_id, r.source] += r.taken
    held = defaultdict(int)
    for r in texts:
        held[r.doc_id, r.source] += len(r.text.split(" "))
    assert held == {k: v for k, v in taken.items() if v}
    whole = {(k, s): " ".join(plain_words(t)) for k, t, s in rows}
    assert all(r.text in whole[r.doc_id, r.source] for r in texts)


def test_mix_edges(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    none = mixing.mix(table(spark, [(1, None, None), (2, "", "a"), (None, " ", "a")])).collect()
    assert {(r.size, r.target, r.taken) for r in none} == {(0, 0.0, 0)} and len(none) == 3
    one = mixing.mix(table(spark, [(k, "a b c d", "only") for k in range(10)])).collect()
    assert {r.target for r in one} == {60.0} and sum(r.taken for r in one) == 60
    with pytest.raises(ValueError):
        mixing.mix(table(spark, []), share=(3, 1))
