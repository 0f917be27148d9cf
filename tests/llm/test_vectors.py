"""Whitening and vector codes against plain recomputations, and their parts on numbers of any size."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerweave.llm import vector_codes, whitening

KIND = "vec_id long, embedding array<double>, label int, component string, code int, at int, n long, same string"


def table(spark, rows):
    return spark.createDataFrame([(k, v, label, "c", 1, 2, 3, "s") for k, v, label in rows], KIND).repartition(3)


def vectors(n, width, seed):
    g = np.random.default_rng(seed)
    mixed = g.standard_normal((n, width)) @ g.standard_normal((width, width))
    return [[float(x) for x in row] for row in mixed + g.standard_normal(width) * 5]


def sound(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


BAD = [(900, None, 1), (901, [1.0, None] * 6, 1), (902, [float("nan")] * 12, 0), (903, [float("inf")] * 12, None)]


def check_whitened(got, rows, components=8):
    kept = sound(rows)
    width = max(len(v) for _, v, _ in kept)
    x = [[math.floor(1024 * c) + 100000 for c in v] + [100000] * (width - len(v)) for _, v, _ in kept]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, total, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = {k: sum((n * c - t) ** 2 for c, t in zip(row, total, strict=True)) for (k, _, _), row in zip(kept, x, strict=True)}
    assert sorted((r.vec_id, r.component) for r in got) == sorted((k, c) for k, _, _ in kept for c in range(1, components + 1))
    at = {k: i for i, (k, _, _) in enumerate(kept)}
    for component in range(1, components + 1):
        e, mine = values[component - 1], [r for r in got if r.component == component]
        want = centred @ axes[:, component - 1] / math.sqrt(e)
        found = np.array([0.0] * n)
        for r in mine:
            found[at[r.vec_id]] = r.whitened
        found *= np.sign(found @ want)
        assert np.abs(found - want).max() < 1e-7
        assert abs(mine[0].explained / (e / values.sum()) - 1) < 1e-10
    assert all(r.n == n and r.deviation == deviation[r.vec_id] for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_by_brute_force(spark):
    rows = [(k, v, k % 3) for k, v in enumerate(vectors(150, 12, 1))] + BAD
    check_whitened(whitening.whiten(table(spark, rows)).collect(), rows)


def test_whitening_of_repeated_short_and_large_vectors(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(40, 5, 2))]
    rows += [(k + 100, v, 0) for k, v, _ in rows[:7]] + [(200, [1.0, 2.0], 0), (201, [], 0), (202, [3e2, -2e2, 0.0, 0.0, 1e2], 0)]
    check_whitened(whitening.whiten(table(spark, rows)).collect(), rows, components=5)


def test_whitening_edges(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, BAD)).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [], 0), (2, [], 0)])).collect() == []
    line = whitening.whiten(table(spark, [(k % 4, [k * 1.0, k * 2.0, 5.0], 0) for k in range(9)] + [(None, [20.0, 40.0, 5.0], 0)])).collect()
    assert len(line) == 10 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    huge = whitening.whiten(table(spark, [(1, [1e30, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 3.0], 0)])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None}


@pytest.mark.parametrize("rank", [0, 1, 5, 9, 16])
def test_factor_and_rotations(rank):
    g = np.random.default_rng(rank)
    half = g.standard_normal((16, rank)) * 10.0 ** -np.arange(rank)[None, :]
    scatter = half @ half.T
    order, factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape[1] <= rank
    assert np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, scatter[np.ix_(order, order)], atol=1e-12 * np.trace(scatter) + 1e-300)
    turned = whitening.one_sided_jacobi(factor)
    dots = turned.T @ turned
    norms = np.sqrt(dots.diagonal())
    assert (np.abs(dots - np.diag(dots.diagonal())) <= 1e-13 * np.outer(norms, norms)).all()
    values, axes = whitening.principal(scatter)
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][: len(values)], atol=1e-12 * np.trace(scatter))
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)


whole = st.integers(-(1 << 29), 1 << 29)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(whole, min_size=3, max_size=3), min_size=1, max_size=5), st.lists(st.lists(whole, min_size=3, max_size=3), min_size=1, max_size=5))
def test_products_of_limbs(x, y):
    got = vector_codes.exact_products(np.array(x, dtype=np.int64), np.array(y, dtype=np.int64).T)
    assert got.tolist() == [[sum(a * b for a, b in zip(p, q, strict=True)) for q in y] for p in x]


def test_nearest_takes_the_first_of_equal_entries():
    x = np.array([[[0, 0], [5, 5]]], dtype=np.int64)
    books = np.array([[[1, 0], [0, 1], [5, 5], [5, 5]]], dtype=np.int64)
    index, far = vector_codes.nearest(x, books)
    assert index.tolist() == [[0, 2]] and far.tolist() == [[1, 0]]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(sound(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    x = [[math.floor(256 * c) for c in v] + [0] * (parts * each - len(v)) for _, v, _ in kept]
    books = [[row[p * each : p * each + each] for row in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    best = lambda row, p: min((far(row[p * each : p * each + each], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in x:
                groups.setdefault(best(row, p)[1], []).append(row[p * each : p * each + each])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(k, "".join(f"{best(row, p)[1]:02x}" for p in range(parts)), sum(best(row, p)[0] for p in range(parts))) for (k, _, _), row in zip(kept, x, strict=True)]
    return out, hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()


@pytest.mark.parametrize("case", ["even", "odd", "few", "large", "repeated", "empty", "none"])
def test_codes_by_brute_force(spark, case):
    rows = {
        "even": [(k * 7 % 101, v, k % 2) for k, v in enumerate(vectors(101, 32, 3))] + BAD,
        "odd": [(k, v[: 5 + k % 15], 0) for k, v in enumerate(vectors(90, 19, 4))],
        "few": [(k, v, 0) for k, v in enumerate(vectors(5, 16, 5))],
        "large": [(k, [c * 1e4 for c in v], 0) for k, v in enumerate(vectors(70, 16, 6))],
        "repeated": [(k % 9 if k % 9 else None, v, None) for k, v in enumerate(vectors(80, 16, 7))] * 2,
        "empty": [(1, [], 0), (2, [], 1)],
        "none": BAD,
    }[case]
    got, books = vector_codes.compress(table(spark, rows))
    want, sha = plain_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert vector_codes.digest(books) == sha
