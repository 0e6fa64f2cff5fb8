"""Operators on embeddings against brute force, on vectors with nulls, non-finite entries, ties, copies, odd lengths, repeated rows and clashing columns."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import nearest, vector_codes, whitening

KIND = "vec_id long, embedding array<float>, label int"
DIM = 16


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(160, DIM)) * np.linspace(0.1, 0.4, DIM), rng.normal(size=(60, DIM)) * 0.02 + 0.3])
    out = [(i, [float(np.float32(c)) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]
    copy = out[5][1]
    out += [(300 + i, copy, 1) for i in range(90)]  # a third of all rows are one vector
    out += [(400, None, 0), (401, [1.0] * (DIM - 1) + [None], 0), (402, [math.nan] * DIM, 0), (403, [math.inf] + [0.0] * (DIM - 1), 1), (404, [], 1), (405, [0.5] * 3, 1), (406, [0.0] * DIM, 2), (407, [-0.0] * DIM, None)]
    return [*out, out[10], (None, out[11][1], None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    clash = {c: F.lit(c) for c in ("key", "v", "x", "id", "code", "block", "n", "component", "score", "rank", "of", "error", "size")}
    return spark.createDataFrame(rows, KIND).repartition(5).withColumns(clash)


def kept(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == DIM and all(c is not None and math.isfinite(c) for c in r[1])]


def key(i):
    return (i is None, i or 0)


def test_double_double_is_exact_where_doubles_are_not():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(999, 6)) * 10.0 ** rng.integers(-6, 7, (999, 6))
    n, exact = len(x), [[Fraction(c) for c in row] for row in x]
    mean = [sum(c) / n for c in zip(*exact, strict=True)]
    got = whitening.mean_of(whitening.total(whitening.plain(x)), n)
    assert all(abs(Fraction(h) + Fraction(low) - m) <= abs(m) * Fraction(1, 1 << 95) for h, low, m in zip(*got, mean, strict=True))
    high, low = whitening.total(whitening.outer(x, got))
    for at, (i, j) in enumerate(zip(*np.triu_indices(6), strict=True)):
        want = sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in exact)
        assert abs(Fraction(high[at]) + Fraction(low[at]) - want) <= Fraction(1, 1 << 80) * sum(abs((r[i] - mean[i]) * (r[j] - mean[j])) for r in exact)


def test_eigenvectors():
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(9, 9)))[0]
    e, v = whitening.eigen((q * [9, 5, 5, 3, 1, 1, 1e-9, 0, 0]) @ q.T)
    assert np.allclose(e.astype(float), [9, 5, 5, 3, 1, 1, 1e-9, 0, 0], atol=1e-14) and np.abs(v.T @ v - np.eye(9)).max() < 1e-15
    assert abs(abs((v[:, 0] * q[:, 0]).sum()) - 1) < 1e-14


def test_whitening(rows, table):
    got = whitening.whiten(table).collect()
    x = {i: [math.floor(256 * c) for c in v] for i, v, _ in kept(rows)}
    fit = np.array(sorted(set(map(tuple, x.values()))), object)
    n, s = len(fit), fit.sum(0)
    e, q = np.linalg.eigh(np.cov(fit.astype(float).T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 4 * len(kept(rows)) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    sign = {}
    for r in got:
        c = r.component - 1
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        want = float((np.array(x[r.vec_id], float) - (s / n).astype(float)) @ q[:, c] / math.sqrt(e[c]))
        assert abs(abs(want) - abs(r.whitened)) < 1e-9 and abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-10
        if abs(want) > 1e-6:
            assert sign.setdefault(c, want * r.whitened > 0) == (want * r.whitened > 0)


def test_whitening_of_few_and_large_vectors(spark):
    make = lambda *v: whitening.whiten(spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], KIND)).collect()
    assert make() == make([1.0, 2.0]) == make([1.0, 2.0], [1.0, 2.0]) == make([], []) == []
    two = make([0.0, 1.0], [0.0, 3.0], [0.0, 3.0])  # of one dimension only
    assert [(r.component, r.n, round(abs(r.whitened), 12), r.explained) for r in two] == [(1, 2, 1.0, 1.0)] * 3
    assert [r.deviation for r in make([3e18, 0.0], [0.0, 0.0])] == [None] * 2


def brute_nearest(rows, query, k):
    of = [(i, np.array(v)) for i, v, _ in kept(rows) if i is not None and any(v)]
    x = next(v for i, v in of if i == query)
    return sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in of if i != query)[:k]


def test_nearest(rows, table):
    got = {}
    for r in nearest.search(table, F.col("vec_id") % 4 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = sorted({i for i, v, _ in kept(rows) if i is not None and i % 4 == 0 and any(v)})
    assert sorted(got) == queries
    found = total = 0
    for q in queries:
        want = brute_nearest(rows, q, 10)
        have = [(round(s, 12), i) for _, i, s in sorted(got[q])]
        assert [r for r, *_ in sorted(got[q])] == list(range(1, 11)) and have == sorted(have)
        everything = {}
        for s, i in brute_nearest(rows, q, len(rows)):
            everything[i] = s
        assert all(abs(everything[i] - s) < 1e-12 for s, i in have)
        found, total = found + len({i for _, i in want} & {i for _, i in have}), total + len({i for _, i in want})
    assert found / total >= 0.95


def test_nearest_of_few_rows(spark, rows):
    make = lambda r: nearest.search(spark.createDataFrame(r, KIND), F.col("vec_id") % 2 == 0, k=3).collect()
    assert make([]) == make([(2, [1.0, 2.0], 0)]) == make([(2, [0.0, 0.0], 0), (None, [1.0, 1.0], 0)]) == []
    assert [tuple(r) for r in make([(2, [1.0, 0.0], 0), (3, [1.0, 2.0], 0), (5, [1.0, 2.0], 0)])] == [(2, 1, 3, 2.0), (2, 2, 5, 2.0)]
    same = make([(i, [1.0, 2.0], 0) for i in range(12)])
    assert sorted((r.query_id, r.rank, r.vec_id) for r in same) == sorted((q, n, i) for q in range(0, 12, 2) for n, i in enumerate([j for j in range(12) if j != q][:3], 1))


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, (700, 4)).astype(np.uint16)
    codes[100:400] = codes[:1] ^ (1 << rng.integers(0, 16, (300, 4))).astype(np.uint16)
    wanted, radius = codes[[0, 150, 600]], np.array([3, 27, 0])
    order = np.argsort(codes.T, axis=1, kind="stable").astype(np.uint16)
    q, r = nearest.probe(codes, order, wanted, radius)
    apart = np.array([[bin(int("".join(f"{a ^ b:016b}" for a, b in zip(x, y, strict=True)), 2)).count("1") for y in codes] for x in wanted])
    assert sorted(zip(q.tolist(), r.tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(apart <= radius[:, None])), strict=True))


def test_short_queries_are_searched_again(rows, table, monkeypatch):
    """Radii that find next to nothing: the second search takes in all codes."""
    monkeypatch.setattr(nearest.Codes, "radius", lambda self, d: np.zeros(len(d), np.int64))
    got = {}
    for r in nearest.search(table, F.col("vec_id") == 8, k=5).collect():
        got[r.rank] = (r.score, r.vec_id)
    assert [i for _, i in sorted(got.values())] == [i for _, i in brute_nearest(rows, 8, 5)]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    x = [(i, label, np.array([math.floor(4096 * c) for c in v], np.int64).reshape(parts, -1)) for i, v, label in kept(rows)]
    first = {}
    for i, _, v in sorted(x, key=lambda r: (key(r[0]), r[2].ravel().tolist())):
        first.setdefault(i, v)
    book = np.stack(list(first.values())[:entries], 1)
    v = np.stack([r[2] for r in x])
    for r in range(rounds + 1):
        d = ((v[:, :, None] - book[None]) ** 2).sum(3)
        of = d.argmin(2)
        for p in range(parts if r < rounds else 0):
            for j in range(book.shape[1]):
                if (of[:, p] == j).any():
                    book[p, j] = v[of[:, p] == j, p].sum(0) // (of[:, p] == j).sum()
    error, labels = d.min(2).sum(1), {}
    for (_, label, _), e in zip(x, error.tolist(), strict=True):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in a), e, labels[label], digest) for (i, label, _), a, e in zip(x, of.tolist(), error.tolist(), strict=True)), key=str)


def test_vector_codes(rows, table):
    assert sorted(map(tuple, vector_codes.encode(table).collect()), key=str) == brute_codes(rows)


def test_vector_codes_of_few_rows(spark, rows):
    make = lambda r, **o: sorted(map(tuple, vector_codes.encode(spark.createDataFrame(r, KIND), **o).collect()), key=str)
    assert make([]) == make([(1, None, 1)]) == []
    few = [(None, [0.5] * 8, None), (3, [0.5] * 8, 1), (2, [-0.25] * 8, 1), (2, [-0.5] * 8, None)]
    codes = {r[2]: r for r in make(few)}
    assert len(make(few)) == 4 and all(e >= 0 for e in codes)
    few8 = [(i, v, label) for i, v, label in few]
    globals()["DIM"], kept_dim = 8, DIM
    try:
        assert make(few8) == brute_codes(few8)
    finally:
        globals()["DIM"] = kept_dim
    with pytest.raises(ValueError, match="can't be cut"):
        make([(1, [1.0] * 9, 1)])


def test_bounds_spare_distances():
    """Rounds after the first look at fewer distances, and assign as a full scan does, ties and empty entries included."""
    rng = np.random.default_rng(4)
    x = (rng.integers(-6, 7, (400, 1, 3)) + rng.integers(0, 3, (400, 1, 1)) * 50).astype(np.int64)
    x[100:200] = x[:1]
    books, state, made = vector_codes.first_books(np.stack([x[:8, 0]]), 3), (None, None, None), []
    for _ in range(8):
        of, upper, lower, n = vector_codes.assign(x[:, 0], *state, books.entries[0], books.groups[0], books.drift[0], books.group_drift[0])
        state = of, upper, lower
        made.append(n)
        assert (of == ((x - books.entries) ** 2).sum(2).argmin(1)).all()
        moved = books.entries.copy()
        for j in set(of.tolist()):
            moved[0, j] = x[of == j, 0].sum(0) // (of == j).sum()
        books = books.moved(moved)
    assert made[-1] < made[0] / 2
