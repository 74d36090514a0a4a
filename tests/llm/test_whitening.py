"""The exact polynomial, its roots and null vectors against slow definitions, whitening against plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from chronoweave.llm import whitening as wh

SF = "/root/testdata/sf0.001"


def polynomial_by_definition(a):
    """Faddeev-LeVerrier in fractions: e_k with det(x - a) = sum (-1)^k e_k x^(d-k)."""
    d, m, e = len(a), [[Fraction(0)] * len(a) for _ in a], [Fraction(1)]
    c = Fraction(1)
    for k in range(1, d + 1):
        m = [[sum(a[i][r] * m[r][j] for r in range(d)) + (c if i == j else 0) for j in range(d)] for i in range(d)]
        c = -sum(sum(a[i][r] * m[r][i] for r in range(d)) for i in range(d)) / k
        e.append(-c if k % 2 else c)
    return e


def scatter_by_definition(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    return n, s, x, [[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x) // n for j in range(d)] for i in range(d)]


def gram(rng, d, rank, size):
    b = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(v[i] * v[j] for v in b) for j in range(d)] for i in range(d)]


def test_primes():
    slow = lambda n: n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))
    assert all(wh.is_prime(n) == slow(n) for n in range(5_000))
    assert all(slow(p) for p in wh.primes_below(1 << 31, 3)) and wh.primes_below(12, 3) == [11, 7, 5]


def test_characteristic_polynomial(spark):
    rng = random.Random(1)
    for d, rank, size in ((1, 1, 9), (2, 1, 3), (3, 3, 10**6), (6, 2, 50), (7, 9, 10**12), (4, 0, 1)):
        a = gram(rng, d, rank, size) if rank else [[0] * d for _ in range(d)]
        assert wh.characteristic(spark, a) == polynomial_by_definition(a), (d, rank, size)
    a = [[2, 0, 0, 0], [0, 0, 0, 0], [0, 0, 5, 1], [0, 0, 1, 5]]  # zero columns below the diagonal
    assert wh.characteristic(spark, a) == polynomial_by_definition(a)
    small = wh.charpoly_modulo([[1, 2, 0], [3, 4, 5], [7, 0, 6]], [3, 5, 101])  # pivots that vanish modulo a prime
    assert [r.tolist() for r in small] == [[c % p for c in (1, -11, 28, -58)] for p in (3, 5, 101)]


def test_roots_are_isolated_with_their_multiplicity():
    def poly(roots):
        c = [1]
        for r in roots:
            c = [x - r * y for x, y in zip([*c, 0], [0, *c])]
        return [-v if k % 2 else v for k, v in enumerate(c)]

    got = wh.largest_roots(poly([7, 7, 7, 5, 3, 3, 1, 0, 0]), 8)
    assert [(round(n / 2**t), m) for n, t, m in got] == [(7, 3), (5, 1), (3, 2), (1, 1)]
    assert [m for *_, m in wh.largest_roots(poly([7, 7, 7, 5]), 2)] == [3]
    close = wh.largest_roots(poly([10**30, 10**30 + 1, 4]), 3)
    assert [round(Fraction(n, 2**t)) for n, t, _ in close] == [10**30 + 1, 10**30, 4]
    (num, t, _), *_ = wh.largest_roots([1, 4, 2], 2)  # 2 + sqrt 2
    assert abs(num * num * 1 - 4 * num * 2**t + 2 * 4**t) < 4**t >> 150
    assert wh.roots_above([1, 4, 2], 3, 0) == 1 and wh.roots_above([1, 4, 2], 0, 0) == 2 and wh.roots_above([1, 4, 2], 4, 0) == 0


@pytest.mark.parametrize("d,rank", [(1, 1), (5, 5), (9, 4), (20, 30)])
def test_components_against_lapack(spark, d, rank):
    a = gram(random.Random(d), d, rank, 1_000)
    values, vectors = np.linalg.eigh(np.array(a, dtype=float))
    roots = wh.largest_roots(wh.characteristic(spark, a), 4)
    for k, (num, t, m) in enumerate(roots):
        assert m == 1 and num / 2**t == pytest.approx(values[-1 - k], rel=1e-9)
        (v,) = wh.null_vectors(a, num, t, 1)
        assert abs(np.dot(v, vectors[:, -1 - k])) == pytest.approx(1, abs=1e-9) and math.fsum(x * x for x in v) == pytest.approx(1, abs=1e-15)
    plane = wh.null_vectors([[5, 0, 0], [0, 5, 0], [0, 0, 1]], 5, 0, 2)
    assert np.allclose(np.array(plane) @ np.array(plane).T, np.eye(2), atol=1e-15) and np.allclose(np.array(plane)[:, 2], 0, atol=1e-15)


def check_whitening(spark, rows, kind="float", components=8):
    """Fit and apply to (id, vector) rows; compare with the definition. Gives back the model."""
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, whitened string")
    model = wh.fit(df, components=components)
    out = wh.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "whitened", "deviation"]
    got = out.collect()
    vectors = [[np.float32(c) if kind == "float" else c for c in r["embedding"]] for r in got]
    n, s, x, a = scatter_by_definition(vectors)
    assert (model.n, list(model.sums)) == (n, s)
    assert model.trace == Fraction(sum(a[i][i] for i in range(len(s))), n * n)
    for r, xs in zip(got, x):
        exact = sum((n * c - t) ** 2 for c, t in zip(xs, s))
        assert r["deviation"] == (exact if exact < 2**63 else None)
        assert len(r["whitened"]) == len(model.eigenvalues)
        for w, v, e in zip(r["whitened"], model.components, model.eigenvalues):
            want = float(sum((c - Fraction(t, n)) * Fraction(float(f)) for c, t, f in zip(xs, s, v))) / math.sqrt(e)
            assert w == pytest.approx(want, abs=1e-9)
    error = wh.identity_error(out, len(model.eigenvalues))
    assert (error is None) == (not model.eigenvalues) and (error or 0) < 1e-9
    return model


def test_whitening_of_awkward_tables(spark):
    rng = np.random.default_rng(3)
    plain = [(i, rng.normal(size=6).tolist(), "x") for i in range(40)]
    odd = [(None, rng.normal(size=6).tolist(), None), (7, None, "x"), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (9, [float("nan")] * 6, "x"), (10, [float("inf")] + [0.0] * 5, "x"),
           (11, [], "x"), (12, [1.0, 2.0], "x"), (0, plain[0][1], "x"), (0, plain[0][1], "x")]
    model = check_whitening(spark, plain + odd)
    assert model.n == 43 and len(model.eigenvalues) == 6
    assert len(check_whitening(spark, plain, components=2).eigenvalues) == 2
    assert len(check_whitening(spark, plain[:3]).eigenvalues) == 2  # no variance in the other directions
    assert check_whitening(spark, plain[:1]).eigenvalues == ()
    tied = check_whitening(spark, [(i, [float(i == 0), float(i == 1), float(i == 2)], "x") for i in range(3)])
    assert len(tied.eigenvalues) == 2 and tied.eigenvalues[0] == tied.eigenvalues[1]


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, [(i, (rng.normal(size=3) * [1e9, 1e5, 1.0]).tolist(), "x") for i in range(30)], "double")
    df = spark.createDataFrame([(1, [1e200, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    model = wh.fit(df)  # entries beyond 2^61 after scaling count as that
    assert model.n == 3 and {r["vec_id"] for r in wh.whiten(df, model).collect()} == {1, 2, 3}


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    for some in (df, df.limit(0)):
        assert wh.fit(some) is None
        assert wh.whiten(some, None).columns == ["vec_id", "embedding", "whitened", "deviation"] and wh.whiten(some, None).count() == 0


def test_query_against_plain_python(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    out = wh.op13_embedding_whitening(spark, SF)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    x = np.floor(np.array([vectors[i] for i in sorted(vectors)]) * 1024)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    assert set(got) == {(i, k) for i in vectors for k in range(1, 9)}
    for k in range(8):
        want = centred @ axes[:, k] / math.sqrt(values[k])
        have = np.array([got[i, k + 1]["whitened"] for i in sorted(vectors)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
    one = got[min(vectors), 1]
    assert one["identity_error"] < 1e-10 and one["n"] == len(x) and one["explained"] == pytest.approx(values[0] / values.sum(), rel=1e-9)
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    assert one["deviation"] == sum((n * int(v) - t) ** 2 for v, t in zip(x[0], s))
