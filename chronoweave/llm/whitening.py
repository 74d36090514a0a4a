"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers x. With n vectors and their sums S, the scatter A = sum (n x - S)(n x - S)^T / n is a matrix of
whole numbers, n^2 times the covariance. Spark adds it up exactly from products of centred entries, one small partial
matrix a task. From A on, everything depends on the dimension only, not on the number of rows:

1. `charpoly_modulo`: for each of enough 31-bit primes A is brought to Hessenberg form and its characteristic polynomial is
   read off (one Spark task per few primes); Chinese remaindering gives the coefficients exactly (`characteristic`), and
   one prime more than needed checks them.
2. `largest_roots`: all roots are real, so the sign changes of the polynomial shifted to a point count the roots above it
   exactly. Counting and bisecting isolates each root; the sign of the polynomial refines it to a relative 2^-PRECISION.
   Roots that even then are not apart count as one of higher multiplicity.
3. `null_vectors`: inverse iteration on A - root, in decimal arithmetic with `DIGITS` digits, gives the component.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize
from chronoweave.llm.common import query, table, without

SCALE, SHIFT = 1024, 100_000  # x = floor(SCALE * entry) + SHIFT
COMPONENTS = 8
PRECISION = 160  # bits of an eigenvalue
DIGITS = 120  # of the decimal arithmetic of the components
LIMB = 22  # bits; products of two limbs and their sums over 256 rows are exact in doubles
LARGEST = 1 << 61  # x beyond this counts as this
PRIMES_AT_ONCE = 16
LONG_MAX = (1 << 63) - 1


# whole numbers of vectors -------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Neither null nor empty, all entries present and finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fine(c), F.lit(False))), F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    x = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Parts of LIMB bits with values = sum part[a] * 2^(LIMB * a), as doubles; the last one has the sign."""
    out, rest = [], values
    while len(rest) and max(-int(rest.min()), int(rest.max())) >= 1 << LIMB:
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def _of_arrow(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(flat.reshape(-1, dimension))


def sums_of(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """(i, n, total) per dimension: the rows and the sum of x_i of this task."""
    total, n = np.zeros(dimension, dtype=object), 0
    for batch in batches:
        x = _of_arrow(batch, dimension)
        n += len(x)
        total += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "n", "total"])


def scatter_of(batches: Iterator[pa.RecordBatch], centre: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """(shift, i, j, total) for i <= j: the sum of 2^-shift * y_i * y_j over this task's rows, y = x - centre."""
    d, middle, total = len(centre), np.array(centre, dtype=np.int64), {}
    for batch in batches:
        parts = _limbs(_of_arrow(batch, d) - middle)
        for a, left in enumerate(parts):
            for b, right in enumerate(parts):
                product = np.zeros((d, d), dtype=np.int64)  # exact: 2^52 times the blocks of a batch
                for k in range(0, len(left), 256):
                    product += (left[k : k + 256].T @ right[k : k + 256]).astype(np.int64)
                total[a + b] = total.get(a + b, 0) + product.astype(object)
    if total:
        i, j = np.triu_indices(d)
        for shift, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shift * LIMB), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([decimal.Decimal(v) for v in m[i, j]], pa.decimal128(38, 0))], ["shift", "i", "j", "total"])


def scatter_matrix(df: DataFrame, vector: str, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, A): rows, sums of x, and the scatter sum (n x - S)(n x - S)^T / n, all exact."""
    d, rows = dimension, df.select(F.col(vector).alias("v"))
    parts = rows.mapInArrow(lambda b: sums_of(b, d), "i int, n long, total decimal(38,0)")
    sums = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    if not sums:
        return 0, [0] * d, [[0] * d for _ in range(d)]
    n, sums = sums[0]["n"], [int(r["total"]) for r in sums]
    centre = [s // n for s in sums]
    parts = rows.mapInArrow(lambda b: scatter_of(b, centre), "shift int, i int, j int, total decimal(38,0)")
    y = [s - n * c for s, c in zip(sums, centre)]
    a = [[-y[i] * y[j] for j in range(d)] for i in range(d)]
    for r in parts.groupBy("shift", "i", "j").agg(F.sum("total").alias("total")).collect():  # d * d numbers, or a few times that
        for i, j in {(r["i"], r["j"]), (r["j"], r["i"])}:
            a[i][j] += n * int(r["total"]) << r["shift"]
    return n, sums, a


# characteristic polynomial ------------------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Exact for n < 3.2e9: Miller-Rabin with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    s = (n - 1 & 1 - n).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, n - 1 >> s, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_below(limit: int, count: int) -> list[int]:
    out, n = [], limit - 1
    while len(out) < count:
        if is_prime(n):
            out.append(n)
        n -= 1
    return out


def charpoly_modulo(a: Sequence[Sequence[int]], primes: Sequence[int]) -> np.ndarray:
    """Coefficients of det(x - a) modulo each prime, the leading 1 first; all primes side by side."""
    d, p = len(a), np.array(primes, dtype=np.int64)
    h = np.array([[[v % q for v in row] for row in a] for q in primes], dtype=np.int64).reshape(len(primes), d, d)
    each, modulus = np.arange(len(primes)), p[:, None, None]
    for k in range(d - 2):
        below = h[:, k + 1 :, k] != 0
        pivot = k + 1 + below.argmax(axis=1)  # k + 1 itself where the column is zero already
        rows = h[each, pivot].copy()
        h[each, pivot] = h[:, k + 1]
        h[:, k + 1] = rows
        columns = h[each, :, pivot].copy()
        h[each, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = columns
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, k + 1, k], primes)], dtype=np.int64)
        u = h[:, k + 2 :, k] * inverse[:, None] % p[:, None]
        h[:, k + 2 :] = (h[:, k + 2 :] - u[:, :, None] * h[:, k + 1, None, :] % modulus) % modulus
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None, :] % modulus).sum(axis=2)) % p[:, None]
    column = p[:, None]
    poly = [np.zeros((len(primes), d + 1), dtype=np.int64)]  # poly[k]: of the leading k x k block, lowest power first
    poly[0][:, 0] = 1
    for k in range(d):
        new = -h[:, k, k, None] * poly[k] % column
        new[:, 1:] = (new[:, 1:] + poly[k][:, :-1]) % column
        product = np.ones(len(primes), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            product = product * h[:, i + 1, i] % p
            new = (new - (product * h[:, i, k] % p)[:, None] * poly[i]) % column
        poly.append(new)
    return poly[d][:, ::-1]


def characteristic(spark, a: list[list[int]]) -> list[int]:
    """e_0 .. e_d with det(x - a) = sum (-1)^k e_k x^(d-k), for a positive semidefinite matrix of whole numbers.

    All e_k lie between 0 and (1 + trace / d)^d, which says how many primes are needed.
    """
    d = len(a)
    trace = sum(a[i][i] for i in range(d))
    bits = d * (trace // d + 2).bit_length() + 1
    primes = primes_below(1 << 31, bits // 30 + 2)
    listed = spark.createDataFrame([(i, q) for i, q in enumerate(primes)], "k int, prime long")

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), PRIMES_AT_ONCE):
                some = f["prime"].tolist()[i : i + PRIMES_AT_ONCE]
                yield pd.DataFrame({"prime": some, "residues": list(charpoly_modulo(a, some))})

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    found = listed.repartition(tasks, "k").mapInPandas(residues, "prime long, residues array<long>").collect()  # d * primes numbers
    *found, check = sorted((r["prime"], r["residues"]) for r in found)
    e, modulus = [0] * (d + 1), 1
    for q, residues_q in found:
        inverse = pow(modulus, -1, q)
        for k, r in enumerate(residues_q):
            e[k] += modulus * (((-r if k % 2 else r) - e[k]) * inverse % q)
        modulus *= q
    if any((e[k] - (-r if k % 2 else r)) % check[0] for k, r in enumerate(check[1])):
        raise ArithmeticError("the characteristic polynomial does not agree with a further prime")
    return e


# roots --------------------------------------------------------------------------------------------------------------


def _shifted(e: Sequence[int], num: int, t: int) -> list[int]:
    """Coefficients, highest first, of the polynomial in y with x = (y + num) / 2^t, times 2^(t d)."""
    c = [(-v if k % 2 else v) << t * k for k, v in enumerate(e)]
    for last in range(len(c), 1, -1):
        for k in range(1, last):
            c[k] += num * c[k - 1]
    return c


def roots_above(e: Sequence[int], num: int, t: int) -> int:
    """Roots greater than num / 2^t, with multiplicity: sign changes of the shifted polynomial (exact, all roots are real)."""
    signs = [c > 0 for c in _shifted(e, num, t) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(e: Sequence[int], num: int, t: int) -> int:
    value = 0
    for k, v in enumerate(e):
        value = value * num + ((-v if k % 2 else v) << t * k)
    return (value > 0) - (value < 0)


def largest_roots(e: Sequence[int], count: int, precision: int = PRECISION) -> list[tuple[int, int, int]]:
    """(num, t, multiplicity) of the largest positive roots num / 2^t until `count` are had (the last may go beyond it).

    Each lies within a relative 2^-precision of the true root; roots not apart by that count as one.
    """
    rank = max(k for k, v in enumerate(e) if v)
    out, had = [], 0
    while had < min(count, rank):
        lo, hi, t = 0, e[1] + 1, 0  # every root is below the trace + 1
        above_lo, above_hi = rank, 0
        while (above_lo > had + 1 or above_hi < had) and hi - lo > lo >> precision:
            if hi - lo == 1:
                lo, hi, t = lo << 64, hi << 64, t + 64
            mid = (lo + hi) // 2
            above = roots_above(e, mid, t)
            if above > had:
                lo, above_lo = mid, above
            else:
                hi, above_hi = mid, above
        if above_lo == had + 1:  # one simple root in (lo, hi]: the polynomial changes its sign there
            beyond = -1 if had % 2 else 1  # sign to the right of the root
            while hi - lo > lo >> precision:
                if hi - lo == 1:
                    lo, hi, t = lo << 64, hi << 64, t + 64
                mid = (lo + hi) // 2
                if _sign(e, mid, t) == -beyond:
                    lo = mid
                else:
                    hi = mid
        out.append((hi, t, above_lo - had))
        had = above_lo
    return out


# components ---------------------------------------------------------------------------------------------------------


def null_vectors(a: Sequence[Sequence[int]], num: int, t: int, count: int) -> list[list[float]]:
    """`count` orthonormal vectors that a - num / 2^t takes to (nearly) zero, by inverse iteration."""
    D, d = decimal.Decimal, len(a)
    with decimal.localcontext() as context:
        context.prec = DIGITS + num.bit_length() // 3
        root = D(num) / (D(2) ** t)
        rows = [[D(v) for v in row] for row in a]
        for i in range(d):
            rows[i][i] -= root
        least = D(10) ** -DIGITS * max(max(map(abs, row)) for row in [*rows, [D(1)]])
        order = list(range(d))
        for k in range(d):  # LU with partial pivoting, in place
            pivot = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[pivot], order[k], order[pivot] = rows[pivot], rows[k], order[pivot], order[k]
            top = rows[k]
            if abs(top[k]) < least:
                top[k] = least
            tail = top[k + 1 :]
            for row in rows[k + 1 :]:
                if row[k]:
                    f = row[k] = row[k] / top[k]
                    row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], tail)]

        def solved(b: list) -> list:
            x = [b[i] for i in order]
            for k in range(d):
                x[k] -= sum((rows[k][i] * x[i] for i in range(k)), D(0))
            for k in reversed(range(d)):
                x[k] = (x[k] - sum((rows[k][i] * x[i] for i in range(k + 1, d)), D(0))) / rows[k][k]
            return x

        found = [[D(1) / (1 + (i * (j + 2) + j) % (d + j + 1)) for i in range(d)] for j in range(count)]
        for _ in range(3):
            got: list[list] = []
            for v in found:
                v = solved(v)
                for _ in range(2):
                    for w in got:
                        along = sum(x * y for x, y in zip(v, w))
                        v = [x - along * y for x, y in zip(v, w)]
                    length = sum(x * x for x in v).sqrt()
                    v = [x / length for x in v]
                got.append(v)
            found = got
        out = []
        for v in found:
            largest = max(v, key=abs)
            out.append([float(x if largest > 0 else -x) for x in v])
        return out


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S of x; unit components and the eigenvalues of the covariance, largest first."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # (components, dimension)
    eigenvalues: tuple[Fraction, ...]
    trace: Fraction

    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.eigenvalues]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of all usable vectors; None where there are none.

    Usable: not null, not empty, all entries present and finite, as long as most of them (the longer of two lengths as
    frequent). Directions without variance are no components, so there may be fewer than asked for.
    """
    spark, rows = df.sparkSession, df.where(usable(F.col(vector)))
    length = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not length:
        return None
    d = length[0]["d"]
    n, sums, a = scatter_matrix(rows.where(F.size(vector) == d), vector, d)
    trace = sum(a[i][i] for i in range(d))
    roots = largest_roots(characteristic(spark, a), components) if trace else []
    listed = spark.createDataFrame([(k, str(num), t, m) for k, (num, t, m) in enumerate(roots)], "k int, num string, t int, many int")

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                yield pd.DataFrame({"k": r.k, "vectors": [[v for w in null_vectors(a, int(r.num), r.t, r.many) for v in w]]})

    found = sorted(listed.repartition(max(1, len(roots)), "k").mapInPandas(vectors, "k int, vectors array<double>").collect()) if roots else []
    unit = np.array([v for r in found for v in r["vectors"]], dtype=np.float64).reshape(-1, d)[:components]
    values = [Fraction(num, n * n << t) for num, t, m in roots for _ in range(m)][:components]
    return Whitening(d, n, tuple(sums), unit, tuple(values), Fraction(trace, n * n))


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding", into: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows with usable vectors of the model's length, with `into`: array<double>, and `deviation`: long, the sum of
    (n x - S)^2 (null where it is beyond a long). Without a model no row stays. Columns of these names are replaced."""
    kept = without(df, [into, deviation])
    if model is None:
        return kept.where(F.lit(False)).withColumns({into: F.array().cast("array<double>"), deviation: F.lit(None).cast("long")})
    n, centre = model.n, np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = [s - model.n * int(c) for s, c in zip(model.sums, centre)]
    scaled = (model.components / np.sqrt([float(v) for v in model.eigenvalues])[:, None]).T if len(model.eigenvalues) else np.zeros((model.dimension, 0))
    part = np.array([r / n for r in rest])

    @F.pandas_udf("whitened array<double>, deviation long")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            y = whole_numbers(np.stack(some.to_list()).reshape(len(some), model.dimension)) - centre if len(some) else np.zeros((0, model.dimension), np.int64)
            largest = n * (max(-int(y.min()), int(y.max())) if y.size else 0) + max(map(abs, rest))
            if model.dimension * largest * largest <= LONG_MAX:
                squares = ((n * y - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                squares = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
            yield pd.DataFrame({"whitened": list((y - part) @ scaled), "deviation": pd.array([s if s <= LONG_MAX else None for s in squares], dtype="Int64")})

    fine = kept.where(usable(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") == model.dimension))
    got = fine.select(*[F.col(f"`{c}`") for c in kept.columns], placed.asNondeterministic()(F.col(f"`{vector}`")).alias("\0got"))
    return got.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("\0got.whitened").alias(into), F.col("\0got.deviation").alias(deviation))


def identity_error(df: DataFrame, components: int, whitened: str = "whitened") -> float | None:
    """Largest absolute entry of the whitened columns' covariance (divisor n) minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    if not pairs:
        return None
    row = df.agg(*[F.covar_pop(F.col(whitened)[i], F.col(whitened)[j]) for i, j in pairs]).first()
    return max((abs(v - (i == j)) for v, (i, j) in zip(row, pairs) if v is not None), default=None)


@query()
def op13_embedding_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    done = materialize(whiten(rows, model).select("vec_id", "deviation", "whitened"))
    explained = model.explained() if model else []
    error = identity_error(done, len(explained))
    shares = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
