"""Approximate nearest neighbours by inner product: stable random projections, a kd-tree over the projected space, and
incremental verification until a chi-square test holds.

A vector x is lengthened to (x, sqrt(M^2 - |x|^2)), M the largest norm, and a query q to (q, 0). The nearest lengthened
vectors then have the largest inner products. A Gaussian projection to m dimensions turns a squared distance d^2 into
d^2 times a chi-square variable with m degrees of freedom. So a vector as near as the k-th found so far (at d_k) lies
within d_k^2 * quantile(CONFIDENCE) in the projected space with that probability, and the search may stop there.

1. The kd-tree is fitted on a bounded sample of projected vectors and indexes every vector. A leaf with many vectors
   (copies of one vector cannot be split) is cut into blocks by a hash.
2. Each distinct query looks into a block of its own leaf and of the next ones: a first d_k.
3. It then visits all leaves that the test leaves open. In each block, candidates come in the order of their projected
   distance and are verified with the original vectors until the test holds.

Vectors of very different lengths would end all pruning (and overflow), so vectors are searched in bands of lengths, each an
index of its own; nearly always there is one. Bands and queries are scaled by powers of two, which changes no digit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize
from chronoweave.llm.common import query, table

PROJECTIONS = 8  # even, so that the chi-square tail has a closed form
CONFIDENCE = 0.97
SAMPLE = 20_000  # rows the tree is fitted on
LEAF, MOST_LEAVES = 1_024, 1_024
BLOCK, QUERY_BLOCK = 2_048, 1_024
FIRST_LEAVES = 3
BAND = 16  # vectors whose largest component has a binary exponent within such a range are searched together
STEP = 256  # candidates verified between two tests
FLOOR = 1e-5  # of M^2: projected distances below are always verified, so that copies of a vector are all seen


def chi_square_quantile(m: int, p: float) -> float:
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1.0
    while tail(hi) > 1 - p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return hi


def grow(points: np.ndarray, depth: int):
    """Nested (axis, cut, low side, high side) with `depth` levels; cuts at the median of the widest axis."""
    if depth == 0 or len(points) < 2:
        return None
    axis = int(np.argmax(np.percentile(points, 95, axis=0) - np.percentile(points, 5, axis=0)))
    cut = float(np.median(points[:, axis]))
    low = points[:, axis] <= cut
    if low.all():
        return None
    return axis, cut, grow(points[low], depth - 1), grow(points[~low], depth - 1)


def leaves(tree, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the leaves, in the order of leaf_of()."""
    lows, highs = [], []

    def walk(node, lo, hi):
        if node is None:
            lows.append(lo)
            highs.append(hi)
            return
        axis, cut, a, b = node
        left, right = hi.copy(), lo.copy()
        left[axis], right[axis] = cut, cut
        walk(a, lo, left)
        walk(b, right, hi)

    walk(tree, np.full(m, -np.inf), np.full(m, np.inf))
    return np.array(lows), np.array(highs)


def leaf_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int32)

    def walk(node, rows, first) -> int:
        if node is None:
            out[rows] = first
            return first + 1
        axis, cut, a, b = node
        low = points[rows, axis] <= cut
        return walk(b, rows[~low], walk(a, rows[low], first))

    walk(tree, np.arange(len(points)), 0)
    return out


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each leaf."""
    out = np.empty((len(points), len(low)))
    for i, p in enumerate(points):
        d = np.maximum(0, np.maximum(low - p, p - high))
        out[i] = (d * d).sum(axis=1)
    return out


def _usable(df: DataFrame, row: str, vector: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(row).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(row).cast("long").alias("id"), v.alias("v"))
    return rows.withColumn("ex", F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x))))).try_cast("int"))


def _power(x: Column, exponent: Column) -> Column:
    """x * 2^exponent, in two steps, since half the range of exponents is beyond a double's."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _scaled(vector: str, exponent: Column) -> Column:
    """The vector over 2^exponent, which changes no digit."""
    return F.transform(vector, lambda x: _power(x, -exponent))


def _matrix(column, width: int, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(-1, width)


def _best(pairs: Column, n: int) -> Column:
    """The n first of an array of (order, id), one for each id."""
    by_id = F.array_sort(F.transform(pairs, lambda x: F.struct(x["id"].alias("id"), x["order"].alias("order"))))
    # bound once: the lambda sees the sorted array of the one-element outer array
    firsts = F.flatten(F.transform(F.array(by_id), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["id"] != x["id"]))))
    return F.slice(F.array_sort(F.transform(firsts, lambda x: F.struct(x["order"].alias("order"), x["id"].alias("id")))), 1, n)


def search(df: DataFrame, is_query, k: int = 20, row: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, id, score): for each row of `df` where the Column `is_query` holds, its k nearest other rows.

    Nearest first by inner product in double precision, ties to the smaller id; fewer than k rows where there are fewer
    candidates. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
    without an id or with another number of components than most rows have. Rows that repeat an id
    are one candidate with the best of their scores, and all rows with the query's id count as the query's own; an empty
    table gives no rows.
    """
    m, test = PROJECTIONS, chi_square_quantile(PROJECTIONS, confidence)
    usable = _usable(df, row, vector)
    asked = _usable(df.where(is_query), row, vector)
    sizes = usable.groupBy(F.size("v").alias("d"), "ex").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("n", "ex")).alias("exponents")).orderBy(F.desc("n"), "d").limit(1).collect()  # as many exponents as doubles have
    d = sizes[0]["d"] if sizes else 1
    exponents = {r["ex"]: r["n"] for r in sizes[0]["exponents"]} if sizes else {0: 0}
    middle = max(exponents, key=lambda e: (exponents[e], e))
    projection = np.random.default_rng(11).standard_normal((d + 1, m))
    sized = lambda x: x.where(F.size("v") == d)

    def project(top: float | None):
        """Candidates are lengthened to the squared length `top`, queries (None) by zero."""

        def run(batches):
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                extra = np.zeros(len(v)) if top is None else np.sqrt(np.maximum(0, top - (v * v).sum(axis=1)))
                y = np.column_stack([v, extra]) @ projection
                raw = [r.tobytes() for r in v]
                names = batch.column(2) if top is None else pa.array([xxhash.xxh3_128_hexdigest(r) for r in raw], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in y], pa.binary())], ["id", "name", "v", "y"])

        return run

    schema = "id long, name string, v binary, y binary"
    # a query's own power of two does not change the order of its neighbours
    name = F.concat_ws("|", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256), "ex")
    queries = materialize(sized(asked).select("id", _scaled("v", F.col("ex")).alias("v"), name.alias("name")).mapInArrow(project(None), schema))

    def searched(part: DataFrame) -> DataFrame:
        """(name, best): the k + 1 best of one band of vectors, in the band's scale."""
        total, top = part.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
        top = top or 1.0
        floor = FLOOR * top
        rows = materialize(part.select("id", "v").mapInArrow(project(top), schema).dropDuplicates(["id", "name"]))
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("y").collect()
        depth = max(0, min(int(math.log2(MOST_LEAVES)), math.ceil(math.log2(max(1, total) / LEAF))))
        tree = grow(_matrix([r["y"] for r in picked], m), depth) if picked else None
        low, high = leaves(tree, m)

        def place(batches):
            for batch in batches:
                leaf = leaf_of(tree, _matrix(batch.column(3).to_pylist(), m))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "name", "v", "y", "leaf"])

        placed = materialize(rows.mapInArrow(place, schema + ", leaf int").select("id", "v", "y", "leaf"))
        counts = placed.groupBy("leaf").count().collect()  # at most MOST_LEAVES rows
        held = np.zeros(len(low), dtype=np.int64)
        for r in counts:
            held[r["leaf"]] = r["count"]
        cut = np.maximum(1, -(-held // BLOCK))
        cuts = F.array(*[F.lit(int(c)) for c in cut])
        blocked = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(cuts, F.col("leaf") + 1)).cast("int"))

        def choose(first: bool):
            """(leaf, block) pairs of each query: some near ones at first, later all within its bound."""

            def run(batches):
                for batch in batches:
                    names, vs, ys = (batch.column(i).to_pylist() for i in range(3))
                    gap = gaps(_matrix(ys, m), low, high)
                    out = [[], [], [], [], [], []]
                    bounds = batch.column(3).to_pylist()
                    for i, name in enumerate(names):
                        if first:
                            order = np.argsort(gap[i], kind="stable")
                            order = order[held[order] > 0]
                            seen = np.cumsum(held[order] / cut[order])
                            order = order[: max(FIRST_LEAVES, int(np.searchsorted(seen, 2 * (k + 1))) + 1)]
                            visits = [(int(c), int(xxhash.xxh3_64_intdigest(name) % int(cut[c]))) for c in order]
                        else:
                            visits = [(int(c), b) for c in np.flatnonzero((gap[i] <= bounds[i] * test + floor) & (held > 0)) for b in range(int(cut[c]))]
                        for c, b in visits:
                            for column, value in zip(out, (name, vs[i], ys[i], bounds[i], c, b)):
                                column.append(value)
                    types = (pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32())
                    for s in range(0, max(1, len(out[0])), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 4096], t) for c, t in zip(out, types)], ["name", "v", "y", "bound", "leaf", "block"])

            return run

        def verify(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            ids, v, y = left["id"].to_numpy(), _matrix(left["v"], d), _matrix(left["y"], m)
            qs, qys = _matrix(right["v"], d), _matrix(right["y"], m)
            length, out = (y * y).sum(axis=1), []
            repeated = len(np.unique(ids)) < len(ids)  # an id with several vectors
            for start in range(0, len(qs), 64):
                some_y = qys[start : start + 64]
                fars = np.ascontiguousarray((length[:, None] - 2 * (y @ some_y.T) + (some_y * some_y).sum(axis=1)).T)
                for far, i in zip(fars, range(start, start + 64)):
                    q, bound = qs[i], right["bound"].iat[i]
                    norm = float(q @ q)
                    order = np.flatnonzero(far <= bound * test + floor)
                    order = order[np.argsort(far[order])]
                    found_id, found, at = ids[:0], np.zeros(0), 0
                    while at < len(order) and far[order[at]] <= bound * test + floor:
                        some = order[at : at + STEP]
                        at += STEP
                        # only what is within the bound can be among the nearest; its score is then taken row by row
                        some = some[v[some] @ q >= (top + norm - bound) / 2 - 1e-9 * (top + norm)]
                        if not len(some):
                            continue
                        found_id, found = np.concatenate([found_id, ids[some]]), np.concatenate([found, (v[some] * q).sum(axis=1)])
                        best = np.lexsort((found_id, -found))
                        if repeated:
                            best = best[np.sort(np.unique(found_id[best], return_index=True)[1])]
                        best = best[: k + 1]
                        found_id, found = found_id[best], found[best]
                        if len(found) > k:
                            bound = min(bound, top + norm - 2 * found[-1])
                    if len(found):
                        out.append((right["name"].iat[i], found_id.tolist(), found.tolist()))
            return pd.DataFrame(out, columns=["name", "ids", "scores"])

        def visit(visits: DataFrame) -> DataFrame:
            """Best k + 1 of each query over its visits: (name, best)."""
            per = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (QUERY_BLOCK * F.element_at(cuts, F.col("leaf") + 1))).cast("int").alias("parts"))
            parts = np.ones(len(low), dtype=np.int64)
            for r in per.collect():  # at most MOST_LEAVES rows
                parts[r["leaf"]] = max(1, r["parts"])
            split = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("leaf") + 1)
            right = visits.withColumn("part", F.pmod(F.xxhash64("name"), split).cast("int"))
            wanted = right.select("leaf", "block").distinct()
            left = blocked.join(wanted, ["leaf", "block"], "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), split.cast("int") - 1)))
            keys = ["leaf", "block", "part"]
            got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(verify, "name string, ids array<long>, scores array<double>")
            pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("order"), x["ids"].alias("id")))
            # two steps, so that no task holds more than a share of what a query's visits returned
            some = got.select("name", pairs.alias("best"), F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("salt"))
            top_of = lambda: _best(F.flatten(F.collect_list("best")), k + 1).alias("best")
            return some.groupBy("name", "salt").agg(top_of()).groupBy("name").agg(top_of())

        distinct = queries.groupBy("name").agg(F.first("v").alias("v"), F.first("y").alias("y"))
        columns = "name string, v binary, y binary, bound double, leaf int, block int"
        start = materialize(distinct.select("name", "v", "y", F.lit(float("inf")).alias("bound")).mapInArrow(choose(True), columns))
        first = materialize(visit(start))
        bound = F.when(F.size("best") > k, F.lit(float(top)) + 2 * F.element_at("best", k + 1)["order"]).otherwise(F.lit(float("inf")))

        def add_norm(batches):
            for batch in batches:
                v = _matrix(batch.column(1).to_pylist(), d)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.asarray(batch.column(3).to_numpy(zero_copy_only=False)) + (v * v).sum(axis=1))], ["name", "v", "y", "bound"])

        bounded = distinct.join(first.select("name", bound.alias("bound")), "name").select("name", "v", "y", "bound").mapInArrow(add_norm, "name string, v binary, y binary, bound double")
        later = visit(materialize(bounded.mapInArrow(choose(False), columns)))
        # what the first look found stays, whether or not the test would have led there again
        both = F.concat("best", F.coalesce("more", F.array().cast("array<struct<order:double,id:bigint>>")))
        return first.join(later.withColumnRenamed("best", "more"), "name", "left").select("name", _best(both, k + 1).alias("best"))
    def band_of(e: int) -> int:
        return (e - middle + BAND // 2) // BAND

    parts = []
    for band in sorted({band_of(e) for e in exponents}):
        scale = middle + BAND * band
        low, high = scale - BAND // 2, scale + BAND // 2 - 1
        inside = sized(usable).where(F.col("ex").between(low, high)).select("id", _scaled("v", F.lit(scale)).alias("v"))
        found = searched(inside)
        power = F.element_at(F.split("name", r"\|"), 2).cast("int") + F.lit(scale)
        parts.append(found.select("name", F.transform("best", lambda x: F.struct(_power(x["order"], power).alias("order"), x["id"].alias("id"))).alias("best")))
    final = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            final = final.unionByName(more)
        final = final.groupBy("name").agg(_best(F.flatten(F.collect_list("best")), k + 1).alias("best"))
    lists = queries.select(F.col("id").alias("query_id"), "name").distinct().join(final, "name")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = lists.select("query_id", F.posexplode(others).alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("id"), (-F.col("one.order")).alias("score"))


@query()
def op2_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")
