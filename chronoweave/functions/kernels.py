"""Order, rank, prefix-sum and quantile kernels that never put one group into one task.

A window over a hot key (or over no key at all) runs in a single task. The kernels here sort the
whole table by (group, order) with a range shuffle instead, number the rows inside each range
partition, and carry small per-partition edges (at most one row per group and partition) across the
partition borders. A group of any size is spread over as many tasks as its rows need. Where the
largest group is small (it is counted first), the plain window is the cheaper plan and is used.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.hashing import as_col

HOT_GROUP_ROWS = 500_000  # groups above this are split over tasks
ROW_BITS = 33  # monotonically_increasing_id keeps the partition id above this bit
_open = threading.local()  # paths written inside each `finished` of this thread, the innermost last


def workspace(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder, or a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-chronoweave-")
        sc.setCheckpointDir(root)
    return f"{str(root).rstrip('/')}/chronoweave-{sc.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once and read back: cuts lineage, fixes partition ids, survives lost executors."""
    if getattr(df, "_chronoweave_path", None):
        return df
    return _put(df, _new_path(df.sparkSession))


def _new_path(spark: SparkSession) -> str:
    path = os.path.join(workspace(spark), uuid.uuid4().hex)
    for written in getattr(_open, "scopes", [])[-1:]:
        written.append((spark, path))
    return path


def _put(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    df.write.mode("append").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._chronoweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_chronoweave_path", None):
            _delete(df.sparkSession, path)


def finished(make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """The table (or tables) that `make` gives, written; what else was written on the way is deleted, so that a job takes
    the disk of its results and of the step it is in, however many steps it has."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    out: tuple[DataFrame, ...] = ()
    try:
        made = make()
        out = tuple(materialize(df) for df in (made if isinstance(made, tuple) else (made,)))
    finally:
        written, kept = scopes.pop(), {df._chronoweave_path for df in out}
        for spark, path in written:
            if path not in kept:
                _delete(spark, path)
        for outer in scopes[-1:]:
            outer.extend(w for w in written if w[1] in kept)
    return out if isinstance(made, tuple) else out[0]


def in_pieces(df: DataFrame, by: Sequence[str], work: Callable[[DataFrame], DataFrame], rows: int) -> DataFrame:
    """`work` on pieces of about `rows` rows, whole groups of `by` each, one after the other into one table.

    For work that makes its rows wide: its shuffles take the disk of one piece, whatever the size of the table. `work` must
    treat groups independently of each other.
    """
    pieces = -(-df.count() // rows)
    if pieces <= 1:
        return work(df)

    parts = _put(df.withColumn("_piece", F.pmod(F.xxhash64(*by), F.lit(pieces)).cast("int")), _new_path(df.sparkSession), ["_piece"])
    path = _new_path(df.sparkSession)
    for i in range(pieces):
        out = finished(lambda: _put(work(parts.where(F.col("_piece") == i).drop("_piece")), path))
    discard(parts)
    return out


def _is_scan(df: DataFrame) -> bool:
    """Columns and rows picked from one table of files: cheaper to read again than to write."""
    if not hasattr(df, "_jdf"):
        return False
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName().startswith("Relation")


def drop_workspace(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote."""
    _delete(spark, workspace(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_groups(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null keys meet each other; the key columns are those of `left`."""
    named = right.withColumnsRenamed({c: f"_join_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_join_{c}")) for c in on]
    return left.join(named, match, how).drop(*[f"_join_{c}" for c in on])


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    rank: str | None = None,
    before: Mapping[str, Column] | None = None,
    through: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    hot: int | None = None,
) -> DataFrame:
    """Window results over (partition by `by` order by `order`) with large groups split over tasks.

    rank       row number from 1
    before     running sums of the rows strictly before this one (0 on the first row)
    through    running sums up to and including this row
    previous   value of the row before (null on the first row); `following` is the row after
    Null keys form a group like any other, on both plans. `order` should end in a tie-break. Running sums of
    fractional values may differ between the plans in the last digit (sum decimals where that matters).

    Unless the input is read from files as it stands, it is written once, so its plan runs once however many passes follow.
    """
    by = list(by)
    before, through = dict(before or {}), dict(through or {})
    previous, following = dict(previous or {}), dict(following or {})
    source = df
    if by:
        df = df if _is_scan(df) else materialize(df)
        largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0
        if largest <= (HOT_GROUP_ROWS if hot is None else hot):
            return _windowed(df, by, order, rank, before, through, previous, following)
    # expressions become columns first, as a sort works them out anew in every comparison
    made = {f"_order{i}": c for i, c in enumerate(order) if not isinstance(c, str) and not _directed(c)}
    keys = [F.col(c) for c in by] + [F.col(f"_order{i}") if f"_order{i}" in made else as_col(c) for i, c in enumerate(order)]
    placed = df.withColumns(made).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*made)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()))
    if df is not source:
        discard(df)  # all else reads the sorted rows
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    cell = ["_part", *by]

    aggs = [F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(e).alias(f"_s_{name}") for name, e in {**before, **through}.items()]
    aggs += [F.max_by(e, F.col("_at")).alias(f"_p_{name}") for name, e in previous.items()]
    aggs += [F.min_by(e, F.col("_at")).alias(f"_f_{name}") for name, e in following.items()]
    edges = placed.groupBy(*cell).agg(*aggs)

    # One row per (group, partition it reaches): the window below sees at most one row per partition.
    across = Window.partitionBy(*by).orderBy("_part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns(
        {"_rows0": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
        | {f"_s0_{k}": F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)) for k in {**before, **through}}
        | {f"_p0_{k}": F.lag(f"_p_{k}").over(across) for k in previous}
        | {f"_f0_{k}": F.lead(f"_f_{k}").over(across) for k in following}
    )

    inside = Window.partitionBy(*cell).orderBy("_at")
    joined = join_groups(placed, edges, cell)
    out: dict[str, Column] = {}
    if rank:
        out[rank] = F.col("_at") - F.col("_first") + 1 + F.col("_rows0")
    for name, e in before.items():
        local = F.sum(e).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        out[name] = F.col(f"_s0_{name}") + F.coalesce(local, F.lit(0))
    for name, e in through.items():
        local = F.sum(e).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        out[name] = F.col(f"_s0_{name}") + F.coalesce(local, F.lit(0))
    for name, e in previous.items():
        out[name] = F.when(F.col("_at") == F.col("_first"), F.col(f"_p0_{name}")).otherwise(F.lag(e).over(inside))
    for name, e in following.items():
        last = F.col("_first") + F.col("_rows") - 1
        out[name] = F.when(F.col("_at") == last, F.col(f"_f0_{name}")).otherwise(F.lead(e).over(inside))
    return joined.withColumns(out).select(*[c for c in df.columns if c not in out], *out)


def _directed(c: Column) -> bool:
    """A column with a direction, which can only stand in an order."""
    return str(c).endswith((" NULLS FIRST'>", " NULLS LAST'>"))


def ranked_in_steps(df: DataFrame, by: Sequence[str], step: str, order: Sequence[str | Column], rank: str) -> DataFrame:
    """Row number from 1 over (partition by `by` order by `step`, `order`), where `step` has few values and many rows each.

    Rows are ordered inside their step only; a step starts where the counts of the steps before it end, so a large group
    needs no sort over the whole table. Nulls come first, as in `ordered`.
    """
    cell = [*by, step]
    df = df if _is_scan(df) else materialize(df)
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
    starts = ordered(counts, by, [step], before={"_start": F.col("_rows")}).drop("_rows")
    inside = ordered(df, cell, order, rank=rank)
    return join_groups(inside, starts, cell).withColumn(rank, F.col(rank) + F.col("_start")).drop("_start")


def _windowed(df, by, order, rank, before, through, previous, following) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    out: dict[str, Column] = {}
    if rank:
        out[rank] = F.row_number().over(w).cast("long")
    for name, e in before.items():
        out[name] = F.coalesce(F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for name, e in through.items():
        out[name] = F.coalesce(F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    for name, e in previous.items():
        out[name] = F.lag(e).over(w)
    for name, e in following.items():
        out[name] = F.lead(e).over(w)
    return df.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Global row number from 1."""
    return ordered(df, [], order, rank=name)


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """(by, value, _n) with map-side combine; null values dropped."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles (the usual definition on position p*(n-1)).

    Works on value counts with split prefix sums, so neither a hot group nor a continuous column
    ends up in the memory of one task. One output row per group with a column per name in `probs`.
    """
    by = list(by)
    counts = value_counts(df.withColumn(value, F.col(value).cast("double")), by, value, weight)
    run = ordered(counts, by, [value], before={"_below": F.col("_n")})
    if by:
        totals = run.groupBy(*by).agg(F.sum("_n").alias("_total"))
        run = join_groups(run, totals, by)
        total = F.col("_total")
    else:
        total = F.lit(run.agg(F.sum("_n")).first()[0] or 0)

    def at(position: Column) -> Column:
        hit = (F.col("_below") <= position) & (position < F.col("_below") + F.col("_n"))
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for i, p in enumerate(probs.values()):
        place = F.lit(float(p)) * (total - 1)
        aggs += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
        aggs += [F.max(place - F.floor(place)).alias(f"_w{i}")]
    picked = run.groupBy(*by).agg(*aggs)
    cols = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name)
        for i, name in enumerate(probs)
    ]
    return picked.select(*by, *cols)


def quantile_grid(df: DataFrame, value: str, knots: int) -> DataFrame:
    """(knot, value) at i/(knots-1) for i = 0..knots-1, for grids too long to spell out as aggregates.

    A run of equal values knows from whole-number arithmetic which knots fall on it, so each knot is
    emitted once for its lower and once for its upper neighbor.
    """
    counts = value_counts(df.withColumn(value, F.col(value).cast("double")), [], value)
    run = ordered(counts, [], [value], before={"_b": F.col("_n")})
    total = run.agg(F.sum("_n")).first()[0] or 0
    m, k = max(total - 1, 1), knots - 1
    b, e = F.col("_b"), F.col("_b") + F.col("_n")
    up = lambda c: F.floor((c * k + (m - 1)) / F.lit(m))  # noqa: E731  ceiling of c*k/m
    spans = F.array(
        F.struct(F.lit(0).alias("side"), up(b).alias("i0"), F.least(up(e) - 1, F.lit(k)).alias("i1")),
        F.struct(F.lit(1).alias("side"), F.greatest(F.floor((b - 1) * k / F.lit(m)) + 1, F.lit(0)).alias("i0"), F.least(F.floor((e - 1) * k / F.lit(m)), F.lit(k)).alias("i1")))
    hit = run.select(value, F.inline(spans)).where(F.col("i0") <= F.col("i1")).select(value, "side", F.explode(F.sequence("i0", "i1")).alias("knot"))
    pair = hit.groupBy("knot").agg(F.max(F.when(F.col("side") == 0, F.col(value))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col(value))).alias("hi"))
    weight = F.pmod(F.col("knot") * m, F.lit(k)) / F.lit(k)
    return pair.select("knot", (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias("value"))


def tagged(real: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both sides in one table with `is_real`, so that one shuffle serves a comparison."""
    if columns is not None:
        real, synthetic = real.select(*columns), synthetic.select(*columns)
    return real.withColumn("is_real", F.lit(True)).unionByName(synthetic.withColumn("is_real", F.lit(False)))


def aligned_counts(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, real_n, synthetic_n) over the union of keys; absent keys count 0."""
    return both.groupBy(*keys).agg(
        F.count_if(F.col("is_real")).alias("real_n"),
        F.count_if(~F.col("is_real")).alias("synthetic_n"),
    )


def guarded_corr(x: Column, y: Column, tiny: float = 1e-12) -> Column:
    """Pearson correlation; null below two rows or when one side does not vary."""
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    usable = (F.count(x) >= 2) & (F.stddev_pop(x) > tiny) & (F.stddev_pop(y) > tiny)
    return F.when(usable, F.try_divide(F.covar_pop(x, y), spread))


def rate(flag: Column) -> Column:
    """Share of rows with the flag set (null over no rows)."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for reports; ties go up by a nudge far below the last digit, and zero has no sign."""
    return F.round(c.cast("double") + 10.0 ** -(digits + 4), digits) + F.lit(0.0)
