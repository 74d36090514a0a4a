"""Distances between the real and the synthetic side of a table.

Every function takes one table with a boolean `is_real` (see `kernels.tagged`), so both sides share a
shuffle, and an optional list of group columns `by`, so many columns, blocks or entities are measured
in one pass after a melt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import aligned_counts, guarded_corr, ordered


def melt(both: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("is_real",)) -> DataFrame:
    """(keep..., column, value double) with one row per numeric cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return both.select(*keep, F.inline(pairs)).select(*keep, "column", "value")


def metric_rows(one_row: DataFrame, metrics: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Turn a one-row (or grouped) aggregate into (metric, value) rows."""
    if not isinstance(metrics, Mapping):
        metrics = {m: F.col(m) for m in metrics}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in metrics.items()])
    return one_row.select(F.inline(pairs))


def stack_reports(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cumulative_shares(both: DataFrame, value: str, by: Sequence[str] = (), following: bool = False) -> DataFrame:
    """Both empirical distribution functions on the pooled distinct values."""
    by = list(by)
    pooled = both.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    counts = aligned_counts(pooled, [*by, value])
    run = ordered(
        counts, by, [value],
        through={"real_cum": F.col("real_n"), "synthetic_cum": F.col("synthetic_n")},
        following={"next_value": F.col(value)} if following else None,
    )
    totals = run.groupBy(*by).agg(F.sum("real_n").alias("real_total"), F.sum("synthetic_n").alias("synthetic_total"))
    if by:
        run = run.join(totals, by)
    else:
        one = totals.first()
        run = run.withColumns({k: F.lit(one[k]).cast("long") for k in ("real_total", "synthetic_total")})
    return run.withColumns({
        "real_cdf": F.try_divide(F.col("real_cum"), F.col("real_total")),
        "synthetic_cdf": F.try_divide(F.col("synthetic_cum"), F.col("synthetic_total")),
    })


def ks_distance(both: DataFrame, value: str, by: Sequence[str] = (), empty: float | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance; `empty` is the answer when a side has no rows (None or 0.0)."""
    shares = cumulative_shares(both, value, by)
    gap = F.max(F.abs(F.col("real_cdf") - F.col("synthetic_cdf")))
    out = shares.groupBy(*by).agg(
        gap.alias("ks"), F.max("real_total").alias("real_n"), F.max("synthetic_total").alias("synthetic_n")
    )
    both_sides = (F.col("real_n") > 0) & (F.col("synthetic_n") > 0)
    return out.withColumn("ks", F.when(both_sides, F.col("ks")).otherwise(F.lit(empty).cast("double")))


def area_distance(both: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Wasserstein-1 as the exact area between the two distribution functions."""
    shares = cumulative_shares(both, value, by, following=True)
    piece = F.abs(F.col("real_cdf") - F.col("synthetic_cdf")) * (F.col("next_value") - F.col(value))
    return shares.groupBy(*by).agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("wasserstein"))


def grid_distance(both: DataFrame, value: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wasserstein-1 as the mean quantile gap on max(n, m) evenly spaced quantiles.

    The larger side sits exactly on the grid; the smaller one is interpolated between two ranks.
    `tie` names columns that split equal values (an id), so a frequent value spreads over tasks.
    """
    by = list(by)
    rows = both.where(F.col(value).isNotNull()).select(*by, "is_real", F.col(value).cast("double").alias("v"), *tie)
    ranked = ordered(rows, ["is_real", *by], ["v", *tie], rank="rk").select(*by, "is_real", "v", (F.col("rk") - 1).alias("i"))
    sizes = ranked.groupBy(*by).agg(F.count_if("is_real").alias("rn"), F.count_if(~F.col("is_real")).alias("sn"))
    if by:
        ranked = ranked.join(sizes, by)
    else:
        one = sizes.first()
        ranked = ranked.withColumns({"rn": F.lit(one["rn"]), "sn": F.lit(one["sn"])})
    big = F.when(F.col("rn") >= F.col("sn"), F.col("is_real")).otherwise(~F.col("is_real"))
    n, m = F.greatest("rn", "sn"), F.least("rn", "sn")
    place = F.when(n > 1, F.col("i") * (m - 1) / (n - 1)).otherwise(F.lit(0.0))
    grid = ranked.where(big & (m > 0)).select(
        *by, F.col("v").alias("a"), F.floor(place).alias("lo"), F.ceil(place).alias("hi"), (place - F.floor(place)).alias("w")
    )
    small = ranked.where(~big).select(*by, "i", "v")
    low = small.select(*by, F.col("i").alias("lo"), F.col("v").alias("b_lo"))
    high = small.select(*by, F.col("i").alias("hi"), F.col("v").alias("b_hi"))
    met = grid.join(low, [*by, "lo"]).join(high, [*by, "hi"])
    b = F.col("b_lo") + (F.col("b_hi") - F.col("b_lo")) * F.col("w")
    return met.groupBy(*by).agg(F.avg(F.abs(F.col("a") - b)).alias("wasserstein"))


def shares(both: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Aligned counts and probabilities of both sides per key, inside each group of `by`."""
    by = list(by)
    counts = aligned_counts(both, [*by, *keys])
    totals = counts.groupBy(*by).agg(F.sum("real_n").alias("real_total"), F.sum("synthetic_n").alias("synthetic_total"))
    if by:
        counts = counts.join(totals, by)
    else:
        one = totals.first()
        counts = counts.withColumns({k: F.lit(one[k]).cast("long") for k in ("real_total", "synthetic_total")})
    return counts.withColumns({
        "p": F.coalesce(F.try_divide(F.col("real_n"), F.col("real_total")), F.lit(0.0)),
        "q": F.coalesce(F.try_divide(F.col("synthetic_n"), F.col("synthetic_total")), F.lit(0.0)),
    })


def total_variation(both: DataFrame, keys: Sequence[str], by: Sequence[str] = (), support: Sequence | None = None) -> DataFrame:
    """Half the L1 distance of the value shares; with `support`, mass outside it is ignored."""
    complete = both
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    s = shares(complete, keys, by)
    if support is not None:
        s = s.where(F.col(keys[0]).cast("string").isin([str(v) for v in support]))
    return s.groupBy(*by).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))


def _half_kl(p: str, mid: Column, base2: bool) -> Column:
    log = F.log2 if base2 else F.ln
    return F.when(F.col(p) > 0, F.col(p) * log(F.col(p) / mid)).otherwise(F.lit(0.0))


def jensen_shannon(both: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The three forms in use: ln divergence, log2 divergence, and the log2 distance (its root)."""
    s = shares(both, keys, by)
    mid = (F.col("p") + F.col("q")) / 2
    nat = F.sum(_half_kl("p", mid, False) + _half_kl("q", mid, False)) / 2
    two = F.sum(_half_kl("p", mid, True) + _half_kl("q", mid, True)) / 2
    return s.groupBy(*by).agg(nat.alias("js_ln"), two.alias("js_log2")).withColumn(
        "js_distance", F.sqrt(F.greatest(F.col("js_log2"), F.lit(0.0)))
    )


def kl_divergence(both: DataFrame, keys: Sequence[str], by: Sequence[str] = (), epsilon: float = 1e-12) -> DataFrame:
    """Sum of p(ln(p+e) - ln(q+e)) in both directions."""
    s = shares(both, keys, by)
    lp, lq = F.ln(F.col("p") + epsilon), F.ln(F.col("q") + epsilon)
    return s.groupBy(*by).agg(
        F.sum(F.col("p") * (lp - lq)).alias("kl_real_synthetic"), F.sum(F.col("q") * (lq - lp)).alias("kl_synthetic_real")
    )


def series_agreement(both: DataFrame, key: str, fill: float | None = 0.0) -> DataFrame:
    """Correlation, L1 over real rows, MAE of two count series on the union of keys."""
    c = aligned_counts(both, [key])
    gap = F.abs(F.col("real_n") - F.col("synthetic_n"))
    return c.agg(
        guarded_corr(F.col("real_n"), F.col("synthetic_n")).alias("corr"),
        (F.sum(gap) / F.greatest(F.sum("real_n"), F.lit(1))).alias("l1"),
        F.avg(gap).alias("mae"), F.count(F.lit(1)).alias("keys"),
    )
