"""Counts, degrees, repeated pairs, blocks and entity lifecycles of an event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import numbered, ordered, quantiles, rate

DEGREE_PROBS = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def degrees(df: DataFrame, entity: str, name: str = "degree") -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias(name))


def gini(df: DataFrame, value: str, by: Sequence[str] = (), clip: bool = False) -> DataFrame:
    """Gini coefficient of a non-negative column; 0 when everything is 0.

    Works on value counts: a run of n equal values x at ranks b+1..b+n adds x*(n*b + n(n+1)/2).
    """
    by = list(by)
    v = F.greatest(F.col(value).cast("double"), F.lit(0.0)) if clip else F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, v.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    run = ordered(counts, by, ["x"], before={"b": F.col("n")})
    weighted = F.sum(F.col("x") * (F.col("n") * F.col("b") + F.col("n") * (F.col("n") + 1) / 2))
    total, n = F.sum(F.col("x") * F.col("n")), F.sum("n")
    value_col = F.when(total == 0, F.lit(0.0)).otherwise(2.0 * weighted / (n * total) - (n + 1.0) / n)
    return run.groupBy(*by).agg(value_col.alias("gini"))


def degree_summary(df: DataFrame, entity: str) -> DataFrame:
    """(metric, value): count, mean, median, p90, p95, p99, max and gini of the entity degrees."""
    from chronoweave.operators.two_sample import metric_rows, stack_reports

    d = degrees(df, entity)
    basic = d.agg(F.count(F.lit(1)).alias("count"), F.avg("degree").alias("mean"), F.max("degree").alias("max"))
    return stack_reports(
        metric_rows(basic, ["count", "mean", "max"]),
        metric_rows(quantiles(d, "degree", DEGREE_PROBS), list(DEGREE_PROBS)),
        metric_rows(gini(d, "degree"), ["gini"]),
    )


def pair_counts(df: DataFrame, pair: Sequence[str]) -> DataFrame:
    return df.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))


def repeated_pair_statistics(df: DataFrame, pair: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Both duplicate definitions, kept under two names.

    surplus_rate: 1 - distinct pairs / rows; repeated_row_rate: rows in pairs seen more than once / rows.
    """
    c = df.groupBy(*by, *pair).agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum("n")
    return c.groupBy(*by).agg(
        rows.alias("rows"), F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated_pairs"),
        (1 - F.count(F.lit(1)) / rows).alias("surplus_rate"),
        (F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / rows).alias("repeated_row_rate"),
        F.max("n").alias("max_multiplicity"),
    )


def multiplicity_histogram(df: DataFrame, pair: Sequence[str]) -> DataFrame:
    return pair_counts(df, pair).groupBy(F.col("n").alias("multiplicity")).agg(F.count(F.lit(1)).alias("pairs"))


def top_pairs(df: DataFrame, pair: Sequence[str], k: int = 20) -> DataFrame:
    return pair_counts(df, pair).orderBy(F.desc("n"), *pair).limit(k)


def period(ts: Column, grain: str) -> Column:
    """Text key of the day, week (first Monday), month or year of a time."""
    if grain == "week":
        return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[grain])


def counts_by_period(df: DataFrame, ts: str, grain: str) -> DataFrame:
    return df.groupBy(period(F.col(ts), grain).alias("period")).agg(F.count(F.lit(1)).alias("n"))


# --- blocks -------------------------------------------------------------------------------------


def with_blocks(
    df: DataFrame, customer_blocks: DataFrame, product_blocks: DataFrame, missing: int | None = None,
    customer: str = "customer_id", product: str = "product_id",
) -> DataFrame:
    """Add both block columns. `missing` None drops unmapped rows (inner); -1 or 0 keeps them.

    The maps have one row per entity, so they are left to Catalyst: broadcast under the size
    threshold, otherwise a shuffled join with adaptive skew splitting.
    """
    how = "inner" if missing is None else "left"
    out = df.join(customer_blocks, customer, how).join(product_blocks, product, how)
    fill = F.lit(missing)
    return out.withColumns({
        c: F.col(c).cast("int") if missing is None else F.coalesce(F.col(c).cast("int"), fill)
        for c in ("customer_block", "product_block")
    })


def cell_counts(df: DataFrame, day: str = "day") -> DataFrame:
    """Events per (customer block, product block, day) cell with the month gate."""
    return df.groupBy("customer_block", "product_block", day).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.date_format(day, "yyyy-MM")).alias("gate")
    )


def block_overview(blocks: DataFrame, block: str) -> DataFrame:
    """(metric, value): number of blocks and their smallest, median and largest size."""
    from chronoweave.operators.two_sample import metric_rows, stack_reports

    sizes = degrees(blocks, block, "size")
    basic = sizes.agg(F.count(F.lit(1)).alias(f"{block}_count"), F.min("size").alias(f"{block}_size_min"),
                      F.max("size").alias(f"{block}_size_max"))
    return stack_reports(
        metric_rows(basic, basic.columns),
        metric_rows(quantiles(sizes, "size", {f"{block}_size_median": 0.5}), [f"{block}_size_median"]),
    )


def block_pair_concentration(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per hierarchy level: pairs, smallest/mean/median/largest cell, share of the largest and of the top ten."""
    by = list(by)
    cells = df.groupBy(*by, "customer_block", "product_block").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered(cells, by, [F.desc("n"), "customer_block", "product_block"], rank="rk")
    total = F.sum("n")
    basic = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("n").alias("min_cell"), F.avg("n").alias("mean_cell"),
        F.max("n").alias("max_cell"), (F.max("n") / total).alias("largest_share"),
        (F.sum(F.when(F.col("rk") <= 10, F.col("n"))) / total).alias("top10_share"),
    )
    return basic.join(quantiles(cells, "n", {"median_cell": 0.5}, by), by)


def cell_size_statistics(cells: DataFrame, limit: int) -> DataFrame:
    """(metric, value): cell count, mean, p95, p99, max, and the share of cells and events above `limit`."""
    from chronoweave.operators.two_sample import metric_rows, stack_reports

    big = F.col("n") > limit
    basic = cells.agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("events"), F.avg("n").alias("mean"), F.max("n").alias("max"),
        rate(big).alias("cells_above_limit"), (F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)) / F.sum("n")).alias("events_above_limit"),
    )
    return stack_reports(
        metric_rows(basic, basic.columns), metric_rows(quantiles(cells, "n", {"p95": 0.95, "p99": 0.99}), ["p95", "p99"])
    )


def degree_quantile_blocks(df: DataFrame, entity: str, k: int, block: str) -> DataFrame:
    """Entities by degree (falling, then id text), cut into k equal runs."""
    d = degrees(df, entity)
    ranked = numbered(d, [F.desc("degree"), F.col(entity).cast("string")], "rk")
    n = ranked.count()
    cut = F.floor((F.col("rk") - 1) * k / F.lit(n))
    return ranked.select(entity, F.least(cut, F.lit(k - 1)).cast("int").alias(block))


def joint_degree_matrix(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges per (out-degree of the source, in-degree of the target)."""
    out = degrees(edges, src, "out_degree")
    into = degrees(edges, dst, "in_degree")
    return edges.join(out, src).join(into, dst).groupBy("out_degree", "in_degree").agg(F.count(F.lit(1)).alias("edges"))


# --- lifecycles ---------------------------------------------------------------------------------


def day_ordinal(day) -> Column:
    """Day number with 0001-01-01 = 1."""
    return F.unix_date(day) + 719163


def lifecycle(df: DataFrame, entity: str, day: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """First, last and peak day (largest count, earliest on ties), span, and entropy over days."""
    by = list(by)
    c = df.groupBy(*by, entity, day_ordinal(F.col(day)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    n, total = F.col("n"), F.sum("n")
    # -sum p ln p with p = n/N equals ln N - sum(n ln n)/N: one pass, no join back
    return c.groupBy(*by, entity).agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.max_by("d", F.struct("n", -F.col("d"))).alias("peak"),
        (F.max("d") - F.min("d")).alias("span"), (F.ln(total) - F.sum(n * F.ln(n)) / total).alias("entropy"),
        total.alias("degree"),
    )


def structural_features(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Degree, log degree, first/last on [0,1] of the table's range, span, monthly entropy, early/late share."""
    lo, hi = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    span = max(float(hi - lo), 1.0)
    x = (F.unix_micros(ts) - F.lit(lo)) / F.lit(span)
    months = df.groupBy(entity, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("first"), F.max(x).alias("last"),
        F.count_if(x <= 0.5).alias("early"),
    )
    total = F.sum("n")
    return months.groupBy(entity).agg(
        total.alias("degree"), F.log1p(total).alias("log_degree"), F.min("first").alias("first"), F.max("last").alias("last"),
        ((F.max("last") - F.min("first")) * span / 86400e6).alias("span_days"),
        (F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total).alias("monthly_entropy"),
        (F.sum("early") / total).alias("early_share"), (1 - F.sum("early") / total).alias("late_share"),
    )


def entity_time_stats(df: DataFrame, entity: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """First, last, active window and mean gap (null with one event) in days."""
    t = F.unix_micros(ts) / F.lit(86400e6)
    span = F.max(t) - F.min(t)
    n = F.count(F.lit(1))
    return df.groupBy(*by, entity).agg(
        F.min(t).alias("first"), F.max(t).alias("last"), span.alias("window"),
        F.when(n > 1, span / (n - 1)).alias("mean_gap"), n.alias("events"),
    )


def inter_event_gaps(df: DataFrame, entity: str, ts: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Days between consecutive events of an entity; the first event of each has none."""
    rows = df.select(*by, entity, *tie, (F.unix_micros(ts) / F.lit(86400e6)).alias("t"))
    seen = ordered(rows, [*by, entity], ["t", *tie], previous={"t0": F.col("t")})
    return seen.where(F.col("t0").isNotNull()).select(*by, entity, (F.col("t") - F.col("t0")).alias("gap"))


def window_within(df: DataFrame, entity: str, day: str = "day") -> DataFrame:
    d = day_ordinal(F.col(day))
    return df.groupBy(entity).agg(F.min(d).alias(f"{entity}_first"), F.max(d).alias(f"{entity}_last"))


def top_entities(df: DataFrame, entity: str, k: int) -> DataFrame:
    """Most frequent entities, ties by id."""
    return degrees(df, entity, "n").orderBy(F.desc("n"), entity).limit(k)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the minimum to the maximum, the last one closed."""
    lo, hi = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))
    counts = df.where(F.col(value).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )
