"""Profiles, keys, descriptive and association statistics of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.kernels import numbered, ordered, quantiles, rate
from chronoweave.operators import counts as ct
from chronoweave.operators.splits import average_rank
from chronoweave.operators.two_sample import metric_rows, stack_reports


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, item, n) by value text for several categorical columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("item")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "item").agg(F.count(F.lit(1)).alias("n"))


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """(metric, value): mean, median, p95, share of zeros."""
    basic = df.agg(F.avg(column).alias("mean"), F.avg((F.col(column) == 0).cast("double")).alias("zero_rate"))
    return stack_reports(metric_rows(basic, basic.columns),
                         metric_rows(quantiles(df.select(column), column, {"median": 0.5, "p95": 0.95}), ["median", "p95"]))


LENGTH_PROBS = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def length_statistics(df: DataFrame, text: str) -> DataFrame:
    """(unit, statistic, value) of token, word and character lengths."""
    units = {"token": F.size(tx.tokens(text)), "word": tx.word_length(text), "char": tx.char_length(text)}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), e.alias("len")) for u, e in units.items()])))
    basic = long.groupBy("unit").agg(
        F.avg("len").alias("mean"), F.stddev_samp("len").alias("std"), F.min("len").cast("double").alias("min"),
        F.max("len").cast("double").alias("max"), rate(F.col("len") == 0).alias("empty_share"))
    wide = basic.join(quantiles(long, "len", LENGTH_PROBS, ["unit"]), "unit").withColumn("iqr", F.col("p75") - F.col("p25"))
    names = [c for c in wide.columns if c != "unit"]
    return wide.select("unit", F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names])))


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, missing, distinct, constant, all_missing).

    Distinct counts run on melted (column, value) pairs: one shuffle with map-side combine instead of
    one wide row expansion per counted column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])
    c = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    out = c.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("v").alias("distinct"))
    types = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    return out.select("column", types[F.col("column")].alias("dtype"), "rows", "missing", "distinct",
                      (F.col("distinct") == 1).alias("constant"), (F.col("missing") == F.col("rows")).alias("all_missing"))


def primary_key_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with a null key part, and all copies of duplicated keys."""
    any_null = None
    for k in key:
        any_null = F.col(k).isNull() if any_null is None else any_null | F.col(k).isNull()
    c = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first(any_null).alias("has_null"))
    return c.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("has_null"), F.col("n"))), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def foreign_key_report(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Rows, non-null rows, orphans and the valid share; a null reads as text and counts as invalid."""
    keys = parent.where(F.col(parent_column).isNotNull()).select(F.col(parent_column).cast("string").alias("_k")).distinct()
    c = child.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.coalesce(F.col(column).cast("string"), F.lit("nan")))
    m = c.join(keys.withColumn("_hit", F.lit(True)), "_k", "left")
    bad = F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0))
    return m.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_rows"),
        bad.alias("invalid"), (1 - bad / F.sum("n")).alias("valid_rate"))


def table_scan(df: DataFrame, ts: str, ids: Mapping[str, str], number: str, category: str) -> DataFrame:
    """(metric, value): rows, nulls per column, time range in days, active ids, category counts, price summary, duplicate rows."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    basic = df.agg(
        F.count(F.lit(1)).alias("rows"), *nulls, F.min(F.unix_date(F.to_date(ts))).alias("first_day"), F.max(F.unix_date(F.to_date(ts))).alias("last_day"),
        F.min(number).alias("number_min"), F.avg(number).alias("number_mean"), F.max(number).alias("number_max"))
    parts = [metric_rows(basic, basic.columns)]
    for name, c in ids.items():
        parts.append(metric_rows(df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("v")), {f"active_{name}": F.col("v")}))
    cats = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    parts.append(cats.select(F.concat(F.lit("category_"), F.coalesce(F.col(category).cast("string"), F.lit("null"))).alias("metric"), F.col("n").cast("double").alias("value")))
    dup = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    parts.append(metric_rows(dup, ["duplicate_rows"]))
    return stack_reports(*parts)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content hash: row count, and sum and xor of a 52-bit row hash (with repeats)."""
    from chronoweave.functions.hashing import hashed_long

    h = hashed_long("row", *[F.col(c) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(h, F.lit(2**31))).alias("low_sum"), F.bit_xor(h).alias("xor"))


# --- groups -------------------------------------------------------------------------------------


def numeric_by_group(df: DataFrame, group: str, value: str, probs: Mapping[str, float] | None = None) -> DataFrame:
    """Rows, mean, median and p95 of a number per group."""
    probs = dict(probs or {"median": 0.5, "p95": 0.95})
    basic = df.groupBy(group).agg(F.count(value).alias("rows"), F.avg(value).alias("mean"))
    return basic.join(quantiles(df, value, probs, [group]), group)


def entity_variance(df: DataFrame, entity: str, value: str, minimum: int) -> DataFrame:
    """(metric, value) over entities with enough rows: variance between and within, explained share, spread of means and medians."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    g = rows.groupBy(entity).agg(F.count("_x").alias("n"), F.avg("_x").alias("m"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"),
                                 F.when(F.count("_x") > 1, F.var_samp("_x")).otherwise(F.lit(0.0)).alias("v")).where(F.col("n") >= minimum)
    n, m, total = F.col("n"), F.col("m"), F.sum("n")
    grand = F.sum("s") / total
    out = g.agg(
        F.count(F.lit(1)).alias("entities"), total.alias("rows"), (F.sum(n * m * m) / total - grand * grand).alias("between"),
        (F.sum(F.col("v") * n) / total).alias("within"), (F.sum("q") / total - grand * grand).alias("total"))
    out = out.select("entities", "rows", "between", "within", F.try_divide(F.col("between"), F.col("total")).alias("explained"),
                     F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("icc"))
    medians = quantiles(rows.join(g.select(entity), entity, "left_semi"), value, {"med": 0.5}, [entity])
    parts = [metric_rows(out, out.columns)]
    for name, table, column in (("mean", g, "m"), ("median", medians, "med")):
        probs = {f"{name}_p5": 0.05, f"{name}_median": 0.5, f"{name}_p95": 0.95}
        parts.append(metric_rows(quantiles(table, column, probs), list(probs)))
    return stack_reports(*parts)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    from chronoweave.functions.kernels import guarded_corr

    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx = average_rank(clean, x, name="rx").select(x, "rx")
    ry = average_rank(clean, y, name="ry").select(y, "ry")
    # ranks are per value, so join them to pair counts, not to rows
    pairs = clean.groupBy(x, y).agg(F.count(F.lit(1)).alias("n")).join(rx, x).join(ry, y)
    n, a, b = F.sum("n"), F.col("rx"), F.col("ry")
    w = F.col("n")
    sa, sb = F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sa * sb / n
    var = F.sqrt((F.sum(w * a * a) - sa * sa / n) * (F.sum(w * b * b) - sb * sb / n))
    return pairs.agg(F.try_divide(cov, var).alias("spearman"), n.alias("rows"))


def kruskal_wallis(df: DataFrame, group: str, value: str, minimum: int = 2) -> DataFrame:
    """H with tie correction and epsilon squared, over groups of at least `minimum` rows."""
    cells = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    big = cells.groupBy(group).agg(F.sum("c").alias("_k")).where(F.col("_k") >= minimum)
    cells = cells.join(big, group)
    per_value = cells.groupBy(value).agg(F.sum("c").alias("ties"))
    run = ordered(per_value, [], [value], before={"_b": F.col("ties")})
    ranks = run.select(value, "ties", (F.col("_b") + (F.col("ties") + 1) / 2).alias("r"))
    one = ranks.agg(F.sum("ties"), F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties"))).first()
    n, ties = float(one[0]), float(one[1])
    g = cells.join(ranks, value).groupBy(group).agg(F.sum(F.col("c") * F.col("r")).alias("rs"), F.sum("c").alias("k"))
    h = (12.0 / (n * (n + 1)) * F.sum(F.col("rs") * F.col("rs") / F.col("k")) - 3 * (n + 1)) / F.lit(1 - ties / (n**3 - n))
    out = g.agg(h.alias("h"), F.count(F.lit(1)).alias("groups"))
    epsilon = (F.col("h") - F.col("groups") + 1) / F.greatest(F.lit(n) - F.col("groups"), F.lit(1.0))
    return out.withColumn("epsilon_squared", F.greatest(epsilon, F.lit(0.0)))


def binned_mutual_information(df: DataFrame, x: str, y: str, bins: int = 16) -> DataFrame:
    """Mutual information in nats of two numbers cut into equal-mass bins."""
    bx = equal_mass_bins(df, x, bins).select(x, F.col("bin").alias("bx"))
    by = equal_mass_bins(df, y, bins).select(y, F.col("bin").alias("by"))
    cells = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n")).join(bx, x).join(by, y).groupBy("bx", "by").agg(F.sum("n").alias("n"))
    rows = cells.groupBy("bx").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("by").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n")).first()[0]
    p = F.col("n") / F.lit(total)
    return cells.join(rows, "bx").join(cols, "by").agg(
        F.sum(p * F.ln(p * F.lit(total) * F.lit(total) / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def multi_run_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run) and a 95% interval over repeated runs."""
    n = F.count(value)
    out = rows.groupBy(*by).agg(n.alias("runs"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("std"))
    half = 1.96 * F.col("std") / F.sqrt(F.greatest("runs", F.lit(1)))
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def leaderboard(metrics: DataFrame, method: str, higher: Mapping[str, bool]) -> DataFrame:
    """Best method per metric; ties by name. `higher` says which direction is better."""
    up = F.create_map(*[F.lit(x) for kv in higher.items() for x in kv])[F.col("metric")]
    score = F.when(up, F.col("value")).otherwise(-F.col("value"))
    scored = metrics.where(up.isNotNull() & F.col("value").isNotNull()).withColumn("s", score)
    top = scored.groupBy("metric").agg(F.max("s").alias("best"))
    return scored.join(top, "metric").where(F.col("s") == F.col("best")).groupBy("metric").agg(
        F.min(method).alias("best_method"), F.max("value").alias("value"))


# --- bins ---------------------------------------------------------------------------------------


def adaptive_time_bins(df: DataFrame, ts: str, key: str, desired: int = 8, minimum_rows: int = 50) -> DataFrame:
    """Add `bin`: weeks when there are at least four of enough rows, else equal-count bins."""
    week = ct.period(F.col(ts), "week")
    ok = df.groupBy(week.alias("w")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.min("n")).first()
    if ok[0] >= 4 and ok[1] >= minimum_rows:
        return df.withColumn("bin", week)
    ranked = numbered(df, [ts, key], "_rk")
    n = ranked.count()
    place = F.greatest(F.lit(0), F.ceil((F.col("_rk") - 1) * min(desired, max(n, 1)) / F.lit(max(n - 1, 1))) - 1)
    return ranked.withColumn("bin", F.concat(F.lit("q"), (place + 1).cast("string"))).drop("_rk")


def equal_mass_bins(df: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n, bin): distinct values cut at i/k of the rows; empty cuts are closed up."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = ordered(c, [], [value], before={"_below": F.col("n")})
    total, distinct = run.agg(F.sum("n"), F.count(F.lit(1))).first()
    k = min(k, distinct or 1)
    raw = F.least(F.floor(F.col("_below") * k / F.lit(max(total or 1, 1))), F.lit(k - 1)).cast("int")
    marked = run.withColumn("_raw", raw)
    used = sorted(r[0] for r in marked.select("_raw").distinct().collect())  # at most k bins
    return marked.select(value, "n", (F.array_position(F.array(*[F.lit(u) for u in used]), F.col("_raw")) - 1).cast("int").alias("bin"))


def support_class_weights(counts: DataFrame, n: str = "n", beta: float = 0.999) -> DataFrame:
    """Inverse, inverse root and effective-number weights of value counts: mean 1, clipped to .05..20."""
    c = F.greatest(F.col(n).cast("double"), F.lit(1.0))
    raw = {"inverse": 1 / c, "inverse_sqrt": 1 / F.sqrt(c), "effective_number": (1 - beta) / (1 - F.pow(F.lit(beta), c))}
    means = counts.agg(*[F.avg(e).alias(k) for k, e in raw.items()]).first()
    return counts.withColumns({k: F.least(F.greatest(e / F.lit(means[k]), F.lit(0.05)), F.lit(20.0)) for k, e in raw.items()})


def class_balance_weights(df: DataFrame, column: str, classes: Sequence[str], power: float = 0.5, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """(class, n, weight): (1/frequency)^power with mean 1 over present classes, clipped; absent ones get the maximum."""
    domain = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    seen = df.groupBy(F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    full = domain.join(seen, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = float(max(full.agg(F.sum("n")).first()[0] or 0, 1))
    raw = F.when(F.col("n") > 0, F.pow(F.lit(total) / F.col("n"), F.lit(power)))
    mean = full.agg(F.avg(raw)).first()[0] or 1.0
    return full.select("class", "n", F.when(F.col("n") > 0, F.least(F.greatest(raw / mean, F.lit(low)), F.lit(high))).otherwise(F.lit(high)).alias("weight"))
