"""Numeric supports: nearest values, profiles, calibration against a reference distribution, transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import cleaning as cl
from chronoweave.functions.hashing import hashed_unit
from chronoweave.functions.kernels import numbered, ordered, quantile_grid, quantiles, rate
from chronoweave.operators.splits import average_rank
from chronoweave.operators.two_sample import metric_rows, stack_reports


def support_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("support")).agg(F.count(F.lit(1)).alias("n"))


def nearest_values(queries: DataFrame, value: str, support: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, nearest, distance) per distinct query value; ties go to the smaller support value.

    Both sides are merged in order once. A query learns how many support values lie at or below it and
    joins the support by number, so the join is an equi-join whatever the spread of the values.
    """
    by = list(by)
    numbered_support = ordered(support.select(*by, "support").distinct(), by, ["support"], rank="k")
    asked = queries.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x")).distinct()
    merged = numbered_support.select(*by, F.col("support").alias("x"), F.lit(1).alias("s")).unionByName(asked.withColumn("s", F.lit(0)))
    # at equal values the support row comes first
    run = ordered(merged, by, ["x", F.desc("s")], through={"k": F.col("s")}).where(F.col("s") == 0)
    low = numbered_support.select(*by, "k", F.col("support").alias("low"))
    high = numbered_support.select(*by, (F.col("k") - 1).alias("k"), F.col("support").alias("high"))
    met = run.join(low, [*by, "k"], "left").join(high, [*by, "k"], "left")
    take_low = F.col("high").isNull() | (F.abs(F.col("x") - F.col("low")) <= F.abs(F.col("high") - F.col("x")))
    nearest = F.when(F.col("low").isNotNull() & take_low, F.col("low")).otherwise(F.col("high"))
    return met.select(*by, F.col("x").alias(value), nearest.alias("nearest")).withColumn("distance", F.abs(F.col(value) - F.col("nearest")))


def project_to_support(df: DataFrame, value: str, support: DataFrame, entity: str | None = None, entity_support: DataFrame | None = None,
                       minimum: int = 1, out: str = "projected") -> DataFrame:
    """Add the nearest support value; with an entity support, entities with enough rows use their own."""
    keyed = df.withColumn(value, F.col(value).cast("double"))
    flat = nearest_values(keyed, value, support).select(value, F.col("nearest").alias("_g"))
    res = keyed.join(flat, value, "left")
    if entity is None:
        return res.withColumn(out, F.col("_g")).drop("_g")
    big = entity_support.groupBy(entity).agg(F.sum("n").alias("_n")).where(F.col("_n") >= minimum).select(entity)
    own_support = entity_support.join(big, entity, "left_semi")
    own = nearest_values(keyed.join(big, entity, "left_semi"), value, own_support, [entity]).select(entity, value, F.col("nearest").alias("_e"))
    return res.join(own, [entity, value], "left").withColumns({out: F.coalesce("_e", "_g"), "source_level": F.when(F.col("_e").isNotNull(), "entity").otherwise("global")}).drop("_e", "_g")


def stochastic_projection(df: DataFrame, key: str, value: str, support: DataFrame, neighbors: int = 8, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """(key, projected): one of the nearest `neighbors` support values, by softmax of distance and count.

    The 2*neighbors support values around a query are joined by number; no row sees the whole support.
    """
    s = ordered(support.select("support", "n"), [], ["support"], rank="k")
    asked = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    merged = s.select(F.col("support").alias("x"), F.lit(1).alias("s")).unionByName(asked.select("x").distinct().withColumn("s", F.lit(0)))
    place = ordered(merged, [], ["x", F.desc("s")], through={"at": F.col("s")}).where(F.col("s") == 0).select("x", "at")
    window = F.sequence(F.col("at") - neighbors + 1, F.col("at") + neighbors)
    near = place.withColumn("k", F.explode(window)).join(s, "k").withColumn("d", F.abs(F.col("x") - F.col("support")))
    packed = near.groupBy("x").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "support", "n"))), 1, neighbors).alias("c"))
    scale = F.greatest(F.element_at("c", -1)["d"], F.lit(1e-12))
    packed = packed.withColumn("scale", scale)
    rows = asked.join(packed, "x")
    score = F.transform("c", lambda e: F.struct(
        (-e["d"] / F.col("scale") / temperature + 0.25 * F.ln(F.greatest(e["n"], F.lit(1)))
         - F.ln(-F.ln(hashed_unit(seed, F.col(key), e["support"])))).alias("s"), e["support"].alias("v")))
    return rows.select(key, F.array_max(score)["v"].alias("projected"))


def learned_bins(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """(support): at most `bins` observed values, the middle one of each equal-mass run."""
    from chronoweave.operators.profiles import equal_mass_bins

    cut = equal_mass_bins(df.withColumn(value, F.col(value).cast("double")), value, bins)
    run = ordered(cut, ["bin"], [value], rank="i")
    size = run.groupBy("bin").agg(F.max("i").alias("m"))
    return run.join(size, "bin").where(F.col("i") == F.floor((F.col("m") + 1) / 2)).select(F.col(value).alias("support"))


def decimal_precisions(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(cl.decimal_places(value).alias("places")).agg(F.count(F.lit(1)).alias("n"))


def support_profile(df: DataFrame, value: str, top: int = 32) -> DataFrame:
    """(metric, value): support size, repeats, entropy in bits, spacing of the support, top mass, main precision."""
    c = support_counts(df, value)
    run = ordered(c, [], ["support"], following={"up": F.col("support")})
    n = F.col("n")
    gap = F.col("up") - F.col("support")
    basic = run.agg(
        F.sum(n).alias("rows"), F.count(F.lit(1)).alias("unique"), (F.count(F.lit(1)) / F.sum(n)).alias("unique_ratio"),
        (F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)) / F.sum(n)).alias("repeated_mass"),
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy_bits"),
        F.min(gap).alias("spacing_min"), F.avg(gap).alias("spacing_mean"), F.max(gap).alias("spacing_max"),
        F.coalesce(F.try_divide(F.stddev_pop(gap), F.greatest(F.avg(gap), F.lit(1e-12))), F.lit(0.0)).alias("spacing_cv"))
    total = basic.first()["rows"]
    top_mass = c.orderBy(F.desc("n"), "support").limit(top).agg((F.sum("n") / F.lit(total)).alias("top_mass"))
    precision = decimal_precisions(df, value).agg((F.max("n") / F.lit(total)).alias("dominant_precision"))
    return stack_reports(
        metric_rows(basic, basic.columns), metric_rows(top_mass, ["top_mass"]), metric_rows(precision, ["dominant_precision"]),
        metric_rows(quantiles(run.withColumn("gap", gap), "gap", {"spacing_median": 0.5, "spacing_p95": 0.95}), ["spacing_median", "spacing_p95"]))


def holdout_overlap(df: DataFrame, key: str, value: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Share of hashed-out rows whose value also occurs in the rest."""
    held = hashed_unit(seed, key) < fraction
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(held).alias("h"), F.count_if(~held).alias("f"))
    return c.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("f") > 0, F.col("h"))), F.sum("h")), F.lit(1.0)).alias("holdout_overlap"))


# Thresholds of the six signals.
TYPE_THRESHOLDS = {"unique_ratio": 0.25, "repeated_mass": 0.5, "holdout_overlap": 0.75, "dominant_precision": 0.7, "spacing_cv": 2.0, "top_mass": 0.1}
LOW_CARDINALITY = 64


def numeric_type(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the six signals, votes, and the kind of the column (structured needs three votes)."""
    m = {r["metric"]: r["value"] for r in support_profile(df, value).collect()}
    m["holdout_overlap"] = holdout_overlap(df, key, value).first()[0]
    at_most = {"unique_ratio", "spacing_cv"}
    signals = {k: (m[k] <= v if k in at_most else m[k] >= v) for k, v in TYPE_THRESHOLDS.items()}
    votes = sum(signals.values())
    low = m["unique"] <= LOW_CARDINALITY and (signals["unique_ratio"] or signals["repeated_mass"])
    kind = "low_cardinality" if low else ("structured" if votes >= 3 else "continuous")
    return df.sparkSession.createDataFrame([(*signals.values(), votes, kind)], ", ".join(f"{k} boolean" for k in signals) + ", votes int, kind string")


def split_overlap(parts: DataFrame, part: str, value: str, support: DataFrame, tolerance: float) -> DataFrame:
    """Per split: rows, distinct values, exact and tolerant share on the support, mean and largest distance."""
    near = nearest_values(parts, value, support)
    c = parts.where(F.col(value).isNotNull()).groupBy(part, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("n")).join(near, value)
    n, d = F.col("n"), F.col("distance")
    total = F.sum(n)
    return c.groupBy(part).agg(
        total.alias("rows"), F.count(F.lit(1)).alias("unique"), (F.sum(F.when(d == 0, n).otherwise(0)) / total).alias("exact_overlap"),
        (F.sum(F.when(d <= tolerance, n).otherwise(0)) / total).alias("tolerant_overlap"), (F.sum(n * d) / total).alias("mean_distance"), F.max(d).alias("max_distance"))


def probability_table(train: DataFrame, validation: DataFrame, generated: DataFrame, value: str, eps: float = 1e-8) -> DataFrame:
    """Support values with counts and shares of the three sides after projection, ratio and log correction."""
    base = support_counts(train, value).withColumnRenamed("n", "train_count")
    both = validation.select(value, F.lit("v").alias("side")).unionByName(generated.select(value, F.lit("g").alias("side")))
    near = nearest_values(both, value, base).select(value, "nearest")
    c = both.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double")).groupBy(value).agg(
        F.count_if(F.col("side") == "v").alias("v"), F.count_if(F.col("side") == "g").alias("g"))
    c = c.join(near, value).groupBy(F.col("nearest").alias("support")).agg(F.sum("v").alias("validation_count"), F.sum("g").alias("generated_count"))
    t = base.join(c, "support", "left").na.fill(0, ["validation_count", "generated_count"])
    s = t.agg(F.sum("train_count"), F.sum("validation_count"), F.sum("generated_count")).first()
    p = {n: F.col(f"{n}_count") / F.lit(float(max(s[i] or 0, 1))) for i, n in enumerate(("train", "validation", "generated"))}
    t = t.withColumns({f"p_{k}": e for k, e in p.items()})
    return t.withColumns({
        "ratio": (F.col("p_train") + eps) / (F.col("p_generated") + eps),
        "log_correction": F.ln(F.col("p_train") + eps) - F.ln(F.col("p_generated") + eps),
    })


def calibration_metrics(table: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(metric, value) from a support probability table: distances, head and tail mass, entropy, rare and dominant mass."""
    from chronoweave.functions.kernels import guarded_corr

    ranked = numbered(table, [F.desc("p_train"), "support"], "i")
    size = ranked.count()
    p, q, v = F.col("p_train"), F.col("p_generated"), F.col("p_validation")
    rare_cut = quantiles(table, "p_train", {"x": 0.25}).first()["x"]
    dominant = min(10, max(1, -(-size // 10)))
    i = F.col("i")

    def mass(c: Column, on: Column) -> Column:
        return F.coalesce(F.sum(F.when(on, c)), F.lit(0.0))

    rare = p <= rare_cut
    mid = (p + q) / 2
    one = ranked.agg(
        F.count(F.lit(1)).alias("support_size"), (F.sum(F.abs(p - q)) / 2).alias("tv_train_generated"), (F.sum(F.abs(v - q)) / 2).alias("tv_validation_generated"),
        (F.sum(p * (F.ln(p + eps) - F.ln(mid + eps)) + q * (F.ln(q + eps) - F.ln(mid + eps))) / 2).alias("js"),
        F.sum(p * (F.ln(p + eps) - F.ln(q + eps))).alias("kl_train_generated"), F.sum(q * (F.ln(q + eps) - F.ln(p + eps))).alias("kl_generated_train"),
        *[F.abs(mass(q, i <= k) - mass(p, i <= k)).alias(f"top_{k}_error") for k in (10, 50, 100)],
        F.abs(mass(q, i > min(100, size)) - mass(p, i > min(100, size))).alias("tail_error"),
        (-F.sum(p * F.ln(p + eps))).alias("train_entropy"), (-F.sum(q * F.ln(q + eps))).alias("generated_entropy"),
        mass(p, rare).alias("rare_train"), mass(q, rare).alias("rare_generated"), mass(p, i <= dominant).alias("dominant_train"), mass(q, i <= dominant).alias("dominant_generated"),
        rate((F.col("train_count") > 0) & (F.col("generated_count") == 0)).alias("missing_rate"),
        guarded_corr(F.when(i <= 100, p), F.when(i <= 100, q)).alias("head_correlation"))
    return metric_rows(one, one.columns)


def log_bias(table: DataFrame, strength: float) -> DataFrame:
    """Additive logit correction per support value."""
    return table.select("support", (F.col("log_correction") * strength).alias("bias"))


def smoothed_support_prior(df: DataFrame, value: str, by: Sequence[str] = (), smoothing: float = 1.0, backoff: float = 100.0, minimum: int = 20, top: int | None = None) -> DataFrame:
    """Support prior: (count + 1) shares globally; per group pulled to the global one, only for groups of enough rows.

    With `top`, each group keeps its most frequent values (a top-k per group by definition of the table).
    """
    base = support_counts(df, value)
    total = base.agg(F.sum(F.col("n") + smoothing)).first()[0]
    flat = base.select("support", ((F.col("n") + smoothing) / F.lit(float(total))).alias("p"))
    if not by:
        return flat
    c = support_counts(df, value, by)
    size = c.groupBy(*by).agg(F.sum("n").alias("rows")).where(F.col("rows") >= minimum)
    full = c.join(size, list(by)).join(flat, "support")
    mixed = full.select(*by, "support", "n", "rows", ((F.col("n") + backoff * F.col("p")) / (F.col("rows") + backoff)).alias("p"))
    if top is None:
        return mixed
    return ordered(mixed, list(by), [F.desc("n"), "support"], rank="i").where(F.col("i") <= top).drop("i")


def quantile_map(train: DataFrame, synthetic: DataFrame, key: str, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """(key, by, calibrated): average rank r of n becomes the (r-.5)/n quantile of the reference in the same group."""
    by = list(by)
    ranks = average_rank(synthetic.withColumn("_x", F.col(value).cast("double")), "_x", by, "r")
    sizes = ranks.groupBy(*by).agg(F.sum("ties").alias("n"))
    ref = ordered(train.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), tie), by, ["v", tie], rank="i")
    m = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    if by:
        ranks = ranks.join(sizes, by).join(m, by)
        n, mm = F.col("n"), F.col("m")
    else:
        n, mm = F.lit(sizes.first()[0]), F.lit(m.first()[0])
    place = (F.col("r") - 0.5) / n * (mm - 1)
    at = ranks.select(*by, "_x", (F.floor(place) + 1).alias("lo"), (F.ceil(place) + 1).alias("hi"), (place - F.floor(place)).alias("w"))
    low, high = ref.select(*by, F.col("i").alias("lo"), F.col("v").alias("a")), ref.select(*by, F.col("i").alias("hi"), F.col("v").alias("b"))
    mapped = at.join(low, [*by, "lo"]).join(high, [*by, "hi"]).select(*by, "_x", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("calibrated"))
    return synthetic.withColumn("_x", F.col(value).cast("double")).join(mapped, [*by, "_x"], "left").select(key, *by, "calibrated")


# --- transforms ---------------------------------------------------------------------------------


def fit_transform(df: DataFrame, columns: Mapping[str, bool]) -> dict[str, dict]:
    """Per column (True for counts): mean and deviation after log1p for counts, and the training range."""
    aggs = []
    for c, counts in columns.items():
        x = F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if counts else F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_m"), F.stddev_pop(x).alias(f"{c}_s"), F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi")]
    row = df.agg(*aggs).first()
    return {c: {"counts": k, "mean": row[f"{c}_m"], "std": row[f"{c}_s"] if row[f"{c}_s"] >= 1e-8 else 1.0, "min": row[f"{c}_lo"], "max": row[f"{c}_hi"]} for c, k in columns.items()}


def apply_transform(c, how: Mapping) -> Column:
    x = F.col(c).cast("double") if isinstance(c, str) else c
    x = F.log1p(F.greatest(x, F.lit(0.0))) if how["counts"] else x
    return (x - how["mean"]) / how["std"]


def invert_transform(c, how: Mapping) -> Column:
    """Back to the original scale, inside the training range; counts are whole."""
    x = (F.col(c) if isinstance(c, str) else c) * how["std"] + how["mean"]
    x = F.bround(F.expm1(x)) if how["counts"] else x
    return F.least(F.greatest(x, F.lit(how["min"])), F.lit(how["max"]))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    ppf = NormalDist().inv_cdf
    return p.map(lambda v: None if pd.isna(v) else ppf(min(max(v, 1e-7), 1 - 1e-7)))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    cdf = NormalDist().cdf
    return x.map(lambda v: None if pd.isna(v) else cdf(v))


def cdf_edges(df: DataFrame, value: str) -> DataFrame:
    """(value, low, high): the step of each value in the empirical distribution function."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0]
    run = ordered(c, [], [value], before={"b": F.col("n")})
    return run.select(value, (F.col("b") / F.lit(total)).alias("low"), ((F.col("b") + F.col("n")) / F.lit(total)).alias("high"))


def dequantize(df: DataFrame, key: str, value: str, edges: DataFrame, seed: int = 42) -> DataFrame:
    """Add `u`, uniform inside the step of the value, and `z`, its normal quantile."""
    out = df.join(edges, value, "left")
    u = F.col("low") + (F.col("high") - F.col("low")) * hashed_unit(seed, key)
    return out.withColumn("u", u).withColumn("z", normal_quantile("u")).drop("low", "high")


def requantize(df: DataFrame, key: str, z: str, edges: DataFrame, value: str) -> DataFrame:
    """Value whose step holds the normal probability of z (left edge on ties); a merge by order and number."""
    steps = ordered(edges, [], ["low"], rank="k")
    q = df.select(key, normal_cdf(z).alias("u"))
    merged = steps.select(F.col("low").alias("x"), F.lit(1).alias("s"), F.lit(None).cast(dict(df.dtypes)[key]).alias(key)).unionByName(
        q.select(F.col("u").alias("x"), F.lit(0).alias("s"), key))
    at = ordered(merged, [], ["x", F.desc("s"), key], through={"k": F.col("s")}).where(F.col("s") == 0)
    return at.withColumn("k", F.greatest("k", F.lit(1))).join(steps.select("k", value), "k").select(key, value)


def linear_normalizer(df: DataFrame, key: str, value: str, kind: str = "standard") -> DataFrame:
    """(key, scaled, missing): standard scores or the place between minimum and maximum, fitted on the values there are.

    A missing value becomes 0 (the mean, or the minimum) with its flag set; a column that does not vary is 0 throughout.
    """
    v = F.col(value).cast("double")
    if kind == "standard":
        centre, spread = df.agg(F.avg(v), F.stddev_pop(v)).first()
    elif kind == "minmax":
        lo, hi = df.agg(F.min(v), F.max(v)).first()
        centre, spread = lo, None if lo is None else hi - lo
    else:
        raise ValueError(f"unknown normalizer: {kind}")
    scaled = (v - centre) / spread if spread else F.lit(0.0)
    return df.select(key, F.coalesce(scaled, F.lit(0.0)).alias("scaled"), v.isNull().alias("missing"))


def quantile_normalizer(df: DataFrame, key: str, value: str, normal: bool = True) -> DataFrame:
    """(key, scaled): place on the empirical quantile grid (n/30 knots, 10..1000), as uniform or normal score."""
    n = df.where(F.col(value).isNotNull()).count()
    knots = max(min(n // 30, 1000), 10)
    # at most 1,000 knots reach the driver
    edges = [r["value"] for r in quantile_grid(df, value, knots).orderBy("knot").collect()]

    @F.pandas_udf(T.DoubleType())
    def place(x: pd.Series) -> pd.Series:
        import numpy as np

        e, p = np.asarray(edges), np.linspace(0, 1, knots)
        v = x.to_numpy(dtype=float)
        # average of both directions handles flat stretches of the grid
        return pd.Series(0.5 * (np.interp(v, e, p) - np.interp(-v, -e[::-1], -p[::-1])))

    u = place(F.col(value).cast("double"))
    return df.where(F.col(value).isNotNull()).select(key, (normal_quantile(u) if normal else u).alias("scaled"))
