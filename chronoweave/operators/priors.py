"""Smoothed priors, shrunk effects, and temporal activity of entities and blocks.

Tables stay sparse and long: one row per observed (group, class) or (entity, time), never a dense grid
of entities by time. Domains of classes are short literal lists and are exploded, not cross joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.cleaning import logit
from chronoweave.functions.hashing import hashed_long
from chronoweave.functions.kernels import materialize, ordered, quantiles

TINY = 1e-8
AGE_BINS = ["pre_active", "early", "mid", "late", "post_active", "single_day"]


def class_shares(df: DataFrame, column: str, classes: Sequence[str]) -> dict[str, float]:
    """Shares of the domain classes over the whole table; uniform when none occurs."""
    c = df.where(F.col(column).cast("string").isin(list(classes))).groupBy(F.col(column).cast("string").alias("c")).count().collect()
    n = {r["c"]: r["count"] for r in c}
    total = sum(n.values())
    return {k: (n.get(k, 0) / total if total else 1 / len(classes)) for k in classes}


def _lookup(values: Mapping[str, float], key: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[key]


def grouped_class_prior(
    df: DataFrame, by: Sequence[str], column: str, flag: str, classes: Sequence[str], alpha: float | None = None
) -> DataFrame:
    """(by, class, n, p, global_p, flag_rate): class shares and flag rate of a group pulled to the global ones.

    alpha None means max(20, sqrt(n)).
    """
    base = class_shares(df, column, classes)
    rate_all = df.agg(F.avg(F.col(flag).cast("double"))).first()[0] or 0.0
    cell = df.groupBy(*by, F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(flag).cast("double")).alias("f"))
    group = cell.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("f").alias("f"))
    grid = group.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    a = F.greatest(F.lit(20.0), F.sqrt("n")) if alpha is None else F.lit(float(alpha))
    full = grid.join(cell.select(*by, "class", "c"), [*by, "class"], "left").withColumn("global_p", _lookup(base, F.col("class")))
    return full.select(
        *by, "class", "n", ((F.coalesce("c", F.lit(0)) + a * F.col("global_p")) / (F.col("n") + a)).alias("p"), "global_p",
        ((F.col("f") + a * rate_all) / (F.col("n") + a)).alias("flag_rate"), F.lit(rate_all).alias("global_rate"))


def prior_for(keys: DataFrame, prior: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class shares for each key row; a group never seen gets the global shares."""
    classes = prior.select("class", "global_p", "global_rate").distinct()
    base = {r["class"]: (r["global_p"], r["global_rate"]) for r in classes.collect()}
    grid = keys.withColumn("class", F.explode(F.array(*[F.lit(c) for c in sorted(base)])))
    out = grid.join(prior.select(*by, "class", "p", "flag_rate"), [*by, "class"], "left")
    rate_all = next(iter(base.values()))[1] if base else 0.0
    return out.withColumns({"p": F.coalesce("p", _lookup({k: v[0] for k, v in base.items()}, F.col("class"))),
                            "flag_rate": F.coalesce("flag_rate", F.lit(rate_all))})


def residuals(prior: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, class, residual, flag_residual): log share against the global one, centered in the group; logit gap of the flag."""
    gap = F.ln(F.col("p") + TINY) - F.ln(F.col("global_p") + TINY)
    with_gap = prior.withColumn("gap", gap)
    center = with_gap.groupBy(*by).agg(F.avg("gap").alias("center"))
    return with_gap.join(center, list(by)).select(
        *by, "class", (F.col("gap") - F.col("center")).alias("residual"),
        (logit("flag_rate") - logit("global_rate")).alias("flag_residual"))


def first_level(df: DataFrame, levels: Sequence[tuple[str, DataFrame, Sequence[str]]], values: Sequence[str], default: Mapping[str, float]) -> DataFrame:
    """Fallback lookup: the first level that knows the row's key wins, with its name in `source_level`.

    `levels` are (name, table, keys), most specific first; the tables have one row per key.
    """
    out = df
    for i, (_, table, keys) in enumerate(levels):
        side = table.select(*keys, *[F.col(v).alias(f"_{i}_{v}") for v in values], F.lit(True).alias(f"_{i}_hit"))
        out = out.join(side, list(keys), "left")
    source, picked = None, {v: None for v in values}
    for i, (name, _, _) in enumerate(levels):
        hit = F.col(f"_{i}_hit")
        source = F.when(hit, name) if source is None else source.when(hit, name)
        for v in values:
            picked[v] = F.when(hit, F.col(f"_{i}_{v}")) if picked[v] is None else picked[v].when(hit, F.col(f"_{i}_{v}"))
    out = out.withColumns({"source_level": source.otherwise("global"), **{v: picked[v].otherwise(F.lit(default[v])) for v in values}})
    return out.drop(*[c for c in out.columns if c.startswith("_") and c.split("_")[1].isdigit()])


def median_degree(df: DataFrame, entity: str, default: float = 10.0) -> float:
    return _median(df.groupBy(entity).agg(F.count(F.lit(1)).alias("d")), "d", default)


def _median(rows: DataFrame, value: str, default: float = 10.0) -> float:
    m = quantiles(rows, value, {"m": 0.5}).first()["m"]
    return m if m and m > 0 else default


def entity_effects(df: DataFrame, entity: str, value: str, flag: str, alpha: float | None = None) -> DataFrame:
    """Shrunk mean effect n/(n+a)(mean-global), and the flag effect in logit space; a defaults to the median degree."""
    a = median_degree(df, entity) if alpha is None else alpha
    m, f = df.agg(F.avg(F.col(value).cast("double")), F.avg(F.col(flag).cast("double"))).first()
    n = F.count(F.lit(1))
    g = df.groupBy(entity).agg(n.alias("n"), F.avg(F.col(value).cast("double")).alias("m"), F.avg(F.col(flag).cast("double")).alias("f"))
    shrink = F.col("n") / (F.col("n") + F.lit(float(a)))
    return g.select(entity, "n", (shrink * (F.col("m") - m)).alias("value_effect"), (shrink * (logit("f") - logit(F.lit(f)))).alias("flag_effect"))


def vector_effects(df: DataFrame, entity: str, column: str, flag: str, classes: Sequence[str], alpha: float | None = None) -> DataFrame:
    """(entity, effects array, flag_effect): centered log shares per class in domain order."""
    a = median_degree(df, entity) if alpha is None else alpha
    res = residuals(grouped_class_prior(df, [entity], column, flag, classes, a), [entity])
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    packed = res.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), "residual"))).alias("v"), F.first("flag_residual").alias("flag_effect"))
    return packed.select(entity, F.transform("v", lambda x: x["residual"]).alias("effects"), "flag_effect")


def degree_bins(df: DataFrame, degree: str, bins: int) -> tuple[DataFrame, list[float]]:
    """Add `degree_bin` q0..; edges are inner quantiles, a value on an edge goes up."""
    from chronoweave.functions.cleaning import bucket_by_edges

    cut = quantiles(df, degree, {str(i): i / bins for i in range(1, bins)}).first()
    edges = sorted(set(cut.asDict().values()))
    return df.withColumn("degree_bin", F.concat(F.lit("q"), bucket_by_edges(degree, edges).cast("string"))), edges


def gaussian_cells(
    effects: DataFrame, block: str, degree: str, x: str, y: str, bins: int = 4, minimum: int = 20, shrinkage: float = 0.1, eps: float = 1e-6
) -> DataFrame:
    """(level, block, degree_bin, entities, means, covariance): cells, then blocks, then degree bins, then global.

    All four grains come from one GROUPING SETS pass. Off-diagonals are shrunk, the diagonal gets eps.
    """
    binned, _ = degree_bins(effects, degree, bins)
    total = binned.count()
    n = F.count(F.lit(1))
    cov = {"xx": F.covar_samp(x, x), "xy": F.covar_samp(x, y), "yy": F.covar_samp(y, y)}
    g = binned.groupingSets([[F.col(block), F.col("degree_bin")], [F.col(block)], [F.col("degree_bin")], []], F.col(block), F.col("degree_bin")).agg(
        F.grouping_id().alias("gid"), n.alias("entities"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        *[F.when(n > 1, c).alias(k) for k, c in cov.items()])
    level = F.when(F.col("gid") == 0, "cell").when(F.col("gid") == 1, "block").when(F.col("gid") == 2, "degree_bin").otherwise("global")
    g = g.withColumn("level", level)
    some = F.col("entities") >= max(2, min(minimum, total))
    keep = (F.col("level") == "global") | ((F.col("level") == "cell") & ((F.col("entities") >= minimum) | (F.col("entities") >= max(2, total // 4)))) | (
        F.col("level").isin("block", "degree_bin") & some)
    return g.where(keep).select(
        "level", F.col(block).alias("block"), "degree_bin", "entities", "mean_x", "mean_y",
        (F.coalesce("xx", F.lit(eps)) + eps).alias("cov_xx"), (F.coalesce("xy", F.lit(0.0)) * (1 - shrinkage)).alias("cov_xy"),
        (F.coalesce("yy", F.lit(eps)) + eps).alias("cov_yy"))


# --- time ---------------------------------------------------------------------------------------


def activity_model(df: DataFrame, entity: str, day: str, blocks: DataFrame, block: str, smoothing: float = 5.0, alpha: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Sparse activity: (entity, day, own probability, weight, block) and (block, day, probability, cdf).

    P(t) = w * own(t) + (1-w) * block(t) with w = degree/(degree+alpha).
    """
    counts = materialize(df.groupBy(entity, day).agg(F.count(F.lit(1)).alias("n")))
    degree = counts.groupBy(entity).agg(F.sum("n").alias("degree"))
    a = _median(degree, "degree") if alpha is None else alpha
    own = counts.join(degree, entity).join(blocks, entity, "left").withColumn(block, F.coalesce(F.col(block).cast("int"), F.lit(0)))
    own = own.select(entity, block, day, (F.col("n") / F.col("degree")).alias("own_p"), (F.col("degree") / (F.col("degree") + F.lit(float(a)))).alias("weight"), "n", "degree")
    by_block = own.groupBy(block, day).agg(F.sum("n").alias("bn"))
    by_day = by_block.groupBy(day).agg(F.sum("bn").alias("gn"))
    total = by_day.agg(F.sum("gn")).first()[0] or 1
    block_total = by_block.groupBy(block).agg(F.sum("bn").alias("bt"))
    # every block sees every day: blocks are few, days are bounded by the calendar
    names = [r[0] for r in block_total.select(block).distinct().collect()]
    grid = by_day.withColumn(block, F.explode(F.array(*[F.lit(b) for b in names])))
    smooth = grid.join(by_block, [block, day], "left").join(block_total, block)
    p = (F.coalesce("bn", F.lit(0)) + smoothing * F.col("gn") / F.lit(total)) / (F.col("bt") + smoothing)
    model = ordered(smooth.select(block, day, p.alias("p")), [block], [day], through={"cdf": F.col("p")})
    return own, model


def activity_probability(pairs: DataFrame, own: DataFrame, model: DataFrame, entity: str, day: str, block: str, eps: float = 1e-12) -> DataFrame:
    """P(t) for given (entity, day) rows; an entity never seen follows its block."""
    weight = own.select(entity, block, "weight").distinct()
    out = pairs.join(weight, entity, "left").join(own.select(entity, day, "own_p"), [entity, day], "left").join(model.select(block, day, "p"), [block, day], "left")
    w = F.coalesce("weight", F.lit(0.0))
    mix = w * F.coalesce("own_p", F.lit(0.0)) + (1 - w) * F.coalesce("p", F.lit(0.0))
    return out.withColumn("probability", F.greatest(mix, F.lit(eps)))


def shrinkage_by_holdout(df: DataFrame, entity: str, key: str, day: str, blocks: DataFrame, block: str, alphas: Sequence[float], seed: int = 42, min_degree: int = 2) -> DataFrame:
    """(alpha, avg_log_likelihood, events): one held-out event per entity, scored under each alpha."""
    keyed = df.join(blocks, entity, "left").withColumn(block, F.coalesce(F.col(block).cast("int"), F.lit(0)))
    degree = keyed.groupBy(entity).agg(F.count(F.lit(1)).alias("degree"), F.min_by(key, F.struct(hashed_long(seed, key), F.col(key))).alias("_held"))
    marked = keyed.join(degree, entity).withColumn("held", (F.col(key) == F.col("_held")) & (F.col("degree") >= min_degree))
    train = marked.where(~F.col("held"))
    own = train.groupBy(entity, day).agg(F.count(F.lit(1)).alias("c"))
    size = train.groupBy(entity).agg(F.count(F.lit(1)).alias("d"))
    bt = train.groupBy(block, day).agg(F.count(F.lit(1)).alias("bc"))
    bs = train.groupBy(block).agg(F.count(F.lit(1)).alias("bd"))
    gone = marked.where("held").select(entity, block, day).join(own, [entity, day], "left").join(size, entity, "left").join(bt, [block, day], "left").join(bs, block, "left")
    rows = gone.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    d = F.coalesce("d", F.lit(0))
    w = F.coalesce(F.try_divide(d, d + F.col("alpha")), F.lit(0.0))
    p = w * F.coalesce(F.try_divide(F.col("c"), d), F.lit(0.0)) + (1 - w) * F.coalesce(F.try_divide(F.col("bc"), F.col("bd")), F.lit(0.0))
    return rows.groupBy("alpha").agg(F.avg(F.ln(F.greatest(p, F.lit(1e-12)))).alias("avg_log_likelihood"), F.count(F.lit(1)).alias("events"))


def gap_bandwidths(
    df: DataFrame, entity: str, day: str, tie: Sequence[str], blocks: DataFrame, block: str,
    default: float = 7.0, scale: float = 0.25, low: float = 1.0, high: float | None = None,
) -> DataFrame:
    """(entity, block, bandwidth, source): spread of the gaps between events, entity then block then global."""
    d = df.withColumn("_d", F.unix_date(day))
    seen = ordered(d.select(entity, "_d", *tie), [entity], ["_d", *tie], previous={"_p": F.col("_d")})
    gaps = seen.where(F.col("_p").isNotNull()).select(entity, (F.col("_d") - F.col("_p")).cast("double").alias("gap"))
    members = df.select(entity).distinct().join(blocks, entity, "left").withColumn(block, F.coalesce(F.col(block).cast("int"), F.lit(0)))
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

    def spread(fallback: Column) -> Column:
        iqr = F.col("q75") - F.col("q25")
        return F.when(iqr > 0, iqr).when(F.col("q50") > 0, F.col("q50")).otherwise(fallback)

    def clip(c: Column) -> Column:
        c = F.greatest(c, F.lit(low))
        return c if high is None else F.least(c, F.lit(high))

    one = quantiles(gaps, "gap", probs).select(spread(F.lit(default / scale)).alias("raw")).first()
    raw = one["raw"] if one and one["raw"] is not None else default / scale
    overall = max(scale * raw, low) if high is None else min(max(scale * raw, low), high)
    per_block = quantiles(gaps.join(members, entity), "gap", probs, [block]).select(block, clip(scale * spread(F.lit(raw))).alias("block_bw"))
    n = gaps.groupBy(entity).agg(F.count(F.lit(1)).alias("gaps"))
    own = quantiles(gaps, "gap", probs, [entity]).join(n, entity)
    out = members.join(per_block, block, "left").join(own, entity, "left")
    fallback = F.coalesce("block_bw", F.lit(overall))
    enough = F.coalesce(F.col("gaps") >= 2, F.lit(False))
    return out.select(
        entity, block, F.when(enough, clip(scale * spread(fallback / scale))).otherwise(fallback).alias("bandwidth"),
        F.when(enough, "entity").when(F.col("block_bw").isNotNull(), "block").otherwise("global").alias("source"))


def kde_bandwidths(df: DataFrame, by: Sequence[str], x: str, fallback: float = 0.05, silverman: bool = False, tiny: float = 1e-4) -> DataFrame:
    """(by, n, bandwidth): std * n^(-1/5) of positions on [0, 1]; `fallback` for small or flat groups."""
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("std"))
    raw = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * (0.9 if silverman else 1.0)
    usable = (F.col("n") >= 3) & (F.col("std") > tiny)
    return g.select(*by, "n", F.when(usable, F.greatest(raw, F.lit(tiny))).otherwise(F.lit(max(fallback, tiny))).alias("bandwidth"))


def time_gates(events: DataFrame, gate: str, u: str, v: str, alpha: float) -> DataFrame:
    """(gate, dim, weight): mean elementwise product of the two vectors per gate, shrunk to the overall mean."""
    long = events.select(gate, F.posexplode(F.zip_with(u, v, lambda a, b: a * b)).alias("dim", "x"))
    total = long.groupBy("dim").agg(F.avg("x").alias("overall"))
    per = long.groupBy(gate, "dim").agg(F.avg("x").alias("raw"), F.count(F.lit(1)).alias("n")).join(total, "dim")
    w = F.col("n") / (F.col("n") + alpha)
    shrunk = per.select(gate, "dim", (w * F.col("raw") + (1 - w) * F.col("overall")).alias("g"))
    scale = shrunk.groupBy(gate).agg(F.avg(F.abs("g")).alias("s"))
    return shrunk.join(scale, gate).select(gate, "dim", (F.col("g") / F.greatest("s", F.lit(1e-12))).alias("weight"))


def product_age_bin(first: Column, last: Column, now: Column) -> Column:
    span = F.datediff(last, first)
    rel = F.datediff(now, first) / span
    return (F.when(now < first, "pre_active").when(now > last, "post_active").when(span == 0, "single_day")
            .when(rel <= 0.25, "early").when(rel <= 0.75, "mid").otherwise("late"))


def product_age_affinity(df: DataFrame, product: str, block: str, day: str, smoothing: float = 5.0) -> DataFrame:
    """(block, age_bin, probability, global_probability, log_residual) of product age at the time of purchase."""
    life = df.groupBy(product).agg(F.min(day).alias("_f"), F.max(day).alias("_l"))
    aged = df.join(life, product).withColumn("age_bin", product_age_bin(F.col("_f"), F.col("_l"), F.col(day)))
    cells = aged.groupBy(block, "age_bin").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["age_bin"]: r["n"] for r in cells.groupBy("age_bin").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values())
    base = {b: (seen.get(b, 0) + smoothing / len(AGE_BINS)) / (total + smoothing) for b in AGE_BINS}
    sizes = cells.groupBy(block).agg(F.sum("n").alias("t")).withColumn("age_bin", F.explode(F.array(*[F.lit(b) for b in AGE_BINS])))
    full = sizes.join(cells, [block, "age_bin"], "left").withColumn("global_probability", _lookup(base, F.col("age_bin")))
    p = (F.coalesce("n", F.lit(0)) + smoothing * F.col("global_probability")) / (F.col("t") + smoothing)
    return full.select(block, "age_bin", p.alias("probability"), "global_probability", (F.ln(p) - F.ln("global_probability")).alias("log_residual"))
