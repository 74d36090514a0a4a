"""How close a synthetic event spine is to the real one: degrees, overlap, blocks, time, lifecycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import aligned_counts, guarded_corr, materialize, quantiles, rate
from chronoweave.operators import counts as ct
from chronoweave.operators import two_sample as ts
from chronoweave.operators.two_sample import metric_rows, stack_reports

CUSTOMER, PRODUCT = "customer_id", "product_id"


def degree_sides(both: DataFrame, entity: str, real_entities_only: bool = True) -> DataFrame:
    """One (entity, side) degree row; over the real entities, missing synthetic degrees are 0."""
    c = aligned_counts(both, [entity])
    if real_entities_only:
        c = c.where(F.col("real_n") > 0)
    pair = F.array(
        F.struct(F.lit(True).alias("is_real"), F.col("real_n").alias("degree")),
        F.struct(F.lit(False).alias("is_real"), F.col("synthetic_n").alias("degree")),
    )
    out = c.select(entity, F.inline(pair))
    return out if real_entities_only else out.where(F.col("degree") > 0)


def degree_ks(both: DataFrame, entity: str, real_entities_only: bool = True) -> DataFrame:
    return ts.ks_distance(degree_sides(both, entity, real_entities_only), "degree", empty=0.0).select("ks")


def degree_exact_match(both: DataFrame, entity: str) -> DataFrame:
    """Share of the union of entities whose counts agree."""
    c = aligned_counts(both, [entity])
    return c.agg(rate(F.col("real_n") == F.col("synthetic_n")).alias("exact_match_rate"), F.count(F.lit(1)).alias("entities"))


def overlap(both: DataFrame, pair: Sequence[str] = (CUSTOMER, PRODUCT), day: str = "day") -> DataFrame:
    """Row- and edge-based overlap of pairs and dated events, and the repeated-row rates of both sides.

    One pass over (pair, day) counts and one roll-up to pairs; no join between the sides is needed.
    """
    events = aligned_counts(both, [*pair, day])
    e = events.agg(
        F.sum("synthetic_n").alias("synthetic_rows"),
        F.coalesce(F.sum(F.when(F.col("real_n") > 0, F.col("synthetic_n"))), F.lit(0)).alias("hits"),
    ).select((F.col("hits") / F.greatest("synthetic_rows", F.lit(1))).alias("exact_event_overlap_rate"))
    pairs = events.groupBy(*pair).agg(F.sum("real_n").alias("rn"), F.sum("synthetic_n").alias("sn"))
    hit = F.col("rn") > 0
    p = pairs.agg(
        (F.coalesce(F.sum(F.when(hit, F.col("sn"))), F.lit(0)) / F.greatest(F.sum("sn"), F.lit(1))).alias("real_edge_overlap_rate"),
        (F.count_if(hit & (F.col("sn") > 0)) / F.greatest(F.count_if(F.col("sn") > 0), F.lit(1))).alias("distinct_edge_overlap_rate"),
        (F.coalesce(F.sum(F.when(F.col("rn") > 1, F.col("rn"))), F.lit(0)) / F.greatest(F.sum("rn"), F.lit(1))).alias("real_duplicate_rate"),
        (F.coalesce(F.sum(F.when(F.col("sn") > 1, F.col("sn"))), F.lit(0)) / F.greatest(F.sum("sn"), F.lit(1))).alias("synthetic_duplicate_rate"),
    ).withColumn("duplicate_rate_ratio", F.try_divide(F.col("synthetic_duplicate_rate"), F.col("real_duplicate_rate")))
    return stack_reports(metric_rows(e, e.columns), metric_rows(p, p.columns))


def multiset_overlap(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the smaller counts over synthetic rows, and whether both multisets are equal."""
    c = aligned_counts(both, keys)
    return c.agg(
        (F.sum(F.least("real_n", "synthetic_n")) / F.greatest(F.sum("synthetic_n"), F.lit(1))).alias("overlap_rate"),
        F.bool_and(F.col("real_n") == F.col("synthetic_n")).alias("exact_match"),
    )


def block_pair_fidelity(both: DataFrame, with_time: bool = False, day: str = "day") -> DataFrame:
    """Exact-match rate and absolute errors of the block-pair (or cell) counts."""
    c = aligned_counts(both, ["customer_block", "product_block", *([day] if with_time else [])])
    gap = F.abs(F.col("real_n") - F.col("synthetic_n"))
    return c.agg(
        rate(gap == 0).alias("exact_match_rate"), F.count_if(F.col("real_n") > 0).alias("pairs_real"),
        F.count_if(F.col("synthetic_n") > 0).alias("pairs_synthetic"), F.count(F.lit(1)).alias("pairs_union"),
        F.sum(gap).alias("abs_error_sum"), F.max(gap).alias("max_abs_error"),
        F.try_divide(F.sum(gap), F.sum("real_n")).alias("l1_relative_error"),
    )


def block_pair_time_ks(both: DataFrame, ts_col: str, min_count: int = 5) -> DataFrame:
    """KS of event times inside each block pair: mean, median, real-weighted mean, pairs used and skipped."""
    pair = ["customer_block", "product_block"]
    times = both.withColumn("t", F.unix_micros(ts_col).cast("double"))
    per = ts.ks_distance(times, "t", pair).withColumn(
        "used", (F.col("real_n") >= min_count) & (F.col("synthetic_n") >= min_count))
    used = per.where("used")
    summary = per.agg(
        F.avg(F.when(F.col("used"), F.col("ks"))).alias("mean"),
        F.try_divide(F.sum(F.when(F.col("used"), F.col("ks") * F.col("real_n"))), F.sum(F.when(F.col("used"), F.col("real_n")))).alias("weighted_mean"),
        F.count_if("used").alias("pairs"), F.count_if(~F.col("used")).alias("skipped"),
    )
    return stack_reports(metric_rows(summary, summary.columns), metric_rows(quantiles(used, "ks", {"median": 0.5}), ["median"]))


def block_pair_date_l1(both: DataFrame, day: str = "day") -> DataFrame:
    """Per pair present on both sides: daily count gaps over its real rows; plain and real-weighted mean."""
    c = aligned_counts(both, ["customer_block", "product_block", day])
    gap = F.sum(F.abs(F.col("real_n") - F.col("synthetic_n")))
    per = c.groupBy("customer_block", "product_block").agg(
        gap.alias("gap"), F.sum("real_n").alias("rn"), F.sum("synthetic_n").alias("sn"))
    per = per.where((F.col("rn") > 0) & (F.col("sn") > 0)).withColumn("l1", F.col("gap") / F.col("rn"))
    return per.agg(
        F.avg("l1").alias("mean_l1"), F.try_divide(F.sum(F.col("l1") * F.col("rn")), F.sum("rn")).alias("weighted_l1"),
        F.count(F.lit(1)).alias("pairs"),
    )


def lifecycle_fidelity(both: DataFrame, entity: str, day: str = "day") -> DataFrame:
    """Correlation of first/last/peak on common entities; KS of span, entropy and day shares."""
    life = ct.lifecycle(both, entity, day, by=["is_real"])
    side = {
        f"{c}_{s}": F.max(F.when(F.col("is_real") == F.lit(s == "r"), F.col(c)))
        for c in ("first", "last", "peak") for s in ("r", "s")
    }
    wide = life.groupBy(entity).agg(*[v.alias(k) for k, v in side.items()]).where(
        F.col("first_r").isNotNull() & F.col("first_s").isNotNull())
    corr = wide.agg(*[guarded_corr(F.col(f"{c}_r"), F.col(f"{c}_s")).alias(f"{c}_time_corr") for c in ("first", "last", "peak")])
    shares_rows = both.groupBy("is_real", entity, day).agg(F.count(F.lit(1)).alias("n"))
    totals = shares_rows.groupBy("is_real", entity).agg(F.sum("n").alias("total"))
    day_shares = shares_rows.join(totals, ["is_real", entity]).select(
        "is_real", F.lit("time_activity_distribution_ks").alias("column"), (F.col("n") / F.col("total")).alias("value"))
    rows = ts.melt(life.withColumns({"active_span_ks": F.col("span"), "activity_entropy_ks": F.round("entropy", 9)}),
                   ["active_span_ks", "activity_entropy_ks"]).unionByName(day_shares)
    ks = ts.ks_distance(rows, "value", ["column"], empty=0.0).select(F.col("column").alias("metric"), F.col("ks").alias("value"))
    return stack_reports(metric_rows(corr, corr.columns), ks)


def coactivity(real: DataFrame, synthetic: DataFrame, margin: int = 30, day: str = "day") -> DataFrame:
    """Share of synthetic events inside the real active window (plus margin) of customer, product, both."""
    d = ct.day_ordinal(F.col(day))
    out = synthetic
    ok = {}
    for e in (CUSTOMER, PRODUCT):
        out = out.join(ct.window_within(real, e, day), e, "left")
        ok[e] = F.coalesce(d.between(F.col(f"{e}_first") - margin, F.col(f"{e}_last") + margin), F.lit(False))
    return out.agg(
        rate(ok[CUSTOMER]).alias("customer_rate"), rate(ok[PRODUCT]).alias("product_rate"),
        rate(ok[CUSTOMER] & ok[PRODUCT]).alias("joint_rate"),
    )


def relative_age(both: DataFrame, entity: str, day: str = "day") -> DataFrame:
    """Position of each event in the entity's real window (0 for unknown entities), on both sides."""
    w = ct.window_within(both.where("is_real"), entity, day)
    first, last = F.col(f"{entity}_first"), F.col(f"{entity}_last")
    age = (ct.day_ordinal(F.col(day)) - first) / F.greatest(last - first, F.lit(1))
    return both.join(w, entity, "left").withColumn("age", F.coalesce(age, F.lit(0.0)))


def relative_age_metrics(both: DataFrame, entity: str, day: str = "day") -> DataFrame:
    aged = relative_age(both, entity, day).withColumn("age", F.round("age", 12))
    ks = ts.ks_distance(aged, "age", empty=0.0).select(F.lit("relative_age_ks").alias("metric"), F.col("ks").alias("value"))
    mean = aged.agg((F.avg(F.when(~F.col("is_real"), F.col("age"))) - F.avg(F.when(F.col("is_real"), F.col("age"))))
                    .alias("relative_age_mean_diff"))
    return stack_reports(ks, metric_rows(mean, mean.columns))


def clock_distances(both: DataFrame, ts_col: str) -> DataFrame:
    """Total variation of the hour and of the weekday (Monday = 0)."""
    cells = F.array(
        F.struct(F.lit("hour").alias("part"), F.hour(ts_col).alias("item")),
        F.struct(F.lit("weekday").alias("part"), F.weekday(ts_col).alias("item")),
    )
    return ts.total_variation(both.select("is_real", F.inline(cells)), ["item"], ["part"])


def entity_time_ks(both: DataFrame, entity: str, ts_col: str) -> DataFrame:
    """KS of mean gaps (all entities) and of window, first and last (common entities)."""
    s = ct.entity_time_stats(both, entity, ts_col, by=["is_real"])
    both_sides = s.groupBy(entity).agg(F.count(F.lit(1)).alias("sides"))
    s = s.join(both_sides, entity).withColumns(
        {c: F.when(F.col("sides") == 2, F.col(c)) for c in ("window", "first", "last")})
    rows = ts.melt(s, ["mean_gap", "window", "first", "last"])
    return ts.ks_distance(rows, "value", ["column"])


def preservation_audit(both: DataFrame, ts_col: str = "day") -> DataFrame:
    """What the generator kept exactly, and the label that follows."""
    flags = []
    for name, keys in (("customer_degrees", [CUSTOMER]), ("product_degrees", [PRODUCT]), ("timestamps", [ts_col])):
        # degree multisets: counts of counts must agree; timestamps: counts per time must agree
        c = aligned_counts(both, keys)
        if name != "timestamps":
            sides = degree_sides(both, keys[0], real_entities_only=False)
            c = aligned_counts(sides, ["degree"])
        flags.append(c.agg(F.bool_and(F.col("real_n") == F.col("synthetic_n")).alias("exact")).select(F.lit(name).alias("item"), "exact"))
    blocks = both.where("is_real").select("customer_block", "product_block").distinct().agg((F.count(F.lit(1)) > 1).alias("exact"))
    flags.append(blocks.select(F.lit("blocks_not_trivial").alias("item"), "exact"))
    out = flags[0]
    for f in flags[1:]:
        out = out.unionByName(f)
    label = F.when(F.col("item") == "blocks_not_trivial", F.when(F.col("exact"), "block structure used").otherwise("single block"))
    return out.withColumn("label", F.coalesce(label, F.when(F.col("exact"), "preserved exactly").otherwise("learned")))


def spine_report(both: DataFrame, customer_blocks: DataFrame, product_blocks: DataFrame, margin: int = 30) -> DataFrame:
    """The whole spine comparison as (metric, value) rows."""
    # the comparison reads the two sides many times: keep one narrow copy
    base = materialize(both.select("is_real", CUSTOMER, PRODUCT, "day"))
    blocked = ct.with_blocks(base, customer_blocks, product_blocks, missing=-1)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col("metric")).alias("metric"), F.col("value").cast("double"))

    sizes = base.agg(*[
        F.count_distinct(F.when(F.col("is_real") == F.lit(s == "real"), F.col(c))).alias(f"active_{n}_{s}")
        for c, n in ((CUSTOMER, "customers"), (PRODUCT, "products")) for s in ("real", "synthetic")
    ])
    parts = [metric_rows(sizes, sizes.columns), overlap(base)]
    for e, n in ((CUSTOMER, "customer_"), (PRODUCT, "product_")):
        parts.append(metric_rows(degree_ks(base, e), {f"{n}degree_ks": F.col("ks")}))
        parts.append(named(lifecycle_fidelity(base, e), n))
        parts.append(named(relative_age_metrics(base, e), n))
    daily = ts.series_agreement(base, "day")
    monthly = ts.series_agreement(base.select("is_real", F.date_format("day", "yyyy-MM").alias("m")), "m")
    parts.append(metric_rows(daily, {"daily_count_corr": F.col("corr"), "daily_count_l1": F.col("l1")}))
    parts.append(metric_rows(monthly, {"monthly_count_corr": F.col("corr")}))
    parts.append(metric_rows(block_pair_fidelity(blocked), {"block_pair_count_exact_match_rate": F.col("exact_match_rate")}))
    parts.append(metric_rows(block_pair_fidelity(blocked, True), {"block_pair_time_count_l1": F.col("l1_relative_error")}))
    co = coactivity(base.where("is_real"), base.where("not is_real"), margin)
    parts.append(metric_rows(co, {f"coactive_{c}": F.col(c) for c in co.columns}))
    return stack_reports(*parts)
