"""Fidelity of generated attributes: by month, by entity, by group, jointly, and as copied tuples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import aligned_counts, discard, finished, guarded_corr, in_pieces, quantiles, rate
from chronoweave.operators import two_sample as ts
from chronoweave.operators.two_sample import metric_rows, stack_reports


def on_side(real: bool, c: Column) -> Column:
    return F.when(F.col("is_real") == F.lit(real), c)


def side_means(both: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, real_n, synthetic_n, real_mean, synthetic_mean) in one pass."""
    v = F.col(value).cast("double")
    return both.groupBy(*by).agg(
        F.count(on_side(True, v)).alias("real_n"), F.count(on_side(False, v)).alias("synthetic_n"),
        F.avg(on_side(True, v)).alias("real_mean"), F.avg(on_side(False, v)).alias("synthetic_mean"))


def group_mean_agreement(both: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Correlation, MAE and real-weighted MAE of group means over groups on both sides."""
    g = side_means(both, by, value).where(F.col("real_mean").isNotNull() & F.col("synthetic_mean").isNotNull())
    gap = F.abs(F.col("real_mean") - F.col("synthetic_mean"))
    return g.agg(guarded_corr(F.col("real_mean"), F.col("synthetic_mean")).alias("corr"), F.avg(gap).alias("mae"),
                 F.try_divide(F.sum(gap * F.col("real_n")), F.sum("real_n")).alias("weighted_mae"), F.count(F.lit(1)).alias("groups"))


def entity_mean_distribution(both: DataFrame, entity: str, value: str) -> DataFrame:
    """(metric, value): variances of the entity means, their ratio, and the KS between both sides."""
    m = both.groupBy("is_real", entity).agg(F.avg(F.col(value).cast("double")).alias("m"))
    v = m.agg(F.var_pop(on_side(True, F.col("m"))).alias("real_variance"), F.var_pop(on_side(False, F.col("m"))).alias("synthetic_variance"))
    v = v.withColumn("variance_ratio", F.when(F.abs("real_variance") >= 1e-12, F.col("synthetic_variance") / F.col("real_variance")))
    ks = ts.ks_distance(m.withColumn("m", F.round("m", 12)), "m", empty=0.0)
    return stack_reports(metric_rows(v, v.columns), metric_rows(ks, {"distribution_ks": F.col("ks")}))


def value_degree_corr(both: DataFrame, entity: str, value: str) -> DataFrame:
    g = both.groupBy("is_real", entity).agg(F.count(F.lit(1)).alias("d"), F.avg(F.col(value).cast("double")).alias("m"))
    return g.groupBy("is_real").agg(guarded_corr(F.col("d"), F.col("m")).alias("corr"))


def monthly_table(both: DataFrame, bucket: str, value: str, flag: str) -> DataFrame:
    """Per bucket: counts, mean values and flag rates of both sides, absolute errors, and the JS of the value."""
    base = both.groupBy(bucket).agg(*[
        e.alias(f"{n}_{s}") for s, real in (("real", True), ("synthetic", False)) for n, e in (
            ("n", F.count_if(F.col("is_real") == F.lit(real))), ("mean", F.avg(on_side(real, F.col(value).cast("double")))), ("rate", F.avg(on_side(real, F.col(flag).cast("double")))))])
    js = ts.jensen_shannon(both, [value], [bucket]).select(bucket, F.col("js_log2").alias("js"))
    out = base.join(js, bucket)
    present = (F.col("n_real") > 0) & (F.col("n_synthetic") > 0)
    return out.withColumns({"js": F.when(present, F.col("js")), "mean_error": F.abs(F.col("mean_synthetic") - F.col("mean_real")), "rate_error": F.abs(F.col("rate_synthetic") - F.col("rate_real"))})


def monthly_summary(table: DataFrame) -> DataFrame:
    """(metric, value): correlation, MAE, RMSE and variance ratio of the monthly means and rates; mean JS."""
    parts = []
    for n in ("mean", "rate"):
        a, b = F.col(f"{n}_real"), F.col(f"{n}_synthetic")
        ok = a.isNotNull() & b.isNotNull()
        x, y = F.when(ok, a), F.when(ok, b)
        one = table.agg(guarded_corr(a, b).alias(f"{n}_corr"), F.avg(F.abs(x - y)).alias(f"{n}_mae"), F.sqrt(F.avg((x - y) * (x - y))).alias(f"{n}_rmse"),
                        F.stddev_samp(x).alias(f"{n}_real_std"), F.stddev_samp(y).alias(f"{n}_synthetic_std"), F.try_divide(F.var_pop(y), F.var_pop(x)).alias(f"{n}_variance_ratio"))
        parts.append(metric_rows(one, one.columns))
    js = table.agg(F.avg("js").alias("js_mean"))
    return stack_reports(*parts, metric_rows(js, js.columns))


def joint_categories(both: DataFrame, value: str, flag: str, support: Sequence[int]) -> DataFrame:
    """(metric, value): joint L1 on the fixed support, MAE of the flag rate per value, L1 of values given the flag."""
    c = aligned_counts(both.where(F.col(value).isNotNull() & F.col(flag).isNotNull()), [value, flag])
    n = c.agg(F.sum("real_n"), F.sum("synthetic_n")).first()
    inside = F.col(value).isin(list(support)) & F.col(flag).isin(0, 1)
    joint = c.where(inside).agg(F.sum(F.abs(F.col("real_n") / max(n[0] or 0, 1) - F.col("synthetic_n") / max(n[1] or 0, 1))).alias("joint_l1"))
    per_value = c.groupBy(value).agg(*[F.try_divide(F.sum(F.when(F.col(flag) == 1, F.col(s))), F.sum(s)).alias(s) for s in ("real_n", "synthetic_n")])
    per_value = per_value.where(F.col(value).isin(list(support)))
    full = c.groupBy(value).agg(*[F.coalesce(F.sum(F.when(F.col(flag) == 1, F.col(s))), F.lit(0)).alias(f"f_{s}") for s in ("real_n", "synthetic_n")], F.sum("real_n").alias("rn"), F.sum("synthetic_n").alias("sn"))
    gap = full.where(F.col(value).isin(list(support)) & (F.col("rn") > 0) & (F.col("sn") > 0)).agg(F.avg(F.abs(F.col("f_real_n") / F.col("rn") - F.col("f_synthetic_n") / F.col("sn"))).alias("flag_rate_by_value_mae"))
    by_flag = c.where(F.col(value).isin(list(support))).groupBy(flag).agg(F.sum("real_n").alias("rt"), F.sum("synthetic_n").alias("st"))
    given = c.where(inside).join(by_flag, flag).agg(F.sum(F.abs(F.coalesce(F.try_divide(F.col("real_n"), F.col("rt")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("synthetic_n"), F.col("st")), F.lit(0.0)))).alias("value_given_flag_l1"))
    return stack_reports(metric_rows(joint, joint.columns), metric_rows(gap, gap.columns), metric_rows(given, given.columns))


def numeric_report(both: DataFrame, value: str, tie: str, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(metric, value): means, deviations, quantile MAE, KS, W1, support TV and overlap, out-of-range, uniqueness, missing."""
    v = F.col(value).cast("double")
    lo, hi = both.where("is_real").agg(F.min(v), F.max(v)).first()
    basic = both.agg(
        F.avg(on_side(True, v)).alias("real_mean"), F.avg(on_side(False, v)).alias("synthetic_mean"), F.stddev_samp(on_side(True, v)).alias("real_std"), F.stddev_samp(on_side(False, v)).alias("synthetic_std"),
        F.avg(on_side(False, ((v < lo) | (v > hi)).cast("double"))).alias("out_of_range_rate"), F.avg(on_side(False, v.isNull().cast("double"))).alias("synthetic_missing_rate"))
    names = {f"q{i}": p for i, p in enumerate(probs)}
    q = quantiles(both.where(F.col(value).isNotNull()), value, names, ["is_real"])
    gap = q.agg(*[F.abs(F.max(on_side(True, F.col(n))) - F.max(on_side(False, F.col(n)))).alias(n) for n in names])
    gap = gap.select((sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).alias("quantile_mae"))
    s = ts.shares(both.where(F.col(value).isNotNull()), [value])
    sup = s.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("support_tv"), F.sum(F.when(F.col("real_n") > 0, F.col("q")).otherwise(0.0)).alias("support_overlap"),
                (F.count_if(F.col("real_n") > 0) / F.max("real_total")).alias("real_unique_ratio"), (F.count_if(F.col("synthetic_n") > 0) / F.max("synthetic_total")).alias("synthetic_unique_ratio"))
    ks = ts.ks_distance(both, value)
    w = ts.grid_distance(both, value, [tie])
    return stack_reports(metric_rows(basic, basic.columns), metric_rows(gap, gap.columns), metric_rows(sup, sup.columns),
                         metric_rows(ks, {"ks": F.col("ks")}), metric_rows(w, {"wasserstein": F.col("wasserstein")}))


def categorical_report(both: DataFrame, column: str, rare_share: float = 0.01, rare_rows: int = 5) -> DataFrame:
    """(metric, value): TV, JS distance, invalid rate, and how many rare real categories the synthetic side covers."""
    present = both.where(F.col(column).isNotNull())
    s = ts.shares(present, [column])
    n = s.agg(F.max("real_total")).first()[0] or 0
    rare = (F.col("real_n") > 0) & (F.col("real_n") <= max(rare_rows, rare_share * n))
    one = s.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), F.sum(F.when(F.col("real_n") == 0, F.col("q")).otherwise(0.0)).alias("invalid_rate"),
                F.count_if(rare).alias("rare_categories"), F.try_divide(F.count_if(rare & (F.col("synthetic_n") > 0)), F.count_if(rare)).alias("rare_coverage"))
    js = ts.jensen_shannon(present, [column])
    return stack_reports(metric_rows(one, one.columns), metric_rows(js, {"js_distance": F.col("js_distance")}))


def conditional_numeric(both: DataFrame, condition: str, value: str) -> DataFrame:
    """Groups compared, MAE of group means, and the same over the real deviation."""
    std = both.agg(F.stddev_samp(on_side(True, F.col(value).cast("double")))).first()[0] or 0.0
    a = group_mean_agreement(both, [condition], value)
    return a.select("groups", "mae", (F.col("mae") / max(std, 1e-12)).alias("standardized_mae"))


def conditional_categorical(both: DataFrame, condition: str, column: str, minimum: int = 2) -> DataFrame:
    """Groups of enough real rows: total variation of the category inside the group, weighted by real rows."""
    s = ts.shares(both, [column], [condition])
    per = s.groupBy(condition).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), F.max("real_total").alias("rn"), F.max("synthetic_total").alias("sn"))
    used = per.where((F.col("rn") >= minimum) & (F.col("sn") > 0))
    return used.agg(F.count(F.lit(1)).alias("groups"), F.try_divide(F.sum(F.col("tv") * F.col("rn")), F.sum("rn")).alias("weighted_tv"))


def entity_numeric_report(both: DataFrame, entity: str, value: str, minimum: int = 1) -> DataFrame:
    """(metric, value): weighted mean and quantile MAE per entity, share of synthetic values the entity has shown, mode match."""
    v = F.col(value).cast("double")
    g = side_means(both, [entity], value).where((F.col("real_n") >= minimum) & (F.col("synthetic_n") >= minimum))
    w = F.col("real_n")
    means = g.agg(F.count(F.lit(1)).alias("entities"), F.try_divide(F.sum(F.abs(F.col("real_mean") - F.col("synthetic_mean")) * w), F.sum(w)).alias("weighted_mean_mae"))
    q = quantiles(both.where(v.isNotNull()), value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["is_real", entity])
    wide = q.groupBy(entity).agg(*[F.max(on_side(s, F.col(c))).alias(f"{c}{int(s)}") for c in ("q1", "q2", "q3") for s in (True, False)])
    gap = sum((F.abs(F.col(f"{c}1") - F.col(f"{c}0")) for c in ("q1", "q2", "q3")), F.lit(0.0)) / 3
    quant = wide.join(g.select(entity, "real_n"), entity).agg(F.try_divide(F.sum(gap * w), F.sum(w)).alias("weighted_quantile_mae"))
    c = aligned_counts(both.where(v.isNotNull()), [entity, value])
    seen = c.agg(F.try_divide(F.sum(F.when(F.col("real_n") > 0, F.col("synthetic_n")).otherwise(0)), F.sum("synthetic_n")).alias("seen_pair_rate"))
    # most frequent value per side, the smaller value on ties
    mode = c.groupBy(entity).agg(F.max_by(value, F.struct("real_n", -F.col(value))).alias("rm"), F.max("real_n").alias("rn"),
                                 F.max_by(value, F.struct("synthetic_n", -F.col(value))).alias("sm"), F.max("synthetic_n").alias("sn"))
    match = mode.where("rn > 0 AND sn > 0").agg(rate(F.col("rm") == F.col("sm")).alias("mode_match_rate"))
    return stack_reports(*[metric_rows(x, x.columns) for x in (means, quant, seen, match)])


def entity_time_error(both: DataFrame, entity: str, bucket: str, value: str, minimum: int = 2) -> DataFrame:
    """Cells with enough rows on both sides: real-weighted MAE of the cell means."""
    g = side_means(both, [entity, bucket], value).where((F.col("real_n") >= minimum) & (F.col("synthetic_n") >= minimum))
    gap = F.abs(F.col("real_mean") - F.col("synthetic_mean"))
    return g.agg(F.count(F.lit(1)).alias("cells"), F.try_divide(F.sum(gap * F.col("real_n")), F.sum("real_n")).alias("weighted_mae"))


ACTIVITY = {"1": (1, 1), "2-4": (2, 4), "5-9": (5, 9), "10+": (10, None)}


def entity_rating_metrics(both: DataFrame, entity: str, value: str, top: int = 1000) -> DataFrame:
    """(metric, value): entity mean MAE plain, weighted, of the top entities and by activity; TV and entropy gaps per entity."""
    g = side_means(both, [entity], value)
    common = g.where((F.col("real_n") > 0) & (F.col("synthetic_n") > 0)).withColumn("gap", F.abs(F.col("real_mean") - F.col("synthetic_mean")))
    parts = []
    one = common.agg(F.count(F.lit(1)).alias("common_entities"), F.avg("gap").alias("mean_mae"), F.try_divide(F.sum(F.col("gap") * F.col("real_n")), F.sum("real_n")).alias("weighted_mae"),
                     *[F.avg(F.when((F.col("real_n") >= lo) & (F.lit(True) if hi is None else F.col("real_n") <= hi), F.col("gap"))).alias(f"mae_activity_{n}") for n, (lo, hi) in ACTIVITY.items()])
    parts.append(metric_rows(one, one.columns))
    best = g.where("real_n > 0").orderBy(F.desc("real_n"), entity).limit(top).where("synthetic_n > 0").agg(F.avg(F.abs(F.col("real_mean") - F.col("synthetic_mean"))).alias("top_mae"))
    parts.append(metric_rows(best, best.columns))
    s = ts.shares(both, [value], [entity]).where("real_total > 0 AND synthetic_total > 0")
    ent = lambda c: -F.sum(F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c))).otherwise(0.0))
    per = s.groupBy(entity).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), F.abs(ent("p") - ent("q")).alias("e"))
    dist = per.agg(F.avg("tv").alias("distribution_tv_mean"), F.avg("e").alias("entropy_gap_mean"))
    return stack_reports(*parts, metric_rows(dist, dist.columns))


def trajectory_correlation(both: DataFrame, entity: str, ts_col: str, k: int = 20) -> DataFrame:
    """Mean correlation of monthly counts of the top real entities; months outside both ranges are not padded."""
    top = both.where("is_real").groupBy(entity).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), entity).limit(k).select(entity)
    m = F.floor(F.months_between(F.trunc(ts_col, "month"), F.lit("1970-01-01").cast("date"))).cast("int")
    c = both.join(top, entity, "left_semi").groupBy("is_real", entity, m.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    span = c.groupBy("is_real", entity).agg(F.min("m").alias("a"), F.max("m").alias("b"))
    # each side fills the gaps between its own first and last month, the union is filled with 0
    grid = span.select(entity, F.explode(F.sequence("a", "b")).alias("m")).distinct()
    wide = c.groupBy(entity, "m").agg(F.sum(on_side(True, F.col("n"))).alias("rn"), F.sum(on_side(False, F.col("n"))).alias("sn"))
    full = grid.join(wide, [entity, "m"], "left").na.fill(0, ["rn", "sn"])
    per = full.groupBy(entity).agg(guarded_corr(F.col("rn"), F.col("sn")).alias("corr"), F.max("sn").alias("any"))
    return per.where("any > 0").agg(F.avg("corr").alias("mean_corr"), F.count("corr").alias("entities"))


def tuple_copying(both: DataFrame, columns: Sequence[str], rare: int = 5) -> DataFrame:
    """Share of synthetic attribute tuples seen in training, and seen only rarely there; distinct tuples of both sides."""
    c = aligned_counts(both, list(columns))
    n = F.greatest(F.sum("synthetic_n"), F.lit(1))
    return c.agg((F.coalesce(F.sum(F.when(F.col("real_n") > 0, F.col("synthetic_n"))), F.lit(0)) / n).alias("exact_overlap_rate"),
                 (F.coalesce(F.sum(F.when(F.col("real_n").between(1, rare), F.col("synthetic_n"))), F.lit(0)) / n).alias("rare_overlap_rate"),
                 F.count_if(F.col("real_n") > 0).alias("real_tuples"), F.count_if(F.col("synthetic_n") > 0).alias("synthetic_tuples"))


def alignment(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows on both sides of an id join, and how many differ in the spine columns or lack a partner."""
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    m = a.join(b, key, "full")
    return m.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
                 F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


def probability_calibration(rows: DataFrame, logits: str, label: str, temperatures: Sequence[float], bins: int = 15) -> DataFrame:
    """Per temperature: negative log likelihood, accuracy, mean confidence, and expected calibration error. `label` is a class position from 0."""
    from chronoweave.functions.cleaning import softmax

    grid = rows.withColumn("temperature", F.explode(F.array(*[F.lit(float(x)) for x in temperatures])))
    scaled = grid.select("temperature", F.col(label).alias("y"), F.transform(logits, lambda v: v / F.col("temperature")).alias("l"))
    p = scaled.select("temperature", "y", softmax("l").alias("p")).select(
        "temperature", F.array_max("p").alias("conf"), F.get("p", F.col("y")).alias("py"), (F.array_position("p", F.array_max("p")) - 1 == F.col("y")).cast("double").alias("hit"))
    cell = p.groupBy("temperature", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), F.sum("hit").alias("h"), F.sum(F.ln(F.greatest("py", F.lit(1e-12)))).alias("ll"))
    n = F.sum("n")
    return cell.groupBy("temperature").agg((-F.sum("ll") / n).alias("nll"), (F.sum("h") / n).alias("accuracy"), (F.sum("c") / n).alias("mean_confidence"),
                                           (F.sum(F.abs(F.col("c") - F.col("h"))) / n).alias("ece"))


def grouped_standardized_error(rows: DataFrame, group: str, target: str, prediction: str, scale: float) -> DataFrame:
    """Row-weighted absolute gap of group means over a scale."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(target) - F.avg(prediction)).alias("e"))
    return g.agg((F.sum(F.col("e") * F.col("n")) / F.sum("n") / max(scale, 1e-12)).alias("weighted_error"))


def affinity_diagnostics(both: DataFrame, vectors: tuple[DataFrame, DataFrame], gate: str = "gate", alpha: float = 100.0, piece_rows: int = 2_000_000) -> DataFrame:
    """(metric, value): mean and median gated affinity of both sides, and the KS between their pair scores."""
    from chronoweave.functions.cleaning import array_sum
    from chronoweave.operators.priors import time_gates

    cv, pv = vectors
    def met(rows: DataFrame) -> DataFrame:
        return rows.join(cv.select("customer_id", F.col("vector").alias("u")), "customer_id").join(pv.select("product_id", F.col("vector").alias("v")), "product_id")

    def gates() -> DataFrame:
        found = time_gates(met(both.where("is_real")), gate, "u", "v", alpha)
        return found.groupBy(gate).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "weight"))), lambda x: x["weight"]).alias("w"))

    g = finished(gates)
    prod = F.zip_with("u", "v", lambda a, b: a * b)
    # a gate never fitted weighs every dimension alike
    gated = F.when(F.col("w").isNotNull(), F.zip_with(prod, "w", lambda a, b: a * b)).otherwise(prod)

    def score(rows: DataFrame) -> DataFrame:
        return met(rows).join(g, gate, "left").select("is_real", F.round(array_sum(gated), 12).alias("score"))

    # vectors are many times as wide as the rows: they join pieces of them, and only the scores are kept
    rows = finished(lambda: both.select("is_real", "customer_id", "product_id", gate))
    scored = finished(lambda: in_pieces(rows, ["customer_id", "product_id"], score, piece_rows))
    discard(rows)
    mean = scored.agg(F.avg(on_side(True, F.col("score"))).alias("mean_real"), F.avg(on_side(False, F.col("score"))).alias("mean_synthetic"))
    med = quantiles(scored, "score", {"m": 0.5}, ["is_real"]).select(F.when(F.col("is_real"), "median_real").otherwise("median_synthetic").alias("metric"), F.col("m").alias("value"))
    ks = ts.ks_distance(scored, "score", empty=0.0)
    return stack_reports(metric_rows(mean, mean.columns), med, metric_rows(ks, {"ks": F.col("ks")}))
