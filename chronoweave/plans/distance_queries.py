"""Two-sample distances on the two halves of the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import aligned_counts, r6
from chronoweave.operators import two_sample as ts
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.tables import ACTIONS, SPINE, Tables, corr_sql, r

NUMERIC = ["rating", "quantity", "price", "discount"]
LONG = f"long AS ({sp.melt_sql('spine', NUMERIC)})"
CATEGORICAL = ["flag", "status", "priority"]
CLONG = "clong AS (" + " UNION ALL ".join(
    f"SELECT is_real, '{c}' AS \"column\", {c} AS item FROM spine" for c in CATEGORICAL) + ")"


def categories(t: Tables):
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("item")) for c in CATEGORICAL])
    return t.spine.select("is_real", F.inline(cells))


@query("I1", f"""WITH {SPINE}, {LONG} {sp.ks_sql('long', 'value', ['"column"'])}""")
def column_ks(t: Tables):
    return ts.ks_distance(ts.melt(t.spine, NUMERIC), "value", ["column"]).select("column", r6(F.col("ks")).alias("ks"))


@query("I1", f"WITH {ACTIONS} {sp.ks_sql('actions', 'value', ['event_type'])}")
def action_value_ks(t: Tables):
    return ts.ks_distance(t.actions, "value", ["event_type"]).select("event_type", r6(F.col("ks")).alias("ks"))


@query("I2", f"""WITH {SPINE}, {CLONG} {sp.tv_sql('clong', ['item'], ['"column"'])}""")
def category_total_variation(t: Tables):
    return ts.total_variation(categories(t), ["item"], ["column"]).select("column", r6(F.col("tv")).alias("tv"))


@query("I2", f"""WITH {SPINE} SELECT {r('sum(abs(p - q)) / 2')} AS tv FROM {sp.shares_sql('spine', ['rating'])}
WHERE rating BETWEEN 1 AND 5""")
def fixed_support_total_variation(t: Tables):
    return ts.total_variation(t.spine, ["rating"], support=[1, 2, 3, 4, 5]).select(r6(F.col("tv")).alias("tv"))


HALF = "coalesce(CASE WHEN p > 0 THEN p * {f}(p / ((p + q) / 2)) END, 0) + coalesce(CASE WHEN q > 0 THEN q * {f}(q / ((p + q) / 2)) END, 0)"


@query("I3", f"""WITH {SPINE}, {CLONG} SELECT "column", {r(f"sum({HALF.format(f='ln')}) / 2")} AS js_ln,
{r(f"sum({HALF.format(f='log2')}) / 2")} AS js_log2,
{r(f"sqrt(greatest(sum({HALF.format(f='log2')}) / 2, 0))")} AS js_distance
FROM {sp.shares_sql('clong', ['item'], ['"column"'])} GROUP BY "column" """)
def category_jensen_shannon(t: Tables):
    out = ts.jensen_shannon(categories(t), ["item"], ["column"])
    return out.select("column", *[r6(F.col(c)).alias(c) for c in ("js_ln", "js_log2", "js_distance")])


@query("I4", f"""WITH {SPINE}, {LONG}, {sp.grid_ranked_cte('long', 'value', ['"column"'])}
{sp.grid_sql('long', 'value', ['"column"'])}""")
def column_quantile_wasserstein(t: Tables):
    both = ts.melt(t.spine, NUMERIC, ["is_real", "event_id"])
    return ts.grid_distance(both, "value", ["event_id"], ["column"]).select("column", r6(F.col("wasserstein")).alias("wasserstein"))


@query("I4", f"""WITH {SPINE}, {LONG} {sp.area_sql('long', 'value', ['"column"'])}""")
def column_area_wasserstein(t: Tables):
    out = ts.area_distance(ts.melt(t.spine, NUMERIC), "value", ["column"])
    return out.select("column", r6(F.col("wasserstein")).alias("wasserstein"))


@query("I5", f"""WITH {SPINE} SELECT {r('sum(p * (ln(p + 1e-12) - ln(q + 1e-12)))')} AS kl_real_synthetic,
{r('sum(q * (ln(q + 1e-12) - ln(p + 1e-12)))')} AS kl_synthetic_real FROM {sp.shares_sql('spine', ['quantity'])}""")
def quantity_kl(t: Tables):
    return ts.kl_divergence(t.spine, ["quantity"]).select(*[r6(F.col(c)).alias(c) for c in ("kl_real_synthetic", "kl_synthetic_real")])


@query("I6", f"""WITH {SPINE} SELECT is_real, {r(corr_sql('quantity', 'price'))} AS quantity_price,
{r(corr_sql('rating', 'discount'))} AS rating_discount, CAST(NULL AS DOUBLE) AS constant_price FROM spine GROUP BY is_real""")
def guarded_correlations(t: Tables):
    from chronoweave.functions.kernels import guarded_corr

    return t.spine.groupBy("is_real").agg(
        r6(guarded_corr(F.col("quantity"), F.col("price"))).alias("quantity_price"),
        r6(guarded_corr(F.col("rating"), F.col("discount"))).alias("rating_discount"),
        r6(guarded_corr(F.lit(1.0), F.col("price"))).alias("constant_price"),
    )


@query("C6", f"""WITH {SPINE} SELECT coalesce(a.day, b.day) AS day, coalesce(rn, 0) AS real_n, coalesce(sn, 0) AS synthetic_n
FROM (SELECT day, count(*) AS rn FROM real GROUP BY day) a FULL JOIN (SELECT day, count(*) AS sn FROM synthetic GROUP BY day) b
ON a.day = b.day""")
def aligned_daily_series(t: Tables):
    return aligned_counts(t.spine, ["day"])


@query("I10 D5", f"""WITH {SPINE}, d AS (SELECT day AS k, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn
FROM spine GROUP BY 1), m AS (SELECT strftime(day, '%Y-%m') AS k, count(*) FILTER (WHERE is_real) AS rn,
count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY 1)
SELECT 'daily' AS period, {r(corr_sql('rn', 'sn'))} AS corr, {r('sum(abs(rn - sn)) / greatest(sum(rn), 1)')} AS l1,
{r('avg(abs(rn - sn))')} AS mae, count(*) AS keys FROM d UNION ALL
SELECT 'monthly', {r(corr_sql('rn', 'sn'))}, {r('sum(abs(rn - sn)) / greatest(sum(rn), 1)')},
{r('avg(abs(rn - sn))')}, count(*) FROM m""")
def period_count_agreement(t: Tables):
    parts = []
    for period, key in (("daily", F.col("day").cast("string")), ("monthly", F.date_format("ts", "yyyy-MM"))):
        s = ts.series_agreement(t.spine.select("is_real", key.alias("k")), "k")
        parts.append(s.select(F.lit(period).alias("period"), *[r6(F.col(c)).alias(c) for c in ("corr", "l1", "mae")], "keys"))
    return ts.stack_reports(*parts)
