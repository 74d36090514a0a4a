"""Event-spine fidelity: the halves of the order lines against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import r6
from chronoweave.operators import counts as ct
from chronoweave.operators import spine_metrics as sm
from chronoweave.operators import two_sample as ts
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.tables import ACTIONS, BLOCK_MAPS, SPINE, Tables, corr_sql, r


def rounded(df):
    return df.select("metric", r6(F.col("value")).alias("value"))


def rounded_columns(df, keep=()):
    return df.select(*keep, *[r6(F.col(c)).alias(c) for c in df.columns if c not in keep])


BLOCKED = """blocked AS (SELECT spine.*, customer_block, product_block FROM spine JOIN cb USING (customer_id) JOIN pb USING (product_id))"""


def blocked(t: Tables):
    return ct.with_blocks(t.spine, t.customer_blocks, t.product_blocks)


def degree_sides_sql(entity: str) -> str:
    return f"""(SELECT is_real, degree FROM (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn
      FROM spine GROUP BY {entity}) c, LATERAL (SELECT unnest([true, false]) AS is_real, unnest([rn, sn]) AS degree) WHERE rn > 0)"""


DEGREE_BLOCKS = """dcb AS (SELECT customer_id, CAST(least(((row_number() OVER (ORDER BY n DESC, CAST(customer_id AS VARCHAR)) - 1) * 5)
  // count(*) OVER (), 4) AS INTEGER) AS customer_block FROM (SELECT customer_id, count(*) AS n FROM spine GROUP BY 1)),
dpb AS (SELECT product_id, CAST(least(((row_number() OVER (ORDER BY n DESC, CAST(product_id AS VARCHAR)) - 1) * 5)
  // count(*) OVER (), 4) AS INTEGER) AS product_block FROM (SELECT product_id, count(*) AS n FROM spine GROUP BY 1))"""


@query("I23 I16 I14 I10 J37", f"""WITH {SPINE}, {DEGREE_BLOCKS},
d AS (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY day),
bp AS (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn
  FROM spine JOIN dcb USING (customer_id) JOIN dpb USING (product_id) GROUP BY customer_block, product_block)
SELECT 'daily_count_l1' AS metric, {r('sum(abs(rn - sn)) / greatest(sum(rn), 1)')} AS value FROM d
UNION ALL SELECT 'customer_degree_ks', ks FROM ({sp.ks_sql(degree_sides_sql('customer_id'), 'degree')})
UNION ALL SELECT 'product_degree_ks', ks FROM ({sp.ks_sql(degree_sides_sql('product_id'), 'degree')})
UNION ALL SELECT 'block_pair_exact_match_rate', {r('avg(CASE WHEN rn = sn THEN 1.0 ELSE 0.0 END)')} FROM bp
UNION ALL SELECT 'block_pair_l1', {r('sum(abs(rn - sn)) / sum(rn)')} FROM bp""")
def spine_fidelity_slice(t: Tables):
    """Flagship: degree-quantile blocks, then day, degree and block-pair agreement of the two sides."""
    spine = t.spine.select("is_real", "customer_id", "product_id", "day")
    cb = ct.degree_quantile_blocks(spine, "customer_id", 5, "customer_block")
    pb = ct.degree_quantile_blocks(spine, "product_id", 5, "product_block")
    pairs = sm.block_pair_fidelity(ct.with_blocks(spine, cb, pb))
    return rounded(ts.stack_reports(
        ts.metric_rows(ts.series_agreement(spine, "day"), {"daily_count_l1": F.col("l1")}),
        ts.metric_rows(sm.degree_ks(spine, "customer_id"), {"customer_degree_ks": F.col("ks")}),
        ts.metric_rows(sm.degree_ks(spine, "product_id"), {"product_degree_ks": F.col("ks")}),
        ts.metric_rows(pairs, {"block_pair_exact_match_rate": F.col("exact_match_rate"), "block_pair_l1": F.col("l1_relative_error")}),
    ))


@query("J37", f"WITH {SPINE}, {DEGREE_BLOCKS} SELECT * FROM dcb")
def customer_degree_blocks(t: Tables):
    return ct.degree_quantile_blocks(t.spine, "customer_id", 5, "customer_block")


@query("I14", f"""WITH {SPINE} {sp.ks_sql('(SELECT is_real, count(*) AS degree FROM spine GROUP BY is_real, product_id)', 'degree')}""")
def own_side_degree_ks(t: Tables):
    return rounded_columns(sm.degree_ks(t.spine, "product_id", real_entities_only=False))


@query("I15", f"""WITH {SPINE} SELECT {r('avg(CASE WHEN rn = sn THEN 1.0 ELSE 0.0 END)')} AS exact_match_rate, count(*) AS entities
FROM (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY product_id)""")
def degree_exact_match_rate(t: Tables):
    return rounded_columns(sm.degree_exact_match(t.spine, "product_id"), ["entities"])


@query("C4 D4", f"""WITH {SPINE}, ev AS (SELECT customer_id, product_id, day, count(*) FILTER (WHERE is_real) AS rn,
  count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY ALL),
p AS (SELECT customer_id, product_id, sum(rn) AS rn, sum(sn) AS sn FROM ev GROUP BY ALL)
{sp.rows_sql('ev', {'exact_event_overlap_rate': r('coalesce(sum(sn) FILTER (WHERE rn > 0), 0) / sum(sn)')})} UNION ALL
{sp.rows_sql('p', {
    'real_edge_overlap_rate': r('coalesce(sum(sn) FILTER (WHERE rn > 0), 0) / sum(sn)'),
    'distinct_edge_overlap_rate': r('count(*) FILTER (WHERE rn > 0 AND sn > 0) / count(*) FILTER (WHERE sn > 0)'),
    'real_duplicate_rate': r('coalesce(sum(rn) FILTER (WHERE rn > 1), 0) / sum(rn)'),
    'synthetic_duplicate_rate': r('coalesce(sum(sn) FILTER (WHERE sn > 1), 0) / sum(sn)'),
    'duplicate_rate_ratio': r('(coalesce(sum(sn) FILTER (WHERE sn > 1), 0) / sum(sn)) / (sum(rn) FILTER (WHERE rn > 1) / sum(rn))')})}""")
def edge_and_event_overlap(t: Tables):
    return rounded(sm.overlap(t.spine))


@query("C5", f"""WITH {SPINE} SELECT {r('sum(least(rn, sn)) / sum(sn)')} AS overlap_rate, bool_and(rn = sn) AS exact_match FROM
(SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY day)""")
def timestamp_multiset_overlap(t: Tables):
    out = sm.multiset_overlap(t.spine, ["day"])
    return out.select(r6(F.col("overlap_rate")).alias("overlap_rate"), "exact_match")


def pair_fidelity_sql(keys: str) -> str:
    return f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT {r('avg(CASE WHEN rn = sn THEN 1.0 ELSE 0.0 END)')} AS exact_match_rate,
count(*) FILTER (WHERE rn > 0) AS pairs_real, count(*) FILTER (WHERE sn > 0) AS pairs_synthetic, count(*) AS pairs_union,
CAST(sum(abs(rn - sn)) AS BIGINT) AS abs_error_sum, max(abs(rn - sn)) AS max_abs_error, {r('sum(abs(rn - sn)) / sum(rn)')} AS l1_relative_error
FROM (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM blocked GROUP BY {keys})"""


def _pair_fidelity(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("exact_match_rate", "l1_relative_error")})


@query("I16 C1 A10", pair_fidelity_sql("customer_block, product_block"))
def block_pair_count_fidelity(t: Tables):
    return _pair_fidelity(sm.block_pair_fidelity(blocked(t)))


@query("I16 D6", pair_fidelity_sql("customer_block, product_block, day"))
def block_pair_day_count_fidelity(t: Tables):
    return _pair_fidelity(sm.block_pair_fidelity(blocked(t), with_time=True))


@query("I17", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED},
per AS (SELECT customer_block, product_block, max(abs(cr - cs)) AS ks, max(rt) AS rn, max(st) AS sn
FROM {sp.cdf_sql('(SELECT *, epoch_us(ts) AS t FROM blocked)', 't', ['customer_block', 'product_block'])} GROUP BY 1, 2)
{sp.rows_sql('per', {'mean': r('avg(ks) FILTER (WHERE rn >= 5 AND sn >= 5)'),
    'weighted_mean': r('sum(ks * rn) FILTER (WHERE rn >= 5 AND sn >= 5) / sum(rn) FILTER (WHERE rn >= 5 AND sn >= 5)'),
    'pairs': 'count(*) FILTER (WHERE rn >= 5 AND sn >= 5)', 'skipped': 'count(*) FILTER (WHERE NOT (rn >= 5 AND sn >= 5))',
    'median': r('quantile_cont(ks, 0.5) FILTER (WHERE rn >= 5 AND sn >= 5)')})}""")
def block_pair_timestamp_ks(t: Tables):
    return rounded(sm.block_pair_time_ks(blocked(t), "ts"))


@query("I18", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT {r('avg(l1)')} AS mean_l1, {r('sum(l1 * rn) / sum(rn)')} AS weighted_l1,
count(*) AS pairs FROM (SELECT sum(abs(rn - sn)) / sum(rn) AS l1, sum(rn) AS rn FROM (SELECT customer_block, product_block, day,
count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM blocked GROUP BY ALL)
GROUP BY customer_block, product_block HAVING sum(rn) > 0 AND sum(sn) > 0)""")
def block_pair_daily_l1(t: Tables):
    return rounded_columns(sm.block_pair_date_l1(blocked(t)), ["pairs"])


LIFE = """life AS (SELECT is_real, {e} AS e, min(d) AS first, max(d) AS last, max_by(d, n * 10000000 - d) AS peak,
  max(d) - min(d) AS span, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy
  FROM (SELECT is_real, {e}, day - DATE '0001-01-01' + 1 AS d, count(*) AS n FROM spine GROUP BY ALL) GROUP BY ALL)"""


def lifecycle_sql(entity: str) -> str:
    return f"""{LIFE.format(e=entity)}, wide AS (SELECT a.first AS fr, b.first AS fs, a.last AS lr, b.last AS ls, a.peak AS pr, b.peak AS ps
  FROM life a JOIN life b ON a.e = b.e AND a.is_real AND NOT b.is_real),
lrows AS (SELECT is_real, 'active_span_ks' AS metric, CAST(span AS DOUBLE) AS v FROM life UNION ALL
  SELECT is_real, 'activity_entropy_ks', round(entropy, 9) + 0.0 FROM life UNION ALL
  SELECT is_real, 'time_activity_distribution_ks', n / sum(n) OVER (PARTITION BY is_real, {entity})
  FROM (SELECT is_real, {entity}, day, count(*) AS n FROM spine GROUP BY ALL)),
lifecycle_report AS ({sp.rows_sql('wide', {'first_time_corr': r(corr_sql('fr', 'fs')), 'last_time_corr': r(corr_sql('lr', 'ls')),
                                           'peak_time_corr': r(corr_sql('pr', 'ps'))})}
  UNION ALL {sp.ks_sql('lrows', 'v', ['metric'], 'value', '0.0')})"""


@query("I19 D10", f"WITH {SPINE}, {lifecycle_sql('product_id')} SELECT * FROM lifecycle_report")
def product_lifecycle_fidelity(t: Tables):
    return rounded(sm.lifecycle_fidelity(t.spine, "product_id"))


@query("D10", f"""WITH {SPINE}, {LIFE.format(e='customer_id')} SELECT e AS customer_id, first, last, peak, span, {r('entropy')} AS entropy
FROM life WHERE is_real""")
def customer_lifecycle(t: Tables):
    out = ct.lifecycle(t.real, "customer_id")
    return out.select("customer_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "peak", "span")], r6(F.col("entropy")).alias("entropy"))


WINDOWS = """cw AS (SELECT customer_id, min(day) AS cf, max(day) AS cl FROM real GROUP BY 1),
pw AS (SELECT product_id, min(day) AS pf, max(day) AS pl FROM real GROUP BY 1)"""


@query("I20", f"""WITH {SPINE}, {WINDOWS} SELECT {r('avg(c)')} AS customer_rate, {r('avg(p)')} AS product_rate, {r('avg(c * p)')} AS joint_rate
FROM (SELECT CASE WHEN day BETWEEN cf - 30 AND cl + 30 THEN 1.0 ELSE 0.0 END AS c,
CASE WHEN day BETWEEN pf - 30 AND pl + 30 THEN 1.0 ELSE 0.0 END AS p
FROM synthetic LEFT JOIN cw USING (customer_id) LEFT JOIN pw USING (product_id))""")
def coactive_window_rates(t: Tables):
    return rounded_columns(sm.coactivity(t.real, t.synthetic))


@query("I21", f"""WITH {SPINE}, {WINDOWS}, aged AS (SELECT is_real, coalesce(round((day - pf) / greatest(pl - pf, 1), 12), 0) AS age
FROM spine LEFT JOIN pw USING (product_id))
SELECT 'relative_age_ks' AS metric, ks AS value FROM ({sp.ks_sql('aged', 'age', empty='0.0')}) UNION ALL
SELECT 'relative_age_mean_diff', {r('avg(age) FILTER (WHERE NOT is_real) - avg(age) FILTER (WHERE is_real)')} FROM aged""")
def product_relative_age(t: Tables):
    return rounded(sm.relative_age_metrics(t.spine, "product_id"))


@query("I22", f"""WITH {ACTIONS}, parts AS (SELECT is_real, 'hour' AS part, hour(ts) AS item FROM actions UNION ALL
SELECT is_real, 'weekday', isodow(ts) - 1 FROM actions) {sp.tv_sql('parts', ['item'], ['part'])}""")
def clock_total_variation(t: Tables):
    return rounded_columns(sm.clock_distances(t.actions, "ts"), ["part"])


@query("I13 D12", f"""WITH {ACTIONS}, st AS (SELECT is_real, user_id, min(t) AS first, max(t) AS last, max(t) - min(t) AS w,
CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END AS gap, count(*) OVER (PARTITION BY user_id) AS sides
FROM (SELECT is_real, user_id, epoch_us(ts) / 86400e6 AS t FROM actions) GROUP BY is_real, user_id),
rows AS (SELECT is_real, 'mean_gap' AS "column", gap AS value FROM st UNION ALL SELECT is_real, 'window', w FROM st WHERE sides = 2
UNION ALL SELECT is_real, 'first', first FROM st WHERE sides = 2 UNION ALL SELECT is_real, 'last', last FROM st WHERE sides = 2)
{sp.ks_sql('rows', 'value', ['"column"'])}""")
def user_time_ks(t: Tables):
    out = sm.entity_time_ks(t.actions, "user_id", "ts")
    return out.select("column", r6(F.col("ks")).alias("ks"))


@query("D12", f"""SELECT user_id, {r('min(t)')} AS first, {r('max(t)')} AS last, {r('max(t) - min(t)')} AS "window",
{r('CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END')} AS mean_gap, count(*) AS events
FROM (SELECT user_id, epoch_us(ts) / 86400e6 AS t FROM events) GROUP BY user_id""")
def user_time_stats(t: Tables):
    return rounded_columns(ct.entity_time_stats(t.actions, "user_id", "ts"), ["user_id", "events"])


@query("E6", f"""SELECT user_id, count(*) AS gaps, {r('avg(gap)')} AS mean_gap, {r('max(gap)')} AS max_gap, {r('min(gap)')} AS min_gap FROM
(SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400e6 AS gap FROM events)
WHERE gap IS NOT NULL GROUP BY user_id""")
def user_inter_event_gaps(t: Tables):
    gaps = ct.inter_event_gaps(t.actions, "user_id", "ts", ["event_id"])
    return gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("gaps"), r6(F.avg("gap")).alias("mean_gap"), r6(F.max("gap")).alias("max_gap"), r6(F.min("gap")).alias("min_gap"))


@query("I24 G4", f"""WITH {SPINE}, cd AS (SELECT is_real, count(*) AS d FROM spine GROUP BY is_real, customer_id),
pd AS (SELECT is_real, count(*) AS d FROM spine GROUP BY is_real, product_id),
f AS (SELECT 'customer_degrees' AS item, bool_and(rn = sn) AS exact FROM (SELECT count(*) FILTER (WHERE is_real) AS rn,
count(*) FILTER (WHERE NOT is_real) AS sn FROM cd GROUP BY d) UNION ALL
SELECT 'product_degrees', bool_and(rn = sn) FROM (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM pd GROUP BY d)
UNION ALL SELECT 'timestamps', bool_and(rn = sn) FROM (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY day))
SELECT *, CASE WHEN exact THEN 'preserved exactly' ELSE 'learned' END AS label FROM f UNION ALL
SELECT 'blocks_not_trivial', true, 'block structure used'""")
def preservation_flags(t: Tables):
    return sm.preservation_audit(blocked(t))


@query("I23", f"""WITH {SPINE}, {BLOCK_MAPS}, {WINDOWS},
ev AS (SELECT customer_id, product_id, day, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY ALL),
p AS (SELECT customer_id, product_id, sum(rn) AS rn, sum(sn) AS sn FROM ev GROUP BY ALL),
{lifecycle_sql('customer_id')},
co AS (SELECT CASE WHEN day BETWEEN cf - 30 AND cl + 30 THEN 1.0 ELSE 0.0 END AS c,
  CASE WHEN day BETWEEN pf - 30 AND pl + 30 THEN 1.0 ELSE 0.0 END AS p FROM synthetic LEFT JOIN cw USING (customer_id) LEFT JOIN pw USING (product_id))
SELECT 'customer_' || metric AS metric, value FROM lifecycle_report
UNION ALL SELECT 'customer_degree_ks', ks FROM ({sp.ks_sql(degree_sides_sql('customer_id'), 'degree')})
UNION ALL SELECT 'product_degree_ks', ks FROM ({sp.ks_sql(degree_sides_sql('product_id'), 'degree')})
UNION ALL SELECT 'exact_event_overlap_rate', {r('coalesce(sum(sn) FILTER (WHERE rn > 0), 0) / sum(sn)')} FROM ev
UNION ALL SELECT 'real_edge_overlap_rate', {r('coalesce(sum(sn) FILTER (WHERE rn > 0), 0) / sum(sn)')} FROM p
UNION ALL SELECT 'coactive_joint_rate', {r('avg(c * p)')} FROM co
UNION ALL {sp.rows_sql('spine', {f'active_{n}_{s}': f"count(DISTINCT {c}) FILTER (WHERE {w})" for c, n in (('customer_id', 'customers'), ('product_id', 'products')) for s, w in (('real', 'is_real'), ('synthetic', 'NOT is_real'))})}
UNION ALL SELECT 'daily_count_l1', {r('sum(abs(rn - sn)) / sum(rn)')} FROM (SELECT sum(rn) AS rn, sum(sn) AS sn FROM ev GROUP BY day)
UNION ALL SELECT 'daily_count_corr', {r(corr_sql('rn', 'sn'))} FROM (SELECT sum(rn) AS rn, sum(sn) AS sn FROM ev GROUP BY day)
UNION ALL SELECT 'block_pair_count_exact_match_rate', {r('avg(CASE WHEN rn = sn THEN 1.0 ELSE 0.0 END)')} FROM (SELECT sum(rn) AS rn, sum(sn) AS sn
  FROM ev JOIN cb USING (customer_id) JOIN pb USING (product_id) GROUP BY customer_block, product_block)""")
def spine_report(t: Tables):
    twin = ["customer_first_time_corr", "customer_last_time_corr", "customer_peak_time_corr", "customer_active_span_ks",
            "customer_activity_entropy_ks", "customer_time_activity_distribution_ks", "customer_degree_ks", "product_degree_ks",
            "exact_event_overlap_rate", "real_edge_overlap_rate", "coactive_joint_rate", "active_customers_real",
            "active_customers_synthetic", "active_products_real", "active_products_synthetic", "daily_count_l1", "daily_count_corr",
            "block_pair_count_exact_match_rate"]
    return rounded(sm.spine_report(t.spine, t.customer_blocks, t.product_blocks).where(F.col("metric").isin(twin)))
