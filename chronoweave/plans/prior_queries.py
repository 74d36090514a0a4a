"""Priors, effects, activity, bandwidths and numeric supports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import r6
from chronoweave.operators import priors as pr
from chronoweave.operators import supports as su
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import BLOCKED, blocked, rounded, rounded_columns
from chronoweave.plans.tables import ACTIONS, BLOCK_MAPS, SPINE, Tables, r, unit_sql

CLASSES = ["1", "2", "3", "4", "5", "6", "7"]


def prior_sql(src: str, key: str, alpha: str, name: str = "pri") -> str:
    """Rows (key, class, n, p, gp, fr, gr)."""
    return f"""{name}_g AS (SELECT CAST(rating AS VARCHAR) AS class, count(*) / sum(count(*)) OVER () AS gp FROM {src} GROUP BY 1),
{name}_r AS (SELECT avg(verified) AS gr FROM {src}), {name}_n AS (SELECT {key}, count(*) AS n, sum(verified) AS f FROM {src} GROUP BY ALL),
{name}_c AS (SELECT {key}, CAST(rating AS VARCHAR) AS class, count(*) AS c FROM {src} GROUP BY ALL),
{name} AS (SELECT {key}, class, n, (coalesce(c, 0) + {alpha} * gp) / (n + {alpha}) AS p, gp, (f + {alpha} * gr) / (n + {alpha}) AS fr, gr
  FROM {name}_n CROSS JOIN {name}_g CROSS JOIN {name}_r LEFT JOIN {name}_c USING ({key}, class))"""


AUTO = "greatest(20, sqrt(n))"


@query("D13", f"""WITH {SPINE}, m AS (SELECT *, strftime(ts, '%Y-%m') AS bucket FROM spine), {prior_sql('m', 'bucket', AUTO)}
SELECT bucket, class, n, {r('p')} AS p, {r('fr')} AS flag_rate FROM pri""")
def monthly_rating_prior(t: Tables):
    m = t.spine.withColumn("bucket", F.date_format("ts", "yyyy-MM"))
    out = pr.grouped_class_prior(m, ["bucket"], "rating", "verified", CLASSES)
    return out.select("bucket", "class", "n", r6(F.col("p")).alias("p"), r6(F.col("flag_rate")).alias("flag_rate"))


def residual_sql(name: str, key: str) -> str:
    clip = lambda x: f"least(greatest({x}, 1e-4), 1 - 1e-4)"
    lg = lambda x: f"ln({clip(x)} / (1 - {clip(x)}))"
    return f"""{name}_res AS (SELECT {key}, class, ln(p + 1e-8) - ln(gp + 1e-8) - avg(ln(p + 1e-8) - ln(gp + 1e-8)) OVER (PARTITION BY {key}) AS residual,
{lg('fr')} - {lg('gr')} AS flag_residual FROM {name})"""


@query("D14 C15", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, t AS (SELECT * FROM blocked WHERE customer_block < 3 AND product_block < 4),
{prior_sql('t', 'customer_block, product_block', '20.0', 'a')}, {prior_sql('t', 'product_block', '20.0', 'b')}, {prior_sql('t', 'customer_block', '20.0', 'c')},
{residual_sql('a', 'customer_block, product_block')}, {residual_sql('b', 'product_block')}, {residual_sql('c', 'customer_block')},
q AS (SELECT DISTINCT customer_block, product_block, class FROM blocked, (SELECT unnest(['1', '2', '3', '4', '5', '6', '7']) AS class))
SELECT q.customer_block, q.product_block, q.class, CASE WHEN x.residual IS NOT NULL THEN 'pair' WHEN y.residual IS NOT NULL THEN 'product_block'
WHEN z.residual IS NOT NULL THEN 'customer_block' ELSE 'global' END AS source_level, {r('coalesce(x.residual, y.residual, z.residual, 0)')} AS residual,
{r('coalesce(x.flag_residual, y.flag_residual, z.flag_residual, 0)')} AS flag_residual
FROM q LEFT JOIN a_res x USING (customer_block, product_block, class) LEFT JOIN b_res y ON y.product_block = q.product_block AND y.class = q.class
LEFT JOIN c_res z ON z.customer_block = q.customer_block AND z.class = q.class""")
def block_residuals_with_fallback(t: Tables):
    """Fitted on part of the blocks, looked up for all: pair, then product block, then customer block, then 0."""
    b = blocked(t)
    train = b.where("customer_block < 3 AND product_block < 4")
    levels = []
    for name, keys in (("pair", ["customer_block", "product_block"]), ("product_block", ["product_block"]), ("customer_block", ["customer_block"])):
        res = pr.residuals(pr.grouped_class_prior(train, keys, "rating", "verified", CLASSES, 20.0), keys)
        levels.append((name, res, [*keys, "class"]))
    grid = b.select("customer_block", "product_block").distinct().withColumn("class", F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    out = pr.first_level(grid, levels, ["residual", "flag_residual"], {"residual": 0.0, "flag_residual": 0.0})
    return rounded_columns(out, ["customer_block", "product_block", "class", "source_level"])


MEDIAN = "(SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM spine GROUP BY {e}))"


@query("D15", f"""WITH {SPINE}, g AS (SELECT product_id, count(*) AS n, avg(rating) AS m, least(greatest(avg(verified), 1e-4), 1 - 1e-4) AS f FROM spine GROUP BY 1),
o AS (SELECT avg(rating) AS gm, least(greatest(avg(verified), 1e-4), 1 - 1e-4) AS gf, {MEDIAN.format(e='product_id')} AS a FROM spine)
SELECT product_id, n, {r('n / (n + a) * (m - gm)')} AS value_effect, {r('n / (n + a) * (ln(f / (1 - f)) - ln(gf / (1 - gf)))')} AS flag_effect FROM g, o""")
def product_shrunk_effects(t: Tables):
    return rounded_columns(pr.entity_effects(t.spine, "product_id", "rating", "verified"), ["product_id", "n"])


@query("D16 H19", f"""WITH {SPINE}, {prior_sql('spine', 'product_id', '30.0')}, {residual_sql('pri', 'product_id')}
SELECT product_id, {r('max(residual) FILTER (WHERE class = ' + "'1')")} AS first_class, {r('max(residual) FILTER (WHERE class = ' + "'7')")} AS last_class,
{r('sqrt(sum(residual * residual))')} AS norm, {r('max(flag_residual)')} AS flag_effect FROM pri_res GROUP BY product_id""")
def product_vector_effects(t: Tables):
    from chronoweave.functions.cleaning import norm

    v = pr.vector_effects(t.spine, "product_id", "rating", "verified", CLASSES, 30.0)
    return v.select("product_id", r6(F.col("effects")[0]).alias("first_class"), r6(F.col("effects")[6]).alias("last_class"),
                    r6(norm("effects")).alias("norm"), r6(F.col("flag_effect")).alias("flag_effect"))


@query("D17", f"""WITH {SPINE}, {BLOCK_MAPS}, g AS (SELECT product_id, count(*) AS degree, avg(rating) AS x, avg(quantity) AS y FROM spine GROUP BY 1),
e AS (SELECT list_sort(list_distinct(quantile_cont(degree, [0.25, 0.5, 0.75]))) AS edges FROM g),
b AS (SELECT product_block AS block, 'q' || CAST(len(list_filter(edges, lambda z: z <= degree)) AS VARCHAR) AS degree_bin, x, y FROM g JOIN pb USING (product_id), e),
c AS (SELECT CASE grouping(block) * 2 + grouping(degree_bin) WHEN 0 THEN 'cell' WHEN 1 THEN 'block' WHEN 2 THEN 'degree_bin' ELSE 'global' END AS level, block, degree_bin,
count(*) AS entities, avg(x) AS mean_x, avg(y) AS mean_y, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(y, y) AS yy FROM b GROUP BY GROUPING SETS ((block, degree_bin), (block), (degree_bin), ()))
SELECT level, block, degree_bin, entities, {r('mean_x')} AS mean_x, {r('mean_y')} AS mean_y, {r('xx + 1e-6')} AS cov_xx, {r('xy * 0.9')} AS cov_xy, {r('yy + 1e-6')} AS cov_yy
FROM c WHERE entities >= 20 OR level = 'global'""")
def gaussian_effect_cells(t: Tables):
    g = t.spine.groupBy("product_id").agg(F.count(F.lit(1)).alias("degree"), F.avg("rating").alias("x"), F.avg("quantity").alias("y")).join(t.product_blocks, "product_id")
    return rounded_columns(pr.gaussian_cells(g, "product_block", "degree", "x", "y"), ["level", "block", "degree_bin", "entities"])


ACTIVITY = f"""ec AS (SELECT customer_id, day, count(*) AS n FROM spine GROUP BY customer_id, day), ed AS (SELECT *, sum(n) OVER (PARTITION BY customer_id) AS degree FROM ec),
am AS (SELECT {MEDIAN.format(e='customer_id')} AS a), bd AS (SELECT customer_block, day, sum(n) AS bn FROM ed JOIN cb USING (customer_id) GROUP BY ALL),
gd AS (SELECT day, sum(bn) AS gn FROM bd GROUP BY 1), bt AS (SELECT customer_block, sum(bn) AS bt FROM bd GROUP BY 1),
bp AS (SELECT customer_block, day, (coalesce(bn, 0) + 5 * gn / (SELECT sum(gn) FROM gd)) / (bt + 5) AS p FROM gd CROSS JOIN bt LEFT JOIN bd USING (customer_block, day))"""


@query("D18", f"""WITH {SPINE}, {BLOCK_MAPS}, {ACTIVITY} SELECT customer_id, day, {r('greatest(degree / (degree + a) * n / degree + (1 - degree / (degree + a)) * p, 1e-12)', 9)} AS probability
FROM ed JOIN cb USING (customer_id) JOIN bp USING (customer_block, day), am""")
def customer_activity_probability(t: Tables):
    own, model = pr.activity_model(t.spine, "customer_id", "day", t.customer_blocks, "customer_block")
    pairs = t.spine.select("customer_id", "day").distinct()
    out = pr.activity_probability(pairs, own, model, "customer_id", "day", "customer_block")
    return out.select("customer_id", "day", r6(F.col("probability"), 9).alias("probability"))


@query("D18", f"""WITH {SPINE}, {BLOCK_MAPS}, {ACTIVITY} SELECT customer_block, day, {r('sum(p) OVER (PARTITION BY customer_block ORDER BY day)')} AS cdf FROM bp""")
def block_activity_cdf(t: Tables):
    _, model = pr.activity_model(t.spine, "customer_id", "day", t.customer_blocks, "customer_block")
    return model.select("customer_block", "day", r6(F.col("cdf")).alias("cdf"))


@query("D19", f"""WITH {SPINE}, {BLOCK_MAPS}, d AS (SELECT customer_id, count(*) AS degree, min_by(event_id, (CAST('0x' || substr(md5('42|' || event_id), 1, 13) AS BIGINT), event_id)) AS held FROM spine GROUP BY 1),
k AS (SELECT customer_id, customer_block, day, event_id = held AND degree >= 2 AS h FROM spine JOIN cb USING (customer_id) JOIN d USING (customer_id)),
o AS (SELECT customer_id, day, count(*) AS c FROM k WHERE NOT h GROUP BY ALL), s AS (SELECT customer_id, count(*) AS d FROM k WHERE NOT h GROUP BY ALL),
bt AS (SELECT customer_block, day, count(*) AS bc FROM k WHERE NOT h GROUP BY ALL), bs AS (SELECT customer_block, count(*) AS bd FROM k WHERE NOT h GROUP BY ALL)
SELECT alpha, {r("avg(ln(greatest(coalesce(d, 0) / (coalesce(d, 0) + alpha) * coalesce(c / d, 0) + (1 - coalesce(d, 0) / (coalesce(d, 0) + alpha)) * coalesce(bc / bd, 0), 1e-12)))")} AS avg_log_likelihood, count(*) AS events
FROM (SELECT customer_id, customer_block, day FROM k WHERE h) LEFT JOIN o USING (customer_id, day) LEFT JOIN s USING (customer_id) LEFT JOIN bt USING (customer_block, day) LEFT JOIN bs USING (customer_block),
(SELECT unnest([1.0::DOUBLE, 5.0, 20.0, 100.0]) AS alpha) GROUP BY alpha""")
def shrinkage_by_holdout(t: Tables):
    out = pr.shrinkage_by_holdout(t.spine, "customer_id", "event_id", "day", t.customer_blocks, "customer_block", [1.0, 5.0, 20.0, 100.0])
    return rounded_columns(out, ["alpha", "events"])


@query("D20", f"""WITH {SPINE}, {BLOCK_MAPS}, g AS (SELECT customer_id, CAST(day - lag(day) OVER (PARTITION BY customer_id ORDER BY day, event_id) AS DOUBLE) AS gap FROM spine),
raw AS (SELECT CASE WHEN quantile_cont(gap, 0.75) > quantile_cont(gap, 0.25) THEN quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) WHEN quantile_cont(gap, 0.5) > 0 THEN quantile_cont(gap, 0.5) ELSE 28 END AS raw FROM g WHERE gap IS NOT NULL),
b AS (SELECT customer_block, greatest(0.25 * (CASE WHEN quantile_cont(gap, 0.75) > quantile_cont(gap, 0.25) THEN quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) WHEN quantile_cont(gap, 0.5) > 0 THEN quantile_cont(gap, 0.5) ELSE max(raw) END), 1) AS bw
  FROM g JOIN cb USING (customer_id), raw WHERE gap IS NOT NULL GROUP BY 1),
e AS (SELECT customer_id, count(*) AS n, quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) AS iqr, quantile_cont(gap, 0.5) AS med FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT m.customer_id, customer_block, {r('CASE WHEN n >= 2 THEN greatest(0.25 * (CASE WHEN iqr > 0 THEN iqr WHEN med > 0 THEN med ELSE bw / 0.25 END), 1) ELSE bw END')} AS bandwidth,
CASE WHEN n >= 2 THEN 'entity' ELSE 'block' END AS source FROM (SELECT DISTINCT customer_id FROM spine) m JOIN cb USING (customer_id) JOIN b USING (customer_block) LEFT JOIN e USING (customer_id)""")
def customer_gap_bandwidths(t: Tables):
    out = pr.gap_bandwidths(t.spine, "customer_id", "day", ["event_id"], t.customer_blocks, "customer_block")
    return out.select("customer_id", "customer_block", r6(F.col("bandwidth")).alias("bandwidth"), "source")


@query("D21", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, l AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM spine), x AS (SELECT customer_block, product_block, (epoch_us(ts) - lo) / (hi - lo) AS x FROM blocked, l)
SELECT customer_block, product_block, count(*) AS n, {r('CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-4 THEN greatest(0.9 * stddev_pop(x) * pow(count(*), -0.2), 1e-4) ELSE 0.05 END')} AS bandwidth FROM x GROUP BY ALL""")
def block_pair_kde_bandwidths(t: Tables):
    from chronoweave.operators.clean import normalized_time

    b = blocked(t)
    out = pr.kde_bandwidths(normalized_time(b, "ts", b, "x"), ["customer_block", "product_block"], "x", silverman=True)
    return rounded_columns(out, ["customer_block", "product_block", "n"])


@query("D22", f"""WITH {SPINE}, v AS (SELECT strftime(ts, '%Y-%m') AS gate, unnest([0, 1, 2]) AS dim, unnest([rating * quantity / 10.0, verified * discount, 1.0 * price / 1000]) AS x FROM spine),
o AS (SELECT dim, avg(x) AS overall FROM v GROUP BY 1), g AS (SELECT gate, dim, count(*) / (count(*) + 100) * avg(x) + (1 - count(*) / (count(*) + 100)) * max(overall) AS g FROM v JOIN o USING (dim) GROUP BY ALL)
SELECT gate, dim, {r('g / avg(abs(g)) OVER (PARTITION BY gate)')} AS weight FROM g""")
def monthly_time_gates(t: Tables):
    d = lambda c: F.col(c).cast("double")
    e = t.spine.select(F.date_format("ts", "yyyy-MM").alias("gate"), F.array(d("rating"), d("verified"), F.lit(1.0)).alias("u"),
                       F.array(d("quantity") / 10, d("discount"), d("price") / 1000).alias("v"))
    return rounded_columns(pr.time_gates(e, "gate", "u", "v", 100.0), ["gate", "dim"])


@query("D23", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, lf AS (SELECT product_id, min(day) AS f, max(day) AS l FROM blocked GROUP BY 1),
a AS (SELECT customer_block, CASE WHEN l = f THEN 'single_day' WHEN (day - f) / (l - f) <= 0.25 THEN 'early' WHEN (day - f) / (l - f) <= 0.75 THEN 'mid' ELSE 'late' END AS age_bin FROM blocked JOIN lf USING (product_id)),
bins AS (SELECT unnest(['pre_active', 'early', 'mid', 'late', 'post_active', 'single_day']) AS age_bin), g AS (SELECT bins.age_bin, (count(a.age_bin) + 5.0 / 6) / ((SELECT count(*) FROM a) + 5) AS gp FROM bins LEFT JOIN a USING (age_bin) GROUP BY 1),
c AS (SELECT customer_block, age_bin, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT customer_block, sum(n) AS t FROM c GROUP BY 1)
SELECT customer_block, age_bin, {r('(coalesce(n, 0) + 5 * gp) / (t + 5)')} AS probability, {r('gp')} AS global_probability, {r('ln((coalesce(n, 0) + 5 * gp) / (t + 5)) - ln(gp)')} AS log_residual
FROM t CROSS JOIN g LEFT JOIN c USING (customer_block, age_bin)""")
def product_age_affinity(t: Tables):
    return rounded_columns(pr.product_age_affinity(blocked(t), "product_id", "customer_block", "day"), ["customer_block", "age_bin"])


# --- supports -----------------------------------------------------------------------------------

NEAREST = """(SELECT x, s AS nearest, abs(x - s) AS distance FROM (SELECT x, s, row_number() OVER (PARTITION BY x ORDER BY abs(x - s), s) AS i
FROM (SELECT DISTINCT value AS x FROM events), (SELECT DISTINCT l_quantity AS s FROM lineitem)) WHERE i = 1)"""


@query("C9", f"SELECT x AS value, nearest, {r('distance')} AS distance FROM {NEAREST}")
def nearest_support_values(t: Tables):
    s = su.support_counts(t.spine, "quantity")
    out = su.nearest_values(t.actions, "value", s)
    return out.select("value", "nearest", r6(F.col("distance")).alias("distance"))


@query("C10 J30", f"""WITH {ACTIONS}, es AS (SELECT user_id, value AS s, count(*) AS n FROM actions WHERE is_real GROUP BY ALL),
big AS (SELECT user_id FROM es GROUP BY 1 HAVING sum(n) >= 30), gs AS (SELECT DISTINCT value AS s FROM actions WHERE is_real), q AS (SELECT event_id, user_id, round(value * 1.37 + 0.005, 3) AS x FROM actions WHERE NOT is_real),
own AS (SELECT event_id, s FROM (SELECT event_id, s, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - s), s) AS i FROM q JOIN es USING (user_id) WHERE user_id IN (SELECT user_id FROM big)) WHERE i = 1),
gl AS (SELECT event_id, s FROM (SELECT event_id, s, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - s), s) AS i FROM q, gs WHERE user_id NOT IN (SELECT user_id FROM big)) WHERE i = 1)
SELECT event_id, s AS projected, 'entity' AS source_level FROM own UNION ALL SELECT event_id, s, 'global' FROM gl""")
def entity_support_projection(t: Tables):
    a = t.actions
    train, gen = a.where("is_real"), a.where("not is_real").withColumn("value", F.round(F.col("value") * 1.37 + 0.005, 3))
    out = su.project_to_support(gen, "value", su.support_counts(train, "value"), "user_id", su.support_counts(train, "value", ["user_id"]), 30)
    return out.select("event_id", "projected", "source_level")


@query("J30")
def stochastic_support_projection(t: Tables):
    """Random by seed among the nearest values; checked for membership in the support."""
    a = t.actions
    return su.stochastic_projection(a.where("not is_real"), "event_id", "value", su.support_counts(a.where("is_real"), "value"))


@query("J30 E13", f"""WITH {ACTIONS}, c AS (SELECT value, count(*) AS n FROM actions GROUP BY 1), w AS (SELECT value, floor((sum(n) OVER (ORDER BY value) - n) * 64 / sum(n) OVER ()) AS b FROM c),
i AS (SELECT value, row_number() OVER (PARTITION BY b ORDER BY value) AS i, count(*) OVER (PARTITION BY b) AS m FROM w) SELECT value AS support FROM i WHERE i = (m + 1) // 2""")
def learned_support_bins(t: Tables):
    return su.learned_bins(t.actions, "value", 64)


PROFILE_SQL = {
    'rows': 'sum(n)', 'unique': 'count(*)', 'unique_ratio': r('count(*) / sum(n)'), 'repeated_mass': r('coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)'),
    'entropy_bits': r('log2(sum(n)) - sum(n * log2(n)) / sum(n)'), 'spacing_min': r('min(gap)'), 'spacing_mean': r('avg(gap)'), 'spacing_max': r('max(gap)'), 'spacing_cv': r('stddev_pop(gap) / avg(gap)'),
    'top_mass': r('sum(n) FILTER (WHERE i <= 32) / sum(n)'), 'spacing_median': r('quantile_cont(gap, 0.5)'), 'spacing_p95': r('quantile_cont(gap, 0.95)')}


@query("D29", f"""WITH c AS (SELECT value, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, lead(value) OVER (ORDER BY value) - value AS gap, row_number() OVER (ORDER BY n DESC, value) AS i FROM c)
{sp.rows_sql('w', PROFILE_SQL)} UNION ALL SELECT 'dominant_precision', {r('max(n) / sum(n)')} FROM
(SELECT length(regexp_replace(regexp_extract(CAST(value AS VARCHAR), '\\.(\\d+)', 1), '0+$', '')) AS p, count(*) AS n FROM events GROUP BY 1)""")
def value_support_profile(t: Tables):
    return rounded(su.support_profile(t.actions, "value"))


@query("D29 I30", f"""WITH {ACTIONS}, s AS (SELECT DISTINCT value AS s FROM actions WHERE is_real), q AS (SELECT is_real, value AS x, count(*) AS n FROM actions GROUP BY ALL),
d AS (SELECT x, min(abs(x - s)) AS d FROM (SELECT DISTINCT x FROM q), s GROUP BY x)
SELECT is_real, CAST(sum(n) AS BIGINT) AS rows, count(*) AS "unique", {r('sum(CASE WHEN d = 0 THEN n ELSE 0 END) / sum(n)')} AS exact_overlap, {r('sum(CASE WHEN d <= 0.015 THEN n ELSE 0 END) / sum(n)')} AS tolerant_overlap,
{r('sum(n * d) / sum(n)')} AS mean_distance, {r('max(d)')} AS max_distance FROM q JOIN d USING (x) GROUP BY is_real""")
def split_support_overlap(t: Tables):
    a = t.actions
    return rounded_columns(su.split_overlap(a, "is_real", "value", su.support_counts(a.where("is_real"), "value"), 0.015), ["is_real", "rows", "unique"])


@query("D30", """SELECT 'quantity' AS "column", true AS unique_ratio, true AS repeated_mass, true AS holdout_overlap, true AS dominant_precision, true AS spacing_cv, true AS top_mass, 6 AS votes, 'low_cardinality' AS kind""")
def quantity_numeric_type(t: Tables):
    return su.numeric_type(t.spine, "event_id", "quantity").select(F.lit("quantity").alias("column"), "*")


PTABLE = f"""tr AS (SELECT quantity AS s, count(*) AS tc FROM real GROUP BY 1), qv AS (SELECT unnest([quantity, quantity + 0.4]) AS x, unnest(['v', 'g']) AS side FROM synthetic),
nn AS (SELECT x, s FROM (SELECT x, s, row_number() OVER (PARTITION BY x ORDER BY abs(x - s), s) AS i FROM (SELECT DISTINCT x FROM qv), tr) WHERE i = 1),
ca AS (SELECT s, count(*) FILTER (WHERE side = 'v') AS vc, count(*) FILTER (WHERE side = 'g') AS gc FROM qv JOIN nn USING (x) GROUP BY 1),
pt AS (SELECT s AS support, tc, coalesce(vc, 0) AS vc, coalesce(gc, 0) AS gc, tc / sum(tc) OVER () AS pt, coalesce(vc, 0) / sum(coalesce(vc, 0)) OVER () AS pv, coalesce(gc, 0) / sum(coalesce(gc, 0)) OVER () AS pg FROM tr LEFT JOIN ca USING (s))"""


def ptable(t: Tables):
    syn = t.synthetic
    return su.probability_table(t.real, syn, syn.withColumn("quantity", F.col("quantity") + 0.4), "quantity")


@query("D31 J31", f"""WITH {SPINE}, {PTABLE} SELECT support, tc AS train_count, vc AS validation_count, gc AS generated_count, {r('pt')} AS p_train, {r('pg')} AS p_generated,
{r('(pt + 1e-8) / (pg + 1e-8)')} AS ratio, {r('0.5 * (ln(pt + 1e-8) - ln(pg + 1e-8))')} AS bias FROM pt""")
def support_probability_table(t: Tables):
    p = ptable(t)
    b = p.join(su.log_bias(p, 0.5), "support")
    return b.select("support", "train_count", "validation_count", "generated_count", *[r6(F.col(c)).alias(c) for c in ("p_train", "p_generated", "ratio", "bias")])


@query("D32", f"""WITH {SPINE}, {PTABLE}, k AS (SELECT *, row_number() OVER (ORDER BY pt DESC, support) AS i, pt <= (SELECT quantile_cont(pt, 0.25) FROM pt) AS rare, (pt + pg) / 2 AS mid FROM pt)
{sp.rows_sql('k', {'support_size': 'count(*)', 'tv_train_generated': r('sum(abs(pt - pg)) / 2'), 'tv_validation_generated': r('sum(abs(pv - pg)) / 2'),
'js': r('sum(pt * (ln(pt + 1e-8) - ln(mid + 1e-8)) + pg * (ln(pg + 1e-8) - ln(mid + 1e-8))) / 2'), 'kl_train_generated': r('sum(pt * (ln(pt + 1e-8) - ln(pg + 1e-8)))'), 'kl_generated_train': r('sum(pg * (ln(pg + 1e-8) - ln(pt + 1e-8)))'),
**{f'top_{n}_error': r(f'abs(sum(pg) FILTER (WHERE i <= {n}) - sum(pt) FILTER (WHERE i <= {n}))') for n in (10, 50, 100)}, 'tail_error': '0.0',
'train_entropy': r('-sum(pt * ln(pt + 1e-8))'), 'generated_entropy': r('-sum(pg * ln(pg + 1e-8))'), 'rare_train': r('sum(pt) FILTER (WHERE rare)'), 'rare_generated': r('sum(pg) FILTER (WHERE rare)'),
'dominant_train': r('sum(pt) FILTER (WHERE i <= 5)'), 'dominant_generated': r('sum(pg) FILTER (WHERE i <= 5)'), 'missing_rate': r('avg(CASE WHEN gc = 0 THEN 1.0 ELSE 0.0 END)'), 'head_correlation': r('corr(pt, pg)')})}""")
def support_calibration_metrics(t: Tables):
    return rounded(su.calibration_metrics(ptable(t)))


@query("D33", f"""WITH {SPINE}, g AS (SELECT quantity AS s, (count(*) + 1.0) / sum(count(*) + 1.0) OVER () AS p FROM spine GROUP BY 1), c0 AS (SELECT strftime(ts, '%Y-%m') AS bucket, quantity AS s, count(*) AS n FROM spine GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY bucket) AS rows FROM c0),
k AS (SELECT bucket, s, n, CAST(rows AS BIGINT) AS rows, (n + 100 * p) / (rows + 100) AS p, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, s) AS i FROM c JOIN g USING (s) WHERE rows >= 20)
SELECT bucket, s AS support, n, rows, {r('p')} AS p FROM k WHERE i <= 8""")
def monthly_support_prior(t: Tables):
    m = t.spine.withColumn("bucket", F.date_format("ts", "yyyy-MM"))
    out = su.smoothed_support_prior(m, "quantity", ["bucket"], top=8)
    return out.select("bucket", "support", "n", "rows", r6(F.col("p")).alias("p"))


@query("E15", f"""WITH {ACTIONS}, s AS (SELECT event_id, event_type, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM actions WHERE NOT is_real WINDOW w AS (PARTITION BY event_type ORDER BY value)),
f AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM actions WHERE is_real),
p AS (SELECT event_id, event_type, (rk - 0.5) / n * (m - 1) AS place FROM s JOIN (SELECT DISTINCT event_type, m FROM f) USING (event_type))
SELECT event_id, p.event_type, {r('a.v + (b.v - a.v) * (place - floor(place))')} AS calibrated FROM p JOIN f a ON a.event_type = p.event_type AND a.i = floor(place) JOIN f b ON b.event_type = p.event_type AND b.i = ceil(place)""")
def rank_preserving_calibration(t: Tables):
    a = t.actions
    out = su.quantile_map(a.where("is_real"), a.where("not is_real"), "event_id", "value", "event_id", ["event_type"])
    return out.select("event_id", "event_type", r6(F.col("calibrated")).alias("calibrated"))


@query("D26 H18", f"""WITH {SPINE}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS d, avg(ln(1 + quantity)) AS qm, stddev_pop(ln(1 + quantity)) AS qd FROM real)
SELECT event_id, {r('(price - m) / d')} AS price_z, {r('(ln(1 + quantity) - qm) / qd')} AS quantity_z, quantity AS quantity_back FROM synthetic, s""")
def numeric_transform(t: Tables):
    how = su.fit_transform(t.real, {"price": False, "quantity": True})
    z = t.synthetic.select("event_id", su.apply_transform("price", how["price"]).alias("price_z"), su.apply_transform("quantity", how["quantity"]).alias("quantity_z"))
    return z.select("event_id", r6(F.col("price_z")).alias("price_z"), r6(F.col("quantity_z")).alias("quantity_z"), su.invert_transform("quantity_z", how["quantity"]).alias("quantity_back"))


@query("D28", f"""WITH {SPINE}, c AS (SELECT quantity, count(*) AS n FROM spine GROUP BY 1), e AS (SELECT quantity, (sum(n) OVER (ORDER BY quantity) - n) / sum(n) OVER () AS low, sum(n) OVER (ORDER BY quantity) / sum(n) OVER () AS high FROM c)
SELECT event_id, quantity, {r(f"low + (high - low) * {unit_sql(42, 'event_id')}")} AS u, quantity AS back FROM spine JOIN e USING (quantity)""")
def dequantized_quantities(t: Tables):
    s = t.spine.select("event_id", "quantity")
    edges = su.cdf_edges(s, "quantity")
    z = su.dequantize(s, "event_id", "quantity", edges)
    back = su.requantize(z, "event_id", "z", edges, "quantity").withColumnRenamed("quantity", "back")
    return z.join(back, "event_id").select("event_id", "quantity", r6(F.col("u")).alias("u"), "back")


@query("D27", f"""WITH {SPINE}, v AS (SELECT event_id, CASE WHEN product_id % 7 <> 0 THEN price END AS x FROM spine), f AS (SELECT avg(x) AS m, stddev_pop(x) AS d, min(x) AS lo, max(x) AS hi FROM v)
SELECT event_id, {r('coalesce((x - m) / d, 0)')} AS standard, {r('coalesce((x - lo) / (hi - lo), 0)')} AS minmax, x IS NULL AS missing FROM v, f""")
def linear_normalized_prices(t: Tables):
    v = t.spine.select("event_id", F.when(F.col("product_id") % 7 != 0, F.col("price")).alias("x"))
    a, b = su.linear_normalizer(v, "event_id", "x"), su.linear_normalizer(v, "event_id", "x", "minmax").drop("missing")
    both = a.withColumnRenamed("scaled", "standard").join(b.withColumnRenamed("scaled", "minmax"), "event_id")
    return both.select("event_id", r6(F.col("standard")).alias("standard"), r6(F.col("minmax")).alias("minmax"), "missing")


@query("D27")
def quantile_normalized_prices(t: Tables):
    return su.quantile_normalizer(t.spine, "event_id", "price")
