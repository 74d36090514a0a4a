"""Whole-table metrics: shape, trend, time, keys, validity and the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import cleaning as cl
from chronoweave.functions.kernels import r6
from chronoweave.operators import profiles as pf
from chronoweave.operators import table_metrics as tm
from chronoweave.operators import two_sample as ts
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import rounded, rounded_columns
from chronoweave.plans.tables import SPINE, Tables, corr_sql, r

RULE = cl.CategoryRule
SPECS = {
    "customer_id": tm.ColumnSpec("foreign_key"), "product_id": tm.ColumnSpec("foreign_key"), "ts": tm.ColumnSpec("datetime"),
    "quantity": tm.ColumnSpec("numerical"), "price": tm.ColumnSpec("numerical"), "flag": tm.ColumnSpec("categorical"),
    "rating": tm.ColumnSpec("categorical", RULE("int", (1, 2, 3, 4, 5, 6, 7))), "priority": tm.ColumnSpec("text"),
}
LIM = "lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM real)"
MEASURED = f"""{LIM}, meas AS (SELECT is_real, 'quantity' AS "column", quantity AS value FROM spine UNION ALL SELECT is_real, 'price', price FROM spine
UNION ALL SELECT is_real, 'ts', round((epoch_us(ts) - lo) / (hi - lo), 12) FROM spine, lim UNION ALL SELECT is_real, 'priority', len(string_split(priority, ' ')) FROM spine)"""
CATS = """cats AS (SELECT is_real, 'flag' AS "column", flag AS item FROM spine UNION ALL SELECT is_real, 'rating', CAST(rating AS VARCHAR) FROM spine)"""


def fk_sides(e: str) -> str:
    return f"""SELECT is_real, '{e}' AS "column", n FROM (SELECT count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY {e}) c,
LATERAL (SELECT unnest([true, false]) AS is_real, unnest([rn, sn]) AS n)"""


SHAPE = f"""{MEASURED}, {CATS}, fks AS ({fk_sides('customer_id')} UNION ALL {fk_sides('product_id')}), {sp.grid_ranked_cte('meas', 'value', ['"column"'])},
w AS ({sp.grid_sql('meas', 'value', ['"column"'], 'secondary')}),
shp AS (SELECT "column", ks AS shape_error, secondary, CASE "column" WHEN 'ts' THEN 'datetime' WHEN 'priority' THEN 'text' ELSE 'numerical' END AS kind,
CASE "column" WHEN 'priority' THEN 'text' ELSE 'attribute' END AS shape_group FROM ({sp.ks_sql('meas', 'value', ['"column"'])}) JOIN w USING ("column")
UNION ALL SELECT "column", tv, NULL, 'categorical', 'attribute' FROM ({sp.tv_sql('cats', ['item'], ['"column"'])})
UNION ALL SELECT "column", ks, NULL, 'foreign_key', 'structural' FROM ({sp.ks_sql('fks', 'n', ['"column"'])}))"""


@query("I7", f"WITH {SPINE}, {SHAPE} SELECT * FROM shp")
def column_shape_errors(t: Tables):
    out = tm.shape_errors(t.spine, SPECS, "event_id")
    return out.select("column", r6(F.col("shape_error")).alias("shape_error"), r6(F.col("secondary")).alias("secondary"), "kind", "shape_group")


@query("I7 I54 L3", f"""WITH {SPINE}, {SHAPE} {sp.rows_sql('shp', {'macro_shape_error': r('avg(shape_error)', 5), 'macro_attribute_shape_error': r("avg(shape_error) FILTER (WHERE shape_group <> 'structural')", 5),
'macro_text_shape_error': r("avg(shape_error) FILTER (WHERE shape_group = 'text')", 5), 'macro_structural_shape_error': r("avg(shape_error) FILTER (WHERE shape_group = 'structural')", 5)})}""")
def macro_shape_summary(t: Tables):
    e = tm.shape_errors(t.spine, SPECS, "event_id").withColumn("shape_error", r6(F.col("shape_error")))
    return tm.shape_summary(e).select("metric", r6(F.col("value"), 5).alias("value"))


CODED = """coded AS (SELECT *, dense_rank() OVER (PARTITION BY is_real ORDER BY flag) - 1 AS flag_c, dense_rank() OVER (PARTITION BY is_real ORDER BY status) - 1 AS status_c,
epoch_us(ts) AS t, len(string_split(priority, ' ')) AS words FROM spine)"""
TREND_COLUMNS = {"quantity": "quantity", "price": "price", "ts": "t", "flag": "flag_c", "status": "status_c", "priority": "words"}


def trend_sql() -> str:
    from itertools import combinations

    parts = []
    for a, b in combinations(TREND_COLUMNS, 2):
        if (a, b) == ("flag", "status"):
            parts.append(f"""SELECT 'flag' AS col_a, 'status' AS col_b, tv AS trend_error, 'contingency_total_variation' AS metric_used, true AS headline FROM ({sp.tv_sql('spine', ['flag', 'status'])})""")
            continue
        x, y = TREND_COLUMNS[a], TREND_COLUMNS[b]
        parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'abs(max(c) FILTER (WHERE is_real) - max(c) FILTER (WHERE NOT is_real)) / 2')} AS trend_error,
        'absolute_correlation_difference' AS metric_used, true AS headline FROM (SELECT is_real, {corr_sql(x, y)} AS c FROM coded GROUP BY is_real)""")
    return " UNION ALL ".join(parts)


@query("I8 B23", f"WITH {SPINE}, {CODED} {trend_sql()}")
def pair_trend_errors(t: Tables):
    specs = {"quantity": SPECS["quantity"], "price": SPECS["price"], "ts": SPECS["ts"], "flag": SPECS["flag"], "status": tm.ColumnSpec("categorical"), "priority": SPECS["priority"]}
    out = tm.trend_errors(t.spine, specs)
    return out.withColumn("trend_error", r6(F.col("trend_error")))


def binned_sql(mode: str, key: str, grid: str | None = None) -> str:
    base = f"(SELECT {key} AS k, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine, lim GROUP BY 1)"
    if grid:
        base = f"(SELECT i AS k, coalesce(rn, 0) AS rn, coalesce(sn, 0) AS sn FROM range({grid}) x(i) LEFT JOIN {base} c ON c.k = i)"
    return f"""SELECT '{mode}' AS mode, {r('sum(abs(p - q)) / 2')} AS tv, {r(corr_sql('rn', 'sn'))} AS count_corr, {r('avg(abs(p - q))')} AS count_mae, count(*) AS bins
    FROM (SELECT *, rn / sum(rn) OVER () AS p, sn / sum(sn) OVER () AS q FROM {base})"""


@query("I9", f"""WITH {SPINE}, {LIM} {binned_sql('adaptive', 'CASE WHEN epoch_us(ts) BETWEEN lo AND hi THEN least(floor((epoch_us(ts) - lo) / (hi - lo) * 50), 49) END', '50')}
UNION ALL {binned_sql('weekly', "strftime(date_trunc('week', ts), '%Y-%m-%d')")} UNION ALL {binned_sql('monthly', "strftime(ts, '%Y-%m')")}""")
def binned_time_distance(t: Tables):
    parts = [tm.binned_time(t.spine, "ts", m).select(F.lit(m).alias("mode"), "*") for m in ("adaptive", "weekly", "monthly")]
    return rounded_columns(ts.stack_reports(*parts), ["mode", "bins"])


@query("I9 I4", f"""WITH {SPINE}, dd AS (SELECT is_real, epoch_us(ts) / 86400e6 AS d FROM spine), {sp.grid_ranked_cte('dd', 'd')}, w AS ({sp.grid_sql('dd', 'd').replace("round(", "(").replace(", 6)", ")").replace(" + 1e-10", "")}),
l AS (SELECT max(d) - min(d) AS span FROM dd WHERE is_real) SELECT {r('wasserstein / span')} AS normalized, {r('wasserstein')} AS days, {r('wasserstein / 7')} AS weeks, {r('wasserstein / 30.4375')} AS months FROM w, l""")
def time_wasserstein(t: Tables):
    return rounded_columns(tm.time_wasserstein(t.spine, "ts", "event_id"))


@query("I11", f"""WITH {SPINE}, c AS (SELECT c_custkey AS id, count(customer_id) FILTER (WHERE is_real) AS rn, count(customer_id) FILTER (WHERE NOT is_real) AS sn FROM customer LEFT JOIN spine ON customer_id = c_custkey GROUP BY 1),
tot AS (SELECT sum(rn) AS r, sum(sn) AS s FROM c), sides AS (SELECT is_real, n, n / t AS share FROM (SELECT unnest([true, false]) AS is_real, unnest([rn, sn]) AS n, unnest([r, s]) AS t FROM c, tot)),
{sp.grid_ranked_cte('sides', 'n')}, g AS (SELECT is_real, n, row_number() OVER (PARTITION BY is_real ORDER BY n) AS i, count(*) OVER (PARTITION BY is_real) AS m, sum(n) OVER (PARTITION BY is_real) AS s FROM sides),
nk AS ({sp.ks_sql('sides', 'share')})
SELECT 'absolute_ks' AS metric, ks AS value FROM ({sp.ks_sql('sides', 'n')}) UNION ALL SELECT 'normalized_ks', ks FROM nk UNION ALL SELECT 'similarity', round(1 - ks, 6) FROM nk
UNION ALL SELECT 'wasserstein', wasserstein FROM ({sp.grid_sql('sides', 'n')})
UNION ALL {sp.rows_sql('c', {'mean_abs_diff': r('avg(abs(rn - sn))'), 'real_mean': r('avg(rn)'), 'synthetic_mean': r('avg(sn)'), 'parents': 'count(*)'})}
UNION ALL SELECT CASE WHEN is_real THEN 'real_gini' ELSE 'synthetic_gini' END, {r('2.0 * sum(i * n) / (max(m) * max(s)) - (max(m) + 1.0) / max(m)')} FROM g GROUP BY is_real""")
def customer_fk_cardinality(t: Tables):
    parents = t.customer.select(F.col("c_custkey").alias("customer_id"))
    return rounded(tm.fk_cardinality(t.spine, "customer_id", parents))


BROKEN = """broken AS (SELECT CASE WHEN order_id % 40 = 0 THEN NULL ELSE order_id END AS order_id, rating AS line, CASE order_id % 30 WHEN 0 THEN '' ELSE flag END AS flag,
CASE order_id % 25 WHEN 0 THEN 'n/a' ELSE CAST(quantity AS {s}) END AS quantity, CASE order_id % 35 WHEN 0 THEN 'soon' ELSE CAST(day AS {s}) END AS day,
CASE WHEN order_id % 45 = 0 THEN customer_id + 10000000 ELSE customer_id END AS customer_id, CASE order_id % 20 WHEN 0 THEN 'Z' ELSE status END AS status FROM {t})"""


@query("I12", f"""WITH {SPINE}, {BROKEN.format(s='VARCHAR', t='spine')}, kc AS (SELECT order_id, line, count(*) AS copies FROM broken GROUP BY ALL),
f AS (SELECT flag = '' AS a, TRY_CAST(quantity AS DOUBLE) IS NULL AS b, TRY_CAST(day AS DATE) IS NULL AS c, status NOT IN ('F', 'O') AS d,
customer_id NOT IN (SELECT c_custkey FROM customer) AS e, coalesce(copies > 1, true) AS g FROM broken LEFT JOIN kc USING (order_id, line)),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a OR b OR c OR d OR e OR g) AS bad, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c,
count(*) FILTER (WHERE d) AS d, count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE g) AS g FROM f)
{sp.rows_sql('s', {'rows': 'n', 'violating_rows': 'bad', 'violations': 'a + b + c + d + e + g', 'checks': 'n * 6', 'constraint_violation_rate': r('bad / n'), 'violation_count_rate': r('(a + b + c + d + e + g) / (n * 6)'),
'null_violations': 'a', 'dtype_violations': 'b + c', 'datetime_parse_violations': 'c', 'categorical_domain_violations': 'd', 'foreign_key_violations': 'e', 'primary_key_violations': 'g'})}""")
def constraint_violations(t: Tables):
    t.spine.createOrReplaceTempView("_spine_rows")
    broken = t.spark.sql("WITH " + BROKEN.format(s="STRING", t="_spine_rows") + " SELECT * FROM broken")
    specs = {"flag": tm.ColumnSpec("categorical", nullable=False), "quantity": tm.ColumnSpec("numerical"), "day": tm.ColumnSpec("datetime"),
             "status": tm.ColumnSpec("categorical", RULE("", ("F", "O"))), "customer_id": tm.ColumnSpec("foreign_key")}
    out = tm.violations(broken, specs, ["order_id", "line"], {"customer_id": t.customer.select("c_custkey")})
    return rounded(out)


@query("B22", f"""WITH {SPINE}, c AS (SELECT count(*) AS n, count(CASE WHEN product_id % 3 = 0 THEN 1 END) AS k FROM spine)
SELECT v."column", included, reason, CASE WHEN v."column" = 'note' THEN k ELSE n END AS filled FROM c, (VALUES ('event_id', false, 'primary_key'), ('customer_id', false, 'foreign_key'), ('ts', false, 'timestamp'), ('note', false, 'text'),
('quantity', true, 'generated_attribute'), ('fixed', false, 'not_generated'), ('token_length', false, 'length_like'), ('flag', true, 'generated_attribute')) v("column", included, reason)""")
def classifier_feature_manifest(t: Tables):
    """Which columns of the order lines a classifier may use, why, and how many values each has."""
    specs = {"event_id": tm.ColumnSpec("categorical"), "customer_id": SPECS["customer_id"], "ts": SPECS["ts"], "note": tm.ColumnSpec("text"), "quantity": SPECS["quantity"],
             "fixed": tm.ColumnSpec("categorical", generated=False), "token_length": tm.ColumnSpec("numerical"), "flag": SPECS["flag"]}
    rows = t.spine.select("event_id", "customer_id", "ts", "quantity", "flag", F.when(F.col("product_id") % 3 == 0, F.col("flag")).alias("note"), F.col("flag").alias("fixed"), F.length("flag").alias("token_length"))
    filled = rows.agg(*[F.count(c).alias(c) for c in specs]).unpivot([], list(specs), "column", "filled")
    return tm.feature_manifest(t.spark, specs, ["event_id"]).join(filled, "column")


@query("I57", f"""WITH {SPINE}, s AS (SELECT * FROM synthetic), p AS (SELECT customer_id, product_id, count(*) AS n FROM s GROUP BY ALL)
SELECT 'customer_valid_rate' AS metric, {r('avg(CASE WHEN customer_id IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0.0 END)')} AS value FROM s UNION ALL
SELECT 'product_valid_rate', {r('avg(CASE WHEN product_id IN (SELECT p_partkey FROM part) THEN 1.0 ELSE 0.0 END)')} FROM s UNION ALL SELECT 'rows', count(*) FROM s UNION ALL
SELECT 'repeated_pair_rate', {r('1 - count(*) / sum(n)')} FROM p UNION ALL SELECT 'finite_price_share', {r('avg(CASE WHEN isfinite(price) THEN 1.0 ELSE 0.0 END)')} FROM s UNION ALL
SELECT 'time_parse_errors', count(*) FILTER (WHERE ts IS NULL) FROM s UNION ALL SELECT 'unseen_flags', count(*) FILTER (WHERE flag NOT IN (SELECT flag FROM real)) FROM s""")
def generation_validity(t: Tables):
    s = t.synthetic
    c = pf.foreign_key_report(s, t.customer, "customer_id", "c_custkey").select("valid_rate")
    p = pf.foreign_key_report(s, t.part, "product_id", "p_partkey").select("valid_rate")
    from chronoweave.operators.counts import repeated_pair_statistics

    rep = repeated_pair_statistics(s, ["customer_id", "product_id"])
    basic = s.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("price").isNotNull() & ~F.isnan("price") & (F.abs("price") < float("inf"))).cast("double")).alias("finite_price_share"),
                  F.count_if(F.col("ts").isNull()).alias("time_parse_errors"))
    unseen = s.join(t.real.select("flag").distinct(), "flag", "left_anti").agg(F.count(F.lit(1)).alias("unseen_flags"))
    return rounded(ts.stack_reports(
        ts.metric_rows(c, {"customer_valid_rate": F.col("valid_rate")}), ts.metric_rows(p, {"product_valid_rate": F.col("valid_rate")}),
        ts.metric_rows(rep, {"repeated_pair_rate": F.col("surplus_rate")}), ts.metric_rows(basic, basic.columns), ts.metric_rows(unseen, ["unseen_flags"])))


@query("I58", f"""WITH {SPINE} SELECT 'train' AS stage, flag AS item, count(*) AS n, false AS outside FROM real GROUP BY 2 UNION ALL
SELECT 'generated', f, count(*), f = 'X' FROM (SELECT CASE WHEN order_id % 17 = 0 THEN 'X' ELSE flag END AS f FROM synthetic) GROUP BY 2""")
def categorical_stage_audit(t: Tables):
    """Domain drift of a category across pipeline stages; the first stage sets the domain."""
    stages = t.real.select(F.lit("train").alias("stage"), F.col("flag").alias("item")).unionByName(
        t.synthetic.select(F.lit("generated").alias("stage"), F.when(F.col("order_id") % 17 == 0, "X").otherwise(F.col("flag")).alias("item")))
    c = stages.groupBy("stage", "item").agg(F.count(F.lit(1)).alias("n"))
    domain = c.where(F.col("stage") == "train").select("item", F.lit(True).alias("known"))
    return c.join(domain, "item", "left").select("stage", "item", "n", F.col("known").isNull().alias("outside"))


@query("I61", f"""WITH {SPINE}, m AS (SELECT 'customer_overlap' AS metric, 1.0 AS value UNION ALL SELECT 'duplicate_rate', (SELECT count(*) - count(DISTINCT (customer_id, product_id)) FROM synthetic) / (SELECT count(*) FROM synthetic))
SELECT metric, {r('value')} AS value, CASE WHEN metric = 'customer_overlap' AND value >= 0.999 THEN 'SUSPICIOUS_EXACT_MATCH' WHEN metric = 'duplicate_rate' AND value > 0.5 THEN 'HIGH_DUPLICATE_RATE' END AS warning FROM m""")
def metric_sanity_warnings(t: Tables):
    """Rules over finished metrics that flag impossible or suspicious values."""
    from chronoweave.operators.counts import repeated_pair_statistics

    rep = repeated_pair_statistics(t.synthetic, ["customer_id", "product_id"])
    m = ts.metric_rows(rep, {"duplicate_rate": F.col("surplus_rate")}).unionByName(t.spark.createDataFrame([("customer_overlap", 1.0)], "metric string, value double"))
    warn = F.when((F.col("metric") == "customer_overlap") & (F.col("value") >= 0.999), "SUSPICIOUS_EXACT_MATCH").when(
        (F.col("metric") == "duplicate_rate") & (F.col("value") > 0.5), "HIGH_DUPLICATE_RATE")
    return m.select("metric", r6(F.col("value")).alias("value"), warn.alias("warning"))
