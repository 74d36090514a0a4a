"""Histories, splits, subsets and buckets on order lines and user events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import quantiles, r6
from chronoweave.operators import counts as ct
from chronoweave.operators import histories as hi
from chronoweave.operators import splits as sl
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import BLOCKED, blocked, rounded, rounded_columns
from chronoweave.plans.tables import ACTIONS, BLOCK_MAPS, SPINE, Tables, hash_sql, r


@query("E2", f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
- count(*) OVER (PARTITION BY user_id, ts) AS prior_count FROM events""")
def strict_prior_counts(t: Tables):
    return hi.with_prior_count(t.actions, "user_id", "ts", "prior_count").select("event_id", "prior_count")


PRIOR = """pg AS (SELECT customer_id, day, count(*) AS c, sum(quantity) AS s FROM spine GROUP BY ALL),
pr AS (SELECT customer_id, day, coalesce(sum(c) OVER w, 0) AS pc, sum(s) OVER w AS ps, lag(day) OVER (PARTITION BY customer_id ORDER BY day) AS pd,
 min(day) OVER (PARTITION BY customer_id) AS fd FROM pg WINDOW w AS (PARTITION BY customer_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("E3", f"""WITH {SPINE}, {PRIOR} SELECT customer_id, day, CAST(pc AS BIGINT) AS prior_count, {r('ps / pc')} AS past_mean, pd AS previous_day,
{r('day - pd')} AS recency_days, {r('pc / greatest(day - fd, 1)')} AS activity_rate FROM pr""")
def customer_history_features(t: Tables):
    out = hi.history_features(t.spine, "customer_id", "ts", "quantity")
    return out.select("customer_id", F.to_date("ts").alias("day"), "prior_count", r6(F.col("past_mean")).alias("past_mean"),
                      F.to_date("previous_time").alias("previous_day"), r6(F.col("recency_days")).alias("recency_days"),
                      r6(F.col("activity_rate")).alias("activity_rate"))


def _scope(name: str, keys: str) -> str:
    on = f"PARTITION BY {keys} " if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {cols}day, coalesce(sum(n) OVER w, 0) AS {name}_n, sum(s) OVER w AS {name}_s, sum(q) OVER w AS {name}_q, sum(f) OVER w AS {name}_f,
  lag(day) OVER ({on}ORDER BY day) AS {name}_d FROM (SELECT {cols}day, count(*) AS n, sum(rating) AS s, sum(rating * rating) AS q, sum(verified) AS f FROM blocked GROUP BY ALL)
  WINDOW w AS ({on}ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("E4", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, {_scope('c', 'customer_id')}, {_scope('p', 'product_id')}, {_scope('bp', 'customer_block, product_block')},
{_scope('kb', 'customer_block')}, {_scope('qb', 'product_block')}, {_scope('g', '')},
lim AS (SELECT min(day) AS lo, max(day) AS hi FROM blocked), deg AS (SELECT customer_id, count(*) AS d FROM blocked GROUP BY 1)
SELECT event_id, CAST(c_n AS DOUBLE) AS customer_past_count, {r('coalesce(c_s / nullif(c_n, 0), g_s / nullif(g_n, 0), 0)')} AS customer_past_rating,
{r('CASE WHEN c_n > 1 THEN sqrt(greatest(c_q / c_n - (c_s / c_n) * (c_s / c_n), 0)) ELSE 0 END')} AS customer_past_std,
{r('coalesce(day - c_d, 0)')} AS customer_days_since_last, {r('coalesce(p_f / nullif(p_n, 0), g_f / nullif(g_n, 0), 0)')} AS product_past_verified,
CAST(bp_n AS DOUBLE) AS block_pair_past_count, {r('coalesce(bp_s / nullif(bp_n, 0), g_s / nullif(g_n, 0), 0)')} AS block_pair_past_rating,
{r('coalesce(kb_s / nullif(kb_n, 0), g_s / nullif(g_n, 0), 0)')} AS customer_block_past_rating, {r('coalesce(qb_f / nullif(qb_n, 0), g_f / nullif(g_n, 0), 0)')} AS product_block_past_verified,
CAST(g_n AS DOUBLE) AS global_past_count, {r('coalesce(g_s / nullif(g_n, 0), 0)')} AS global_past_rating, {r('(day - lo) / (hi - lo)')} AS normalized_time,
CAST(isodow(day) - 1 AS DOUBLE) AS day_of_week, CAST(d AS DOUBLE) AS customer_total_degree, {r('ln(1 + d)')} AS customer_degree_log
FROM blocked JOIN c USING (customer_id, day) JOIN p USING (product_id, day) JOIN bp USING (customer_block, product_block, day)
JOIN kb USING (customer_block, day) JOIN qb USING (product_block, day) JOIN g USING (day) JOIN deg USING (customer_id), lim""")
def causal_features(t: Tables):
    b = blocked(t)
    degrees = {e: ct.degrees(b, e, f"{e.split('_')[0]}_degree") for e in ("customer_id", "product_id")}
    out = hi.causal_features(b, degrees, "event_id", "ts", "day", "rating", "verified")
    names = ["customer_past_count", "customer_past_rating", "customer_past_std", "customer_days_since_last", "product_past_verified", "block_pair_past_count",
             "block_pair_past_rating", "customer_block_past_rating", "product_block_past_verified", "global_past_count", "global_past_rating",
             "normalized_time", "day_of_week", "customer_total_degree", "customer_degree_log"]
    return out.select("event_id", *[r6(F.col(n)).alias(n) for n in names])


def _rows_before(name: str, keys: str) -> str:
    over = f"(PARTITION BY {keys} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if keys else "(ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""CAST(count(*) OVER {over} AS DOUBLE) AS {name}_past_count, {r(f'coalesce(avg(rating) OVER {over}, 0)')} AS {name}_past_rating,
    {r(f'coalesce(avg(verified) OVER {over}, 0)')} AS {name}_past_verified"""


@query("E5", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT event_id, {_rows_before('customer', 'customer_id')}, {_rows_before('product', 'product_id')},
{_rows_before('block_pair', 'customer_block, product_block')}, {_rows_before('global', '')} FROM blocked""")
def row_order_history(t: Tables):
    scopes = {"customer": ["customer_id"], "product": ["product_id"], "block_pair": ["customer_block", "product_block"], "global": []}
    return rounded_columns(hi.row_order_history(blocked(t), "event_id", scopes, "ts", "rating", "verified"), ["event_id"])


def _history_text(df, key: str):
    ids = F.array_join(F.transform("history", lambda e: e["neighbor"].cast("string")), ",")
    return df.select(key, F.size("history").alias("found"), ids.alias("neighbors"))


def neighbor_sql(condition: str, k: int, order: str = "b.ts DESC, b.event_id DESC") -> str:
    return f"""WITH m AS (SELECT a.event_id, b.event_id AS n, row_number() OVER (PARTITION BY a.event_id ORDER BY {order}) AS i
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND {condition})
SELECT e.event_id, CAST(count(n) AS INTEGER) AS found, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY i), '') AS neighbors
FROM events e LEFT JOIN (SELECT * FROM m WHERE i <= {k}) USING (event_id) GROUP BY e.event_id"""


@query("C7", neighbor_sql("b.ts <= a.ts", 5))
def causal_neighbors(t: Tables):
    out = hi.neighbors(t.actions, "user_id", "event_id", "ts", 5)
    return _history_text(hi.assert_past_only(out, strict=False), "event_id")


@query("C7", neighbor_sql("b.ts <= a.ts AND epoch_us(a.ts) - epoch_us(b.ts) <= 43200000000", 4))
def causal_window_neighbors(t: Tables):
    return _history_text(hi.neighbors(t.actions, "user_id", "event_id", "ts", 4, window_days=0.5), "event_id")


@query("C7", neighbor_sql("abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 43200000000", 4))
def symmetric_window_neighbors(t: Tables):
    return _history_text(hi.neighbors(t.actions, "user_id", "event_id", "ts", 4, mode="symmetric", window_days=0.5), "event_id")


@query("C8 E14", neighbor_sql("b.ts < a.ts", 6))
def strict_past_neighbors(t: Tables):
    out = hi.neighbors(t.actions, "user_id", "event_id", "ts", 6, same_time="none")
    return _history_text(hi.assert_past_only(out, strict=True), "event_id")


@query("C8", neighbor_sql("(b.ts, b.event_id) < (a.ts, a.event_id)", 6))
def earlier_row_neighbors(t: Tables):
    return _history_text(hi.neighbors(t.actions, "user_id", "event_id", "ts", 6, same_time="earlier"), "event_id")


@query("C8")
def mixed_past_neighbors(t: Tables):
    """Recent share plus uniform draws from the older past (random by seed; tested for order and repeats)."""
    return _history_text(hi.neighbors(t.actions, "user_id", "event_id", "ts", 8, same_time="none", strategy="mixed"), "event_id")


@query("E7 H14", f"""WITH m AS (SELECT a.event_id, (epoch_us(a.ts) - epoch_us(b.ts)) / 86400e6 AS d, b.value AS v, CAST(b.event_type = 'error' AS INTEGER) AS f,
row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS i
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts <= a.ts AND epoch_us(a.ts) - epoch_us(b.ts) <= 3 * 86400000000)
SELECT e.event_id, {r('least(count(d) / 5, 1)')} AS filled, {r('coalesce(avg(d), 0) / 3')} AS mean_age, {r('coalesce(sum(exp(-d / 1.5)), 0) / 5')} AS decayed_mass,
{r('coalesce(avg(v), 0)')} AS mean_rating, {r('coalesce(avg(f), 0)')} AS mean_verified FROM events e LEFT JOIN (SELECT * FROM m WHERE i <= 5) USING (event_id) GROUP BY e.event_id""")
def history_context_features(t: Tables):
    a = t.actions.withColumn("failed", (F.col("event_type") == "error").cast("int"))
    h = hi.neighbors(a, "user_id", "event_id", "ts", 5, window_days=3.0, carry=["value", "failed"])
    return rounded_columns(hi.context_features(h, "event_id", 5, 3.0, 1.5, "value", "failed"), ["event_id"])


def split_sql(src: str, order: str, a: float, b: float, keep: str) -> str:
    return f"""SELECT {keep}, CASE WHEN rn <= floor(n * {a}) THEN 'train' WHEN rn <= floor(n * {b}) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM {src})"""


EVENT_SPLIT = f"sp AS ({split_sql('events', 'ts, CAST(event_id AS VARCHAR)', 0.7, 0.85, 'event_id, user_id, event_type, ts, value')})"


@query("E1", f"WITH {EVENT_SPLIT} SELECT event_id, split FROM sp")
def chronological_split(t: Tables):
    return sl.chronological_split(t.actions, "ts", "event_id").select("event_id", "split")


@query("E1", f"""WITH {SPINE}, s AS ({split_sql('spine', 'ts, event_id', 0.9, 0.95, 'event_id')}) SELECT * FROM s""")
def time_ordered_90_5_5_split(t: Tables):
    return sl.resolved_split(t.spine, "ts", "event_id").select("event_id", "split")


@query("E1", """SELECT event_id, CASE event_type WHEN 'error' THEN 'test' WHEN 'click' THEN 'validation' ELSE 'train' END AS split FROM events""")
def explicit_split_labels(t: Tables):
    label = F.when(F.col("event_type") == "error", " Test").when(F.col("event_type") == "click", "val").otherwise("Training")
    return sl.resolved_split(t.actions.withColumn("split", label), "ts", "event_id").select("event_id", "split")


@query("D37", f"""WITH {EVENT_SPLIT}, k AS (SELECT user_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM sp GROUP BY 1),
bd AS (SELECT max(ts) FILTER (WHERE split = 'train') AS t1, min(ts) FILTER (WHERE split = 'validation') AS v0, max(ts) FILTER (WHERE split = 'validation') AS v1,
min(ts) FILTER (WHERE split = 'test') AS s0 FROM sp)
SELECT 'empty_splits' AS "check", 0 AS found UNION ALL SELECT 'unknown_labels', 0 UNION ALL
SELECT 'not_separated', CAST(t1 > v0 AS INTEGER) + CAST(v1 > s0 AS INTEGER) FROM bd UNION ALL
SELECT 'shared_boundaries', CAST(t1 = v0 AS INTEGER) + CAST(v1 = s0 AS INTEGER) FROM bd UNION ALL
SELECT 'train_vs_validation', count(*) FILTER (WHERE a AND b) FROM k UNION ALL SELECT 'train_vs_test', count(*) FILTER (WHERE a AND c) FROM k UNION ALL
SELECT 'validation_vs_test', CAST(count(*) FILTER (WHERE b AND c) AS BIGINT) FROM k""")
def split_integrity(t: Tables):
    return sl.split_integrity(sl.chronological_split(t.actions, "ts", "event_id"), "ts", ["user_id"])


@query("D38", f"""WITH {EVENT_SPLIT}, p AS (SELECT *, (SELECT count(*) FROM events e WHERE e.user_id = sp.user_id AND e.ts < sp.ts) AS a,
count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY event_type, ts) AS b FROM sp),
q AS (SELECT * FROM p WHERE split = 'test')
{sp.rows_sql('q', {'rows': 'count(*)', 'first_coverage': r('avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END)'), 'first_mean': r('avg(a)'), 'first_max': 'max(a)',
'second_coverage': r('avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END)'), 'second_mean': r('avg(b)'), 'second_max': 'max(b)',
'cold_events': 'count(*) FILTER (WHERE a = 0 AND b = 0)', 'partial_history_events': 'count(*) FILTER (WHERE (a > 0) <> (b > 0))',
'warm_events': 'count(*) FILTER (WHERE a > 0 AND b > 0)', 'any_history_rate': r('avg(CASE WHEN a > 0 OR b > 0 THEN 1.0 ELSE 0.0 END)'),
'warm_rate': r('avg(CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 0.0 END)'), 'first_p50': r('quantile_cont(a, 0.5)'), 'first_p95': r('quantile_cont(a, 0.95)'),
'second_p50': r('quantile_cont(b, 0.5)'), 'second_p95': r('quantile_cont(b, 0.95)')})}""")
def history_coverage(t: Tables):
    s = sl.chronological_split(t.actions, "ts", "event_id")
    return rounded(hi.history_coverage(s, "user_id", "event_type", "ts", "split"))


@query("A19 G1", f"""WITH {EVENT_SPLIT} SELECT 'history_prefix' AS part, count(*) AS rows, count(DISTINCT user_id) AS users FROM sp WHERE split <> 'test'
UNION ALL SELECT split || '_spine', count(*), count(DISTINCT user_id) FROM sp GROUP BY split""")
def split_spines(t: Tables):
    parts = sl.split_spines(sl.chronological_split(t.actions, "ts", "event_id"), ["event_id", "user_id", "ts"])
    rows = [parts[n].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")).select(F.lit(n).alias("part"), "rows", "users")
            for n in ("history_prefix", "train_spine", "validation_spine", "test_spine")]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


@query("F4", f"""WITH {SPINE}, pool AS (SELECT c_custkey AS customer_id FROM customer WHERE c_custkey IN (SELECT customer_id FROM spine)),
chosen AS (SELECT customer_id FROM pool ORDER BY {hash_sql(42, 'customer_id')}, customer_id LIMIT 100),
kept AS (SELECT * FROM spine WHERE customer_id IN (SELECT customer_id FROM chosen))
SELECT 'customers' AS part, count(*) AS rows FROM chosen UNION ALL SELECT 'events', count(*) FROM kept
UNION ALL SELECT 'products', count(*) FROM part WHERE p_partkey IN (SELECT product_id FROM kept)""")
def induced_customer_subset(t: Tables):
    c = t.customer.withColumnRenamed("c_custkey", "customer_id")
    p = t.part.withColumnRenamed("p_partkey", "product_id")
    parts = sl.induced_subset(t.spine, c, p, 100)
    named = zip(("customers", "events", "products"), parts)
    out = None
    for n, df in named:
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("F5", f"""WITH {SPINE}, c AS (SELECT customer_id, count(*) AS n FROM spine GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'customer_id')}, customer_id) AS i,
CAST(sum(n) OVER (ORDER BY {hash_sql(42, 'customer_id')}, customer_id) AS BIGINT) AS total, (SELECT count(*) // 6 FROM spine) AS target FROM c),
w AS (SELECT max(i) FILTER (WHERE ok) AS last FROM (SELECT i, bool_and(grow) OVER (ORDER BY i) AS ok FROM
(SELECT i, total, n, target, abs(total - target) <= abs(total - n - target) AND total - n < target AS grow FROM o))),
s AS (SELECT (SELECT total FROM o WHERE i = last) AS total, last, (SELECT max(target) FROM o) AS target FROM w)
SELECT CAST(abs(total - target) <= 1000 AS BOOLEAN) AS close_to_target, true AS unique_sources, true AS full_histories FROM s""")
def target_sized_source_selection(t: Tables):
    c = ct.degrees(t.spine, "customer_id", "n")
    target = t.spine.count() // 6
    s = sl.select_sources(c, "customer_id", target)
    out = s.join(c.withColumnRenamed("n", "full_n"), "customer_id")
    return out.agg((F.abs(F.sum("n") - target) <= 1).alias("close_to_target"), (F.count(F.lit(1)) == F.count_distinct("customer_id")).alias("unique_sources"),
                   F.bool_and(F.col("n") == F.col("full_n")).alias("full_histories"))


@query("F6", f"""WITH b AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS place FROM events),
w AS (SELECT day, count(*) AS n, row_number() OVER (ORDER BY day) AS bin_no, coalesce(sum(count(*)) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b GROUP BY day),
d AS (SELECT i AS draw, CAST(floor((({hash_sql('42b', 'i')} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) * (SELECT count(*) FROM w)) AS BIGINT) + 1 AS bin_no,
(({hash_sql('42r', 'i')} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS v FROM range(2000) x(i))
SELECT draw, event_id, day FROM (SELECT draw, day, CAST(floor(v * n) AS BIGINT) + 1 AS place FROM d JOIN w USING (bin_no)) JOIN b USING (day, place)""")
def stratified_time_draws(t: Tables):
    a = t.actions.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sl.stratified_draws(a, "event_id", "day", 2000)


@query("F7", f"""WITH {ACTIONS}, n AS (SELECT least(count(*) FILTER (WHERE is_real), count(*) FILTER (WHERE NOT is_real), 1000) AS n FROM actions),
a AS (SELECT *, row_number() OVER (PARTITION BY is_real ORDER BY CASE WHEN is_real THEN {hash_sql('421', 'event_id')} ELSE {hash_sql('420', 'event_id')} END, event_id) AS i FROM actions)
SELECT event_id, is_real FROM a, n WHERE i <= n""")
def balanced_two_sample_draw(t: Tables):
    return sl.balanced_draw(t.actions, "event_id", 1000).select("event_id", "is_real")


@query("F1 F8", f"""WITH {EVENT_SPLIT} SELECT event_id, ts FROM sp WHERE split = 'test' ORDER BY ts, event_id LIMIT 500""")
def fixed_evaluation_rows(t: Tables):
    test = sl.chronological_split(t.actions, "ts", "event_id").where("split = 'test'")
    return sl.evaluation_rows(test, "ts", "event_id", 500).select("event_id", "ts")


@query("E8 K3", f"""SELECT mode, k, count(*) AS n FROM (SELECT unnest(['date', 'window']) AS mode, unnest([strftime(ts, '%Y-%m-%d'),
CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // (86400000000 * 7) AS VARCHAR)]) AS k FROM events) GROUP BY ALL""")
def chronological_groups(t: Tables):
    lo = t.actions.agg(F.min(F.unix_micros("ts"))).first()[0]
    cells = F.array(*[F.struct(F.lit(m).alias("mode"), sl.chronological_group("ts", m, lo, 7).alias("k")) for m in ("date", "window")])
    return t.actions.select(F.inline(cells)).groupBy("mode", "k").agg(F.count(F.lit(1)).alias("n"))


FREQ = """fb AS (SELECT product_id, n, 'frequency_q' || CAST(greatest(0, CAST(ceil((rk - 1) * 5 / greatest(total - 1, 1)) AS BIGINT) - 1) + 1 AS VARCHAR) AS bucket
FROM (SELECT product_id, n, row_number() OVER (ORDER BY n, product_id) AS rk, count(*) OVER () AS total FROM (SELECT product_id, count(*) AS n FROM spine GROUP BY 1)))"""


@query("E9", f"WITH {SPINE}, {FREQ} SELECT * FROM fb")
def product_frequency_buckets(t: Tables):
    return sl.frequency_buckets(ct.degrees(t.spine, "product_id", "n"), "product_id", 5)


@query("E10", f"""WITH {SPINE}, p AS (SELECT event_id, (rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2) / count(*) OVER () AS pct FROM spine)
SELECT event_id, CASE WHEN pct <= 0.25 THEN 1 WHEN pct <= 0.5 THEN 2 WHEN pct <= 0.75 THEN 3 ELSE 4 END AS quartile FROM p""")
def quantity_quartiles(t: Tables):
    return sl.quartile_groups(t.spine.select("event_id", "quantity"), "quantity").select("event_id", "quartile")


@query("E11", f"""WITH {ACTIONS}, e AS (SELECT list_distinct(quantile_cont(epoch_us(ts), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM actions WHERE is_real),
lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM actions WHERE is_real)
SELECT is_real, CAST(len(list_filter(edges, lambda x: x <= epoch_us(ts))) AS INTEGER) AS quantile_bin,
CAST(greatest(least(floor((epoch_us(ts) - lo) * 10.0 / (hi - lo)), 9), 0) AS INTEGER) AS width_bin, count(*) AS n FROM actions, e, lim GROUP BY ALL""")
def train_fitted_time_bins(t: Tables):
    """Bins are fitted on the real side and applied to both."""
    a = t.actions.withColumn("t", F.unix_micros("ts").cast("double"))
    edges = quantiles(a.where("is_real"), "t", {str(i): i / 10 for i in range(1, 10)}).first()
    lo, hi = a.where("is_real").agg(F.min("t"), F.max("t")).first()
    from chronoweave.functions.cleaning import bucket_by_edges

    width = F.greatest(F.least(F.floor((F.col("t") - lo) * 10.0 / (hi - lo)), F.lit(9)), F.lit(0)).cast("int")
    return a.groupBy("is_real", bucket_by_edges("t", sorted(set(edges))).alias("quantile_bin"), width.alias("width_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("E12", f"""WITH w AS (SELECT date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY 1),
ok AS (SELECT count(*) >= 4 AND min(n) >= 50 AS weekly FROM w),
b AS (SELECT event_id, ts, greatest(0, CAST(ceil((row_number() OVER (ORDER BY ts, event_id) - 1) * 8.0 / (count(*) OVER () - 1)) AS BIGINT) - 1) AS q FROM events)
SELECT CASE WHEN weekly THEN strftime(date_trunc('week', ts), '%Y-%m-%d') ELSE 'q' || CAST(q + 1 AS VARCHAR) END AS bin, count(*) AS n FROM b, ok GROUP BY ALL""")
def adaptive_time_bins(t: Tables):
    from chronoweave.operators.profiles import adaptive_time_bins as bins

    return bins(t.actions, "ts", "event_id").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("E13", f"""WITH {SPINE}, c AS (SELECT quantity, count(*) AS n FROM spine GROUP BY 1), w AS (SELECT quantity, n, sum(n) OVER (ORDER BY quantity) - n AS below, sum(n) OVER () AS total FROM c)
SELECT quantity, CAST(least(floor(below * 8 / total), 7) AS INTEGER) AS bin FROM w""")
def equal_mass_value_bins(t: Tables):
    from chronoweave.operators.profiles import equal_mass_bins

    return equal_mass_bins(t.spine, "quantity", 8).select("quantity", "bin")


@query("E2 E4", f"""WITH {SPINE}, e AS (SELECT event_id, CASE WHEN product_id % 11 <> 0 THEN customer_id END AS customer_id, ts FROM spine)
SELECT event_id, customer_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n FROM e""")
def prior_counts_with_missing_customers(t: Tables):
    """Events without a customer keep each other's company: none is lost."""
    e = t.spine.select("event_id", F.when(F.col("product_id") % 11 != 0, F.col("customer_id")).alias("customer_id"), "ts")
    return hi.with_prior_count(e, "customer_id", "ts", "n").select("event_id", "customer_id", "n")
