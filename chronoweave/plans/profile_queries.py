"""Profiles, keys, degrees and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import r6
from chronoweave.operators import counts as ct
from chronoweave.operators import profiles as pf
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import BLOCKED, blocked, rounded, rounded_columns
from chronoweave.plans.tables import BLOCK_MAPS, SPINE, TEXTS, Tables, hash_sql, r
from chronoweave.plans.text_queries import tokens_sql, words_sql, squeeze_sql


@query("D1", f"""WITH {SPINE} SELECT 'flag' AS "column", flag AS item, count(*) AS n FROM spine GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM spine GROUP BY 2
UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*) FROM spine GROUP BY 2""")
def category_value_counts(t: Tables):
    return pf.value_counts(t.spine, ["flag", "status", "rating"])


@query("D1", f"""WITH {SPINE} {sp.rows_sql('spine', {'mean': r('avg(discount)'), 'zero_rate': r('avg(CASE WHEN discount = 0 THEN 1.0 ELSE 0.0 END)'),
'median': r('quantile_cont(discount, 0.5)'), 'p95': r('quantile_cont(discount, 0.95)')})}""")
def discount_profile(t: Tables):
    return rounded(pf.numeric_profile(t.spine, "discount"))


def degree_summary_sql(src: str, entity: str) -> str:
    return f"""d AS (SELECT count(*) AS degree FROM {src} GROUP BY {entity}), g AS (SELECT degree, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n, sum(degree) OVER () AS s FROM d)
{sp.rows_sql('d', {'count': 'count(*)', 'mean': r('avg(degree)'), 'max': 'max(degree)', 'median': r('quantile_cont(degree, 0.5)'), 'p90': r('quantile_cont(degree, 0.9)'),
                   'p95': r('quantile_cont(degree, 0.95)'), 'p99': r('quantile_cont(degree, 0.99)')})}
UNION ALL SELECT 'gini', {r('2.0 * sum(i * degree) / (max(n) * max(s)) - (max(n) + 1.0) / max(n)')} FROM g"""


@query("D2 D3", f"WITH {SPINE}, {degree_summary_sql('spine', 'product_id')}")
def product_degree_summary(t: Tables):
    return rounded(ct.degree_summary(t.spine, "product_id"))


@query("D3", f"""WITH g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, {r('2.0 * sum(i * value) / (max(n) * sum(value)) - (max(n) + 1.0) / max(n)')} AS gini FROM g GROUP BY event_type""")
def value_gini_by_type(t: Tables):
    return rounded_columns(ct.gini(t.actions, "value", ["event_type"]), ["event_type"])


@query("D4", f"""WITH {SPINE}, c AS (SELECT is_real, customer_id, product_id, count(*) AS n FROM spine GROUP BY ALL)
SELECT is_real, CAST(sum(n) AS BIGINT) AS rows, count(*) AS pairs, count(*) FILTER (WHERE n > 1) AS repeated_pairs, {r('1 - count(*) / sum(n)')} AS surplus_rate,
{r('coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)')} AS repeated_row_rate, max(n) AS max_multiplicity FROM c GROUP BY is_real""")
def repeated_pair_statistics(t: Tables):
    out = ct.repeated_pair_statistics(t.spine, ["customer_id", "product_id"], ["is_real"])
    return out.withColumns({c: r6(F.col(c)) for c in ("surplus_rate", "repeated_row_rate")})


@query("D4", f"""WITH {SPINE} SELECT n AS multiplicity, count(*) AS pairs FROM (SELECT count(*) AS n FROM spine GROUP BY customer_id, product_id) GROUP BY n""")
def pair_multiplicity_histogram(t: Tables):
    return ct.multiplicity_histogram(t.spine, ["customer_id", "product_id"])


@query("D4 F3", f"""WITH {SPINE} SELECT customer_id, product_id, count(*) AS n FROM spine GROUP BY ALL ORDER BY n DESC, customer_id, product_id LIMIT 20""")
def top_repeated_pairs(t: Tables):
    return ct.top_pairs(t.spine, ["customer_id", "product_id"], 20)


@query("D5", f"""WITH {SPINE} SELECT 'week' AS grain, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, count(*) AS n FROM spine GROUP BY 2
UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM spine GROUP BY 2""")
def counts_by_week_and_month(t: Tables):
    w = ct.counts_by_period(t.spine, "ts", "week").select(F.lit("week").alias("grain"), "period", "n")
    return w.unionByName(ct.counts_by_period(t.spine, "ts", "month").select(F.lit("month").alias("grain"), "period", "n"))


@query("D6 A18", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT customer_block, product_block, day, count(*) AS n, strftime(day, '%Y-%m') AS gate FROM blocked GROUP BY ALL""")
def block_pair_day_cells(t: Tables):
    return ct.cell_counts(blocked(t))


@query("D7", f"""WITH {BLOCK_MAPS}, s AS (SELECT count(*) AS size FROM cb GROUP BY customer_block) {sp.rows_sql('s', {
    'customer_block_count': 'count(*)', 'customer_block_size_min': 'min(size)', 'customer_block_size_max': 'max(size)', 'customer_block_size_median': r('quantile_cont(size, 0.5)')})}""")
def customer_block_overview(t: Tables):
    return rounded(ct.block_overview(t.customer_blocks, "customer_block"))


@query("D8", f"""WITH {SPINE}, lv AS (SELECT unnest([5, 10]) AS level, customer_id, product_id FROM spine),
c AS (SELECT level, customer_id % level AS customer_block, product_id % level AS product_block, count(*) AS n FROM lv GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, customer_block, product_block) AS i FROM c)
SELECT level, count(*) AS pairs, min(n) AS min_cell, {r('avg(n)')} AS mean_cell, max(n) AS max_cell, {r('max(n) / sum(n)')} AS largest_share,
{r('sum(n) FILTER (WHERE i <= 10) / sum(n)')} AS top10_share, {r('quantile_cont(n, 0.5)')} AS median_cell FROM k GROUP BY level""")
def block_pair_concentration_by_level(t: Tables):
    lv = t.spine.select(F.explode(F.array(F.lit(5), F.lit(10))).alias("level"), "customer_id", "product_id")
    df = lv.select("level", (F.col("customer_id") % F.col("level")).alias("customer_block"), (F.col("product_id") % F.col("level")).alias("product_block"))
    out = ct.block_pair_concentration(df, ["level"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_cell", "largest_share", "top10_share", "median_cell")})


@query("D9", f"""WITH {SPINE}, e AS (SELECT DISTINCT customer_id, product_id FROM spine), o AS (SELECT customer_id, count(*) AS out_degree FROM e GROUP BY 1),
i AS (SELECT product_id, count(*) AS in_degree FROM e GROUP BY 1) SELECT out_degree, in_degree, count(*) AS edges FROM e JOIN o USING (customer_id) JOIN i USING (product_id) GROUP BY ALL""")
def joint_degree_matrix(t: Tables):
    edges = t.spine.select("customer_id", "product_id").distinct()
    return ct.joint_degree_matrix(edges, "customer_id", "product_id")


@query("G2", f"WITH {SPINE} SELECT DISTINCT customer_id, product_id FROM spine")
def distinct_pairs(t: Tables):
    return t.spine.select("customer_id", "product_id").distinct()


@query("D11", f"""WITH {SPINE}, lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM spine), x AS (SELECT customer_id, strftime(ts, '%Y-%m') AS m, (epoch_us(ts) - lo) / (hi - lo) AS x, hi - lo AS span FROM spine, lim),
c AS (SELECT customer_id, m, count(*) AS n, min(x) AS first, max(x) AS last, count(*) FILTER (WHERE x <= 0.5) AS early, max(span) AS span FROM x GROUP BY ALL)
SELECT customer_id, CAST(sum(n) AS BIGINT) AS degree, {r('ln(1 + sum(n))')} AS log_degree, {r('min(first)')} AS first, {r('max(last)')} AS last,
{r('(max(last) - min(first)) * max(span) / 86400e6')} AS span_days, {r('ln(sum(n)) - sum(n * ln(n)) / sum(n)')} AS monthly_entropy,
{r('sum(early) / sum(n)')} AS early_share, {r('1 - sum(early) / sum(n)')} AS late_share FROM c GROUP BY customer_id""")
def customer_structural_features(t: Tables):
    return rounded_columns(ct.structural_features(t.spine, "customer_id", "ts"), ["customer_id", "degree"])


@query("D35 A14", f"""WITH c AS (SELECT * FROM (SELECT 'c_custkey' AS "column", CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL
SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END FROM customer))
SELECT "column", CASE "column" WHEN 'c_custkey' THEN 'bigint' WHEN 'c_nationkey' THEN 'int' ELSE 'string' END AS dtype, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS missing,
count(DISTINCT v) AS "distinct", count(DISTINCT v) = 1 AS constant, count(v) = 0 AS all_missing FROM c GROUP BY "column" """)
def customer_column_profile(t: Tables):
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("c_mktsegment"))
    return pf.column_profile(c)


@query("D36", """WITH k AS (SELECT CASE WHEN l_orderkey % 100 = 0 THEN NULL ELSE l_orderkey END AS o, l_linenumber AS l FROM lineitem),
c AS (SELECT o, l, count(*) AS n FROM k GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE o IS NULL), 0) AS BIGINT) AS null_rows,
CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows FROM c""")
def order_line_key_report(t: Tables):
    k = t.lineitem.select(F.when(F.col("l_orderkey") % 100 != 0, F.col("l_orderkey")).alias("o"), F.col("l_linenumber").alias("l"))
    return pf.primary_key_report(k, ["o", "l"])


@query("C3", f"""WITH c AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k FROM orders), p AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT count(*) AS rows, count(k) AS non_null_rows, count(*) FILTER (WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM p)) AS invalid,
{r('1 - count(*) FILTER (WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM p)) / count(*)')} AS valid_rate FROM c""")
def customer_key_validity(t: Tables):
    child = t.orders.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("k"))
    out = pf.foreign_key_report(child, t.customer.where("c_acctbal > 0"), "k", "c_custkey")
    return out.withColumn("valid_rate", r6(F.col("valid_rate")))


@query("A14", f"""WITH {SPINE}, s AS (SELECT customer_id, product_id, ts, price, flag FROM spine) {sp.rows_sql('s', {'rows': 'count(*)', **{f'nulls_{c}': f'count(*) - count({c})' for c in
('customer_id', 'product_id', 'ts', 'price', 'flag')}, 'first_day': "min(CAST(ts AS DATE) - DATE '1970-01-01')", 'last_day': "max(CAST(ts AS DATE) - DATE '1970-01-01')", 'number_min': r('min(price)'),
'number_mean': r('avg(price)', 4), 'number_max': r('max(price)'), 'active_customers': 'count(DISTINCT customer_id)', 'active_products': 'count(DISTINCT product_id)',
'category_A': "count(*) FILTER (WHERE flag = 'A')", 'category_N': "count(*) FILTER (WHERE flag = 'N')", 'category_R': "count(*) FILTER (WHERE flag = 'R')",
'duplicate_rows': 'count(*) - count(DISTINCT (customer_id, product_id, ts, price, flag))'})}""")
def raw_table_scan(t: Tables):
    s = t.spine.select("customer_id", "product_id", "ts", "price", "flag")
    out = pf.table_scan(s, "ts", {"customers": "customer_id", "products": "product_id"}, "price", "flag")
    return out.select("metric", F.when(F.col("metric") == "number_mean", r6(F.col("value"), 4)).otherwise(r6(F.col("value"))).alias("value"))


@query("A17", f"""WITH h AS (SELECT {hash_sql('row', 'o_orderkey', 'o_custkey', 'o_orderpriority')} AS h FROM orders)
SELECT count(*) AS rows, CAST(sum(h % 2147483648) AS BIGINT) AS low_sum, bit_xor(h) AS xor FROM h""")
def order_fingerprint(t: Tables):
    return pf.fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("D39", f"""WITH {SPINE}, g AS (SELECT product_id, count(*) AS n, avg(quantity) AS m, var_samp(quantity) AS v, sum(quantity) AS s, sum(quantity * quantity) AS q, quantile_cont(quantity, 0.5) AS med
FROM spine GROUP BY 1 HAVING count(*) >= 25), t AS (SELECT *, sum(s) OVER () / sum(n) OVER () AS grand FROM g),
u AS (SELECT count(*) AS entities, sum(n) AS rows, sum(n * (m - grand) * (m - grand)) / sum(n) AS b, sum(v * n) / sum(n) AS w, sum(q) / sum(n) - max(grand) * max(grand) AS tot FROM t)
{sp.rows_sql('u', {'entities': 'entities', 'rows': 'rows', 'between': r('b'), 'within': r('w'), 'explained': r('b / tot'), 'icc': r('b / (b + w)')})} UNION ALL
{sp.rows_sql('g', {f'{n}_{l}': r(f'quantile_cont({c}, {p})') for n, c in (('mean', 'm'), ('median', 'med')) for l, p in (('p5', 0.05), ('median', 0.5), ('p95', 0.95))})}""")
def product_quantity_variance(t: Tables):
    return rounded(pf.entity_variance(t.spine, "product_id", "quantity", 25))


RANKED = """k AS (SELECT quantity, price, flag, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS rq,
rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS rp, count(*) OVER (PARTITION BY quantity) AS ties FROM spine)"""


@query("D40", f"WITH {SPINE}, {RANKED} SELECT {r('corr(rq, rp)')} AS spearman, count(*) AS rows FROM k")
def quantity_price_spearman(t: Tables):
    return rounded_columns(pf.spearman(t.spine, "quantity", "price"), ["rows"])


@query("D40", f"""WITH {SPINE}, {RANKED}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(ties AS DOUBLE) * ties - 1) AS t FROM k),
g AS (SELECT flag, sum(rq) AS rs, count(*) AS c FROM k GROUP BY flag), h AS (SELECT (12.0 / (n * (n + 1)) * sum(rs * rs / c) - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, count(*) AS k, n FROM g, n GROUP BY n, t)
SELECT {r('h', 4)} AS h, k AS groups, {r('greatest((h - k + 1) / (n - k), 0)')} AS epsilon_squared FROM h""")
def quantity_by_flag_kruskal(t: Tables):
    out = pf.kruskal_wallis(t.spine, "flag", "quantity")
    return out.select(r6(F.col("h"), 4).alias("h"), "groups", r6(F.col("epsilon_squared")).alias("epsilon_squared"))


@query("D40", f"""WITH {SPINE}, a AS (SELECT quantity, floor((sum(count(*)) OVER (ORDER BY quantity) - count(*)) * 16 / (SELECT count(*) FROM spine)) AS bx FROM spine GROUP BY 1),
b AS (SELECT discount, floor((sum(count(*)) OVER (ORDER BY discount) - count(*)) * 16 / (SELECT count(*) FROM spine)) AS bd FROM spine GROUP BY 1),
c AS (SELECT bx, bd, count(*) AS n FROM spine JOIN a USING (quantity) JOIN b USING (discount) GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY bd) AS ny, sum(n) OVER () AS t FROM c)
SELECT {r('sum(n / t * ln(n * t / (nx * ny)))')} AS mutual_information FROM m""")
def quantity_discount_mutual_information(t: Tables):
    return rounded_columns(pf.binned_mutual_information(t.spine, "quantity", "discount"))


@query("D41 H3", f"""WITH {TEXTS}, l AS (SELECT unnest(['token', 'word', 'char']) AS unit, unnest([len({tokens_sql('text')}), len({words_sql('text')}), length({squeeze_sql('text')})]) AS len FROM texts),
s AS (SELECT unit, avg(len) AS mean, stddev_samp(len) AS std, min(len) AS min, max(len) AS max, avg(CASE WHEN len = 0 THEN 1.0 ELSE 0.0 END) AS e,
quantile_cont(len, [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM l GROUP BY unit)
SELECT unit, unnest(['mean', 'std', 'min', 'max', 'empty_share', 'p5', 'p25', 'median', 'p75', 'p90', 'p95', 'p99', 'iqr']) AS statistic,
unnest([{', '.join(r(x) for x in ('mean', 'std', 'min', 'max', 'e', *[f'q[{i}]' for i in range(1, 8)], 'q[4] - q[2]'))}]) AS value FROM s""")
def text_length_statistics(t: Tables):
    out = pf.length_statistics(t.texts, "text")
    return out.select("unit", "statistic", r6(F.col("value")).alias("value"))


@query("D42", f"""WITH {SPINE}, run AS (SELECT flag AS metric, year(day) AS seed, avg(quantity) AS v FROM spine GROUP BY ALL)
SELECT metric, count(*) AS runs, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*))')} AS low,
{r('avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*))')} AS high FROM run GROUP BY metric""")
def multi_run_summary(t: Tables):
    runs = t.spine.groupBy(F.col("flag").alias("metric"), F.year("day").alias("seed")).agg(F.avg("quantity").alias("v"))
    return rounded_columns(pf.multi_run_summary(runs, ["metric"], "v"), ["metric", "runs"])


@query("D43", f"""WITH {SPINE}, m AS (SELECT priority AS method, 'quantity' AS metric, avg(quantity) AS v, true AS up FROM spine GROUP BY 1 UNION ALL
SELECT priority, 'discount', avg(discount), false FROM spine GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN up THEN -v ELSE v END, method) AS i FROM m)
SELECT metric, method AS best_method, {r('v')} AS value FROM k WHERE i = 1""")
def method_leaderboard(t: Tables):
    m = t.spine.groupBy(F.col("priority").alias("method")).agg(F.avg("quantity").alias("quantity"), F.avg("discount").alias("discount"))
    long = m.select("method", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("quantity", "discount")])))
    return rounded_columns(pf.leaderboard(long, "method", {"quantity": True, "discount": False}), ["metric", "best_method"])


@query("D44", f"""WITH {SPINE} SELECT flag AS "group", count(price) AS rows, {r('avg(price)', 4)} AS mean, {r('quantile_cont(price, 0.5)', 4)} AS median, {r('quantile_cont(price, 0.95)', 4)} AS p95 FROM spine GROUP BY 1
UNION ALL SELECT strftime(ts, '%Y-%m'), count(price), {r('avg(price)', 4)}, {r('quantile_cont(price, 0.5)', 4)}, {r('quantile_cont(price, 0.95)', 4)} FROM spine GROUP BY 1""")
def price_by_category_and_month(t: Tables):
    s = t.spine.select("price", F.inline(F.array(F.struct(F.col("flag").alias("group")), F.struct(F.date_format("ts", "yyyy-MM").alias("group")))))
    out = pf.numeric_by_group(s, "group", "price")
    return out.select("group", "rows", *[r6(F.col(c), 4).alias(c) for c in ("mean", "median", "p95")])


@query("D44 E9", f"""WITH {SPINE}, b AS (SELECT product_id, 'q' || CAST(greatest(0, CAST(ceil((row_number() OVER (ORDER BY count(*), product_id) - 1) * 5 / (count(*) OVER () - 1)) AS BIGINT) - 1) + 1 AS VARCHAR) AS bucket
FROM spine GROUP BY 1) SELECT bucket, count(price) AS rows, {r('avg(price)', 4)} AS mean, {r('quantile_cont(price, 0.5)', 4)} AS median, {r('quantile_cont(price, 0.95)', 4)} AS p95 FROM spine JOIN b USING (product_id) GROUP BY bucket""")
def price_by_popularity_bucket(t: Tables):
    from chronoweave.operators.splits import frequency_buckets

    b = frequency_buckets(ct.degrees(t.spine, "product_id", "n"), "product_id", 5, "q").select("product_id", "bucket")
    out = pf.numeric_by_group(t.spine.join(b, "product_id"), "bucket", "price")
    return out.select("bucket", "rows", *[r6(F.col(c), 4).alias(c) for c in ("mean", "median", "p95")])


@query("D45", f"""WITH {SPINE}, l AS (SELECT min(price) AS lo, max(price) AS hi FROM spine), c AS (SELECT CAST(least(floor((price - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM spine, l GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, {r('lo + i * (hi - lo) / 20')} AS left_edge, coalesce(n, 0) AS n FROM range(20) x(i) LEFT JOIN c ON c.bin = i, l""")
def price_histogram(t: Tables):
    return ct.histogram(t.spine, "price").select("bin", r6(F.col("left_edge")).alias("left_edge"), "n")


@query("F2", f"""WITH {SPINE}, a AS (SELECT product_id FROM real GROUP BY 1 ORDER BY count(*) DESC, product_id LIMIT 100), b AS (SELECT product_id FROM synthetic GROUP BY 1 ORDER BY count(*) DESC, product_id LIMIT 100)
SELECT {r('(SELECT count(*) FROM a JOIN b USING (product_id)) / 100')} AS top100_overlap""")
def top_product_overlap(t: Tables):
    a, b = (ct.top_entities(df, "product_id", 100).select("product_id") for df in (t.real, t.synthetic))
    return a.join(b, "product_id").agg(r6(F.count(F.lit(1)) / 100).alias("top100_overlap"))


@query("F3", f"""WITH {TEXTS} SELECT md5({squeeze_sql('text')}) AS digest, count(*) AS n FROM texts GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, digest LIMIT 20""")
def most_repeated_texts(t: Tables):
    from chronoweave.functions import text as tx

    d = t.texts.groupBy(F.md5(tx.squeeze("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") > 1).orderBy(F.desc("n"), "digest").limit(20)


@query("G3", f"""WITH {SPINE} SELECT DISTINCT quantity FROM synthetic WHERE product_id < 5 AND quantity NOT IN (SELECT quantity FROM real WHERE product_id < 5)""")
def unseen_domain_values(t: Tables):
    few = F.col("product_id") < 5
    return t.synthetic.where(few).select("quantity").distinct().join(t.real.where(few).select("quantity").distinct(), "quantity", "left_anti")


@query("I56 D48", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, c AS (SELECT count(*) AS n FROM blocked GROUP BY customer_block, product_block, day) {sp.rows_sql('c', {
'cells': 'count(*)', 'events': 'sum(n)', 'mean': r('avg(n)'), 'max': 'max(n)', 'cells_above_limit': r('avg(CASE WHEN n > 3 THEN 1.0 ELSE 0.0 END)'),
'events_above_limit': r('coalesce(sum(n) FILTER (WHERE n > 3), 0) / sum(n)'), 'p95': r('quantile_cont(n, 0.95)'), 'p99': r('quantile_cont(n, 0.99)')})}""")
def cell_size_statistics(t: Tables):
    return rounded(ct.cell_size_statistics(ct.cell_counts(blocked(t)), 3))


@query("D34", f"""WITH {SPINE}, c AS (SELECT quantity, count(*) AS n FROM spine GROUP BY 1), w AS (SELECT *, 1.0 / n AS a, 1 / sqrt(n) AS b, 0.001 / (1 - pow(0.999, n)) AS e FROM c)
SELECT quantity, n, {r('greatest(least(a / avg(a) OVER (), 20), 0.05)')} AS inverse, {r('greatest(least(b / avg(b) OVER (), 20), 0.05)')} AS inverse_sqrt,
{r('greatest(least(e / avg(e) OVER (), 20), 0.05)')} AS effective_number FROM w""")
def quantity_class_weights(t: Tables):
    c = t.spine.groupBy("quantity").agg(F.count(F.lit(1)).alias("n"))
    return rounded_columns(pf.support_class_weights(c), ["quantity", "n"])


@query("D47", f"""WITH {SPINE}, c AS (SELECT flag AS "class", count(*) AS n, sum(count(*)) OVER () AS t FROM spine GROUP BY 1), w AS (SELECT *, sqrt(t / n) AS w FROM c)
SELECT "class", n, {r('least(greatest(w / avg(w) OVER (), 0.5), 5)')} AS weight FROM w UNION ALL SELECT 'X', 0, 5.0""")
def flag_balance_weights(t: Tables):
    return rounded_columns(pf.class_balance_weights(t.spine, "flag", ["A", "N", "R", "X"]), ["class", "n"])
