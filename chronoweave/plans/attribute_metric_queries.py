"""Attribute and text fidelity on the two halves of the order lines, user events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.kernels import materialize, r6
from chronoweave.operators import attribute_metrics as am
from chronoweave.operators import gram_index as gi
from chronoweave.operators import text_metrics as tm
from chronoweave.plans import sql_parts as sp
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import rounded, rounded_columns
from chronoweave.plans.tables import ACTIONS, SPINE, TEXTS, Tables, corr_sql, r
from chronoweave.plans.text_queries import LEXICON, copy_sql, squeeze_sql, tokens_sql

MEANS = "{n} AS (SELECT {k}, count({v}) FILTER (WHERE is_real) AS rn, count({v}) FILTER (WHERE NOT is_real) AS sn, avg({v}) FILTER (WHERE is_real) AS rm, avg({v}) FILTER (WHERE NOT is_real) AS sm FROM spine GROUP BY {k})"


@query("I25", f"""WITH {SPINE}, {MEANS.format(n='m', k='product_id', v='rating')}, k AS (SELECT * FROM m WHERE rm IS NOT NULL AND sm IS NOT NULL)
SELECT {r(corr_sql('rm', 'sm'))} AS corr, {r('avg(abs(rm - sm))')} AS mae, {r('sum(abs(rm - sm) * rn) / sum(rn)')} AS weighted_mae, count(*) AS groups FROM k""")
def product_mean_agreement(t: Tables):
    return rounded_columns(am.group_mean_agreement(t.spine, ["product_id"], "rating"), ["groups"])


@query("I26", f"""WITH {SPINE}, m AS (SELECT is_real, customer_id, round(avg(rating), 12) AS m FROM spine GROUP BY ALL) {sp.rows_sql('m', {'real_variance': r('var_pop(m) FILTER (WHERE is_real)'),
'synthetic_variance': r('var_pop(m) FILTER (WHERE NOT is_real)'), 'variance_ratio': r('var_pop(m) FILTER (WHERE NOT is_real) / var_pop(m) FILTER (WHERE is_real)')})} UNION ALL SELECT 'distribution_ks', ks FROM ({sp.ks_sql('m', 'm')})""")
def customer_mean_distribution(t: Tables):
    return rounded(am.entity_mean_distribution(t.spine, "customer_id", "rating"))


@query("I27", f"WITH {SPINE}, g AS (SELECT is_real, product_id, count(*) AS d, avg(rating) AS m FROM spine GROUP BY ALL) SELECT is_real, {r(corr_sql('d', 'm'))} AS corr FROM g GROUP BY is_real")
def rating_degree_correlation(t: Tables):
    return rounded_columns(am.value_degree_corr(t.spine, "product_id", "rating"), ["is_real"])


JS2 = "sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2"
MONTHLY = f"""mo AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM spine), js AS (SELECT month, {JS2} AS js FROM {sp.shares_sql('mo', ['rating'], ['month'])} GROUP BY month),
mt AS (SELECT month, count(*) FILTER (WHERE is_real) AS n_real, avg(rating) FILTER (WHERE is_real) AS mean_real, avg(verified) FILTER (WHERE is_real) AS rate_real,
count(*) FILTER (WHERE NOT is_real) AS n_synthetic, avg(rating) FILTER (WHERE NOT is_real) AS mean_synthetic, avg(verified) FILTER (WHERE NOT is_real) AS rate_synthetic FROM mo GROUP BY month)"""


@query("I28", f"""WITH {SPINE}, {MONTHLY} SELECT month, n_real, {r('mean_real')} AS mean_real, {r('rate_real')} AS rate_real, n_synthetic, {r('mean_synthetic')} AS mean_synthetic, {r('rate_synthetic')} AS rate_synthetic,
{r('CASE WHEN n_real > 0 AND n_synthetic > 0 THEN js END')} AS js, {r('abs(mean_synthetic - mean_real)')} AS mean_error, {r('abs(rate_synthetic - rate_real)')} AS rate_error FROM mt JOIN js USING (month)""")
def monthly_attribute_table(t: Tables):
    m = t.spine.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return rounded_columns(am.monthly_table(m, "month", "rating", "verified"), ["month", "n_real", "n_synthetic"])


@query("I28", f"""WITH {SPINE}, {MONTHLY}, k AS (SELECT * FROM mt WHERE mean_real IS NOT NULL AND mean_synthetic IS NOT NULL) {" UNION ALL ".join(sp.rows_sql('k', {
f'{n}_corr': r(corr_sql(f'{n}_real', f'{n}_synthetic')), f'{n}_mae': r(f'avg(abs({n}_real - {n}_synthetic))'), f'{n}_rmse': r(f'sqrt(avg(pow({n}_real - {n}_synthetic, 2)))'), f'{n}_real_std': r(f'stddev_samp({n}_real)'),
f'{n}_synthetic_std': r(f'stddev_samp({n}_synthetic)'), f'{n}_variance_ratio': r(f'var_pop({n}_synthetic) / var_pop({n}_real)')}) for n in ('mean', 'rate'))} UNION ALL SELECT 'js_mean', {r('avg(js)')} FROM js JOIN mt USING (month) WHERE n_real > 0 AND n_synthetic > 0""")
def monthly_attribute_summary(t: Tables):
    m = t.spine.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return rounded(am.monthly_summary(am.monthly_table(m, "month", "rating", "verified")))


@query("I29", f"""WITH {SPINE}, c AS (SELECT rating, verified, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY ALL), t AS (SELECT sum(rn) AS rt, sum(sn) AS st FROM c), k AS (SELECT * FROM c WHERE rating <= 5),
v AS (SELECT rating, sum(rn) FILTER (WHERE verified = 1) / sum(rn) AS a, sum(sn) FILTER (WHERE verified = 1) / sum(sn) AS b FROM k GROUP BY 1), g AS (SELECT *, rn / sum(rn) OVER (PARTITION BY verified) AS p, sn / sum(sn) OVER (PARTITION BY verified) AS q FROM k)
SELECT 'joint_l1' AS metric, {r('sum(abs(rn / rt - sn / st))')} AS value FROM k, t UNION ALL SELECT 'flag_rate_by_value_mae', {r('avg(abs(a - b))')} FROM v UNION ALL SELECT 'value_given_flag_l1', {r('sum(abs(p - q))')} FROM g""")
def joint_rating_flag_error(t: Tables):
    return rounded(am.joint_categories(t.spine, "rating", "verified", [1, 2, 3, 4, 5]))


@query("I30", f"""WITH {SPINE}, {sp.grid_ranked_cte('spine', 'quantity')}, q AS (SELECT quantile_cont(quantity, [0.05, 0.25, 0.5, 0.75, 0.95]) FILTER (WHERE is_real) AS a, quantile_cont(quantity, [0.05, 0.25, 0.5, 0.75, 0.95]) FILTER (WHERE NOT is_real) AS b FROM spine),
l AS (SELECT min(quantity) AS lo, max(quantity) AS hi FROM real), s AS (SELECT * FROM {sp.shares_sql('spine', ['quantity'])})
{sp.rows_sql('spine, l', {'real_mean': r('avg(quantity) FILTER (WHERE is_real)'), 'synthetic_mean': r('avg(quantity) FILTER (WHERE NOT is_real)'), 'real_std': r('stddev_samp(quantity) FILTER (WHERE is_real)'), 'synthetic_std': r('stddev_samp(quantity) FILTER (WHERE NOT is_real)'),
'out_of_range_rate': r('avg(CASE WHEN quantity < lo OR quantity > hi THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT is_real)'), 'synthetic_missing_rate': '0.0'})} UNION ALL
SELECT 'quantile_mae', {r('(abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3]) + abs(a[4] - b[4]) + abs(a[5] - b[5])) / 5')} FROM q UNION ALL
{sp.rows_sql('s', {'support_tv': r('sum(abs(p - q)) / 2'), 'support_overlap': r('sum(q) FILTER (WHERE rn > 0)'), 'real_unique_ratio': r('count(*) FILTER (WHERE rn > 0) / sum(rn)'), 'synthetic_unique_ratio': r('count(*) FILTER (WHERE sn > 0) / sum(sn)')})}
UNION ALL SELECT 'ks', ks FROM ({sp.ks_sql('spine', 'quantity')}) UNION ALL SELECT 'wasserstein', wasserstein FROM ({sp.grid_sql('spine', 'quantity')})""")
def quantity_attribute_report(t: Tables):
    return rounded(am.numeric_report(t.spine, "quantity", "event_id"))


@query("I31", f"""WITH {ACTIONS}, c AS (SELECT is_real, event_type || '-' || CAST(floor(value / 60) AS BIGINT) AS k FROM actions), s AS (SELECT * FROM {sp.shares_sql('c', ['k'])}), t AS (SELECT greatest(5, 0.01 * sum(rn)) AS cut FROM s)
{sp.rows_sql('s, t', {'tv': r('sum(abs(p - q)) / 2'), 'invalid_rate': r('coalesce(sum(q) FILTER (WHERE rn = 0), 0)'), 'rare_categories': 'count(*) FILTER (WHERE rn > 0 AND rn <= cut)',
'rare_coverage': r('count(*) FILTER (WHERE rn > 0 AND rn <= cut AND sn > 0) / count(*) FILTER (WHERE rn > 0 AND rn <= cut)'), 'js_distance': r(f'sqrt(greatest({JS2}, 0))')})}""")
def event_category_report(t: Tables):
    c = t.actions.select("is_real", F.concat_ws("-", "event_type", F.floor(F.col("value") / 60).cast("string")).alias("k"))
    return rounded(am.categorical_report(c, "k"))


@query("I32", f"""WITH {SPINE}, mo AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM spine), m AS (SELECT month, avg(quantity) FILTER (WHERE is_real) AS a, avg(quantity) FILTER (WHERE NOT is_real) AS b FROM mo GROUP BY 1), d AS (SELECT stddev_samp(quantity) AS d FROM real)
SELECT count(*) AS groups, {r('avg(abs(a - b))')} AS mae, {r('avg(abs(a - b)) / max(d)')} AS standardized_mae FROM m, d WHERE a IS NOT NULL AND b IS NOT NULL""")
def quantity_given_month(t: Tables):
    return rounded_columns(am.conditional_numeric(t.spine.withColumn("month", F.date_format("ts", "yyyy-MM")), "month", "quantity"), ["groups"])


@query("I32", f"""WITH {SPINE}, p AS (SELECT product_id, sum(abs(p - q)) / 2 AS tv, sum(rn) AS rn, sum(sn) AS sn FROM {sp.shares_sql('spine', ['flag'], ['product_id'])} GROUP BY 1)
SELECT count(*) AS groups, {r('sum(tv * rn) / sum(rn)')} AS weighted_tv FROM p WHERE rn >= 2 AND sn > 0""")
def flag_given_product(t: Tables):
    return rounded_columns(am.conditional_categorical(t.spine, "product_id", "flag"), ["groups"])


@query("I33", f"""WITH {SPINE}, {MEANS.format(n='m', k='product_id', v='quantity')}, k AS (SELECT * FROM m WHERE rn >= 1 AND sn >= 1), q AS (SELECT product_id, quantile_cont(quantity, [0.25, 0.5, 0.75]) FILTER (WHERE is_real) AS a, quantile_cont(quantity, [0.25, 0.5, 0.75]) FILTER (WHERE NOT is_real) AS b FROM spine GROUP BY 1),
c AS (SELECT product_id, quantity, count(*) FILTER (WHERE is_real) AS r, count(*) FILTER (WHERE NOT is_real) AS s FROM spine GROUP BY ALL), o AS (SELECT product_id, max_by(quantity, r * 1000 - quantity) AS rm, max_by(quantity, s * 1000 - quantity) AS sm, max(r) AS mr, max(s) AS ms FROM c GROUP BY 1)
SELECT 'entities' AS metric, CAST(count(*) AS DOUBLE) AS value FROM k UNION ALL SELECT 'weighted_mean_mae', {r('sum(abs(rm - sm) * rn) / sum(rn)')} FROM k UNION ALL
SELECT 'weighted_quantile_mae', {r('sum((abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 3 * rn) / sum(rn)')} FROM q JOIN k USING (product_id) UNION ALL
SELECT 'seen_pair_rate', {r('sum(s) FILTER (WHERE r > 0) / sum(s)')} FROM c UNION ALL SELECT 'mode_match_rate', {r('avg(CASE WHEN rm = sm THEN 1.0 ELSE 0.0 END)')} FROM o WHERE mr > 0 AND ms > 0""")
def product_quantity_report(t: Tables):
    return rounded(am.entity_numeric_report(t.spine, "product_id", "quantity"))


@query("I34", f"""WITH {SPINE}, g AS (SELECT customer_id, year(ts) AS y, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn, avg(quantity) FILTER (WHERE is_real) AS a, avg(quantity) FILTER (WHERE NOT is_real) AS b FROM spine GROUP BY ALL)
SELECT count(*) AS cells, {r('sum(abs(a - b) * rn) / sum(rn)')} AS weighted_mae FROM g WHERE rn >= 2 AND sn >= 2""")
def customer_year_error(t: Tables):
    return rounded_columns(am.entity_time_error(t.spine.withColumn("y", F.year("ts")), "customer_id", "y", "quantity"), ["cells"])


ENT = "-sum(CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END)"


@query("I35", f"""WITH {SPINE}, {MEANS.format(n='m', k='customer_id', v='rating')}, k AS (SELECT *, abs(rm - sm) AS gap FROM m WHERE rn > 0 AND sn > 0), top AS (SELECT * FROM m WHERE rn > 0 ORDER BY rn DESC, customer_id LIMIT 1000),
s AS (SELECT customer_id, sum(abs(p - q)) / 2 AS tv, abs(({ENT.format(c='p')}) - ({ENT.format(c='q')})) AS e FROM {sp.shares_sql('spine', ['rating'], ['customer_id'])} GROUP BY 1 HAVING sum(rn) > 0 AND sum(sn) > 0)
{sp.rows_sql('k', {'common_entities': 'count(*)', 'mean_mae': r('avg(gap)'), 'weighted_mae': r('sum(gap * rn) / sum(rn)'), 'mae_activity_1': r('avg(gap) FILTER (WHERE rn = 1)'), 'mae_activity_2-4': r('avg(gap) FILTER (WHERE rn BETWEEN 2 AND 4)'),
'mae_activity_5-9': r('avg(gap) FILTER (WHERE rn BETWEEN 5 AND 9)'), 'mae_activity_10+': r('avg(gap) FILTER (WHERE rn >= 10)')})} UNION ALL SELECT 'top_mae', {r('avg(abs(rm - sm))')} FROM top WHERE sn > 0
UNION ALL {sp.rows_sql('s', {'distribution_tv_mean': r('avg(tv)'), 'entropy_gap_mean': r('avg(e)')})}""")
def customer_rating_diagnostics(t: Tables):
    return rounded(am.entity_rating_metrics(t.spine, "customer_id", "rating"))


@query("E16", f"""WITH {SPINE}, top AS (SELECT product_id FROM real GROUP BY 1 ORDER BY count(*) DESC, product_id LIMIT 20), c AS (SELECT is_real, product_id, (year(ts) - 1970) * 12 + month(ts) - 1 AS m, count(*) AS n FROM spine WHERE product_id IN (SELECT product_id FROM top) GROUP BY ALL),
g AS (SELECT DISTINCT product_id, unnest(range(a, b + 1)) AS m FROM (SELECT is_real, product_id, min(m) AS a, max(m) AS b FROM c GROUP BY ALL)), w AS (SELECT product_id, m, sum(n) FILTER (WHERE is_real) AS rn, sum(n) FILTER (WHERE NOT is_real) AS sn FROM c GROUP BY ALL),
f AS (SELECT product_id, coalesce(rn, 0) AS rn, coalesce(sn, 0) AS sn FROM g LEFT JOIN w USING (product_id, m)), p AS (SELECT product_id, {corr_sql("rn", "sn")} AS c, max(sn) AS seen FROM f GROUP BY 1)
SELECT {r('avg(c)')} AS mean_corr, count(c) AS entities FROM p WHERE seen > 0""")
def top_product_trajectories(t: Tables):
    return rounded_columns(am.trajectory_correlation(t.spine, "product_id", "ts"), ["entities"])


@query("I41", f"""WITH {SPINE}, c AS (SELECT quantity, flag, status, rating, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn FROM spine GROUP BY ALL)
SELECT {r('sum(sn) FILTER (WHERE rn > 0) / sum(sn)')} AS exact_overlap_rate, {r('coalesce(sum(sn) FILTER (WHERE rn BETWEEN 1 AND 5), 0) / sum(sn)')} AS rare_overlap_rate, count(*) FILTER (WHERE rn > 0) AS real_tuples, count(*) FILTER (WHERE sn > 0) AS synthetic_tuples FROM c""")
def attribute_tuple_copying(t: Tables):
    return rounded_columns(am.tuple_copying(t.spine, ["quantity", "flag", "status", "rating"]), ["real_tuples", "synthetic_tuples"])


@query("I36", f"""WITH {ACTIONS} SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS matched, count(*) FILTER (WHERE event_id % 50 = 0) AS unmatched, count(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 40 = 1) AS different FROM actions""")
def spine_alignment(t: Tables):
    a = t.actions
    b = a.where("event_id % 50 <> 0").withColumn("user_id", F.when(F.col("event_id") % 40 == 1, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return am.alignment(a, b, "event_id", ["user_id", "ts"])


@query("I59", f"""WITH l AS (SELECT event_id, event_type, [value / 100, 2.0::DOUBLE, (event_id % 7) / 2.0] AS l, CAST(event_id % 3 AS INTEGER) AS y FROM events), g AS (SELECT t AS temperature, y, [exp(l[1] / t), exp(l[2] / t), exp(l[3] / t)] AS e FROM l, (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS t)),
p AS (SELECT temperature, y, [e[1] / (e[1] + e[2] + e[3]), e[2] / (e[1] + e[2] + e[3]), e[3] / (e[1] + e[2] + e[3])] AS p FROM g), q AS (SELECT temperature, list_max(p) AS conf, p[y + 1] AS py, CAST(list_position(p, list_max(p)) - 1 = y AS INTEGER) AS hit FROM p),
b AS (SELECT temperature, least(floor(conf * 15), 14) AS bin, count(*) AS n, sum(conf) AS c, sum(hit) AS h, sum(ln(py)) AS ll FROM q GROUP BY ALL)
SELECT temperature, {r('-sum(ll) / sum(n)')} AS nll, {r('sum(h) / sum(n)')} AS accuracy, {r('sum(c) / sum(n)')} AS mean_confidence, {r('sum(abs(c - h)) / sum(n)')} AS ece FROM b GROUP BY temperature""")
def temperature_calibration(t: Tables):
    e = t.events.select(F.array(F.col("value") / 100, F.lit(2.0), (F.col("event_id") % 7) / 2.0).alias("l"), (F.col("event_id") % 3).cast("int").alias("y"))
    return rounded_columns(am.probability_calibration(e, "l", "y", [0.5, 1.0, 2.0]), ["temperature"])


@query("I62", f"""WITH {SPINE}, g AS (SELECT product_id, count(*) AS n, abs(avg(quantity) - avg(rating * 7)) AS e FROM spine GROUP BY 1) SELECT {r('sum(e * n) / sum(n) / 10')} AS weighted_error FROM g""")
def grouped_standardized_error(t: Tables):
    return rounded_columns(am.grouped_standardized_error(t.spine.withColumn("pred", F.col("rating") * 7), "product_id", "quantity", "pred", 10.0))


# --- texts --------------------------------------------------------------------------------------

TK = f"{TEXTS}, tk AS (SELECT doc_id, is_real, lang, {squeeze_sql('text')} AS s, {tokens_sql('text')} AS tokens FROM texts)"


@query("I37", f"""WITH {TK}, g1 AS (SELECT is_real, unnest(tokens) AS g FROM tk), g2 AS (SELECT is_real, unnest(list_transform(range(1, len(tokens)), lambda i: array_to_string(tokens[i:i+1], chr(31)))) AS g FROM tk WHERE len(tokens) >= 2),
g3 AS (SELECT doc_id, is_real, unnest(list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(tokens[i:i+2], chr(31)))) AS g FROM tk WHERE len(tokens) >= 3),
b AS (SELECT is_real, avg(len(tokens)) AS mt, quantile_cont(len(tokens), 0.5) AS md, avg(CASE WHEN s <> '' THEN 1.0 ELSE 0.0 END) AS ne, avg(CASE WHEN contains(s, '[MASK]') OR contains(s, '[PAD]') OR contains(s, '[CLS]') OR contains(s, '[SEP]') THEN 1.0 ELSE 0.0 END) AS sp FROM tk GROUP BY 1),
d1 AS (SELECT is_real, count(DISTINCT g) AS v, count(DISTINCT g) / count(*) AS d FROM g1 GROUP BY 1), d2 AS (SELECT is_real, count(DISTINCT g) / count(*) AS d FROM g2 GROUP BY 1), d3 AS (SELECT is_real, count(DISTINCT g) / count(*) AS d FROM g3 GROUP BY 1),
rp AS (SELECT is_real, sum(c - u) / sum(c) AS rep FROM (SELECT doc_id, is_real, count(*) AS c, count(DISTINCT g) AS u FROM g3 GROUP BY ALL) GROUP BY 1), du AS (SELECT is_real, coalesce(sum(c) FILTER (WHERE c > 1 AND s <> ''), 0) / sum(c) AS dup FROM (SELECT is_real, s, count(*) AS c FROM tk GROUP BY ALL) GROUP BY 1),
a AS (SELECT b.is_real, mt, md, ne, sp, v, d1.d AS a1, d2.d AS a2, d3.d AS a3, rep, dup FROM b JOIN d1 USING (is_real) JOIN d2 USING (is_real) JOIN d3 USING (is_real) JOIN rp USING (is_real) JOIN du USING (is_real))
SELECT CASE WHEN is_real THEN 'real' ELSE 'synthetic' END AS side, unnest(['mean_tokens', 'median_tokens', 'non_empty_rate', 'special_token_rate', 'vocabulary', 'distinct_1', 'distinct_2', 'distinct_3', 'repeated_3gram_rate', 'duplicate_rate']) AS metric,
unnest([{', '.join(r(x) for x in ('mt', 'md', 'ne', 'sp', 'v', 'a1', 'a2', 'a3', 'rep', 'dup'))}]) AS value FROM a""")
def lexical_text_metrics(t: Tables):
    out = tm.lexical_report(t.texts, "text")
    return out.select("side", "metric", r6(F.col("value")).alias("value"))


@query("I37 I52", f"WITH {TK}, n AS (SELECT is_real, len(tokens) AS n FROM tk) {sp.ks_sql('n', 'n')}")
def text_length_ks(t: Tables):
    return rounded_columns(tm.length_ks(t.texts, "text").select("ks"))


@query("I39", f"""WITH {TEXTS}, b AS (SELECT is_real, {squeeze_sql('text')} AS e, {copy_sql('text')} AS m, len({tokens_sql('text')}) AS n FROM texts), h AS (SELECT e <> '' AND e IN (SELECT e FROM b WHERE is_real) AS eh, m <> '' AND m IN (SELECT m FROM b WHERE is_real) AS mh,
CASE WHEN n <= 2 THEN 'length_le_2' WHEN n <= 5 THEN 'length_3_to_5' WHEN n <= 10 THEN 'length_6_to_10' ELSE 'length_gt_10' END AS bucket FROM b WHERE NOT is_real)
SELECT 'exact_copy_rate' AS metric, {r('avg(CAST(eh AS INTEGER))')} AS value FROM h UNION ALL SELECT 'normalized_copy_rate', {r('avg(CAST(mh AS INTEGER))')} FROM h UNION ALL SELECT 'normalized_copy_rate_' || bucket, {r('avg(CAST(mh AS INTEGER))')} FROM h GROUP BY bucket""")
def text_copy_rates(t: Tables):
    return rounded(tm.copy_report(t.texts, "text"))


@query("I39 H4", f"""WITH {TK}, g AS (SELECT is_real, unnest(list_transform(range(1, len(tokens) - 3), lambda i: array_to_string(tokens[i:i+4], chr(31)))) AS g FROM tk WHERE len(tokens) >= 5), c AS (SELECT g, count(*) FILTER (WHERE is_real) AS r, count(*) FILTER (WHERE NOT is_real) AS s FROM g GROUP BY g)
SELECT {r('sum(s) FILTER (WHERE r > 0) / sum(s)')} AS overlap FROM c""")
def fivegram_overlap(t: Tables):
    return rounded_columns(tm.ngram_overlap(t.texts, "text", 5))


SENT = f"(len(list_filter(tokens, lambda x: list_contains({LEXICON[0]}, x))) - len(list_filter(tokens, lambda x: list_contains({LEXICON[1]}, x)))) / len(tokens)"


@query("I38 H7", f"""WITH {TK}, b AS (SELECT is_real, lang, coalesce({SENT}, 0) AS s, len(tokens) AS n FROM tk) SELECT lang, {r('avg(s) FILTER (WHERE is_real)')} AS real_sentiment, {r('avg(s) FILTER (WHERE NOT is_real)')} AS synthetic_sentiment,
{r('avg(n) FILTER (WHERE is_real)')} AS real_length, {r('avg(n) FILTER (WHERE NOT is_real)')} AS synthetic_length FROM b GROUP BY lang""")
def sentiment_by_language(t: Tables):
    return rounded_columns(tm.sentiment_by_group(t.texts, "text", "lang", [*tx.POSITIVE_WORDS, "the"], [*tx.NEGATIVE_WORDS, "to"]), ["lang"])


@query("I38", f"""WITH {TK}, b AS (SELECT is_real, source, coalesce({SENT}, 0) AS s, len(tokens) AS n FROM tk JOIN (SELECT doc_id, source FROM documents) USING (doc_id)), g AS (SELECT source, avg(n) FILTER (WHERE is_real) AS a, avg(n) FILTER (WHERE NOT is_real) AS b, avg(s) FILTER (WHERE NOT is_real) AS c FROM b GROUP BY source)
SELECT {r(corr_sql('a', 'b'))} AS length_corr, {r('stddev_pop(b)')} AS synthetic_length_std, {r('stddev_pop(c)')} AS synthetic_sentiment_std FROM g""")
def text_source_agreement(t: Tables):
    return rounded_columns(tm.length_series_corr(tm.sentiment_by_group(t.texts, "text", "source", [*tx.POSITIVE_WORDS, "the"], [*tx.NEGATIVE_WORDS, "to"])))


@query("I53", f"""WITH a AS (SELECT doc_id, text, CASE doc_id % 10 WHEN 0 THEN text || '  ' WHEN 1 THEN text || ' more' ELSE text END AS other FROM documents), m AS (SELECT text = other AS raw, {squeeze_sql('text')} AS x, {squeeze_sql('other')} AS y FROM a),
bag AS (SELECT x AS d, true AS s FROM m UNION ALL SELECT y, false FROM m), e AS (SELECT count(*) FILTER (WHERE s) = count(*) FILTER (WHERE NOT s) AS eq FROM bag GROUP BY d)
{sp.rows_sql('m', {'rows': 'count(*)', 'identical_raw': r('avg(CAST(raw AS INTEGER))'), 'identical_canonical': r('avg(CAST(x = y AS INTEGER))'), 'left_mean_length': r('avg(length(x))'), 'right_mean_length': r('avg(length(y))')})} UNION ALL SELECT 'same_multiset', CAST(bool_and(eq) AS DOUBLE) FROM e""")
def text_frame_comparison(t: Tables):
    d = t.documents.select("doc_id", "text")
    k = F.col("doc_id") % 10
    other = d.withColumn("text", F.when(k == 0, F.concat("text", F.lit("  "))).when(k == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return rounded(tm.compare_frames(d, other, "doc_id", "text"))


EMB = f"""h AS (SELECT doc_id, is_real, CAST('0x' || substr(md5('bag|' || token), 1, 13) AS BIGINT) AS h FROM (SELECT doc_id, is_real, unnest(tokens) AS token FROM tk)), w AS (SELECT doc_id, is_real, h % 64 AS place, sum(CASE WHEN (h >> 8) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS w FROM h GROUP BY ALL),
e AS (SELECT doc_id, is_real, place, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), 0) AS v FROM w), n AS (SELECT is_real, count(DISTINCT doc_id) AS n FROM e GROUP BY 1)"""


@query("I60", f"""WITH {TK}, {EMB}, c AS (SELECT place, sum(v) FILTER (WHERE is_real) / (SELECT n FROM n WHERE is_real) AS a, sum(v) FILTER (WHERE NOT is_real) / (SELECT n FROM n WHERE NOT is_real) AS b FROM e GROUP BY 1)
SELECT {r('sum(a * b) / sqrt(sum(a * a) * sum(b * b))')} AS center_cosine FROM c""")
def text_embedding_centers(t: Tables):
    return rounded_columns(tm.embedding_centers(t.texts, "doc_id", "text"))


@query("I60 C16", f"""WITH {TK}, {EMB}, d AS (SELECT a.doc_id AS q, b.doc_id AS n, sum(a.v * b.v) AS c FROM e a JOIN e b ON a.place = b.place AND NOT a.is_real AND b.is_real GROUP BY ALL), m AS (SELECT q, max(c) AS c FROM d GROUP BY 1)
SELECT {r('avg(c)')} AS mean_best_cosine, {r('min(c)')} AS min_best_cosine FROM m""")
def closest_text_cosine(t: Tables):
    return rounded_columns(tm.closest_cosine(t.texts, "doc_id", "text"))


def cosine_sql(counts: str, features: int, real: str = "SELECT doc_id FROM texts WHERE is_real", asked: str = "SELECT doc_id FROM texts WHERE NOT is_real", n: str = "") -> str:
    """best{n} (doc_id, neighbor, similarity): all pairs over the fitted grams, from gram counts (doc_id, g, tf)."""
    return f"""rl{n} AS ({real}), vo{n} AS (SELECT g, sum(tf) AS total, count(*) AS df FROM {counts} WHERE doc_id IN (SELECT doc_id FROM rl{n}) GROUP BY g ORDER BY total DESC, g LIMIT {features}),
wt{n} AS (SELECT doc_id, g, tf * (ln((1.0 + (SELECT count(*) FROM rl{n})) / (1 + df)) + 1) AS v FROM {counts} JOIN vo{n} USING (g)), nv{n} AS MATERIALIZED (SELECT doc_id, g, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM wt{n}),
cs{n} AS (SELECT a.doc_id, b.doc_id AS n, sum(a.v * b.v) AS c FROM nv{n} a JOIN nv{n} b USING (g) WHERE a.doc_id IN ({asked}) AND b.doc_id IN (SELECT doc_id FROM rl{n}) GROUP BY ALL),
best{n} AS MATERIALIZED (SELECT t.doc_id, s.n AS neighbor, coalesce(s.c, 0) AS similarity FROM ({asked}) t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 9) DESC, n) AS k FROM cs{n}) WHERE k = 1) s ON t.doc_id = s.doc_id)"""


def char_counts_sql(src: str, n: str = "") -> str:
    """tf{n} (doc_id, g, tf) of rows (doc_id, s)."""
    return f"""wc{n} AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(string_split(lower(s), ' ')) AS w FROM {src}) WHERE w <> '' GROUP BY ALL), dw{n} AS (SELECT w, ' ' || w || ' ' AS p FROM (SELECT DISTINCT w FROM wc{n})),
gr{n} AS (SELECT w, substr(p, i, n) AS g FROM (SELECT w, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM dw{n}, (SELECT unnest([3, 4, 5]) AS n))), pl{n} AS (SELECT w, g, count(*) AS k FROM gr{n} GROUP BY ALL),
tf{n} AS MATERIALIZED (SELECT doc_id, g, sum(c * k) AS tf FROM wc{n} JOIN pl{n} USING (w) GROUP BY ALL)"""


@query("C18 I40", f"WITH {TK}, {char_counts_sql('tk')}, {cosine_sql('tf', 50_000)} SELECT doc_id, neighbor, {r('similarity')} AS similarity FROM best")
def nearest_text_join(t: Tables):
    """Cosine over the 50,000 most frequent character 3- to 5-grams of the real texts; SQL compares all pairs."""
    out = gi.nearest_texts(t.texts, "doc_id", "text")
    return out.select("doc_id", "neighbor", r6(F.col("similarity")).alias("similarity"))


WORD_COUNTS = """ww AS (SELECT doc_id, list_filter(string_split_regex(lower(s), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) >= 2) AS t FROM tk),
wg AS MATERIALIZED (SELECT doc_id, g, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS g FROM ww UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM ww) GROUP BY ALL)"""


@query("C18 I40", f"WITH {TK}, {WORD_COUNTS}, {cosine_sql('wg', 20_000)} SELECT doc_id, neighbor, {r('similarity')} AS similarity FROM best")
def nearest_text_join_by_words(t: Tables):
    """The word form: 20,000 runs of one and two words."""
    out = gi.nearest_texts(t.texts, "doc_id", "text", 20_000, gi.word_grams)
    return out.select("doc_id", "neighbor", r6(F.col("similarity")).alias("similarity"))


@query("I40 H13", f"""WITH {TK}, {char_counts_sql('tk')}, {cosine_sql('tf', 50_000)},
bt AS (SELECT item_id + 10000000 AS doc_id, {squeeze_sql('text')} AS s FROM benchmark UNION ALL SELECT doc_id, s FROM tk WHERE NOT is_real), {char_counts_sql('bt', '2')},
{cosine_sql('tf2', 50_000, 'SELECT doc_id FROM bt WHERE doc_id >= 10000000', 'SELECT doc_id FROM texts WHERE NOT is_real', '2')},
jc AS (SELECT len(list_intersect(list_distinct(a.tokens), list_distinct(b.tokens))) / len(list_distinct(a.tokens || b.tokens)) AS j FROM best JOIN tk a USING (doc_id) JOIN tk b ON b.doc_id = neighbor)
SELECT 'train_mean' AS metric, {r('avg(similarity)')} AS value FROM best UNION ALL SELECT 'train_max', {r('max(similarity)')} FROM best UNION ALL SELECT 'train_p95', {r('quantile_cont(similarity, 0.95)')} FROM best
UNION ALL SELECT 'train_vs_test_gap', {r('(SELECT avg(similarity) FROM best) - (SELECT avg(similarity) FROM best2)')} UNION ALL SELECT 'nearest_jaccard', {r('avg(j)')} FROM jc""")
def nearest_text_privacy(t: Tables):
    """Benchmark passages stand for unseen texts. The line with the longest common subsequence is a query of its own."""
    test = t.benchmark.select((F.col("item_id") + 10_000_000).alias("doc_id"), "text", F.lit("x").alias("lang"), F.lit("benchmark").alias("source"), F.lit(True).alias("is_real"))
    return rounded(tm.nearest_text_privacy(t.texts, "doc_id", "text", test)).where("metric <> 'nearest_rouge_l'")


@query("I40 H13")
def nearest_text_common_subsequence(t: Tables):
    """Longest-common-subsequence F1 with the nearest real text; no SQL form, tested against brute force."""
    pairs = tm.neighbor_tokens(gi.nearest_texts(t.texts, "doc_id", "text"), t.texts, "doc_id", "text")
    return pairs.select("doc_id", "neighbor", tx.rouge_l("a", "b").alias("rouge_l"))


@query("I55 J17", "SELECT unnest(['ks', 'mean_real', 'mean_synthetic', 'median_real', 'median_synthetic']) AS metric, true AS finite")
def dynamic_affinity_diagnostics(t: Tables):
    from chronoweave.operators import spine_generation as sg

    s = materialize(t.spine.select("is_real", "customer_id", "product_id", F.date_format("ts", "yyyy-MM").alias("gate")))
    out = am.affinity_diagnostics(s, sg.affinity_vectors(s.where("is_real")))
    return out.select("metric", (F.col("value").isNotNull() & ~F.isnan("value")).alias("finite"))
