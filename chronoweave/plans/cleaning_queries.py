"""Cleaning and scalar functions on messy cells derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import cleaning as cl
from chronoweave.functions.kernels import r6
from chronoweave.operators import clean as op
from chronoweave.plans.registry import query
from chronoweave.plans.tables import ACTIONS, SPINE, Tables, r

# Messy cells as SQL text that reads the same in both engines.
RAW_FLAG = """CASE order_id % 9 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN 'F' WHEN 3 THEN 'no' WHEN 4 THEN ''
 WHEN 5 THEN '1.0' WHEN 6 THEN 'maybe' WHEN 7 THEN NULL ELSE 'verified' END"""
RAW_NUMBER = """CASE order_id % 5 WHEN 0 THEN CAST(quantity AS {s}) WHEN 1 THEN ' 12 ' WHEN 2 THEN 'abc' WHEN 3 THEN NULL
 ELSE CAST(discount AS {s}) END"""
RAW_RATING = """CASE order_id % 6 WHEN 0 THEN '3.5' WHEN 1 THEN '4.0' WHEN 2 THEN '2.25' WHEN 3 THEN '0' WHEN 4 THEN 'x'
 ELSE CAST(rating AS {s}) END"""
RAW_TIME = """CASE order_id % 4 WHEN 0 THEN 'not a date' WHEN 1 THEN NULL ELSE CAST(day AS {s}) END"""


def raw(t: Tables):
    e = lambda text: F.expr(text.format(s="STRING"))
    return t.spine.select("event_id", "customer_id", "is_real", "rating", "day", "ts", e(RAW_FLAG).alias("raw_flag"), e(RAW_NUMBER).alias("raw_number"),
                          e(RAW_RATING).alias("raw_rating"), e(RAW_TIME).alias("raw_time"))


RAW = f"""WITH {SPINE}, raw AS (SELECT event_id, customer_id, is_real, rating, day, ts, {RAW_FLAG} AS raw_flag, {RAW_NUMBER.format(s='VARCHAR')} AS raw_number,
{RAW_RATING.format(s='VARCHAR')} AS raw_rating, {RAW_TIME.format(s='VARCHAR')} AS raw_time FROM spine)"""
WORD = "lower(trim(raw_flag))"
TRUES, FALSES = "('true','t','yes','y'{x})", "('false','f','no','n'{x})"


@query("B3", f"""{RAW}, v AS (SELECT CASE WHEN raw_flag IS NULL OR trim(raw_flag) = '' THEN '' WHEN regexp_matches(trim(raw_flag), '^[+-]?\\d*\\.0$')
THEN CAST(CAST(trim(raw_flag) AS BIGINT) AS VARCHAR) ELSE trim(raw_flag) END AS flag_text,
CASE WHEN raw_number IS NULL OR trim(raw_number) = '' THEN '' WHEN regexp_matches(trim(raw_number), '^[+-]?\\d*\\.0$')
THEN CAST(CAST(trim(raw_number) AS BIGINT) AS VARCHAR) ELSE trim(raw_number) END AS number_text FROM raw)
SELECT flag_text, number_text, count(*) AS n FROM v GROUP BY ALL""")
def normalized_value_text(t: Tables):
    return raw(t).groupBy(cl.value_text("raw_flag").alias("flag_text"), cl.value_text("raw_number").alias("number_text")).agg(
        F.count(F.lit(1)).alias("n"))


@query("B8", f"""{RAW} SELECT count(TRY_CAST(trim(raw_number) AS DOUBLE)) AS numbers, {r('sum(TRY_CAST(trim(raw_number) AS DOUBLE))', 4)} AS total,
count(TRY_CAST(raw_time AS TIMESTAMP)) AS times, CAST(max(TRY_CAST(raw_time AS TIMESTAMP)) AS DATE) AS latest FROM raw""")
def coerced_cells(t: Tables):
    return raw(t).agg(
        F.count(cl.number("raw_number")).alias("numbers"), r6(F.sum(cl.number("raw_number")), 4).alias("total"),
        F.count(cl.moment("raw_time")).alias("times"), F.max(cl.moment("raw_time")).cast("date").alias("latest"))


@query("B4", f"""{RAW}, c AS (SELECT CASE WHEN raw_flag IS NULL OR trim(raw_flag) = '' THEN NULL WHEN {WORD} IN {TRUES.format(x='')} THEN '1'
WHEN {WORD} IN {FALSES.format(x='')} THEN '0' WHEN TRY_CAST(raw_flag AS DOUBLE) IN (0, 1) THEN CAST(CAST(TRY_CAST(raw_flag AS DOUBLE) AS INTEGER) AS VARCHAR)
ELSE trim(raw_flag) END AS flag_category FROM raw) SELECT flag_category, count(*) AS n FROM c GROUP BY ALL""")
def canonical_flag_categories(t: Tables):
    c = cl.category("raw_flag", cl.CategoryRule("boolean"))
    return raw(t).groupBy(c.alias("flag_category")).agg(F.count(F.lit(1)).alias("n"))


@query("B5", f"""{RAW}, c AS (SELECT is_real, raw_flag AS raw, CASE WHEN raw_flag IS NULL OR trim(raw_flag) = '' THEN NULL WHEN {WORD} IN {TRUES.format(x='')} THEN '1'
WHEN {WORD} IN {FALSES.format(x='')} THEN '0' WHEN TRY_CAST(raw_flag AS DOUBLE) IN (0, 1) THEN CAST(CAST(TRY_CAST(raw_flag AS DOUBLE) AS INTEGER) AS VARCHAR)
ELSE trim(raw_flag) END AS canon, count(*) AS n FROM raw GROUP BY ALL)
SELECT is_real, CAST(coalesce(sum(n) FILTER (WHERE canon IS NOT NULL AND canon NOT IN ('0', '1')), 0) AS BIGINT) AS unmapped,
string_agg(DISTINCT raw, ',' ORDER BY raw) AS raw_values, string_agg(DISTINCT canon, ',' ORDER BY canon) AS canon_values FROM c GROUP BY is_real""")
def canonicalization_diagnostics(t: Tables):
    return op.canonical_diagnostics(raw(t), "raw_flag", cl.CategoryRule("boolean", (0, 1)))


@query("B6", f"""{RAW}, p AS (SELECT TRY_CAST(trim(raw_rating) AS DOUBLE) AS x FROM raw)
SELECT CASE WHEN abs(x * 2 - round_even(x * 2, 0)) <= 1e-8 AND round_even(x * 2, 0) > 0 THEN round_even(x * 2, 0) / 2 END AS rating,
count(*) AS n FROM p GROUP BY ALL""")
def normalized_ratings(t: Tables):
    return raw(t).groupBy(cl.rating("raw_rating").alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@query("B7", f"""{RAW} SELECT raw_flag,
CAST(CASE WHEN raw_flag IS NULL THEN 0 WHEN {WORD} IN {TRUES.format(x=",'1'")} THEN 1 WHEN {WORD} IN {FALSES.format(x=",'0'")} THEN 0
  WHEN raw_flag <> '' THEN 1 ELSE 0 END AS DOUBLE) AS variant_a,
CAST(coalesce({WORD} IN {TRUES.format(x=",'1'")}, false) AS DOUBLE) AS variant_b,
CAST(coalesce(lower(raw_flag) IN ('true','1','yes','y'), false) AS DOUBLE) AS variant_c,
TRY_CAST(raw_flag AS DOUBLE) AS variant_d,
CAST(CASE WHEN {WORD} IN {TRUES.format(x=",'1','1.0','verified'")} THEN 1 WHEN {WORD} IN {FALSES.format(x=",'0','0.0','unverified'")} THEN 0 END AS DOUBLE) AS variant_e,
count(*) AS n FROM raw GROUP BY ALL""")
def binary_flag_variants(t: Tables):
    rows = raw(t)
    any_number = not rows.where(cl.number("raw_flag").isNotNull()).limit(1).isEmpty()
    return rows.groupBy("raw_flag").agg(F.count(F.lit(1)).alias("n")).select(
        "raw_flag", cl.flag_any_text("raw_flag").alias("variant_a"), cl.flag_words("raw_flag").alias("variant_b"),
        cl.flag_strict("raw_flag").alias("variant_c"), cl.flag_numeric_first("raw_flag", any_number).alias("variant_d"),
        cl.flag_or_null("raw_flag").alias("variant_e"), "n")


@query("B1 B2 L2", f"""{RAW} SELECT customer_id, count(*) AS n, {r('sum(x)', 4)} AS total, max(d) AS latest FROM (
SELECT CAST(customer_id AS VARCHAR) AS customer_id, TRY_CAST(trim(raw_number) AS DOUBLE) AS x, CAST(TRY_CAST(raw_time AS TIMESTAMP) AS DATE) AS d FROM raw)
WHERE x IS NOT NULL AND d IS NOT NULL GROUP BY customer_id""")
def normalized_frame(t: Tables):
    roles = op.Roles(foreign_keys=("customer_id",), datetimes=("raw_time",), categoricals=("raw_flag",), numericals=("raw_number",))
    out = op.normalize_frame(raw(t), roles)
    return out.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("raw_number"), 4).alias("total"),
                                          F.max(F.to_date("raw_time")).alias("latest"))


@query("B9", f"""{RAW}, lo AS (SELECT min(TRY_CAST(raw_time AS TIMESTAMP)) AS v FROM raw)
SELECT strftime(coalesce(TRY_CAST(raw_time AS TIMESTAMP), (SELECT v FROM lo)), '%Y-%m') AS bucket, count(*) AS n FROM raw GROUP BY ALL""")
def month_bucket_with_fallback(t: Tables):
    return op.day_or_month(raw(t), "raw_time", "month").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("B10", f"""WITH {SPINE} SELECT level, bucket, count(*) AS n FROM (SELECT unnest(['date', 'year_month', 'month', 'year', 'global', 'legacy']) AS level,
unnest([strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m'), strftime(ts, '%m'), strftime(ts, '%Y'), 'global', strftime(ts, '%m')]) AS bucket FROM spine) GROUP BY ALL""")
def temporal_buckets(t: Tables):
    cells = [F.struct(F.lit(level).alias("level"), cl.time_bucket("ts", level).alias("bucket"))
             for level in ("date", "year_month", "month", "year", "global")]
    cells.append(F.struct(F.lit("legacy").alias("level"), cl.padded_month(F.month("ts")).alias("bucket")))
    return t.spine.select(F.inline(F.array(*cells))).groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n"))


def granularity_sql(table: str, source: str) -> str:
    return f"""SELECT '{source}' AS source, rows, offsets, midnight_share, CASE WHEN midnight_share >= 0.99 THEN 'date_only'
WHEN offsets <= greatest(24, floor(rows * 0.01)) THEN 'empirical_offsets' ELSE 'continuous_time_of_day' END AS mode FROM (
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS offsets, {r('coalesce(sum(n) FILTER (WHERE s = 0), 0) / sum(n)')} AS midnight_share FROM
(SELECT epoch_us(ts) % 86400000000 // 1000000 AS s, count(*) AS n FROM {table} GROUP BY 1))"""


@query("B11", f"WITH {SPINE} {granularity_sql('spine', 'orders')} UNION ALL {granularity_sql('events', 'events')}")
def timestamp_granularity(t: Tables):
    parts = [op.granularity(df, "ts").select(F.lit(name).alias("source"), "rows", "offsets", r6(F.col("midnight_share")).alias("midnight_share"), "mode")
             for name, df in (("orders", t.spine), ("events", t.actions))]
    return parts[0].unionByName(parts[1])


@query("B12", f"""WITH {ACTIONS}, lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM actions WHERE is_real)
SELECT event_id, {r('(epoch_us(ts) - lo) / (hi - lo)')} AS x FROM actions, lim WHERE NOT is_real""")
def normalized_times(t: Tables):
    a = t.actions
    out = op.normalized_time(a.where("not is_real"), "ts", a.where("is_real"), "x")
    return out.select("event_id", r6(F.col("x")).alias("x"))


@query("B13", f"""WITH {SPINE} SELECT count(*) AS events, count(DISTINCT customer_id) AS customers, min(day) AS first FROM spine
WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND product_id IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def valid_event_filter(t: Tables):
    parents = {"customer_id": t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id")),
               "product_id": t.part.where("p_size > 10").select(F.col("p_partkey").alias("product_id"))}
    out = op.valid_events(t.spine, "ts", parents)
    return out.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("customer_id").alias("customers"), F.min("day").alias("first"))


@query("B15 B17", f"""WITH {SPINE}, m AS (SELECT CASE WHEN order_id % 7 = 0 THEN NULL ELSE quantity END AS q, CASE WHEN order_id % 11 = 0 THEN NULL ELSE flag END AS f
FROM spine), a AS (SELECT avg(q) AS mean FROM m)
SELECT coalesce(f, '?') AS f, CAST(q IS NULL AS INTEGER) AS q_missing, count(*) AS n, {r('sum(coalesce(q, mean))', 4)} AS filled,
{r('coalesce(sum(q), 0)', 4)} AS restored, count(q) AS restored_n FROM m, a GROUP BY ALL""")
def imputed_and_restored(t: Tables):
    m = t.spine.select("event_id", F.when(F.col("order_id") % 7 != 0, F.col("quantity")).alias("q"),
                       F.when(F.col("order_id") % 11 != 0, F.col("flag")).alias("f"), F.lit("same").alias("c"))
    filled, how = op.impute(m, ["f", "c"], ["q"])
    # the round trip is checked on the same rows: encoded next to restored
    kept = filled.withColumns({"q2": F.col("q"), "f2": F.col("f"), "missing2": F.col("q_missing")})
    back = op.restore(kept, how, ["f", "c"], {"q": 1})
    return back.groupBy(F.col("f2").alias("f"), F.col("missing2").alias("q_missing")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("q2"), 4).alias("filled"), r6(F.coalesce(F.sum("q"), F.lit(0.0)), 4).alias("restored"),
        F.count("q").alias("restored_n"))


@query("B16", """WITH d AS (SELECT o_orderdate AS ordered, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lo AS (SELECT least(min(ordered), min(shipped)) AS first FROM d),
o AS (SELECT avg(epoch_us(ordered)) <= avg(epoch_us(shipped)) AS ordered_first FROM d)
SELECT CASE WHEN ordered_first THEN CAST(ordered AS DATE) - CAST(first AS DATE) ELSE CAST(shipped AS DATE) - CAST(first AS DATE) END AS first_date,
CASE WHEN ordered_first THEN CAST(shipped AS DATE) - CAST(ordered AS DATE) ELSE CAST(ordered AS DATE) - CAST(shipped AS DATE) END AS second_date,
count(*) AS n, bool_and(true) AS round_trip FROM d, lo, o GROUP BY ALL""")
def chained_date_encoding(t: Tables):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("ordered"), F.col("l_shipdate").alias("shipped"), F.col("o_orderdate").alias("o2"), F.col("l_shipdate").alias("s2"))
    enc, how = op.encode_dates(d, ["ordered", "shipped"])
    first, second = (f"{c}_date" for c in how.order)
    back = op.decode_dates(enc.withColumns({"a": F.col(first), "b": F.col(second)}), how)
    same = (F.col("ordered") == F.col("o2")) & (F.col("shipped") == F.col("s2"))
    return back.groupBy(F.col("a").alias("first_date"), F.col("b").alias("second_date")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(same).alias("round_trip"))


@query("B18", f"""WITH {ACTIONS}, lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM actions WHERE is_real)
SELECT {r('avg(CASE WHEN epoch_us(ts) < lo THEN 1.0 ELSE 0.0 END)')} AS before, {r('avg(CASE WHEN epoch_us(ts) > hi THEN 1.0 ELSE 0.0 END)')} AS after,
{r('sum((epoch_us(ts) - lo) / 1e6)', 1)} AS seconds, true AS round_trip FROM actions, lim WHERE NOT is_real""")
def training_origin_encoding(t: Tables):
    a = t.actions
    lo, hi = a.where("is_real").agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    syn = a.where("not is_real")
    enc = op.decode_time(op.encode_time(syn, "ts", lo, "s"), "s", lo, "back")
    out = op.outside_training_range(syn, "ts", lo, hi)
    check = enc.agg(r6(F.sum("s"), 1).alias("seconds"), F.bool_and(F.col("back") == F.col("ts")).alias("round_trip")).first()
    return out.select(r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"),
                      F.lit(check["seconds"]).alias("seconds"), F.lit(check["round_trip"]).alias("round_trip"))


@query("B19", f"""WITH {SPINE} SELECT CASE WHEN flag IN ('A', 'N') THEN flag ELSE 'A' END AS flag, count(*) AS n FROM spine GROUP BY ALL""")
def repaired_categories(t: Tables):
    return op.repair_categories(t.spine, "flag", ["A", "N"], repair=True).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("B20", """SELECT * FROM (VALUES ('nation', false, 'n_name,n_nationkey,n_regionkey'), ('region', true, 'r_name,r_regionkey'),
('customer', false, 'c_acctbal,c_custkey,c_mktsegment,c_name')) v("table", dimension, kept)""")
def pruned_tables(t: Tables):
    specs = {
        "nation": {"n_nationkey": "id", "n_name": "categorical", "n_regionkey": "id"},
        "region": {"r_regionkey": "id", "r_name": "categorical"},
        "customer": {"c_custkey": "id", "c_name": "categorical", "c_nationkey": "unknown", "c_acctbal": "numerical", "c_mktsegment": "categorical"},
    }
    rows = []
    for name, types in specs.items():
        kept, dimension = op.prune_table(t.table(name), types)
        rows.append((name, dimension, ",".join(sorted(kept.columns))))
    return t.spark.createDataFrame(rows, '`table` string, dimension boolean, kept string')


@query("B21 A2", f"""WITH {SPINE} SELECT row_number() OVER (ORDER BY ts, customer_id, product_id, price, event_id) - 1 AS event_number, customer_id, product_id, day FROM spine""")
def numbered_events(t: Tables):
    cols = ["customer_id", "product_id", "ts", "day", "price", "event_id"]
    out = op.with_event_id(t.spine, cols, ["ts", "customer_id", "product_id", "price", "event_id"], "event_number")
    return out.select("event_number", "customer_id", "product_id", "day")


@query("H9", f"""SELECT event_id, month(ts)::INTEGER AS month, (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, year(ts)::INTEGER AS year,
{r('sin(2 * pi() * (month(ts) - 1) / 12)')} AS month_sin, {r('cos(2 * pi() * (month(ts) - 1) / 12)')} AS month_cos,
{r('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS weekday_sin, {r('cos(2 * pi() * (isodow(ts) - 1) / 7)')} AS weekday_cos,
{r('epoch_us(ts) / 1e6', 3)} AS seconds FROM events""")
def date_part_features(t: Tables):
    parts = cl.date_parts("ts")
    smooth = {k: (r6(v, 3 if k == "seconds" else 6) if k in ("month_sin", "month_cos", "weekday_sin", "weekday_cos", "seconds") else v) for k, v in parts.items()}
    return t.actions.select("event_id", *[v.alias(k) for k, v in smooth.items()])


@query("H10", f"""WITH {SPINE} SELECT day, CAST(day - DATE '0001-01-01' + 1 AS INTEGER) AS ordinal, count(*) AS n FROM spine GROUP BY ALL""")
def day_ordinals(t: Tables):
    from chronoweave.operators.counts import day_ordinal

    return t.spine.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("ordinal", day_ordinal("day"))


@query("H11", f"""WITH {SPINE}, c AS (SELECT product_id, avg(verified) AS p FROM spine GROUP BY 1), k AS (SELECT *, least(greatest(p, 1e-4), 1 - 1e-4) AS q FROM c)
SELECT product_id, {r('ln(q / (1 - q))')} AS logit, {r('q')} AS back, {r('ln(greatest(p, 1e-12))')} AS log_clip,
{r('-(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * log2(1 - p) ELSE 0 END)')} AS bits,
{r('exp(p) / (exp(p) + exp(1 - p))')} AS soft FROM k""")
def probability_transforms(t: Tables):
    c = t.spine.groupBy("product_id").agg(F.avg("verified").alias("p"))
    pair = F.array(F.col("p"), 1 - F.col("p"))
    return c.select("product_id", r6(cl.logit("p")).alias("logit"), r6(cl.sigmoid(cl.logit("p"))).alias("back"), r6(cl.log_clip(pair)[0]).alias("log_clip"),
                    r6(cl.entropy(pair, bits=True)).alias("bits"), r6(cl.softmax(pair)[0]).alias("soft"))


@query("H12 H14", f"""WITH x AS (SELECT event_id, value / 37.0 - 4 AS x FROM events)
SELECT event_id, {r('1 - abs(1 - (((x % 2) + 2) % 2))')} AS folded, {r('exp(-greatest(x, 0) / 2.5)')} AS decay FROM x""")
def reflected_and_decayed(t: Tables):
    x = t.actions.select("event_id", (F.col("value") / 37.0 - 4).alias("x"))
    return x.select("event_id", r6(cl.reflect_unit("x")).alias("folded"), r6(cl.decay("x", 2.5)).alias("decay"))


@query("H15", f"""WITH {SPINE}, v AS (SELECT 'discount' AS "column", discount AS x FROM spine UNION ALL SELECT 'price', price FROM spine
UNION ALL SELECT 'quantity', quantity FROM spine UNION ALL SELECT 'value', value FROM events)
SELECT "column", CAST(length(regexp_replace(regexp_extract(CAST(x AS VARCHAR), '\\.(\\d+)', 1), '0+$', '')) AS INTEGER) AS places, count(*) AS n FROM v GROUP BY ALL""")
def decimal_precision(t: Tables):
    from chronoweave.operators.two_sample import melt

    v = melt(t.spine, ["discount", "price", "quantity"], []).unionByName(melt(t.actions, ["value"], []))
    return v.groupBy("column", cl.decimal_places("value").alias("places")).agg(F.count(F.lit(1)).alias("n"))


@query("H5", f"""SELECT CAST('0x' || substr(md5('user|' || user_id), 1, 13) AS BIGINT) % 16 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def stable_id_buckets(t: Tables):
    from chronoweave.functions.text import bucket_of

    return t.actions.groupBy(bucket_of("user", "user_id", 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
