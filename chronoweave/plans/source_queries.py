"""Sources, sinks and streams. Raw files in the public formats are written from the given tables first, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.functions.kernels import r6, workspace
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import rounded
from chronoweave.plans.tables import BLOCK_MAPS, SPINE, Tables, r
from chronoweave.sources import interactions as ix
from chronoweave.sources import tables as st
from chronoweave.streaming import histories as sh


def staged(t: Tables, files: dict) -> str:
    """Write DataFrames as raw files under a fresh folder; keys are file names."""
    root = f"{workspace(t.spark)}/raw-{uuid.uuid4().hex}"
    for name, df in files.items():
        st.write_table(df, f"{root}/{name}")
    return root


def movie_root(t: Tables, gaps: bool = False) -> str:
    """Ratings and movies as raw files; with `gaps` every tenth movie is missing from the second."""
    e = t.events
    ratings = e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(F.col("user_id").alias("userId"), (F.col("event_id") % 97).alias("movieId"), (F.floor(F.col("value")) % 5 + 1).alias("rating"), F.floor(F.unix_micros("ts") / 1000000).alias("timestamp"))
    movies = e.select((F.col("event_id") % 97).alias("movieId")).distinct().select("movieId", F.concat(F.lit("Movie, "), F.col("movieId").cast("string")).alias("title"), F.lit("Drama").alias("genres"))
    return staged(t, {"ratings.csv": ratings, "movies.csv": movies.where("movieId % 10 <> 3") if gaps else movies})


@query("A3 A2 A1 L1", """SELECT 'ml-rating-' || (row_number() OVER (ORDER BY event_id) - 1) AS event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 97 AS VARCHAR) AS movie_id,
to_timestamp(epoch_us(ts) // 1000000)::TIMESTAMP AS event_time, CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS VARCHAR) AS rating FROM events""")
def movielens_source(t: Tables):
    return ix.source_by_name("movielens", t.spark, movie_root(t)).interactions()


@query("A7 A8", "SELECT CAST(m AS VARCHAR) AS movie_id, 'Movie, ' || m AS title FROM (SELECT DISTINCT event_id % 97 AS m FROM events WHERE user_id < 5)")
def movie_entities_of_subset(t: Tables):
    s = ix.source_by_name("movielens", t.spark, movie_root(t))
    used = s.interactions().where("cast(user_id as int) < 5")
    return s.entities(used, "destination").select("movie_id", "title")


@query("A4", """SELECT 'r' || event_id AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS business_id, date_trunc('second', ts) AS event_time, CAST(CAST(event_id % 5 + 1 AS DOUBLE) AS VARCHAR) AS stars,
CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS useful, 0::BIGINT AS funny, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'said "hi", ' || event_id END AS text FROM events""")
def yelp_source(t: Tables):
    e = t.events
    raw = e.select(F.concat(F.lit("r"), "event_id").alias("review_id"), F.col("user_id").cast("string"), F.col("event_type").alias("business_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
                   (F.col("event_id") % 5 + 1).cast("double").alias("stars"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7).alias("useful"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit('said "hi", '), "event_id")).alias("text"))
    return ix.source_by_name("yelp", t.spark, staged(t, {"review.json": raw})).interactions().drop("cool")


def shop_root(t: Tables) -> str:
    e = t.events
    kind = F.element_at(F.array(F.lit(" View "), F.lit("ADDTOCART"), F.lit("transaction")), (F.col("event_id") % 3 + 1).cast("int"))
    events = e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(F.floor(F.unix_micros("ts") / 1000).alias("timestamp"), F.col("user_id").alias("visitorid"), kind.alias("event"), (F.col("event_id") % 50).alias("itemid"),
                                                      F.when(F.col("event_id") % 3 == 2, F.col("event_id")).alias("transactionid"))
    props = [e.where(f"event_id % 2 = {i}").select(F.floor(F.unix_micros("ts") / 1000).alias("timestamp"), (F.col("event_id") % 80).alias("itemid"), F.lit("p").alias("property"), F.col("value").cast("string").alias("value")) for i in (0, 1)]
    tree = t.spark.range(5).select(F.col("id").alias("categoryid"), F.floor(F.col("id") / 2).alias("parentid"))
    return staged(t, {"events.csv": events, "item_properties_part1.csv": props[0], "item_properties_part2.csv": props[1], "category_tree.csv": tree})


@query("A5", """WITH e AS (SELECT 'rr-event-' || (row_number() OVER (ORDER BY event_id) - 1) AS event_id, CAST(user_id AS VARCHAR) AS visitor_id, CAST(event_id % 50 AS VARCHAR) AS item_id, date_trunc('millisecond', ts) AS event_time,
CASE event_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'addtocart' ELSE 'transaction' END AS event, CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) END AS audit_transaction_id FROM events) SELECT * FROM e""")
def retailrocket_source_with_audit(t: Tables):
    s = ix.source_by_name("retailrocket", t.spark, shop_root(t))
    return s.interactions().join(s.audit(), "event_id")


@query("A9", "SELECT count(*) AS properties, count(DISTINCT event_id % 80) AS items, (SELECT 5)::BIGINT AS tree_rows FROM events WHERE event_id % 80 < 50")
def shop_support_tables(t: Tables):
    s = ix.source_by_name("retailrocket", t.spark, shop_root(t))
    p = s.properties(s.interactions())
    n = s.category_tree().count()
    return p.agg(F.count(F.lit(1)).alias("properties"), F.count_distinct("item_id").alias("items"), F.lit(n).cast("long").alias("tree_rows"))


@query("A6", """SELECT customer_id, count(*) AS n, count(price) AS prices, CAST(min(event_time) AS DATE) AS first FROM (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderdate AS event_time FROM orders) GROUP BY 1""")
def hm_source(t: Tables):
    raw = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("t_dat"), F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("article_id"),
                          F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.lit("1").alias("sales_channel_id"))
    i = ix.source_by_name("hm", t.spark, staged(t, {"transactions_train.csv": raw})).interactions()
    return i.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"), F.min(F.to_date("event_time")).alias("first"))


@query("A2", "SELECT o_orderkey, row_number() OVER () - 1 AS raw_row_number FROM orders")
def parquet_row_numbers(t: Tables):
    return st.with_file_row_number(t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")).select("o_orderkey", "raw_row_number")


@query("A13", """SELECT vec_id, label, '[' || array_to_string(list_transform(embedding[1:2], lambda x: CAST(x > 0 AS VARCHAR)), ',') || ']' AS signs FROM embeddings""")
def nested_columns_to_json(t: Tables):
    v = t.embeddings.select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda x: x > 0).alias("signs"))
    return st.flat_columns(v)


@query("A10", """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_nationkey AS customer_block FROM customer WHERE c_nationkey <> 7""")
def block_assignment_source(t: Tables):
    c = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_nationkey") == 7, "none").otherwise(F.col("c_nationkey").cast("string")).alias("block"))
    return st.load_blocks(c, ["customer_id", "id"], ["customer_block", "block"], "customer_id", "customer_block", t.spark)


@query("A15 D46 F5", "SELECT 'duplicate_ids' AS \"check\", 0::BIGINT AS bad UNION ALL SELECT 'null_ids', 0 UNION ALL SELECT 'bad_times', 0 UNION ALL SELECT 'missing_splits', 0 UNION ALL SELECT 'incomplete_histories', 0 UNION ALL SELECT 'source_orphans', 0 UNION ALL SELECT 'destination_orphans', (SELECT count(*) FROM events WHERE event_id % 97 NOT IN (SELECT event_id % 97 FROM events))")
def subset_validation(t: Tables):
    """The subset of about a third of the events is valid in every check."""
    s = ix.source_by_name("movielens", t.spark, movie_root(t))
    sub = ix.build_subset(s, t.events.count() // 3)
    root = f"{workspace(t.spark)}/subset-{uuid.uuid4().hex}"
    ix.write_subset(sub, root)
    return t.spark.read.schema("check string, bad long").json(f"{root}/validation.json")


def published(t: Tables) -> str:
    """A subset of all events over movies with gaps, written and read back."""
    s = ix.source_by_name("movielens", t.spark, movie_root(t, gaps=True))
    n = t.events.count()
    root = f"{workspace(t.spark)}/subset-{uuid.uuid4().hex}"
    ix.write_subset(ix.build_subset(s, n), root, target=n)
    return root


@query("A15 D46", """SELECT 'duplicate_ids' AS "check", count(*) - count(DISTINCT event_id) AS bad FROM events UNION ALL SELECT 'null_ids', count(*) FILTER (WHERE event_id IS NULL) FROM events
UNION ALL SELECT 'bad_times', count(*) FILTER (WHERE ts IS NULL) FROM events UNION ALL SELECT 'missing_splits', 0 UNION ALL SELECT 'incomplete_histories', count(*) - (SELECT count(*) FROM events) FROM events
UNION ALL SELECT 'source_orphans', count(*) FILTER (WHERE user_id IS NULL) FROM events UNION ALL SELECT 'destination_orphans', count(*) FILTER (WHERE event_id % 97 % 10 = 3) FROM events""")
def subset_validation_with_orphans(t: Tables):
    """Every tenth movie has no entity row; the report counts the events left without one."""
    return ix.read_subset(t.spark, published(t))["validation"].select("check", F.col("bad").cast("long").alias("bad"))


@query("A15", """SELECT 'interactions' AS "table", count(*) AS rows, count(*) AS target, 0::BIGINT AS deviation, true AS within_tolerance FROM events
UNION ALL SELECT 'sources', count(DISTINCT user_id), NULL, NULL, NULL FROM events UNION ALL SELECT 'destinations', count(DISTINCT event_id % 97) FILTER (WHERE event_id % 97 % 10 <> 3), NULL, NULL, NULL FROM events""")
def subset_manifest(t: Tables):
    """Rows of each table, the target and how far the subset is from it, from the manifest of a finished subset."""
    lines = t.spark.read.schema("table string, rows long, target long, deviation long, within_tolerance boolean").json(f"{published(t)}/manifest.json")
    return lines.where("table not in ('statistics', 'validation')")


@query("D46 A15")
def subset_statistics(t: Tables):
    s = ix.source_by_name("movielens", t.spark, movie_root(t))
    return rounded(ix.build_subset(s, t.events.count() // 3).statistics)


# --- streams ------------------------------------------------------------------------------------


def file_stream(t: Tables, df, parts: int = 4):
    """A table as a file stream: one write per stretch of time, so that files come in time order, one per batch."""
    path = f"{workspace(t.spark)}/stream-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    stretch = F.least(F.floor((F.unix_micros("ts") - lo) * parts / max(1, hi - lo)), F.lit(parts - 1))
    for i in range(parts):
        df.where(stretch == i).coalesce(1).write.mode("append").parquet(path)  # stages the feed only; a real one brings its own files
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_stream(t: Tables, parts: int = 4):
    return file_stream(t, t.events.select("event_id", "user_id", "ts", "value", "event_type"), parts)


@query("K1", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def streamed_history_counts(t: Tables):
    return sh.collect_updates(sh.running_counts(event_stream(t), "user_id"), ["user_id"])


@query("K2 E2", f"""SELECT event_id, user_id, count(*) OVER w AS prior_count, {r('coalesce(sum(value) OVER w, 0)', 4)} AS prior_value FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def streamed_running_statistics(t: Tables):
    run = sh.RunningStatistics(t.spark, "user_id", "event_id", "ts", {"value": F.col("value")})
    sh.run_available(event_stream(t), run)
    return run.results().select("event_id", "user_id", "prior_count", r6(F.col("prior_value"), 4).alias("prior_value"))


@query("K3", "SELECT CAST(epoch_us(ts) // (86400000000 * 7) AS BIGINT) AS week_no, count(*) AS n FROM events GROUP BY 1")
def streamed_tumbling_groups(t: Tables):
    out = sh.collect_updates(sh.tumbling_groups(event_stream(t), "ts", 7, "1 day"), ["window"])
    return out.select(F.floor(F.unix_micros(F.col("window.start")) / (86400000000 * 7)).alias("week_no"), "n")


@query("K4 D6", f"""WITH {SPINE}, {BLOCK_MAPS} SELECT day, customer_block, product_block, count(*) AS n FROM spine JOIN cb USING (customer_id) JOIN pb USING (product_id) GROUP BY ALL""")
def streamed_block_day_counts(t: Tables):
    stream = file_stream(t, t.spine.select("event_id", "customer_id", "product_id", "ts"), 3)
    out = sh.collect_updates(sh.block_day_counts(stream, "ts", t.customer_blocks, t.product_blocks, "1 day"), ["window", "customer_block", "product_block"])
    return out.select(F.to_date("window.start").alias("day"), "customer_block", "product_block", "n")
