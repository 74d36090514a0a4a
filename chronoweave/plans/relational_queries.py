"""Relational jobs and nearest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize, r6
from chronoweave.operators import attribute_generation as ag
from chronoweave.operators import nearest as nn
from chronoweave.operators import relational as rl
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import rounded, rounded_columns
from chronoweave.plans.tables import Tables, SIDE_SEED, hash_sql, r
from chronoweave.functions.hashing import hashed_long


@query("A11 A12", """SELECT * FROM (VALUES ('customer', 'orders', 'c_custkey', 'o_custkey'), ('orders', 'lineitem', 'o_orderkey', 'l_orderkey'), ('part', 'lineitem', 'p_partkey', 'l_partkey')) v(parent, child, parent_key, child_key)""")
def relationships(t: Tables):
    declared = {"o_custkey": "customer", "l_orderkey": "orders"}
    links = [("customer", "orders", "c_custkey", []), ("orders", "lineitem", "o_orderkey", []), ("part", "lineitem", "p_partkey", ["l_partkey"])]
    found = [rl.Relationship(p, c, k, rl.find_foreign_key(t.table(c).columns, p, declared, k, fb)) for p, c, k, fb in links]
    return rl.relationship_table(t.spark, found)


@query("C11 A16", """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS node FROM customer), c AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS node FROM orders)
SELECT c.node AS child, p.node AS parent FROM c JOIN p ON c_custkey = o_custkey""")
def order_customer_edges(t: Tables):
    o = t.orders
    return rl.edge_table(o, rl.dense_ids(o, "o_orderkey"), "o_orderkey", "o_custkey", rl.dense_ids(t.customer, "c_custkey"), "c_custkey")


@query("C12", """SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS bridge_id, l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def part_supplier_bridge(t: Tables):
    e = rl.collapse_bridge(t.lineitem.select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey")
    return rl.restore_bridge(e, "l_partkey", "l_suppkey", "bridge_id")


@query("C13", """SELECT row_number() OVER (ORDER BY o_custkey, place) - 1 AS order_no, o_custkey, place FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey) AS place FROM orders)""")
def regrown_order_stubs(t: Tables):
    return rl.regrow_stubs(rl.trim_stubs(t.orders, "o_custkey"), "o_custkey", "order_no")


@query("C14", """WITH RECURSIVE e AS (SELECT CAST(conv_id AS VARCHAR) AS a, 'r' || (conv_id % 7) || '-' || role AS b FROM conversations GROUP BY ALL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, seen) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY node""")
def conversation_components(t: Tables):
    e = t.conversations.select(F.col("conv_id").cast("string").alias("src"), F.concat(F.lit("r"), (F.col("conv_id") % 7).cast("string"), F.lit("-"), F.col("role")).alias("dst")).distinct()
    return rl.connected_components(e)


@query("C21", """WITH a AS (SELECT l_partkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem),
b AS (SELECT l_partkey AS k, l_discount AS d, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem) SELECT k, q, d FROM a JOIN b USING (k, n)""")
def occurrence_aligned_rows(t: Tables):
    tie = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    l = t.lineitem.withColumn("k", F.col("l_partkey"))
    a = l.select("k", F.col("l_quantity").alias("q"), *[F.col(c).alias(f"a_{c}") for c in tie])
    b = l.select("k", F.col("l_discount").alias("d"), *[F.col(c).alias(f"b_{c}") for c in tie])
    return rl.aligned_occurrences(a, b, ["k"], ["q", *[f"a_{c}" for c in tie]], ["d", *[f"b_{c}" for c in tie]]).select("k", "q", "d")


@query("J40", """WITH e AS (SELECT o_custkey AS parent, o_orderkey AS child, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT row_number() OVER (ORDER BY parent, child) - 1 AS row_id, parent, CASE (p - 1) % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS step FROM e""")
def tables_from_graph(t: Tables):
    e = t.orders.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    return rl.graph_to_tables(e, "parent", "row_id", ["first", "second", "third"])


@query("C2", "SELECT count(*) AS kept FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def restricted_parents(t: Tables):
    used = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(used, "p_partkey", "left_semi").agg(F.count(F.lit(1)).alias("kept"))


# --- nearest rows -------------------------------------------------------------------------------


def mixed_customers(t: Tables):
    c = t.customer.withColumn("third", (hashed_long(SIDE_SEED, "c_custkey") % 3).cast("int"))
    ranges, domains = nn.fit_mixed(c.where("third < 2"), ["c_acctbal"], ["c_mktsegment", "c_nationkey"])
    return materialize(c.select("c_custkey", "third", nn.mixed_vector(c, ranges, domains).alias("v")))


MIXED = f"""c AS (SELECT *, {hash_sql(SIDE_SEED, 'c_custkey')} % 3 AS third FROM customer), l AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c WHERE third < 2),
d AS (SELECT a.c_custkey AS q, b.third, b.c_custkey AS n, abs(a.c_acctbal - b.c_acctbal) / (hi - lo) + 2 * CAST(a.c_mktsegment <> b.c_mktsegment AS INTEGER) + 2 * CAST(a.c_nationkey <> b.c_nationkey AS INTEGER) AS dist
FROM c a JOIN c b ON a.third = 2 AND b.third < 2, l)"""


@query("C16", f"""WITH {MIXED} SELECT q AS c_custkey, {r('min(dist) FILTER (WHERE third = 0)')} AS train_distance, {r('min(dist) FILTER (WHERE third = 1)')} AS holdout_distance FROM d GROUP BY q""")
def closest_customer_records(t: Tables):
    c = mixed_customers(t)
    parts = [nn.nearest_rows(c.where("third = 2"), "c_custkey", c.where(f"third = {i}"), "c_custkey", "v", "l1").select("c_custkey", r6(F.col("distance")).alias(n))
             for i, n in ((0, "train_distance"), (1, "holdout_distance"))]
    return parts[0].join(parts[1], "c_custkey")


@query("I42", f"""WITH {MIXED}, m AS (SELECT q, min(dist) FILTER (WHERE third = 0) AS dt, min(dist) FILTER (WHERE third = 1) AS dh FROM d GROUP BY q)
SELECT {r('avg(CASE WHEN round(dt - dh, 9) < 0 THEN 1 WHEN round(dt - dh, 9) = 0 THEN 0.5 ELSE 0 END)')} AS score, {r('avg(CASE WHEN round(dt - dh, 9) < 0 THEN 1.0 ELSE 0.0 END)')} AS strict_score, {r('avg(dt)')} AS mean_train_distance, {r('avg(dh)')} AS mean_holdout_distance FROM m""")
def closest_record_score(t: Tables):
    c = mixed_customers(t)
    return rounded_columns(nn.closest_record_score(c.where("third = 2"), "c_custkey", c.where("third = 0"), c.where("third = 1"), "c_custkey", "v"))


def vectors(t: Tables):
    return materialize(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label", (hashed_long(SIDE_SEED, "vec_id") % 2 == 0).alias("is_real")))


VEC = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {hash_sql(SIDE_SEED, 'vec_id')} % 2 = 0 AS is_real FROM embeddings), vd AS (SELECT a.vec_id AS q, b.vec_id AS n, a.is_real AS qr, b.is_real AS nr, a.label AS ql, b.label AS nl, list_distance(a.v, b.v) AS dist FROM v a, v b)"""


@query("C17", f"WITH {VEC} SELECT q AS vec_id, {r('min(dist)', 5)} AS distance FROM vd WHERE NOT qr AND nr GROUP BY q")
def nearest_embedding_distances(t: Tables):
    v = vectors(t)
    out = nn.nearest_rows(v.where("not is_real"), "vec_id", v.where("is_real"), "vec_id", "v")
    return out.select("vec_id", r6(F.col("distance"), 5).alias("distance"))


@query("C19", f"""WITH {VEC}, c AS (SELECT label FROM v WHERE is_real GROUP BY 1 HAVING count(*) >= 3) SELECT q AS vec_id, CAST(min_by(n, dist) AS VARCHAR) AS decoded FROM vd WHERE NOT qr AND nr AND (ql = nl OR ql NOT IN (SELECT label FROM c)) GROUP BY q""")
def decoded_latent_neighbors(t: Tables):
    """Nearest training latent of the same category when it has three or more rows, else of any category."""
    v = vectors(t)
    train = v.where("is_real")
    big = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("label")
    syn = v.where("not is_real")
    own = nn.nearest_rows(syn.join(big, "label", "left_semi"), "vec_id", train.join(big, "label", "left_semi"), "vec_id", "v", by="label")
    rest = syn.join(big, "label", "left_anti")
    every = nn.nearest_rows(rest, "vec_id", train, "vec_id", "v")
    return own.unionByName(every).select("vec_id", F.col("neighbor").alias("decoded"))


@query("I44", f"""WITH {VEC}, rk AS (SELECT q, dist, row_number() OVER (PARTITION BY q ORDER BY dist) AS i FROM vd WHERE qr AND nr AND q <> n), rr AS (SELECT q, dist AS radius FROM rk WHERE i = 5),
fk AS (SELECT q, dist, row_number() OVER (PARTITION BY q ORDER BY dist) AS i FROM vd WHERE NOT qr AND NOT nr AND q <> n), ff AS (SELECT q, dist AS radius FROM fk WHERE i = 5),
p AS (SELECT vd.q, count(*) FILTER (WHERE dist <= radius + 1e-12) AS balls FROM vd JOIN rr ON rr.q = vd.n WHERE NOT qr AND nr GROUP BY vd.q), rc AS (SELECT vd.q, count(*) FILTER (WHERE dist <= radius + 1e-12) AS balls FROM vd JOIN ff ON ff.q = vd.n WHERE qr AND NOT nr GROUP BY vd.q),
cv AS (SELECT vd.q, min(dist) <= max(radius) + 1e-12 AS hit FROM vd JOIN rr ON rr.q = vd.q WHERE qr AND NOT nr GROUP BY vd.q)
SELECT 'precision' AS metric, {r('avg(CASE WHEN balls > 0 THEN 1.0 ELSE 0.0 END)')} AS value FROM p UNION ALL SELECT 'density', {r('sum(balls) / (5 * count(*))')} FROM p UNION ALL
SELECT 'recall', {r('avg(CASE WHEN balls > 0 THEN 1.0 ELSE 0.0 END)')} FROM rc UNION ALL SELECT 'coverage', {r('avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)')} FROM cv UNION ALL SELECT 'real_rows', count(*) FILTER (WHERE is_real) FROM v""")
def embedding_manifold_metrics(t: Tables):
    v = vectors(t)
    return rounded(nn.manifold_metrics(v.where("is_real"), v.where("not is_real"), "vec_id", "v"))


@query("J32 C17")
def interpolated_rows(t: Tables):
    """New customers between a customer and its nearest neighbor of the mixed distance."""
    c = mixed_customers(t)
    near = nn.nearest_rows(c, "c_custkey", c, "c_custkey", "v", "l1", drop_self=True)
    raw = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    other = raw.select(F.col("c_custkey").cast("string").alias("neighbor"), F.col("c_acctbal").alias("nb_c_acctbal"), F.col("c_mktsegment").alias("nb_c_mktsegment"))
    return ag.interpolate_rows(near.join(raw, "c_custkey").join(other, "neighbor"), "c_custkey", ["c_acctbal"], ["c_mktsegment"])
