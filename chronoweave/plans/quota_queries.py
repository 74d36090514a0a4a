"""Quota filling on the order lines: the synthetic half's demand per block and month meets the real half's customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize
from chronoweave.operators import quota_filling as qf
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import blocked
from chronoweave.plans.tables import BLOCK_MAPS, SPINE, Tables

LEVELS = (("customer_block", "month"), ("customer_block",), ())


def shares_sql(name: str, rows: str, by: tuple[str, ...]) -> str:
    """`name` (by, customer_id, take): the closed solution, from rows (by, customer_id, quota, weight, demand)."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""{name}_r AS (SELECT *, sum(quota) OVER w AS q, sum(weight) OVER w AS wq, sum(weight) OVER ({part}) AS wt FROM {rows} WHERE quota > 0 WINDOW w AS ({part}ORDER BY CAST(quota AS DOUBLE) / weight, customer_id)),
{name}_f AS (SELECT *, CAST(quota AS HUGEINT) * (wt - wq) <= CAST(demand - q AS HUGEINT) * weight AS used FROM {name}_r),
{name}_s AS (SELECT *, coalesce(sum(quota) FILTER (WHERE used) OVER ({part}), 0) AS qs, greatest(wt - coalesce(sum(weight) FILTER (WHERE used) OVER ({part}), 0), 1) AS others FROM {name}_f),
{name}_b AS (SELECT *, CASE WHEN used THEN 0 ELSE CAST(demand - qs AS HUGEINT) * weight // others END AS base, CASE WHEN used THEN 0 ELSE CAST(demand - qs AS HUGEINT) * weight % others END AS rem FROM {name}_s),
{name}_k AS (SELECT *, row_number() OVER ({part}ORDER BY used, rem DESC, customer_id) AS place, demand - qs - sum(base) OVER ({part}) AS more FROM {name}_b),
{name} AS MATERIALIZED (SELECT {''.join(f'{b}, ' for b in by)}customer_id, CAST(CASE WHEN used THEN quota ELSE base + CASE WHEN place <= more THEN 1 ELSE 0 END END AS BIGINT) AS take FROM {name}_k)"""


FILLED = f"""WITH {SPINE}, {BLOCK_MAPS}, bl AS (SELECT customer_id, customer_block, is_real, CAST(date_trunc('month', day) AS DATE) AS month, event_id FROM spine JOIN cb USING (customer_id)),
demand AS (SELECT customer_block, month, count(*) AS demand FROM bl WHERE NOT is_real GROUP BY ALL),
own AS (SELECT customer_block, month, customer_id, count(*) AS quota FROM bl WHERE is_real GROUP BY ALL), deg AS (SELECT customer_id, customer_block, count(*) AS degree FROM bl WHERE is_real GROUP BY ALL),
bm AS (SELECT customer_block, month, sum(quota) AS bn FROM own GROUP BY ALL), bt AS (SELECT customer_block, sum(bn) AS bt FROM bm GROUP BY 1),
caps AS (SELECT customer_block, month, customer_id, quota, greatest(1, CAST(round(1000000 * (degree * (quota + 5.0 * bn / bt) / (degree + 5.0))) AS BIGINT)) AS weight FROM own JOIN deg USING (customer_id, customer_block) JOIN bm USING (customer_block, month) JOIN bt USING (customer_block)),
rows1 AS (SELECT * FROM caps JOIN demand USING (customer_block, month)), {shares_sql('t1', 'rows1', LEVELS[0])},
d1 AS (SELECT customer_block, sum(demand - coalesce(got, 0)) AS demand FROM demand LEFT JOIN (SELECT customer_block, month, sum(take) AS got FROM t1 GROUP BY ALL) USING (customer_block, month) GROUP BY 1 HAVING sum(demand - coalesce(got, 0)) > 0),
l1 AS (SELECT customer_id, customer_block, degree - coalesce(m, 0) AS degree FROM deg LEFT JOIN (SELECT customer_id, sum(take) AS m FROM t1 GROUP BY 1) USING (customer_id)),
rows2 AS (SELECT customer_block, customer_id, degree AS quota, degree AS weight, demand FROM l1 JOIN d1 USING (customer_block) WHERE degree > 0), {shares_sql('t2', 'rows2', LEVELS[1])},
d2 AS (SELECT sum(demand - coalesce(got, 0)) AS demand FROM d1 LEFT JOIN (SELECT customer_block, sum(take) AS got FROM t2 GROUP BY 1) USING (customer_block)),
l2 AS (SELECT customer_id, degree - coalesce(m, 0) AS degree FROM l1 LEFT JOIN (SELECT customer_id, sum(take) AS m FROM t2 GROUP BY 1) USING (customer_id)),
rows3 AS (SELECT customer_id, degree AS quota, degree AS weight, demand FROM l2, d2 WHERE degree > 0 AND demand > 0), {shares_sql('t3', 'rows3', LEVELS[2])},
takes AS (SELECT 1 AS level, customer_block, month, customer_id, take FROM t1 WHERE take > 0 UNION ALL SELECT 2, customer_block, NULL, customer_id, take FROM t2 WHERE take > 0 UNION ALL SELECT 3, NULL, NULL, customer_id, take FROM t3 WHERE take > 0)"""


def _filled(t: Tables):
    b = materialize(blocked(t).select("event_id", "customer_id", "customer_block", "is_real", "day", F.trunc("day", "month").cast("date").alias("month")))
    slots, real = b.where("not is_real"), b.where("is_real")
    demand = slots.groupBy("customer_block", "month").agg(F.count(F.lit(1)).alias("demand"))
    own = real.groupBy("customer_block", "month", "customer_id").agg(F.count(F.lit(1)).alias("quota"))
    degrees = materialize(real.groupBy("customer_id", "customer_block").agg(F.count(F.lit(1)).alias("degree")))
    month = own.groupBy("customer_block", "month").agg(F.sum("quota").alias("bn"))
    block = month.groupBy("customer_block").agg(F.sum("bn").alias("bt"))
    share = F.col("degree") * (F.col("quota") + F.lit(5.0) * F.col("bn") / F.col("bt")) / (F.col("degree") + F.lit(5.0))
    caps = own.join(degrees, ["customer_id", "customer_block"]).join(month, ["customer_block", "month"]).join(block, "customer_block")
    caps = materialize(caps.select("customer_block", "month", "customer_id", "quota", F.greatest(F.lit(1), F.round(share * 1_000_000).cast("long")).alias("weight")))
    return slots, qf.fill_by_levels(demand, caps, degrees, LEVELS, "customer_id")


@query("J21", f"{FILLED} SELECT level, customer_block, month, customer_id, take FROM takes")
def quota_takes(t: Tables):
    """Events per customer, cell and level; SQL has the closed solution."""
    return _filled(t)[1]


@query("J21", f"""{FILLED}, n AS (SELECT count(*) AS n FROM bl WHERE NOT is_real) SELECT level, CAST(sum(take) AS BIGINT) AS events, count(DISTINCT customer_id) AS customers,
(SELECT bool_and(t <= degree) FROM (SELECT customer_id, sum(take) AS t FROM takes GROUP BY 1) JOIN deg USING (customer_id)) AS within_degrees FROM takes GROUP BY level""")
def quota_levels(t: Tables):
    """Slots that each level has filled, counted on the slots themselves."""
    slots, takes = _filled(t)
    placed = materialize(qf.assign_filled(slots.withColumnRenamed("event_id", "slot").select("slot", "customer_block", "month", "day"), takes, LEVELS, "customer_id"))
    degrees = t.spine.where("is_real").groupBy("customer_id").agg(F.count(F.lit(1)).alias("degree"))
    got = placed.groupBy("customer_id").agg(F.count(F.lit(1)).alias("got")).join(degrees, "customer_id", "left")
    inside = got.agg(F.bool_and(F.col("got") <= F.col("degree"))).first()[0]
    one = placed.count() == placed.select("slot").distinct().count()
    return placed.groupBy("level").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("customer_id").alias("customers")).withColumn("within_degrees", F.lit(bool(inside and one)))
