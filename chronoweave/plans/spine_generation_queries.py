"""Spine generators on the order lines. Random results are checked by exact invariants; picks by position have SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.hashing import hashed_unit
from chronoweave.functions.kernels import discard, finished, materialize, r6
from chronoweave.operators import counts as ct
from chronoweave.operators import priors as pr
from chronoweave.operators import spine_generation as sg
from chronoweave.operators.clean import normalized_time
from chronoweave.plans.registry import query
from chronoweave.plans.spine_queries import BLOCKED, blocked
from chronoweave.plans.tables import BLOCK_MAPS, SPINE, Tables, hash_sql, r, unit_sql

def counts_sql(events: str, names=tuple(sg.EXACT_COUNTS)) -> str:
    """The counts that a generated spine must share with its source, from the source."""
    return " UNION ALL ".join(f"""SELECT '{name}' AS "constraint", {" || '|' || ".join(f'CAST({k} AS VARCHAR)' for k in keys)} AS key, count(*) AS n FROM {events} GROUP BY {', '.join(keys)}"""
                              for name, keys in sg.EXACT_COUNTS.items() if name in names)


COUNTS = f"WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} {counts_sql('blocked')}"
LIST_COUNTS = ("customer_degrees", "product_degrees", "daily_counts", "block_pair_counts")  # lists keep no cells
LISTED = f"WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} {counts_sql('blocked', LIST_COUNTS)}"


def flags(df, names: dict):
    return df.select(*[c.alias(n) for n, c in names.items()])


def true_sql(*names: str) -> str:
    return "SELECT " + ", ".join(f"true AS {n}" for n in names)


@query("J1", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, c AS (SELECT customer_block, product_block, count(*) AS n FROM blocked GROUP BY ALL), t AS (SELECT sum(n) AS have FROM c),
b AS (SELECT *, n * 10007 // have AS base, n * 10007 % have AS rest FROM c, t), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, n DESC, customer_block, product_block) AS i, 10007 - sum(base) OVER () AS missing FROM b)
SELECT customer_block, product_block, n, CAST(base + CASE WHEN i <= missing THEN 1 ELSE 0 END AS BIGINT) AS scaled FROM k""")
def scaled_block_pair_counts(t: Tables):
    c = blocked(t).groupBy("customer_block", "product_block").agg(F.count(F.lit(1)).alias("n"))
    return sg.scale_counts(c, ["customer_block", "product_block"], "n", 10007)


@query("J11", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT customer_block, product_block, day, row_number() OVER (PARTITION BY customer_block, product_block, day) AS place FROM blocked""")
def cell_slots(t: Tables):
    return sg.slots(ct.cell_counts(blocked(t))).drop("slot")


@query("J12", f"""WITH {SPINE}, {BLOCK_MAPS}, b AS (SELECT *, {unit_sql('k', 'event_id')} - 0.5 AS u FROM spine), l AS (SELECT min(day - DATE '1970-01-01') AS lo, max(day - DATE '1970-01-01') AS hi FROM spine)
SELECT event_id, CAST(least(greatest((day - DATE '1970-01-01') + round_even(-7.0 * sign(u) * ln(1 - 2 * abs(u)), 0), lo), hi) AS INTEGER) AS wanted FROM b, l""")
def local_kernel_desired_days(t: Tables):
    s = t.spine.select("event_id", "customer_id", "day")
    bw = s.select("customer_id").distinct().withColumn("bandwidth", F.lit(7.0))
    # hashed with seed 'k' through an empty base seed
    return sg.desired_days(s, "event_id", "customer_id", "day", "local_kernel", "", bandwidths=bw).select("event_id", "wanted")


@query("J12", "SELECT true AS complete, true AS inside_range, true AS some_own_days")
def mixture_desired_days(t: Tables):
    b = materialize(blocked(t).select("event_id", "customer_id", "customer_block", "day"))
    _, model = pr.activity_model(b, "customer_id", "day", b.select("customer_id", "customer_block").distinct(), "customer_block")
    out = sg.desired_days(b, "event_id", "customer_id", "day", "mixture", "42", model, "customer_block", alpha=40.0)
    lo, hi = b.agg(F.min(F.unix_date("day")), F.max(F.unix_date("day"))).first()
    n = b.count()
    own = b.select("customer_id", F.unix_date("day").alias("wanted")).distinct().withColumn("own", F.lit(1))
    return out.join(own, ["customer_id", "wanted"], "left").agg(
        (F.count(F.lit(1)) == n).alias("complete"), F.bool_and(F.col("wanted").between(lo, hi)).alias("inside_range"), (F.avg(F.coalesce("own", F.lit(0))) > 0.3).alias("some_own_days"))


@query("J13", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, sl AS (SELECT customer_block, day, customer_block || '|' || product_block || '|' || day || '|' || row_number() OVER (PARTITION BY customer_block, product_block, day) AS slot FROM blocked),
a AS (SELECT slot, customer_block, row_number() OVER (PARTITION BY customer_block ORDER BY day, {hash_sql('42s', 'slot')}, slot) AS i FROM sl),
b AS (SELECT customer_id, customer_block, row_number() OVER (PARTITION BY customer_block ORDER BY day, {hash_sql('42t', 'event_id')}, event_id) AS i FROM blocked) SELECT slot, customer_id FROM a JOIN b USING (customer_block, i)""")
def stub_to_slot_assignment(t: Tables):
    b = blocked(t)
    stubs = sg.desired_days(b.select("event_id", "customer_id", "customer_block", "day"), "event_id", "customer_id", "day", "exact", 42)
    return sg.assign_stubs(sg.slots(ct.cell_counts(b)), stubs, "customer_block", "event_id", "customer_id").select("slot", "customer_id")


@query("J18 J19 J11 J12 J13 J14", COUNTS)
def block_stub_matching(t: Tables):
    """The whole generator with mixture times: both degree sequences, days, block pairs and cells as generated; SQL counts the source."""
    s = t.spine.select("event_id", "customer_id", "product_id", "day")
    return sg.exact_counts(sg.block_stub_matching(s, t.customer_blocks, t.product_blocks, "event_id"))


@query("J18", COUNTS)
def block_stub_matching_local_kernel(t: Tables):
    s = t.spine.select("event_id", "customer_id", "product_id", "day")
    return sg.exact_counts(sg.block_stub_matching(s, t.customer_blocks, t.product_blocks, "event_id", mode="local_kernel"))


RANKED_SIDES = " ".join(f"""side{x}a AS (SELECT slot, {block}, row_number() OVER (PARTITION BY {block} ORDER BY day, {hash_sql(f'42{x}s', 'slot')}, slot) AS i FROM sl),
side{x}b AS (SELECT {entity}, {block}, row_number() OVER (PARTITION BY {block} ORDER BY day, {hash_sql(f'42{x}t', 'event_id')}, event_id) AS i FROM blocked), side{x} AS (SELECT slot, {entity} FROM side{x}a JOIN side{x}b USING ({block}, i)),"""
    for x, entity, block in (("c", "customer_id", "customer_block"), ("p", "product_id", "product_block")))


@query("J15 J18", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, sl AS (SELECT customer_block, product_block, day, customer_block || '|' || product_block || '|' || day || '|' || row_number() OVER (PARTITION BY customer_block, product_block, day) AS slot FROM blocked),
{RANKED_SIDES} made AS (SELECT customer_id, product_id, day FROM sl JOIN sidec USING (slot) JOIN sidep USING (slot)), ev AS (SELECT DISTINCT customer_id, product_id, day FROM spine), ed AS (SELECT DISTINCT customer_id, product_id FROM spine)
SELECT 'paired' AS stage, count(*) AS rows, (SELECT count(*) FROM made JOIN ev USING (customer_id, product_id, day)) AS repeated_events, (SELECT count(*) FROM made JOIN ed USING (customer_id, product_id)) AS repeated_edges,
(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM made GROUP BY customer_id, product_id)) AS repeated_pairs, true AS no_more_events, true AS no_more_pairs FROM made""")
def repair_overlaps(t: Tables):
    """Overlaps before the repairs, which SQL counts on the same random pairing, and whether the repairs left fewer."""
    s = materialize(t.spine.select("event_id", "customer_id", "product_id", "day"))
    cell = ["customer_block", "product_block", "day"]
    made = sg.block_stub_matching(s, t.customer_blocks, t.product_blocks, "event_id", mode="exact", pairing="random", repair=False)
    spread = sg.spread_repeats(made, cell, s, patience=1)
    lines = {r["stage"]: r for r in sg.overlap_report({"paired": made, "spread": spread, "swapped": sg.swap_away_overlaps(spread, s, cell, ["day"])}, s).collect()}
    a, b, c = lines["paired"], lines["spread"], lines["swapped"]
    fewer_events = c["repeated_events"] < max(a["repeated_events"], 1) and b["repeated_events"] <= a["repeated_events"]
    return t.spark.createDataFrame([(*a, fewer_events, b["repeated_pairs"] < max(a["repeated_pairs"], 1))],
                                   "stage string, rows long, repeated_events long, repeated_edges long, repeated_pairs long, no_more_events boolean, no_more_pairs boolean")


@query("J14 J16", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, monthly AS (SELECT customer_id, product_id, customer_block, product_block, CAST(date_trunc('month', day) AS DATE) AS day FROM blocked) {counts_sql('monthly')}""")
def greedy_affinity_pairing(t: Tables):
    """Greedy pairing by affinity inside month-like cells keeps every exact count."""
    s = materialize(t.spine.select("event_id", "customer_id", "product_id", F.trunc("day", "month").alias("day")))
    v = sg.affinity_vectors(s)
    return sg.exact_counts(sg.block_stub_matching(s, t.customer_blocks, t.product_blocks, "event_id", mode="exact", pairing="greedy", vectors=v, repair=False))


@query("J14", COUNTS)
def projection_affinity_pairing(t: Tables):
    s = materialize(t.spine.select("event_id", "customer_id", "product_id", "day"))
    v = sg.affinity_vectors(s)
    return sg.exact_counts(sg.block_stub_matching(s, t.customer_blocks, t.product_blocks, "event_id", mode="exact", pairing="projection", vectors=v, repair=False))


@query("J16 J17", true_sql("unit_vectors", "all_customers", "finite_scores"))
def affinity_vectors_and_scores(t: Tables):
    s = materialize(t.spine.select("customer_id", "product_id"))
    v = sg.affinity_vectors(s)
    deg = (ct.degrees(s, "customer_id"), ct.degrees(s, "product_id"))
    n = s.select("customer_id").distinct().count()
    from chronoweave.functions.cleaning import norm

    length = norm("vector")
    unit = v[0].agg(F.bool_and((F.abs(length - 1) < 1e-6) | (length < 1e-9)).alias("u"), (F.count(F.lit(1)) == n).alias("a")).first()
    scores = sg.pair_scores(s.distinct(), v, deg)
    return scores.agg(F.lit(unit["u"]).alias("unit_vectors"), F.lit(unit["a"]).alias("all_customers"), F.bool_and(F.col("score").isNotNull() & ~F.isnan("score")).alias("finite_scores"))


@query("J17", f"""WITH {SPINE} SELECT event_id, {r('rating / 7.0 + ln(greatest(discount, 1e-12)) + ln(greatest(quantity / 50, 1e-12)) + 0.5 * verified + 0.1 * ln(1 + rating) - (rating % 2) - 2 * verified')} AS score FROM spine""")
def event_score_formula(t: Tables):
    c = F.col
    return t.spine.select("event_id", r6(sg.event_score(c("rating") / 7.0, c("discount"), c("quantity") / 50, c("verified"), c("rating"), c("rating") % 2, c("verified"))).alias("score"))


def unit_time(t: Tables):
    b = blocked(t).select("event_id", "customer_id", "product_id", "customer_block", "product_block", "ts", "day")
    return finished(lambda: normalized_time(b, "ts", b, "x"))


@query("J2 D21", f"WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT customer_block, product_block, count(*) AS draws, true AS inside_unit, true AS spread FROM blocked GROUP BY ALL")
def kde_time_draws(t: Tables):
    e = unit_time(t)
    pair = ["customer_block", "product_block"]
    bw = pr.kde_bandwidths(e, pair, "x")
    out = sg.kde_times(e.select("event_id", *pair), "event_id", pair, e, "x", bw)
    return out.groupBy(*pair).agg(F.count(F.lit(1)).alias("draws"), F.bool_and(F.col("time").between(0, 1)).alias("inside_unit"), (F.stddev_pop("time") > 0.1).alias("spread"))


@query("J5 J3 J2 J1", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, c AS (SELECT customer_block, product_block, count(*) AS n FROM blocked GROUP BY ALL), t AS (SELECT sum(n) AS have, sum(n) // 2 AS want FROM c),
b AS (SELECT *, n * want // have AS base, n * want % have AS rest FROM c, t), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, n DESC, customer_block, product_block) AS i, want - sum(base) OVER () AS missing FROM b)
SELECT customer_block, product_block, CAST(base + CASE WHEN i <= missing THEN 1 ELSE 0 END AS BIGINT) AS events, true AS inside_unit FROM k""")
def temporal_block_model(t: Tables):
    e = unit_time(t)
    n = e.count() // 2
    out = finished(lambda: sg.temporal_block_model(e, n, "event_id", "x"))
    discard(e)
    # blocks are those of the chosen ids, so an id of another block shows in the counts
    own = out.select("draw", "customer_id", "product_id", "time").join(t.customer_blocks, "customer_id").join(t.product_blocks, "product_id")
    return own.groupBy("customer_block", "product_block").agg(F.count_distinct("draw").alias("events"), F.bool_and(F.col("time").between(0, 1)).alias("inside_unit"))


@query("J4", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, pc AS (SELECT day, count(*) AS pn FROM blocked GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM pc),
c AS (SELECT customer_block, product_block, day, count(*) AS c FROM blocked GROUP BY ALL), s AS (SELECT customer_block, product_block, sum(c) AS n FROM c GROUP BY ALL), tot AS (SELECT sum(pn) AS tot FROM pc),
p AS (SELECT customer_block, product_block, day, (coalesce(c, 0) + greatest(5, sqrt(n)) * coalesce(pn, 0) / tot) / (n + greatest(5, sqrt(n))) AS p FROM s CROSS JOIN cal CROSS JOIN tot LEFT JOIN c USING (customer_block, product_block, day) LEFT JOIN pc USING (day))
SELECT customer_block, product_block, day, {r('p', 9)} AS p FROM p""")
def smoothed_date_probabilities(t: Tables):
    cells = ct.cell_counts(blocked(t)).select("customer_block", "product_block", "day", "n")
    out = sg.smoothed_date_pmf(cells, ["customer_block", "product_block"], "day", cells)
    return out.withColumn("p", r6(F.col("p"), 9))


@query("J4", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, d AS (SELECT product_block, day, count(*) AS n FROM blocked GROUP BY ALL),
w AS (SELECT product_block, day, coalesce(sum(n) OVER (PARTITION BY product_block ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY product_block) AS x FROM d),
u AS (SELECT event_id, product_block, {unit_sql(7, 'event_id')} AS u FROM blocked)
SELECT event_id, u.product_block, w.day FROM u ASOF JOIN w ON u.product_block = w.product_block AND u.u >= w.x""")
def inverse_cdf_day_draws(t: Tables):
    """Days drawn from each block's own daily counts; the same draws come out of an as-of join in SQL."""
    b = blocked(t)
    draws = b.select("product_block", "event_id", hashed_unit(7, "event_id").alias("u"))
    table = b.groupBy("product_block", "day").agg(F.count(F.lit(1)).alias("n"))
    return sg.pick_by_weight(draws, "u", table, "n", ["day"], ["product_block"], ["day"])


@query("J6 J7", LISTED)
def temporal_stub_lists(t: Tables):
    e = blocked(t).select("event_id", "customer_id", "product_id", "customer_block", "product_block", "day")
    return sg.exact_counts(materialize(sg.stub_lists(e, "event_id", F.unix_date("day").cast("double"))), LIST_COUNTS)


@query("J8 J9", LISTED)
def kde_stub_lists_without_real_edges(t: Tables):
    """Stubs ordered by jittered times, then products swapped inside windows away from real edges."""
    e = unit_time(t)
    jitter = F.col("x") + 0.02 * (hashed_unit("j", "event_id") - 0.5)
    out = sg.stub_lists(e, "event_id", jitter)
    fixed = finished(lambda: sg.swap_away_overlaps(out.select("slot", "customer_id", "product_id", "day", "customer_block", "product_block"), e, ["customer_block", "product_block"], [], window=250))
    discard(out)
    return sg.exact_counts(fixed, LIST_COUNTS)


@query("J10", f"""WITH o AS (SELECT (epoch_us(ts) % 86400000000) // 1000000 AS s, count(*) AS n FROM events GROUP BY 1), w AS (SELECT s, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS x FROM o),
u AS (SELECT event_id, ts, {unit_sql('42g', 'event_id')} AS u FROM events), l AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events)
SELECT event_id, least(greatest(date_trunc('day', ts) + to_seconds(s), lo), hi) AS ts FROM (SELECT event_id, ts, s FROM u ASOF JOIN w ON u.u >= w.x), l""")
def sampled_time_offsets(t: Tables):
    a = t.actions
    off = a.groupBy(F.floor(F.pmod(F.unix_micros("ts"), F.lit(86400000000)) / 1000000).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = a.agg(F.min("ts"), F.max("ts")).first()
    return sg.apply_granularity(a.select("event_id", "ts"), "ts", "event_id", "empirical_offsets", off, lo, hi)


@query("J35", f"""WITH {SPINE}, f AS (SELECT event_id FROM spine ORDER BY day, event_id LIMIT 1) SELECT event_id, CASE WHEN event_id = (SELECT event_id FROM f) THEN day + 1 ELSE day END AS day FROM spine""")
def timestamp_multiset_avoidance(t: Tables):
    s = t.spine.select("event_id", "day")
    return sg.avoid_same_times(s, s, "day", "event_id")


@query("J20", f"WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT customer_id, customer_block, count(*) AS n, count(*) AS slots FROM blocked GROUP BY ALL")
def weighted_draw_with_degree_repair(t: Tables):
    b = materialize(blocked(t).select("event_id", "customer_id", "customer_block", "product_block", "day"))
    own, _ = pr.activity_model(b, "customer_id", "day", b.select("customer_id", "customer_block").distinct(), "customer_block")
    deg = b.groupBy("customer_id", "customer_block").agg(F.count(F.lit(1)).alias("degree"))
    out = materialize(sg.draw_with_repair(sg.slots(ct.cell_counts(b)), own, deg, "customer_id", "customer_block"))
    got = out.join(t.customer_blocks, "customer_id").groupBy("customer_id", "customer_block")
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"))


@query("J22", f"WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED} SELECT customer_block, product_block, day, count(*) AS n FROM blocked GROUP BY ALL")
def candidate_affinity_events(t: Tables):
    b = finished(lambda: blocked(t).select("customer_id", "product_id", "customer_block", "product_block", "day"))
    v = sg.affinity_vectors(b)
    deg = lambda *keys: materialize(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("degree")))
    ents = {"customer_id": (deg("customer_id", "customer_block"), "customer_block"),
            "product_id": (deg("product_id", "product_block"), "product_block")}
    slots = finished(lambda: sg.slots(ct.cell_counts(b)))
    discard(b)
    out = finished(lambda: sg.candidate_affinity(slots, ents, v, 4))
    own = slots.select("slot", "day").join(out, "slot").join(t.customer_blocks, "customer_id").join(t.product_blocks, "product_id")
    return own.groupBy("customer_block", "product_block", "day").agg(F.count(F.lit(1)).alias("n"))


@query("J23", """WITH s AS (SELECT c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT b, row_number() OVER (ORDER BY n DESC, b) - 1 AS compact FROM s)
SELECT c_custkey AS customer_id, CAST(compact AS INTEGER) AS compact_block, 0 AS type_block FROM customer JOIN k ON b = c_nationkey""")
def compacted_blocks(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("b"))
    return sg.compact_blocks(c, "b", "compact_block").join(sg.type_blocks(c, "customer_id", "type_block"), "customer_id").select("customer_id", "compact_block", "type_block")


@query("J23", true_sql("every_customer", "within_k"))
def clustered_blocks(t: Tables):
    s = t.spine.select("customer_id", "product_id")
    v = sg.affinity_vectors(s)[0]
    out = sg.cluster_blocks(v, "customer_id", 4, "block")
    n = s.select("customer_id").distinct().count()
    return out.agg((F.count(F.lit(1)) == n).alias("every_customer"), F.bool_and(F.col("block").between(0, 3)).alias("within_k"))


EDGE_KEYS = {"joint_degrees": ["c_degree", "p_degree"], "blocks": ["customer_block", "product_block"], "customers": ["customer_id"], "products": ["product_id"]}


@query("J24 D9", f"""WITH {SPINE}, {BLOCK_MAPS}, {BLOCKED}, e AS (SELECT DISTINCT customer_id, product_id, customer_block, product_block FROM blocked),
d AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS c_degree, count(*) OVER (PARTITION BY product_id) AS p_degree FROM e) """ + " UNION ALL ".join(
    f"""SELECT '{name}' AS kind, {" || '|' || ".join(f'CAST({k} AS VARCHAR)' for k in keys)} AS key, count(*) AS n, count(*) AS edges FROM d GROUP BY {', '.join(keys)}""" for name, keys in EDGE_KEYS.items()))
def rewired_edges(t: Tables):
    b = blocked(t).select("event_id", "customer_id", "product_id", "customer_block", "product_block")
    e = materialize(b.groupBy("customer_id", "product_id", "customer_block", "product_block").agg(F.min("event_id").alias("event_id")))
    out = materialize(sg.rewire(e, "event_id", "customer_id", "product_id", ["customer_block", "product_block"]))
    # one row a pair: how often it came out (a new parallel edge would show), and whether it is one of the source
    keys, tag = ["customer_id", "product_id", "customer_block", "product_block"], lambda df, out: df.select(*keys, F.lit(out).alias("made"))
    pairs = materialize(tag(out, 1).unionByName(tag(e, 0)).groupBy(*keys).agg(F.sum("made").alias("made"), (F.min("made") == 1).alias("new")).where("made > 0"))
    moved, total = pairs.agg(F.sum(F.when(F.col("new"), F.col("made")).otherwise(0)), F.sum("made")).first()
    if moved * 2 < total:
        raise ValueError(f"only {moved} edges have moved")
    degrees = [pairs.groupBy(k).agg(F.sum("made").alias(n)) for k, n in (("customer_id", "c_degree"), ("product_id", "p_degree"))]
    d, lines = materialize(pairs.join(degrees[0], "customer_id").join(degrees[1], "product_id")), None
    for name, keys in EDGE_KEYS.items():
        c = d.groupBy(*keys).agg(F.sum("made").alias("n"), F.count(F.lit(1)).alias("edges")).select(F.lit(name).alias("kind"), F.concat_ws("|", *keys).alias("key"), "n", "edges")
        lines = c if lines is None else lines.unionByName(c)
    return lines
