import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import attribute_generation as ag
from chronoweave.operators import counts as ct
from chronoweave.operators import nearest as nn
from chronoweave.operators import relational as rl
from chronoweave.operators import spine_generation as sg


@pytest.fixture(scope="module")
def blocked_events(spark):
    pattern = [("c0", "p0"), ("c1", "p1"), ("c2", "p2"), ("c3", "p3"), ("c0", "p4")]
    rows = [(f"{d}-{i}", c, p, dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in range(6) for i, (c, p) in enumerate(pattern)]
    e = spark.createDataFrame(rows, "event_id string, customer_id string, product_id string, day date")
    e = e.withColumns({c: F.substring(c, 2, 2).cast("long") for c in ("customer_id", "product_id")})
    cb = spark.range(4).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("customer_block"))
    pb = spark.range(5).select(F.col("id").alias("product_id"), (F.col("id") % 2).cast("int").alias("product_block"))
    return e, cb, pb


@pytest.mark.parametrize("mode", ["exact", "mixture", "local_kernel"])
def test_block_stub_matching_is_exact(blocked_events, mode):
    e, cb, pb = blocked_events
    out = sg.block_stub_matching(e, cb, pb, "event_id", mode=mode)
    assert out.count() == 30
    sg.require_exact(sg.exact_constraints(ct.with_blocks(e, cb, pb), out))


def test_broken_constraints_raise(blocked_events):
    e, cb, pb = blocked_events
    real = ct.with_blocks(e, cb, pb)
    with pytest.raises(ValueError, match="customer_degrees"):
        sg.require_exact(sg.exact_constraints(real, real.withColumn("customer_id", F.lit(0).cast("long"))))


def test_expand_spreads_large_counts(spark):
    df = spark.createDataFrame([("a", 25), ("b", 3), ("c", 0)], "k string, n long")
    out = sg.expand(df, "n", "i", chunk=4).groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("i").alias("d"), F.max("i").alias("m")).collect()
    assert {r["k"]: (r["c"], r["d"], r["m"]) for r in out} == {"a": (25, 25, 25), "b": (3, 3, 3)}


def test_pick_by_weight_follows_the_weights(spark):
    table = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "item string, w double")
    draws = spark.range(400).select("id", ((F.col("id") + 0.5) / 400).alias("u"))
    n = {r["item"]: r["count"] for r in sg.pick_by_weight(draws, "u", table, "w", ["item"], keep=["item"]).groupBy("item").count().collect()}
    assert n == {"x": 100, "y": 300}


def test_copies_get_suffixes(spark):
    train = spark.createDataFrame([("good",), ("good overall",)], "t string")
    gen = spark.createDataFrame([(1, "Good"), (2, "fresh")], "id int, text string")
    out = {r["id"]: (r["text"], r["attempts"], r["resolved"]) for r in ag.block_exact_copies(gen, "id", "text", train, "t").collect()}
    assert out == {1: ("Good overall in practice", 2, True), 2: ("fresh", 0, True)}


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_nearest_rows_equal_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(nn, "RING_ROWS", 7)
    monkeypatch.setattr(nn, "QUERY_ROWS", 5)
    rng = np.random.default_rng(1)
    ref, qry = rng.normal(size=(90, 3)), rng.normal(size=(25, 3))
    lab = lambda n: ["ab"[i % 2] for i in range(n)]
    r = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(ref, lab(90)))], "id int, v array<double>, g string")
    q = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(qry, lab(25)))], "qid int, v array<double>, g string")
    d = np.abs(qry[:, None] - ref[None]).sum(2) if metric == "l1" else np.sqrt(((qry[:, None] - ref[None]) ** 2).sum(2))
    for k in (1, 3):
        got = {x["qid"]: x["distance"] for x in nn.nearest_rows(q, "qid", r, "id", "v", metric, k=k, pivots=8).collect()}
        assert [got[i] for i in range(25)] == pytest.approx(np.sort(d, axis=1)[:, k - 1].tolist())
    got = {x["qid"]: x["distance"] for x in nn.nearest_rows(q, "qid", r, "id", "v", metric, pivots=8, by="g").collect()}
    same = np.array([[a == b for b in lab(90)] for a in lab(25)])
    assert [got[i] for i in range(25)] == pytest.approx(np.where(same, d, np.inf).min(1).tolist())


def test_nearest_rows_in_many_dimensions_ask_blocks_and_not_rings(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2500, 24))
    r = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    at = nn.rings(r, "id", "v", "l2", 64)
    asked = nn.visits(r, "id", "v", "l2", at, 1)
    assert asked.count() == 2500  # one row carries a vector, however many rings are in reach
    assert len(at.cell) >= 50 and asked.selectExpr("max(size(_blocks))").first()[0] <= 2


def test_nearest_of_equal_rows_is_the_smallest_id_at_distance_zero(spark, monkeypatch):
    monkeypatch.setattr(nn, "RING_ROWS", 3)
    monkeypatch.setattr(nn, "QUERY_ROWS", 10)
    rng = np.random.default_rng(4)
    v = 1e3 + rng.normal(size=(40, 17))
    r = spark.createDataFrame([(f"{100 + i}", v[i % 40].tolist()) for i in range(240)], "id string, v array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid int, v array<double>")
    got = {x["qid"]: (x["distance"], x["neighbor"]) for x in nn.nearest_rows(q, "qid", r, "id", "v").collect()}
    assert got == {i: (0.0, f"{100 + i}") for i in range(40)}
    got = {x["id"]: (x["distance"], x["neighbor"]) for x in nn.nearest_rows(r, "id", r, "id", "v", drop_self=True).collect()}
    assert got == {f"{100 + i}": (0.0, f"{100 + i % 40}" if i >= 40 else f"{140 + i}") for i in range(240)}
    zero = r.selectExpr("id as _r", "0.0D as radius")
    assert {x["balls"] for x in nn.balls_hit(q, "qid", r, "id", "v", zero).collect()} == {6}


def test_connected_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x1", "x2"), ("x2", "x3"), ("x1", "x3"), ("z", "z")]
    got = {r["node"]: r["component"] for r in rl.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and {got[x] for x in ("x1", "x2", "x3")} == {"x1"} and got["z"] == "z"


def test_rewiring_keeps_degrees(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 30, 200), rng.integers(0, 40, 200))})
    e = spark.createDataFrame([(f"e{i}", a, b, a % 2, b % 2) for i, (a, b) in enumerate(pairs)], "id string, s long, t long, sb long, tb long")
    out = sg.rewire(e, "id", "s", "t", ["sb", "tb"], patience=30).collect()
    assert len({(r["s"], r["t"]) for r in out}) == len(pairs)
    for side in ("s", "t"):
        assert sorted(r[side] for r in out) == sorted(r[side] for r in e.collect())


def test_rewiring_writes_the_table_a_bounded_number_of_times(spark, monkeypatch):
    """Rounds after the first write the edges they move, not the table; joint counts per class stay, rows without a block too."""
    edges = [(f"e{i}", i % 400, (i * 7) % 300, None if i % 5 == 4 else i % 2) for i in range(1_200)]
    e = spark.createDataFrame(edges, "id string, s long, t long, b long")
    whole, write = [], sg.materialize

    def counted(df):
        out = write(df)
        whole.append(out.count() >= 1_200)
        return out

    monkeypatch.setattr(sg, "materialize", counted)
    out = sg.rewire(e, "id", "s", "t", ["b"], patience=30).collect()
    assert len(out) == 1_200 and sum(whole) <= 3
    assert sorted(r["t"] for r in out) == sorted(x[2] for x in edges)
    assert sorted((str(r["b"]), r["s"]) for r in out) == sorted((str(x[3]), x[1]) for x in edges)
    count = {}
    for r in out:
        count[r["s"], r["t"]] = count.get((r["s"], r["t"]), 0) + 1
    real = {}
    for _, a, b, _ in edges:
        real[a, b] = real.get((a, b), 0) + 1
    assert max(count.values()) <= max(real.values())


def test_rows_of_large_counts_come_from_many_tasks(spark):
    counts = spark.range(64).select(F.col("id").alias("cell"), F.lit(50).alias("n"))
    made = sg.expand(counts, "n", "place")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and made.count() == 3200


def test_candidate_pools_are_never_sized_by_their_slots(spark):
    slots = spark.range(40).select(F.concat(F.lit("s"), "id").alias("slot"), (F.col("id") % 2).cast("int").alias("customer_block"), F.lit(0).alias("product_block"))
    customers = spark.range(6).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("customer_block"), F.lit(3).alias("degree"))
    products = spark.range(4).select(F.col("id").alias("product_id"), F.lit(0).alias("product_block"), F.lit(2).alias("degree"))
    unit = [F.array(F.lit(0.6), F.lit(0.8)).alias("vector")]
    out = sg.candidate_affinity(slots, {"customer_id": (customers, "customer_block"), "product_id": (products, "product_block")}, (customers.select("customer_id", *unit), products.select("product_id", *unit)))
    # exploded rows under a join would be taken for as few as there were before, and broadcast
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.join(slots, "slot").collect()
    assert len(rows) == 40 and all(r["customer_id"] % 2 == r["customer_block"] for r in rows)


def test_picks_agree_with_a_cumulative_scan(spark):
    weights = {("a", i): float(w) for i, w in enumerate((0.001, 5, 0, 3, 1e-9, 2, 7))} | {(None, 9): 1.0}
    table = spark.createDataFrame([(b, i, w) for (b, i), w in weights.items()], "b string, item int, w double")
    us = [i / 997 for i in range(997)] + [0.999999999]
    draws = spark.createDataFrame([(f"{b}{j}", b, u) for b in ("a", None) for j, u in enumerate(us)], "key string, b string, u double")
    got = {r["key"]: r["item"] for r in sg.pick_by_weight(draws, "u", table, "w", ["item"], ["b"], ["item"]).collect()}
    live = [(i, w) for (b, i), w in weights.items() if b == "a" and w > 0]
    total, want = sum(w for _, w in live), {}
    for j, u in enumerate(us):
        start = 0.0
        for i, w in live:
            if start / total <= u:
                want[f"a{j}"] = i
            start += w
        want[f"None{j}"] = 9
    assert got == want
