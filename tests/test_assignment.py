"""Auctions, quota filling and rank joins against slow definitions."""

import itertools
import random
from fractions import Fraction

from pyspark.sql import functions as F

from chronoweave.operators import event_auction as ea
from chronoweave.operators import quota_filling as qf
from chronoweave.operators import spine_generation as sg


def auction_tables(spark, scores, capacity, customers=None):
    """scores[slot][product] in points, everything in one block."""
    n = len(scores)
    slots = spark.createDataFrame([(f"s{i:02d}", (customers or list(range(n)))[i], 0, 1) for i in range(n)], "slot string, customer_id long, product_block int, day int")
    rows = [(f"s{i:02d}", p, int(v * ea.UNIT)) for i, line in enumerate(scores) for p, v in enumerate(line) if v is not None]
    caps = spark.createDataFrame([(p, 0, c) for p, c in enumerate(capacity)], "product_id long, product_block int, capacity long")
    return slots, spark.createDataFrame(rows, "slot string, product_id long, score long"), caps


def test_auction_is_near_the_best_assignment(spark):
    rng = random.Random(1)
    for capacity in ([1] * 6, [2, 3, 1], [6]):
        scores = [[round(rng.random(), 3) for _ in capacity] for _ in range(6)]
        slots, candidates, caps = auction_tables(spark, scores, capacity)
        step = ea.UNIT // 1_000
        done = ea.auction(slots, candidates, caps, rounds=60, step=step, repeat_penalty=0)
        got = {r["slot"]: r["product_id"] for r in done.assigned.collect()}
        seats = [p for p, c in enumerate(capacity) for _ in range(c)]
        best = max(sum(scores[i][p] for i, p in enumerate(x)) for x in set(itertools.permutations(seats)))
        assert sorted(got.values()) == seats
        assert sum(scores[int(s[1:])][p] for s, p in got.items()) >= best - 6 * step / ea.UNIT - 1e-9
        assert not done.assigned.where("filled").count()


def test_packed_candidates_go_by_number(spark):
    """Candidates of one row a slot, keyed by the slot's number, give what rows keyed by its text give; two rounds move few of them."""
    rng = random.Random(3)
    scores = [[round(rng.random(), 3) if rng.random() < 0.8 else None for _ in range(5)] for _ in range(14)]
    slots, candidates, caps = auction_tables(spark, scores, [4, 4, 3, 2, 1], customers=[i % 4 for i in range(14)])
    numbered = ea.in_order(slots)
    assert [r["number"] for r in numbered.orderBy("slot").collect()] == list(range(1, 15))
    offers = ea.packed(candidates.join(numbered.select("slot", "number", "customer_id"), "slot"))
    assert offers.count() == candidates.select("slot").distinct().count() and ea.unpacked(offers).count() == candidates.count()
    one, two = ea.auction(slots, candidates, caps, rounds=5), ea.auction(numbered, offers, caps, rounds=5)
    rows = lambda done: sorted((r["slot"], r["product_id"], r["filled"]) for r in done.assigned.collect())
    assert rows(one) == rows(two) and one.rounds.collect() == two.rounds.collect()


def test_auction_fills_what_candidates_leave(spark):
    scores = [[3.0, None, None] for _ in range(5)]  # everybody wants product 0, which has one place
    slots, candidates, caps = auction_tables(spark, scores, [1, 2, 2])
    done = ea.auction(slots, candidates, caps, rounds=4)
    rows = done.assigned.collect()
    assert sorted(r["product_id"] for r in rows) == [0, 1, 1, 2, 2] and sum(r["filled"] for r in rows) == 4
    prices = {r["product_id"]: tuple(r)[1:] for r in done.prices.collect()}
    assert prices[0][0] > 0 and prices[0][1:] == (1, 1) and prices[1] == (0, 0, 2)
    assert [r["held"] for r in done.rounds.orderBy("round").collect()][-1] == 1
    nobody = ea.auction(slots, candidates.limit(0), caps)
    assert sorted(r["product_id"] for r in nobody.assigned.collect()) == [0, 1, 1, 2, 2] and nobody.rounds.count() == 0
    assert ea.auction(slots.limit(0), candidates.limit(0), caps.limit(0)).assigned.count() == 0


def test_repeats_of_a_customer_cost(spark):
    scores = [[1.0, 0.4]] * 4
    slots, candidates, caps = auction_tables(spark, scores, [2, 2], customers=[1, 1, 2, 2])
    got = {(r["customer_id"], r["product_id"]) for r in ea.auction(slots, candidates, caps, rounds=40, step=ea.UNIT // 100).assigned.collect()}
    assert got == {(1, 0), (1, 1), (2, 0), (2, 1)}


def shares_by_definition(rows, demand):
    """rows {entity: (quota, weight)}: raise the level until the demand is met, then largest remainders."""
    rows = {e: (q, w) for e, (q, w) in rows.items() if q > 0}
    if sum(q for q, _ in rows.values()) <= demand:
        return {e: q for e, (q, _) in rows.items()}
    full = set()
    while True:
        rest = demand - sum(rows[e][0] for e in full)
        level = Fraction(rest, sum(w for e, (_, w) in rows.items() if e not in full))
        more = {e for e, (q, w) in rows.items() if e not in full and level * w >= q}
        if not more:
            break
        full |= more
    share = {e: level * w for e, (_, w) in rows.items() if e not in full}
    take = {e: int(v) for e, v in share.items()}
    for e in sorted(share, key=lambda e: (take[e] - share[e], e))[: rest - sum(take.values())]:
        take[e] += 1
    return take | {e: rows[e][0] for e in full}


def test_capped_shares(spark, monkeypatch):
    rng = random.Random(2)
    groups = {}
    for g in range(60):
        rows = {e: (rng.choice([0, 1, 2, 5, 30]), rng.choice([1, 2, 7, 1_000_000])) for e in range(rng.randint(1, 9))}
        groups[g if g else None] = (rows, rng.randint(0, sum(q for q, _ in rows.values()) + 3))
    table = spark.createDataFrame([(g, e, q, w, d) for g, (rows, d) in groups.items() for e, (q, w) in rows.items()], "g long, e long, quota long, weight long, demand long")
    for hot in (500_000, 3):
        monkeypatch.setattr("chronoweave.functions.kernels.HOT_GROUP_ROWS", hot)
        got = {}
        for r in qf.capped_shares(table, ["g"], "e").collect():
            got.setdefault(r["g"], {})[r["e"]] = r["take"]
        for g, (rows, d) in groups.items():
            want = shares_by_definition(rows, d)
            assert got[g] == {e: want.get(e, 0) for e in rows}, (g, rows, d)
    assert qf.capped_shares(table.limit(0), ["g"], "e").count() == 0
    one = {r["e"]: r["take"] for r in qf.capped_shares(table.where("g = 5").drop("g"), [], "e").collect()}
    assert one == {r["e"]: r["take"] for r in qf.capped_shares(table.where("g = 5"), ["g"], "e").collect()}


def test_filling_goes_up_the_levels(spark):
    demand = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), ("b", 1, 4)], "block string, month int, demand long")
    caps = spark.createDataFrame([("a", 1, 10, 2, 1), ("a", 2, 10, 3, 1), ("a", 2, 11, 1, 5), ("b", 1, 20, 1, 1)], "block string, month int, who long, quota long, weight long")
    degrees = spark.createDataFrame([(10, "a", 5), (11, "a", 1), (20, "b", 1), (21, "b", 2)], "who long, block string, degree long")
    levels = (("block", "month"), ("block",), ())
    takes = qf.fill_by_levels(demand, caps, degrees, levels, "who")
    got = sorted((r["level"], r["block"] or "", r["month"] or 0, r["who"], r["take"]) for r in takes.collect())
    assert got == [(1, "a", 1, 10, 2), (1, "a", 2, 11, 1), (1, "b", 1, 20, 1), (2, "a", 0, 10, 3), (2, "b", 0, 21, 2)]  # one of b's four finds nobody
    slots = spark.createDataFrame([(f"{b}{m}{i}", b, m, i) for b, m, n in (("a", 1, 5), ("a", 2, 1), ("b", 1, 4)) for i in range(n)], "slot string, block string, month int, day int")
    placed = qf.assign_filled(slots, takes, levels, "who").collect()
    assert len(placed) == len({r["slot"] for r in placed}) == 9
    assert {r["slot"][0] for r in placed if r["who"] == 10} == {"a"} and sum(r["who"] == 10 for r in placed) == 5
    assert qf.fill_by_levels(demand.limit(0), caps, degrees, levels, "who").count() == 0


def test_rank_joins_keep_rows_with_null_groups(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "b int, x int")
    right = spark.createDataFrame([(None, 10), (None, 20), (5, 30)], "b int, y int")
    assert sorted((r["x"], r["y"]) for r in sg.match_by_rank(left, right, ["b"], ["x"], ["y"]).collect()) == [(1, 10), (2, 20), (3, 30)]
    draws = spark.createDataFrame([(None, "k", 0.9), (5, "l", 0.1)], "b int, key string, u double")
    weights = spark.createDataFrame([(None, 1, 1), (None, 2, 1), (5, 3, 1)], "b int, item int, w int")
    assert sorted((r["key"], r["item"]) for r in sg.pick_by_weight(draws, "u", weights, "w", ["item"], ["b"], ["item"]).collect()) == [("k", 2), ("l", 3)]


def test_repeats_are_spread_over_all_cells(spark):
    rng = random.Random(4)
    rows = [(f"s{i}", rng.randrange(12), rng.randrange(10), rng.randrange(2), 0, rng.randrange(6)) for i in range(150)]
    rows += [(f"h{i}", 99, rng.randrange(10), 0, 0, rng.randrange(6)) for i in range(8)]
    df = spark.createDataFrame(rows, "slot string, customer_id long, product_id long, customer_block int, product_block int, day int")
    real = spark.createDataFrame([(c, p, d) for c in range(12) for p in range(3) for d in range(6)], "customer_id long, product_id long, day int")
    cell = ["customer_block", "product_block", "day"]
    for window in (500, 4):
        out = sg.spread_repeats(df, cell, real, ["day"], window=window)
        before, after = ([tuple(r) for r in x.select("slot", "customer_id", "product_id", *cell).collect()] for x in (df, out))
        side = lambda rows, k: sorted((r[k], *r[3:]) for r in rows)
        assert sorted((r[0], r[1], *r[3:]) for r in before) == sorted((r[0], r[1], *r[3:]) for r in after)
        assert side(before, 2) == side(after, 2)
        again = lambda rows: len(rows) - len({(r[1], r[2]) for r in rows})
        events = lambda rows: sum(r[1] < 12 and r[2] < 3 for r in rows)
        assert again(after) < again(before) and events(after) <= events(before)
        lines = {r["stage"]: r for r in sg.overlap_report({"a": df, "b": out}, real).collect()}
        assert (lines["a"]["repeated_pairs"], lines["b"]["repeated_pairs"]) == (again(before), again(after)) and lines["b"]["rows"] == 158
        assert (lines["a"]["repeated_events"], lines["b"]["repeated_events"]) == (events(before), events(after))
    same = sg.spread_repeats(df, cell, goal=1_000)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, df.collect()))
    assert sg.spread_repeats(df.limit(0), cell).count() == 0


def test_greedy_runs_take_the_best_product_left(spark):
    """Batches of many small runs give what each run gives alone."""
    rng = random.Random(5)
    vector = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(3)]
    cv, pv = ({i: vector() for i in range(9)} for _ in range(2))
    rows = [(f"s{i:03d}", rng.randrange(10), rng.randrange(10), rng.choice([None, 1]), 0, rng.randrange(12)) for i in range(120)]
    df = spark.createDataFrame(rows, "slot string, customer_id long, product_id long, customer_block int, product_block int, day int").withColumn("day", F.date_add(F.lit("2024-01-01"), F.col("day")))
    tables = [spark.createDataFrame(list(v.items()), f"{n} long, vector array<double>") for v, n in ((cv, "customer_id"), (pv, "product_id"))]
    got = sg.pair_greedily(df, *tables).collect()
    assert len(got) == 120
    side = lambda rows, name: sorted((r[name], str(r["customer_block"]), r["product_block"], r["day"]) for r in rows)
    assert all(side(got, n) == side(df.collect(), n) for n in ("slot", "customer_id", "product_id"))
    zero, score = [0.0] * 3, lambda c, p: sum(a * b for a, b in zip(cv.get(c, zero), pv.get(p, zero)))
    cells = {}
    for r in got:
        cells.setdefault((r["customer_block"], r["day"]), []).append((r["customer_id"], r["product_id"]))
    for pairs in cells.values():
        if len({c for c, _ in pairs}) == len(pairs):  # without repeats the best pair of the cell is always taken
            assert max(score(c, p) for c, p in pairs) >= max(score(c, p) for c, _ in pairs for _, p in pairs) - 1e-9
