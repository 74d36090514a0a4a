"""Steps keep the disk of their results only, and rows that become wide go in pieces."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import kernels as kn
from chronoweave.operators import event_auction as ea
from chronoweave.operators import reserved_pairs as rp
from chronoweave.operators import spine_generation as sg


def tables(spark) -> set[str]:
    root = Path(kn.workspace(spark).removeprefix("file:"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def rows(df) -> list:
    return sorted(tuple(r) for r in df.collect())


def grown(spark, make):
    """What `make` gives, and the tables it leaves."""
    before = tables(spark)
    return make(), tables(spark) - before


@pytest.fixture(scope="module")
def blocked(spark):
    e = spark.range(240).select(
        F.col("id").alias("event_id"), (F.col("id") * 7 % 20).alias("customer_id"), (F.col("id") * 11 % 30).alias("product_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 6).cast("int")).alias("day"))
    return e.withColumns({"customer_block": (F.col("customer_id") % 2).cast("int"), "product_block": (F.col("product_id") % 2).cast("int")})


def blocks(blocked):
    return blocked.select("customer_id", "customer_block").distinct(), blocked.select("product_id", "product_block").distinct()


def test_finished_leaves_its_tables_only(spark):
    def make():
        inner = kn.finished(lambda: kn.materialize(spark.range(5)).where("id > 1"))
        return kn.materialize(inner.withColumn("x", F.lit(1))), inner.where("id > 3")

    (a, b), left = grown(spark, lambda: kn.finished(make))
    assert (a.count(), b.count(), len(left)) == (3, 1, 2)
    kn.discard(a, b, spark.range(1))
    assert not left & tables(spark)


def test_finished_cleans_up_after_an_error(spark):
    def fails():
        kn.materialize(spark.range(3))
        raise ValueError("no")

    before = tables(spark)
    with pytest.raises(ValueError, match="no"):
        kn.finished(fails)
    assert tables(spark) == before


def test_finished_keeps_tables_made_before(spark):
    old = kn.materialize(spark.range(4))
    assert kn.finished(lambda: old) is old
    assert kn.finished(lambda: old.where("id > 2")).count() == 1 and old.count() == 4


def test_shuffle_files_go_with_their_job(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_pieces_hold_whole_groups(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") % 10 > 0, F.col("id") % 10))
    count = lambda part: part.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got, left = grown(spark, lambda: kn.in_pieces(df, ["k"], count, 30))
    assert rows(got.na.fill(0)) == [(k, 10) for k in range(10)] and len(left) == 1


def test_block_stub_matching_leaves_one_table(spark, blocked):
    out, left = grown(spark, lambda: sg.block_stub_matching(blocked.drop("customer_block", "product_block"), *blocks(blocked), "event_id"))
    assert out.count() == 240 and len(left) <= 3  # the spine, and the vectors


@pytest.fixture(scope="module")
def placed(spark, blocked):
    return kn.materialize(blocked.withColumn("slot", F.concat(F.lit("s"), "event_id")))


def vectors(blocked):
    v = lambda c: blocked.select(c).distinct().select(c, F.array(F.sin(c), F.cos(c)).alias("vector"))
    return v("customer_id"), v("product_id")


def test_greedy_pairing_in_pieces_is_the_same(blocked, placed):
    pair = lambda n: sg.pair_greedily(placed, *vectors(blocked), real_events=blocked, real_pairs=blocked, real_penalty=0.5, run=7, piece_rows=n)
    assert rows(pair(40)) == rows(pair(10_000))


def test_candidates_in_pieces_are_the_same(spark, blocked, placed):
    ents = {e: (blocked.groupBy(e, b).agg(F.count(F.lit(1)).alias("degree")), b) for e, b in (("customer_id", "customer_block"), ("product_id", "product_block"))}
    pick = lambda n: sg.candidate_affinity(placed, ents, vectors(blocked), 3, piece_rows=n)
    whole, (parts, left) = pick(10_000), grown(spark, lambda: pick(150))
    assert rows(parts) == rows(whole) and len(left) <= 2


def test_endpoints_take_the_first_accepted_proposal(spark):
    e = spark.range(60).select(F.col("id").alias("customer_id"), F.lit(1).alias("b"), (F.col("id") / 60).alias("x"))
    draws = spark.range(300).select(F.col("id").alias("draw"), F.lit(1).alias("b"), (F.col("id") / 300).alias("time"))
    bw = spark.createDataFrame([(1, 60, 0.05)], "b int, n long, bandwidth double")
    got, left = grown(spark, lambda: sg.endpoints_near(draws, "draw", ["b"], "time", e, "x", "customer_id", bw))
    assert len(left) == 1 and got.count() == 300
    # the first proposal is taken where it passes, whatever comes after it
    one = sg.endpoints_near(draws, "draw", ["b"], "time", e, "x", "customer_id", bw, tries=4)
    assert rows(got.select("draw")) == rows(one.select("draw"))


def test_changed_partners_leave_one_round(spark):
    stubs = spark.createDataFrame([(i, 0, 0, i % 6, i % 3 + 3 * (i // 9)) for i in range(36)], "event_id long, customer_block long, product_block long, customer_id long, product_id long")
    out, left = grown(spark, lambda: rp.change_partners(kn.materialize(stubs), "event_id", stubs.limit(0)))
    assert out.groupBy("customer_id", "product_id").count().where("count > 1").isEmpty()
    assert len(left) <= 3  # the input, what is forbidden, the last round


def test_auction_rounds_leave_the_last(spark):
    slots = spark.createDataFrame([(f"s{i:03}", i % 7, 0, None) for i in range(60)], "slot string, customer_id long, product_block int, day date")
    candidates = spark.createDataFrame([(f"s{i:03}", p, (i * 31 + p * 17) % 50 * ea.UNIT // 10) for i in range(60) for p in range(3)], "slot string, product_id long, score long")
    capacity = spark.createDataFrame([(p, 0, 20) for p in range(3)], "product_id long, product_block int, capacity long")
    done, left = grown(spark, lambda: ea.auction(slots, candidates, capacity, 6))
    assert done.rounds.count() > 2 and len(left) <= 4  # slots, candidates, prices, what is held
