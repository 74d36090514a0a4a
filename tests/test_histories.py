import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import counts as ct
from chronoweave.operators import histories as hi
from chronoweave.operators import priors as pr
from chronoweave.operators import splits as sl
from chronoweave.operators import supports as su
from chronoweave.streaming import histories as sh


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(0, "c1", "p1", "2020-01-01", 2, 1), (1, "c1", "p2", "2020-01-01", 4, 0), (2, "c2", "p1", "2020-01-02", 5, 1), (3, "c1", "p2", "2020-01-03", 1, 1), (4, "c2", "p2", "2020-01-03", 3, 0)]
    df = spark.createDataFrame(rows, "event_id int, customer_id string, product_id string, d string, rating int, verified int")
    return df.select("*", F.to_timestamp("d").alias("ts"), F.to_date("d").alias("day"), F.lit(0).alias("customer_block"), F.lit(0).alias("product_block")).drop("d")


def test_no_same_day_leakage(reviews):
    deg = {e: ct.degrees(reviews, e, f"{e.split('_')[0]}_degree") for e in ("customer_id", "product_id")}
    f = {r["event_id"]: r for r in hi.causal_features(reviews, deg, "event_id", "ts", "day", "rating", "verified").collect()}
    assert f[0]["customer_past_count"] == 0 and f[1]["customer_past_count"] == 0
    assert f[3]["customer_past_count"] == 2 and f[3]["customer_past_rating"] == 3.0 and f[3]["product_past_count"] == 1
    assert f[3]["customer_days_since_last"] == 2.0 and f[0]["customer_days_since_last"] == 0.0


def test_neighbors_against_brute_force(reviews):
    rows = reviews.collect()
    for same in ("all", "none", "earlier"):
        got = {r["event_id"]: [h["neighbor"] for h in r["history"]] for r in hi.neighbors(reviews, "customer_id", "event_id", "ts", 2, same_time=same).collect()}
        for a in rows:
            ok = {"all": lambda b: b["ts"] <= a["ts"], "none": lambda b: b["ts"] < a["ts"], "earlier": lambda b: (b["ts"], b["event_id"]) < (a["ts"], a["event_id"])}[same]
            past = [b for b in rows if b["customer_id"] == a["customer_id"] and b["event_id"] != a["event_id"] and ok(b)]
            past.sort(key=lambda b: (b["ts"], b["event_id"]), reverse=True)
            assert got[a["event_id"]] == [b["event_id"] for b in past[:2]], (same, a["event_id"])


def test_mixed_draws_stay_in_the_past_without_repeats(spark):
    df = spark.createDataFrame([(i, "e", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i)) for i in range(60)], "event_id int, entity string, ts timestamp")
    out = hi.assert_past_only(hi.neighbors(df, "entity", "event_id", "ts", 8, same_time="none", strategy="mixed"), strict=True).collect()
    for r in out:
        ids = [h["neighbor"] for h in r["history"]]
        assert len(ids) == len(set(ids)) == min(r["event_id"], 8)


def test_split_policy(spark):
    df = spark.createDataFrame([(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(20)], "event_id int, ts timestamp")
    n = {r["split"]: r["count"] for r in sl.resolved_split(df, "ts", "event_id").groupBy("split").count().collect()}
    assert n == {"train": 18, "validation": 1, "test": 1}
    named = df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("TEST")), (F.col("event_id") % 3 + 1).cast("int")))
    assert {r[0] for r in sl.resolved_split(named, "ts", "event_id").select("split").distinct().collect()} == {"train", "validation", "test"}
    with pytest.raises(ValueError):
        sl.resolved_split(df.withColumn("split", F.lit("dev")), "ts", "event_id")


def test_source_selection_nears_the_target_and_repeats(spark):
    c = spark.createDataFrame([("u1", 2), ("u2", 3), ("u3", 4), ("u4", 1)], "k string, n long")
    first = sl.select_sources(c, "k", 5).collect()
    assert abs(sum(r["n"] for r in first) - 5) <= 1
    assert sorted(r["k"] for r in first) == sorted(r["k"] for r in sl.select_sources(c.repartition(3), "k", 5).collect())


def test_monthly_prior_is_a_smooth_distribution(spark):
    rows = [("2020-01", "5", 1)] * 18 + [("2020-01", "1", 0)] * 2 + [("2020-02", "5", 1)] * 2 + [("2020-02", "1", 0)] * 18
    df = spark.createDataFrame(rows, "bucket string, rating string, verified int")
    p = pr.grouped_class_prior(df, ["bucket"], "rating", "verified", ["1", "2", "5"]).collect()
    for b in ("2020-01", "2020-02"):
        assert sum(r["p"] for r in p if r["bucket"] == b) == pytest.approx(1.0)
    five = {r["bucket"]: r["p"] for r in p if r["class"] == "5"}
    assert five["2020-01"] > five["2020-02"] > 0


def test_calibration_keeps_order_and_support(spark):
    train = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 4.0])], "id int, v double")
    gen = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.2), (3, 0.3)], "id int, v double")
    out = {r["id"]: r["calibrated"] for r in su.quantile_map(train, gen, "id", "v", "id").collect()}
    assert sorted(out, key=out.get) == [0, 2, 3, 1] and all(1 <= x <= 4 for x in out.values())


def test_support_overlap(spark):
    v = [(0.01,)] * 60 + [(0.02,)] * 30 + [(0.03,)] * 10
    support = su.support_counts(spark.createDataFrame(v, "x double"), "x")
    parts = spark.createDataFrame([("test", 0.01), ("test", 0.02), ("syn", 0.01), ("syn", 0.015), ("syn", 0.2), ("syn", 0.0)], "part string, x double")
    got = {r["part"]: r["exact_overlap"] for r in su.split_overlap(parts, "part", "x", support, 0.0).collect()}
    assert got == {"test": 1.0, "syn": 0.25}


def test_running_statistics_over_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + dt.timedelta(hours=i // 2), float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "event_id int, user int, ts timestamp, value double")
    run = sh.RunningStatistics(spark, "user", "event_id", "ts", {"value": F.col("value")})
    for e, (a, b) in enumerate([(0, 8), (8, 16), (16, 24)]):
        run(df.where(F.col("event_id").between(a, b - 1)), e)
    late = df.where("event_id = 0").withColumn("ts", F.lit(t0 - dt.timedelta(days=9)).cast("timestamp"))
    run(late.unionByName(df.where("event_id = 23").withColumn("event_id", F.lit(99))), 3)
    got = {r["event_id"]: r["prior_value"] for r in run.results().collect()}
    for i, u, ts, _ in rows:
        assert got[i] == sum(v for _, w, t, v in rows if w == u and t < ts)
    assert run.dropped == 1 and 99 in got


def test_running_statistics_survive_a_rerun_and_a_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 4 == 0 else i % 3, t0 + dt.timedelta(hours=i // 2), float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "event_id int, user int, ts timestamp, value double")
    part = lambda e: df.where(F.col("event_id").between(8 * e, 8 * e + 7))
    run = sh.RunningStatistics(spark, "user", "event_id", "ts", {"value": F.col("value")})
    run(part(0), 0)
    run(part(1), 1)
    run(part(1), 1)  # the batch again
    again = sh.RunningStatistics(spark, "user", "event_id", "ts", {"value": F.col("value")}, path=run.path)
    again(part(1), 1)  # and after a restart
    again(part(2), 2)
    got = {r["event_id"]: (r["prior_count"], r["prior_value"]) for r in again.results().collect()}
    for i, u, ts, _ in rows:
        past = [v for _, w, t, v in rows if w == u and t < ts]
        assert got[i] == (len(past), sum(past))


def test_histories_keep_events_without_an_entity(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, None, t0), (1, None, t0 + dt.timedelta(days=1)), (2, 7, t0), (3, 7, t0 + dt.timedelta(days=2))]
    df = spark.createDataFrame(rows, "event_id int, user int, ts timestamp").withColumn("value", F.lit(2.0))
    got = {r["event_id"]: r["n"] for r in hi.with_prior_count(df, "user", "ts", "n").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}
    assert hi.history_features(df, "user", "ts", "value").count() == 4
