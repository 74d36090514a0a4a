import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import kernels as k
from chronoweave.functions.hashing import hashed_long, hashed_unit


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 600
    # one group holds more than a third of the rows
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n))
    return pd.DataFrame({"g": g, "t": rng.integers(0, 50, n), "id": np.arange(n), "v": rng.integers(0, 9, n)})


@pytest.mark.parametrize("hot", [0, 10**9])
@pytest.mark.parametrize("partitions", ["1", "2", "17"])
def test_ordered_equals_pandas_on_both_plans(spark, rows, hot, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows)
        out = k.ordered(df, ["g"], ["t", "id"], rank="rk", before={"b": F.col("v")}, through={"c": F.col("v")},
                        previous={"p": F.col("id")}, following={"f": F.col("id")}, hot=hot).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = rows.sort_values(["g", "t", "id"])
    grouped = want.groupby("g")
    want = want.assign(rk=grouped.cumcount() + 1, c=grouped["v"].cumsum(), p=grouped["id"].shift(1), f=grouped["id"].shift(-1))
    want["b"] = want["c"] - want["v"]
    a, b = out.set_index("id").sort_index(), want.set_index("id").sort_index()
    for c in ("rk", "b", "c", "p", "f"):
        assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c


@pytest.mark.parametrize("by", [["g"], ["g", "h"]])
def test_both_plans_keep_rows_with_null_keys(spark, rows, by):
    df = spark.createDataFrame(rows).withColumns({"g": F.when(F.col("g") != "hot", F.col("g")), "h": F.when(F.col("id") % 3 > 0, F.col("id") % 2)})
    plans = [k.ordered(df, by, ["t", "id"], rank="rk", before={"b": F.col("v")}, previous={"p": F.col("id")}, hot=hot).orderBy("id").collect() for hot in (0, 10**9)]
    assert plans[0] == plans[1] and len(plans[0]) == len(rows)
    per = k.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()
    assert None in {r["g"] for r in per}


def test_global_rank_and_quantiles(spark, rows):
    df = spark.createDataFrame(rows).repartition(7)
    out = k.numbered(df, ["t", "id"]).toPandas().set_index("id")["position"].sort_index()
    want = rows.sort_values(["t", "id"]).reset_index(drop=True).reset_index().set_index("id")["index"].sort_index() + 1
    assert (out == want).all()
    q = k.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.93}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(list(np.quantile(rows["v"], [0.1, 0.5, 0.93])))
    per = {r["g"]: r["m"] for r in k.quantiles(df, "t", {"m": 0.25}, ["g"]).collect()}
    for g, part in rows.groupby("g"):
        assert per[g] == pytest.approx(np.quantile(part["t"], 0.25))
    grid = [r["value"] for r in k.quantile_grid(df, "t", 41).orderBy("knot").collect()]
    assert grid == pytest.approx(list(np.quantile(rows["t"], np.linspace(0, 1, 41))))


def test_hashed_uniform_is_fixed(spark):
    one = spark.createDataFrame([(7,)], "x long").select(hashed_long(42, "x").alias("h"), hashed_unit(42, "x").alias("u")).first()
    assert one["h"] == 2091261189250984 and 0 < one["u"] < 1


def test_guarded_corr_is_null_when_flat(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(k.guarded_corr(F.col("a"), F.col("b"))).first()[0] is None


def test_intermediate_tables_are_written_once(spark):
    df = k.materialize(spark.range(5))
    assert k.materialize(df) is df and df.count() == 5
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString() or "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [0, 10**9])
def test_expressions_of_an_order_are_worked_out_once_a_row(spark, rows, hot):
    """A sort must compare columns: an expression left in it would be worked out in every comparison."""
    seen = []
    df = spark.createDataFrame(rows)
    real = k.materialize
    try:
        k.materialize = lambda d: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d)
        out = k.ordered(df, ["g"], ["t", hashed_long("s", "id"), F.desc("id")], rank="rk", hot=hot)
    finally:
        k.materialize = real
    assert not any("md5" in line for plan in seen for line in plan.splitlines() if "Sort" in line or "RepartitionByExpression" in line)
    assert set(out.columns) == {*rows.columns, "rk"} and out.select("g", "rk").distinct().count() == len(rows)


def test_ranks_in_steps_equal_ranks_by_window(spark, rows):
    df = spark.createDataFrame(rows).withColumns({"g": F.when(F.col("g") != "a", F.col("g")), "t": F.when(F.col("t") != 7, F.col("t"))})
    want = k.ordered(df, ["g"], ["t", hashed_long("s", "id"), "id"], rank="rk").select("id", "rk").orderBy("id").collect()
    assert k.ranked_in_steps(df, ["g"], "t", [hashed_long("s", "id"), "id"], "rk").select("id", "rk").orderBy("id").collect() == want
