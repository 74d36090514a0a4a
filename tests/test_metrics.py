import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.kernels import tagged
from chronoweave.operators import counts as ct
from chronoweave.operators import spine_metrics as sm
from chronoweave.operators import table_metrics as tb
from chronoweave.operators import text_metrics as tm
from chronoweave.operators import two_sample as ts


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def sides(spark, real, synthetic, schema="x double"):
    return tagged(spark.createDataFrame([(v,) for v in real], schema), spark.createDataFrame([(v,) for v in synthetic], schema))


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=80).round(1), rng.normal(0.4, 1, size=53).round(1)
    both = sides(spark, a.tolist(), b.tolist()).withColumn("id", F.monotonically_increasing_id())
    grid = np.unique(np.concatenate([a, b]))
    ks = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / 80 - np.searchsorted(np.sort(b), grid, "right") / 53))
    assert ts.ks_distance(both, "x").first()["ks"] == pytest.approx(ks)
    q = np.linspace(0, 1, 80)
    assert ts.grid_distance(both, "x", ["id"]).first()["wasserstein"] == pytest.approx(np.mean(np.abs(np.quantile(a, q) - np.quantile(b, q))))
    cdf = lambda s: np.searchsorted(np.sort(s), grid, "right") / len(s)
    area = np.sum(np.abs(cdf(a) - cdf(b))[:-1] * np.diff(grid))
    assert ts.area_distance(both, "x").first()["wasserstein"] == pytest.approx(area)


def test_empty_side_rules(spark):
    both = sides(spark, [1.0, 2.0], [])
    assert ts.ks_distance(both, "x").first()["ks"] is None
    assert ts.ks_distance(both, "x", empty=0.0).first()["ks"] == 0.0


def test_equal_tables_have_no_shape_or_trend_error(spark):
    rows = [(i, 2 * i + i % 3, "ab"[i % 2]) for i in range(6)]
    same = spark.createDataFrame(rows, "x int, y int, label string").withColumn("id", F.monotonically_increasing_id())
    other = same.withColumns({"x": F.lit(9) - F.col("x") * F.col("x"), "label": F.lit("a")})
    specs = {"x": tb.ColumnSpec("numerical"), "y": tb.ColumnSpec("numerical"), "label": tb.ColumnSpec("categorical")}
    for synthetic, worse in ((same, False), (other, True)):
        both = tagged(same, synthetic)
        shape = [r["shape_error"] for r in tb.shape_errors(both, specs, "id").collect()]
        trend = [r["trend_error"] for r in tb.trend_errors(both, specs).collect()]
        assert (max(shape) > 0) == worse and (max(trend) > 1e-9) == worse


def test_foreign_key_cardinality_drops_when_children_pile_up(spark):
    parents = spark.range(5).select(F.col("id").alias("k"))
    real = spark.createDataFrame([(p,) for p, n in enumerate([5, 4, 3, 2, 1]) for _ in range(n)], "k long")
    piled = real.withColumn("k", F.lit(0).cast("long"))
    equal = values(tb.fk_cardinality(tagged(real, real), "k", parents))
    worse = values(tb.fk_cardinality(tagged(real, piled), "k", parents))
    assert equal["similarity"] == 1.0 and worse["similarity"] < 0.5 and worse["synthetic_gini"] > equal["synthetic_gini"]


def test_repeated_pairs_keep_both_definitions(spark):
    d = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "a")], "customer_id string, product_id string")
    one = ct.repeated_pair_statistics(d, ["customer_id", "product_id"]).first()
    assert one["repeated_row_rate"] == 0.5 and one["surplus_rate"] == 0.25


def test_spine_report_of_a_table_with_itself(spark):
    rows = [("c1", "p1", "2020-01-01"), ("c1", "p2", "2020-01-03"), ("c2", "p1", "2020-02-01"), ("c3", "p2", "2020-02-02")]
    s = spark.createDataFrame(rows, "customer_id string, product_id string, d string").withColumn("day", F.to_date("d")).drop("d")
    cb = spark.createDataFrame([("c1", 0), ("c2", 1), ("c3", 1)], "customer_id string, customer_block int")
    pb = spark.createDataFrame([("p1", 0), ("p2", 1)], "product_id string, product_block int")
    v = values(sm.spine_report(tagged(s, s), cb, pb))
    assert v["daily_count_l1"] == 0 and v["customer_degree_ks"] == 0 and v["exact_event_overlap_rate"] == 1
    assert v["block_pair_count_exact_match_rate"] == 1 and v["coactive_joint_rate"] == 1


def test_text_copies_and_duplicates(spark):
    real = spark.createDataFrame([(0, "Great product"), (1, "Works well"), (2, "Not good")], "doc_id long, text string")
    syn = spark.createDataFrame([(10, "Great product"), (11, "great product!"), (12, "Brand new"), (13, "Brand new")], "doc_id long, text string")
    both = tagged(real, syn)
    v = values(tm.copy_report(both, "text"))
    assert v["exact_copy_rate"] == 0.25 and v["normalized_copy_rate"] == 0.5
    lex = {(r["side"], r["metric"]): r["value"] for r in tm.lexical_report(both, "text").collect()}
    assert lex[("synthetic", "duplicate_rate")] == 0.5


def test_string_similarity_against_brute_force(spark):
    pairs = [("a b c d", "b a c d e"), ("x", "x"), ("", "y z"), ("the cat sat", "the dog sat down")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(tx.common_subsequence(tx.words("a"), tx.words("b")).alias("l"), tx.rouge_l(tx.words("a"), tx.words("b")).alias("r"), tx.jaccard(tx.words("a"), tx.words("b")).alias("j")).collect()
    for (a, b), row in zip(pairs, got):
        x, y = a.split(), b.split()
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        lcs = table[-1, -1]
        assert row["l"] == lcs
        assert row["r"] == pytest.approx(2 * lcs / (len(x) + len(y)) if x and y else 0.0)
        assert row["j"] == pytest.approx(len(set(x) & set(y)) / max(len(set(x) | set(y)), 1))


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Café, 'déjà' vu!",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(tx.tokens("t")).collect()]
    assert out[0] == ["café", ",", "'", "déjà", "'", "vu", "!"] and out[1] == [] and out[2] == []
    assert len(df.select(tx.ngrams(tx.tokens("t"), 3)).first()[0]) == 5


def test_largest_entry_counts_places_where_signs_cancel(spark):
    from chronoweave.plans.text_queries import embedding_summary

    # bi and bb fall on one place with opposite signs, ac on another one with a negative sign
    rows = spark.createDataFrame([(1, "bi bb ac"), (2, "ac"), (3, "bi bb")], "doc_id long, text string")
    got = {r["doc_id"]: (r["total"], r["top"]) for r in embedding_summary(rows).collect()}
    assert got == {1: (-1.0, 0.0), 2: (-1.0, -1.0), 3: (0.0, 0.0)}


def test_grams_of_a_long_text_take_linear_time(spark):
    import time

    words = [f"w{i % 59_000}" for i in range(60_000)]
    rows = spark.createDataFrame([(" ".join(words), True), ("a b a b a", False), ("", False)], "text string, is_real boolean")
    assert [r["g"] for r in rows.select(tx.joined_ngrams(F.split("text", " "), 3, " ").alias("g")).collect()][1:] == [["a b a", "b a b", "a b a"], []]
    start = time.perf_counter()
    got = {(r["side"], r["metric"]): r["value"] for r in tm.lexical_report(rows, "text").collect()}
    assert time.perf_counter() - start < 60
    assert got["real", "repeated_3gram_rate"] == pytest.approx((60_000 - 2 - 59_000) / (60_000 - 2)) and got["synthetic", "repeated_3gram_rate"] == pytest.approx(1 / 3)
