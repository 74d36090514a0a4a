"""Pseudonyms are a bijection within each written form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from chronoweave.llm import pseudonyms as ps


def mapped(spark, values):
    """value -> (kind, pseudonym)."""
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    rows = df.select("v", ps.pseudonym(F.col("v"), F.lit("key")).alias("p")).collect()
    return {r["v"]: (r["p"]["kind"], r["p"]["value"]) if r["p"] else (None, None) for r in rows}


def test_every_written_date_of_a_run_has_its_own_pseudonym(spark):
    days = [dt.date(1985, 1, 1) + dt.timedelta(i) for i in range(10_227)]
    forms = {"%Y-%m-%d": days, "%Y/%m/%d": days, "%d.%m.%Y": days, "%m/%d/%Y": days, "%d/%m/%Y": [d for d in days if d.day > 12]}
    written = {f: [d.strftime(f) for d in some] for f, some in forms.items()}
    got = mapped(spark, [v for some in written.values() for v in some])
    for f, some in written.items():
        new = [got[v] for v in some]
        assert {k for k, _ in new} == {"date"} and sorted(v for _, v in new) == sorted(some), f  # the form's own dates, each once
    slashed = written["%m/%d/%Y"] + written["%d/%m/%Y"]
    assert len({got[v][1] for v in slashed}) == len(slashed)


def test_other_runs_of_years_and_no_dates(spark):
    got = mapped(spark, ["31/12/1901", "31/12/2096", "13/01/1929", "31/12/2097", "31/02/2001", "00/00/2001", "13/13/2001"])
    assert {v: g[0] for v, g in got.items() if g[0]} == dict.fromkeys(("31/12/1901", "31/12/2096", "13/01/1929"), "date")
    for v, run in (("31/12/1901", 1901), ("31/12/2096", 2069), ("13/01/1929", 1929)):
        d, m, y = map(int, got[v][1].split("/"))
        assert d > 12 and run <= y < run + 28 and dt.date(y, m, d)


def test_country_codes_stay_without_a_separator(spark):
    rng = random.Random(3)
    numbers = [f"+{c}{rng.randrange(10**9):09d}" for c in ("49", "1", "7", "44", "351", "212", "20") for _ in range(200)]
    got = mapped(spark, numbers)
    for code in ("49", "1", "7", "44", "351", "212", "20"):
        mine = [v for v in set(numbers) if v.startswith(f"+{code}") and len(v) == 10 + len(code)]
        assert all(got[v][0] == "phone" and got[v][1].startswith(f"+{code}") and len(got[v][1]) == len(v) for v in mine)
        assert len({got[v][1] for v in mine}) == len(mine)


def test_small_permutations_are_bijections(spark):
    two = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    assert sorted(r[0] for r in two.select(ps.permuted_digits(F.col("d"), F.lit("k"), "t")).collect()) == [f"{i:02d}" for i in range(100)]
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert len({r[0] for r in three.select(ps.permuted_digits(F.col("d"), F.lit("k"), "t")).collect()}) == 1000
    ssn = [f"{a:03d}-{g:02d}-{n:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for n in (1, 5, 9999)]
    assert len({v for _, v in mapped(spark, ssn).values()}) == len(ssn)


def test_repeated_rows_long_texts_and_clashing_names(spark):
    long = "x " * 200_000 + "call +491701234567 on 31/12/2001"
    df = spark.createDataFrame([(1, long, "a", "b"), (1, long, "a", "b"), (None, None, None, None), (2, "", "a", "b")], "doc_id long, text string, _hit string, _made string")
    rows = ps.pseudonymize(df, "k").collect()
    assert ps.pseudonymize(df, "k").columns == ["doc_id", "text", "_hit", "_made", "pii_counts"]
    whole = [r for r in rows if r["doc_id"] == 1]
    assert whole[0] == whole[1] and whole[0]["pii_counts"] == {"phone": 1, "date": 1} and whole[0]["_hit"] == "a" and len(whole[0]["text"]) == len(long)
    assert sorted((str(r["text"]), str(r["pii_counts"])) for r in rows if r["doc_id"] != 1) == [("", "{}"), ("None", "{}")]
    assert ps.pseudonymize(df.limit(0), "k").count() == 0
