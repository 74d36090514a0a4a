"""The curve by its definition, both laws on awkward tables, pruning, and the query against its SQL."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import hilbert_shards as hs
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_and_steps_to_neighbours(spark, n, bits):
    cells = spark.range(1 << n * bits).select(*[F.shiftright("id", bits * j).bitwiseAND((1 << bits) - 1).alias(f"c{j}") for j in range(n)])
    at = sorted(cells.withColumn("at", hs.curve_index(F.array(*[F.col(f"c{j}").cast("int") for j in range(n)]), n, bits)).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in at] == list(range(1 << n * bits))
    assert all(sum(abs(a[j] - b[j]) for j in range(n)) == 1 for a, b in zip(at, at[1:]))


def odd_table(spark):
    rows = [(i, "same" if i % 3 else None, ["en", "de", None][i % 3], i * 7 % 11, "x") for i in range(50)] + [(None, None, None, None, None)] * 9 + [(7, "same", "en", 5, "x")] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size long, Slot string")


@pytest.mark.parametrize("count", [1, 3, 8, 200])
def test_law_rows(spark, count):
    df = odd_table(spark)
    got = hs.shards(df, ("lang", "size", "doc_id"), count, "rows", ties=("text", "doc_id")).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    assert set(by) <= set(range(count))
    sizes = [len(by.get(s, [])) for s in range(count)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slot for slot, _ in v) == list(range(len(v))) for v in by.values())
    in_order = [c for s in sorted(by) for _, c in sorted(by[s])]
    assert in_order == sorted(in_order)


@pytest.mark.parametrize("count", [1, 4, 8])
def test_law_bytes(spark, count):
    got = hs.shards(odd_table(spark), ("lang", "size"), count, "bytes", size="size").collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] or 0 for r in got)
    assert set(by) == set(range(count)) and len(got) == 99
    assert all(abs(sum(r["size"] or 0 for r in v) - total / count) <= 10 for v in by.values())
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_empty_tables_and_wrong_parameters(spark):
    empty = odd_table(spark).limit(0)
    for law in hs.LAWS:
        out = hs.shards(empty, ("lang", "size"), 8, law)
        assert out.columns == ["doc_id", "text", "lang", "size", "curve", "shard", "slot"] and out.count() == 0
    with pytest.raises(ValueError):
        hs.shards(empty, ("lang",), 8, "key")
    with pytest.raises(ValueError):
        hs.on_curve(empty, ("lang",) * 11, 6)


def test_hot_cells_are_spread(spark, monkeypatch):
    df = spark.range(20_000).select(F.lit("hot").alias("lang"), (F.col("id") % 2).alias("size"), "id")
    got = hs.shards(df, ("lang", "size"), 8, ties=("id",))
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {2_500}


def test_written_shards_are_pruned_on_every_dimension(spark, tmp_path):
    df = spark.range(4_096).select("id", (F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    done = hs.shards(df, ("a", "b"), 16, bits=6)
    manifest = hs.write_shards(done, str(tmp_path / "t"), ("a", "b"), rows_per_file=100)
    assert manifest.agg(F.sum("rows")).first()[0] == 4_096
    for wanted in ({"a": (0, 15)}, {"b": (48, None)}, {"a": (16, 31), "b": (None, 15)}):
        few = hs.shards_to_read(manifest, wanted)
        assert len(few) <= 4, (wanted, few)
        plain = df
        for c, (lo, hi) in wanted.items():
            plain = plain.where((F.col(c) >= (lo or 0)) & (F.col(c) <= (99 if hi is None else hi)))
        assert sorted(r["id"] for r in hs.read_shards(spark, str(tmp_path / "t"), wanted).collect()) == sorted(r["id"] for r in plain.collect())
    assert hs.shards_to_read(manifest, {"a": (100, None)}) == []


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(QUERIES["op12_hilbert_shards"].sql)
    names = [d[0] for d in cur.description]
    out = hs.op12_hilbert_shards(spark, SF)
    assert out.columns == names
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(cur.fetchall())
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all((size, crc) == (len(text[d]) + 1, zlib.crc32(text[d])) for d, size, crc, *_ in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
