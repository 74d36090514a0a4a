"""Similarity join, decontamination, nearest neighbours and connected classes against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, jaccard_join, neighbours
from chronoweave.llm.common import connected


def invented(rng, n, vocabulary=4_000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=1):
    """Texts with exact copies, near copies by a chain of edits, a large group of near copies, short and empty ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = invented(rng, rng.randrange(5, 200))
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base = list(base)
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(base))
    hot = invented(rng, 80)
    for i in range(60):
        copy = list(hot)
        copy[(7 * i) % 80] = f"y{i}"
        out.append(" ".join(copy))
    out += [out[0]] * 25 + ["", None, "a b", "A, b!", "a b c", "---", None]
    rng.shuffle(out)
    return out


def by_hand(texts, threshold=0.8):
    sets = [set(jaccard_join.shingles(t or "").tolist()) for t in texts]
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9 and common:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 8])
def test_join_equals_all_pairs(spark, monkeypatch, block):
    """Also with blocks so small that every group is cut."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted((r["id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(df).collect())
    assert got == by_hand(texts)


def test_one_of_each_group_stays(spark):
    texts = near_copies(2)
    expected = sorted(i for i, root, _ in by_hand(texts) if i == root)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("extra"))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == expected


def test_join_with_repeated_and_null_ids(spark):
    t = "one two three four five six seven eight nine"
    rows = [(1, t), (1, t), (None, t), (2, "other words than these are not in it"), (2, t), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(df).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3), (2, 2, 0), (2, 1, 3), (None, None, 0), (3, 3, 0)], key=str)
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard_join.one_of_each(df).collect())
    assert kept == sorted([("1", t), ("2", rows[3][1]), ("None", "None"), ("3", "")])
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_bayesian_limits_keep_pairs_at_the_threshold():
    needed = jaccard_join.least_matches(0.8, 1e-5)
    assert list(needed) == [16, 32, 48, 64, 80] and all(0 < m < 0.8 * n for n, m in needed.items())
    assert jaccard_join.least_matches(0.8, 0.5)[80] > needed[80]


def test_intersections_dense_and_sparse():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 6_000, 300).astype(np.uint64)) for _ in range(20)]
    a, b = np.triu_indices(20, 1)
    expected = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert jaccard_join.intersections(sets, a, b).tolist() == expected
    assert jaccard_join.intersections(sets, a[:5], b[:5]).tolist() == expected[:5]


def test_connected_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 80)] + [(400, 400), (500, None)]
    nodes = spark.range(600).select("id")
    got = {r["id"]: r["root"] for r in connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 200 for i in range(200, 280)) and got[400] == 400 and got[500] == 500


# --- decontamination


def windows_by_hand(docs, items, threshold=0.8):
    grams = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])((t or "").lower().split())
    out = {}
    for d, text in docs:
        g = grams(text)
        for k, item in items:
            h = grams(item)
            best = 0.0
            for s in range(len(g) if h else 0):
                a, b = Counter(g[s : s + len(h)]), Counter(h)
                low, high = sum((a & b).values()), sum((a | b).values())
                best = max(best, low / high)
            if best >= threshold:
                out[d, k] = round(best, 6)
    return out


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(4)
    items = [(k, " ".join(invented(rng, n))) for k, n in enumerate([12, 12, 20, 33, 60, 3, 5])] + [(7, ""), (8, None), (9, "a a a a a a a a a a a a")]
    docs = []
    for d in range(120):
        words = invented(rng, rng.randrange(0, 120))
        if d % 3 == 0:
            passage = items[rng.randrange(7)][1].split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "edited"
            if d % 2 and len(passage) > 20:  # moved sentences
                passage = passage[10:] + passage[:10]
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    docs += [(200, None), (201, ""), (202, items[5][1]), (203, "b a a a a a a a a a a a a c"), (204, items[4][1] + " " + items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hashes", F.lit("clash")).withColumn("item", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == windows_by_hand(docs, items) and len(got) > 10
    kept = decontaminate.without_benchmark(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_with_repeats_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    passage = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(1, passage), (1, passage), (None, "x " + passage), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, passage), (5, passage), (6, passage), (None, None)], "item_id long, text string")
    got = sorted((str(r["id"]), r["item_id"], r["similarity"]) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [("1", 5, 1.0), ("1", 6, 1.0), ("None", 5, 1.0), ("None", 6, 1.0)]
    assert [r["doc_id"] for r in decontaminate.without_benchmark(df, bench).collect()] == [2]


def test_decontamination_of_passages_cut_by_the_end_of_the_text(spark):
    rng = random.Random(12)
    items = [(k, " ".join(invented(rng, n))) for k, n in enumerate([60, 60, 33, 20])]
    docs = []
    for d in range(120):
        passage = items[d % 4][1].split()
        passage = passage[: round(len(passage) * rng.uniform(0.75, 1))]
        docs.append((d, " ".join((invented(rng, rng.randrange(60)) if d % 3 else []) + passage)))
    docs.append((200, " ".join(items[0][1].split()[:51])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == windows_by_hand(docs, items) and got[200, 0] == round(47 / 56, 6)
    assert 200 not in {r["doc_id"] for r in decontaminate.without_benchmark(df, bench).collect()}


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), rng.randrange(decontaminate.RADIUS + 1)):
            b |= 1 << bit
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        rows.append((signed(a), signed(a ^ b)))
    df = spark.createDataFrame(rows, "a long, b long")
    shared = F.size(F.array_intersect(decontaminate.blocks(F.col("a"), decontaminate.RADIUS), decontaminate.blocks(F.col("b"), decontaminate.RADIUS)))
    assert df.where(shared == 0).count() == 0


def test_simhash_is_the_sign_of_votes(spark):
    hashes = [3, -1, 1 << 40, 5, 5]
    votes = [sum(1 if (h >> bit) & 1 else -1 for h in hashes) for bit in range(64)]
    expected = sum(1 << bit for bit, v in enumerate(votes) if v > 0)
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(decontaminate.simhash(F.col("h"))).first()[0]
    assert got % (1 << 64) == expected


# --- nearest neighbours


def test_neighbours_recall_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1_500, 24)) * rng.uniform(0.5, 2, (1_500, 1))
    v[100:400] = v[7]  # a third of the rows around one vector, many of them equal
    v[300:400] += rng.normal(size=(100, 24)) * 1e-3
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(2_000, None), (2_020, [0.0] * 24), (2_040, [float("nan")] + [1.0] * 23), (2_060, [1.0] * 23 + [None]), (2_080, [1.0]), (None, v[0].tolist()), (2_100, [float("inf")] * 24), (2_120, [])]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0))
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"], r["rank"]))
    hit = 0
    assert sorted(got) == list(range(0, 1_500, 20))
    for q, found in got.items():
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hit += len({i for i, _, _ in found} & set(best.tolist()))
        assert len(found) == 20 and [r for _, _, r in found] == list(range(1, 21)) and all(abs(s[i] - x) < 1e-12 for i, x, _ in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hit / (20 * len(got)) > 0.95
    for q in range(100, 300, 20):  # equal vectors: ties in order of id
        same = sorted({7, *range(100, 300)} - {q})
        longer = (v * v[q]).sum(axis=1)[[i for i in range(1_500) if i not in same and i != q]]
        if longer.max() < v[q] @ v[q]:
            assert [i for i, _, _ in got[q]] == same[:20]


def test_repeated_rows_and_ids_take_one_place(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    far = [(7, (v[7] * 0.5 + 1e-3 * j).tolist()) for j in range(60)] + [(9, (v[9] * (1 + 1e-3 * j)).tolist()) for j in range(60)]
    top = int(np.argmax(np.where(np.arange(300) == 0, -np.inf, v @ v[0])))
    df = spark.createDataFrame(rows * 2 + [rows[top]] * 30 + far, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(df, (F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    every, of = np.vstack([v] + [np.array([x]) for _, x in far]), np.array([*range(300), *[i for i, _ in far]])
    hit = 0
    for q in range(0, 300, 20):
        s = np.full(300, -np.inf)
        np.maximum.at(s, of, (every * v[q]).sum(axis=1))
        s[q] = -np.inf
        assert len(got[q]) == 20 and len({i for i, _ in got[q]}) == 20 and all(abs(s[i] - x) < 1e-12 for i, x in got[q])
        hit += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert hit / 300 > 0.95


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(8, 0.95) - 15.507) < 1e-3 and abs(neighbours.chi_square_quantile(2, 0.5) - 1.3863) < 1e-4


def test_neighbours_of_vectors_of_very_different_lengths(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=6) for i in range(60)}
    vectors |= {100: rng.normal(size=6) * 1e200, 101: rng.normal(size=6) * 1e-200, 102: rng.normal(size=6) * 1e9, 103: np.array([1e-310, 0, 0, 0, 0, 2e-310]), 120: rng.normal(size=6) * 1e90}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, confidence=0.9999).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    assert set(got) == {0, 20, 40, 100, 120}
    for q, found in got.items():
        scores = {i: float((v * vectors[q]).sum()) for i, v in vectors.items() if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert [found[r][0] for r in range(1, 6)] == want, q
        assert all(found[r][1] == pytest.approx(scores[i], rel=1e-12) for r, i in enumerate(want, 1))


def test_truncated_passages_in_sql_and_spark(spark):
    import duckdb

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((60, 40, 12, 3))]
    docs, cut = [], {0: (51, 47, 46), 1: (34, 33, 30), 2: (12, 11), 3: (3,)}
    for i, text in items:
        for keep in cut[i]:
            held = " ".join(text.split()[:keep])
            docs += [held, " ".join(word() for _ in range(30)) + " " + held, held + " " + " ".join(word() for _ in range(30))]
    docs = [(100 + i, t) for i, t in enumerate([*docs, "", None])]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r["id"], r["item_id"], round(r["similarity"], 6)) for r in found.collect())
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert got == sorted(con.execute(decontaminate.SQL).fetchall())
    assert (100, 0, 0.839286) in got and (101, 0, 0.839286) in got  # the first 51 of 60 words, at the end of a text
