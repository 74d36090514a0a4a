"""Runs of words against the definition, and the query against a slow rewrite in plain Python."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from chronoweave.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def runs_by_definition(x, least_words=24, least_periods=3):
    n, out = len(x), set()
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            smaller = any(all(x[k] == x[k + r] for k in range(i, j + q - r)) for r in range(1, q))
            if j + q - i >= max(least_words, least_periods * q) and not smaller:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def lyndon_by_definition(x):
    """The next smaller suffix ends the longest Lyndon word."""
    return [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]


def some_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < rng.randint(0, 300):
            if rng.random() < 0.5:
                words += [str(rng.randrange(30)) for _ in range(rng.randint(1, 60))]
            else:
                base = [str(rng.randrange(rng.choice([1, 2, 30]))) for _ in range(rng.randint(1, 15))]
                words += (base * 30)[: rng.randint(len(base), len(base) * 6)]
        yield words


def test_lyndon_lengths_of_short_words():
    rng = random.Random(1)
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(1, 40))]
        assert pr.lyndon_lengths(np.array(x)).tolist() == lyndon_by_definition(x)
        assert pr.runs_of(np.array(x), 2, 3) == runs_by_definition(x, 2, 3)


def test_runs_of_texts_taken_together():
    texts = list(some_texts(2, 250))
    assert pr.runs_of_texts(texts) == [runs_by_definition(t) for t in texts]
    assert sum(map(len, pr.runs_of_texts(texts))) > 50
    assert pr.runs_of_texts([]) == [] and pr.runs_of_texts([[], ["a"]]) == [[], []]


def test_equal_fingerprints_of_different_words_change_nothing(monkeypatch):
    texts = list(some_texts(3, 60))
    monkeypatch.setattr(pr.Extensions, "same", lambda self, i, k, length: np.ones(len(i), dtype=bool))
    assert pr.runs_of_texts(texts) == [runs_by_definition(t) for t in texts]


@pytest.mark.parametrize("x", [np.zeros(200_000, dtype=int), np.tile(np.arange(50), 4_000), np.tile(np.random.default_rng(4).integers(0, 3, 66_667), 3)])
def test_long_texts_take_near_linear_time(x):
    start = time.process_time()
    assert len(pr.runs_of(x)) >= 1
    assert time.process_time() - start < 20


def test_operator_on_odd_rows(spark):
    beat = " ".join(["tick tock"] * 20)
    rows = [(1, None, "kept", "r"), (2, "", "kept", "r"), (3, f"so \t\n{beat}  end", "kept", "r"), (None, beat, None, None), (3, f"so \t\n{beat}  end", "kept", "r"), (4, "a\x1cb " * 30, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _got string, RUNS string")
    out = pr.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "_got", "runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"], r["_got"]) for r in out.collect()), key=str)
    assert got == sorted([
        (0, [(0, 40, 2)], "tick tock", None), (1, [], "", "kept"), (2, [], "", "kept"), (3, [(1, 40, 2)], "so tick tock end", "kept"),
        (3, [(1, 40, 2)], "so tick tock end", "kept"), (4, [(0, 30, 1)], "a\x1cb", "x")], key=str)
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_query_against_plain_python(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^ \t-\r]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_definition(w) if n < 1_500 else pr.runs_of_texts([w])[0]  # the definition is slow
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[r["doc_id"]] = (len(runs), *(best[:3] if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
                             sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))
    out = pr.op11_periodic_runs(spark, SF)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", "runs_sha256 string", "collapsed_sha256 string"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    assert sum(v[0] for v in want.values()) > 10
