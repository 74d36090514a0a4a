"""The corpus pipeline on the smallest tables, stage by stage against brute force."""

import base64
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import jaccard_join, secrets
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == before
        stages[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(stages["language_id"]) == {d for d, t in start.items() if t and any(c.isalpha() for c in t)}
    sets = {d: set(jaccard_join.shingles(t).tolist()) for d, t in stages["language_id"].items()}
    kept = stages["near_duplicates"]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not any(alike(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert all(any(alike(sets[d], sets[o]) for o in sets if o != d) for d in set(sets) - set(kept))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    held = {d for d, t in kept.items() if any(f" {plain(i)} " in f" {plain(t)} " for i in items)}
    assert held <= set(kept) - set(stages["decontamination"])
    assert not any(s["kind"] != "lexed" for t in stages["secret_scan"].values() for s in secrets.spans_of(t))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in steps["byte_bpe"](spark, docs, SF).collect():
        assert r["round_trip"] and r["token_ids"] == library.encode_ordinary(stages["secret_scan"][r["doc_id"]])


def test_stages_on_odd_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the of and", None, None, 3), (3, "der die das", "de", "s", 1), (3, "der die das", "de", "s", 1)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_and_registration(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and out.where(~F.col("round_trip")).count() == 0 and out.count() > 0
