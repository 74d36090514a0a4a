"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again before the
next one. Every stage works on all rows its predecessor kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize
from chronoweave.llm import byte_bpe, decontaminate, jaccard_join, language, secrets
from chronoweave.llm.common import bucket_of_id, table

REMEMBERED_BYTES = 16 << 20  # of pre-tokens, in a worker that the other stages share; the tokens do not depend on it
#: SQL expresses neither the network nor the tokens; tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL = None


def language_id(spark, docs, sf_dir):
    """Documents without a determinable language go (no text, no letter, nothing learned); a missing `lang` is filled in."""
    held = bucket_of_id("doc_id", 4) == 2
    net = language.fit(docs.where(~held).select("doc_id", "text", "lang"))
    rows = language.predict(docs, net, "text", "_lang", "_score")
    kept = rows.where(F.col("_lang") != language.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of copies stays."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item_text")), item_text="item_text")


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked in the text."""
    done = secrets.mask_secrets(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark, docs, sf_dir):
    """(doc_id, token_ids, n_tokens, round_trip): ids of the whole text, and whether they decode to its bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = byte_bpe.round_trip(docs.select("doc_id", "text"), path, pattern, keep=False, remember=REMEMBERED_BYTES)
    return done.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", tokens),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
