"""Text normalization, tokens, n-grams, hashed embeddings and string similarity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.hashing import as_col, hashed_long
from chronoweave.functions.cleaning import array_sum

# Unicode white space, token pattern, special tokens and word lists.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{N}_]"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{M}}\p{{N}}_ ]"
ASCII_WORD = "[A-Za-z0-9_']+"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPECIAL_TOKENS = ["[PAD]", "[BOS]", "[MASK]", "[UNK]", "[EOS]", "<empty>"]
LEAK_MARKERS = ["[MASK]", "[PAD]", "[CLS]", "[SEP]"]
POSITIVE_WORDS = ["great", "good", "excellent", "perfect", "love", "loved", "nice", "best", "amazing", "awesome", "wonderful"]
NEGATIVE_WORDS = ["bad", "poor", "terrible", "awful", "worst", "hate", "hated", "broken", "disappointed", "disappointing", "not"]
SUFFIXES = ["overall", "in practice", "after use", "for me", "as expected"]
SUMMARY_LENGTH_BUCKETS = {"len_0": (0, 0), "len_1_2": (1, 2), "len_3_5": (3, 5), "len_6_10": (6, 10),
                          "len_11_16": (11, 16), "len_17_32": (17, 32)}
COPY_LENGTH_BUCKETS = {"length_le_2": 2, "length_3_to_5": 5, "length_6_to_10": 10, "length_gt_10": None}

_EDGES = rf"^{SPACE}+|{SPACE}+$"


def squeeze(c) -> Column:
    """Trim, collapse white space, null to ''."""
    t = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(t, _EDGES, ""), rf"{SPACE}+", " ")


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def canonical(c) -> Column:
    """Squeezed text in Unicode composed form."""
    return squeeze(_composed(F.coalesce(as_col(c).cast("string"), F.lit(""))))


def private_form(c) -> Column:
    """Lower-case squeezed text."""
    return F.lower(squeeze(c))


def copy_form(c) -> Column:
    """Lower case without ASCII punctuation: equal texts under light edits."""
    return squeeze(F.regexp_replace(F.lower(squeeze(c)), ASCII_PUNCTUATION, ""))


def tokens(c) -> Column:
    """Words and single punctuation marks, lower case."""
    return F.regexp_extract_all(F.lower(squeeze(c)), F.lit(TOKEN), F.lit(0))


def tokens_or_empty(c) -> Column:
    t = tokens(c)
    return F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("<empty>")))


def words(c) -> Column:
    """White-space separated parts."""
    return F.filter(F.split(squeeze(c), " "), lambda x: x != "")


def ascii_words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(c).cast("string"), F.lit(""))), F.lit(ASCII_WORD), F.lit(0))


def word_length(c) -> Column:
    return F.size(words(c))


def char_length(c) -> Column:
    return F.length(squeeze(c))


def ngrams(tokens_col, n: int) -> Column:
    """Contiguous n-grams as token arrays; empty when there are fewer than n tokens.

    The tokens are bound as a lambda variable: written inline they would be tokenized again per gram.
    """

    def cut(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, F.lit(n)))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<array<string>>"))

    return F.transform(F.array(as_col(tokens_col)), cut)[0]


def joined_ngrams(tokens_col, n: int, separator: str = "\x1f") -> Column:
    """Contiguous n-grams as text. Spark compares arrays of texts by hash, but those of arrays element by element with all others."""

    def cut(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(separator, *[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(as_col(tokens_col)), cut)[0]


def char_ngrams(c, n: int) -> Column:
    def cut(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(as_col(c)), cut)[0]


def bucket_of(column: str, raw_id, buckets: int) -> Column:
    """Stable bucket of an id inside a named column."""
    return F.pmod(hashed_long(column, raw_id), F.lit(buckets))


def hashed_bag(df: DataFrame, key: str, tokens_col: Column, dim: int = 64, places: str | None = None) -> DataFrame:
    """(key, embedding): signed token counts hashed into `dim` places, scaled to length one.

    Long format in, one row per key out: tokens are counted per (key, place) before the shuffle. `places` names a column
    for the number of places that tokens fall on, among them those where the signs cancel out.
    """
    h = hashed_long("bag", F.col("token"))
    cells = (
        df.select(key, F.explode(tokens_col).alias("token"))
        .select(key, F.pmod(h, F.lit(dim)).cast("int").alias("place"),
                F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 1, 1.0).otherwise(-1.0).alias("sign"))
        .groupBy(key, "place").agg(F.sum("sign").alias("w"))
    )
    packed = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    hit = [F.size("m").alias(places)] if places else []
    with_norm = packed.select(key, *hit, raw.alias("raw")).withColumn("len", F.sqrt(array_sum(F.transform("raw", lambda v: v * v))))
    return with_norm.select(key, F.transform("raw", lambda v: F.coalesce(F.try_divide(v, F.col("len")), F.lit(0.0))).alias("embedding"), *([places] if places else []))


def text_encoder(encode: Callable[[Sequence[str]], Sequence[Sequence[float]]]):
    """Wrap a user's batch encoder (texts to vectors) as an Arrow UDF column function."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encode(s.fillna("").tolist())])

    return run


def token_vector_encoder(dim: int = 128):
    """Hash-seeded unit vector per token, averaged over the text."""
    import hashlib
    import re

    import numpy as np

    def encode(texts):
        seen: dict[str, np.ndarray] = {}

        def vector(token: str) -> np.ndarray:
            if token not in seen:
                seed = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "little")
                v = np.random.default_rng(seed).normal(size=dim)
                seen[token] = v / max(np.linalg.norm(v), 1e-12)
            return seen[token]

        out = []
        for text in texts:
            found = re.findall(ASCII_WORD, text.lower())
            out.append(np.mean([vector(t) for t in found], axis=0) if found else np.zeros(dim))
        return out

    return text_encoder(encode)


def sentiment(tokens_col, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """(positive - negative) share of the tokens; 0 without tokens."""
    t = as_col(tokens_col)
    score = F.size(F.filter(t, lambda x: x.isin(list(positive)))) - F.size(F.filter(t, lambda x: x.isin(list(negative))))
    return F.when(F.size(t) > 0, score / F.size(t)).otherwise(F.lit(0.0))


def jaccard(a, b) -> Column:
    """Token-set overlap; two empty texts are equal."""
    a, b = as_col(a), as_col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(T.LongType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays (bit-parallel rows)."""

    def one(x, y) -> int:
        masks: dict[str, int] = {}
        for i, token in enumerate(x):
            masks[token] = masks.get(token, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            hit = row & masks.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")


def rouge_l(a, b) -> Column:
    """F1 of the longest common subsequence against both lengths."""
    a, b = as_col(a), as_col(b)
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * common_subsequence(a, b) / total)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def named_bucket(c, buckets: dict[str, tuple[int, int]]) -> Column:
    """Name of the first bucket whose closed range holds the value; past the end, the last name."""
    c = as_col(c)
    out = None
    for name, (low, high) in buckets.items():
        hit = c.between(low, high)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(list(buckets)[-1]))


def copy_length_bucket(n) -> Column:
    n = as_col(n)
    out = F.when(n <= 2, "length_le_2").when(n <= 5, "length_3_to_5").when(n <= 10, "length_6_to_10")
    return out.otherwise("length_gt_10")


def tidy(c) -> Column:
    """Undo the spacing of joined tokens around punctuation and brackets."""
    c = F.regexp_replace(as_col(c), r"\s+([,.;:!?%)\]\}])", "$1")
    c = F.regexp_replace(c, r"([\(\[\{])\s+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+'", "'"), r"\s+", " "))
