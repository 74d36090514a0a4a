"""Category and token vocabularies, and fixed-width token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.kernels import numbered


def category_vocabulary(df: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    """(token, id, n): most frequent first, ties by text. `<missing>` leads only when the data has no missing cell."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(counts, [F.desc("n"), "token"], "rk")
    if ranked.where(F.col("token") == missing).limit(1).isEmpty():
        extra = df.sparkSession.createDataFrame([(missing, 0, 0)], "token string, n long, rk long")
        return ranked.unionByName(extra).select("token", F.col("rk").alias("id"), "n")
    return ranked.select("token", (F.col("rk") - 1).alias("id"), "n")


def encode_category(df: DataFrame, column: str, vocabulary: DataFrame, out: str, missing: str = "<missing>") -> DataFrame:
    """Id of the category; unknown is 0."""
    keyed = df.withColumn("_token", F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    ids = vocabulary.select(F.col("token").alias("_token"), F.col("id").alias(out))
    return keyed.join(ids, "_token", "left").withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_token")


def token_vocabulary(
    df: DataFrame, tokens: Column, size: int = 30_000, min_frequency: int = 1, specials: Sequence[str] = tuple(tx.SPECIAL_TOKENS)
) -> DataFrame:
    """(token, id, n): specials first, then the most frequent tokens, ties by text, up to `size` entries."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("n") >= min_frequency) & ~F.col("token").isin(list(specials)))
    top = counts.orderBy(F.desc("n"), "token").limit(max(size - len(specials), 0))
    learned = numbered(top, [F.desc("n"), "token"], "rk").select("token", (F.col("rk") - 1 + len(specials)).alias("id"), "n")
    fixed = df.sparkSession.createDataFrame([(t, i, 0) for i, t in enumerate(specials)], "token string, id long, n long")
    return fixed.unionByName(learned)


def encode_tokens(df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, width: int) -> DataFrame:
    """(key, ids, length): BOS + ids + EOS, cut to `width` and padded with PAD.

    The cut comes before the explode, so a very long text costs no more than `width` rows.
    """
    if width < 2:
        raise ValueError("width must leave room for BOS and EOS")
    pad, bos, unk, eos = (tx.SPECIAL_TOKENS.index(t) for t in ("[PAD]", "[BOS]", "[UNK]", "[EOS]"))
    rows = df.select(key, F.posexplode(F.slice(tokens, 1, max(width - 2, 1))).alias("at", "token"))
    if width == 2:
        rows = rows.where(F.lit(False))
    ids = rows.join(vocabulary.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(unk)))
    packed = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("cells"))
    full = df.select(key).join(packed, key, "left")
    body = F.coalesce(F.transform("cells", lambda c: c["id"]), F.array().cast("array<long>"))
    marked = F.concat(F.array(F.lit(bos).cast("long")), body, F.array(F.lit(eos).cast("long")))
    return full.select(
        key, F.size(marked).alias("length"),
        F.transform(F.concat(marked, F.array_repeat(F.lit(pad).cast("long"), width - F.size(marked))), lambda v: v.cast("int")).alias("ids"),
    )


def decode_tokens(df: DataFrame, key: str, ids: str, vocabulary: DataFrame) -> DataFrame:
    """Text back from ids: stops at the first EOS or PAD, drops other specials, restores spacing."""
    stop = [tx.SPECIAL_TOKENS.index(t) for t in ("[EOS]", "[PAD]")]
    skip = [tx.SPECIAL_TOKENS.index(t) for t in ("[BOS]", "[MASK]", "[UNK]", "<empty>")]
    ends = F.array_min(F.filter(F.transform(ids, lambda v, i: F.when(v.isin(stop), i)), lambda x: x.isNotNull()))
    body = F.slice(F.col(ids), F.lit(1), F.coalesce(ends, F.size(ids)))
    rows = df.select(key, F.posexplode(body).alias("at", "id")).where(~F.col("id").isin(skip))
    named = rows.join(vocabulary.select("token", F.col("id").cast("int").alias("id")), "id", "left")
    packed = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("cells"))
    joined = F.array_join(F.transform("cells", lambda c: c["token"]), " ")
    return df.select(key).join(packed.select(key, tx.tidy(joined).alias("text")), key, "left").withColumn(
        "text", F.coalesce("text", F.lit("")))
