"""Similarity join on word n-gram sets: MinHash bands give candidate pairs, a Bayesian test prunes them, Jaccard decides.

1. Texts with the same set of five-word shingles form one class; only classes go on.
2. Classes that agree on all values of a MinHash band meet in a bucket. Large buckets are cut into blocks, and each pair
   of blocks is one bounded piece of work, however many near copies a group has.
3. In a piece, MinHash values are compared a few at a time; a pair is dropped once the posterior probability that its
   similarity reaches the threshold is below the tolerance.
4. Survivors are verified exactly on their shingle sets, piece by piece. Pairs are counted there, not written out; what
   leaves a piece is a number of links per class and a spanning edge, from which the groups are connected.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize
from chronoweave.llm.common import bounded_batches, connected, query, table, whole_text

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_VALUES = 20, 4  # a pair at the threshold shares no band with probability 3e-5
CHUNK, TOLERANCE = 16, 1e-5
BLOCK = 512

_WORD = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, one without words none."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), dtype=np.uint64)
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mixed(h * _ODD[i % 5] + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, BANDS * BAND_VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * BAND_VALUES, dtype=np.uint64)


def minhash(h: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = np.full(len(factor), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 2048):
        low = np.minimum(low, (h[i : i + 2048, None] * factor + shift).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values: the fewest matches m with P(similarity >= threshold | m of n) >= tolerance, uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its tail is the binomial sum P(Bin(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(CHUNK, BANDS * BAND_VALUES + 1, CHUNK):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def candidates(sig: np.ndarray, block: np.ndarray, band: int, cross: bool, needed: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of one piece of work that survive the incremental comparison.

    A pair that shares an earlier band belongs to the piece of that band and is left to it.
    """
    if cross:
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    else:
        a, b = np.triu_indices(len(sig), 1)
    same = np.zeros(len(a), dtype=np.int16)
    earlier = np.ones(len(a), dtype=bool)
    for n in sorted(needed):
        hit = sig[a, n - CHUNK : n] == sig[b, n - CHUNK : n]
        same += hit.sum(axis=1, dtype=np.int16)
        bands = hit.reshape(len(a), -1, BAND_VALUES).all(axis=2)
        first_band = (n - CHUNK) // BAND_VALUES
        for k in range(bands.shape[1]):
            if first_band + k < band:
                earlier &= ~bands[:, k]
        keep = (same >= needed[n]) & earlier
        a, b, same, earlier = a[keep], b[keep], same[keep], earlier[keep]
        if not len(a):
            break
    return a, b


def described(df: DataFrame, row: str, text: str) -> DataFrame:
    """(id, text_hash, key, n, sig) for every row: key names the shingle set, sig holds the MinHash values."""
    bounded_batches(df.sparkSession)

    def run(batches):
        factor, shift = _permutations()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for t in batch.column(2).to_pylist():
                h = shingles(t)
                keys.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                sizes.append(len(h))
                sigs.append(minhash(h, factor, shift).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["id", "text_hash", "key", "n", "sig"])

    given = df.select(F.col(row).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), whole_text(text).alias("text"))
    return given.mapInArrow(run, "id long, text_hash long, key string, n int, sig binary")


def _pieces(classes: DataFrame) -> DataFrame:
    """One row per bucket, or pair of blocks of a large bucket, with its members."""
    values = [F.substring("sig", 4 * BAND_VALUES * b + 1, 4 * BAND_VALUES) for b in range(BANDS)]
    banded = classes.select("key", F.posexplode(F.array(*[F.xxhash64(F.lit(b), v) for b, v in enumerate(values)])).alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    placed = banded.join(shared, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("band", "bucket", "key", "block", other).select("band", "bucket", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    members = placed.join(classes.select("key", "size", "sig"), "key")
    return members.groupBy("band", "bucket", "low", "high").agg(F.collect_list(F.struct("key", "block", "size", "sig")).alias("members"))


def _survivors(pieces: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    def run(batches):
        needed = least_matches(threshold, tolerance)
        for batch in batches:
            bands, buckets, lows, highs = (batch.column(i).to_pylist() for i in range(4))
            members = batch.column(4)
            flat, at = members.flatten(), members.offsets.to_numpy() - members.offsets[0].as_py()
            key, size = flat.field("key"), flat.field("size").to_numpy()
            block = flat.field("block").to_numpy()
            sig = np.frombuffer(b"".join(flat.field("sig").to_pylist()), dtype=np.uint32).reshape(-1, BANDS * BAND_VALUES)
            out = [[] for _ in range(8)]
            for r in range(batch.num_rows):
                s, e = at[r], at[r + 1]
                cross = lows[r] != highs[r]
                if e - s < 2 or (cross and block[s:e].min() == block[s:e].max()):
                    continue
                a, b = candidates(sig[s:e], block[s:e], bands[r], cross, needed)
                if len(a):
                    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                    for c, v in zip(out, (bands[r], buckets[r], lows[r], highs[r], key.take(pa.array(s + used)).to_pylist(), size[s + used].tolist(), place[: len(a)].tolist(), place[len(a) :].tolist())):
                        c.append(v)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["band", "bucket", "low", "high", "keys", "sizes", "a", "b"])

    return pieces.mapInArrow(run, "band int, bucket long, low int, high int, keys array<string>, sizes array<long>, a array<int>, b array<int>")


def _shingled(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(key, set) of the wanted classes, from one text each."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(h.tobytes()) for h in sets]), pa.array([h.tobytes() for h in sets], pa.binary())], ["key", "set"])

    texts = df.select(F.xxhash64(F.col(text)).alias("text_hash"), whole_text(text).alias("text")).join(wanted.select("text_hash"), "text_hash", "left_semi")
    return texts.select("text").mapInArrow(run, "key string, set binary").dropDuplicates(["key"])


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of common shingles of each pair."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1, 2048):
        s, e = np.searchsorted(column, [start, start + 2048])
        held = np.zeros((len(sets), 2048), dtype=np.float32)
        held[owner[s:e], column[s:e] - start] = 1
        total += held @ held.T
    return total[a, b].astype(np.int64)


def _verified(survivors: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) for each class with a verified link in a piece; root joins the linked classes of the piece."""
    piece = ["band", "bucket", "low", "high"]
    members = survivors.select(*piece, F.posexplode("keys").alias("at", "key")).join(sets, "key")
    gathered = members.groupBy(*piece).agg(F.array_sort(F.collect_list(F.struct("at", "set"))).alias("members"))

    def run(batches):
        for batch in batches:
            keys, sizes, first, second = (batch.column(i) for i in range(4))
            out_key, out_links, out_root = [], [], []
            for r in range(batch.num_rows):
                sets = [np.frombuffer(m["set"].as_buffer(), dtype=np.uint64) for m in batch.column(4)[r]]
                a, b = np.array(first[r].as_py()), np.array(second[r].as_py())
                common = intersections(sets, a, b)
                n = np.array([len(s) for s in sets])
                ok = common >= threshold * (n[a] + n[b] - common) - 1e-9
                if not ok.any():
                    continue
                a, b = a[ok], b[ok]
                size = np.array(sizes[r].as_py())
                links = np.bincount(a, size[b], len(n)) + np.bincount(b, size[a], len(n))
                root = np.arange(len(n))
                while True:
                    low = root.copy()
                    np.minimum.at(low, a, root[b])
                    np.minimum.at(low, b, root[a])
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
                name = keys[r].as_py()
                for i in np.unique(np.concatenate([a, b])):
                    out_key.append(name[i])
                    out_links.append(int(links[i]))
                    out_root.append(name[root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.string()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.string())], ["key", "links", "root"])

    return survivors.join(gathered, piece).select("keys", "sizes", "a", "b", "members").mapInArrow(run, "key string, links long, root string")


def join(df: DataFrame, row: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, text_hash, copy_id, class_id, class_hash, n_links), one row per row of `df`.

    copy_id   smallest id with the same set of shingles
    class_id  smallest id among the texts connected by links; class_hash tells apart rows that repeat an id
    n_links   number of other rows whose shingle sets have a Jaccard similarity of `threshold` or more (copies included)
    A text without words (null, empty) has no shingles: it is linked to nothing and is a class of its own. Rows that
    repeat an id are rows of their own; a null id takes part by its text. Other columns of `df` are not looked at.
    """
    rows = materialize(described(df, row, text))
    full = rows.where("n > 0")
    classes = full.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "text_hash")).alias("least"), F.min("id").alias("copy_id"), F.first("sig").alias("sig"), F.first("text_hash").alias("text_hash"))
    classes = materialize(classes)
    survivors = materialize(_survivors(_pieces(classes), threshold, tolerance))
    wanted = survivors.select(F.explode("keys").alias("key")).distinct().join(classes, "key").select("text_hash")
    found = materialize(_verified(survivors, _shingled(df, text, wanted), threshold))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = connected(links.select("key"), found.select("key", "root"), "key", "key", "root")
    named = classes.select("key", "size", "least", "copy_id").join(links.join(groups, "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # struct ordering puts a null id first; a class goes by its smallest id, and by a null one only where it has no other
    heads = named.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("least.id").isNotNull(), F.col("least"))), F.min("least")).alias("head"), F.min("copy_id").alias("class_id"))
    known = named.join(heads, "root").select("key", "copy_id", "class_id", F.col("head.text_hash").alias("class_hash"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    done = full.select("id", "text_hash", "key").join(known, "key").drop("key")
    alone = rows.where("n = 0").select("id", "text_hash", F.col("id").alias("copy_id"), F.col("id").alias("class_id"), F.col("text_hash").alias("class_hash"), F.lit(0).cast("long").alias("n_links"))
    return done.unionByName(alone)


def one_of_each(df: DataFrame, row: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that stay: of each class the one with the smallest id, exactly once even if the row is repeated.

    Texts without words all stay.
    """
    decided = materialize(join(df, row, text, threshold))
    heads = decided.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    names = heads.select(F.col("id").alias("_head"), F.col("text_hash").alias("_hash"))
    kept = df.withColumns({"_id": F.col(row).cast("long"), "_text": F.xxhash64(F.col(text)), "_empty": ~F.rlike(whole_text(text), F.lit(r"[\p{L}\p{N}]"))})
    kept = kept.join(names, F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_text") == F.col("_hash")), "left_semi")
    if heads.where("rows > 1").limit(1).count():
        kept = kept.where("not _empty").dropDuplicates(["_id", "_text"]).unionByName(kept.where("_empty"))
    return kept.drop("_id", "_text", "_empty")


@query()
def op7_ngram_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).select(F.col("id").alias("doc_id"), "class_id", "copy_id", "n_links")
