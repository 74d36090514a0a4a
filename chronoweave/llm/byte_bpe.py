"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte pieces. A bucket per merge rank holds the left positions whose pair has that
rank; a bitmap of three levels tells which buckets are in use, and find-first-set picks the lowest. Entries whose pair
has changed meanwhile are skipped when they come up. A pre-token of n bytes takes O(n log n) at worst, however long.
Pre-tokens of a batch of texts share one queue, each distinct one is merged once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import bounded_batches, fresh_name, query, table, whole_text, without

REMEMBERED_BYTES = 80 << 20  # of pre-tokens a worker remembers in each of two generations; results do not depend on it
ENTRY_BYTES = 200  # of a remembered pre-token beside its text and ids
LONG_PIECE = 256  # longer ones are not remembered
PIECES_AT_ONCE = 2_000  # pre-tokens that share the queue
CHARS_AT_ONCE = 1_000_000  # texts are taken together up to this size (a longer text alone)
BATCH_ROWS, BATCH_SIZE = 200, "1m"  # a batch becomes pieces, ids, bytes and Arrow arrays, several times its own size together
MAX_VOCABULARY_BYTES = 64 << 20  # size check of the one broadcast


class RankQueue:
    """Positions by rank; ranks in use are the set bits of 64-bit words, with two levels of summary words above."""

    def __init__(self, ranks: int):
        n0 = (ranks + 63) // 64
        n1 = (n0 + 63) // 64
        self.low, self.mid, self.top = [0] * n0, [0] * n1, [0] * ((n1 + 63) // 64)
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none; later positions are appended to it."""
        self.buckets[rank] = positions
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[i >> 6] |= 1 << (i & 63)
        self.top[i >> 12] |= 1 << ((i >> 6) & 63)

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use, and its bucket, which leaves the queue."""
        for t, word in enumerate(self.top):
            if word:
                break
        else:
            return None
        m = (t << 6) + (word & -word).bit_length() - 1
        word = self.mid[m]
        i = (m << 6) + (word & -word).bit_length() - 1
        word = self.low[i]
        rank = (i << 6) + (word & -word).bit_length() - 1
        self.low[i] = word & (word - 1)
        if not self.low[i]:
            self.mid[m] &= ~(1 << (i & 63))
            if not self.mid[m]:
                self.top[t] &= ~(1 << (m & 63))
        return rank, self.buckets.pop(rank)


class Codec:
    def __init__(self, vocabulary: bytes, pattern: str):
        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.size = max(self.ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # rank of a pair of neighbours, by both ids
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
        self.first = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)  # empty again after each merge()
        self.known: dict[str, bytes] = {}  # ids as packed integers
        self.older: dict[str, bytes] = {}  # what was known when the memory was last full; what is used of it moves over
        self.held, self.remember = 0, REMEMBERED_BYTES  # bytes of `known`, and their bound

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token. They share one queue: pairs never reach across a border between two of them."""
        size, pair, queue = self.size, self.pairs.get, self.queue
        buckets, rank_open = queue.buckets, queue.open
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n, ends = len(flat), np.cumsum([len(p) for p in pieces])
        starts = [0, *ends[:-1].tolist()]
        ranks_now = np.full(n, -1)
        ranks_now[:-1] = self.first[flat[:-1].astype(np.int64) * 256 + flat[1:]]
        ranks_now[ends - 1] = -1
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[starts], after[ends - 1] = -1, -1
        token, before, after, rank_at = self.single[flat].tolist(), before.tolist(), after.tolist(), ranks_now.tolist()
        used = np.flatnonzero(ranks_now >= 0)
        used = used[np.argsort(ranks_now[used], kind="stable")]
        borders = np.flatnonzero(np.diff(ranks_now[used])) + 1
        for group in np.split(used, borders) if len(used) else ():
            rank_open(rank_at[group[0]], group.tolist())
        while (top := queue.take()) is not None:
            rank, bucket = top
            if len(bucket) > 1:
                bucket.sort()  # leftmost first among equals
            for place, i in enumerate(bucket):
                if rank_at[i] != rank:  # stale: merged away or paired anew
                    continue
                j = after[i]
                k, h, lower = after[j], before[i], False
                token[i], after[i], rank_at[i], rank_at[j] = rank, k, -1, -1
                if k >= 0:
                    before[k] = i
                    if (r := pair(rank * size + token[k], -1)) >= 0:
                        rank_at[i], lower = r, r < rank
                        if (b := buckets.get(r)) is None:
                            rank_open(r, [i])
                        else:
                            b.append(i)
                if h >= 0:
                    rank_at[h] = r = pair(token[h] * size + rank, -1)
                    if r >= 0:
                        lower = lower or r < rank
                        if (b := buckets.get(r)) is None:
                            rank_open(r, [h])
                        else:
                            b.append(h)
                if lower and place + 1 < len(bucket):  # a lower rank goes first
                    rank_open(rank, bucket[place + 1 :])
                    break
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text. Pre-tokens not seen before are merged together."""
        if self.held > self.remember:
            self.known, self.older, self.held = {}, self.known, 0
        split, known, ranks = self.split, self.known, self.ranks
        pieces = [split(t) for t in texts]
        asked = {p for ps in pieces for p in ps if p not in known}
        again = {p: ids for p in asked if (ids := self.older.get(p)) is not None}
        known.update(again)
        fresh = asked - again.keys()
        raw = {p: p.encode("utf-8") for p in fresh}
        known.update((p, self.packed([ranks[b]])) for p, b in raw.items() if b in ranks)
        rest = [(p, b) for p, b in raw.items() if b not in ranks]
        for i in range(0, len(rest), PIECES_AT_ONCE):
            some = rest[i : i + PIECES_AT_ONCE]
            known.update((p, self.packed(ids)) for (p, _), ids in zip(some, self.merge([b for _, b in some])))
        out = [np.frombuffer(b"".join(map(known.__getitem__, ps)), dtype=np.int32) for ps in pieces]
        for p in fresh:
            if len(p) > LONG_PIECE:
                del known[p]
        self.held += sum(ENTRY_BYTES + len(p) + len(known[p]) for p in asked if p in known)
        return out

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def encode(self, texts) -> list[np.ndarray]:
        out, some, chars = [], [], 0
        for t in texts:
            some.append(t)
            chars += len(t)
            if chars >= CHARS_AT_ONCE:
                out += self.encode_all(some)
                some, chars = [], 0
        return out + self.encode_all(some)

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=4)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _shared(spark, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file larger than {MAX_VOCABULARY_BYTES} bytes: {path}")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", into: str = "token_ids", keep: bool = True, remember: int = REMEMBERED_BYTES) -> DataFrame:
    """`df` with `into`: array<int> of the whole text's token ids; null and empty texts have an empty array.

    `vocabulary` is a rank file read on the driver (size checked) and sent to the executors once. Special tokens are
    plain text. A column named `into` is replaced. Each row stands alone: repeated rows and ties need no rule.
    Workers remember the ids of pre-tokens (up to `remember` bytes in each of two generations) from task to task; with
    `keep` off they forget them at the end of a task, which leaves more memory to other stages and takes more time.
    """
    bounded_batches(df.sparkSession, BATCH_ROWS, BATCH_SIZE)
    data = _shared(df.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(data.value, pattern)
        c.remember = remember
        try:
            for texts in batches:
                yield pd.Series(c.encode(texts))
        finally:
            if not keep:
                c.forget()

    return df.withColumn(into, ids.asNondeterministic()(whole_text(text)))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`df` with `into`: the bytes of the ids (null ids give null; an id outside the vocabulary fails the job)."""
    bounded_batches(df.sparkSession, BATCH_ROWS, BATCH_SIZE)
    data = _shared(df.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def back(arrays: pd.Series) -> pd.Series:
        c = codec(data.value, pattern)
        return pd.Series([None if a is None else c.decode(a.tolist()) for a in arrays])

    return df.withColumn(into, back.asNondeterministic()(F.col(ids)))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids", into: str = "decoded", keep: bool = True, remember: int = REMEMBERED_BYTES) -> DataFrame:
    """encode() and decode() in one pass over the rows: `ids` and, decoded from them, `into`."""
    bounded_batches(df.sparkSession, BATCH_ROWS, BATCH_SIZE)
    data = _shared(df.sparkSession, vocabulary)

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.BinaryType())]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(data.value, pattern)
        c.remember = remember
        try:
            for texts in batches:
                encoded = c.encode(texts)
                yield pd.DataFrame({"ids": encoded, "bytes": [c.decode(a.tolist()) for a in encoded]})
        finally:
            if not keep:
                c.forget()

    name = fresh_name(df, "got")
    got = without(df.withColumn(name, both.asNondeterministic()(whole_text(text))), [ids, into])
    return got.withColumns({ids: F.col(f"{name}.ids"), into: F.col(f"{name}.bytes")}).drop(name)


@query()
def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs, path, pattern, "text", "ids", "bytes")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
