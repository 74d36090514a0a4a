"""Periodic runs of words: Lyndon arrays by Baier's grouping, Lyndon roots extended to runs.

A run is a stretch of consecutive words with smallest period q, at least `LEAST_WORDS` long and `LEAST_PERIODS` periods
long, that no neighbouring word extends keeping the period. Each run holds a Lyndon root: a position i whose longest
Lyndon word, under the order of words or under its reverse, is as long as the period and is followed by itself.

1. `lyndon_lengths`: phase one of Baier's suffix sorter. Suffixes are grouped by first word; groups are taken from the
   highest down; each suffix of a group points to the nearest suffix before it that is in a lower group, and those
   pointed at move up to groups of their own, their context lengthened by the group's once per pointer. When all groups
   are taken, the length of a suffix's context is that of the longest Lyndon word that starts there.
2. `runs_of`: a root (i, q) is followed by itself; it is extended to both sides by longest common extensions (prefix
   fingerprints, binary search for all roots at once), and the stretch found is compared word by word, so a collision
   of fingerprints cannot give a wrong run.
3. Only stretches in which windows of `WINDOW` words come again in the same text can hold a run. A run of l >= 24 and
   l >= 3q words has l-7 windows of 8 words inside; windows q apart are equal, and l-7 >= 2q, so none of them stands
   alone in the text. The other words, the bulk of most texts, are passed over by that one look at sorted window hashes,
   which may take too much (a collision) but never too little.

Time is near linear in the words of a text; nothing is shuffled and each text stands alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bounded_batches, fresh_name, query, table, whole_text, without

LEAST_WORDS, LEAST_PERIODS = 24, 3
WINDOW = 8  # LEAST_WORDS - WINDOW + 1 >= 2 * q for all q <= 8, LEAST_PERIODS * q - WINDOW + 1 >= 2 * q for larger ones
WORD = r"[^\x20\x09-\x0D]+"
PRIME = (1 << 31) - 1  # fingerprints; products of two residues fit into 62 bits
BASES = (911_382_323, 972_663_749)
MIX = np.uint64(0x9E3779B97F4A7C15)
find_words = re.compile(WORD).findall


def lyndon_lengths(word: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position; the end of the text is below every word."""
    n = len(word)
    by_word = np.argsort(word, kind="stable")
    starts = np.flatnonzero(np.diff(word[by_word], prepend=word[by_word[:1]] - 1))
    members = [g.tolist() for g in np.split(by_word, starts[1:])]
    group = np.empty(n, dtype=np.int64)
    group[by_word] = np.repeat(np.arange(len(members)), np.diff(np.append(starts, n)))
    group = group.tolist()
    alive = [len(g) for g in members]  # members[g] may also list suffixes that have left
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))  # neighbours in the order of groups
    size = [1] * n
    free = list(range(-1, n))  # free[i + 1] leads to the nearest suffix up to i whose group has not been taken
    top = len(members) - 1
    while top >= 0:
        here = members[top] if alive[top] == len(members[top]) else [i for i in members[top] if group[i] == top]
        for i in here:
            free[i + 1] = i - 1
        pointed: dict[int, int] = {}
        for i in here:
            j = i - 1
            while (k := free[j + 1]) != j:
                free[j + 1] = j = free[k + 1]
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        length = size[here[0]]
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            size[j] += times * length
            moves.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moves, reverse=True):  # more pointers, higher group
            some = moves[times, old]
            alive[old] -= len(some)
            if not alive[old]:  # nobody stays, so the old group serves as the new one
                alive[old] = len(some)
                members[old] = some
                continue
            new, above = len(members), upper[old]
            members.append(some)
            alive.append(len(some))
            lower.append(old)
            upper.append(above)
            lower[above] = upper[old] = new
            for j in some:
                group[j] = new
        top = lower[top]
    return np.array(size, dtype=np.int64)


class Extensions:
    """Longest common extensions of positions (i, k) of one text, by prefix fingerprints."""

    _powers = [np.ones(1, dtype=np.int64) for _ in BASES]

    def __init__(self, word: np.ndarray):
        self.n = n = len(word)
        self.steps = [1 << b for b in reversed(range(n.bit_length()))]
        self.prefix = []
        for b, base in enumerate(BASES):
            power = self._powers[b]
            while len(power) <= n:
                power = np.concatenate([power, power * pow(base, len(power), PRIME) % PRIME])
            self._powers[b] = power
            self.prefix.append(np.concatenate([[0], np.cumsum((word + 1) * power[:n] % PRIME) % PRIME]))

    def same(self, i: np.ndarray, k: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), dtype=bool)
        for prefix, power in zip(self.prefix, self._powers):
            out &= (prefix[i + length] - prefix[i]) % PRIME * power[k - i] % PRIME == (prefix[k + length] - prefix[k]) % PRIME
        return out

    def forward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Equal words from i and from k > i on."""
        got = np.zeros(len(i), dtype=np.int64)
        for step in self.steps:
            fits = k + got + step <= self.n
            longer = np.where(fits, step, 0)
            got += np.where(fits & self.same(i + got, k + got, longer), step, 0)
        return got

    def backward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Equal words just before i and just before k > i."""
        got = np.zeros(len(i), dtype=np.int64)
        for step in self.steps:
            fits = i - got - step >= 0
            longer = np.where(fits, step, 0)
            got += np.where(fits & self.same(i - got - longer, k - got - longer, longer), step, 0)
        return got


def runs_of(word: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least_words` words and `least_periods` >= 3 periods, in order. (With 3, two roots follow each other.)"""
    n = len(word)
    if n < least_words:
        return []
    at, period = [], []
    for order in (word, word.max() - word):
        length = lyndon_lengths(order)
        i = np.flatnonzero(np.arange(n) + 2 * length <= n)
        i = i[length[i + length[i]] == length[i]]
        at.append(i)
        period.append(length[i])
    at, period = np.concatenate(at), np.concatenate(period)
    if not len(at):
        return []
    common = Extensions(word)
    again = common.same(at, at + period, period)
    at, period = at[again], period[again]
    start = at - common.backward(at, at + period)
    length = at + period + common.forward(at, at + period) - start
    enough = (length >= least_words) & (length >= least_periods * period)
    roots: dict[tuple[int, int, int], list[int]] = {}
    for i, s, n, q in zip(*(a[enough].tolist() for a in (at, start, length, period))):
        roots.setdefault((s, n, q), []).append(i)
    found = {(s, n, q) for run, some in roots.items() for s, n, q in _confirmed(word, *run, some) if n >= least_words and n >= least_periods * q}
    return sorted(found, key=lambda r: (r[0], r[2]))


def _confirmed(word: np.ndarray, start: int, length: int, period: int, roots: list[int]) -> list[tuple[int, int, int]]:
    """The stretches around the roots that keep the period: one, as found, unless fingerprints collided.

    Unequal fingerprints prove unequal words, equal ones do not prove equal words, so the stretch is compared itself and
    cut at the first difference on either side of a root.
    """
    end = start + length
    wrong = start + np.flatnonzero(word[start : end - period] != word[start + period : end])
    out = []
    for root in roots if len(wrong) else roots[:1]:
        left, right = wrong[wrong < root], wrong[wrong >= root]
        lo, hi = int(left[-1]) + 1 if len(left) else start, int(right[0]) + period if len(right) else end
        out.append((lo, hi - lo, period))
    return out


def candidate_stretches(word: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(text number, from, to) of the stretches of at least LEAST_WORDS words, all in windows that come again in their text.

    `word` holds the word numbers of several texts one after another, `ends` where each text ends.
    """
    n = len(word)
    if n < LEAST_WORDS:
        return []
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    h = (word.astype(np.uint64) + np.uint64(1)) * MIX
    h ^= h >> np.uint64(29)
    for width, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93)):
        h = h[:-width] * np.uint64(factor) + h[width:]
    whole = np.flatnonzero(text[: len(h)] == text[WINDOW - 1 :])
    h = (h[whole] ^ (text[whole].astype(np.uint64) * MIX)) * MIX
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(whole), dtype=bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[whole[again]] += 1
    cover[whole[again] + WINDOW] -= 1
    inside = np.cumsum(cover[:-1]) > 0
    change = inside[1:] != inside[:-1]
    change |= text[1:] != text[:-1]
    borders = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
    lengths = np.diff(borders)
    keep = np.flatnonzero((lengths >= LEAST_WORDS) & inside[borders[:-1]])
    return [(int(text[borders[k]]), int(borders[k]), int(borders[k + 1])) for k in keep]


def runs_of_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as its words."""
    number: dict[str, int] = {}
    word = np.array([number.setdefault(w, len(number)) for t in texts for w in t], dtype=np.int64)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, lo, hi in candidate_stretches(word, ends):
        first = lo - (int(ends[t - 1]) if t else 0)
        out[t] += [(first + s, length, q) for s, length, q in runs_of(np.unique(word[lo:hi], return_inverse=True)[1])]
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The text with only the first period of each run, single spaces between words."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return " ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]) if runs else " ".join(words)


def periodic_runs(df: DataFrame, text: str | Column = "text", runs: str = "runs", into: str = "collapsed") -> DataFrame:
    """`df` with `runs`: array<struct<start, length, period>> by start, then period (word numbers from 0), and `into`: the
    text with the first period of each run only.

    Words are what white space (space, tab, line ends) separates. Null and empty texts have no runs and the empty text.
    Ties: two runs may start at one word with different periods; both are listed. Repeated rows stand alone. Columns named
    `runs` or `into` are replaced, all others stay.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, kept string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            words = [find_words(t) for t in texts]
            found = runs_of_texts(words)
            yield pd.DataFrame({
                "starts": [[r[0] for r in rs] for rs in found],
                "lengths": [[r[1] for r in rs] for rs in found],
                "periods": [[r[2] for r in rs] for rs in found],
                "kept": [collapsed(w, rs) for w, rs in zip(words, found)],
            })

    kept = without(df, [runs, into])
    got = fresh_name(kept, "got")
    zipped = F.arrays_zip(F.col(f"{got}.starts").alias("start"), F.col(f"{got}.lengths").alias("length"), F.col(f"{got}.periods").alias("period"))
    with_found = df.select(*[F.col(f"`{c}`") for c in kept.columns], find.asNondeterministic()(whole_text(text)).alias(got))
    return with_found.select(*[F.col(f"`{c}`") for c in kept.columns], zipped.cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias(runs), F.col(f"{got}.kept").alias(into))


def with_repeated_tails(text: Column, key: Column) -> Column:
    """The stated texts of the query: where crc32 of the key ends in 0, the tail repeats its first words."""
    words = F.filter(F.split(whole_text(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(key.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(whole_text(text))


@query()
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repeated_tails(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    longer = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]  # noqa: E731  greater exponent, exactly
    best = F.aggregate("runs", F.element_at("runs", 1), lambda b, r: F.when(longer(r, b), r).otherwise(b))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
