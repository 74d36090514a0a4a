"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

Features of the whole text: densities of a learned and of a fixed lexicon, insults near the second person, capitals,
punctuation and obfuscation rates. Words of the learned lexicon, trees and calibration are fitted on a bounded,
hash-chosen sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.kernels import materialize
from chronoweave.llm.common import bounded_batches, bucket_of_id, query, table, whole_text, without, words

ROWS_PER_CLASS = 3_000  # bound of the training sample
LEXICON = 300  # words learned at most
TREES, DEPTH, SHRINK, BINS = 80, 3, 0.15, 32

#: Common insults in four languages, and second-person words.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb fool loser losers scum trash garbage worthless pathetic disgusting clown ugly hate kill die shut
    bastard bitch asshole jerk creep pig filth vermin dummkopf blödmann arschloch abschaum widerlich wertlos versager schwein hässlich
    imbécile crétin connard salaud ordure minable dégoûtant moche débile abruti imbécil estúpido tonto basura asqueroso patético inútil cerdo""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros eres".split())
NAMES = (
    "log_words", "learned", "learned_weight", "learned_kinds", "fixed", "near_second_person", "densest_hundred", "capital_letters", "capital_words",
    "exclamation", "question", "repeated_marks", "symbols", "obfuscated", "obfuscated_hits",
)
_WORD = re.compile(r"[^\W_]+")
_CAPS = re.compile(r"(?<![^\W_])[A-ZÀ-Þ]{3,}+(?![^\W_])")
_MARKS = re.compile(r"[!?]{2,}+")
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_]++(?:[0-9@$*!|]++[^\W\d_]++)+")
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
NEAR, SPAN = 5, 100


def describe(text: str, learned: dict[str, float]) -> list[float]:
    """The features in the order of NAMES; an empty text has zeros."""
    low = text.lower()
    found = _WORD.findall(low)
    n = len(found)
    if not n:
        return [0.0] * len(NAMES)
    vocabulary = set(found)
    own, fixed = vocabulary & learned.keys(), vocabulary & INSULTS
    places = sorted(i for i, w in enumerate(found) if w in own) if own else []
    insults = [i for i, w in enumerate(found) if w in fixed or w in own] if own or fixed else []
    near = sum(1 for i in insults if not SECOND_PERSON.isdisjoint(found[max(0, i - NEAR) : i + NEAR + 1]))
    densest, first = 0, 0
    for k, i in enumerate(places):
        while places[first] <= i - SPAN:
            first += 1
        densest = max(densest, k - first + 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8"), dtype=np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    masked = _MASKED.findall(low) if any(counts[b] for b in b"0123456789@$*!|") else []
    hits = 0
    for w in masked:
        plain = w.translate(_PLAIN)
        hits += plain in learned or plain in INSULTS or ("*" in w and any(re.fullmatch(re.escape(plain).replace(r"\*", "."), v) for v in INSULTS if v[0] == plain[0]))
    size = len(text)
    return [
        math.log1p(n), 100 * len(places) / n, 100 * sum(learned[found[i]] for i in places) / n, float(len(own)),
        100 * sum(1 for w in found if w in fixed) / n if fixed else 0.0, 100 * near / n, float(densest),
        float(counts[65:91].sum()) / letters, 100 * len(_CAPS.findall(text)) / n, 100 * float(counts[33]) / size, 100 * float(counts[63]) / size,
        100 * len(_MARKS.findall(text)) / n, 100 * float(sum(counts[b] for b in b"#$%&*@^~|")) / size, 100 * len(masked) / n, float(hits),
    ]


@dataclass
class Scorer:
    """Trees as (feature, cut, low, high) with leaf values; calibration by steps, joined linearly."""

    learned: dict[str, float]
    base: float
    trees: list
    steps_x: np.ndarray
    steps_y: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _value(tree, x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        step = np.interp(raw, self.steps_x, self.steps_y)
        return np.clip(0.98 * step + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)  # the last part only orders equal steps


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _value(low, x), _value(high, x))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list]:
    """Gradient boosting with logistic loss on quantile-binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    base = math.log(share / (1 - share))
    raw, trees = np.full(len(x), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        if depth and len(rows) >= 20:
            best = (1e-3, None, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] is not None:
                _, f, k = best
                low = binned[rows, f] <= k
                return f, float(cuts[f][k]), grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1)
        return float(SHRINK * gs / (hs + 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(x)), weight * (y - p), weight * p * (1 - p), DEPTH)
        trees.append(tree)
        raw = raw + _value(tree, x)
    return base, trees


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising step function, as points at the ends of each step."""
    pools: list[list[float]] = []  # mean, weight, first raw, last raw
    for i in np.argsort(raw, kind="stable"):
        pools.append([float(y[i]), float(weight[i]), float(raw[i]), float(raw[i])])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in (p[0], p[0])])
    return xs, ys


def learned_lexicon(sample: DataFrame, text: str, label: str) -> dict[str, float]:
    """Words that far more toxic than other texts of the sample hold, with their log ratio; equal texts count once."""
    once = sample.dropDuplicates([text, label])
    totals = {r[label]: r["count"] for r in once.groupBy(label).count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    by_word = once.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"), F.col(label).alias("label")).groupBy("word")
    counts = by_word.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    ratio = (F.col("n1") / n1) / ((F.col("n0") + 1) / (n0 + 1))
    kept = counts.where((F.col("n1") >= max(3, 0.01 * n1)) & (ratio >= 6)).select("word", F.log(ratio).alias("weight"), (F.col("n1") * F.log(ratio)).alias("_use"))
    return {r["word"]: r["weight"] for r in kept.orderBy(F.desc("_use"), "word").limit(LEXICON).collect()}


def fit(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "label") -> Scorer | None:
    """Lexicon, trees and calibration from at most ROWS_PER_CLASS rows of each label 0 and 1 (the same rows every time).

    `labels` has `row` and `label`; rows with another or no label or without a document are passed over, a null text
    counts as empty. None where a label has no rows. Rows are chosen on ids alone, and only the texts of the chosen
    ones are fetched. A quarter of the sample, chosen by hash, is kept from the trees and calibrates them.
    """
    usable = labels.where(F.col(label).isin(0, 1)).select(F.col(row).alias("row"), F.col(label).cast("int").alias("label")).dropDuplicates(["row"])
    usable = materialize(usable.join(docs.select(F.col(row).alias("row")), "row", "left_semi"))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    pick = lambda v: usable.where(F.col("label") == v).orderBy(F.xxhash64(F.lit("toxicity"), "row"), "row").limit(ROWS_PER_CLASS)
    chosen = materialize(pick(0).unionByName(pick(1)))
    texts = docs.select(F.col(row).alias("row"), whole_text(text).alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "row"))  # at most 2 x ROWS_PER_CLASS ids
    learned = learned_lexicon(sample, "text", "label")
    rows = described(sample, learned, "text", "x").select("row", "label", "x", (F.pmod(F.xxhash64(F.lit("calibration"), "row"), F.lit(4)) == 0).alias("aside")).orderBy("row").collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    kept = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, totals[1] / kept[1], totals[0] / kept[0])  # as in all labelled rows
    weight = weight / weight.mean()
    aside = np.array([r["aside"] for r in rows])
    if min((y[aside] == v).sum() for v in (0, 1)) < 5 or min((y[~aside] == v).sum() for v in (0, 1)) < 5:
        aside = np.zeros(len(y), dtype=bool)  # too few rows to keep any from the trees
    base, trees = boost(x[~aside], y[~aside], weight[~aside])
    scorer = Scorer(learned, base, trees, np.zeros(1), np.zeros(1))
    use = aside if aside.any() else ~aside
    scorer.steps_x, scorer.steps_y = isotonic(scorer.raw(x[use]), y[use], weight[use])
    return scorer


def described(df: DataFrame, learned: dict[str, float], text: str, into: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def feature_rows(texts: pd.Series) -> pd.Series:
        return pd.Series([describe(t, learned) for t in texts])

    bounded_batches(df.sparkSession)
    return df.withColumn(into, feature_rows.asNondeterministic()(whole_text(text)))


def score(df: DataFrame, scorer: Scorer | None, text: str = "text", into: str = "score") -> DataFrame:
    """`df` with a score from 0 to 1 for each whole text, null texts as empty ones; 0 where nothing could be learned.

    Rows are scored alone, so repeated texts get equal scores. A column named `into` is replaced.
    """
    if scorer is None:
        return without(df, [into]).withColumn(into, F.lit(0.0))

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(scorer.score(np.array([describe(t, scorer.learned) for t in texts])))

    bounded_batches(df.sparkSession)
    return df.withColumn(into, scored.asNondeterministic()(whole_text(text)))


@query()
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held = bucket_of_id("doc_id", 5) == 0
    scorer = fit(docs, labels.where(~held))
    rows = score(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), scorer)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
