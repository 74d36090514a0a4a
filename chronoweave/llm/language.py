"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum, and a
softmax gives the language. The network is trained in numpy on a bounded, hash-chosen sample of labelled rows and is
then applied to every window of every text, many windows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import bounded_batches, bucket_of_id, query, table, whole_text, without

WINDOW = 256  # bytes
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4, 5), 8
ROWS_PER_LANGUAGE = 1_000  # bound of the training sample
MAX_LANGUAGES = 200  # the most frequent ones are learned
WINDOWS_PER_ROW = 4
EPOCHS, BATCH, RATE = 4, 64, 3e-3
BATCH_WINDOWS = 48
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """emb (256, E); filters (widest * E, all filters), zero beyond a filter's own width; dense layer to languages."""

    languages: list[str]
    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.emb[windows].reshape(len(windows), -1)
        return sliding_window_view(x, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED].reshape(-1, max(WIDTHS) * EMBED)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (self.columns(windows) @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        return y, np.maximum(y.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(windows), BATCH_WINDOWS):
            z = self.pooled(windows[i : i + BATCH_WINDOWS])[1] @ self.dense + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def _mask() -> np.ndarray:
    m = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        m[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    return m


def as_windows(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole lower-cased text, the last one filled up with zeros."""
    data = np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def train(texts: list[str], labels: list[str], seed: int = 7) -> ByteNet | None:
    """Fit the network with Adam; None when there is nothing to learn from."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x = np.concatenate([as_windows(t)[:1] for t in texts])
    y = np.array([languages.index(v) for v in labels])
    mask, k = _mask(), len(languages)
    p = {
        "emb": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.2, mask.shape) * mask, "bias": np.zeros(mask.shape[1]),
        "dense": rng.normal(0, 0.3, (mask.shape[1], k)), "offset": np.zeros(k),
    }
    p = {n: v.astype(np.float32) for n, v in p.items()}
    first, second, step = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}, 0
    share = np.bincount(y, minlength=k) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / k).astype(np.float32)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            net = ByteNet(languages, **p)
            xb, yb = x[rows], y[rows]
            cols = net.columns(xb).reshape(len(xb), -1, mask.shape[0])
            conv, act = net.pooled(xb)
            z = act @ p["dense"] + p["offset"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(yb)), yb] -= 1
            g *= (weight[yb] / len(yb))[:, None]
            up = (g @ p["dense"].T) * (act > 0)
            at = conv.argmax(axis=1)  # only the winning place of a filter learns
            hit = cols[np.arange(len(xb))[:, None], at]  # (rows, filters, widest * E)
            grads = {
                "dense": act.T @ g, "offset": g.sum(0), "bias": up.sum(0),
                "filters": np.einsum("rf,rfc->cf", up, hit) * mask, "emb": np.zeros_like(p["emb"]),
            }
            back = up[:, :, None] * p["filters"].T[None]
            for j in range(max(WIDTHS)):
                np.add.at(grads["emb"], xb[np.arange(len(xb))[:, None], at + j], back[:, :, j * EMBED : (j + 1) * EMBED])
            step += 1
            for n, d in grads.items():
                first[n] = 0.9 * first[n] + 0.1 * d
                second[n] = 0.999 * second[n] + 0.001 * d * d
                p[n] = (p[n] - RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNet(languages, **p)


def training_windows(labelled: DataFrame, row: str, text: str, lang: str) -> list:
    """At most MAX_LANGUAGES x ROWS_PER_LANGUAGE rows, chosen by a hash of their id, as pieces spread over each text."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.rlike(F.col(text), F.lit(r"\p{L}")))
    counts = usable.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r[lang], min(1.0, ROWS_PER_LANGUAGE / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(row)), F.lit(1 << 20)) / float(1 << 20)
    step = F.length(text) / WINDOWS_PER_ROW
    pieces = F.array(*[F.substring(F.col(text), (F.floor(step * i) + 1).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS_PER_ROW)])
    some = usable.where(draw < F.element_at(rate, F.col(lang))).orderBy(F.xxhash64(F.lit("language"), F.col(row)), row).limit(len(counts) * ROWS_PER_LANGUAGE)
    return some.select(F.col(lang).alias("lang"), F.explode(F.array_distinct(pieces)).alias("piece")).collect()


def fit(labelled: DataFrame, row: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet | None:
    """The network for the labels in `lang`; rows without a label or a letter are passed over, repeats are harmless."""
    rows = [r for r in training_windows(labelled, row, text, lang) if any(c.isalpha() for c in r["piece"])]
    return train([r["piece"] for r in rows], [r["lang"] for r in rows])


def predict(df: DataFrame, net: ByteNet | None, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the language of the whole text and its probability, averaged over all windows by their bytes.

    A text that is null, empty or without a letter is `und` with score 0, and so is every row where nothing could be
    learned. Equal probabilities go to the first language in alphabetical order. Columns named like the results are replaced.
    """

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def classify(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        todo, held, n = [], [], 0

        def flush():
            if not todo:
                return
            probs = net.probabilities(np.concatenate([w for _, w, _ in todo])).astype(np.float64)
            at = 0
            for i, w, size in todo:
                weight = np.full(len(w), float(WINDOW))
                weight[-1] = size - WINDOW * (len(w) - 1)
                mean = weight @ probs[at : at + len(w)] / weight.sum()
                at += len(w)
                best = int(mean.argmax())
                langs[i], scores[i] = net.languages[best], float(min(1.0, mean[best]))
            todo.clear()

        for i, t in enumerate(texts):
            if net is not None and t and any(c.isalpha() for c in t):
                w = as_windows(t)
                todo.append((i, w, len(t.lower().encode("utf-8"))))
                n += len(w)
                if n >= 4096:
                    flush()
                    n = 0
        flush()
        return pd.DataFrame({"lang": langs, "score": scores})

    bounded_batches(df.sparkSession)
    got = without(df.withColumn("_got", classify.asNondeterministic()(whole_text(text))), [into, score])
    return got.withColumns({into: F.col("_got.lang"), score: F.col("_got.score")}).drop("_got")


@query()
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = bucket_of_id("doc_id", 4) == 2
    net = fit(docs.where(~held).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    return predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")
