"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into fixed-length windows. Each window goes through
byte embeddings, convolution filters of several widths, max pooling over the
window, and softmax; a text's scores are the mean log-probabilities of all its
windows, weighted by their length. Training is numpy (Adam on cross-entropy) on
windows of a bounded sample of labelled rows, the rows of smallest hash of their
text; the windows are drawn over each whole text. All other rows only meet the
finished network.

For prediction, embeddings and filters are folded into tables over byte values
and byte pairs, so that a convolution is a sum of table rows.

Null text, and text without a letter, is ``und`` with score 0. If no labelled row
exists, every text is ``und``. Neither lang, source nor doc_id enters a
prediction; equal texts get equal answers. Whole texts are read, however long.
Other columns pass through ``predict`` untouched; where one has the name of a new
column, the new one gets underscores behind it. An empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, fresh, id_remainder

#: Bound of the training sample in rows, and in windows drawn from each of their texts.
SAMPLE_ROWS = 2000
SAMPLE_WINDOWS = 16
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
EPOCHS = 3
BATCH = 64
#: Windows whose convolutions are computed together.
PREDICT_WINDOWS = 512
UNKNOWN = "und"


@dataclass
class Network:
    """Parameters of a trained network. ``langs`` are the learned labels in order."""

    langs: list[str]
    embed: np.ndarray  # 257 x EMBEDDING; row 256 stands for padding and is zero
    filters: dict[int, np.ndarray]  # width -> width x EMBEDDING x FILTERS
    bias: np.ndarray  # filters of all widths
    dense: np.ndarray  # filters x languages
    dense_bias: np.ndarray


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text as rows of byte values; 256 pads the last."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 256, dtype=np.int32)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def start(langs: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    embed = rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32)
    embed[256] = 0
    filters = {w: rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS}
    dense = rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32)
    return Network(langs, embed, filters, np.zeros(n, np.float32), dense, np.zeros(len(langs), np.float32))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy on windows x with labels y."""
    n, rows = len(x), np.arange(len(x))[:, None]
    e = net.embed[x]
    pooled, best, patches = [], {}, {}
    for i, w in enumerate(WIDTHS):
        out = sum(e[:, k : WINDOW - w + 1 + k] @ net.filters[w][k] for k in range(w))
        best[w] = out.argmax(axis=1)
        pooled.append(np.take_along_axis(out, best[w][:, None], axis=1)[:, 0] + net.bias[i * FILTERS : (i + 1) * FILTERS])
    h = np.concatenate(pooled, axis=1)
    active = np.maximum(h, 0)
    d = np.exp(_log_softmax(active @ net.dense + net.dense_bias))
    d[np.arange(n), y] -= 1
    d /= n
    grads = {"dense": active.T @ d, "dense_bias": d.sum(axis=0)}
    dh = (d @ net.dense.T) * (h > 0)
    grads["bias"] = dh.sum(axis=0)
    de = np.zeros((257, EMBEDDING), np.float32)
    for i, w in enumerate(WIDTHS):
        part = dh[:, i * FILTERS : (i + 1) * FILTERS]  # windows x filters, at the winning places
        g = np.zeros_like(net.filters[w])
        for k in range(w):
            at = best[w] + k
            g[k] = np.einsum("nfe,nf->ef", e[rows, at], part)
            np.add.at(de, x[rows, at], part[:, :, None] * net.filters[w][k].T[None])
        grads[f"filters{w}"] = g
    de[256] = 0
    grads["embed"] = de
    return grads


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Train on whole windows of the texts given; the same input gives the same network."""
    langs = sorted(set(labels))
    net = start(langs, seed)
    cut = [windows_of(t) for t in texts]
    x = np.concatenate(cut)
    y = np.repeat([langs.index(v) for v in labels], [len(c) for c in cut])
    params = {"embed": net.embed, "bias": net.bias, "dense": net.dense, "dense_bias": net.dense_bias}
    params |= {f"filters{w}": net.filters[w] for w in WIDTHS}
    mean = {k: np.zeros_like(v) for k, v in params.items()}
    square = {k: np.zeros_like(v) for k, v in params.items()}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            step += 1
            take = order[at : at + BATCH]
            for k, g in gradients(net, x[take], y[take]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                params[k] -= 0.004 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return net


class Folded:
    """A network's convolutions as tables of byte values (odd widths) and byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        self.single = {}
        self.pairs = {}
        for w in WIDTHS:
            one = [net.embed @ net.filters[w][k] for k in range(w)]
            for k in range(0, w - 1, 2):
                self.pairs[w, k] = (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(257 * 257, FILTERS)
            if w % 2:
                self.single[w] = one[w - 1]

    def window_scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window."""
        net, parts = self.net, []
        pair = x[:, :-1] * 257 + x[:, 1:]
        for i, w in enumerate(WIDTHS):
            n = WINDOW - w + 1
            out = self.pairs[w, 0].take(pair[:, :n], axis=0)
            for k in range(2, w - 1, 2):
                out += self.pairs[w, k].take(pair[:, k : k + n], axis=0)
            if w in self.single:
                out += self.single[w].take(x[:, w - 1 : w - 1 + n], axis=0)
            parts.append(out.max(axis=1) + net.bias[i * FILTERS : (i + 1) * FILTERS])
        return _log_softmax(np.maximum(np.concatenate(parts, axis=1), 0) @ net.dense + net.dense_bias)

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-probabilities of each text over its bytes."""
        cut = [windows_of(t) for t in texts]
        counts = np.array([len(c) for c in cut])
        x = np.concatenate(cut)
        weight = (x != 256).sum(axis=1, keepdims=True).astype(np.float64)
        z = np.concatenate([self.window_scores(x[i : i + PREDICT_WINDOWS]) for i in range(0, len(x), PREDICT_WINDOWS)])
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        total = np.add.reduceat(z * weight, starts, axis=0)
        return total / np.maximum(np.add.reduceat(weight, starts, axis=0), 1)


def train(docs: DataFrame, eligible: Column) -> Network | None:
    """A network from at most SAMPLE_ROWS labelled rows where ``eligible`` holds.

    The sample is spread evenly over labels: of each the distinct texts of smallest
    hash, which are the same on every run. A share that the label's row count
    bounds is cut out by hash first, so that few rows are ranked by label. Of a
    text's windows, SAMPLE_WINDOWS at most are drawn by a hash, from all of them.
    """
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.encode("text", "UTF-8").alias("raw"), F.xxhash64("text").alias("order"))
    # labels beyond the sample's rows could not be in it; this also bounds the broadcast
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS)
    part = F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
    near = rows.join(F.broadcast(sizes), "lang").where(part <= F.lit(2.0 * SAMPLE_ROWS))
    n = F.ceil(F.octet_length("raw") / F.lit(WINDOW))
    draws = F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(SAMPLE_WINDOWS)) - F.lit(1))
    drawn = F.array_distinct(F.transform(draws, lambda i: F.when(n <= SAMPLE_WINDOWS, i).otherwise(F.pmod(F.xxhash64("order", i), n))))
    windows = F.transform(drawn, lambda i: F.substring("raw", (i * F.lit(WINDOW) + F.lit(1)).cast("int"), F.lit(WINDOW)))
    texts = near.select("lang", "order", windows.alias("windows")).groupBy("lang", "order").agg(F.min("windows").alias("windows"))
    order = Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 30)), "order")
    ranked = texts.withColumn("nth", F.row_number().over(order))
    sample = (
        ranked.where(F.col("nth") <= F.lit(SAMPLE_ROWS)).orderBy("nth", "order", "lang").limit(SAMPLE_ROWS).collect()
    )
    if not sample:
        return None
    return fit([bytes(w) for r in sample for w in r["windows"]], [r["lang"] for r in sample for _ in r["windows"]])


def predict(docs: DataFrame, net: Network | None, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    lang, score, held = (fresh(docs, name) for name in (lang, score, "_langid"))
    if net is None:
        return docs.withColumn(lang, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    folded: list[Folded] = []

    @F.pandas_udf("lang string, score double")
    def scores(raw: pd.Series) -> pd.DataFrame:
        if not folded:
            folded.append(Folded(shared.value))
        z = folded[0].text_scores([x or b"" for x in raw])
        best = z.argmax(axis=1)
        share = np.exp(z - z.max(axis=1, keepdims=True))
        names = np.array(shared.value.langs, dtype=object)[best]
        return pd.DataFrame({"lang": names, "score": 1 / share.sum(axis=1)})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn(held, F.struct(lettered.alias("lettered"), scores(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("found")))
        .withColumn(lang, F.when(F.col(f"{held}.lettered"), F.col(f"{held}.found.lang")).otherwise(F.lit(UNKNOWN)))
        .withColumn(score, F.when(F.col(f"{held}.lettered"), F.col(f"{held}.found.score")).otherwise(F.lit(0.0)))
        .drop(held)
    )


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned where crc32(doc_id) mod 4 is not 2."""
    held_out = id_remainder(4) == 2
    net = train(docs, ~held_out)
    out = predict(docs.select("doc_id", "text"), net)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
