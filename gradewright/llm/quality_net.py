"""Quality classifier: a byte-level convolutional network in numpy.

Every byte window of the whole text meets FILTERS learned filters. Responses are
max-pooled over chunks of 2 * HALF bytes that overlap by half, so the chunks cover
the whole document; a small hidden layer reads each chunk's maxima and how full the
chunk is, and the mean over chunks gives one probability. As a filter's response is a sum of table entries (one per
byte of the window), a chunk costs WIDTH look-ups per byte, and a text of any length
is worked through in strips of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sigmoid, text_batches
from .training import labelled_sample, sample_texts

WIDTH, FILTERS, HIDDEN, HALF = 6, 16, 8, 256
PAD = 256  # the symbol after the end of a text
STRIP = 192  # half-chunks worked on at a time
PER_CLASS = 1500  # labelled documents of each class used for training, at most
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 11
THRESHOLD = 0.3


def halves(text: str | bytes | None) -> np.ndarray:
    """Bytes of the whole text as overlapping rows of HALF + WIDTH - 1 symbols."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
    n = max(1, -(-len(raw) // HALF))
    padded = np.full(n * HALF + WIDTH - 1, PAD, np.uint16)
    padded[:len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, HALF + WIDTH - 1), (HALF * 2, 2))


def filled(rows: np.ndarray) -> np.ndarray:
    """Share of each half-chunk that is text."""
    return (rows[:, :HALF] != PAD).mean(axis=1, dtype=np.float32)


@dataclass
class Net:
    """table[j, s]: response of each filter to symbol s at place j of the window."""

    table: np.ndarray   # (WIDTH, 257, FILTERS)
    bias: np.ndarray    # (FILTERS,)
    hidden: np.ndarray  # (FILTERS + 1, HIDDEN), the last row for the filled share
    hbias: np.ndarray   # (HIDDEN,)
    out: np.ndarray     # (HIDDEN,)
    obias: np.ndarray   # (1,)

    @classmethod
    def fresh(cls, seed: int = SEED) -> Net:
        r = np.random.default_rng(seed)
        # Filters start as products of a window pattern with a byte code, as an
        # embedding followed by a convolution would.
        code, window = r.normal(size=(257, 8)), r.normal(size=(WIDTH, 8, FILTERS))
        f4 = np.float32
        return cls((np.einsum("sd,jdf->jsf", code, window) * 0.15).astype(f4), np.zeros(FILTERS, f4),
                   (r.normal(size=(FILTERS + 1, HIDDEN)) * 0.35).astype(f4), np.zeros(HIDDEN, f4),
                   (r.normal(size=HIDDEN) * 0.35).astype(f4), np.zeros(1, f4))

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.hidden, self.hbias, self.out, self.obias]

    def respond(self, rows: np.ndarray) -> np.ndarray:
        """Filter responses at every byte: (rows, HALF, FILTERS)."""
        acc = self.table[0].take(rows[:, :HALF], axis=0)
        for j in range(1, WIDTH):
            acc += self.table[j].take(rows[:, j:j + HALF], axis=0)
        return acc

    def pool(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.respond(rows[i:i + STRIP]).max(axis=1)
                               for i in range(0, len(rows), STRIP)])

    def _read(self, chunk: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and outputs of the hidden layer for each chunk."""
        two = len(fill) > 1
        own = (fill[:-1] + fill[1:]) / 2 if two else fill / 2
        a = np.concatenate([np.maximum(chunk + self.bias, 0), own[:, None]], axis=1)
        return a, np.maximum(a @ self.hidden + self.hbias, 0)

    def logit(self, pooled: np.ndarray, fill: np.ndarray) -> float:
        """One document's logit from its half-chunk maxima."""
        chunk = np.maximum(pooled[:-1], pooled[1:]) if len(pooled) > 1 else pooled
        _, h = self._read(chunk, fill)
        return float(h.mean(axis=0) @ self.out + self.obias[0])

    def probability(self, text: str | None) -> float:
        rows = halves(text)
        return float(sigmoid(self.logit(self.pool(rows), filled(rows))))

    def gradient(self, docs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean log loss over a few documents."""
        sizes = [len(d) for d in docs]
        rows = np.concatenate(docs)
        best = np.concatenate([self.respond(rows[i:i + STRIP]).argmax(axis=1)
                               for i in range(0, len(rows), STRIP)])  # (halves, FILTERS)
        f = np.arange(FILTERS)
        at = [rows[np.arange(len(rows))[:, None], best + j] for j in range(WIDTH)]
        pooled = sum(self.table[j][at[j], f] for j in range(WIDTH))
        g = [np.zeros(p.shape, np.float64) for p in self.params()]
        back = np.zeros_like(pooled)
        start, fill = 0, filled(rows)
        for size, target in zip(sizes, y):
            p = pooled[start:start + size]
            two = size > 1
            left = p[:-1] >= p[1:] if two else np.ones_like(p, bool)
            chunk = np.where(left, p[:-1], p[1:]) if two else p
            a, h = self._read(chunk, fill[start:start + size])
            mean = h.mean(axis=0)
            e = (sigmoid(mean @ self.out + self.obias[0]) - target) / len(docs)
            g[4] += e * mean
            g[5] += e
            gh = (h > 0) * (e * self.out / len(h))
            g[2] += a.T @ gh
            g[3] += gh.sum(axis=0)
            ga = (gh @ self.hidden[:FILTERS].T) * (a[:, :FILTERS] > 0)
            g[1] += ga.sum(axis=0)
            if two:
                back[start:start + size - 1] += ga * left
                back[start + 1:start + size] += ga * ~left
            else:
                back[start:start + size] += ga
            start += size
        for j in range(WIDTH):
            flat = at[j].astype(np.int64) * FILTERS + f
            g[0][j] = np.bincount(flat.ravel(), back.ravel(), 257 * FILTERS).reshape(257, FILTERS)
        return g


def fit(docs: list[bytes], y: np.ndarray, prior: float, epochs: int = EPOCHS) -> Net:
    """Adam over shuffled small batches of both classes; then the bias takes the true prior.

    Texts are kept as bytes and cut into half-chunks, all of them, batch by batch.
    """
    net, r = Net.fresh(), np.random.default_rng(SEED)
    m = [np.zeros(p.shape) for p in net.params()]
    v = [np.zeros(p.shape) for p in net.params()]
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for i in range(0, len(docs), BATCH):
            part = order[i:i + BATCH]
            t += 1
            for p, g, a, b in zip(net.params(), net.gradient([halves(docs[k]) for k in part], y[part]), m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-7)).astype(p.dtype)
    share = y.mean()
    net.obias += np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net:
    """Fit to at most ``per_class`` labelled rows of each class, fold 0 left out.

    Their texts are read whole, as in scoring. Without rows of both classes the net
    answers with the share of class 1 (1 if there are no labels).
    """
    text_batches(docs.sparkSession)
    sample, sizes = labelled_sample(labels, "quality", per_class)
    rows = (sample_texts(docs, sample)
            .select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).collect())
    rows.sort(key=lambda r: (r["doc_id"], r["raw"]))
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len({r["label"] for r in rows}) < 2:
        net = Net.fresh()
        net.out[:] = 0
        net.obias[:] = np.log(prior / (1 - prior)) if sizes else 60
        return net
    return fit([bytes(r["raw"]) for r in rows], np.array([r["label"] for r in rows], np.float64), prior)


def _scored(net: Net):
    def score(batches):
        for batch in batches:
            p = [net.probability(text.as_py()) for text in batch["text"]]
            yield batch.append_column("score", pa.array(p, pa.float64()))
    return score


def score(docs: DataFrame, net: Net) -> DataFrame:
    """Add score (probability of quality 1), predicted and held_out to every row.

    The score reads only the text. A null text counts as empty; empty texts get the
    net's answer to padding. Very long texts are scored whole, strip by strip. Repeated
    rows score alike. Other columns pass through; columns named like an added one are
    replaced. Empty input gives an empty result. A null doc_id counts as held out.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted", "held_out")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (docs.mapInArrow(_scored(net), schema + ", score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .withColumn("held_out", fold(F.col("doc_id")) == 0))
