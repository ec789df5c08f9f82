"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever
their labels say, is the unlabelled set. Linear classifiers over hashed words and
word beginnings minimise the non-negative risk estimator with a class prior (Kiryo
et al., 2017) under log loss: prior * R+ plus the unlabelled risk less the positives'
part of it, held above zero. The answers of several classifiers are averaged. Scoring needs one
pass over the words of a whole text and shuffles nothing.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sigmoid, text_batches
from .training import by_hash, labelled, sample_texts
from .words import byte_runs, groups, hash_spans

BITS = 16
SIZE = 1 << BITS
STEMS = (4, 5)       # lengths, in bytes, of the word beginnings that count as features
POSITIVES = 2000     # toxic documents the classifiers are fitted to, at most
UNLABELLED = 6000    # documents in the unlabelled sample, at most
MODELS, EPOCHS, BATCH, RATE, SEED = 3, 30, 250, 0.1, 5
DECAY = 2e-5
THRESHOLD = 0.5
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_LETTERS = np.array([bool(_WORD.fullmatch(bytes([x]))) for x in range(256)])
_CACHED_WORDS = 120_000
# Checksums of the marks before a word and before its beginnings, which theirs go on from.
_SHIFT, _WHOLE = 32 - BITS, zlib.crc32(b"w")
_STARTS = tuple((size, zlib.crc32(b"%d" % size)) for size in STEMS)


class _Features(dict):
    """Word -> buckets of the word and its beginnings."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = [zlib.crc32(word, _WHOLE) >> _SHIFT]
        for size, start in _STARTS:
            if len(word) >= size:
                value.append(zlib.crc32(word[:size], start) >> _SHIFT)
        self[word] = value = tuple(value)
        return value


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-cased words of the whole text."""
    return set(_WORD.findall((text or "").lower().encode()))


def buckets(text: str | None, cache: _Features) -> np.ndarray:
    """Feature buckets of the distinct words of the whole text."""
    return np.fromiter(itertools.chain.from_iterable(cache[w] for w in sorted(words_of(text))), np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (MODELS, SIZE)
    bias: np.ndarray     # (MODELS,)


class Scorer:
    """Scores texts: the sum of the weights of the features of its distinct words, over the root
    of the number of features, so that long texts do not score high by their length."""

    def __init__(self, model: Model) -> None:
        self.model, self.features = model, _Features()

    def _values(self, words: list[bytes]) -> np.ndarray:
        """For each word, the number of its features and the sums of their weights."""
        at = [self.features[word] for word in words]
        size = np.fromiter(map(len, at), np.int64, len(at))
        flat = np.fromiter(itertools.chain.from_iterable(at), np.int64, int(size.sum()))
        sums = np.add.reduceat(self.model.weights[:, flat], np.cumsum(size) - size, axis=1)
        return np.vstack([size, sums]).T

    def _group(self, raws: list[bytes]) -> np.ndarray:
        """Scores of several texts, whose words are told apart by hash and looked up once for all."""
        sums = np.zeros((len(raws), 1 + len(self.model.bias)))
        whole = b"\n".join(raws)
        b = np.frombuffer(whole, np.uint8)
        starts, ends = byte_runs(b, _LETTERS)
        if len(starts):
            named, first, which = np.unique(hash_spans(b, starts, ends), return_index=True, return_inverse=True)
            values = self._values([whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
            owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
            text, word = np.divmod(np.unique(owner * len(named) + which), len(named))
            for k in range(sums.shape[1]):
                sums[:, k] = np.bincount(text, values[word, k], len(raws))
        z = sums[:, 1:] / np.sqrt(np.maximum(sums[:, :1], 1))
        return sigmoid(z + self.model.bias).mean(axis=1)

    def probabilities(self, texts: list[str | None]) -> list[float]:
        """Scores of whole texts, in order."""
        lowered = ((t or "").lower().encode() for t in texts)
        return [p for group in groups(lowered) for p in self._group(group).tolist()]


def nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, seed: int,
         epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """One linear classifier by minibatch Adam on the non-negative PU risk, log loss."""
    r = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, b = np.zeros(SIZE), 0.0
    m, v, t = np.zeros(SIZE + 1), np.zeros(SIZE + 1), 0
    steps = max(1, len(unl) // BATCH)
    for epoch in range(epochs):
        up, uu = r.permutation(len(pos)), r.permutation(len(unl))
        for k in range(steps):
            p = pos[up[k * len(pos) // steps:max(k * len(pos) // steps + 1, (k + 1) * len(pos) // steps)]]
            u = unl[uu[k * BATCH:(k + 1) * BATCH] if len(unl) >= BATCH else uu]
            part = [rows[i] for i in (*p, *u)]
            flat = np.concatenate(part)
            owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
            scale = 1 / np.sqrt(np.maximum(1, [len(x) for x in part]))
            z = np.bincount(owner, w[flat], len(part)) * scale + b
            s = sigmoid(z)
            as_neg = np.logaddexp(0, z)  # log loss if the text were clean; its slope is s
            n, nu = len(p), len(u)
            risk_neg = as_neg[n:].mean() - prior * as_neg[:n].mean()
            g = np.zeros(len(part))
            if risk_neg >= 0:
                g[:n] = -prior / n       # slope of the loss as toxic less that as clean
                g[n:] = s[n:] / nu
            else:                        # step back where the unlabelled risk was overfitted
                g[:n] = prior * s[:n] / n
                g[n:] = -s[n:] / nu
            grad = np.append(np.bincount(flat, (g * scale)[owner], SIZE) + DECAY * w, g.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = RATE * (1 - 0.9 * epoch / epochs) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
            w, b = w - step[:-1], b - step[-1]
    # The risk estimate leaves the bias unsure; the prior says how many of the
    # unlabelled texts are toxic.
    z = [w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) for i in unl]
    return w, -float(np.quantile(z, 1 - prior))


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float) -> Model:
    pairs = [nnpu(rows, positive, prior, SEED + i) for i in range(MODELS)]
    return Model(np.array([w for w, _ in pairs]), np.array([b for _, b in pairs]))


def _feature_rows(batches):
    cache = _Features()
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), batch["positive"],
             pa.array([buckets(t.as_py(), cache).astype("<u2").tobytes() for t in batch["text"]], pa.binary())],
            ["doc_id", "positive", "at"])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None,
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit to at most ``positives`` toxic and ``unlabelled`` other documents (fold 0 left out).

    ``prior``: share of toxic documents; by default their share among labelled training
    rows. Without a toxic example every score is near the prior.
    """
    text_batches(docs.sparkSession)
    known = labelled(labels, "toxic")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if prior is None:
        prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    toxic = by_hash(known.filter("label = 1"), "doc_id", positives).select("doc_id", F.lit(True).alias("positive"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    other = by_hash(ids, "doc_id", unlabelled).select("doc_id", F.lit(False).alias("positive"))
    rows = (sample_texts(docs, toxic.unionByName(other))
            .mapInArrow(_feature_rows, "doc_id long, positive boolean, at binary").collect())
    rows.sort(key=lambda r: (r["positive"], r["doc_id"], r["at"]))
    positive = np.array([r["positive"] for r in rows], bool)
    if not positive.any() or positive.all():
        return Model(np.zeros((1, SIZE)), np.array([np.log(prior / (1 - prior))]))
    return fit([np.frombuffer(r["at"], "<u2").astype(np.int64) for r in rows], positive, prior)


def _scored(model):
    def score(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            p = scorer.probabilities(batch["text"].to_pylist())
            yield batch.append_column("score", pa.array(p, pa.float64()))
    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (probability of being toxic), predicted and held_out to every row.

    The score reads only the text. A null text counts as empty, and an empty text gets
    the score of a text without known words. Texts of any length are read whole.
    Repeated rows score alike. Other columns pass through; columns named like an added
    one are replaced. Empty input gives an empty result. A null doc_id counts as held out.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted", "held_out")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODELS * SIZE weights
    return (docs.mapInArrow(_scored(shared), schema + ", score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .withColumn("held_out", fold(F.col("doc_id")) == 0))
