"""Quality rules: counted base rules, then a hashed n-gram logistic regression.

The regression sees the share of each hashed word 1- and 2-gram and character 3-
and 5-gram in the whole text. It is trained on a bounded sample of labelled rows,
calibrated (Platt) on a fold it was not fitted to, and held against fixed
thresholds. Scoring is one gather of weights per n-gram in Arrow batches: a text of
any length needs memory for its own n-grams only. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, sigmoid, text_batches
from .training import labelled_sample, sample_texts

BITS = 11  # 2048 buckets for each kind of n-gram
SIZE = 1 << BITS
KINDS = 4
PER_CLASS = 1200  # labelled rows of each class that the model is fitted to, at most
KEEP_AT, SURE_AT = 0.3, 0.7
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_CACHED_WORDS = 60_000


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) > 1 << 20:  # three ids would not fit in 63 bits: number the pairs first
        _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
        windows = pairs[:-1] * np.int64(len(known)) + ids[2:]
    else:
        windows = (ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i:n - 2 + i] |= twice
    return int(covered.sum())


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


def ngram_buckets(text: str, cache: _Words) -> list[np.ndarray]:
    """Bucket of every n-gram of the text, for each of the four kinds."""
    words = text.encode().split()
    w = np.fromiter(map(cache.__getitem__, words), np.uint32, len(words))
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - BITS)

    def chars(k):
        if len(c) < k:
            return np.zeros(0, np.uint32)
        h = c[:len(c) - k + 1] * _K[0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint32(15))) + c[j:len(c) - k + 1 + j] * _K[j]
        return (h * _K[1]) >> shift

    return [(w * _K[0]) >> shift, ((w[:-1] * _K[1] + w[1:] * _K[2]) * _K[0]) >> shift,
            chars(3), chars(5)]


@dataclass(frozen=True)
class Model:
    """Weights per n-gram kind, the bias, and the calibration of the raw score."""

    weights: np.ndarray  # (KINDS, SIZE) float32
    bias: float
    slope: float
    offset: float

    def probability(self, text: str | None, cache: _Words) -> float:
        raw = self.bias
        for kind, at in enumerate(ngram_buckets(text or "", cache)):
            if len(at):
                raw += float(self.weights[kind].take(at).mean(dtype=np.float64))
        return float(sigmoid(self.slope * raw + self.offset))


def _features(batches):
    """Share of each bucket in each kind of n-gram, as non-zero entries."""
    cache = _Words()
    for batch in batches:
        at, share = [], []
        for text in batch["text"]:
            row = np.concatenate([np.bincount(b, minlength=SIZE) / max(1, len(b))
                                  for b in ngram_buckets(text.as_py() or "", cache)])
            places = np.flatnonzero(row)
            at.append(places.astype("<u2").tobytes())
            share.append(row[places].astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "label": batch["label"], "at": at, "share": share},
            schema=pa.schema([("doc_id", pa.int64()), ("label", pa.int32()),
                              ("at", pa.binary()), ("share", pa.binary())]))


def _forward(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in doubles, without a copy of all of x as doubles."""
    return np.concatenate([x[a:a + 512].astype(np.float64) @ w for a in range(0, len(x), 512)])


def _backward(err: np.ndarray, x: np.ndarray) -> np.ndarray:
    """err @ x in doubles, likewise."""
    return np.concatenate([err @ x[:, a:a + 2048].astype(np.float64) for a in range(0, x.shape[1], 2048)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int
              ) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by full-batch Adam."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        err = (sigmoid(_forward(x, w) + b) - y) * weight
        g = np.append(_backward(err, x) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _fitted(sizes: dict[int, int]):
    """Model of all rows of a task, as one row; none if they are of one class."""
    def fit(batches):
        rows = [r for b in batches for r in zip(*(b[c].to_pylist() for c in ("doc_id", "at", "share", "label")))]
        rows.sort()
        y = np.array([r[3] for r in rows], np.float64)
        if len(set(y.tolist())) < 2:
            return
        x = np.zeros((len(rows), KINDS * SIZE), np.float32)
        for i, (_, at, share, _) in enumerate(rows):
            x[i, np.frombuffer(at, "<u2")] = np.frombuffer(share, "<f4")
        ids = [r[0] for r in rows]
        del rows
        scale = (1 / np.sqrt(x.mean(axis=0) + 1e-4)).astype(np.float32)
        x *= scale
        # Fold 1 calibrates, the rest fit; a small sample does both.
        calib = np.array([crc_fold(i) == 1 for i in ids])
        if min(np.bincount(y[calib].astype(int), minlength=2)) < 10:
            calib = np.ones(len(ids), bool)
        use = ~calib if not calib.all() else calib
        half = np.where(y == 1, 0.5 / max(1, y[use].sum()), 0.5 / max(1, (1 - y[use]).sum()))
        own = x[calib]
        for k, i in enumerate(np.flatnonzero(use)):  # rows to fit move to the front: no copy of them
            x[k] = x[i]
        w, b = _logistic(x[:use.sum()], y[use], half[use], 1e-4, 200)
        raw = _forward(own, w) + b
        # Classes were sampled evenly; calibration weighs them as they occur.
        counts = np.bincount(y[calib].astype(int), minlength=2)
        prior = np.array([sizes[0], sizes[1]]) / counts
        s, o = _logistic((raw / 4)[:, None], y[calib], prior[y[calib].astype(int)], 1e-3, 400)
        yield pa.RecordBatch.from_pydict({
            "weights": [(w * scale).astype("<f4").tobytes()], "bias": [float(b)],
            "slope": [max(float(s[0]) / 4, 1e-3)], "shift": [float(o)]})
    return fit


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit to at most ``per_class`` labelled rows of each class (fold 0 is never used).

    One task fits, and the driver gets the model alone. With rows of one class or none,
    the model returns that class's share, or 1.
    """
    text_batches(docs.sparkSession)
    sample, sizes = labelled_sample(labels, "quality", per_class)
    model = (sample_texts(docs, sample)
             .mapInArrow(_features, "doc_id long, label int, at binary, share binary").repartition(1)
             .mapInArrow(_fitted(sizes), "weights binary, bias double, slope double, shift double").collect())
    if not model:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 1)
        return Model(np.zeros((KINDS, SIZE), np.float32), 0.0, 1.0, float(np.log(share / max(1e-9, 1 - share)))
                     if share < 1 else 60.0)
    m = model[0]
    return Model(np.frombuffer(m["weights"], "<f4").reshape(KINDS, SIZE), m["bias"], m["slope"], m["shift"])


def _score(model: Model):
    def score(batches):
        cache = _Words()
        for batch in batches:
            counts, p = [], []
            for text in batch["text"]:
                text = text.as_py()
                counts.append(base_counts(text))
                p.append(model.probability(text, cache))
            n = np.array(counts, np.int64).reshape(-1, 5)
            out = batch
            for i, name in enumerate(COUNTS):
                out = out.append_column(name, pa.array(n[:, i]))
            yield out.append_column("quality_score", pa.array(p, pa.float64()))
    return score


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, model: Model) -> DataFrame:
    """Add the base counts, quality_score, base_failed, band and kept to every row.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows.
    band: reject below KEEP_AT, keep from SURE_AT, doubt between. kept: not base_failed
    and not in band reject. A null text counts as empty (0 words, so it fails). Repeated
    rows are scored alike. Other columns pass through; columns named like an added one
    are replaced. Empty input gives an empty result.
    """
    text_batches(docs.sparkSession)
    added = [*COUNTS, "quality_score"]
    docs = docs.drop(*added, "base_failed", "band", "kept")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(_score(model), schema + "".join(f", {c} long" for c in COUNTS)
                           + ", quality_score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    band = (F.when(F.col("quality_score") < KEEP_AT, "reject")
            .when(F.col("quality_score") < SURE_AT, "doubt").otherwise("keep"))
    return (rows.withColumn("base_failed", failed).withColumn("band", band)
            .withColumn("kept", ~F.col("base_failed") & (F.col("band") != "reject")))
