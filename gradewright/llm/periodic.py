"""Runs of periodically repeated words: sparse diagonal DP over each text, word by word.

A run is a stretch of words with smallest period q (words q apart are identical), of at
least MIN_WORDS words and TIMES periods, that no neighbouring word extends. Seen as a
dot plot of the text against itself, a run is a piece of diagonal q of at least
(TIMES - 1) * q matches. Going through the words, an earlier occurrence of the word at
lag q adds one to the match length of diagonal q; an active diagonal that gets no match
has ended, and if it is long enough its run is emitted there and then.

The DP is sparse: an occurrence counts only if its context agrees too, and of those
occurrences only the nearest one does. Lags come in levels; level s has lags s to t and
a context of g = max(MIN_WORDS - s, (TIMES - 1) * s) words ending at the word, the
fewest matches any run of the level has, and t is the greatest lag with 2t - 1 <= g.
Nothing is lost: were a nearer occurrence of the context inside a run of period q at
lag d < q, the context would have periods q and d, and having g >= q + d words it would
have period gcd(q, d) as well, so q would not be the smallest. For the same reason what
is emitted has its smallest period. The first word of a diagonal found so already ends
g matches. So a word costs one sort entry on each level its context still repeats on,
whatever the number of its occurrences; a text without repeated contexts costs one.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, text_batches
from .words import groups, word_table

MIN_WORDS = 6
TIMES = 4
RUN_TYPE = "struct<start:bigint,length:bigint,period:bigint>"
_ROWS = f"doc_id long, n_words long, runs array<{RUN_TYPE}>, collapsed string"
_K = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def levels(longest: int):
    """(lowest lag, highest lag, words of context) of each level a text of that length can use."""
    low = 1
    while TIMES * low <= longest:
        context = max(MIN_WORDS - low, (TIMES - 1) * low)
        high = (context + 1) // 2
        yield low, high, context
        low = high + 1


def _matches(words: np.ndarray, first: np.ndarray):
    """(word, lag, context) of the nearest earlier occurrence in context, level by level.

    ``first``: first word of each text and of the end. Contexts are named by doubling:
    one of g words is two of 2^k words that together cover it.
    """
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(words)) - np.repeat(first[:-1], size)
    alive = np.arange(len(words))  # words whose last context occurs elsewhere in the text
    names, span = words, 1         # names of the 2^k words that end at each word
    for low, high, context in levels(int(size.max(initial=0))):
        while 2 * span <= context:
            with np.errstate(over="ignore"):
                longer = names.copy()
                longer[span:] = mix(names[span:] * _K + names[:-span], span)
            names, span = longer, 2 * span
        alive = alive[within[alive] >= context - 1]
        if len(alive) < 2:
            return
        with np.errstate(over="ignore"):
            named = mix(names[alive] * _K + names[alive - (context - span)], context)
            named = mix(named + text[alive].astype(np.uint64) * _K, 1)
        order = np.argsort(named, kind="stable")
        named, at = named[order], alive[order]
        same = named[1:] == named[:-1]
        lag = at[1:] - at[:-1]
        hit = same & (low <= lag) & (lag <= high)
        yield at[1:][hit], lag[hit], context
        alive = np.sort(at[np.r_[same, False] | np.r_[False, same]])


def _emit(matches) -> list[Run]:
    """The DP proper over (word, lag, context) in word order; runs by start, then period."""
    runs: list[Run] = []

    def end(last: int, lag: int, length: int) -> None:
        if length + lag >= max(MIN_WORDS, TIMES * lag):
            runs.append((last - length - lag + 1, length + lag, lag))

    active: dict[int, int] = {}  # lag -> matches on its diagonal up to the word before
    before = -2
    for word, here in groupby(matches, key=itemgetter(0)):
        if word != before + 1:
            for lag, length in active.items():
                end(before, lag, length)
            active = {}
        longer = {lag: active.pop(lag, context - 1) + 1 for _, lag, context in here}
        for lag, length in active.items():
            end(before, lag, length)
        active, before = longer, word
    for lag, length in active.items():
        end(before, lag, length)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(raws: list[bytes]) -> tuple[list[list[Run]], list[int]]:
    """Runs and number of words of several whole texts."""
    words, first = word_table(raws)
    found = list(_matches(words, first))
    runs: list[list[Run]] = [[] for _ in raws]
    if found:
        word = np.concatenate([w for w, _, _ in found])
        lag = np.concatenate([g for _, g, _ in found])
        context = np.concatenate([np.full(len(w), c) for w, _, c in found])
        order = np.argsort(word, kind="stable")
        word, lag, context = word[order], lag[order], context[order]
        cuts = np.searchsorted(word, first)
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            runs[k] = _emit(zip((word[a:b] - first[k]).tolist(), lag[a:b].tolist(), context[a:b].tolist()))
    return runs, np.diff(first).tolist()


def collapse(raw: bytes, runs: list[Run]) -> bytes:
    """Words joined by one space, less those that a run holds after its first period."""
    words = raw.split()
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words)


def _find(batches):
    for batch in batches:
        raws = [raw or b"" for raw in batch["text"].cast(pa.binary()).to_pylist()]
        runs, sizes, kept = [], [], []
        for group in groups(raws):
            found, n = runs_of(group)
            runs += found
            sizes += n
            kept += [collapse(raw, r) for raw, r in zip(group, found)]
        flat = [r for own in runs for r in own]
        fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period), collapsed.

    ``collapsed`` is the text's words joined by one space, without the words that some
    run holds after its first period. Words are runs of anything but ASCII white space,
    case counts. A null text has no words, no runs and an empty ``collapsed``, as has an
    empty text. Runs of different periods may overlap and are all returned. Texts of any
    length are read whole, each in one task; memory is some 100 bytes a word of the
    longest text. Repeated rows give repeated results, a null key stays null, other
    columns are ignored, and an empty table gives an empty result. Nothing is shuffled.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_find, _ROWS)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of every tenth text, by hash of its id, made periodic.

    With h the crc32 of the decimal id, g = h // 10 and n words: if h % 10 = 0, word
    i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Other
    texts, also null ones and those without words or without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    steps = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("_h"))
             .withColumn("_w", F.when(F.col("_h") % 10 == 0, split))
             .withColumn("_g", F.floor(F.col("_h") / 10))
             .withColumn("_n", F.when(F.size("_w") > 0, F.size("_w")))
             .withColumn("_a", F.col("_g") % F.col("_n"))
             .withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))))
    place = F.transform(F.expr("sequence(0L, _n - 1L)"), lambda i: F.when(i < F.col("_a"), i).otherwise(
        F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    words = F.transform(place, lambda i: F.get(F.col("_w"), i.cast("int")))
    return steps.select("doc_id", F.when(F.col("_n").isNotNull(), F.array_join(words, " "))
                        .otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run and digests of all runs and of the collapsed text."""
    def lines(run: Column) -> Column:
        return F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.shorter")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.shorter")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lines), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))
