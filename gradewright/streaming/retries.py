"""Retry resolution over a stream of validated attempts."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CALL = "seen INT, failed INT, ok INT, refused INT, payload STRING, done BOOLEAN, latest BIGINT"
NEW = (0, 0, 0, 0, None, False, 0)
DECIDED = (0, 0, 0, 0, None, True)  # the mark that a call is decided is all that has to stay, until its time is up
BUCKETS = 1024  # groups that calls are dealt to; one holds the calls of the timeout, over BUCKETS


# The processor travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RetryResolver(StatefulProcessor):
    """Emits a call once: at its first valid attempt, when exhausted, or on timeout.

    State per call is two attempt bit masks, the deciding attempt numbers and one
    payload, whatever the number or order of rows. An attempt decides only when
    all attempts before it were seen, so arrival order does not change the result.

    A group is a bucket of calls, and its state is one row with all of them: it is read and
    written once a batch, not once a call, and has one timer, for the call that is over first.

    With a timeout every call ends ``timeout_ms`` of event time after its latest attempt: an
    undecided one is emitted with what was seen, and its state, or the mark that it is
    decided, is removed. So state follows the calls of the timeout, not all calls.
    """

    def __init__(self, keys: Sequence[str], bound: int, timeout_ms: int | None) -> None:
        self.keys, self.bound, self.timeout_ms = list(keys), bound, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names = ", ".join(f"k{i} STRING" for i in range(len(self.keys)))
        self.state = handle.getValueState("calls", f"timer BIGINT, calls ARRAY<STRUCT<{names}, {CALL}>>")

    def _load(self) -> tuple[int | None, dict[tuple, tuple]]:
        timer, held = self.state.get() if self.state.exists() else (None, [])
        n = len(self.keys)
        return timer, {tuple(c[:n]): tuple(c[n:]) for c in held}

    def _save(self, timer: int | None, calls: dict[tuple, tuple]) -> None:
        """Keep the calls, and the timer at the end of the one that is over first."""
        if not calls:
            self.state.clear()
            return
        if self.timeout_ms is not None:
            end = min(c[-1] for c in calls.values()) + self.timeout_ms
            if end != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(end)
                timer = end
        self.state.update((timer, [(*key, *call) for key, call in calls.items()]))

    def _rows(self, decided: list[tuple]) -> Iterator[pd.DataFrame]:
        if decided:
            out = pd.DataFrame(decided, columns=[*self.keys, "outcome", "attempt", "failed_attempts", "payload"],
                               dtype=object)
            yield out.astype({"attempt": "Int32", "failed_attempts": "Int32"})

    def _decide(self, seen: int, failed: int, ok: int, refused: int, force: bool):
        """(outcome, attempt, failed before it), or None while it is still open."""
        first = min(ok or self.bound + 1, refused or self.bound + 1)
        if first <= self.bound:
            before = (1 << (first - 1)) - 1
            if force or seen & before == before:
                name = "ok" if ok == first else "provider_error"
                return name, first, bin(failed & before).count("1")
            return None
        count = bin(failed).count("1")
        if count >= self.bound:
            return "exhausted", None, count
        return ("open", None, count) if force else None

    def _seen(self, call: tuple, attempt, valid, error, text, millis: int) -> tuple:
        seen, failed, ok, refused, payload, done, latest = call
        latest = max(latest, millis)
        if not done and attempt <= self.bound:
            attempt = int(attempt)
            seen |= 1 << (attempt - 1)
            if error is not None and not pd.isna(error):
                refused = min(refused or attempt, attempt)
            elif valid:
                if not ok or attempt < ok:
                    ok, payload = attempt, text
            else:
                failed |= 1 << (attempt - 1)
        return seen, failed, ok, refused, payload, done, latest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        timer, calls = self._load()
        touched: dict[tuple, None] = {}
        for batch in rows:
            # Columns come as objects with None for null, whatever type pandas would pick.
            columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in self.keys]
            # A row without a time leaves its call's latest as it is.
            millis = batch["millis"].fillna(0).tolist() if self.timeout_ms is not None else [0] * len(batch)
            for *name, attempt, valid, error, text, at in zip(
                    *columns, batch["attempt"], batch["valid"], batch["provider_error"], batch["payload"], millis):
                name = tuple(name)
                calls[name] = self._seen(calls.get(name, NEW), attempt, valid, error, text, int(at))
                touched[name] = None
        decided = []
        for name in touched:
            *held, done, latest = calls[name]
            found = None if done else self._decide(*held[:4], force=False)
            if found is not None:
                calls[name] = (*DECIDED, latest)
                decided.append((*name, *found, held[4] if found[0] == "ok" else None))
        self._save(timer, calls)
        yield from self._rows(decided)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        _, calls = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        decided = []
        for name in [k for k, c in calls.items() if c[-1] + self.timeout_ms <= now]:
            *held, done, _ = calls.pop(name)
            if not done and (held[0] or held[1]):
                found = self._decide(*held[:4], force=True)
                decided.append((*name, *found, held[4] if found[0] == "ok" else None))
        self._save(None, calls)
        yield from self._rows(decided)

    def close(self) -> None:
        pass


def resolve_stream(attempts: DataFrame, keys: Sequence[str] = ("run_id", "record_id", "stage"),
                   bound: int = fixed.RESPONSE_ATTEMPTS, timeout_ms: int | None = 600_000,
                   at: str = "at", delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Stateful twin of the batch retry resolution; needs the RocksDB state store.

    ``attempts`` has the keys, attempt, valid, provider_error, a text payload and, with
    a timeout, an event time ``at``. Rows may arrive ``delay`` late. Once the watermark has passed a
    call's latest attempt by the timeout, it is over: emitted as it stands if it is still undecided
    (``open`` without a deciding attempt), and forgotten; a row that names it after that
    opens a new call. Without a timeout nothing is forgotten.

    ``buckets`` must stay the same for a checkpoint. A batch rewrites the open calls of the
    buckets it has rows for: more buckets rewrite less, fewer cost less where all are touched.
    """
    schema = ", ".join(f"{k} STRING" for k in keys) + (
        ", outcome STRING, attempt INT, failed_attempts INT, payload STRING")
    columns = [*keys, "attempt", "valid", "provider_error", "payload"]
    if timeout_ms is None:
        slim = attempts.select(*columns)
    else:
        slim = (attempts.select(*columns, F.unix_millis(at).alias("millis"), F.col(at).alias("at"))
                .withWatermark("at", delay))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    return slim.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        RetryResolver(keys, bound, timeout_ms), schema, "append",
        "EventTime" if timeout_ms is not None else "None")
