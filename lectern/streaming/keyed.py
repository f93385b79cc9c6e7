"""Keyed operators on streams whose rows come late, out of order and more than once.

A row waits in its key's state until the watermark has passed it: only then is everything known that
comes before it. A timer wakes the key, which answers its waiting rows in order of time, by
the same step as the table form, and keeps only what the step still needs. Equal rows within the
watermark's delay count once. State is a list per key in RocksDB; one row per waiting request, one value
for the step's state, which a timer removes when no later request could still see it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import cache, ordered

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Answers each key's rows in order of (time, tie) once the watermark is past them."""

    def __init__(self, step: ordered.Step, us: str, tie: str, schema: str, columns: list[str], name: str, keep: int):
        self.step, self.us, self.tie, self.schema, self.columns, self.name, self.keep = step, us, tie, schema, columns, name, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.kept = handle.getListState("kept", "at long")

    def _wake(self, us: int) -> int:
        """The first millisecond at which a watermark is past a time in microseconds."""
        return us // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            for row in batch[self.columns].itertuples(index=False, name=None):
                self.waiting.appendValue(tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row))
            times.update(batch[self.us])
        # One timer for all that came together: it fires when the last of them is passed, or an earlier one does.
        if times:
            self.handle.registerTimer(self._wake(int(max(times))))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.columns) if self.waiting.exists() else pd.DataFrame(columns=self.columns)
        state = ordered.restore([at for (at,) in self.kept.get()]) if self.kept.exists() else None
        due = rows[rows[self.us].map(lambda us: self._wake(us) <= now)].sort_values([self.us, self.tie])
        later = rows.drop(due.index)
        answers = []
        for us in due[self.us]:
            state, answer = self.step(state, us)
            answers.append(answer)
        if len(due):
            self.handle.registerTimer(self._wake(int(due[self.us].iloc[-1]) + self.keep))
        if state is not None and (len(due) or len(later) or self._alive(state, now)):
            self.kept.put([(at,) for at in ordered.dump(state)])
        elif self.kept.exists():
            self.kept.clear()
        if len(later):
            self.waiting.put([tuple(r) for r in later.itertuples(index=False, name=None)])
            self.handle.registerTimer(self._wake(int(later[self.us].max())))
        elif self.waiting.exists():
            self.waiting.clear()
        yield due.assign(**{self.name: answers})

    def _alive(self, state: Any, now: int) -> bool:
        times = ordered.dump(state)
        return bool(times) and self._wake(times[-1] + self.keep) > now

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame, key: str, us: str, tie: str, step: ordered.Step, keep: int, name: str, delay: str, once: list[str] | None = None
) -> DataFrame:
    """The stream's rows with ``name``, the step's answer, as the table form gives it.

    ``stream`` has an event time ``ts`` equal to ``us``. ``once`` names the columns by which a row that comes
    again is known (``tie`` unless given). Rows later than the watermark are dropped.
    """
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}: keyed timers need it")
    unique = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(once or [tie])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    made = InOrder(step, us, tie, fields, stream.columns, name, keep)
    return unique.groupBy(key).transformWithStateInPandas(made, f"{fields}, `{name}` boolean", "Append", "EventTime")


def rate_limiter(stream: DataFrame, key: str, us: str, tie: str, span: int = 60_000_000, limit: int = 10, delay: str = "10 minutes") -> DataFrame:
    """R3, for rows that come late or twice."""
    return in_order(stream, key, us, tie, ordered.limit_step(span, limit), span, "accepted", delay)


def ttl_cache(stream: DataFrame, key: str, us: str, tie: str, ttl: int = cache.TTL, delay: str = "10 minutes") -> DataFrame:
    """R2, for rows that come late or twice."""
    return in_order(stream, key, us, tie, ordered.ttl_step(ttl), ttl + 1, "hit", delay)


def with_rocksdb(spark: SparkSession, run: Callable[[], Any]) -> Any:
    """Run something that starts a query with keyed timers, whatever state store the session has set."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
