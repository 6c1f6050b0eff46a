"""Stateful operators of the streams: what a run or field has to remember between micro-batches.

State is kept per key in the state store (RocksDB, on disk and in the checkpoint) and is dropped by
event-time timers, so it does not grow with the number of finished runs and fields.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with several states need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class AfterTaint(StatefulProcessor):
    """Lines of a run behind its first taint mark.

    The mark's line number is a value state.  Lines not behind a known mark wait in a list state on disk,
    as a mark with a smaller number may still come, in whatever batch; then they are settled.  So results do not
    depend on the order of arrival.  ``keep_ms`` after the run's last line (event time) both states are dropped.
    """

    def __init__(self, columns: Sequence[str], waiting: str, keep_ms: int):
        self.columns, self.waiting_schema, self.keep_ms = list(columns), waiting, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first_taint", "line_no long")
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = known = self.first.get()[0] if self.first.exists() else None
        seen = 0
        for row in rows:
            seen = max(seen, int(row["seen_at"].timestamp() * 1000))
            if row["kind"] == "Taint" and (known is None or row["line_no"] < known):
                known = row["line_no"]
            values = tuple(row[c] for c in self.columns)
            if known is None or row["line_no"] <= known:
                self.waiting.appendValue(values)
            else:
                yield self._row(values)
        if known != before:
            self.first.update((known,))
            at, early = self.columns.index("line_no"), []
            for values in self.waiting.get() if self.waiting.exists() else ():
                if values[at] > known:
                    yield self._row(values)
                else:
                    early.append(tuple(values))
            # Lines up to the mark, which a run has few of.
            self.waiting.clear()
            if early:
                self.waiting.put(early)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen + self.keep_ms)

    def _row(self, values: tuple) -> Row:
        return Row(**dict(zip(self.columns, values)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_after_taint(lines: DataFrame, delay: str = "1 hour", keep_ms: int = 3_600_000, columns: Sequence[str] = ("run_id", "line_no", "kind", "mnemonic", "branch", "loop")) -> DataFrame:
    """``stream_trace`` lines behind the first taint mark of their run (``columns`` of them, run_id and line_no among these)."""
    use_rocksdb(lines.sparkSession)
    columns = list(columns)
    kinds = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in columns)
    needed = lines.select(*dict.fromkeys([*columns, "kind", "line_no", "seen_at"])).where("run_id IS NOT NULL AND line_no IS NOT NULL")
    return needed.withWatermark("seen_at", delay).groupBy("run_id").transformWithState(AfterTaint(columns, kinds, keep_ms), kinds, "Append", "EventTime")


class EarlyStop(StatefulProcessor):
    """First position of a field at which its mutations show low diversity.

    Running sums are one value state; at the stop they give way to a mark of one number, and a
    timer drops what is left ``keep_ms`` after the field's last result.
    """

    def __init__(self, key: str, order: str, names: Sequence[str], minimum: int, eps: float, event_time: str | None, keep_ms: int):
        self.key, self.order, self.names, self.minimum, self.eps, self.event_time, self.keep_ms = key, order, list(names), minimum, eps, event_time, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, changed boolean, first array<double>, s array<double>, q array<double>")
        self.stopped = handle.getValueState("stopped", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, width = 0, len(self.names)
        if self.event_time or not self.stopped.exists():
            # As many rows as a batch has results of one field, which its mutation budget bounds.
            rows = sorted(rows, key=lambda r: r[self.order])
        if not self.stopped.exists():
            n, changed, first, s, q = self.sums.get() if self.sums.exists() else (0, False, None, None, None)
            for row in rows:
                v = [float(row[c] or 0.0) for c in self.names]
                n += 1
                first, s, q = list(first or v), list(s or [0.0] * width), list(q or [0.0] * width)
                off = [a - b for a, b in zip(v, first)]
                changed = changed or any(round(a, 6) != round(b, 6) for a, b in zip(v, first))
                s, q = [a + o for a, o in zip(s, off)], [a + o * o for a, o in zip(q, off)]
                spread = sum(sqrt(max(b / n - (a / n) ** 2, 0.0)) for a, b in zip(s, q)) / width
                if self.minimum > 0 and n >= max(self.minimum, 2) and (not changed or spread <= self.eps):
                    self.sums.clear()
                    self.stopped.update((n,))
                    yield Row(**{self.key: key[0], "stop_at": n})
                    break
            else:
                self.sums.update((n, changed, first, s, q))
        if self.event_time:
            seen = max((int(r[self.event_time].timestamp() * 1000) for r in rows), default=0)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.sums.clear()
        self.stopped.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_early_stop(
    results: DataFrame, key: str, order: str, names: Sequence[str], minimum: int, eps: float = 1e-6, event_time: str | None = None, delay: str = "1 hour", keep_ms: int = 3_600_000
) -> DataFrame:
    """(key, stop_at): one row when a field stops; null metric values count as 0.

    With ``event_time`` (a timestamp column) state is dropped by timers; without, it stays as small as it is.
    """
    use_rocksdb(results.sparkSession)
    rows = results.select(*dict.fromkeys([key, order, *names, *([event_time] if event_time else [])])).where(f"`{key}` IS NOT NULL")
    rows = rows.withWatermark(event_time, delay) if event_time else rows
    out = f"`{key}` {results.schema[key].dataType.simpleString()}, stop_at long"
    return rows.groupBy(key).transformWithState(EarlyStop(key, order, names, minimum, eps, event_time, keep_ms), out, "Append", "EventTime" if event_time else "None")
