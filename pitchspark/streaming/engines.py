"""Streaming forms: change-only history, freshness, sliding windows, slot triggers and rate limits.

Keyed operators are state machines over a key's rows in the order of their times (:class:`Ordered`): rows wait in a buffer of
their key until the watermark has passed them, are sorted once and worked on, so the result is the same for any size of
record batches and any order of arrival within the watermark. Rows older than the watermark are dropped by Spark, which
counts them (``numRowsDroppedByWatermark``). A key that has been silent for ``idle`` seconds of event time is forgotten with
all its state, and begins anew if it comes back. Batch twins in ``operators`` let the two be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_feed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run to the end of what is there now, exactly once per checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sliding_counts(stream: DataFrame, time: str, kind: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def fresh_and_stale(stream: DataFrame, observed: str, received: str, seconds: int = 10) -> DataFrame:
    """``freshness``: FRESH, STALE (older than allowed) or FUTURE (rejected downstream)."""
    age = (F.unix_micros(F.col(received).cast("timestamp")) - F.unix_micros(F.col(observed).cast("timestamp"))) / 1e6
    return stream.withColumn("freshness", F.when(age < 0, "FUTURE").when(age > seconds, "STALE").otherwise("FRESH"))


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; repeated deliveries within the watermark go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class Ordered(StatefulProcessor):
    """Rows of a key in the order of their times, by a buffer that event-time timers release.

    A row's tick is the millisecond after it. It is released when the watermark reaches its tick; a row that comes later
    with a tick at or below the watermark is one that Spark drops, so nothing is ever worked on out of order.
    """

    #: Columns of rows and their state types (``at`` in microseconds first), and columns put out.
    FIELDS: tuple[tuple[str, str], ...] = (("at", "long"), ("value", "string"))
    COLUMNS: tuple[str, ...] = ("key", "at", "value")
    IDLE = 2 * 86_400.0

    def __init__(self, idle: float = IDLE) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", ", ".join(f"{n} {t}" for n, t in self.FIELDS))
        self.clock = handle.getValueState("clock", "timer long, last long")
        self.begin(handle)

    # what an operator adds: its state, a step, deadlines of its own, and how it is forgotten
    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> None:
        raise NotImplementedError

    def step(self, key: str, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def store(self) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When the operator wants to be called without a row, in microseconds."""
        return None

    def due(self, key: str, until: int) -> list[tuple]:
        """What follows from deadlines before ``until`` (microseconds)."""
        return []

    @staticmethod
    def tick(at: int) -> int:
        return at // 1000 + 1

    def _arm(self, armed: int | None, when: int) -> int:
        """The one timer of the key is at ``when``."""
        if armed != when:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(when)
        return when

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names, least = [n for n, _ in self.FIELDS], None
        for chunk in rows:
            held = [tuple(None if pd.isna(v) else self._plain(v) for v in row) for row in chunk[names].itertuples(index=False, name=None)]
            if held:
                self.buffer.appendList(held)
                first = self.tick(min(r[0] for r in held))
                least = first if least is None else min(least, first)
        timer, last = self.clock.get() if self.clock.exists() else (None, None)
        if least is not None:
            # a timer for forgetting the key gives way to the rows; one for earlier rows or a deadline stays
            waiting = timer is not None and timer < least
            self.clock.update((timer if waiting else self._arm(timer, least), last))
        yield pd.DataFrame(columns=list(self.COLUMNS))

    @staticmethod
    def _plain(v):
        return v.item() if hasattr(v, "item") else v

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        ready = sorted((r for r in rows if self.tick(r[0]) <= now), key=lambda r: tuple((x is not None, x) for x in r))
        rest = [r for r in rows if self.tick(r[0]) > now]
        last = self.clock.get()[1] if self.clock.exists() else None
        out: list[tuple] = []
        self.load()
        for row in ready:
            out += self.due(key[0], row[0])
            out += self.step(key[0], row)
            last = row[0]
        out += self.due(key[0], now * 1000)
        forgotten = not rest and self.deadline() is None and last is not None and self.tick(last) + int(self.idle * 1000) <= now
        if forgotten:
            self.forget()
            self.buffer.clear()
            self.clock.clear()
        else:
            self.store()
            if rest:
                self.buffer.put(rest)
            else:
                self.buffer.clear()
            times = [self.tick(r[0]) for r in rest] + ([self.tick(self.deadline())] if self.deadline() is not None else [])
            when = min(times) if times else self.tick(last) + int(self.idle * 1000)
            self.handle.registerTimer(when)
            self.clock.update((when, last))
        yield pd.DataFrame(out, columns=list(self.COLUMNS))

    def close(self) -> None:
        pass


def _ordered(stream: DataFrame, processor: Ordered, out: str, late: str) -> DataFrame:
    tick = F.timestamp_millis(F.floor(F.col("at") / 1000) + 1)
    columns = ["key", *[n for n, _ in processor.FIELDS]]
    return stream.select(*columns, tick.alias("_tick")).withWatermark("_tick", late).groupBy("key").transformWithStateInPandas(processor, out, "Append", "EventTime")


class ChangeOnly(Ordered):
    """Rows (key, at, value) whose value differs from the one before of the key."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "value string")

    def load(self) -> None:
        self.known = self.before.exists()
        self.value = self.before.get()[0] if self.known else None

    def step(self, key: str, row: tuple) -> list[tuple]:
        at, value = row
        new = not self.known or value != self.value
        self.known, self.value = True, value
        return [(key, at, value)] if new else []

    def store(self) -> None:
        self.before.update((self.value,))

    def forget(self) -> None:
        self.before.clear()


def change_only(stream: DataFrame, late: str = "0 seconds", idle: float = Ordered.IDLE) -> DataFrame:
    """``stream`` has key string, at long (micros), value string. Needs the RocksDB state store, as all keyed operators here."""
    return _ordered(stream, ChangeOnly(idle), "key string, at long, value string", late)


class SlotTriggers(Ordered):
    """Each named threshold of a key's minute fires once, at the first row that reaches it."""

    FIELDS = (("at", "long"), ("value", "double"))
    COLUMNS = ("key", "threshold", "at")

    def __init__(self, thresholds: tuple[float, ...], idle: float = Ordered.IDLE) -> None:
        super().__init__(idle)
        self.thresholds = thresholds

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getMapState("fired", "threshold double", "at long")

    def load(self) -> None:
        pass

    def step(self, key: str, row: tuple) -> list[tuple]:
        at, value = row
        out = [(key, t, at) for t in self.thresholds if value is not None and value >= t and not self.fired.containsKey((t,))]
        for _, t, _ in out:
            self.fired.updateValue((t,), (at,))
        return out

    def store(self) -> None:
        pass

    def forget(self) -> None:
        self.fired.clear()


def slot_triggers(stream: DataFrame, thresholds: tuple[float, ...], late: str = "0 seconds", idle: float = Ordered.IDLE) -> DataFrame:
    return _ordered(stream, SlotTriggers(thresholds, idle), "key string, threshold double, at long", late)


class RateLimit(Ordered):
    """At most one row of a key per interval, counted from the last one that passed. State older than the interval says
    nothing about rows to come, so it is forgotten then."""

    FIELDS = (("at", "long"),)
    COLUMNS = ("key", "at")

    def __init__(self, micros: int) -> None:
        super().__init__(micros / 1e6)
        self.micros = micros

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "at long")

    def load(self) -> None:
        self.last = self.passed.get()[0] if self.passed.exists() else None

    def step(self, key: str, row: tuple) -> list[tuple]:
        if self.last is not None and row[0] - self.last < self.micros:
            return []
        self.last = row[0]
        return [(key, row[0])]

    def store(self) -> None:
        self.passed.update((self.last,))

    def forget(self) -> None:
        self.passed.clear()


def rate_limit(stream: DataFrame, seconds: float, late: str = "0 seconds") -> DataFrame:
    return _ordered(stream, RateLimit(int(seconds * 1e6)), "key string, at long", late)


class Lifecycle(Ordered):
    """The life of an event: rows (key, at, kind, soon, value) are accepted or not by what was accepted before.

    A finished event takes finished rows only, one that went away takes live rows and coming ones with a near kickoff
    (``soon``), a live one no coming rows. Put out are all rows with ``accepted`` and ``changed`` (the value or kind differs
    from the last accepted one); a terminal row also closes the event's quotes (``closes``), once.
    """

    FIELDS = (("at", "long"), ("kind", "string"), ("soon", "boolean"), ("value", "string"))
    COLUMNS = ("key", "at", "kind", "value", "accepted", "changed", "closes")
    OUT = "key string, at long, kind string, value string, accepted boolean, changed boolean, closes boolean"

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "kind string, value string")

    @staticmethod
    def accepts(was: str | None, kind: str, soon: bool) -> bool:
        if was == "FINISHED":
            return kind == "FINISHED"
        if was == "GONE":
            return kind == "LIVE" or kind == "PREMATCH" and soon
        return not (was == "LIVE" and kind == "PREMATCH")

    def load(self) -> None:
        self.was, self.value = self.last.get() if self.last.exists() else (None, None)

    def step(self, key: str, row: tuple) -> list[tuple]:
        at, kind, soon, value = row
        fine = self.accepts(self.was, kind, bool(soon))
        changed = fine and (kind, value) != (self.was, self.value)
        closes = fine and kind == "FINISHED" and self.was != "FINISHED"
        if fine:
            self.was, self.value = kind, value
        return [(key, at, kind, value, fine, changed, closes)]

    def store(self) -> None:
        self.last.update((self.was, self.value))

    def forget(self) -> None:
        self.last.clear()


def lifecycle(stream: DataFrame, late: str = "0 seconds", idle: float = Ordered.IDLE) -> DataFrame:
    """``stream``: key string, at long (micros), kind string, soon boolean, value string."""
    return _ordered(stream, Lifecycle(idle), Lifecycle.OUT, late)


class MatchSlots(Ordered):
    """The slots of a match, each once: PRE_KICKOFF (the last minute before kickoff and 5 s after), HALFTIME at the edge into
    the break, HT_STABLE ``delay`` seconds later unless play has gone on, MINUTE_x at crossings, FIRST_H2_GOAL at the first
    goal after the break, FINAL. Times are event times; HT_STABLE comes when the watermark has passed it."""

    FIELDS = (("at", "long"), ("kickoff", "long"), ("period", "string"), ("minute", "int"), ("goals", "int"))
    COLUMNS = ("key", "slot", "at")

    def __init__(self, delay: float, minutes: tuple[int, ...], idle: float = Ordered.IDLE) -> None:
        super().__init__(idle)
        self.delay, self.minutes = delay, minutes

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getMapState("fired", "slot string", "at long")
        self.state = handle.getValueState("state", "period string, half_goals int, stable long")

    def load(self) -> None:
        self.period, self.half, self.stable = self.state.get() if self.state.exists() else (None, None, None)

    def _fire(self, key: str, slot: str, at: int) -> list[tuple]:
        if self.fired.containsKey((slot,)):
            return []
        self.fired.updateValue((slot,), (at,))
        return [(key, slot, at)]

    def deadline(self) -> int | None:
        return self.stable

    def due(self, key: str, until: int) -> list[tuple]:
        if self.stable is None or self.stable >= until:
            return []
        at, self.stable = self.stable, None
        return self._fire(key, "HT_STABLE", at) if self.period == "HT" else []

    def step(self, key: str, row: tuple) -> list[tuple]:
        at, kickoff, period, minute, goals = row
        out: list[tuple] = []
        if period == "PRE" and kickoff is not None and -5_000_000 <= kickoff - at <= 60_000_000:
            out += self._fire(key, "PRE_KICKOFF", at)
        if period == "HT" and self.period != "HT":
            out += self._fire(key, "HALFTIME", at)
            self.half = goals
            if not self.fired.containsKey(("HT_STABLE",)):
                self.stable = at + int(self.delay * 1e6)
        if period == "H2":
            for m in self.minutes:
                if minute is not None and minute >= m:
                    out += self._fire(key, f"MINUTE_{m}", at)
            if self.half is not None and goals is not None and goals > self.half:
                out += self._fire(key, "FIRST_H2_GOAL", at)
        if period == "END":
            out += self._fire(key, "FINAL", at)
        self.period = period
        return out

    def store(self) -> None:
        self.state.update((self.period, self.half, self.stable))

    def forget(self) -> None:
        self.fired.clear()
        self.state.clear()


def match_slots(stream: DataFrame, delay: float = 45.0, minutes: tuple[int, ...] = (60, 70, 80, 85, 90), late: str = "0 seconds", idle: float = Ordered.IDLE) -> DataFrame:
    """``stream``: key string, at timestamp, kickoff timestamp, period string (PRE, H1, HT, H2, END), minute int, goals int."""
    rows = stream.withColumns({c: F.unix_micros(c) for c in ("at", "kickoff")})
    return _ordered(rows, MatchSlots(delay, minutes, idle), "key string, slot string, at long", late).withColumn("at", F.timestamp_micros("at"))


class Debounce(Ordered):
    """Suspicions (key, at, suspect) are confirmed when at least ``times`` in a row were seen over at least ``micros``; a row
    without suspicion starts anew. Each run is confirmed once."""

    FIELDS = (("at", "long"), ("suspect", "boolean"))
    COLUMNS = ("key", "at", "seen")

    def __init__(self, times: int, micros: int, idle: float = Ordered.IDLE) -> None:
        super().__init__(idle)
        self.times, self.micros = times, micros

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since long, seen int, done boolean")

    def load(self) -> None:
        self.since, self.seen, self.done = self.run.get() if self.run.exists() else (None, 0, False)

    def step(self, key: str, row: tuple) -> list[tuple]:
        at, suspect = row
        if not suspect:
            self.since, self.seen, self.done = None, 0, False
            return []
        self.since, self.seen = (at if self.since is None else self.since), self.seen + 1
        if self.done or self.seen < self.times or at - self.since < self.micros:
            return []
        self.done = True
        return [(key, at, self.seen)]

    def store(self) -> None:
        if self.since is None:
            self.run.clear()
        else:
            self.run.update((self.since, self.seen, self.done))

    def forget(self) -> None:
        self.run.clear()


def debounced(stream: DataFrame, times: int = 3, seconds: float = 60.0, late: str = "0 seconds", idle: float = Ordered.IDLE) -> DataFrame:
    return _ordered(stream, Debounce(times, int(seconds * 1e6), idle), "key string, at long, seen int", late)
