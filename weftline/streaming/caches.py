"""Caches over requests: what a bounded or expiring store of results would have held, on tables and on streams."""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and lists of state need; set it on the session that runs the streams of this module.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
POLICIES = ("used", "added")
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


@dataclass
class Held:
    """A scope's entries, the one that goes first in front: at most most of them, each for ttl seconds from when it was
    added (a number of microseconds). policy: whether a hit makes an entry the last to go (used), or only being added does (added)."""

    most: int | None
    ttl: float | None
    policy: str = "used"
    entries: OrderedDict = field(default_factory=OrderedDict)

    def old(self, added: int | None, now: int | None) -> bool:
        return self.ttl is not None and now is not None and added is not None and now - added >= self.ttl * 1e6

    def asked(self, key: object, now: int | None) -> bool:
        """Whether the key is there; it is added if not. A request without a time finds entries of any age."""
        if key in self.entries and not self.old(self.entries[key], now):
            if self.policy == "used":
                self.entries.move_to_end(key)
            return True
        self.entries.pop(key, None)
        self.entries[key] = now
        if self.most is not None and len(self.entries) > self.most:
            self.entries.popitem(last=False)
        return False

    def expired(self, now: int) -> list:
        """Takes out the entries that have outlived their time."""
        gone = [k for k, added in self.entries.items() if self.old(added, now)]
        for k in gone:
            del self.entries[k]
        return gone


def _micros(t: dt.datetime | None) -> int | None:
    """Microseconds since 1970; a time without a zone is the machine's, as Spark hands it over."""
    return None if t is None else (t.astimezone(dt.UTC) - EPOCH) // dt.timedelta(microseconds=1)


def _checked(most: int | None, ttl: float | None, policy: str) -> None:
    if policy not in POLICIES or (most is not None and most < 1) or (ttl is not None and ttl <= 0):
        raise ValueError("policy is used or added, most at least 1, ttl above 0")


def requests(events: DataFrame, scope: str, key: str, time: str, most: int | None = None, ttl: float | None = None, policy: str = "used", tie: str | None = None) -> DataFrame:
    """events with hit: whether a cache of their scope would have held their key, taking the requests by time, then tie.

    The cache holds at most most keys of a scope, each for ttl seconds from when it was added (a hit doesn't prolong
    that). When it is full, the key goes that was least recently used, or added. Null keys and scopes are like any
    others; requests without a time come first. Rows pass through as they are; a column hit is replaced.

    One shuffle by scope; a scope streams through its task in order, which holds most keys of one scope."""
    _checked(most, ttl, policy)
    kept = [c for c in events.columns if c.lower() != "hit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = object(), None
        for b in batches:
            hits = []
            for s, k, t in zip(b[scope].to_pylist(), b[key].to_pylist(), b[time].cast(pa.int64()).to_pylist(), strict=True):
                if held is None or s != at:  # scopes come one after the other
                    at, held = s, Held(most, ttl, policy)
                hits.append(held.asked(k, t))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.bool_())], names=[*b.schema.names, "hit"])

    rows = events.select(*(f"`{c}`" for c in kept)).repartition(scope).sortWithinPartitions(scope, time, *([tie] if tie else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, hit boolean")


def _in_order(rows: Iterator[Row], time: str) -> list[tuple[int | None, Row]]:
    """Rows by their times, those without one first."""
    return sorted(((_micros(r[time]), r) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))


class _Requests(StatefulProcessor):
    """Keeps a scope's entries as map state, in order by a number; timers take out what has expired."""

    def __init__(self, kind: str, key: str, time: str, most: int | None, ttl: float | None, policy: str):
        self.kind, self.key, self.time, self.most, self.ttl, self.policy = kind, key, time, most, ttl, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("entries", f"key {self.kind}, none boolean", "added long, place long")

    def _load(self) -> Held:
        entries = sorted(self.state.iterator(), key=lambda e: e[1][1])
        return Held(self.most, self.ttl, self.policy, OrderedDict((None if k[1] else k[0], v[0]) for k, v in entries))

    def _save(self, before: dict, held: Held) -> None:
        """Writes what has changed; an entry's place is its order, which grows only."""
        for k in before.keys() - held.entries.keys():
            self.state.removeKey((k, k is None))
        for place, (k, added) in enumerate(held.entries.items()):
            if before.get(k) != (added, place):
                self.state.updateValue((k, k is None), (added, place))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._load()
        before = {k: (v, n) for n, (k, v) in enumerate(held.entries.items())}
        out, timed = [], set()
        for now, r in _in_order(rows, self.time):
            hit = held.asked(r[self.key], now)
            if not hit and now is not None and self.ttl is not None:
                timed.add(now + self.ttl * 1e6)
            out.append(Row(**r.asDict(), hit=hit))
        self._save(before, held)
        for t in timed:
            self.handle.registerTimer(int(t / 1000) + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._load()
        before = {k: (v, n) for n, (k, v) in enumerate(held.entries.items())}
        if held.expired(expiredTimerInfo.getExpiryTimeInMs() * 1000):
            self._save(before, held)
        return iter(())

    def close(self) -> None:
        pass


def requests_stream(events: DataFrame, scope: str, key: str, time: str, most: int | None = None, ttl: float | None = None, policy: str = "used", watermark: str = "1 minute") -> DataFrame:
    """As requests, over a stream; requests are taken batch by batch, and by time in each. State is bounded: by most keys
    of a scope, and by ttl, as timers delete entries once the watermark has passed the end of their time. The session must
    run with STATE_STORE."""
    _checked(most, ttl, policy)
    rows = events.drop("hit").withWatermark(time, watermark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    run = _Requests(events.schema[key].dataType.simpleString(), key, time, most, ttl, policy)
    return rows.groupBy(scope).transformWithState(run, f"{fields}, hit boolean", "append", "eventTime")


class _Limited(StatefulProcessor):
    """Holds the time of the event of a key that was let through last, until no event can depend on it any more."""

    def __init__(self, time: str, interval: float):
        self.time, self.interval = time, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for t, r in _in_order(rows, self.time):
            if t is None or last is None or t - last >= self.interval * 1e6:
                out.append(r)
                last = t if t is not None else last
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(int(last / 1000 + self.interval * 1000) + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[0] / 1000 + self.interval * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, time: str, interval: float, watermark: str = "1 minute") -> DataFrame:
    """Events of each key that come at least interval seconds after the last one let through, over a stream. A key's state
    ends once the watermark is interval seconds past it. The session must run with STATE_STORE."""
    rows = events.withWatermark(time, watermark)
    return rows.groupBy(key).transformWithState(_Limited(time, interval), rows.schema, "append", "eventTime")


def misses(found: DataFrame) -> DataFrame:
    """The requests that had to be answered anew."""
    return found.where(~F.col("hit")).drop("hit")
