"""Streaming operators with keyed state of their own: sequences of one sender and thresholds that feedback moves.

Each is a processor for `transformWithStateInPandas` over event time. State is kept per key in a RocksDB store
(`keyed_state` names it in the session), is checkpointed with the query's offsets, and comes back after a restart as it was. Rows may come
out of order up to the watermark's delay; rows later than that are dropped by Spark before they reach a processor. What must
wait for rows that may still come waits for an event-time timer; one timer a key is enough, at the earliest thing it waits for. Rows
that nothing can refer to any more are dropped when the watermark passes them, so state is bounded by a key's rows in one span.

Each yields what its batch twin yields over all rows that came in time: `patterns.rising_sequence`,
`patterns.layering_sequence`, `cases.threshold_fold`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.cases import THRESHOLDS, threshold_steps

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: Rows in one entry of the state, and rows that a processor hands on at a time.
PACK = 10_000


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, which keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Keyed(StatefulProcessor):
    """A list of rows that begin with their time in microseconds, and one timer. An entry of the list holds the columns of many rows as arrays,
    for each entry is pickled by itself, which would take most of the time if it were one row."""

    #: Columns of the state, each an array, and those of what comes out.
    state, out = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.state)

    def close(self) -> None:
        pass

    def held(self) -> list[tuple]:
        return sorted(row for pack in self.rows.get() for row in zip(*pack, strict=True))

    def packs(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[k : k + PACK], strict=True))) for k in range(0, len(rows), PACK)]

    def add(self, rows: list[tuple]) -> None:
        self.rows.appendList(self.packs(rows))

    def hold(self, rows: list[tuple]) -> None:
        if rows:
            self.rows.put(self.packs(rows))
        else:
            self.rows.clear()

    def came(self, frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
        return [row for frame in frames for row in zip(*(frame[c].tolist() for c in columns), strict=True)]

    def frames(self, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while chunk := list(islice(found, PACK)):
            yield pd.DataFrame(chunk, columns=self.out)

    def wait_until(self, us: int | None, instead_of: int | None = None) -> None:
        """The one timer: the first millisecond not before `us`. An expired timer is gone by itself; another one is named, since each look into the state
        is a call of its own, which most of a key's time goes into."""
        if instead_of is not None:
            self.handle.deleteTimer(-(-instead_of // 1000))
        if us is not None:
            self.handle.registerTimer(-(-us // 1000))


class RisingSequence(_Keyed):
    """Small, then medium, then large amounts within a span. A triple is complete when the last of its three rows comes, in whichever order."""

    state, out = "us array<long>, leg array<int>, id array<string>", ("sender_id", "t1", "t2", "t3")

    def __init__(self, span_us: int):
        self.span = span_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.held()
        new = sorted(self.came(rows, "us", "leg", "id"))
        self.add(new)
        if not old:
            self.wait_until(new[0][0] + self.span)
        yield from self.frames((*key, *t) for t in self.triples(old, new))

    def triples(self, old: list[tuple], new: list[tuple]) -> Iterator[tuple]:
        """Those with a row of `new`: a new row is where the triple's first new leg stands, so that none comes twice."""
        legs = {(fresh, leg): [r for r in rows if r[1] == leg] for fresh, rows in ((False, old), (True, new)) for leg in range(3)}
        times = {k: [r[0] for r in rows] for k, rows in legs.items()}
        for pick in ((x, y, z) for x in (False, True) for y in (False, True) for z in (False, True) if x or y or z):
            first, middle, last = (legs[fresh, leg] for leg, fresh in enumerate(pick))
            first_us, last_us = times[pick[0], 0], times[pick[2], 2]
            if not first or not last:
                continue
            for us, _, b in middle:
                smaller = first[bisect_left(first_us, us - self.span) : bisect_left(first_us, us)]
                for a_us, _, a in smaller:
                    for _, _, c in last[bisect_right(last_us, us) : bisect_right(last_us, a_us + self.span)]:
                        yield a, b, c

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        left = [r for r in self.held() if r[0] + self.span > passed]  # a row that is not late comes after the watermark
        self.hold(left)
        self.wait_until(left[0][0] + self.span if left else None)
        yield from ()


class LayeringSequence(_Keyed):
    """A deposit, transfers, then a withdrawal within a span. A withdrawal is judged when no row before it can come any more."""

    state, out = "us array<long>, kind array<int>, id array<string>", ("sender_id", "transaction_id", "n_transfers")
    DEPOSIT, TRANSFER, WITHDRAWAL = range(3)

    def __init__(self, span_us: int, least: int):
        self.span, self.least = span_us, least

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self.came(rows, "us", "kind", "id")
        old, until = self.next(self.held()), self.next(new)
        self.add(new)
        if old is None or until < old:
            self.wait_until(until, instead_of=old)
        yield from ()

    def next(self, rows: list[tuple]) -> int | None:
        """The first withdrawal, or the first row to be out of every span. The timer always stands there."""
        return min((us if kind == self.WITHDRAWAL else us + self.span for us, kind, _ in rows), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self.held()
        deposits, transfers = ([us for us, kind, _ in rows if kind == k] for k in (self.DEPOSIT, self.TRANSFER))
        found = []
        for us, kind, i in rows:
            if kind == self.WITHDRAWAL and us <= passed:
                first = bisect_left(deposits, us - self.span)
                if first < len(deposits) and deposits[first] < us:
                    n = bisect_left(transfers, us) - bisect_right(transfers, deposits[first])
                    if n >= self.least:
                        found.append((*key, i, n))
        left = [r for r in rows if (r[0] > passed if r[1] == self.WITHDRAWAL else r[0] + self.span >= passed)]
        self.hold(left)
        self.wait_until(self.next(left))
        yield from self.frames(iter(found))


class FeedbackThresholds(_Keyed):
    """Thresholds that each row of feedback moves, in the order of event time. Rows wait until none before them can come any more."""

    state = "us array<long>, place array<long>, " + ", ".join(f"{n} array<int>" for n in THRESHOLDS)
    out = ("segment", "place", *THRESHOLDS)

    def __init__(self, start: dict[str, float]):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("thresholds", ", ".join(f"{n} double" for n in THRESHOLDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self.came(rows, "us", "place", *THRESHOLDS)
        self.add(new)
        waiting = list(self.handle.listTimers())
        first = min(new)[0]
        if not waiting or first <= waiting[0] * 1000:
            self.wait_until(first, instead_of=waiting[0] * 1000 if waiting else None)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self.held()
        ready, left = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        at = dict(zip(THRESHOLDS, self.now.get(), strict=True)) if self.now.exists() else dict(self.start)
        found = []
        for _, place, *times in ready:
            for name, n in zip(THRESHOLDS, times, strict=True):
                at[name] = moved(at[name], name, n)
            found.append((*key, place, *at.values()))
        self.now.update(tuple(at.values()))
        self.hold(left)
        self.wait_until(left[0][0] if left else None)
        yield from self.frames(iter(found))


def moved(value: float, name: str, times: int) -> float:
    """A threshold after so many steps up (or down), each kept below its cap (above its floor)."""
    size, floor, cap = THRESHOLDS[name]
    for _ in range(abs(times)):
        value = min(value + size, cap) if times > 0 else max(value - size, floor)
    return value


def rising_sequence(txns: DataFrame, small: float = 5_000, large: float = 15_000, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """S4 as a stream: sender_id, t1, t2, t3. Triples come as soon as they are whole."""
    leg = F.when(F.col("amount") < small, 0).when(F.col("amount") <= large, 1).otherwise(2)
    t = txns.where("amount IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    t = t.select("sender_id", "ts", F.unix_micros("ts").alias("us"), leg.alias("leg"), F.col("transaction_id").cast("string").alias("id"))
    kind = dict(txns.dtypes)["sender_id"]
    return t.groupBy("sender_id").transformWithStateInPandas(RisingSequence(hours * HOUR_US), f"sender_id {kind}, t1 string, t2 string, t3 string", "Append", "EventTime")


def layering_sequence(txns: DataFrame, deposits=("cash_deposit",), transfers=("wire_transfer", "ach"), withdrawals=("cash_withdrawal",), least: int = 3, days: int = 7, late: str = "1 hour") -> DataFrame:
    """S5 as a stream: sender_id, transaction_id, n_transfers. A withdrawal comes out when the watermark passes it."""
    named = F.col("transaction_type")
    kind = F.when(named.isin(*deposits), 0).when(named.isin(*transfers), 1).when(named.isin(*withdrawals), 2)
    t = txns.where("ts IS NOT NULL").withWatermark("ts", late)
    t = t.select("sender_id", "ts", F.unix_micros("ts").alias("us"), kind.alias("kind"), F.col("transaction_id").cast("string").alias("id")).where("kind IS NOT NULL")
    key = dict(txns.dtypes)["sender_id"]
    return t.groupBy("sender_id").transformWithStateInPandas(LayeringSequence(days * DAY_US, least), f"sender_id {key}, transaction_id string, n_transfers long", "Append", "EventTime")


def feedback_thresholds(feedback: DataFrame, start: dict[str, float], late: str = "1 hour") -> DataFrame:
    """Feedback: segment, ts, place (tells rows of one time apart, and names the row), class, patterns.
    Each row with its segment's thresholds after it. A segment is one fold and so one task; segments are independent."""
    t = feedback.where("ts IS NOT NULL").withWatermark("ts", late).withColumns(threshold_steps())
    t = t.select("segment", "ts", F.unix_micros("ts").alias("us"), F.col("place").cast("long").alias("place"), *(F.col(n).cast("int").alias(n) for n in THRESHOLDS))
    kind = dict(feedback.dtypes)["segment"]
    return t.groupBy("segment").transformWithStateInPandas(FeedbackThresholds(start), f"segment {kind}, place long, " + ", ".join(f"{n} double" for n in THRESHOLDS), "Append", "EventTime")
