"""Tool-call sessions as keyed state of a stream: phases, the single open call, and running totals.

A session's events may come in any order within the watermark's delay. They wait in the session's state until the
watermark has passed them and are then taken in the order of their numbers, so what a session gives doesn't depend on how
its events were dealt over micro-batches. State is a session's own: totals, the phase reached, the open call, the ring of
the newest discoveries, and what waits. With ``idle_ms`` an event so long after the one before begins a new sitting of its
session, and state without an event for so long is dropped.

The stream appends rows of three kinds, of which ``phases``, ``calls`` and ``states`` take the last word: a phase is told
when it begins and again when it ends, a call when it ends, totals whenever they change.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

#: Discoveries that a session remembers, and characters of a call's result.
RING, RESULT = 20, 20
OUT = "session long, kind string, phase int, started long, completed long, tool string, result string, calls long, errors long, successes long, longest long, tools long, discoveries array<long>"
_NAMES = [f.split(" ")[0] for f in OUT.split(", ")]
_WIDE, _TEXT = LongType(), StringType()


def _struct(**kinds: DataType) -> StructType:
    """A schema that the workers can build, which have no session to parse one."""
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_TOTALS = _struct(calls=_WIDE, errors=_WIDE, successes=_WIDE, longest=_WIDE, tools=ArrayType(_TEXT), best=IntegerType(), phase_started=_WIDE, open_seq=_WIDE, open_tool=_TEXT, last_ms=_WIDE)
_EVENT = _struct(seq=_WIDE, ms=_WIDE, tool=_TEXT, status=_TEXT, result=_TEXT)


def rocks_db(spark: SparkSession) -> None:
    """Keep state on the executors' disks, not in their heaps; keyed state needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Reducer(StatefulProcessor):
    """What one session's events come to."""

    def __init__(self, phases: dict[str, int], prefixes: str, other: int, idle_ms: int | None) -> None:
        self.phases, self.prefixes, self.other, self.idle_ms = phases, re.compile(prefixes), other, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.waiting = handle.getListState("waiting", _EVENT)
        self.ring = handle.getListState("ring", _struct(seq=_WIDE))

    def _phase(self, tool: str) -> int | None:
        return self.phases.get(tool) or (self.other if self.prefixes.search(tool) else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r.seq, int(r.ts.timestamp() * 1000) + 1, r.tool, r.status, r.result) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(e[1] for e in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        due, later = [e for e in every if e[1] <= now], [e for e in every if e[1] > now]
        if due:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(e[1] for e in later))
            else:
                self.waiting.clear()
            yield from self._taken(key[0], due)
        elif not every and self.idle_ms and self.totals.exists() and self.totals.get()[9] + self.idle_ms <= now:
            self.totals.clear()
            self.ring.clear()

    def _taken(self, session: int, events: list[tuple]) -> Iterator[Row]:
        t = self.totals.get() if self.totals.exists() else (0, 0, 0, None, [], None, None, None, None, 0)
        calls, errors, successes, longest, tools, best, started, open_seq, open_tool, last = t
        told = calls
        tools, ring = list(tools), [r[0] for r in self.ring.get()] if self.ring.exists() else []

        def row(kind: str, **values: object) -> Row:
            return Row(**{n: values.get(n) for n in _NAMES} | {"session": session, "kind": kind})

        for seq, ms, tool, status, result in events:
            if self.idle_ms and calls and ms - last >= self.idle_ms:  # a new sitting, whether or not the old was closed yet
                if told != calls:
                    yield row("state", calls=calls, errors=errors, successes=successes, longest=longest, tools=len(tools), discoveries=ring)
                calls = errors = successes = longest = told = 0
                best = started = open_seq = open_tool = None
                tools, ring = [], []
            calls, last = calls + 1, max(last, ms)
            errors, successes = errors + (status == "error"), successes + (status == "completed")
            if result is not None:
                longest = max(longest or 0, len(result))
            if tool is not None and tool not in tools:
                tools.append(tool)
            if status == "completed":
                ring = [*ring, seq][-RING:]
            phase = self._phase(tool or "")
            if phase is not None and (best is None or phase > best):
                if best is not None:
                    yield row("phase", phase=best, started=started, completed=seq)
                best, started = phase, seq
                yield row("phase", phase=phase, started=seq)
            if open_seq is None:
                open_seq, open_tool = seq, tool
            else:
                yield row("call", started=open_seq, completed=seq, tool=open_tool, result=None if result is None else result[:RESULT])
                open_seq = open_tool = None
        self.totals.update((calls, errors, successes, longest, tools, best, started, open_seq, open_tool, last))
        self.ring.put([(s,) for s in ring]) if ring else self.ring.clear()
        if self.idle_ms:
            self.handle.registerTimer(last + self.idle_ms)
        yield row("state", calls=calls, errors=errors, successes=successes, longest=longest, tools=len(tools), discoveries=ring)


def reduce_sessions(events: DataFrame, *, phases: dict[str, int], prefixes: str, other: int, late: str, idle_ms: int | None = None) -> DataFrame:
    """Rows of the three kinds from a stream of (session, seq, ts, tool, status, result). ``late`` is how long an event may
    be behind the newest; tools that begin as ``prefixes`` are of phase ``other``."""
    rocks_db(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans the state gets no shipped files
    e = events.select("session", "seq", F.col("ts").cast("timestamp").alias("ts"), "tool", "status", "result").withWatermark("ts", late)
    return e.groupBy("session").transformWithState(Reducer(phases, prefixes, other, idle_ms), OUT, "append", "eventTime")


def phases(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'phase'").groupBy("session", "phase", "started").agg(F.max("completed").alias("completed"))


def calls(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'call'").select("session", "started", F.col("completed").alias("ended"), "tool", "result")


def states(rows: DataFrame) -> DataFrame:
    names = ["calls", "errors", "successes", "longest", "tools", "discoveries"]
    last = rows.where("kind = 'state'").groupBy("session").agg(F.max(F.struct(*names)).alias("s"))  # calls only grow
    return last.select("session", *(f"s.{n}" for n in names))


def run(events: DataFrame, out: str, checkpoint: str, **parameters: object) -> None:
    """Take in what is there, appended as Parquet to ``out``, and end; goes on from ``checkpoint`` when called again."""
    rows = reduce_sessions(events, **parameters)
    q = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
