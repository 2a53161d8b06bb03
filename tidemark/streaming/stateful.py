"""Commit gates, slot commits and running states on a stream, with keyed state that a processor keeps between triggers.

A key's rows have to come in order, but may be cut into triggers anywhere. A row that isn't later than the last one of its
key counts as late: it changes nothing and isn't returned, so rows that a source sends twice have no effect.

What Spark does for a grouping key (a batch to Python, a state to read and write, a batch back) costs some milliseconds,
far more than its rows. So keys are dealt to groups, and a group keeps the states of its keys in one value.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from .commits import MASKS, next_masks

_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
#: Tasks a core in each trigger of a query with a processor, at most.
TASKS_PER_CORE = 3
#: Columns that the rows get on their way: the group, and whether the key is null. PySpark renames names that begin with "_".
_GROUP, _NONE = "group_of_keys", "key_is_null"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """While a query with a processor starts: its state store has to be RocksDB. The settings before come back.

    Each task of a trigger starts a Python worker, which costs more than its rows, so there are no more of them than
    ``TASKS_PER_CORE`` ask for; a query that is started anew keeps the number of its checkpoint.
    """
    before = {name: spark.conf.get(name, None) for name in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_PARTITIONS, str(min(int(spark.conf.get(_PARTITIONS)), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Fixed value: groups that keys are dealt to. Each trigger rewrites the states of the groups that it touches.
GROUPS = 1024


def _columns(batches: Iterator[pd.DataFrame]) -> dict[str, list]:
    """The columns of a group's rows as lists."""
    columns: dict[str, list] = {}
    for pdf in batches:
        for name in pdf.columns:
            columns.setdefault(name, []).extend(pdf[name].tolist())
    return columns


class _Grouped(StatefulProcessor):
    """Calls ``advance`` for each key of a group that has rows. ``carried`` are the fields of a key's state."""

    def __init__(self, key: str, carried: str, ttl_ms: int | None):
        self.key, self.carried, self.ttl = key, carried, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"held array<struct<key: {self.key_kind}, touched: bigint, {self.carried}>>", ttlDurationMs=self.ttl)

    def load(self, now: int) -> dict:
        """By key, when it was touched and its state; without those whose time to live is over."""
        state = self.held.get()
        each = ((k, touched, tuple(values)) for k, touched, *values in state[0]) if state else ()
        return {k: (touched, values) for k, touched, values in each if self.ttl is None or touched + self.ttl > now}

    def store(self, held: dict) -> None:
        if held:
            self.held.update(([(k, touched, *values) for k, (touched, values) in held.items()],))
        else:
            self.held.clear()

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        """Of pairs of a key and its row."""
        made = {name: [r[name] for _, r in out] for name in out[0][1]}
        return pd.DataFrame({self.key: pd.Series([k for k, _ in out], dtype=object), **made})  # numbers beside None would be floats

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        columns, held, places = _columns(rows), self.load(now), {}
        for i, (k, missing) in enumerate(zip(columns[self.key], columns[_NONE], strict=True)):
            places.setdefault(None if missing or k != k else k, []).append(i)
        out = []
        for k, own in places.items():
            state, made = self.advance(held[k][1] if k in held else None, columns, own)
            if made:
                out += [(k, r) for r in made]
                if state is None:
                    held.pop(k, None)
                else:
                    held[k] = (now, state)
        if out:
            self.store(held)
            yield self.frame(out)

    def advance(self, state: tuple | None, columns: dict[str, list], own: list[int]) -> tuple[tuple | None, list[dict]]:
        """A key's new state (None: it goes) and what it returns for its rows, those at the places ``own``; if that is nothing, its state stays."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Ordered(_Grouped):
    """Calls ``step`` for each row of a key in order. The state is the last order value and the values that ``step`` carries on."""

    def __init__(self, key: str, order: str, carried: str, ttl_ms: int | None):
        super().__init__(key, f"at: double, {carried}", ttl_ms)
        self.order = order

    def rows(self, columns: dict[str, list], own: list[int], after: float | None) -> Iterator[dict]:
        """The rows later than ``after``, in order, the first of each place."""
        order, last = columns[self.order], None
        for i in sorted(own, key=lambda i: (order[i] != order[i], order[i])):
            at = order[i]
            again = last is not None and (at == last or at != at and last != last)
            if not again and (after is None or at > after):
                yield {name: values[i] for name, values in columns.items()}
            last = at

    def advance(self, state, columns, own):
        at, values = (state[0], state[1:]) if state else (None, None)
        out = []
        for r in self.rows(columns, own, at):
            values, made = self.step(values, r)
            at = float(r[self.order])
            out.append({self.order: r[self.order], **made})
        return (at, *(values or ())), out

    def step(self, values: tuple | None, row: dict) -> tuple[tuple, dict]:
        raise NotImplementedError


class _Gate(_Ordered):
    """Words committed so far: the least of what time and stability allow, all eligible at the end, never fewer than before."""

    def __init__(self, key: str, order: str, eligible: str, stable: str, final: str, ttl_ms: int | None):
        super().__init__(key, order, "committed: bigint", ttl_ms)
        self.eligible, self.stable, self.final = eligible, stable, final

    def step(self, values, row):
        before = values[0] if values else 0
        now = row[self.eligible] if row[self.final] else min(row[self.eligible], row[self.stable])
        committed = max(before, int(now)) if values else int(now)
        return (committed,), {"committed": committed, "new": committed - before}


class _Sums(_Ordered):
    """Sum and count after each row, to any order of magnitude: A and then B gives the state of A and B at once."""

    def __init__(self, key: str, order: str, value: str, ttl_ms: int | None):
        super().__init__(key, order, "total: double, n: bigint", ttl_ms)
        self.value = value

    def step(self, values, row):
        total, n = values or (0.0, 0)
        if row[self.value] == row[self.value]:  # null is NaN here
            total, n = total + float(row[self.value]), n + 1
        return (total, n), {"state_sum": total, "state_count": n}


def _kinds(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)


def _run(rows: DataFrame, key: str, processor: _Grouped, out: str, timers: bool = False, groups: int = GROUPS) -> DataFrame:
    kind = rows.schema[key].dataType
    processor.key_kind = kind.simpleString()
    # pandas would turn whole numbers beside a null into floats
    whole = F.coalesce(F.col(key), F.lit(0).cast(kind)) if isinstance(kind, IntegralType) else F.col(key)
    dealt = rows.withColumns({_GROUP: F.pmod(F.xxhash64(key), F.lit(groups)), _NONE: F.col(key).isNull(), key: whole})
    timed = timers or processor.ttl
    return dealt.groupBy(_GROUP).transformWithStateInPandas(processor, StructType.fromDDL(out), "Update", "ProcessingTime" if timed else "None")


def stream_gate(ticks: DataFrame, key: str, order: str, eligible: str, stable: str, final: str, ttl_ms: int | None = None) -> DataFrame:
    """``commits.commit_gate`` on a stream: a row a tick, ``key, order, committed, new``.

    ``ttl_ms``: a key's state goes so long after its last tick (processing time), and its next tick begins anew.
    """
    return _run(ticks, key, _Gate(key, order, eligible, stable, final, ttl_ms), f"{_kinds(ticks, key, order)}, committed long, new long")


def stream_sums(rows: DataFrame, key: str, order: str, value: str, ttl_ms: int | None = None) -> DataFrame:
    """``commits.running_state`` on a stream: ``key, order, state_sum, state_count`` after each row; null values don't count."""
    return _run(rows, key, _Sums(key, order, value, ttl_ms), f"{_kinds(rows, key, order)}, state_sum double, state_count long")


class _Slots(_Grouped):
    """Committed slots of the chunk before and all of the current one; a chunk's rows may come in several triggers."""

    def __init__(self, key: str, chunk: str, slot: str, old_slot: str, committed: str, ttl_ms: int | None):
        super().__init__(key, "chunk: bigint, seen: bigint, before: array<bigint>, slots: array<bigint>, old: array<bigint>, committed: array<boolean>", ttl_ms)
        self.chunk, self.slot, self.old_slot, self.committed = chunk, slot, old_slot, committed

    def _made(self, chunk: int, seen: int, before: set[int], current: dict[int, tuple[int, bool]]) -> dict:
        now = [old for old, committed in current.values() if committed]
        kept = sum(old in before for old in now)
        return {self.chunk: chunk, "seen": seen, "committed": len(now), "new": len(now) - kept, "dropped": len(before) - kept}

    def advance(self, state, columns, own):
        wanted = [columns[c] for c in (self.chunk, self.slot, self.old_slot, self.committed)]
        got = sorted(([c[i] for c in wanted] for i in own), key=lambda r: r[:2])
        chunk, seen = (state[0], state[1]) if state else (None, 0)
        before = set(state[2]) if state else set()
        current = {s: (old, done) for s, old, done in zip(*state[3:], strict=True)} if state else {}
        out, grown = [], False
        for c, s, old, done in got:
            c, s = int(c), int(s)
            if chunk is not None and c < chunk or c == chunk and s in current:
                continue  # late, or sent twice
            if c != chunk:
                if grown:
                    out.append(self._made(chunk, seen, before, current))
                before, current = {s for s, (_, done) in current.items() if done}, {}
            chunk, seen, grown = c, seen + 1, True
            current[s] = (int(old), bool(done))
        if grown:
            out.append(self._made(chunk, seen, before, current))
        return (chunk, seen, list(before), list(current), [v[0] for v in current.values()], [v[1] for v in current.values()]), out


def stream_commits(rows: DataFrame, key: str, chunk: str, slot: str, old_slot: str, committed: str, ttl_ms: int | None = None) -> DataFrame:
    """``commits.new_commits`` on a stream: ``key, chunk, seen, committed, new, dropped``, anew whenever a chunk gets rows.

    The row of the greatest ``seen`` is the one that counts (``resume.KeyedSink`` keeps it). Revised slots are reported as
    dropped by the chunk that revises them; what was returned before isn't taken back.
    """
    out = f"{_kinds(rows, key, chunk)}, seen long, committed long, new long, dropped long"
    return _run(rows, key, _Slots(key, chunk, slot, old_slot, committed, ttl_ms), out)


class _Masks(_Ordered):
    """Masks of chunks whose slots may move; the tokens and committed slots of the last chunk are the state."""

    def __init__(self, key: str, order: str, tokens: str, words: str, candidate: str, token_kind: str, ttl_ms: int | None):
        super().__init__(key, order, f"tokens: array<{token_kind}>, committed: array<int>", ttl_ms)
        self.tokens, self.words, self.candidate = tokens, words, candidate

    def step(self, values, row):
        before = (list(values[0]), list(values[1])) if values else None
        return next_masks(before, *(list(row[c]) for c in (self.tokens, self.words, self.candidate)))


def stream_masks(chunks: DataFrame, key: str, order: str, tokens: str, words: str, candidate: str, ttl_ms: int | None = None) -> DataFrame:
    """``commits.chunk_masks`` on a stream: a row a chunk."""
    kind = chunks.schema[tokens].dataType.elementType.simpleString()
    return _run(chunks, key, _Masks(key, order, tokens, words, candidate, kind, ttl_ms), f"{_kinds(chunks, key, order)}, {MASKS}")


class _Online(_Ordered):
    """A record a tick with the time it took, and a last one when a key has been idle. A group's timer is that of its key idle for longest."""

    def __init__(self, key: str, order: str, value: str, final: str, idle_ms: int, order_kind: str):
        super().__init__(key, order, "total: double, n: bigint", None)
        self.value, self.final, self.idle, self.order_kind = value, final, idle_ms, order_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.due = handle.getValueState("due", "at long")

    def step(self, values, row):
        began = time.perf_counter()
        total, n = values or (0.0, 0)
        total, n = total + float(row[self.value]), n + 1
        kind = "final" if row[self.final] else "tick"
        return (total, n), {"kind": kind, "state_sum": total, "state_count": n, "process_ms": 1000 * (time.perf_counter() - began)}

    def advance(self, state, columns, own):
        state, made = super().advance(state, columns, own)
        return (None if made and made[-1]["kind"] == "final" else state), made

    def store(self, held):
        super().store(held)
        due, before = min((touched for touched, _ in held.values()), default=None), self.due.get()
        if before:
            self.handle.deleteTimer(before[0])
            self.due.clear()
        if due is not None:
            self.handle.registerTimer(due + self.idle)
            self.due.update((due + self.idle,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.load(now)
        over = {k: values for k, (touched, values) in held.items() if touched + self.idle <= now}
        if over:
            self.store({k: v for k, v in held.items() if k not in over})
            flushed = [(k, {self.order: at, "kind": "flush", "state_sum": total, "state_count": n, "process_ms": 0.0}) for k, (at, total, n) in over.items()]
            yield self.frame(flushed).astype({self.order: self.order_kind})


def online(ticks: DataFrame, key: str, order: str, value: str, final: str, idle_ms: int = 60_000) -> DataFrame:
    """The online loop: ``key, order, kind, state_sum, state_count, process_ms``, a row a tick.

    ``kind`` is ``tick``, ``final`` (the state goes), or ``flush``: the state of a key that had no tick for ``idle_ms``,
    which goes too. A tick after that begins anew.
    """
    order_kind = "float64" if ticks.schema[order].dataType.simpleString() in ("double", "float") else "int64"
    loop = _Online(key, order, value, final, idle_ms, order_kind)
    return _run(ticks, key, loop, f"{_kinds(ticks, key, order)}, kind string, state_sum double, state_count long, process_ms double", timers=True)
