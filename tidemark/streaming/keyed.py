"""Ledger and scheduler in keyed state with event-time timers.

Rules follow event time alone: before a row is judged, all that fell due up to its time is done, and a
timer does the same where no row comes. So the outcome does not depend on how a stream is cut into
batches, as long as rows arrive within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in RocksDB.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY_US = 86_400_000_000


def _sorted(rows: Iterator[pd.DataFrame], *order: str) -> list[tuple]:
    """A key's rows of one batch in order, as named tuples; a batch is as large as the trigger allows."""
    parts = [r for r in rows if len(r)]
    return list(pd.concat(parts).sort_values(list(order)).itertuples(index=False)) if parts else []


class _Timed(StatefulProcessor):
    """One timer a key, moved to whatever is due next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _wake(self, at_us: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_us is not None:
            self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


LEDGER = "run_id long, event_id long, call_id string, outcome string, charged long"
_CALL = "tool string, fingerprint string, reserved long, status string, actual long"


class Ledger(_Timed):
    """Admission and settlement of calls of a run.

    ADMIT: a known call id with the same tool, fingerprint and price is REPLAYED, with another one a
    CONFLICT; else refused by DEADLINE, CALLS, TOOL_CAP or MONEY, in this order, or ADMITTED. SETTLE:
    an UNKNOWN_CALL, SETTLED once, SAME when repeated, CONFLICT when repeated differently. A settled
    call charges what it cost, or its price where that is not known; open ones charge their price. At
    the deadline, counted from the run's first row, open calls are EXPIRED and stay charged. State is
    one row a call admitted, so most_calls at most, and one of totals.
    """

    def __init__(self, most_calls: int, most_per_tool: int, most_money: int, lasts_us: int) -> None:
        self.most_calls, self.most_per_tool, self.most_money, self.lasts_us = most_calls, most_per_tool, most_money, lasts_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.calls = handle.getMapState("calls", "call_id string", _CALL)
        self.total = handle.getValueState("total", "deadline_us long, charged long, expired boolean")

    def _expire(self, run_id: int, deadline: int, charged: int) -> list[tuple]:
        out = []
        for (call_id,), call in sorted((k, v) for k, v in self.calls.iterator() if v[3] == "OPEN"):
            self.calls.updateValue((call_id,), (*call[:3], "UNKNOWN", None))
            out.append((run_id, None, call_id, "EXPIRED", charged))
        self.total.update((deadline, charged, True))
        self._wake(None)
        return out

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out, known = [], self.total.get() if self.total.exists() else None
        for r in _sorted(rows, "us", "event_id"):
            if known is None:
                known = (int(r.us) + self.lasts_us, 0, False)
                self._wake(known[0])
            deadline, charged, expired = known
            if r.us >= deadline and not expired:
                out += self._expire(key[0], deadline, charged)
                expired = True
            call = self.calls.getValue((r.call_id,)) if self.calls.containsKey((r.call_id,)) else None
            if r.op == "ADMIT":
                outcome = self._admit(r, call, deadline, charged)
                if outcome == "ADMITTED":
                    charged += int(r.amount)
                    self.calls.updateValue((r.call_id,), (r.tool, r.fingerprint, int(r.amount), "OPEN", None))
            else:
                status, actual = ("SUCCEEDED", int(r.amount)) if r.op == "SETTLE" else ("FAILED", None)
                if call is None:
                    outcome = "UNKNOWN_CALL"
                elif call[3] == "OPEN":
                    outcome = "SETTLED"
                    charged += (call[2] if actual is None else actual) - call[2]
                    self.calls.updateValue((r.call_id,), (*call[:3], status, actual))
                else:
                    outcome = "SAME" if (call[3], call[4]) == (status, actual) else "CONFLICT"
            out.append((key[0], int(r.event_id), r.call_id, outcome, charged))
            known = (deadline, charged, expired)
        if known is not None:
            self.total.update(known)
        yield pd.DataFrame(out, columns=["run_id", "event_id", "call_id", "outcome", "charged"]).astype({"event_id": "Int64"})

    def _admit(self, r, call, deadline: int, charged: int) -> str:
        if call is not None:
            return "REPLAYED" if call[:3] == (r.tool, r.fingerprint, int(r.amount)) else "CONFLICT"
        if r.us >= deadline:
            return "DEADLINE"
        tools = [v[0] for v in self.calls.values()]
        if len(tools) >= self.most_calls:
            return "CALLS"
        if tools.count(r.tool) >= self.most_per_tool:
            return "TOOL_CAP"
        return "MONEY" if charged + int(r.amount) > self.most_money else "ADMITTED"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        deadline, charged, expired = self.total.get()
        out = [] if expired else self._expire(key[0], deadline, charged)
        yield pd.DataFrame(out, columns=["run_id", "event_id", "call_id", "outcome", "charged"]).astype({"event_id": "Int64"})


def ledger(commands: DataFrame, most_calls: int, most_per_tool: int, most_money: int, lasts_us: int) -> DataFrame:
    """The outcome of each of commands(run_id, event_id, ts with a watermark, op: ADMIT, SETTLE or FAIL, call_id, tool, fingerprint, amount), and an EXPIRED row for each call that the deadline finds open."""
    shaped = commands.select("run_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "op", "call_id", "tool", "fingerprint", "amount")
    return shaped.groupBy("run_id").transformWithStateInPandas(Ledger(most_calls, most_per_tool, most_money, lasts_us), LEDGER, "Append", "EventTime")


SCHEDULE = "schedule_id long, due_us long, event string, run_key string, at_us long"


def run_key(schedule_id: int, due_us: int) -> str:
    """One run a schedule and due time, however often it is asked for."""
    return sha256(f"{schedule_id}|{due_us}".encode()).hexdigest()[:32]


class Scheduler(_Timed):
    """Daily runs of a schedule, each under a lease.

    A schedule begins with its first row, at a minute of the day. When it is due, a run is FIRED under
    its key and the cursor moves on, whatever becomes of the run. The first row DONE or BROKEN within
    the lease ends it as SUCCEEDED or FAILED; without one the lease runs out and the run is
    RETRY_WAITING. The lease is shorter than a day, so one run is open at most; state is one row.
    """

    def __init__(self, lease_us: int) -> None:
        if not 0 < lease_us < DAY_US:
            raise ValueError("a lease is shorter than a day")
        self.lease_us = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("cursor", "next_us long, open_us long")

    def _advance(self, key: int, next_us: int, open_us: int | None, now_us: int) -> tuple[int, int | None, list[tuple]]:
        """All that falls due up to now, in order."""
        out = []
        while True:
            ends = None if open_us is None else open_us + self.lease_us
            if ends is not None and ends <= min(now_us, next_us):
                out.append((key, open_us, "RETRY_WAITING", run_key(key, open_us), ends))
                open_us = None
            elif next_us <= now_us:
                out.append((key, next_us, "FIRED", run_key(key, next_us), next_us))
                next_us, open_us = next_us + DAY_US, next_us
            else:
                return next_us, open_us, out

    def _rest(self, next_us: int, open_us: int | None) -> None:
        self.state.update((next_us, open_us))
        self._wake(next_us if open_us is None else min(next_us, open_us + self.lease_us))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["schedule_id", "due_us", "event", "run_key", "at_us"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        next_us, open_us = self.state.get() if self.state.exists() else (None, None)
        for r in _sorted(rows, "us", "event_id"):
            us = int(r.us)
            if next_us is None:
                next_us = us - us % DAY_US + int(r.minute) * 60_000_000
                next_us += DAY_US if next_us <= us else 0
            next_us, open_us, fell = self._advance(key[0], next_us, open_us, us)
            out += fell
            if open_us is not None and r.signal in ("DONE", "BROKEN"):
                out.append((key[0], open_us, "SUCCEEDED" if r.signal == "DONE" else "FAILED", run_key(key[0], open_us), us))
                open_us = None
        if next_us is not None:
            self._rest(next_us, open_us)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        next_us, open_us = self.state.get()
        next_us, open_us, out = self._advance(key[0], next_us, open_us, timerValues.getCurrentWatermarkInMs() * 1000)
        self._rest(next_us, open_us)
        yield self._frame(out)


def scheduler(signals: DataFrame, lease_us: int) -> DataFrame:
    """What happens to the schedules of signals(schedule_id, event_id, ts with a watermark, minute of the day, signal: DONE, BROKEN or anything else)."""
    shaped = signals.select("schedule_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "minute", "signal")
    return shaped.groupBy("schedule_id").transformWithStateInPandas(Scheduler(lease_us), SCHEDULE, "Append", "EventTime")
