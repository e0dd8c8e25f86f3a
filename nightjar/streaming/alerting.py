"""ST-10 on a stream: sustained-threshold alerts in event-time order.

Each (rule, series) key buffers its evaluations until the watermark passes
them, then applies them in order, so arrival order does not matter.  A firing
row is emitted for the first evaluation at which the condition has held for
the whole ``hold``, and a resolved row when it turns false or when an expected
evaluation is missing, also if the series falls silent (event-time timeout).
Evaluations that come after the watermark has passed them are rows of their
own (``too_late``), never silently dropped.  A key keeps the unreleased
evaluations and one run; a key without either keeps nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT_SCHEMA = "series string, event string, at timestamp, run_started_at timestamp"
STATE_SCHEMA = ("run_step long, run_ms long, last_step long, last_ms long, fired boolean, "
                "buf_step array<long>, buf_ms array<long>, buf_cond array<boolean>")


class _Run:
    """The current run of true evaluations of one series."""

    def __init__(self, need: int, step_ms: int, run_step=None, run_ms=None, last_step=None, last_ms=None, fired=False):
        self.need, self.step_ms = need, step_ms
        self.run_step, self.run_ms, self.last_step, self.last_ms, self.fired = run_step, run_ms, last_step, last_ms, fired
        self.out: list[tuple] = []

    @property
    def expected_ms(self) -> int | None:
        """When the evaluation after the run's last one is due."""
        return None if self.run_step is None else self.last_ms + self.step_ms

    def end(self, at_ms: int) -> None:
        if self.fired:
            self.out.append(("resolved", at_ms, self.run_ms))
        self.run_step, self.fired = None, False

    def apply(self, step: int, ms: int, cond: bool) -> None:
        if self.run_step is not None and step != self.last_step + 1:
            self.end(self.expected_ms)
        if not cond:
            if self.run_step is not None:
                self.end(ms)
            return
        if self.run_step is None:
            self.run_step, self.run_ms = step, ms
        self.last_step, self.last_ms = step, ms
        if not self.fired and step - self.run_step >= self.need:
            self.out.append(("firing", ms, self.run_ms))
            self.fired = True


def _transition(need: int, step_ms: int):
    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (series,) = key
        buffer: dict[int, tuple[int, bool]] = {}
        run = _Run(need, step_ms)
        if state.exists:
            *held, steps, times, conds = state.get
            run = _Run(need, step_ms, *held)
            buffer = {int(n): (int(ms), bool(c)) for n, ms, c in zip(steps, times, conds)}
        watermark = state.getCurrentWatermarkMs()
        late = []
        if not state.hasTimedOut:
            for pdf in batches:
                pdf = pdf[pdf["ts"].notna()]  # the others only move the watermark
                ms_of = (pdf["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
                for ms, cond in zip(ms_of, pdf["cond"].tolist()):
                    if ms <= watermark:
                        late.append(("too_late", ms, None))
                        continue
                    n, cond = ms // step_ms, cond is not None and bool(cond)
                    seen = buffer.get(n, (ms, True))
                    buffer[n] = (min(ms, seen[0]), cond and seen[1])
        for n in sorted(buffer):
            # a step is complete once the watermark has left it
            if (n + 1) * step_ms - 1 > watermark:
                break
            ms, cond = buffer.pop(n)
            run.apply(n, ms, cond)
        due = None if run.run_step is None else (run.last_step + 2) * step_ms - 1
        if due is not None and due <= watermark and (run.last_step + 1) not in buffer:
            run.end(run.expected_ms)
            due = None
        waiting = [(min(buffer) + 1) * step_ms - 1] if buffer else []
        waiting += [due] if due is not None else []
        if waiting:
            kept = sorted(buffer)
            state.update((run.run_step, run.run_ms, run.last_step, run.last_ms, run.fired, kept,
                          [buffer[n][0] for n in kept], [buffer[n][1] for n in kept]))
            state.setTimeoutTimestamp(max(min(waiting), watermark + 1))
        elif state.exists:
            state.remove()
        rows = pd.DataFrame([(series, *r) for r in late + run.out], columns=["series", "event", "at", "run_started_at"])
        for c in ("at", "run_started_at"):
            rows[c] = pd.to_datetime(rows[c], unit="ms")
        yield rows
    return fn


def sustained_breach_stream(evals: DataFrame, series_cols: Sequence[str], ts_col: str, cond_col: str,
                            hold_seconds: float, step_seconds: float = 15, watermark: str = "1 minute") -> DataFrame:
    """``evals``: a stream of (series…, ts, cond) evaluations, in any order
    within the watermark.  Output (``append``): firing and resolved
    transitions, equal to ``operators.slo.sustained_breach``'s runs, and one
    ``too_late`` row for each evaluation that came after its time had passed.

    Spark drops rows behind the watermark before a stateful operator sees
    them, so the evaluations themselves travel without an event time beside
    rows that have one and nothing else."""
    e = evals.select(F.concat_ws("|", *[F.col(c).cast("string") for c in series_cols]).alias("series"),
                     F.col(ts_col).cast("timestamp").alias("ts"), F.col(cond_col).cast("boolean").alias("cond"))
    moves = F.struct(F.col("ts").alias("clock"), F.lit(None).cast("timestamp").alias("ts"),
                     F.lit(None).cast("boolean").alias("cond"))
    holds = F.struct(F.lit(None).cast("timestamp").alias("clock"), F.col("ts").alias("ts"), F.col("cond").alias("cond"))
    both = e.select("series", F.inline(F.array(moves, holds))).withWatermark("clock", watermark)
    step_ms = int(step_seconds * 1000)
    return both.groupBy("series").applyInPandasWithState(
        _transition(-(-int(hold_seconds * 1000) // step_ms), step_ms), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------
# ST-11 on a stream: notification grouping with event-time timers
# --------------------------------------------------------------------------
NOTIFY_OUT = "alertname string, sent_at timestamp, alerts long, reason string"
NOTIFY_STATE = ("active long, is_open boolean, last_tick long, last_sent long, "
                "buf_ts array<long>, buf_delta array<int>")


def _grouping(group_wait_s: int, group_interval_s: int, repeat_interval_s: int):
    gw, gi, ri = group_wait_s * 1000, group_interval_s * 1000, repeat_interval_s * 1000

    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (name,) = key
        if state.exists:
            active, is_open, last_tick, last_sent, buf_ts, buf_d = state.get
            buf = list(zip([int(x) for x in buf_ts], [int(x) for x in buf_d]))
        else:
            active, is_open, last_tick, last_sent, buf = 0, False, None, None, []
        if not state.hasTimedOut:
            for pdf in batches:
                ms = (pdf["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
                buf += list(zip(ms, pdf["delta"].astype(int).tolist()))
        wm = state.getCurrentWatermarkMs()
        buf.sort(key=lambda e: (e[0], -e[1]))
        out, nxt = [], None

        def apply_until(t: int) -> bool:
            nonlocal active, buf
            changed = False
            while buf and buf[0][0] <= t:
                active += buf[0][1]
                buf = buf[1:]
                changed = True
            return changed

        while True:
            if not is_open:
                if not buf:
                    break
                flush = buf[0][0] + gw
                if flush > wm:
                    nxt = flush
                    break
                apply_until(flush)
                if active <= 0:
                    continue
                out.append((name, flush, active, "initial"))
                is_open, last_tick, last_sent = True, flush, flush
                continue
            target = last_sent + ri if not buf else min(buf[0][0], last_sent + ri)
            k = max(1, -(-(target - last_tick) // gi))
            tick = last_tick + gi * k
            if tick > wm:
                nxt = tick
                break
            changed = apply_until(tick)
            last_tick = tick
            if active <= 0:
                is_open = False
                continue
            if changed:
                out.append((name, tick, active, "update"))
                last_sent = tick
            elif tick - last_sent >= ri:
                out.append((name, tick, active, "repeat"))
                last_sent = tick
        state.update((active, is_open, last_tick, last_sent, [t for t, _ in buf], [d for _, d in buf]))
        if nxt is not None:
            state.setTimeoutTimestamp(max(nxt, wm + 1))
        rows = pd.DataFrame(out, columns=["alertname", "sent_at", "alerts", "reason"])
        rows["sent_at"] = pd.to_datetime(rows["sent_at"], unit="ms")
        yield rows
    return fn


def group_notifications_stream(firings: DataFrame, alertname_col: str, ts_col: str, delta_col: str,
                               watermark: str = "1 minute", group_wait: int = 30, group_interval: int = 300,
                               repeat_interval: int = 14400) -> DataFrame:
    """ST-11 on a stream: ``firings`` carries (alertname, ts, delta) with +1
    when an alert starts firing and −1 when it resolves (the ST-10 stream's
    transitions).  Per alert name the state keeps the active count, the
    notification clock and the events not yet applied; an event-time timer
    wakes the key at its next decision time (first flush after
    ``group_wait``, then the ``group_interval`` grid, repeats after
    ``repeat_interval``), so notifications are emitted once the watermark
    passes them — the same decisions as the batch twin
    ``operators.slo.group_notifications``."""
    e = (firings.select(F.col(alertname_col).cast("string").alias("alertname"),
                        F.col(ts_col).cast("timestamp").alias("ts"), F.col(delta_col).cast("int").alias("delta"))
         .withWatermark("ts", watermark))
    return e.groupBy("alertname").applyInPandasWithState(
        _grouping(group_wait, group_interval, repeat_interval), NOTIFY_OUT, NOTIFY_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)
