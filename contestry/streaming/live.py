"""The live state of bouts from a stream of passes: one row a bout that merges what each pass brings, a seal, and a series of samples.

A pass (bout_id, ts, state, status, period, clock, stats_a, stats_b, wants_a, wants_b) tells one bout at one time; stats are NULL for a
side that wasn't fetched. Rules, for a bout's passes in order of ts:

- A cancelled bout's live row goes, and its series too, unless it is only suspended.
- Passes that are neither in progress nor over do nothing.
- A sealed row refuses writers for two hours after its last write; then one correction is taken, which counts as a write.
- 'post' is never left. Each side's statistics stay until new ones of that side come.
- A row is sealed when, over, every side that can be fetched came in this very pass.
- A sample is added where there are statistics, the first period has begun, and it differs from the last one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contestry.functions.scalar import is_cancelled, is_suspended

RESEAL_AFTER = pd.Timedelta(hours=2)
PASS = ("ts", "state", "status", "period", "clock", "stats_a", "stats_b", "wants_a", "wants_b")
ROWS = "bout_id bigint, ts timestamp, kind string, state string, period int, clock string, stats_a string, stats_b string, is_final boolean"
#: The live row (state, period, clock, both statistics, seal, last write in microseconds) and the last sample.
STATE = "alive boolean, state string, period int, clock string, stats_a string, stats_b string, is_final boolean, written bigint, sample string"
NOTHING = (False, None, None, None, None, None, False, 0, None)


def apply_pass(now: tuple, p: dict) -> tuple[tuple, list[str]]:
    """The state after a pass, and the kinds of rows that it gives: drop, drop_series, write, sample."""
    alive, state, _, _, a, b, final, written, sample = now
    at = p["ts"].value // 1000
    if p["cancelled"]:
        return (*NOTHING[:-1], sample if p["suspended"] else None), ["drop"] if p["suspended"] else ["drop", "drop_series"]
    if p["state"] not in ("in", "post") or (alive and final and at - written <= RESEAL_AFTER.value // 1000):
        return now, []
    fresh = [p[f"stats_{s}"] is not None for s in "ab" if p[f"wants_{s}"]]
    state = "post" if state == "post" else p["state"]
    a, b = (p["stats_a"] if p["stats_a"] is not None else a), (p["stats_b"] if p["stats_b"] is not None else b)
    final = bool(final or (p["state"] == "post" and fresh and all(fresh)))
    seen = repr((state, p["period"], p["clock"], a, b))
    adds = (a is not None or b is not None) and (p["period"] or 0) >= 1 and seen != sample
    return (True, state, p["period"], p["clock"], a, b, final, at, seen if adds else sample), ["write", "sample"] if adds else ["write"]


def live_rows(passes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row for each write, sample and drop. State is one live row and one sample a bout; it ends ttl_ms after the bout's last pass.

    Passes that do nothing are kept off the state by a filter. A micro-batch's passes of one bout are taken by ts.
    """
    wanted = passes.withColumns({"cancelled": is_cancelled(F.col("status")), "suspended": is_suspended(F.col("status"))}).filter(F.col("cancelled") | F.col("state").isin("in", "post"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else NOTHING
        rows = pd.concat(list(batches)).sort_values(["ts", "place"], kind="stable")  # one bout's passes of one micro-batch
        out = []
        for p in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            p["ts"], p["period"] = pd.Timestamp(p["ts"]), None if p["period"] is None else int(p["period"])
            now, kinds = apply_pass(now, p)
            out += [(key[0], p["ts"], k, *now[1:7]) for k in kinds]
        held.update(now)
        if ttl_ms is not None:
            held.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"period": "Int32"})

    return wanted.groupBy("bout_id").applyInPandasWithState(step, ROWS, STATE, "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """The live row of each bout after all rows: none for a bout that was dropped last."""
    order = F.struct("ts", (F.col("kind") != "write").cast("int"))
    last = rows.filter(F.col("kind").isin("write", "drop")).groupBy("bout_id").agg(F.max_by(F.struct("kind", "state", "period", "clock", "stats_a", "stats_b", "is_final", "ts"), order).alias("r"))
    return last.filter("r.kind = 'write'").select("bout_id", "r.state", "r.period", "r.clock", "r.stats_a", "r.stats_b", "r.is_final", F.col("r.ts").alias("updated_at"))


def series(rows: DataFrame) -> DataFrame:
    """The samples that stay: those behind the last drop of their bout's series."""
    dropped = rows.filter("kind = 'drop_series'").groupBy("bout_id").agg(F.max("ts").alias("gone_"))
    at = rows.filter("kind = 'sample'").join(dropped, "bout_id", "left").filter(F.col("gone_").isNull() | (F.col("ts") > F.col("gone_")))
    return at.select("bout_id", "ts", "state", "period", "clock", "stats_a", "stats_b")


class Heartbeat(StreamingQueryListener):
    """Calls beat at a query's progress, once in `seconds` at most; a beat that fails is counted and stops nothing."""

    def __init__(self, beat: Callable[[str, float], None], seconds: float = 60, clock: Callable[[], float] = time.monotonic) -> None:
        self.beat, self.seconds, self.clock = beat, seconds, clock
        self.last: float | None = None
        self.failed = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tick(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tick(str(event.progress.id))

    def tick(self, query: str) -> None:
        now = self.clock()
        if self.last is None or now - self.last >= self.seconds:
            self.last = now
            try:
                self.beat(query, now)
            except Exception:  # noqa: BLE001
                self.failed += 1


def run_bounded(start: Callable, seconds: float, clock: Callable[[], float] = time.monotonic, pause: float = 1.0) -> int:
    """Keeps a streaming query running until the time is over and returns how often it failed; a failed one is started again.

    start: gives a started query, which goes on from its checkpoint.
    """
    end, failures = clock() + seconds, 0
    while (left := end - clock()) > 0:
        query = start()
        try:
            if not query.awaitTermination(left):
                query.stop()
            elif query.exception() is None:
                return failures
        except Exception:  # noqa: BLE001
            failures += 1
            time.sleep(min(pause, max(0.0, end - clock())))
    return failures
