"""Live passes taken in the order of their own times, whatever the order and the batches they arrive in.

A pass waits in its bout's list state until the watermark is past its time. Then everything that is due happens in order of
time: passes, the request to read a sealed bout once more two hours after its last write, and the end of a live row that
nobody wrote for TTL_HOURS. The live row is a value state, both sides' statistics a map state; timers are of event time, so a
replay in one batch or in many gives the same rows, and a pass that is later than the watermark allows is dropped by Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contestry.functions.scalar import is_cancelled, is_suspended
from contestry.sources.staged import new_path
from contestry.streaming.live import NOTHING, RESEAL_AFTER, ROWS, apply_pass

TTL_HOURS = 48
DELAY = "10 minutes"
HOUR = 3_600_000
PASSES = "bout_id bigint, ts timestamp, place bigint, state string, status string, period int, clock string, stats_a string, stats_b string, wants_a boolean, wants_b boolean"
WAITING = "ts bigint, place bigint, state string, period int, clock string, stats_a string, stats_b string, wants_a boolean, wants_b boolean, cancelled boolean, suspended boolean"
ROW = "alive boolean, state string, period int, clock string, is_final boolean, written bigint, sample string, asked boolean"
NAMES = [c.split()[0] for c in WAITING.split(", ")]
OUT = [c.split()[0] for c in ROWS.split(", ")]


class LivePasses(StatefulProcessor):
    """Rows as of live.live_rows(), and of the kinds reseal_due (a sealed row may be read again) and expired (its row is gone)."""

    def __init__(self, ttl_hours: int = TTL_HOURS) -> None:
        self.ttl = ttl_hours * HOUR
        self.reseal = int(RESEAL_AFTER.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", ROW)
        self.stats = handle.getMapState("stats", "side string", "text string")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            at = (part["ts"].astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[part["ts"].dt.unit]).tolist()
            rest = part[NAMES[1:]].astype(object).where(part[NAMES[1:]].notna(), None).itertuples(index=False, name=None)
            self.waiting.appendList([(t, int(p), s, None if n is None else int(n), *more) for t, (p, s, n, *more) in zip(at, rest, strict=True)])
            self.handle.registerTimer(min(at))  # a timer for the next pass that waits is enough
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [r for r in held if r[0] <= now]
        heapq.heapify(due)
        state, asked = self.read()
        out = []
        while True:
            deadline = self.deadline(state, asked)
            if due and (deadline is None or due[0][0] <= deadline[0]):  # of equals, passes go first
                p = dict(zip(NAMES, heapq.heappop(due), strict=True))
                at = pd.Timestamp(p["ts"], unit="ms")
                state, kinds = apply_pass(state, p | {"ts": at})
                asked = asked and "write" not in kinds and state[0]
                out += [(key[0], at, k, *state[1:7]) for k in kinds]
            elif deadline is not None and deadline[0] <= now:
                at, kind = deadline
                out.append((key[0], pd.Timestamp(at, unit="ms"), kind, *state[1:7]))
                state, asked = (NOTHING, False) if kind == "expired" else (state, True)
            else:
                break
        later = [r for r in held if r[0] > now]
        self.write(state, asked, later, changed=len(later) < len(held))
        if later:
            self.handle.registerTimer(min(r[0] for r in later))
        if deadline is not None and deadline[0] > now:
            self.handle.registerTimer(deadline[0])
        if out:
            yield pd.DataFrame(out, columns=OUT).astype({"period": "Int32"})

    def deadline(self, state: tuple, asked: bool) -> tuple[int, str] | None:
        if not state[0]:
            return None
        written = state[7] // 1000
        return (written + self.reseal, "reseal_due") if state[6] and not asked else (written + self.ttl, "expired")

    def read(self) -> tuple[tuple, bool]:
        if not self.row.exists():
            return NOTHING, False
        alive, state, period, clock, final, written, sample, asked = self.row.get()
        sides = {k[0]: v[0] for k, v in self.stats.iterator()}
        return (alive, state, period, clock, sides.get("a"), sides.get("b"), final, written, sample), asked

    def write(self, state: tuple, asked: bool, later: list[tuple], changed: bool) -> None:
        alive, kind, period, clock, a, b, final, written, sample = state
        if state == NOTHING:
            self.row.clear()
        else:
            self.row.update((alive, kind, period, clock, final, written, sample, asked))
        for side, text in (("a", a), ("b", b)):
            if text is not None:
                self.stats.updateValue((side,), (text,))
            elif self.stats.containsKey((side,)):
                self.stats.removeKey((side,))
        if changed:
            self.waiting.put(later) if later else self.waiting.clear()

    def close(self) -> None:
        pass


def ordered_rows(passes: DataFrame, delay: str = DELAY, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """What a stream of passes (PASSES) gives, each pass at its own time; passes that do nothing are kept off the state.

    The session needs the RocksDB state store. A bout's waiting passes are those of the last `delay`.
    """
    told = passes.withWatermark("ts", delay).withColumns({"cancelled": is_cancelled(F.col("status")), "suspended": is_suspended(F.col("status"))})
    # The condition names ts, so that it stays above the watermark: passes that do nothing still move it.
    wanted = told.filter(F.when(F.col("ts").isNotNull(), F.col("cancelled") | F.col("state").isin("in", "post"))).drop("status")
    return wanted.groupBy("bout_id").transformWithStateInPandas(LivePasses(ttl_hours), ROWS, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay_folder(spark: SparkSession, folder: str, files_a_batch: int | None = None, delay: str = DELAY, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """All rows of a folder's passes (Parquet, oldest file first), to the end: when the files are read, a closing pass far ahead lets out what
    still waits. The folder gets that pass's file."""
    use_rocksdb(spark)
    at = new_path(spark, "ordered")
    reader = spark.readStream.schema(PASSES)
    stream = ordered_rows((reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder), delay, ttl_hours)
    run = lambda: stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    last = spark.read.schema(PASSES).parquet(folder).agg(F.max("ts").alias("ts"))
    closing = last.select(F.lit(None).cast("bigint").alias("bout_id"), (F.col("ts") + F.expr(f"INTERVAL {ttl_hours * 2} HOURS") + F.expr(f"INTERVAL {delay}")).alias("ts"), F.lit("pre").alias("state"))
    spark.createDataFrame([], PASSES).unionByName(closing, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(folder)
    run()
    return spark.read.schema(ROWS).parquet(f"{at}/rows")
