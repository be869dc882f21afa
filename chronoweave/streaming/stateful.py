"""State machines over live event streams: rows wait until the watermark has passed them and then move their key's state in order.

Each key keeps its state and the rows that are still waiting, which span no more than the allowed lateness; an event-time
timer at the earliest of them wakes the key. A row at or before the watermark is late: Spark drops it and counts it in the
query's progress (numRowsDroppedByWatermark), as what came behind it has been answered. So any arrival order within the
lateness gives the rows that the batch operator gives, and a query that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoweave.operators.scan import Machine
from chronoweave.session import shared_dir

#: When first_s is 0, in seconds since 1970: watermarks begin there, and a row at or before them is late.
ORIGIN_S = 1704067200
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Runs a machine over a key's rows in the order of (first_s, event_id)."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first_s long, event_id long, symbol int")
        self.state = handle.getValueState("state", "state int")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(r.first_s), int(r.event_id), -1 if pd.isna(r.symbol) else int(r.symbol)) for frame in rows for r in frame.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer((min(new)[0] + ORIGIN_S) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        done = [r for r in rows if (r[0] + ORIGIN_S) * 1000 <= passed]
        rest = rows[len(done) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer((rest[0][0] + ORIGIN_S) * 1000)
        else:
            self.waiting.clear()
        state = self.state.get()[0] if self.state.exists() else self.machine.start
        out = []
        for first_s, event_id, symbol in done:
            after = state if symbol < 0 else self.machine.moves[symbol][state]
            out.append((key[0], event_id, first_s, None if symbol < 0 else symbol, state, after))
            state = after
        if done:
            self.state.update((state,))
            yield pd.DataFrame(out, columns=["entity", "event_id", "first_s", "symbol", "before", "after"]).astype({"symbol": "Int32", "before": "int32", "after": "int32"})

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, which timers need; the caller's session stays as it is."""
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return other


def scanned(events: DataFrame, machine: Machine, symbol: Column, late_s: int) -> DataFrame:
    """entity, event_id, first_s, symbol, before, after of a streaming frame (entity, event_id, first_s in whole seconds, and what `symbol` needs).

    The frame must belong to a `stateful_session`. Rows may come up to `late_s` seconds behind the latest one. Rows without a
    time can't be placed and are left out; a null symbol changes nothing.
    """
    entity = events.schema["entity"].dataType.simpleString()
    rows = events.where("first_s is not null and event_id is not null").select("entity", "event_id", "first_s", symbol.cast("int").alias("symbol"), F.timestamp_seconds(F.col("first_s") + ORIGIN_S).alias("at"))
    keyed = rows.withWatermark("at", f"{late_s} seconds").groupBy("entity")
    out = f"entity {entity}, event_id long, first_s long, symbol int, before int, after int"
    return keyed.transformWithStateInPandas(statefulProcessor=InOrder(machine), outputStructType=out, outputMode="Append", timeMode="EventTime")


def stretches(rows: DataFrame, arrival: Column, n: int) -> list[DataFrame]:
    """Timeline rows parted in the order of `arrival`; those without one never arrive."""
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    if low is None:
        return []
    wide = (high - low) // n + 1
    return [rows.where((arrival >= low + k * wide) & (arrival < low + (k + 1) * wide)) for k in range(n)]


def end_mark(rows: DataFrame, end_s: int) -> DataFrame:
    """A row of no entity at `end_s` that lets the watermark pass all others."""
    mark = rows.sparkSession.createDataFrame([(end_s,)], "first_s long")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("first_s", "event_id")]
    return mark.select("first_s", F.lit(-1).cast("long").alias("event_id"), *nothing).select(*rows.columns).coalesce(1)


def arrivals(rows: DataFrame, arrival: Column, path: str, files: int, end_s: int) -> None:
    """Write timeline rows as a folder of files in the order of `arrival`, a stretch of it a file for each of its partitions, and an end mark at `end_s`."""
    for part in [*stretches(rows, arrival, files), end_mark(rows, end_s)]:
        part.write.mode("append").parquet(path)


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> None:
    """Write what a streaming frame gives for all files that are there, and stop."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed(spark: SparkSession, rows: DataFrame, machine: Machine, symbol: Column, *, arrival: Column, late_s: int, files: int = 3) -> DataFrame:
    """`scanned` over a table that is streamed in the order of `arrival`, a micro-batch a stretch of it: what a live query would have answered.

    Tasks write their shares of a stretch side by side, so that its files have no order: the query takes all of a stretch at once,
    stops, and goes on from its checkpoint when the next one is there.
    """
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    last = rows.agg(F.coalesce(F.max("first_s"), F.lit(0))).first()[0]
    session = stateful_session(spark)
    for part in [*stretches(rows, arrival, files), end_mark(rows, last + late_s + 1)]:
        part.write.mode("append").parquet(f"{folder}/in")
        out = scanned(session.readStream.schema(rows.schema).parquet(f"{folder}/in"), machine, symbol, late_s)
        run_to_end(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
