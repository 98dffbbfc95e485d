"""Structured Streaming jobs over the event feed.

Sources are file streams (parquet), sinks are parquet file sinks with their
checkpoints under ``spark.checkpoint.dir`` — exactly-once, restartable after a lost
executor or driver, no sockets.  ``trigger(availableNow=True)`` drains what is there
and stops, which is how the tests and the registered queries run them.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from faultline.functions import formulas as X
from faultline.session import ensure_checkpoint_dir, ship_package
from faultline.sources.fixtures import event_view

WATERMARK = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Z_WINDOW = 14          # online detector: fixed trailing window (the batch form derives b from n)
CUSUM_K, CUSUM_H = 0.5, 5.0


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The ``events`` table as a stream, mapped to canonical columns; event time is cast
    from NTZ to TIMESTAMP (watermarks need it; the session runs in UTC)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))
    return event_view(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_to_parquet(df: DataFrame, name: str, mode: str = "append",
                   state_partitions: int | None = None) -> DataFrame:
    """Drain a streaming DataFrame into a parquet sink and return the sink as a batch
    DataFrame.

    ``state_partitions`` fixes the number of shuffle / state-store partitions of a
    stateful query.  Spark records it in the query's checkpoint at the first start and
    keeps it across restarts, so it is set only around ``start()``; by default the
    cluster's parallelism is used rather than the session-wide shuffle setting.  State is held
    by RocksDB, off the JVM's heap, which ``transformWithState`` asks for; that is recorded too."""
    spark = df.sparkSession
    base = _scratch(spark, name)
    own = {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism),
           "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    previous = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        q = (df.writeStream.format("parquet").option("path", f"{base}/out")
               .option("checkpointLocation", f"{base}/chk").outputMode(mode)
               .trigger(availableNow=True).start())
    finally:
        for k, v in previous.items():
            spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def tumbling_rate(events: DataFrame, window: str = "1 day", key: str = "machine_id") -> DataFrame:
    """ST-1: per (day, machine) units, defects, rate; append mode behind a watermark."""
    g = (events.withWatermark("timestamp", WATERMARK)
               .groupBy(F.window("timestamp", window), key)
               .agg(F.sum("units_inspected").alias("units"), F.sum("defect_count").alias("defects")))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key,
                    "units", "defects", X.spark(X.rate("`defects`", "`units`")).alias("defect_rate"))


def daily(events: DataFrame, *keys: str) -> DataFrame:
    """Units and defects per day (and key), emitted once the watermark has passed the day."""
    return (events.withWatermark("timestamp", WATERMARK).groupBy(F.window("timestamp", "1 day").alias("pane"), *keys)
                  .agg(F.sum("units_inspected").alias("units"), F.sum("defect_count").alias("defects")))


def sliding_rate(events: DataFrame, length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """ST-2: sliding 30-day defect rate, one window per day.  Events are summed into panes of one day, and
    only these, one row a day, are copied into the windows that hold them; ``slide`` and ``length`` are whole days."""
    g = (daily(events).groupBy(F.window(F.col("pane"), length, slide).alias("window"))
                      .agg(F.sum("units").alias("units"), F.sum("defects").alias("defects")))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "units", "defects", X.spark(X.rate("`defects`", "`units`")).alias("defect_rate"))


def dedup_ids(events: DataFrame) -> DataFrame:
    """ST-3: drop repeated inspection ids seen within the watermark delay."""
    return events.withWatermark("timestamp", WATERMARK).dropDuplicatesWithinWatermark(["inspection_id"])


ALERT_SCHEMA = ("machine_id string, day date, units long, defects long, defect_rate double, z double, "
                "cusum_pos double, cusum_neg double, alert int")
STATE_SCHEMA = "history array<double>, sp double, sm double"


def _step(rate: float, hist: list[float], sp: float, sm: float):
    """z against the previous ``Z_WINDOW`` days (sample std; 0 when that is 0) and the two-sided CUSUM
    from the first day with a full window."""
    z = None
    if len(hist) >= Z_WINDOW:
        win = hist[-Z_WINDOW:]
        acc = 0.0                                         # plain left-to-right sums (no compensation)
        for x in win:
            acc += x
        mu = acc / len(win)
        acc = 0.0
        for x in win:
            acc += (x - mu) * (x - mu)
        sd = math.sqrt(acc / (len(win) - 1))
        z = (rate - mu) / sd if sd > 0 else 0.0
        sp, sm = max(0.0, sp + z - CUSUM_K), max(0.0, sm - z - CUSUM_K)
    return z, (hist + [rate])[-Z_WINDOW:], sp, sm


class Cusum(StatefulProcessor):
    """ST-4 state machine, one machine per key, fed with closed days only: at most one row a day."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("cusum", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        hist, sp, sm = self.held.get() if self.held.exists() else ([], 0.0, 0.0)
        hist, out = list(hist), []
        for day, units, defects in sorted((d, int(u), int(n)) for pdf in rows
                                          for d, u, n in zip(pdf["day"], pdf["units"], pdf["defects"], strict=True)):
            rate = defects / units if units else 0.0
            z, hist, sp, sm = _step(rate, hist, sp, sm)
            out.append((key[0], day, units, defects, rate, z, sp, sm, int(sp > CUSUM_H or sm > CUSUM_H)))
        self.held.update((hist, float(sp), float(sm)))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ALERT_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def online_cusum(events: DataFrame) -> DataFrame:
    """ST-4: per-machine online z-score + CUSUM over closed days.

    Two stateful steps: events are summed per machine and day behind a watermark, so an event counts in
    whatever order it comes as long as the watermark has not passed its day; closed days, which come in
    order, feed the state of their machine.  No group holds raw events."""
    ship_package(events.sparkSession)
    days = daily(events, "machine_id").select("machine_id", F.to_date("pane.start").alias("day"), "units", "defects")
    return days.groupBy("machine_id").transformWithStateInPandas(Cusum(), ALERT_SCHEMA, "Append", "None")
