"""STM-01 to STM-07, STM-10: progress and running statistics over event streams.

Sources have event_id, ts, user_id (the job), event_type and value.
"""

from __future__ import annotations

import heapq
import itertools
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridgauge.operators import store


def events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fan_out(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, job: int | None = None):
    """STM-01: every micro-batch to ``send``, of one job if given; restarts go on from the checkpoint."""
    own = stream if job is None else stream.where(F.col("user_id") == job)
    return own.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Stages of an upload in order, with their names.
STAGES = {
    "document_processing": "Document Processing",
    "metadata_extraction": "Metadata Extraction",
    "table_detection": "Table Detection",
    "data_extraction": "Data Extraction",
    "financial_processing": "Financial Processing",
    "quality_assurance": "Quality Assurance",
}


def percent(stream: DataFrame, stage: Column, by: str = "user_id") -> DataFrame:
    """STM-02: of each job the events so far, the furthest stage's share of all stages in whole percent, and its message; events of no stage only count."""
    place = F.when(stage.isNotNull(), F.array_position(F.array(*map(F.lit, STAGES)), stage)).otherwise(0)
    got = stream.groupBy(by).agg(F.count("*").alias("n"), F.max(place).alias("stage"))
    name = F.get(F.array(*map(F.lit, STAGES.values())), (F.col("stage") - 1).cast("int"))
    return got.select(by, "n", F.floor(100 * F.col("stage") / len(STAGES)).alias("percent"), F.when(F.col("stage") > 0, F.concat(F.lit("Processing "), name, F.lit("..."))).otherwise("").alias("message"))


def elapsed(stream: DataFrame, most_s: float, by: str = "user_id") -> DataFrame:
    """Of each job the seconds from its first to its last event, and whether they exceed the time it has; two numbers of state a job."""
    seconds = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return stream.groupBy(by).agg((seconds / 1e6).alias("seconds")).withColumn("timed_out", F.col("seconds") > most_s)


class Deadline(StatefulProcessor):
    """A job's first event sets a timer; an event that ends the job in time takes it away; else the timer reports the job."""

    def __init__(self, most_ms: int):
        self.most_ms = most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "started long, done boolean, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, done, n = self.state.get() if self.state.exists() else (None, False, 0)
        first, ends, before = started, [], started
        for p in rows:
            at = p["ts"].astype("datetime64[us]").astype("int64") // 1000
            first = int(at.min()) if first is None else min(first, int(at.min()))
            ends += at[p["ends"] == True].sort_values()[:1].tolist()  # noqa: E712, null is no end
            n += len(p)
        if not done:
            done = any(x <= first + self.most_ms for x in ends)
            if before is not None and (done or first != before):
                self.handle.deleteTimer(before + self.most_ms)
            if not done and (before is None or first != before):
                self.handle.registerTimer(first + self.most_ms)
        self.state.update((first, done, n))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, done, n = self.state.get()
        if not done:
            self.state.update((started, True, n))
            yield pd.DataFrame({"job": [key[0]], "started": [pd.Timestamp(started, unit="ms")], "deadline": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")], "n": [n]})

    def close(self) -> None:
        pass


def timeouts(stream: DataFrame, most_s: float, ends: Column, by: str = "user_id", late: str = "2 hours") -> DataFrame:
    """STM-03: jobs that no event has ended ``most_s`` after their first: ``job``, ``started``, ``deadline`` and ``n`` events so far.

    The watermark, ``late`` behind the newest event of any job, sets the timers off, so a job that falls silent is reported
    too, once.  State is three values a job.  The session needs the RocksDB state store.
    """
    rows = stream.select(by, F.col("ts").cast("timestamp").alias("ts"), ends.alias("ends")).withWatermark("ts", late)
    kind = dict(stream.dtypes)[by]
    return rows.groupBy(by).transformWithStateInPandas(Deadline(round(most_s * 1000)), f"job {kind}, started timestamp, deadline timestamp, n long", "append", "EventTime")


def deliver(stream: DataFrame, listeners: store.Table, send: Callable[[str, int, int, pd.DataFrame], None], out: str, checkpoint: str, by: str = "user_id"):
    """STM-01: every micro-batch's events to the listeners of their job; listeners that a send fails for are pruned.

    ``listeners`` has the columns ``by`` and ``listener`` and is read anew for each batch.  ``send`` gets the listener, the number
    of the batch, the number of the piece and some rows; a batch that runs again has the same number, so a receiver can tell what it
    has.  What was sent is written to ``out``, a folder a batch, which a repeated batch replaces: ``listener``, job, ``n`` and
    ``dead``.  Listeners are pruned after that; a run that dies between goes over the batch again and prunes then.
    """

    def one(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        said = listeners.read().select(F.col(by).alias("job"), "listener").distinct()
        rows = df.select(F.col(by).alias("job"), "*").join(said, "job").repartition("listener").sortWithinPartitions("listener", "ts", "event_id")
        columns = df.columns

        def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            dead, pieces = set(), Counter()
            for p in batches:
                outcome = []
                for (listener, job), own in p.groupby(["listener", "job"], sort=False):
                    n = 0
                    if listener not in dead:
                        try:
                            send(listener, batch, pieces[listener], own[columns])
                            n = len(own)
                        except Exception:  # noqa: BLE001, whatever the send fails with
                            dead.add(listener)
                    pieces[listener] += 1
                    outcome.append((listener, job, n, listener in dead))
                yield pd.DataFrame(outcome, columns=["listener", "job", "n", "dead"])

        kind = dict(df.dtypes)[by]
        sent = rows.mapInPandas(post, f"listener string, job {kind}, n long, dead boolean")
        place = f"{out}/batch={batch}"
        sent.groupBy("listener", "job").agg(F.sum("n").alias("n"), F.max("dead").alias("dead")).write.mode("overwrite").parquet(place)
        gone = spark.read.schema(f"listener string, job {kind}, n long, dead boolean").parquet(place).where("dead").select("listener").distinct()
        of_dead = listeners.read().join(gone, "listener", "left_semi").select(by, "listener")
        listeners.delete(of_dead, [by, "listener"])

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """STM-10: events and mean value by type and window; rows later than the watermark are left out.  An extension of our own."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def running(stream: DataFrame, by: str = "event_type") -> DataFrame:
    """STM-04 to STM-06: number, mean, total and success rate so far; rates divide by one at least."""
    ok = (F.col("value") > 0).cast("int")
    got = stream.groupBy(by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.sum("value").alias("total"), F.sum(ok).alias("ok"))
    return got.withColumn("success_rate", F.col("ok") / F.greatest(F.col("n"), F.lit(1)))


def in_order(batches: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """All rows of ``batches`` by ts and value: each is sorted and spilled as a run, then the runs merge, ``rows`` at a time."""
    with tempfile.TemporaryDirectory() as folder:
        paths = []
        for p in batches:
            paths.append(f"{folder}/{len(paths)}")
            table = pa.Table.from_pandas(p[["ts", "value"]].sort_values(["ts", "value"]), preserve_index=False)
            with pa.ipc.new_file(paths[-1], table.schema) as f:
                f.write_table(table, max_chunksize=512)
        merged = heapq.merge(*map(run, paths))
        while held := list(itertools.islice(merged, rows)):
            yield pd.DataFrame(held, columns=["ts", "value"])


def run(path: str) -> Iterator[tuple]:
    """Rows of a spilled run, a block at a time."""
    with pa.memory_map(path) as source:
        f = pa.ipc.open_file(source)
        for k in range(f.num_record_batches):
            p = f.get_batch(k).to_pandas()
            yield from zip(p["ts"], p["value"])


def breaker(stream: DataFrame, by: str = "user_id", failures: int = 3, reset_s: float = 300.0) -> DataFrame:
    """STM-07: for each event whether the circuit of its key is open; it opens after so many failures in a row and closes after ``reset_s``.

    A failure is an event without a positive value.  A micro-batch's events of a key are stepped through by time,
    however many chunks they come in.  A key's state is two numbers and has no timeout, so that a
    run over what is available ends.
    """
    kind = dict(stream.dtypes)[by]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, opened = state.get if state.exists else (0, 0.0)
        for p in in_order(batches):
            out = []
            for at, v in zip((p["ts"] - pd.Timestamp(0)).dt.total_seconds(), p["value"]):
                if opened and at - opened >= reset_s:
                    n, opened = 0, 0.0
                out.append((key[0], pd.Timestamp(round(at * 1e6), unit="us"), bool(opened)))
                n = 0 if v > 0 else n + 1
                if n >= failures and not opened:
                    opened = at
            yield pd.DataFrame(out, columns=[by, "ts", "open"])
        state.update((n, opened))

    rows = stream.select(by, F.col("ts").cast("timestamp").alias("ts"), "value")
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, ts timestamp, open boolean", "n int, opened double", "append", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, by: str = "user_id") -> DataFrame:
    """The last result of each key.

    The greatest (ts, event_id) is the same however often an event comes, so repeats need no state of their own; the
    state is one row a key.
    """
    return stream.groupBy(by).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
