"""Timers of silent jobs, and listeners that come, die and are pruned, over restarts."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from gridgauge.operators import store
from gridgauge.streaming import progress

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime.datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, held)


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_timeouts(spark, tmp_path, rocks):
    """Files one after the other; jobs 0 to 29 start at odd times, some end in time, some late, some fall silent."""
    rng = random.Random(3)
    events, k = [], 0
    for job in range(30):
        t = rng.randrange(0, 300)
        last = t + rng.choice((0, 20, 300))
        while t <= last:
            events.append((k, at(t), job, rng.choice(("step", "step", "done")) if t > 100 else "step", 1.0))
            k += 1
            t += rng.randrange(5, 60)
    events.sort(key=lambda e: e[1])
    events.append((k, at(2000), 99, "step", 1.0))
    for i in range(0, len(events), 40):
        put(spark, f"{tmp_path}/in", events[i : i + 40])
    got = []
    for _ in range(2):  # the second run has nothing new
        stream = progress.events(spark, f"{tmp_path}/in", SCHEMA, 100)
        q = progress.timeouts(stream, 3600, F.col("event_type") == "done", late="1 minute").writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    want = set()
    for job in range(30):
        own = [e for e in events if e[2] == job]
        start = min(e[1] for e in own)
        if not any(e[3] == "done" and e[1] <= start + datetime.timedelta(hours=1) for e in own):
            want.add((job, start, start + datetime.timedelta(hours=1), len(own)))
    assert sorted((r.job, r.started, r.deadline, r.n) for r in got) == sorted(want) and 5 < len(want) < 30


def test_listeners(spark, tmp_path):
    table = store.Table(spark, f"{tmp_path}/listeners", "user_id", 4)
    table.create(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "user_id long, listener string"))
    box = f"{tmp_path}/box"
    os.mkdir(box)

    def send(listener, batch, piece, rows):
        if listener == "b" and batch > 0:
            raise ConnectionError("gone")
        with open(f"{box}/{listener}-{batch}-{piece}", "w") as f:
            f.write(",".join(map(str, rows["event_id"])))

    def received(listener):
        return sorted(int(x) for name in os.listdir(box) if name.startswith(f"{listener}-") for x in open(f"{box}/{name}").read().split(","))

    def run():
        progress.deliver(progress.events(spark, f"{tmp_path}/in", SCHEMA, 1), table, send, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    put(spark, f"{tmp_path}/in", [(k, at(k), k % 4, "x", 0.0) for k in range(8)])
    run()
    assert (received("a"), received("b"), received("c")) == ([1, 2, 5, 6], [1, 5], [3, 7])
    table.append(spark.createDataFrame([(1, "d")], "user_id long, listener string"), ["user_id", "listener"])
    put(spark, f"{tmp_path}/in", [(k, at(k), k % 4, "x", 0.0) for k in range(8, 12)])
    run()
    assert sorted(r.listener for r in table.read().collect()) == ["a", "a", "c", "d"]
    put(spark, f"{tmp_path}/in", [(k, at(k), k % 4, "x", 0.0) for k in range(12, 16)])
    run()
    run()
    assert (received("a"), received("b"), received("c"), received("d")) == ([1, 2, 5, 6, 9, 10, 13, 14], [1, 5], [3, 7, 11, 15], [9, 13])
    log = {(r.listener, r.job): (r.n, r.dead) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("listener", "job").agg(F.sum("n").alias("n"), F.max("dead").alias("dead")).collect()}
    assert log == {("a", 1): (4, False), ("a", 2): (4, False), ("b", 1): (2, True), ("c", 3): (4, False), ("d", 1): (2, False)}
