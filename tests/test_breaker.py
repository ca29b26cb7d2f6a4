"""The circuit breaker on a key of more events than an Arrow chunk, against brute force."""

import datetime
import random

from gridgauge.streaming import progress


def test_breaker_of_many_chunks(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=20 * k), 1, rng.choice([-1.0, 1.0])) for k in range(25_000)]
    want, n, opened = {}, 0, None
    for _, ts, _, v in rows:
        if opened is not None and (ts - opened).total_seconds() >= 300:
            n, opened = 0, None
        want[ts] = opened is not None
        n = 0 if v > 0 else n + 1
        if n >= 3 and opened is None:
            opened = ts
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = progress.breaker(progress.events(spark, f"{tmp_path}/in", df.schema))
    found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    got = {r.ts: r.open for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
