"""Changes of written tables: what they touch, that they can be repeated, and what a failed one leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridgauge.operators import store


def files(path):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def rows(spark, ids, note):
    return spark.createDataFrame([(i, k, note) for i in ids for k in range(2)], "document_id long, table_index int, note string")


def said(t):
    return sorted(map(tuple, t.read().collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return store.Table(spark, f"{tmp_path}/t", buckets=8).create(rows(spark, range(40), "old"))


def test_only_touched_buckets(spark, table):
    before = files(table.path)
    table.delete(rows(spark, [3], ""), ["document_id", "table_index"])
    after = files(table.path)
    gone = {os.path.dirname(x) for x in before.keys() - after.keys()}
    assert len(gone) == 1 and all(after[x] == t for x, t in before.items() if os.path.dirname(x) not in gone)
    assert len(said(table)) == 78
    table.delete(rows(spark, [], ""), ["document_id"])
    assert files(table.path) == after


def test_bucket_that_empties(spark, table):
    table.delete(rows(spark, range(40), ""), ["document_id"])
    assert said(table) == []
    table.append(rows(spark, [5], "new"), ["document_id", "table_index"])
    assert said(table) == [(5, 0, "new"), (5, 1, "new")]


def test_repeats(spark, table):
    keys = ["document_id", "table_index"]
    for _ in range(2):
        table.append(rows(spark, [39, 40], "new"), keys)
        table.replace(rows(spark, [1], "newer"), ["document_id"])
        table.update(spark.createDataFrame([(2, 0, "set"), (2, 1, None)], "document_id long, table_index int, note string"), keys)
    got = said(table)
    assert len(got) == 82 and {r for r in got if r[2] != "old"} == {(40, 0, "new"), (40, 1, "new"), (1, 0, "newer"), (1, 1, "newer"), (2, 0, "set")}
    refused = table.insert_absent(rows(spark, [40, 41], "late"), keys)
    assert sorted(map(tuple, refused.collect())) == [(40, 0, "late"), (40, 1, "late")] and len(said(table)) == 84


def test_failed_task_leaves_the_table(spark, table):
    before, was = files(table.path), said(table)

    @F.udf("string")
    def fail(k):
        if k == 17:
            raise RuntimeError("on purpose")
        return "new"

    with pytest.raises(Exception, match="on purpose"):
        table.replace(rows(spark, range(40), "x").withColumn("note", fail("document_id")), ["document_id"])
    assert files(table.path) == before and said(table) == was


def test_null_keys_and_existing_tables(spark, table, tmp_path):
    table.append(spark.createDataFrame([(None, 0, "none")], "document_id long, table_index int, note string"), ["document_id", "table_index"])
    assert (None, 0, "none") in said(table)
    with pytest.raises(Exception, match="already exists"):
        store.Table(spark, table.path).create(rows(spark, [1], "x"))


def test_brute_force(spark, tmp_path):
    rng = random.Random(4)
    held = {(i, k): "old" for i in range(12) for k in range(2)}
    t = store.Table(spark, f"{tmp_path}/t", buckets=4).create(rows(spark, range(12), "old"))
    keys = ["document_id", "table_index"]
    for step in range(8):
        some = {(rng.randrange(16), rng.randrange(3)) for _ in range(4)}
        df = spark.createDataFrame([(*k, f"s{step}") for k in some], "document_id long, table_index int, note string")
        how = rng.choice(("append", "replace", "update", "delete"))
        if how == "append":
            t.append(df, keys)
            held = {k: f"s{step}" for k in some} | held
        elif how == "replace":
            t.replace(df, ["document_id"])
            held = {k: v for k, v in held.items() if k[0] not in {i for i, _ in some}} | {k: f"s{step}" for k in some}
        elif how == "update":
            t.update(df, keys)
            held |= {k: f"s{step}" for k in some & held.keys()}
        else:
            t.delete(df, keys)
            held = {k: v for k, v in held.items() if k not in some}
        assert said(t) == sorted(((*k, v) for k, v in held.items()), key=repr), (step, how)
