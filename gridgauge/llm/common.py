"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session may go without ``spark.checkpoint.dir``; it gets a temporary folder.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridgauge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths of the tables that are written while ``scratch`` is open.
_made: list[list[str]] = []


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back without its lineage; and the table's path."""
    path = f"{shared_dir(df.sparkSession)}/gridgauge-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Drop what ``written`` writes inside, but for the paths that are handed to the function it gives."""
    kept: set[str] = set()
    _made.append([])
    try:
        yield kept.add
    finally:
        drop_written(spark, *(x for x in _made.pop() if x not in kept))


def with_text(df: DataFrame, text_col: str, *others: tuple[str, str]) -> DataFrame:
    """Columns ``text`` (null: empty) and the others under fixed names: other columns can't clash."""
    return df.select(*[F.col(c).alias(to) for c, to in others], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Rows that a task turns into Python objects at once.
ROWS = 512
#: What a worker process keeps from task to task, and the keys that the task at hand has asked for.
_kept: dict = {}
_asked: set = set()


def kept(key: Hashable, make: Callable[[], object]):
    """``make()``, once as long as a worker's tasks ask for it; it goes with the first task of ``per_batch`` that doesn't.

    Workers outlive a job's stages: what one stage remembers of its words must not stand beside what the next one needs.
    """
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def drop_unasked() -> None:
    """Forget what the task at hand hasn't asked for."""
    for key in _kept.keys() - _asked:
        del _kept[key]


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Map Arrow batches, ``ROWS`` rows at a time, with what ``make()`` returns; it is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _asked.clear()
        f = make()
        drop_unasked()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield f(b.slice(at, ROWS))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


SPACES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8; ASCII characters other than letters and digits part them."""
    return text.lower().encode().translate(SPACES).split()
