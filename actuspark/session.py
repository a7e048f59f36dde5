"""Session helpers: where intermediate tables live, and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

CHECKPOINT_KEY = "spark.checkpoint.dir"
SMALL_TABLE_ROWS = 20_000

_local_roots: dict[str, str] = {}
_stages: dict[str, list[str]] = {}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("actuspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only for a local master without it."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        _local_roots[app] = tempfile.mkdtemp(prefix="actuspark-")
    return _local_roots[app]


def compile_wide_rows(spark: SparkSession) -> None:
    """Give up whole-stage methods that the JVM would not compile (8,000 bytes and more): rows of many computed columns
    are quicker by the compiled methods of single operators."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the written table.

    Cuts the lineage, survives lost executors, and keeps column pruning for every later reader.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stages.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stage_path = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`materialize` that nothing reads any more."""
    spark, path = df.sparkSession, df.stage_path
    _stages[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables this application has materialized; call it once their readers are written out."""
    paths = _stages.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def small_table(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """A table expected to be small, as broadcast constants when it is and unchanged when it is not.

    Fetches at most ``max_rows + 1`` rows, so a table that outgrows the bound is joined by shuffle instead.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def concurrently(tasks: Sequence[Callable[[], T]], parallelism: int = 4) -> list[T]:
    """Run independent driver-side steps (fits, stage writes) side by side, so their jobs share the executors."""
    if len(tasks) < 2 or parallelism < 2:
        return [task() for task in tasks]
    wrapped = [inheritable_thread_target(task) for task in tasks]
    with ThreadPoolExecutor(min(parallelism, len(tasks))) as pool:
        return list(pool.map(lambda task: task(), wrapped))
