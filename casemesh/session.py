"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22


def local_session(app_name: str = "casemesh", cores: int | str = "*") -> SparkSession:
    """A one-machine session for tests and the benchmark. On a cluster, bring your own."""
    parallel = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names a folder all executors share in ``spark.checkpoint.dir``. Only a
    local session, where every task is on this machine, may fall back to a temporary one.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="casemesh-"))
    return sc.getCheckpointDir().rstrip("/")


_scopes = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_scopes, "open", [])[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes, at its end, the intermediate tables this thread made inside it.

    For code that has written its result by then: a job, or a micro-batch.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield
    finally:
        scopes.remove(made)
        for path in made:
            remove_path(spark, path)


_setting = threading.Lock()
_settings: dict[tuple[int, str], list] = {}


@contextmanager
def _set(spark: SparkSession, conf: str, value: str):
    key = id(spark), conf
    with _setting:
        # Threads share the setting: the first to come sets it, the last to go puts it back.
        held = _settings.setdefault(key, [0, spark.conf.get(conf, None)])
        held[0] += 1
        spark.conf.set(conf, value)
    try:
        yield
    finally:
        with _setting:
            held[0] -= 1
            if not held[0]:
                if held[1] is None:
                    spark.conf.unset(conf)
                else:
                    spark.conf.set(conf, held[1])
                del _settings[key]


def shuffles_dropped(spark: SparkSession):
    """Writes inside it leave no shuffle files behind.

    Otherwise these stay until the driver happens to collect its garbage, and a table takes
    the disk twice. For tables that are read from where they are written, never computed again.
    """
    return _set(spark, CLEANUP_CONF, "true")


def small_batches(spark: SparkSession):
    """Tables written inside it send texts to Python in batches of ``BATCH_BYTES``.

    By default a batch is 10,000 rows whatever they hold: tens of megabytes of documents, in
    the executor's JVM and, twice, in each of its Python workers.
    """
    return _set(spark, BATCH_CONF, str(BATCH_BYTES))


def materialize_counted(
    df: DataFrame, name: str, compression: str = "snappy", **marks: Column
) -> tuple[DataFrame, dict]:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage at a durable table, so that a lost executor costs a re-read and not
    a recomputation, and later reads still prune columns. The row count (``rows``) and
    any other aggregate in ``marks`` are observed by the writing job itself. Tables of texts
    take much less disk with ``zstd``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation(name)
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        mark.alias(alias) for alias, mark in marks.items()
    ])
    counted.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    return materialize_counted(df, name, compression)[0]


def few_tasks(df: DataFrame, rows: int, rows_a_task: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than these need.

    A task in Python takes some 50 ms however few rows it has, and a join that splits its hot
    keys makes many small ones. Each takes several partitions as they are: nothing is shuffled.
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-rows // rows_a_task)))


def side_by_side(spark: SparkSession, *jobs: Callable) -> list:
    """Runs independent driver-side jobs at the same time, so that the many short stages
    of one fill the executors that another leaves idle."""
    target = inheritable_thread_target(spark)
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: job(), [target(job) for job in jobs])


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def remove_path(spark: SparkSession, path: str) -> None:
    system, hadoop_path = _file_system(spark, path)
    system.delete(hadoop_path, True)


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Puts the folder ``new`` in the place of ``path``."""
    remove_path(spark, path)
    system, hadoop_path = _file_system(spark, new)
    if not system.rename(hadoop_path, _file_system(spark, path)[1]):
        raise OSError(f"could not move {new} to {path}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through Hadoop's FileSystem, so any storage scheme works."""
    system, hadoop_path = _file_system(spark, path)
    return bool(system.exists(hadoop_path))
