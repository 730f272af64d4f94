"""What the training-data operators share: the shared folder, written tables, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Has Spark remove a query's shuffle files when the query ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one Arrow batch; a batch is also bounded in bytes (BATCH_BYTES).
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in a local session that names none."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="vigilspark-")
    return _own_dirs[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._vigil_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_vigil_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: What a worker process keeps between tasks, by name; a task that does not keep a cache empties it first.
caches: dict[str, dict] = {}


def _emptied(keeps: str | None) -> None:
    others = [c for name, c in caches.items() if name != keeps and c]
    for c in others:
        c.clear()
    if others:
        gc.collect()


#: Bytes of its own that a worker may hold on to between tasks, or between batches where it keeps a cache.
HELD_BYTES = 160 << 20


def _returned() -> None:
    """Give free memory back to the system where a worker holds much: idle workers wait beside busy ones, and the allocators keep what they had."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared, *_ = map(int, f.read().split())
    except OSError:
        return
    if (resident - shared) * 4096 <= HELD_BYTES:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow with batches that stay small for long texts. keeps: the cache that fn uses; workers are shared by all operators of a job."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vigilspark.llm.common import _emptied, _returned  # those of the worker

        _emptied(keeps)
        try:
            for out in fn(batches):
                yield out
                if keeps is not None:  # such a worker is large, and its batches take long
                    _returned()
        finally:
            _returned()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
