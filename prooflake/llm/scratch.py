"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``.  The setting is read from the session; only where
it is unset (tests, a laptop) a local folder is made.  Tables go when the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="prooflake-"))
    return _LOCAL[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch: texts are long, and a worker holds a batch at a time.
BATCH_ROWS = 2000


class Scratch:
    """Tables of one query run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the JVM may be gone already
            pass

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and read it back: later uses start from the files."""
        df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        for tag in tags:
            _delete(self.spark, self.path(tag))

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that are no longer referenced."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
