"""Tables between the steps of a job: written below the cluster's shared folder and read again.

Executors share no local folders, so such tables go below ``spark.checkpoint.dir`` as Parquet: Spark's commit protocol
makes a retried task harmless, and a lost executor takes no intermediate result with it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of the batches that Python workers get while a table is written.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_opened: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a temporary one is made and set if driver and executors are one
    process (as in tests); on a cluster that is an error, as executors wouldn't see each other's files."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="attesto-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, Spark hands Python workers small batches, as long texts need; then the session's settings are what
    they were."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Workspace:
    """A folder of one run below the shared one.  Its tables are read lazily by what the run returns, so they are
    removed when the application ends or by :func:`clean`."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/attesto/{name}-{uuid.uuid4().hex}"
        _opened.append((spark, self.path))

    def save(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Write ``df`` and return a reader of what was written: its lineage ends here.  ``options`` are the writer's."""
        with small_batches(self.spark):
            df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path`` (driver only, for metadata)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def clean() -> None:
    """Remove the intermediate tables of all runs of this process; results not yet written then become unreadable.  What
    belongs to a session that has stopped can't be reached any more and is left to the owner of the folder."""
    while _opened:
        spark, path = _opened.pop()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)


atexit.register(clean)
