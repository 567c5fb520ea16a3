"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one is made and set, on a local master (as in tests) only."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined() and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="lumenlink-")
        if not have.isDefined():
            sc.setCheckpointDir(at)
            at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/lumenlink-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete what this process has kept so far.  Results that have not been written yet must not be read after it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clear() -> None:
    """What is left when the process ends, as far as it lies in a mounted folder."""
    for path in _made:
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


#: Bytes of one Arrow batch between the JVM and a Python worker, so that long texts do not add up.
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless its own limit is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = str(spark.conf.get(name, "64mb")).lower().rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder, as Parquet with the writer's options, and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    limit_batches(spark)
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete kept tables that no later step reads: what was made of them has been written."""
    for df in kept:
        spark, path = df.sparkSession, df._kept_at
        _made.remove(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of the steps that are done.

    It does so when the driver collects its garbage, which a query of many steps may not see for long.
    """
    spark.sparkContext._jvm.System.gc()


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the least hashes of ``key``, which must be distinct.

    Tasks drop what lies far above the cut before the rows are ordered, so they send about ``limit``
    rows together, whatever their number.
    """
    n = df.count()
    if n > 2 * limit:
        share = int((1.3 * limit / n) * (1 << 40)) + 1
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share)
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(limit)


_asked: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, if they cannot import it by themselves."""
    sc = spark.sparkContext
    if sc.applicationId in _asked:
        return
    _asked.add(sc.applicationId)
    if not sc.parallelize([0], 1).map(lambda _: __import__("importlib.util").util.find_spec("lumenlink") is not None).first():
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root, name = os.path.split(package)
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name))
