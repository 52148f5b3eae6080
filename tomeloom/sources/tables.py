"""Tables written between steps of an operator, in the session's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process only where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tomeloom-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: cuts lineage, fixes generated ids, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Tables written inside are removed at its end, but for those of these names."""
    start = len(_written)
    try:
        yield
    finally:
        inside, _written[start:] = _written[start:], []
        for spark, path in inside:
            if path.rsplit("/", 1)[-1][:-33] in kept:  # less "-" and 32 digits
                _written.append((spark, path))
            else:
                _remove(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone
            return
