"""Tables that cut lineage, kept as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="cartolith-"))
    return f"file://{_OWN_FOLDER[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/cartolith-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def save(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` and read it back; the new frame has no lineage, so a lost executor costs one task only."""
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release(*sent: Broadcast) -> None:
    """Take broadcast values away from the executors once the tables made with them are written."""
    for x in sent:
        x.destroy()


@contextlib.contextmanager
def scope(paths: list[str]) -> Iterator[None]:
    """Notes in ``paths`` what is kept meanwhile, for ``drop`` once the result is written."""
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
