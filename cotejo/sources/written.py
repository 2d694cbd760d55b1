"""Tables written to the folder that driver and executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a local folder takes its place in local mode; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cotejo-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: The folder, under the library's own, of the tables that scratch() takes away.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def new_folder(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A folder for a table; within scratch() one that goes with it, unless it is to be kept."""
    return f"{shared_dir(spark)}/cotejo/{'' if keep else _SCRATCH.get()}{tag}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go at the end: what is to outlive it has to be written with keep before."""
    name = f"scratch-{uuid.uuid4().hex[:12]}/"
    before = _SCRATCH.set(_SCRATCH.get() + name)
    try:
        yield
    finally:
        remove_folder(spark, f"{shared_dir(spark)}/cotejo/{_SCRATCH.get()}")
        _SCRATCH.reset(before)


def durable(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and a lost executor costs a reread only. Packed by zstandard, as these tables often hold texts."""
    path = new_folder(df.sparkSession, tag, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
