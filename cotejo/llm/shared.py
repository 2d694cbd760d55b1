"""Tables in the folder that driver and executors share, and the size of batches."""

from pyspark.sql import DataFrame, SparkSession

from cotejo.sources.written import durable, new_folder, shared_dir

__all__ = ["bound_batches", "durable", "new_folder", "partitions", "shared_dir"]

#: Bytes of input, as stored, for each range of keys; from what size on Spark's estimate is no estimate.
RANGE_BYTES, UNKNOWN_BYTES = 64 << 20, 1 << 60
#: Bytes of rows that go to Python at once; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def partitions(spark: SparkSession, texts: DataFrame) -> int:
    """Ranges of keys over which what is gathered from texts is dealt out: one for each shuffle partition or, if that is more, for each RANGE_BYTES
    of input by Spark's own estimate. So a range, which a task holds, doesn't grow with the table where shuffle partitions stay as they are."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Of some inputs Spark knows nothing and assumes the most.
    return max(least, -(-size // RANGE_BYTES)) if size < UNKNOWN_BYTES else least


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts are bounded by bytes, not only by rows: 10,000 long texts are no longer one batch. A session's own setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
