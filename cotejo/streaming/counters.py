"""Counters and live offers as streams, and the table of the latest row of each key that they keep."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Manifests, with the data they name, that are kept: a batch that runs again starts from the one before its own.
KEPT = 2


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_counts(events: DataFrame, keys: tuple[str, ...] = ("event_type", "id")) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of the largest sequence number of each key; late answers to older requests lose."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r")).select(*keys, "r.*")


def run_once(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, into the in-memory table `name`."""
    query = rows.writeStream.queryName(name).format("memory").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def final_counts(rows: DataFrame, folder: str) -> DataFrame:
    """All that is there now: the last state of a stream in complete mode, written under folder and read back."""
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/v={number}")
        last[:] = [number]

    query = rows.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).parquet(f"{folder}/table/v={last[0]}") if last else spark.createDataFrame([], rows.schema)


class BucketTable:
    """A table of the latest row of each key, in buckets by hash of the keys.

    A batch writes a new version of the buckets that it touches (`data/v=<batch>/bucket=<b>`), then a manifest of the version
    of every bucket (`manifest/v=<batch>`), which makes it visible. Manifests but the last KEPT, and data that none of them names,
    are removed, so the table has at most KEPT files a bucket however many batches there were. A batch that runs
    again, or one that broke off after its data, starts from the manifest before it and leaves the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _list(self, folder: str) -> dict[int, object]:
        """Numbers and paths of the folders v=<number>."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        where = at.getFileSystem(conf)
        found = [s.getPath() for s in where.listStatus(at)] if where.exists(at) else []
        # A manifest counts once its job has ended.
        ended = lambda p: folder != "manifest" or where.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return {int(p.getName()[2:]): p for p in found if p.getName().startswith("v=") and ended(p)}

    def _remove(self, path: object) -> None:
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """{bucket: version}, of the newest manifest (before a batch); at most as many as buckets."""
        numbers = [n for n in self._list("manifest") if before is None or n < before]
        if not numbers:
            return {}
        return dict(map(tuple, self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v={max(numbers)}").collect()))

    def _rows(self, live: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(live.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def merge(self, batch: DataFrame, number: int, sequence: str) -> None:
        at = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        live = self.manifest(number)
        touched = {r[0] for r in batch.select(at.alias("b")).distinct().collect()}
        old = self._rows({b: v for b, v in live.items() if b in touched}).select(*batch.columns)
        new = latest(old.unionByName(batch), self.keys, sequence).select(*batch.columns, at.alias("bucket"))
        if touched:
            new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        live |= {b: number for b in touched}
        self.spark.createDataFrame(sorted(live.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        batch.unpersist()
        self._compact()

    def _compact(self) -> None:
        manifests = self._list("manifest")
        kept = sorted(manifests)[-KEPT:]
        named = {(b, v) for n in kept for b, v in self.manifest(n + 1).items()}
        for n in set(manifests) - set(kept):
            self._remove(manifests[n])
        conf = self.spark._jsc.hadoopConfiguration()
        for v, path in self._list("data").items():
            if v > kept[-1]:
                continue
            folders = {int(s.getPath().getName()[7:]): s.getPath() for s in path.getFileSystem(conf).listStatus(path) if s.getPath().getName().startswith("bucket=")}
            left = {b for b in folders if (b, v) in named}
            for b in set(folders) - left:
                self._remove(folders[b])
            if not left:
                self._remove(path)


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that upsert_into keeps."""
    return BucketTable(spark, path, schema, []).read()


def upsert_into(stream: DataFrame, path: str, keys: list[str], sequence: str, checkpoint: str, buckets: int = 64, mode: str = "append") -> StreamingQuery:
    """Keeps a BucketTable of the row of the largest sequence of each key up to date with a stream; all that is there now."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def merge(batch: DataFrame, number: int) -> None:
        BucketTable(batch.sparkSession, path, schema, keys, buckets).merge(batch, number, sequence)

    query = stream.writeStream.foreachBatch(merge).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
