"""Keyed state over streams: favourites switched on and off, the newest answer of each request, reviews counted as they come.

State is kept by key in RocksDB under the stream's checkpoint, so a batch reads and writes only the keys that it touches, and a
restart goes on where the stream ended. Outputs are changes (update mode): rows of the touched keys, each with the number of
changes so far as `version`, which BucketTable takes as sequence.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cotejo.streaming.counters import upsert_into

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """A stream takes its settings when it starts; the session's own come back after that."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Toggles(StatefulProcessor):
    """Each row of a key switches it; a batch gives one row a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.times.get()
        n = (held[0] if held is not None else 0) + sum(len(r) for r in rows)
        self.times.update((n,))
        yield pd.DataFrame({"id": [key[0]], "is_on": [n % 2 == 1], "version": [n]})

    def close(self) -> None:
        pass


class NewestAnswer(StatefulProcessor):
    """Rows (id, request, answer): the answer to the largest request number; answers to older requests that come later change nothing and give no row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "request long, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        request, version, answer = (held[0], held[1], None) if held is not None else (None, 0, None)
        for part in rows:
            k = part["request"].idxmax()
            if request is None or part["request"][k] > request:
                request, answer = int(part["request"][k]), part["answer"][k]
        if held is None or request > held[0]:
            self.newest.update((request, version + 1))
            yield pd.DataFrame({"id": [key[0]], "request": [request], "answer": [answer], "version": [version + 1]})

    def close(self) -> None:
        pass


class ReviewNumbers(StatefulProcessor):
    """Rows (id, event_id, rating): each with the number of its product's reviews up to it, in order of event_id within a batch; newest first is by falling number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.count.get()
        n, out = held[0] if held is not None else 0, pd.concat(list(rows)).sort_values("event_id")
        out["number"] = range(n + 1, n + len(out) + 1)
        self.count.update((n + len(out),))
        yield out[["id", "event_id", "rating", "number"]]

    def close(self) -> None:
        pass


def toggles(log: DataFrame) -> DataFrame:
    """log (id long) -> (id, is_on, version), the keys of each batch."""
    return log.groupBy("id").transformWithStateInPandas(Toggles(), "id long, is_on boolean, version long", "Update", "None")


def newest_answers(answers: DataFrame) -> DataFrame:
    """answers (id long, request long, answer string) -> (id, request, answer, version), the keys whose newest answer a batch changes."""
    return answers.groupBy("id").transformWithStateInPandas(NewestAnswer(), "id long, request long, answer string, version long", "Update", "None")


def review_numbers(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("id").transformWithStateInPandas(ReviewNumbers(), "id long, event_id long, rating int, number long", "Append", "None")


def keep_latest(changes: DataFrame, folder: str, keys: tuple[str, ...] = ("id",), sequence: str = "version", mode: str = "update") -> StreamingQuery:
    """Changes as a BucketTable under folder/table, with their checkpoint beside it; all that is there now."""
    with rocksdb(changes.sparkSession):
        return upsert_into(changes, f"{folder}/table", list(keys), sequence, f"{folder}/checkpoint", mode=mode)
