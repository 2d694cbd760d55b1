"""Bounded samples of labelled rows, found without a shuffle of texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that a sample can have; what is sent to every task is bounded by it.
MOST_CLASSES = 1000


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def bounded_by_class(rows: DataFrame, class_col: str, id_col: str, most: int) -> DataFrame:
    """About `most` rows of each class at most, by a hash of the id; the same for each run.

    The rows are counted by class, and the counts, a row a class, meet them by broadcast: rows stay where they are.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} classes in {class_col}")
    table = rows.sparkSession.createDataFrame(list(counts.items()), rows.select(F.col(class_col).alias("class_of")).schema.add("many", "long"))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000))
    return rows.join(F.broadcast(table), F.col(class_col) == F.col("class_of")).where(drawn * F.col("many") < F.lit(most * 1_000_000)).drop("class_of", "many")


def labelled_texts(texts: DataFrame, labels: DataFrame, class_col: str, most: int) -> list[tuple[bool, str]]:
    """Sorted (class, text) of about `most` documents of each of two classes; texts (doc_id, text), labels (doc_id, class_col boolean).

    The drawn ids are counted and sent to the texts. An id that stands several times counts once, with its least text.
    """
    drawn = bounded_by_class(labels, class_col, "doc_id", most)
    n = drawn.count()
    # Twice the expected number is out of reach of the hash; more would be another error.
    if n > 4 * most + 1000:
        raise ValueError(f"{n} ids drawn where {2 * most} were expected")
    met = texts.where("text is not null").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct(class_col, "text")).alias("r"))
    return sorted((r[0], r[1]) for r in met.select("r.*").collect())
