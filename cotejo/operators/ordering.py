"""Global and grouped order of tables of any size: range partitions, totals of each, offsets added.

A window without partitioning, or one over a group that holds a third of all rows, sorts its rows in one task.
Here rows are dealt out by range of their order, so that a group may span any number of partitions;
each partition is numbered on its own, and what stands before it comes from a table of a row for each
group and partition.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources.written import durable

#: monotonically_increasing_id holds the row's number within its partition in so many low bits.
_ROWS = (1 << 33) - 1


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: always by sorting. Their files pack so well that a million rows look small enough to Spark for a broadcast, which the driver would have to hold."""
    return left.join(right.hint("merge"), on, how)


def in_order(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df written in order, with piece (its range partition) and place (from 0 within the piece)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(dealt.withColumn("piece", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))), tag)


def _before(pieces: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Totals of a group's earlier pieces. A group has at most as many rows here as there are partitions."""
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumns({v: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values})


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str, tag: str = "order") -> DataFrame:
    """df with the place of each row within its group (from 0), by order; rows equal in all of order get some order among them. keys: columns without nulls; none: one group."""
    rows = in_order(df, [*map(F.col, keys), *order], tag)
    pieces = rows.groupBy(*keys, "piece").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("before"))
    placed = rows.join(_before(pieces, keys, ["before"]), [*keys, "piece"])
    return placed.withColumn(name, F.col("place") - F.col("first") + F.col("before")).drop("piece", "place", "first", "before")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], values: list[str], tag: str = "order") -> DataFrame:
    """df with v_upto for each value v: its sum over the rows of the group up to each row, itself included."""
    rows = in_order(df, [*map(F.col, keys), *order], tag)
    within = Window.partitionBy(*keys, "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"{v}_before" for v in values]
    pieces = rows.groupBy(*keys, "piece").agg(*(F.sum(v).alias(n) for v, n in zip(values, names)))
    summed = rows.withColumns({f"{v}_upto": F.sum(v).over(within) for v in values}).join(_before(pieces, keys, names), [*keys, "piece"])
    return summed.withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.col(n) for v, n in zip(values, names)}).drop("piece", "place", *names)


def _with_offsets(held: DataFrame, name: str, start: int) -> tuple[DataFrame, int]:
    """One count for each partition comes to the driver and goes back as a table of so many rows."""
    offsets, at = [], start
    for piece, n in sorted(held.groupBy("piece").count().collect()):
        offsets.append((piece, at))
        at += n
    table = held.sparkSession.createDataFrame(offsets, "piece int, offset long")
    return held.join(F.broadcast(table), "piece").withColumn(name, F.col("place") + F.col("offset")).drop("piece", "place", "offset"), at


def numbered(df: DataFrame, name: str, start: int, tag: str = "numbered") -> tuple[DataFrame, int]:
    """df written with numbers start, start + 1, ... without gaps, in no given order, and the number after the last."""
    held = durable(df.withColumn("piece", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))), tag)
    return _with_offsets(held, name, start)


def ranked(df: DataFrame, order: list[Column], name: str, start: int = 0, tag: str = "ranked") -> DataFrame:
    """df written with numbers start, start + 1, ... in order."""
    return _with_offsets(in_order(df, order, tag), name, start)[0]
