"""Counters, favourites, reviews and popularity."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(events: DataFrame, key: str = "id") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def star_points(reviews: DataFrame) -> DataFrame:
    points = F.when(F.col("rating") == 5, 10).when(F.col("rating") == 4, 8).when(F.col("rating") == 3, 6).otherwise(0)
    return reviews.groupBy("id").agg(F.sum(points).alias("star_points"))


def popularity(products: DataFrame, clicks: DataFrame, views: DataFrame, reviews: DataFrame) -> DataFrame:
    """products with popularity = 3 clicks + views + star points; products without any count 0."""
    rows = products
    for part in (counters(clicks).withColumnRenamed("n", "clicks"), counters(views).withColumnRenamed("n", "views"), star_points(reviews)):
        rows = rows.join(part, "id", "left")
    zero = F.lit(0)
    return rows.withColumns({c: F.coalesce(c, zero) for c in ("clicks", "views", "star_points")}).withColumn("popularity", 3 * F.col("clicks") + F.col("views") + F.col("star_points"))


def ranked(rows: DataFrame, partition: str | None = None) -> DataFrame:
    over = Window.partitionBy(partition) if partition else Window.partitionBy()
    return rows.withColumn("rank", F.row_number().over(over.orderBy(F.desc("popularity"), "pos")))


def medal(rank: Column) -> Column:
    return F.when(rank == 1, "crown").when(rank == 2, "gold").when(rank == 3, "silver").when(rank == 4, "bronze")


def top_per_category(rows: DataFrame, n: int) -> DataFrame:
    return ranked(rows.where(~F.col("used")), "category").where(F.col("rank") <= n)


def category_counts(categories: DataFrame, products: DataFrame) -> DataFrame:
    counts = products.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_clicked(clicks: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """The most clicked keys that still exist."""
    return counters(clicks).join(known.select("id", "pos"), "id").orderBy(F.desc("n"), "pos").limit(n)


def favorites(products: DataFrame, chosen: DataFrame) -> DataFrame:
    """In the catalog's order."""
    return products.join(chosen.select("id"), "id", "left_semi")


def toggled(log: DataFrame) -> DataFrame:
    """Keys that are on after a log of toggles."""
    return log.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("id")


def all_reviews(own: DataFrame, catalog: DataFrame) -> DataFrame:
    """A user's own reviews, newest first, then the catalog's."""
    return own.withColumn("part", F.lit(0)).unionByName(catalog.withColumn("part", F.lit(1)), allowMissingColumns=True)


def account_summary(chosen: DataFrame, own_reviews: DataFrame) -> DataFrame:
    return chosen.agg(F.count(F.lit(1)).alias("favorites")).join(own_reviews.agg(F.count(F.lit(1)).alias("reviews")))


def home_rankings(rows: DataFrame, n: int = 3, other: str = "Otros") -> DataFrame:
    """The n products of most popularity in each of the three largest categories, and over all."""
    largest = rows.where(F.col("category") != other).groupBy("category").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "category").limit(3)
    blocks = top_per_category(rows, n).join(largest, "category", "left_semi").select(F.col("category").alias("block"), "rank", "id")
    overall = rows.where(~F.col("used")).orderBy(F.desc("popularity"), "pos").limit(n)
    overall = ranked(overall).select(F.lit(None).cast("string").alias("block"), "rank", "id")
    return blocks.unionByName(overall)
