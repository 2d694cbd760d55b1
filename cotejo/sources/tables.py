"""The catalog's views over the star-schema tables, and the same views in SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines that one task holds the distinct keys of.
PIECE = 500_000


class Catalog:
    """Views product, store, region, offer, review, click and view_event of a folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table dealt out by key to all tasks, for work that costs much more than a row's bytes: a small file of many rows is read by one or two."""
        return self.table(name).repartition(key)

    @property
    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
            F.when(size <= 17, "low").when(size <= 34, "mid").otherwise("high").alias("subcategory"), F.when(size % 3 == 0, "S").when(size % 3 == 1, "M").otherwise("L").alias("size_label"), (size % 7 == 0).alias("used"),
        )

    @property
    def stores(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(key.alias("store_id"), F.col("s_name").alias("store"), F.when(key % 3 != 0, F.col("s_nationkey")).alias("hub"), F.when(key % 2 == 0, F.lit(30000.0)).alias("threshold"))

    @property
    def regions(self) -> DataFrame:
        n, m = F.col("n_nationkey"), F.col("n_regionkey")
        lat = F.lit(15.0) + F.lit(3.0) * m + F.lit(0.05) * F.floor(n / 5)
        lng = F.lit(-115.0) + F.lit(6.0) * m + F.lit(0.1) * F.floor(n / 5)
        return self.table("nation").select(n.alias("region"), m.alias("metro"), F.col("n_name").alias("region_name"), lat.alias("lat"), lng.alias("lng"), (n % 3).alias("infra"))

    @property
    def offers(self) -> DataFrame:
        return self._offers(self.table("lineitem"))

    @property
    def offer_keys(self) -> DataFrame:
        """(id, store_id) of offers, dealt out by id in pieces of about PIECE lines."""
        lines = self.table("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("store_id"))
        return lines.repartition(max(1, -(-lines.count() // PIECE)), "id").distinct()

    @property
    def dealt_offers(self) -> DataFrame:
        """The offers, dealt out by id in pieces of about PIECE lines: the newest are found, and a product's gathered, where they lie."""
        lines = self.table("lineitem")
        return self._offers(lines.repartition(max(self.spark.sparkContext.defaultParallelism, -(-lines.count() // PIECE)), "l_partkey"))

    def offers_of(self, products: DataFrame) -> DataFrame:
        """The offers of some products only: others don't come to be sorted for their newest."""
        return self._offers(self.table("lineitem").join(products.select(F.col("id").alias("l_partkey")), "l_partkey", "left_semi"))

    def _offers(self, lines: DataFrame) -> DataFrame:
        newest = Window.partitionBy("l_partkey", "l_suppkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
        rows = lines.withColumn("rank", F.row_number().over(newest)).where("rank = 1")
        tax = F.col("l_tax")
        return rows.select(
            F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("store_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"), F.col("l_extendedprice").alias("list_price"),
            F.when(tax < 0.03, F.lit(0.0)).when(tax < 0.06, F.lit(99.0)).alias("fee"), F.when(F.col("l_linenumber") != 7, 1 + (F.col("l_orderkey") % 9) * F.lit(0.5)).alias("rating"),
            F.col("l_quantity").cast("long").alias("review_count"),
            F.when((F.col("l_returnflag") == "A"), "in_stock").when(F.col("l_returnflag") == "R", "low_stock").when(F.col("l_linestatus") == "O", "backorder").alias("stock"), (F.col("l_linestatus") == "O").alias("verified"),
        )

    def events(self, kind: str) -> DataFrame:
        rows = self.table("events").where(F.col("event_type") == kind)
        return rows.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("id"))

    @property
    def reviews(self) -> DataFrame:
        return self.events("purchase").select("id", (1 + F.col("event_id") % 5).cast("int").alias("rating"))


#: The views as common table expressions.
VIEWS_SQL = """
WITH product AS (SELECT p_partkey AS id, p_partkey AS pos, p_name AS name, p_brand AS brand, p_type AS category,
  CASE WHEN p_size <= 17 THEN 'low' WHEN p_size <= 34 THEN 'mid' ELSE 'high' END AS subcategory,
  CASE p_size % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS size_label, p_size % 7 = 0 AS used FROM part),
store AS (SELECT s_suppkey AS store_id, s_name AS store, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS hub, CASE WHEN s_suppkey % 2 = 0 THEN 30000e0 END AS threshold FROM supplier),
place AS (SELECT n_nationkey AS region, n_regionkey AS metro, n_name AS region_name, 15e0 + 3e0 * n_regionkey + 0.05e0 * (n_nationkey // 5) AS lat,
  -115e0 + 6e0 * n_regionkey + 0.1e0 * (n_nationkey // 5) AS lng, n_nationkey % 3 AS infra FROM nation),
newest AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rank FROM lineitem),
offer AS (SELECT l_partkey AS id, l_suppkey AS store_id, l_extendedprice * (1 - l_discount) AS price, l_extendedprice AS list_price,
  CASE WHEN l_tax < 0.03e0 THEN 0e0 WHEN l_tax < 0.06e0 THEN 99e0 END AS fee, CASE WHEN l_linenumber <> 7 THEN 1 + (l_orderkey % 9) * 0.5e0 END AS rating,
  CAST(l_quantity AS BIGINT) AS review_count,
  CASE WHEN l_returnflag = 'A' THEN 'in_stock' WHEN l_returnflag = 'R' THEN 'low_stock' WHEN l_linestatus = 'O' THEN 'backorder' END AS stock, l_linestatus = 'O' AS verified FROM newest WHERE rank = 1),
event AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events),
review AS (SELECT id, CAST(1 + event_id % 5 AS INT) AS rating FROM event WHERE event_type = 'purchase')
"""
