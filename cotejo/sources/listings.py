"""Remote catalog pages as a data source, read from saved answers."""

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<id:string,name:string,domain_id:string,pictures:array<struct<url:string,secure_url:string>>,attributes:array<struct<id:string,value_name:string>>,pickers:array<struct<products:array<struct<thumbnail:string,tags:array<string>>>>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Answers of the catalog, one JSON document `{query, domain, offset, results: [..]}` a line, as a row for each item with its place."""
    pages = spark.read.schema(f"query string, domain string, offset long, results array<{ITEM}>").json(path)
    return pages.select("query", "domain", F.coalesce("offset", F.lit(0)).alias("offset"), F.posexplode("results").alias("i", "item")).select("query", "domain", (F.col("offset") + F.col("i")).alias("pos"), "item.*")


def search_pages(pages: DataFrame, limit: int = 24, domain: str | None = None) -> DataFrame:
    rows = pages if domain is None else pages.where(F.col("domain_id") == domain)
    return rows.where(F.col("pos") < limit)


def best_sellers(ids: DataFrame) -> DataFrame:
    return ids.where(F.col("id").rlike(r"^MLM\d+$"))


def walk_domain(pages: DataFrame, domain: str, offset: int = 0, limit: int = 20) -> DataFrame:
    return pages.where(F.col("domain_id") == domain).orderBy("pos").offset(max(0, offset)).limit(limit)


def predicted_domain(queries: DataFrame, model: DataFrame) -> DataFrame:
    """model: (query, domain) rows of a classifier's answers."""
    return queries.join(model, "query", "left")


def parse_answers(raw: Iterator[str]) -> Iterator[dict]:
    """Saved answers one by one; broken ones are left out."""
    for line in raw:
        try:
            yield json.loads(line)
        except ValueError:
            continue
