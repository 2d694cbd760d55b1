"""Nested catalog documents, feeds, keyed state and links."""

from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPECS = "array<struct<label:string,value:string>>"
_OFFER = (
    "struct<storeId:string,price:double,url:string,photo:string,shippingFee:double,points:double,rating:double,reviewCount:int,stock:string,"
    "verified:boolean,listPrice:double,priceOriginal:struct<currency:string,amount:double>,variants:array<struct<label:string,url:string,photo:string>>>"
)
CATALOG = (
    "metros array<struct<id:string,name:string,center:struct<lat:double,lng:double>,zoom:int>>,"
    "regions array<struct<id:string,metro:string,name:string,lat:double,lng:double,infraDays:int>>,"
    "stores array<struct<id:string,name:string,color:string,logo:string,logoImg:string,hubRegion:string,freeShippingThresholdUSD:double,typicalShippingDays:array<int>,shippingNote:string>>,"
    "categories array<struct<id:string,name:string,icon:string,iconImage:string,subcategories:array<struct<id:string,name:string,icon:string>>>>,"
    f"products array<struct<id:string,name:string,brand:string,category:string,subcategory:string,image:string,photo:string,mlQuery:string,specs:{_SPECS},"
    f"reviews:array<struct<author:string,rating:int,comment:string,date:string>>,offers:array<{_OFFER}>,"
    "colorVariants:array<struct<color:string,condition:string,price:double,url:string,photo:string,mlQuery:string>>>>"
)
BRANDS = "name string, category string, description string, url string, logo string"


class CatalogDocument:
    """A catalog document and its flat views. pos keeps the order of the arrays, which settles all ties."""

    def __init__(self, spark: SparkSession, path: str):
        self.document = spark.read.schema(CATALOG).option("multiLine", True).json(path)

    def _list(self, name: str) -> DataFrame:
        return self.document.select(F.posexplode(name).alias("pos", "x")).select("pos", "x.*")

    @property
    def products(self) -> DataFrame:
        return self._list("products")

    @property
    def stores(self) -> DataFrame:
        return self._list("stores")

    @property
    def regions(self) -> DataFrame:
        return self._list("regions")

    @property
    def metros(self) -> DataFrame:
        return self._list("metros")

    @property
    def categories(self) -> DataFrame:
        return self._list("categories")

    @property
    def subcategories(self) -> DataFrame:
        return self.categories.select(F.col("id").alias("category"), F.posexplode("subcategories").alias("pos", "s")).select("category", "pos", "s.*")

    def _of_products(self, name: str) -> DataFrame:
        return self.products.select(F.col("id").alias("product_id"), F.posexplode(name).alias("pos", "x")).select("product_id", "pos", "x.*")

    @property
    def offers(self) -> DataFrame:
        return self._of_products("offers")

    @property
    def reviews(self) -> DataFrame:
        return self._of_products("reviews")

    @property
    def specs(self) -> DataFrame:
        return self._of_products("specs")

    @property
    def color_variants(self) -> DataFrame:
        return self._of_products("colorVariants")


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """The brand directory; empty where there is none."""
    try:
        rows = spark.read.schema("brands array<struct<name:string,category:string,description:string,url:string,logo:string>>").option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], BRANDS)
    return rows.select(F.inline("brands"))


def read_state(spark: SparkSession, path: str, schema: str, default: list | None = None, lines: bool = False) -> DataFrame:
    """A keyed state document, or (lines) the entries that write_state wrote; the default where it is missing or broken."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", not lines).json(path)
    except AnalysisException:
        return spark.createDataFrame(default or [], schema)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def write_state(rows: DataFrame, path: str) -> None:
    """An entry a line."""
    rows.write.mode("overwrite").json(path)


def read_feed(spark: SparkSession, path: str, source: str, sep: str = ";") -> DataFrame:
    """A store's feed as offers. Empty fields fall back to their other names; rows whose price isn't a number go, rows without one are kept at 0."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)

    def first(*names: str, default: str | None = None):
        there = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*there, F.lit(default))

    price = F.trim(first("price", "sale_price", default="0"))
    plain = price.rlike(r"^[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(nan|inf|infinity)$")
    value = F.when(plain, F.regexp_replace(price, "_", "").try_cast("double"))
    offers = raw.select(
        F.lit(source).alias("source"), first("id", default="").alias("source_id"), first("name", "title", default="").alias("name"), first("vendor", default="").alias("brand"), value.alias("price"),
        first("currencyId", default="MXN").alias("currency"), first("url", default="").alias("url"), first("picture", "image_link").alias("picture"), first("barcode").alias("identifier"), first("categoryId", "product_type").alias("category"),
    )
    return offers.where("price is not null")


def read_feeds(spark: SparkSession, feeds: list[str], sep: str = ";") -> DataFrame:
    """Feeds named as path:source, one after the other. pos orders rows by feed and place."""
    parts = [read_feed(spark, *feed.rsplit(":", 1), sep).withColumn("pos", F.lit(k) * F.lit(1 << 53) + F.monotonically_increasing_id()) for k, feed in enumerate(feeds)]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class ListQuery:
    """What a list view shows."""

    category: str | None = None
    subcategory: str | None = None
    query: str = ""
    price_min: float | None = None
    price_max: float | None = None
    include_shipping: bool = False
    brands: frozenset[str] = field(default_factory=frozenset)
    min_rating: float = 0
    exclude_used: bool = False
    magsafe_only: bool = False
    size: str | None = None
    page: int = 1
    sort: str = "relevance"

    @classmethod
    def from_link(cls, link: str, current: "ListQuery | None" = None) -> "ListQuery":
        """Parameters of a deep link `#/c/<category>?sub=..&q=..`. A link with a question mark names all of them; one without keeps those of the current view."""
        path, mark, rest = (urlsplit(link).fragment or link.lstrip("#")).partition("?")
        parts = [unquote(p) for p in path.split("/") if p]
        category = parts[1] if len(parts) > 1 and parts[0] == "c" else None
        if not mark:
            return replace(current or cls(), category=category, page=1)
        given = {k: v[0] for k, v in parse_qs(rest, keep_blank_values=True).items()}
        return cls(category=category, subcategory=given.get("sub") or None, query=given.get("q", "").strip())

    def within(self, brands_in_scope: set[str], sizes_in_scope: set[str], has_magsafe: bool) -> "ListQuery":
        """Without the choices that the category in scope doesn't offer."""
        size = self.size if self.size in sizes_in_scope else None
        return replace(self, brands=self.brands & brands_in_scope, size=size, magsafe_only=self.magsafe_only and has_magsafe)
