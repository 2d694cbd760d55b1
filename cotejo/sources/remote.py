"""A paged remote catalog as a Spark data source: a partition asks for a page, or of many pages for a run of them; filters decide which pages are asked for.

`register(spark)` makes the format `paged_catalog` known. Options: path (an http(s) address, or a folder of saved
answers), page_size (20), token (sent as bearer). An answer is a JSON document
`{"status": 200, "paging": {"total": n}, "results": [{"id", "title", "price", "currency_id"}, ...]}`; at an address it is asked for as
`<path>/<domain>?offset=<n>&limit=<page_size>`, in a folder it is the file `<domain>/<offset>.json`.
"""

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "domain string, pos long, id string, title string, price double, currency string, total long"
_LAST = (1 << 63) - 1
#: Partitions of a domain, at most: beyond so many pages each asks for several.
RUNS = 100


class RemoteError(RuntimeError):
    """An answer other than 2xx."""


def get_json(path: str, domain: str, offset: int, limit: int, token: str | None, timeout: float = 30.0) -> dict:
    """One page of a domain. A missing page or any status but 2xx is a RemoteError."""
    if path.startswith(("http://", "https://")):
        url = f"{path.rstrip('/')}/{urllib.parse.quote(domain)}?{urllib.parse.urlencode({'offset': offset, 'limit': limit})}"
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise RemoteError(f"{e.code} for {domain} at {offset}") from e
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path)
    try:
        with where.open_input_stream(f"{base}/{domain}/{offset}.json") as f:
            found = json.loads(f.read())
    except FileNotFoundError as e:
        raise RemoteError(f"404 for {domain} at {offset}") from e
    if not 200 <= found.get("status", 200) < 300:
        raise RemoteError(f"{found['status']} for {domain} at {offset}")
    return found


def domains_of(path: str) -> list[str]:
    """Domains of a folder of saved answers."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path)
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and f.base_name[0] not in "_.")


@dataclass
class Pages(InputPartition):
    """The pages of a domain from an offset up to another."""

    domain: str
    first: int
    end: int


class PagedReader(DataSourceReader):
    """domain = and IN, and bounds of pos, choose pages and rows; Spark tests all other filters."""

    def __init__(self, options: dict):
        self.path, self.token = options["path"], options.get("token")
        self.size = int(options.get("page_size", 20))
        self.domains: set[str] | None = set(options["domain"].split(",")) if "domain" in options else None
        self.least, self.most = 0, _LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("domain",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.domains = wanted if self.domains is None else self.domains & wanted
            elif isinstance(f, EqualTo) and f.attribute == ("pos",):
                self.least, self.most = max(self.least, f.value), min(self.most, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("pos",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and f.attribute in (("domain",), ("pos",))):
                yield f

    def partitions(self) -> list[Pages]:
        """The first page of each domain tells how many there are."""
        if self.domains is None and self.path.startswith("http"):
            raise ValueError("name the domains of a remote catalog, by a filter or the option domain")
        pages = []
        for domain in sorted(domains_of(self.path) if self.domains is None else self.domains):
            total = get_json(self.path, domain, 0, self.size, self.token)["paging"]["total"]
            first, end = self.least // self.size * self.size, min(total, self.most + 1)
            run = self.size * max(1, -(-(end - first) // (self.size * RUNS)))
            pages += [Pages(domain, at, min(at + run, end)) for at in range(first, end, run)]
        return pages

    def read(self, pages: Pages | None) -> Iterator[tuple]:
        if pages is None:  # no partitions at all
            return
        for offset in range(pages.first, pages.end, self.size):
            answer = get_json(self.path, pages.domain, offset, self.size, self.token)
            for pos, x in enumerate(answer["results"], offset):
                if self.least <= pos <= self.most:
                    price = x.get("price")
                    yield pages.domain, pos, x.get("id"), x.get("title"), None if price is None else float(price), x.get("currency_id"), answer["paging"]["total"]


class PagedCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets Python sources take its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCatalog)


def walk(spark: SparkSession, path: str, domain: str, offset: int = 0, limit: int = 20, page_size: int = 20, token: str | None = None) -> DataFrame:
    """`limit` items of a domain from an offset on (a negative one counts as 0); only the pages that hold them are read."""
    register(spark)
    options = {"path": path, "page_size": str(page_size), **({"token": token} if token else {})}
    first = max(0, offset)
    return spark.read.format("paged_catalog").options(**options).load().where(f"pos >= {first} and pos < {first + limit}").where(F.col("domain") == domain)


def search(spark: SparkSession, path: str, words: str, domains: list[str], limit: int = 24, page_size: int = 20, token: str | None = None) -> DataFrame:
    """Items of some domains whose title has all words, whatever their case; of each domain the first `limit`."""
    register(spark)
    options = {"path": path, "page_size": str(page_size), "domain": ",".join(domains), **({"token": token} if token else {})}
    rows = spark.read.format("paged_catalog").options(**options).load()
    for word in words.lower().split():
        rows = rows.where(F.contains(F.lower("title"), F.lit(word)))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).where(F.col("k") <= limit).drop("k")

