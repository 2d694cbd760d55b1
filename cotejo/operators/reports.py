"""Models of report pages, structured data and the site map."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import pricing, text
from cotejo.operators.ordering import ranked, sorted_join

CAP, RELATED = 100, 4


def related_products(rows: DataFrame, n: int = RELATED) -> DataFrame:
    """The n products of the same category nearest in price, by absolute difference and then place.

    In order of price the nearest are among the neighbours on both sides. With ties in
    distance the place decides, so products of equal price count as one neighbour: of a price, its first n + 1 products by place suffice.
    """
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("category", "min_price").orderBy("pos"))).where(F.col("k") <= n + 1)
    prices = first.groupBy("category", "min_price").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("here"))
    by_price = Window.partitionBy("category").orderBy("min_price").rowsBetween(-n, n)
    near = prices.withColumn("near", F.collect_list(F.struct("min_price", "here")).over(by_price)).select("category", "min_price", F.explode("near").alias("p")).select("category", "min_price", F.col("p.min_price").alias("other_price"), F.explode("p.here").alias("o"))
    pairs = rows.select("id", "category", "min_price").join(near, ["category", "min_price"]).where("id <> o.id")
    order = Window.partitionBy("id").orderBy(F.abs(F.col("min_price") - F.col("other_price")), "o.pos")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("id", "rank", F.col("o.id").alias("related_id"))


def category_report(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Each category's products by number of reviews, capped, with the count of all ("n of m")."""
    of = Window.partitionBy("category")
    return rows.withColumn("total", F.count(F.lit(1)).over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("review_count"), "pos"))).where(F.col("rank") <= cap)


def report_offers(offers: DataFrame) -> DataFrame:
    """Offers of each product by raw price, with rank and a mark on the cheapest."""
    of = Window.partitionBy("id")
    return offers.withColumn("rank", F.row_number().over(of.orderBy("price", "store_id"))).withColumn("cheapest", F.min("price").over(of) == F.col("price"))


def category_description(rows: DataFrame) -> DataFrame:
    brands = F.array_join(F.array_sort(F.collect_set("brand")), ", ")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), brands.alias("brands")).withColumn("description", F.concat(text.plural(F.col("n"), "producto", "productos"), F.lit(" de "), F.col("brands")))


def _sums() -> list[Column]:
    """What a product's structured data tell of all its offers."""
    return [F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("review_count").alias("reviews"), F.sum(F.coalesce("rating", F.lit(0.0)) * F.col("review_count")).alias("points")]


def _offer(x: Column) -> Column:
    """A schema.org Offer; x: struct(price, stock, store)."""
    return F.struct(F.lit("Offer").alias("@type"), x["price"].alias("price"), pricing.availability(x["stock"]).alias("availability"), x["store"].alias("seller"))


def _json_ld(listed: Column) -> Column:
    """A schema.org Product as JSON, over name, brand, _sums() and its offers, by store."""
    rating = F.when(F.col("reviews") > 0, F.struct(F.lit("AggregateRating").alias("@type"), F.bround(F.col("points") / F.col("reviews"), 1).alias("ratingValue"), F.col("reviews").alias("reviewCount")))
    group = F.struct(F.lit("AggregateOffer").alias("@type"), F.lit("MXN").alias("priceCurrency"), F.col("low").alias("lowPrice"), F.col("high").alias("highPrice"), F.col("n").alias("offerCount"), listed.alias("offers"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("name"), F.struct(F.lit("Brand").alias("@type"), F.col("brand").alias("name")).alias("brand"), group.alias("offers"), rating.alias("aggregateRating")))


def product_json_ld(products: DataFrame, offers: DataFrame) -> DataFrame:
    """A schema.org Product as JSON. Ratings only where there are reviews."""
    one = _offer(F.struct("price", "stock", "store"))
    per = offers.groupBy("id").agg(*_sums(), F.array_sort(F.collect_list(F.struct("store_id", one.alias("o")))).alias("list"))
    return sorted_join(products, per, "id").select("id", _json_ld(F.transform("list", lambda x: x["o"])).alias("json_ld"))


def breadcrumb_json_ld(items: Column) -> Column:
    """items: array of struct(name, url). Positions count from 1; the last has no url."""
    last = F.size(items)
    element = lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), F.when(i + 1 < last, x["url"]).alias("item"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.transform(items, element).alias("itemListElement")))


def sitemap(products: DataFrame, categories: DataFrame, base: str = "https://example.org") -> DataFrame:
    """(section, url): home, categories, products."""
    home = products.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(f"{base}/").alias("url"))
    of_categories = categories.select(F.lit(1).alias("section"), F.concat(F.lit(f"{base}/categoria/"), text.slug(F.col("category")), F.lit("/")).alias("url"))
    of_products = products.select(F.lit(2).alias("section"), F.concat(F.lit(f"{base}/producto/"), F.col("id").cast("string"), F.lit("/")).alias("url"))
    return home.unionByName(of_categories).unionByName(of_products)


def product_description(rows: DataFrame) -> DataFrame:
    said = F.concat(text.escape_html(F.col("name")), F.lit(": ofertas en "), text.plural(F.col("offer_count"), "tienda", "tiendas"), F.lit(" desde "), pricing.money(F.col("min_price")))
    return rows.select("id", said.alias("description"))


def today() -> Column:
    """The date that a new review or report carries."""
    return F.current_date()


def in_categories(products: DataFrame, categories: DataFrame) -> DataFrame:
    """products with category_name and subcategory_name; categories: (id, name, subcategories: array of struct(id, name)). An unknown category is an error, an unknown or missing subcategory is null."""
    named = categories.select(F.col("id").alias("category"), F.col("name").alias("category_name"), "subcategories")
    rows = products.join(named, "category", "left")
    rows = rows.where(F.assert_true(F.col("category_name").isNotNull(), F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("(none)")))).isNull())
    sub = F.get(F.filter("subcategories", lambda x: x["id"] == F.col("subcategory")), F.lit(0))["name"]
    return rows.withColumn("subcategory_name", sub).drop("subcategories")


def product_pages(products: DataFrame, offers: DataFrame, base: str = "https://example.org") -> DataFrame:
    """(name, body): the report page of each product with offers, as the file producto/<id>/index.html.

    products: (id, name, brand, category_name, subcategory_name); offers: (id, store_id, price, store, shipping, stock, rating, review_count), all
    listed by price, with their lowest price, number and structured data. A product's offers are gathered once; where they lie dealt out by id, nothing is shuffled.
    Everything that comes from data is escaped; in the JSON block `<` is written as a code.
    """
    cell = lambda x: F.concat(F.lit("<td>"), text.escape_html(x), F.lit("</td>"))
    rated = F.when(F.col("rating").isNull(), "—").otherwise(F.concat(F.col("rating").cast("string"), F.lit(" / 5 ("), F.col("review_count").cast("string"), F.lit(")")))
    row = F.concat(F.lit('<tr class="offer">'), cell(F.col("store")), cell(pricing.money(F.col("price"))), cell(F.coalesce("shipping", F.lit("—"))), cell(pricing.stock_label(F.col("stock"))), cell(rated), F.lit("</tr>"))
    per = offers.groupBy("id").agg(*_sums(), F.collect_list(F.struct("price", "store", row.alias("row"), "store_id", "stock")).alias("list"))
    rows = F.array_join(F.transform(F.array_sort("list"), lambda x: x["row"]), "\n")
    by_store = F.array_sort(F.transform("list", lambda x: F.struct(x["store_id"].alias("store_id"), _offer(x).alias("o"))))
    json_ld = _json_ld(F.transform(by_store, lambda x: x["o"]))
    title, about = text.escape_html(F.col("name")), F.concat(text.escape_html(F.col("name")), F.lit(": ofertas en "), text.plural(F.col("n"), "tienda", "tiendas"), F.lit(" desde "), pricing.money(F.col("low")))
    crumbs = F.concat_ws(" › ", *(text.escape_html(F.col(c)) for c in ("category_name", "subcategory_name", "name")))
    body = F.concat(
        F.lit('<!doctype html>\n<html lang="es"><head><meta charset="utf-8">\n<title>'), title, F.lit('</title>\n<meta name="description" content="'), about,
        F.lit(f'">\n<link rel="canonical" href="{base}/producto/'), F.col("id").cast("string"), F.lit('/">\n<script type="application/ld+json">'), F.replace(json_ld, F.lit("<"), F.lit("\\u003c")),
        F.lit("</script></head>\n<body><nav>"), crumbs, F.lit("</nav><h1>"), title, F.lit("</h1><p>"), text.escape_html(F.col("brand")), F.lit("</p>\n<table>\n"), rows, F.lit("\n</table></body></html>\n"),
    )
    return sorted_join(products, per, "id").select(F.concat(F.lit("producto/"), F.col("id").cast("string"), F.lit("/index.html")).alias("name"), body.alias("body"))


#: Addresses that one file of a site map may hold, and files that its index may.
SITEMAP_URLS = 50_000


def sitemap_files(urls: DataFrame, base: str = "https://example.org", most: int = SITEMAP_URLS) -> DataFrame:
    """(name, body): sitemap-1.xml, ... of up to `most` addresses each, in order of (section, url), and sitemap.xml, their index.

    Addresses are numbered over range partitions; a file is made by the task that has its addresses.
    """
    numbered = ranked(urls, [F.col("section"), F.col("url")], "n", tag="sitemap").withColumn("part", (F.floor(F.col("n") / most) + 1).cast("int"))
    entry = F.concat(F.lit("<url><loc>"), text.escape_html(F.col("url")), F.lit("</loc></url>"))
    whole = lambda tag, inner: F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), inner, F.lit(f"\n</{tag}>\n"))
    per = numbered.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]), "\n").alias("entries"))
    parts = per.select(F.concat(F.lit("sitemap-"), F.col("part").cast("string"), F.lit(".xml")).alias("name"), whole("urlset", F.col("entries")).alias("body"))
    listed = numbered.select("part").distinct().groupBy().agg(F.array_sort(F.collect_list("part")).alias("parts"))
    listed = listed.where(F.assert_true(F.size("parts") <= SITEMAP_URLS, F.lit("too many addresses for one index")).isNull())
    links = F.array_join(F.transform("parts", lambda p: F.concat(F.lit(f"<sitemap><loc>{base}/sitemap-"), p.cast("string"), F.lit(".xml</loc></sitemap>"))), "\n")
    return parts.unionByName(listed.select(F.lit("sitemap.xml").alias("name"), whole("sitemapindex", links).alias("body")))


def write_reports(models: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """A model's JSON for each key, in `buckets` folders by hash of the key."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    models.select(bucket, F.col(key), F.to_json(F.struct(*[c for c in models.columns if c != key])).alias("value")).write.partitionBy("bucket").mode("overwrite").json(path)
