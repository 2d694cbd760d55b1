"""Lists of products: aggregates, facets, search, order and pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import pricing
from cotejo.operators import popularity
from cotejo.operators.ordering import in_order, sorted_join
from cotejo.sources.catalog import ListQuery

PAGE = 60


def first_spec(specs: Column, label: str) -> Column:
    return F.get(F.filter(specs, lambda s: s["label"] == label), F.lit(0))["value"]


def has_spec(specs: Column, label: str, pattern: str) -> Column:
    return F.coalesce(F.exists(specs, lambda s: (s["label"] == label) & s["value"].rlike(pattern)), F.lit(False))


def is_used(specs: Column, with_refurbished: bool = True) -> Column:
    """Used or refurbished; report pages leave refurbished out."""
    return has_spec(specs, "Condición", "(?iu)preowned|usado" + ("|reacondicionad" if with_refurbished else ""))


def is_magsafe(specs: Column) -> Column:
    return has_spec(specs, "MagSafe", "(?iu)s[ií]")


def is_commercial(specs: Column) -> Column:
    return F.coalesce(first_spec(specs, "Uso").rlike("(?iu)comercial|industrial"), F.lit(False))


def condition_badge(specs: Column) -> Column:
    value = first_spec(specs, "Condición")
    return F.when(value.rlike("(?iu)reacondicionad"), "refurbished").when(value.rlike("(?iu)preowned|usado"), "used")


def product_metrics(products: DataFrame, offers: DataFrame, include_shipping: bool = False) -> DataFrame:
    """products with min_price, offer_count, rating (weighted by reviews; null ratings weigh as 0), review_count, and price and list price of the cheapest offer (the first of equals)."""
    shown = pricing.display_price(F.col("price"), F.coalesce("fee", F.lit(0.0)), include_shipping)
    listed = pricing.display_price(F.col("list_price"), F.coalesce("fee", F.lit(0.0)), include_shipping)
    per = offers.withColumn("shown", shown).withColumn("listed", listed).groupBy("id").agg(
        F.min("shown").alias("min_price"), F.count(F.lit(1)).alias("offer_count"), F.sum("review_count").alias("review_count"),
        F.sum(F.coalesce("rating", F.lit(0.0)) * F.col("review_count")).alias("points"), F.min_by(F.struct("shown", "listed", "store_id"), F.struct("shown", "store_id")).alias("best"),
    )
    rating = F.when(F.col("review_count") > 0, F.col("points") / F.col("review_count")).otherwise(0.0)
    per = per.select("id", "min_price", "offer_count", "review_count", rating.alias("rating"), F.col("best.store_id").alias("best_store"), pricing.discount_pct(F.col("best.shown"), F.col("best.listed")).alias("discount_pct"), F.when(F.col("best.listed") > F.col("best.shown"), F.col("best.listed") - F.col("best.shown")).alias("savings"))
    return sorted_join(products, per, "id")


def matches(query: ListQuery) -> Column:
    """The condition of a list view on rows of product_metrics with used, magsafe and size_label where asked for."""
    found = F.lit(True)
    if query.query:
        word = F.lit(query.query.lower())
        found = F.contains(F.lower("name"), word) | F.contains(F.lower("brand"), word) | F.contains(F.lower("category"), word)
    if query.category is not None:
        found &= F.col("category") == query.category
    if query.subcategory is not None:
        found &= F.col("subcategory") == query.subcategory
    if query.price_min is not None:
        found &= F.col("min_price") >= query.price_min
    if query.price_max is not None:
        found &= F.col("min_price") <= query.price_max
    if query.brands:
        found &= F.col("brand").isin(sorted(query.brands))
    if query.min_rating:
        found &= pricing.half_up(F.col("rating") * 10) / 10 >= query.min_rating
    if query.exclude_used:
        found &= ~F.col("used")
    if query.magsafe_only:
        found &= F.col("magsafe")
    if query.size is not None:
        found &= F.col("size_label") == query.size
    return found


def ordering(sort: str) -> list[Column]:
    keys = {"relevance": [], "popularity": [F.desc("popularity")], "price_asc": [F.asc("min_price")], "price_desc": [F.desc("min_price")], "rating": [F.desc("rating")]}
    return [*keys[sort], F.asc("pos")]


def search(rows: DataFrame, query: ListQuery) -> DataFrame:
    return rows.where(matches(query)).orderBy(*ordering(query.sort))


def page_count(rows: int, size: int = PAGE) -> int:
    return max(1, -(-rows // size))


def page(rows: DataFrame, query: ListQuery, size: int = PAGE) -> DataFrame:
    """One page of the search, clamped to those there are, with rank over the whole list. It sorts up to the page's end: for deep pages, or many, see RankedList."""
    found = rows.where(matches(query))
    number = min(max(1, query.page), page_count(found.count(), size))
    cut = found.orderBy(*ordering(query.sort)).offset((number - 1) * size).limit(size)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*ordering(query.sort))) + (number - 1) * size)


class RankedList:
    """A search's whole list, written once in order, of which any page is read from one or two of its range partitions.

    Making it sorts all rows once, over all tasks; only a count for each partition comes to the driver.
    """

    def __init__(self, rows: DataFrame, query: ListQuery, size: int = PAGE):
        self.size, self.rows = size, in_order(rows.where(matches(query)), ordering(query.sort), "ranked-list")
        self.pieces, self.total = [], 0
        for piece, n in sorted(self.rows.groupBy("piece").count().collect()):
            self.pieces.append((piece, self.total, self.total + n))
            self.total += n

    @property
    def pages(self) -> int:
        return page_count(self.total, self.size)

    def page(self, number: int) -> DataFrame:
        """The page with ranks over the whole list, clamped to those there are; in order of rank. Filters on piece and place keep all files but its own from being read."""
        low = (min(max(1, number), self.pages) - 1) * self.size
        first, none = F.lit(None).cast("long"), F.lit(False)
        for piece, start, end in self.pieces:
            if start < low + self.size and end > low:
                first = F.when(F.col("piece") == piece, F.lit(start)).otherwise(first)
                none |= (F.col("piece") == piece) & F.col("place").between(low - start, low + self.size - 1 - start)
        cut = self.rows.where(none).withColumn("rank", (F.col("place") + first + 1).cast("int"))
        return cut.drop("piece", "place").orderBy("rank")


def pagination(rows: int, page: int, size: int = PAGE) -> dict:
    """The page shown, how many there are, and the ranks on it."""
    pages = page_count(rows, size)
    number = min(max(1, page), pages)
    return {"page": number, "pages": pages, "first": min(rows, (number - 1) * size + 1), "last": min(rows, number * size), "has_previous": number > 1, "has_next": number < pages}


def list_rows(ranked: DataFrame, sort: str = "relevance") -> DataFrame:
    """What a list shows of each product: rank and medal (by popularity only), stars, "from" price, discount and offers; badges and swatches where specs and colors are there."""
    medal = popularity.medal(F.col("rank")) if sort == "popularity" else F.lit(None).cast("string")
    shown = [F.col("rank"), medal.alias("medal"), F.col("id"), F.col("name"), pricing.stars(F.col("rating")).alias("stars"), F.col("review_count"), pricing.money(F.col("min_price")).alias("from_price"), F.col("discount_pct"), F.col("offer_count")]
    if "specs" in ranked.columns:
        shown += [condition_badge(F.col("specs")).alias("condition"), is_commercial(F.col("specs")).alias("commercial")]
    if "colors" in ranked.columns:
        shown.append(swatches(F.col("colors")).alias("swatches"))
    return ranked.select(*shown)


def option_counts(offers: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, options, variants): the larger of a product's numbers of offers and of colour variants, and the most variants that one of its offers has."""
    none = F.lit(0).cast("long")
    n = offers.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumns({"colors": none, "variants": none})
    per = variants.groupBy("id", "store_id").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(none.alias("n"), F.sum("k").alias("colors"), F.max("k").alias("variants"))
    both = n.unionByName(per).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "colors", "variants")))
    return both.select("id", F.greatest("n", "colors").alias("options"), "variants")


def facet_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows for each value and, with a null value, for all."""
    return rows.rollup(column).agg(F.count(F.lit(1)).alias("n"))


def browser_order(word: Column) -> Column:
    """Sorts as browsers do, by UTF-16 code units: letters beyond the basic plane come before those from U+E000 on, while by code point they come last."""
    return F.encode(word, "UTF-16BE")


def brands_in_scope(rows: DataFrame, typed: str = "", as_browser: bool = False) -> DataFrame:
    """Distinct brands that contain what was typed, by code point or as a browser lists them."""
    brands = rows.select("brand").where("brand is not null and brand <> ''").distinct()
    found = brands.where(F.contains(F.lower("brand"), F.lit(typed.lower()))) if typed else brands
    return found.orderBy(browser_order(F.col("brand")) if as_browser else F.col("brand"))


def brand_categories(brands: DataFrame) -> DataFrame:
    """The categories of the brand directory, in order."""
    return brands.select("category").where("category is not null and category <> ''").distinct().orderBy("category")


def brands_of_category(brands: DataFrame, category: str | None) -> DataFrame:
    """The brand directory's entries of a category; all of them for none."""
    return brands if category is None else brands.where(F.col("category") == category)


def price_scope(rows: DataFrame) -> DataFrame:
    """Whole bounds of the slider for the category in scope; 0 and 1000 where nothing is."""
    bounds = rows.agg(F.floor(F.min("min_price")).alias("low"), F.ceil(F.max("min_price")).alias("top"))
    low, high = F.coalesce("low", F.lit(0)), F.coalesce(F.greatest(F.col("top"), F.col("low") + 1), F.lit(1000))
    return bounds.select(low.alias("low"), high.alias("high")).select("low", "high", pricing.slider_bounds(F.col("low"), F.col("high")).alias("slider")).select("low", "high", F.col("slider.step").alias("step"), F.col("slider.low").alias("slider_low"), F.col("slider.high").alias("slider_high"))


def swatches(colors: Column, shown: int = 6) -> Column:
    distinct = F.array_distinct(F.filter(colors, lambda c: c.isNotNull()))
    return F.struct(F.slice(distinct, 1, shown).alias("colors"), F.greatest(F.size(distinct) - shown, F.lit(0)).alias("more"))
