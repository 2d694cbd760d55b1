"""The catalog's queries over the star-schema tables, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions import pricing, text
from cotejo.operators import catalog, matching, offers, popularity, relevance, reports, variants
from cotejo.operators.ordering import sorted_join
from cotejo.sources.catalog import ListQuery
from cotejo.sources.tables import VIEWS_SQL, Catalog
from cotejo.sources.written import durable, new_folder
from cotejo.streaming import counters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TARGET = 7


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            ORACLES[f.__name__] = VIEWS_SQL.replace("WITH", "WITH RECURSIVE", 1) + sql
        return f

    return register


def r6(name: str):
    return F.round(name, 6).alias(name)


METRICS_SQL = """, best AS (SELECT id, store_id, price, list_price, row_number() OVER (PARTITION BY id ORDER BY price, store_id) AS k FROM offer),
metric AS (SELECT p.*, o.min_price, o.offer_count, o.review_count, CASE WHEN o.review_count > 0 THEN o.points / o.review_count ELSE 0e0 END AS rating, b.store_id AS best_store,
  CASE WHEN b.list_price > b.price THEN CAST(floor((1 - b.price / b.list_price) * 100 + 0.5e0) AS BIGINT) END AS discount_pct, CASE WHEN b.list_price > b.price THEN b.list_price - b.price END AS savings
  FROM product p JOIN (SELECT id, min(price) AS min_price, count(*) AS offer_count, CAST(sum(review_count) AS BIGINT) AS review_count, sum(coalesce(rating, 0e0) * review_count) AS points FROM offer GROUP BY id) o USING (id)
  JOIN best b ON b.id = p.id AND b.k = 1)
"""


def metrics(c: Catalog, category: str | None = None) -> DataFrame:
    """Products with what their offers tell; of a category, only its products' offers are read on."""
    if category is None:
        return catalog.product_metrics(c.products, c.offers)
    products = c.products.where(F.col("category") == category)
    return catalog.product_metrics(products, c.offers_of(products))


@query(METRICS_SQL + "SELECT id, name, round(min_price, 6) AS min_price, offer_count, round(rating, 6) AS rating, discount_pct FROM metric WHERE category = 'ECONOMY' ORDER BY min_price, pos LIMIT 10")
def list_cheapest(c):
    rows = catalog.search(metrics(c, "ECONOMY"), ListQuery(category="ECONOMY", sort="price_asc")).limit(10)
    return rows.select("id", "name", r6("min_price"), "offer_count", r6("rating"), "discount_pct")


@query(METRICS_SQL + "SELECT id, offer_count, review_count, round(rating, 6) AS rating FROM metric")
def weighted_rating(c):
    return metrics(c).select("id", "offer_count", "review_count", r6("rating"))


@query(METRICS_SQL + "SELECT id, best_store, discount_pct, round(savings, 6) AS savings FROM metric")
def best_discount(c):
    return metrics(c).select("id", "best_store", "discount_pct", r6("savings"))


@query(
    METRICS_SQL + """, b AS (SELECT CAST(floor(min(min_price)) AS BIGINT) AS low, greatest(CAST(ceil(max(min_price)) AS BIGINT), CAST(floor(min(min_price)) AS BIGINT) + 1) AS high FROM metric),
s AS (SELECT *, CASE WHEN high - low > 20000 THEN 500 WHEN high - low > 2000 THEN 100 ELSE 10 END AS step FROM b)
SELECT low, high, step, CAST(floor(low / step) * step AS BIGINT) AS slider_low, CAST(ceil(high / step) * step AS BIGINT) AS slider_high FROM s"""
)
def price_bounds(c):
    return catalog.price_scope(metrics(c))


@query("SELECT DISTINCT brand FROM product WHERE brand IS NOT NULL AND brand <> ''")
def facet_brands(c):
    return catalog.brands_in_scope(c.products)


@query("SELECT category, count(*) AS n FROM product GROUP BY ROLLUP (category)")
def facet_counts_rollup(c):
    return catalog.facet_counts(c.products, "category")


SEARCH = ListQuery(query="e", price_min=1000, price_max=60000, min_rating=2, exclude_used=True, size="M", sort="rating")


@query(METRICS_SQL + "SELECT id, name, round(min_price, 6) AS min_price, round(rating, 6) AS rating FROM metric WHERE (contains(lower(name), 'e') OR contains(lower(brand), 'e') OR contains(lower(category), 'e')) AND min_price BETWEEN 1000 AND 60000 AND floor(rating * 10 + 0.5e0) / 10 >= 2 AND NOT used AND size_label = 'M'")
def faceted_search(c):
    return catalog.search(metrics(c), SEARCH).select("id", "name", r6("min_price"), r6("rating"))


@query(METRICS_SQL + "SELECT id, CAST(row_number() OVER (ORDER BY min_price, pos) AS INT) AS rank FROM metric QUALIFY row_number() OVER (ORDER BY min_price, pos) BETWEEN 61 AND 120")
def page_two(c):
    return catalog.page(metrics(c), ListQuery(sort="price_asc", page=2)).select("id", "rank")


ROUTE_SQL = f""", way AS (SELECT h.region AS hub, h.region = t.region AS same_region, h.metro = t.metro AS same_metro, t.infra AS infra_days,
  2 * 6371e0 * asin(sqrt(sin(radians(t.lat - h.lat) / 2) * sin(radians(t.lat - h.lat) / 2) + cos(radians(h.lat)) * cos(radians(t.lat)) * sin(radians(t.lng - h.lng) / 2) * sin(radians(t.lng - h.lng) / 2))) AS km
  FROM place h, place t WHERE t.region = {TARGET}),
line AS (SELECT o.*, s.store, s.hub, s.threshold, w.km, w.same_region, w.same_metro, w.infra_days,
  CASE WHEN km IS NOT NULL THEN least((CASE WHEN same_region THEN 1 WHEN same_metro THEN CASE WHEN km < 15 THEN 1 WHEN km < 40 THEN 2 ELSE 3 END ELSE 3 + floor(km / 500 + 0.5e0) END) + infra_days + CASE WHEN stock = 'backorder' THEN 3 ELSE 0 END, 10) END AS days,
  CASE WHEN km IS NULL OR fee IS NULL OR fee = 0 OR same_region THEN fee ELSE fee + infra_days * 20 + CASE WHEN same_metro THEN 0 ELSE floor(km / 200 + 0.5e0) * 15 END END AS ship_fee
  FROM offer o LEFT JOIN store s USING (store_id) LEFT JOIN way w ON s.hub = w.hub)
"""


@query(ROUTE_SQL + "SELECT hub, same_region, same_metro, round(km, 6) AS km FROM way")
def haversine_matrix(c):
    return offers.routes(c.regions, TARGET).select("hub", "same_region", "same_metro", r6("km"))


@query(ROUTE_SQL + "SELECT id, store_id, CAST(days AS INT) AS days FROM line")
def delivery_days(c):
    return offers.offer_table(c.offers, c.stores, c.regions, TARGET).select("id", "store_id", "days")


@query(ROUTE_SQL + "SELECT id, store_id, round(ship_fee, 6) AS ship_fee FROM line")
def shipping_fee(c):
    return offers.offer_table(c.offers, c.stores, c.regions, TARGET).select("id", "store_id", r6("ship_fee"))


@query(
    ROUTE_SQL + """SELECT id, store_id, store, CAST(row_number() OVER (PARTITION BY id ORDER BY price, store_id) AS INT) AS rank, price = min(price) OVER (PARTITION BY id) AS best_price,
  coalesce(days = min(days) OVER (PARTITION BY id), false) AS fastest, CASE WHEN list_price > price THEN CAST(floor((1 - price / list_price) * 100 + 0.5e0) AS BIGINT) END AS discount_pct, coalesce(verified, false) AS verified,
  CASE WHEN coalesce(price >= threshold, false) THEN true ELSE false END AS free FROM line"""
)
def offer_table(c):
    return offers.offer_table(c.offers, c.stores, c.regions, TARGET).select("id", "store_id", "store", "rank", "best_price", "fastest", "discount_pct", "verified", "free")


@query(
    """, scored AS (SELECT *, 0.4e0 * (1 - CASE WHEN max(price) OVER w - min(price) OVER w > 0 THEN (price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) ELSE 0e0 END)
  + 0.3e0 * (coalesce(rating, 0e0) / 5) + 0.3e0 * CASE WHEN stock = 'in_stock' THEN 1e0 WHEN stock = 'low_stock' OR stock IS NULL THEN 0.5e0 ELSE 0e0 END AS score FROM offer WINDOW w AS (PARTITION BY id)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, store_id) AS k, first_value(store_id) OVER (PARTITION BY id ORDER BY price, store_id) AS cheapest FROM scored)
SELECT id, cheapest, CASE WHEN store_id <> cheapest THEN store_id END AS best_value_store, round(score, 6) AS score FROM r WHERE k = 1"""
)
def best_value(c):
    return offers.best_value(c.offers).select("id", "cheapest", "best_value_store", r6("score"))


POPULAR_SQL = """, popular AS (SELECT p.*, coalesce(c.n, 0) AS clicks, coalesce(v.n, 0) AS views, coalesce(r.s, 0) AS star_points, 3 * coalesce(c.n, 0) + coalesce(v.n, 0) + coalesce(r.s, 0) AS popularity FROM product p
  LEFT JOIN (SELECT id, count(*) AS n FROM event WHERE event_type = 'click' GROUP BY id) c USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM event WHERE event_type = 'view' GROUP BY id) v USING (id)
  LEFT JOIN (SELECT id, CAST(sum(CASE rating WHEN 5 THEN 10 WHEN 4 THEN 8 WHEN 3 THEN 6 ELSE 0 END) AS BIGINT) AS s FROM review GROUP BY id) r USING (id))
"""


def popular(c: Catalog) -> DataFrame:
    return popularity.popularity(c.products, c.events("click"), c.events("view"), c.reviews)


@query(POPULAR_SQL + "SELECT id, clicks, views, star_points, popularity, CAST(row_number() OVER (ORDER BY popularity DESC, pos) AS INT) AS rank FROM popular ORDER BY popularity DESC, pos LIMIT 60")
def popularity_rank(c):
    top = popular(c).orderBy(F.desc("popularity"), "pos").limit(60)
    return popularity.ranked(top).select("id", "clicks", "views", "star_points", "popularity", "rank")


@query(POPULAR_SQL + "SELECT category, id, CAST(row_number() OVER (PARTITION BY category ORDER BY popularity DESC, pos) AS INT) AS rank FROM popular WHERE NOT used QUALIFY row_number() OVER (PARTITION BY category ORDER BY popularity DESC, pos) <= 3")
def top3_per_category(c):
    return popularity.top_per_category(popular(c), 3).select("category", "id", "rank")


@query("SELECT p.id, e.n FROM (SELECT id, count(*) AS n FROM event WHERE event_type = 'click' GROUP BY id) e JOIN product p USING (id) ORDER BY n DESC, pos LIMIT 5")
def top_clicked(c):
    return popularity.top_clicked(c.events("click"), c.products).select("id", "n")


@query("SELECT p.id, e.n FROM (SELECT id, count(*) AS n FROM event WHERE event_type = 'view' GROUP BY id) e JOIN product p USING (id) ORDER BY n DESC, pos LIMIT 1")
def most_viewed(c):
    return popularity.top_clicked(c.events("view"), c.products, 1).select("id", "n")


@query("SELECT id, name FROM product WHERE id IN (SELECT id FROM event WHERE event_type = 'signup' GROUP BY id HAVING count(*) % 2 = 1)")
def favorites_semi(c):
    return popularity.favorites(c.products, popularity.toggled(c.events("signup"))).select("id", "name")


@query(
    POPULAR_SQL + """, big AS (SELECT category FROM popular GROUP BY category ORDER BY count(*) DESC, category LIMIT 3)
SELECT category AS block, CAST(rank AS INT) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, pos) AS rank FROM popular WHERE NOT used) WHERE rank <= 3 AND category IN (SELECT category FROM big)
UNION ALL SELECT NULL, CAST(rank AS INT), id FROM (SELECT *, row_number() OVER (ORDER BY popularity DESC, pos) AS rank FROM popular WHERE NOT used) WHERE rank <= 3"""
)
def home_rankings(c):
    return popularity.home_rankings(popular(c))


@query("SELECT category, count(*) AS n, string_agg(DISTINCT brand, ', ' ORDER BY brand) AS brands FROM product GROUP BY category")
def category_description(c):
    return reports.category_description(c.products).select("category", "n", "brands")


@query(
    METRICS_SQL + "SELECT a.id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY abs(a.min_price - b.min_price), b.pos) AS INT) AS rank, b.id AS related_id FROM metric a JOIN metric b ON a.category = b.category AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(a.min_price - b.min_price), b.pos) <= 4"
)
def related_products(c):
    return reports.related_products(metrics(c))


@query(METRICS_SQL + "SELECT category, id, review_count, count(*) OVER (PARTITION BY category) AS total, CAST(row_number() OVER (PARTITION BY category ORDER BY review_count DESC, pos) AS INT) AS rank FROM metric QUALIFY row_number() OVER (PARTITION BY category ORDER BY review_count DESC, pos) <= 100")
def category_top100(c):
    return reports.category_report(metrics(c)).select("category", "id", "review_count", "total", "rank")


@query("SELECT id, 'Product' AS kind, name, count(*) AS n, round(min(price), 6) AS low, round(max(price), 6) AS high FROM product JOIN offer USING (id) GROUP BY id, name")
def jsonld_product(c):
    made = reports.product_json_ld(c.products, c.offers.join(c.stores.select("store_id", "store"), "store_id"))
    get = lambda path, kind: F.get_json_object("json_ld", path).cast(kind)
    return made.select("id", get("$.@type", "string").alias("kind"), get("$.name", "string").alias("name"), get("$.offers.offerCount", "long").alias("n"), F.round(get("$.offers.lowPrice", "double"), 6).alias("low"), F.round(get("$.offers.highPrice", "double"), 6).alias("high"))


@query("SELECT 0 AS section, 'https://example.org/' AS url UNION ALL SELECT DISTINCT 1, 'https://example.org/categoria/' || lower(trim(regexp_replace(category, '[^a-zA-Z0-9]+', '-', 'g'), '-')) || '/' FROM product UNION ALL SELECT 2, 'https://example.org/producto/' || id || '/' FROM product")
def sitemap(c):
    return reports.sitemap(c.products, c.products.select("category").distinct())


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(replace(text, 'ß', '')), '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def slug(c):
    return c.table("documents").select("doc_id", text.slug(F.replace("text", F.lit("ß"), F.lit(""))).alias("slug"))


IDENTIFIER = "CASE l_linenumber WHEN 1 THEN ' 6922-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') WHEN 2 THEN 'B0' || lpad(CAST(l_suppkey AS VARCHAR), 8, 'X') WHEN 3 THEN '0000000000000' WHEN 4 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END"


@query(
    f""", raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(coalesce({IDENTIFIER}, '')) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN regexp_full_match(t, '[A-Z0-9]{{10}}') AND NOT regexp_full_match(t, '[0-9]{{10}}') THEN t
  WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) IN (8, 12, 13, 14) AND NOT regexp_full_match(regexp_replace(t, '[^0-9]', '', 'g'), '0+') THEN regexp_replace(t, '[^0-9]', '', 'g') END AS identifier FROM raw"""
)
def norm_identifier(c):
    raw = F.expr(IDENTIFIER.replace("VARCHAR", "STRING"))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.normal_identifier(raw).alias("identifier"))


FEED_SQL = """, listing AS (SELECT p_partkey AS pos, 'shop' || (p_partkey % 3) AS source, 'S' || p_partkey AS source_id,
  p_name || ' X' || (p_partkey % 40) || ' Pro ' || CASE p_size % 3 WHEN 0 THEN '8GB+128GB' WHEN 1 THEN '256 GB' ELSE '12GB 1TB' END || ' [HK Warehouse] Global, 6.' || (p_size % 9) || ' inch 120Hz' AS name,
  p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN CAST(6922000000000 + p_partkey // 20 AS VARCHAR) END AS identifier FROM part),
plain AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\[[^\\]]*warehouse[^\\]]*\\]|\\bglobal\\b|\\bnew\\b|\\bversion\\b', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS normal,
  CASE WHEN p_size3 = 0 THEN 8 WHEN p_size3 = 2 THEN 12 END AS ram_gb, CASE p_size3 WHEN 0 THEN 128 WHEN 1 THEN 256 ELSE 1024 END AS storage_gb FROM (SELECT l.*, p.p_size % 3 AS p_size3, p.p_size FROM listing l JOIN part p ON p.p_partkey = l.pos)),
tok AS (SELECT pos, brand, source, ram_gb, storage_gb, p_size % 9 AS screen, list_distinct(['X' || (pos % 40), CAST(pos % 40 AS VARCHAR) || 'PRO'] || CASE p_size3 WHEN 0 THEN ['8GB', '128GB'] WHEN 1 THEN [] ELSE ['12GB', '1TB'] END || ['120HZ']) AS tokens FROM plain)
"""


def feed(c: Catalog) -> DataFrame:
    """Listings of three shops made from the parts, with specifications in their names and some bar codes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    memory = F.when(size % 3 == 0, "8GB+128GB").when(size % 3 == 1, "256 GB").otherwise("12GB 1TB")
    name = F.concat(F.col("p_name"), F.lit(" X"), (key % 40).cast("string"), F.lit(" Pro "), memory, F.lit(" [HK Warehouse] Global, 6."), (size % 9).cast("string"), F.lit(" inch 120Hz"))
    code = F.when(key % 5 == 0, (F.lit(6922000000000) + F.floor(key / 20)).cast("string"))
    return c.spread("part", "p_partkey").select(key.alias("pos"), F.concat(F.lit("shop"), (key % 3).cast("string")).alias("source"), F.concat(F.lit("S"), key.cast("string")).alias("source_id"), name.alias("name"), F.col("p_brand").alias("brand"), code.alias("identifier"))


@query(FEED_SQL + "SELECT pos, normal FROM plain")
def norm_text(c):
    return feed(c).select("pos", text.normal_text(F.col("name")).alias("normal"))


@query(FEED_SQL + "SELECT pos, ram_gb, storage_gb, round(6 + (p_size % 9) / 10e0, 2) AS screen_in, 120 AS refresh_hz FROM plain")
def specs_extract(c):
    return feed(c).select("pos", text.specs(F.col("name")).alias("s")).select("pos", "s.*")


@query(FEED_SQL + "SELECT pos, array_to_string(list_sort(tokens), ',') AS tokens FROM tok")
def model_tokens(c):
    return feed(c).select("pos", F.array_join(text.model_tokens(F.col("name")), ",").alias("tokens"))


@query(
    FEED_SQL + """, b AS (SELECT l.identifier, t.* FROM tok t JOIN listing l USING (pos) WHERE l.identifier IS NOT NULL)
SELECT identifier, count(*) AS offers, count(DISTINCT source) AS sources FROM b GROUP BY identifier HAVING count(DISTINCT source) > 1"""
)
def identifier_buckets(c):
    rows = matching.prepare(feed(c)).where("identifier_key is not null")
    return rows.groupBy(F.col("identifier_key").alias("identifier")).agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("source").alias("sources")).where("sources > 1")


#: Groups by identifier, walked offer by offer.
BY_IDENTIFIER_SQL = """, member AS (SELECT l.identifier, row_number() OVER (PARTITION BY l.identifier ORDER BY t.pos) AS i, {'pos': t.pos, 'brand': t.brand, 'ram': t.ram_gb, 'storage': t.storage_gb, 'screen': t.screen} AS m
  FROM tok t JOIN listing l USING (pos) WHERE l.identifier IN (SELECT identifier FROM listing WHERE identifier IS NOT NULL GROUP BY identifier HAVING count(DISTINCT source) > 1)),
walk AS (SELECT identifier, i, [m] AS taken FROM member WHERE i = 1
  UNION ALL SELECT n.identifier, n.i, CASE WHEN len(list_filter(w.taken, lambda x: x.brand <> n.m.brand OR coalesce(x.ram <> n.m.ram, false) OR coalesce(x.storage <> n.m.storage, false) OR coalesce(x.screen <> n.m.screen, false))) = 0 THEN list_append(w.taken, n.m) ELSE w.taken END
  FROM walk w JOIN member n ON n.identifier = w.identifier AND n.i = w.i + 1),
grouped AS (SELECT identifier, max_by(taken, i) AS taken FROM walk GROUP BY identifier),
by_identifier AS (SELECT 'i:' || identifier AS group_key, unnest(taken).pos AS pos FROM grouped WHERE len(taken) > 1)
"""


@query(FEED_SQL + BY_IDENTIFIER_SQL + "SELECT group_key, pos, 'identifier' AS matched_by, 1e0 AS confidence FROM by_identifier")
def match_identifier(c):
    return matching.by_identifier(matching.prepare(feed(c)))


#: Stars by model word, walked offer by offer of each brand.
BY_MODEL_SQL = """, lead AS (SELECT identifier, min(pos) AS lead FROM listing WHERE identifier IS NOT NULL GROUP BY identifier),
rest AS (SELECT t.*, row_number() OVER (PARTITION BY t.brand ORDER BY l.identifier IS NOT NULL, coalesce(d.lead, t.pos), t.pos) AS i FROM tok t JOIN listing l USING (pos) LEFT JOIN lead d ON d.identifier = l.identifier WHERE t.pos NOT IN (SELECT pos FROM by_identifier)),
nearby AS (SELECT a.brand, a.i, coalesce(list(b.i ORDER BY b.i) FILTER (b.i IS NOT NULL), []) AS later FROM rest a LEFT JOIN rest b ON a.brand = b.brand AND a.i < b.i AND a.source <> b.source AND list_has_any(a.tokens, b.tokens)
  AND coalesce(a.ram_gb = b.ram_gb, true) AND coalesce(a.storage_gb = b.storage_gb, true) AND coalesce(a.screen = b.screen, true) GROUP BY a.brand, a.i),
stars AS (SELECT brand, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS star FROM (SELECT DISTINCT brand FROM rest)
  UNION ALL SELECT brand, i, CASE WHEN len(star) > 0 THEN list_append(list_concat(used, star), i) ELSE used END, star FROM (
    SELECT n.brand, n.i, s.used, CASE WHEN list_contains(s.used, n.i) THEN CAST([] AS BIGINT[]) ELSE list_filter(n.later, lambda x: NOT list_contains(s.used, x)) END AS star FROM stars s JOIN nearby n ON n.brand = s.brand AND n.i = s.i + 1)),
by_model AS (SELECT a.pos AS anchor, unnest(list_append(s.star, s.i)) AS i, s.brand FROM stars s JOIN rest a ON a.brand = s.brand AND a.i = s.i WHERE len(s.star) > 0)
"""


@query(FEED_SQL + BY_IDENTIFIER_SQL + BY_MODEL_SQL + "SELECT 'm:' || g.anchor AS group_key, r.pos, 'model_specs' AS matched_by, 0.9e0 AS confidence FROM by_model g JOIN rest r USING (brand, i)")
def match_model_specs(c):
    rows = durable(matching.prepare(feed(c)), "offers")
    return matching.by_model(sorted_join(rows, matching.by_identifier(rows).select("pos"), "pos", "left_anti"), sized=rows)


def plain_feed(c: Catalog) -> DataFrame:
    """The listings without model words and bar codes, so that likeness decides."""
    return feed(c).withColumn("name", F.regexp_replace("name", r" X\d+ Pro .*", "")).withColumn("identifier", F.lit(None).cast("string"))


# The names are of two words, of which `new` is noise. Equal names, a bare noun and a named one, and `old` and `cold` can reach the threshold: with two words of three apart, the characters would have to be alike for 0.867.
@query(
    """, named AS (SELECT brand, id AS pos, id % 3 AS shop, replace(split_part(name, ' ', 1), 'new', '') AS adj, split_part(name, ' ', 2) AS noun FROM product),
scored AS (SELECT a.brand, a.pos AS a_pos, b.pos AS b_pos, CASE WHEN a.adj = b.adj THEN 1e0 WHEN a.adj <> '' AND b.adj <> '' THEN round(0.5e0 * (1e0 / 3) + 0.5e0 * (2e0 * (length(a.noun) + 4) / (2 * length(a.noun) + 9)), 4) ELSE round(0.25e0 + 0.5e0 * (2e0 * length(a.noun) / (2 * length(a.noun) + length(a.adj || b.adj) + 1)), 4) END AS score
  FROM named a JOIN named b ON a.brand = b.brand AND a.noun = b.noun AND a.pos < b.pos AND a.shop <> b.shop AND (a.adj = b.adj OR a.adj = '' OR b.adj = '' OR (a.adj IN ('old', 'cold') AND b.adj IN ('old', 'cold')))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, a_pos, b_pos) AS i FROM scored WHERE score >= 0.6e0),
paired AS (SELECT brand, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a_pos, CAST(NULL AS BIGINT) AS b_pos, 0e0 AS score FROM (SELECT DISTINCT brand FROM ordered)
  UNION ALL SELECT n.brand, n.i, CASE WHEN list_has_any(p.used, [n.a_pos, n.b_pos]) THEN p.used ELSE list_concat(p.used, [n.a_pos, n.b_pos]) END, CASE WHEN NOT list_has_any(p.used, [n.a_pos, n.b_pos]) THEN n.a_pos END, n.b_pos, n.score FROM paired p JOIN ordered n ON n.brand = p.brand AND n.i = p.i + 1)
SELECT 's:' || a_pos AS group_key, unnest([a_pos, b_pos]) AS pos, 'similarity' AS matched_by, score AS confidence FROM paired WHERE a_pos IS NOT NULL"""
)
def match_similarity(c):
    return matching.by_likeness(matching.prepare(plain_feed(c)))


# Two of these listings of a brand and different shops that contradict in nothing share the word 120HZ, so the model step takes them: what it leaves contradicts itself, scores 0.3 at most and is pending where its brand has another shop's listing left.
@query(
    FEED_SQL + BY_IDENTIFIER_SQL + BY_MODEL_SQL + """, settled AS (SELECT pos FROM by_identifier UNION SELECT r.pos FROM by_model g JOIN rest r USING (brand, i)),
alone AS (SELECT pos, brand, source FROM listing WHERE pos NOT IN (SELECT pos FROM settled)), shops AS (SELECT brand, count(DISTINCT source) AS n FROM alone GROUP BY brand),
counted AS (SELECT (SELECT count(DISTINCT group_key) FROM by_identifier) AS by_identifier, (SELECT count(*) FROM (SELECT DISTINCT brand, anchor FROM by_model)) AS by_model_specs)
SELECT (SELECT count(*) FROM listing) AS input_offers, by_identifier + by_model_specs AS groups, by_identifier, by_model_specs, CAST(0 AS BIGINT) AS by_similarity, (SELECT count(*) FROM alone JOIN shops USING (brand) WHERE n > 1) AS pending_review, (SELECT count(*) FROM alone JOIN shops USING (brand) WHERE n = 1) AS singletons FROM counted"""
)
def match_stats(c):
    rows = feed(c)
    groups, review = matching.match_offers(rows)
    return matching.match_stats(rows, groups, review)


def titles(c: Catalog) -> DataFrame:
    price = c.offers.groupBy("id").agg(F.min("price").alias("price"))
    return variants.keyed(c.products.join(price, "id")).withColumn("url", F.concat(F.lit("https://example.org/"), F.col("id").cast("string")))


#: Names of parts are two words, of which the first can be a colour.
VARIANTS_SQL = """, priced AS (SELECT p.*, o.price, lower(p.brand) AS brand_key, CASE split_part(name, ' ', 1) WHEN 'red' THEN 'Rojo' WHEN 'blue' THEN 'Azul' WHEN 'green' THEN 'Verde' WHEN 'black' THEN 'Negro' WHEN 'white' THEN 'Blanco' END AS color
  FROM product p JOIN (SELECT id, min(price) AS price FROM offer GROUP BY id) o USING (id)),
title AS (SELECT *, CASE WHEN color IS NULL THEN name ELSE split_part(name, ' ', 2) END AS model_key FROM priced),
combo AS (SELECT *, row_number() OVER (PARTITION BY category, brand_key, model_key, color ORDER BY price, pos) AS k, min(pos) OVER (PARTITION BY category, brand_key, model_key, color) AS seen FROM title),
merged AS (SELECT category, brand_key, model_key, count(*) AS members, count(*) FILTER (k = 1) AS n_variants, min_by(id, struct_pack(a := price, b := seen)) FILTER (k = 1) AS primary_id, min(price) AS price
  FROM combo GROUP BY ALL HAVING count(*) > 1)
"""


@query(VARIANTS_SQL + "SELECT category, brand_key, model_key, members, CAST(n_variants AS INT) AS n_variants FROM merged")
def variant_groups(c):
    rows = titles(c)
    merged = variants.merge_variants(rows)
    return merged.select("category", "brand_key", "model_key", "members", F.size("variants").alias("n_variants"))


@query(VARIANTS_SQL + "SELECT category, brand_key, model_key, primary_id, round(price, 6) AS price FROM merged")
def variant_primary(c):
    return variants.merge_variants(titles(c)).select("category", "brand_key", "model_key", "primary_id", F.round(F.col("variants")[0]["price"], 6).alias("price"))


@query(VARIANTS_SQL + "SELECT *, before - merged_rows + variant_groups AS after FROM (SELECT (SELECT count(*) FROM title) AS before, count(*) AS variant_groups, CAST(coalesce(sum(members), 0) AS BIGINT) AS merged_rows FROM merged)")
def variant_stats(c):
    rows = titles(c)
    return variants.merge_stats(rows, variants.merge_variants(rows))


@query(VARIANTS_SQL + "SELECT id, t.name, color, coalesce(n_variants, 0) AS n_variants FROM title t LEFT JOIN merged m USING (category, brand_key, model_key) WHERE m.primary_id IS NULL OR m.primary_id = t.id")
def merged_catalog(c):
    """The merged catalog, written as documents and read again."""
    rows = titles(c)
    path = variants.write_catalog(variants.merged_catalog(rows, variants.merge_variants(rows)), new_folder(c.spark, "catalog"))
    back = c.spark.read.schema("id long, name string, color string, variants array<struct<price:double>>").json(path)
    return back.select("id", "name", "color", F.coalesce(F.size("variants"), F.lit(0)).cast("long").alias("n_variants"))


RELEVANT_SQL = """, pairs AS (SELECT a.p_partkey AS query_id, b.p_partkey AS title_id, a.p_name || ' ' || (a.p_partkey % 7) || 'GB' AS q, b.p_name || ' ' || (b.p_partkey % 7) || ' GB' || CASE b.p_size % 5 WHEN 0 THEN ' Max' WHEN 1 THEN ' funda' ELSE '' END AS t
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type),
words AS (SELECT *, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(q), '(\\d)([a-z])', '\\1 \\2', 'g'), '([a-z])(\\d)', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ') AS qw,
  string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS tw FROM pairs),
parts AS (SELECT *, list_distinct(list_filter(qw, lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(['gb', 'ram', 'dual', 'sim', 'celular', 'smartphone', 'global', 'version', 'g', 'tb', 'mah'], w))) AS plain,
  list_filter(qw, lambda w: regexp_full_match(w, '[0-9]+')) AS numbers FROM words),
covered AS (SELECT *, len(list_filter(plain, lambda w: list_contains(tw, w))) AS n FROM parts)
SELECT query_id, title_id FROM covered WHERE NOT contains(t, 'funda') AND NOT contains(t, ' Max') AND len(list_filter(numbers, lambda w: NOT list_contains(tw, w))) = 0
  AND CASE WHEN len(plain) = 0 THEN len(numbers) > 0 WHEN len(plain) <= 3 THEN n = len(plain) ELSE n / len(plain) >= 0.6e0 END
"""


@query(RELEVANT_SQL)
def relevance_match(c):
    part = c.spread("part", "p_partkey")
    q = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 7).cast("string"), F.lit("GB"))
    more = F.when(F.col("p_size") % 5 == 0, " Max").when(F.col("p_size") % 5 == 1, " funda").otherwise("")
    t = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 7).cast("string"), F.lit(" GB"), more)
    a = part.select(F.col("p_partkey").alias("query_id"), "p_brand", "p_type", relevance.prepared(q).alias("q"))
    b = part.select(F.col("p_partkey").alias("title_id"), "p_brand", "p_type", relevance.prepared(t).alias("t"))
    return relevance.match_pairs(a, b, ["p_brand", "p_type"], ["query_id", "title_id"])


@query("SELECT id AS product, round(price, 6) AS price, round(CASE WHEN list_price > price THEN list_price END, 6) AS list_price, n AS seller_count FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY price, store_id) AS k FROM offer) WHERE k = 1")
def cheapest_listing(c):
    none = F.lit(None)
    listings = c.offers.select(F.col("id").alias("product"), F.col("store_id").alias("pos"), "price", F.col("list_price").alias("original_price"), none.cast("string").alias("currency"), F.lit("new").alias("condition"), (F.col("fee") == 0).alias("free_shipping"), none.cast("string").alias("state"), none.cast("long").alias("total"))
    return relevance.cheapest_listing(listings).select("product", r6("price"), r6("list_price"), "seller_count")


@query("SELECT event_type, id, count(*) AS n FROM event GROUP BY event_type, id")
def stream_counts(c):
    spark: SparkSession = c.spark
    schema = c.table("events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{c.folder}/events.parquet*")
    counted = counters.running_counts(stream.select("event_type", F.get_json_object("props", "$.k").cast("long").alias("id")))
    return counters.final_counts(counted, new_folder(spark, "stream-counts"))


@query(
    """, live AS (SELECT id, store_id, CASE WHEN store_id % 2 = 0 THEN price * 0.9e0 ELSE price END AS price, CASE WHEN store_id % 4 = 0 THEN NULL ELSE fee END AS fee FROM offer WHERE store_id % 3 = 0)
SELECT coalesce(o.id, l.id) AS id, coalesce(o.store_id, l.store_id) AS store_id, round(CASE WHEN l.id IS NOT NULL THEN l.price ELSE o.price END, 6) AS price, round(CASE WHEN l.id IS NOT NULL THEN l.fee ELSE o.fee END, 6) AS fee, round(o.list_price, 6) AS list_price
FROM (SELECT * FROM offer WHERE store_id % 5 <> 0) o FULL JOIN live l ON o.id = l.id AND o.store_id = l.store_id"""
)
def live_upsert(c):
    all_ = c.offers
    live = all_.where("store_id % 3 = 0").select("id", "store_id", F.when(F.col("store_id") % 2 == 0, F.col("price") * 0.9).otherwise(F.col("price")).alias("price"), F.when(F.col("store_id") % 4 != 0, F.col("fee")).alias("fee"))
    return offers.upsert_live(all_.where("store_id % 5 <> 0"), live).select("id", "store_id", r6("price"), r6("fee"), r6("list_price"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["list_cheapest"](spark, folder)
