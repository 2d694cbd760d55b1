"""Offers of a product side by side, and live offers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import pricing

#: Rows of stores and regions up to which they are sent to every task.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if a count proves it small; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def routes(regions: DataFrame, target: int | str) -> DataFrame:
    """Every hub region's way to the target region: same_region, same_metro, km and the target's infrastructure days."""
    to = regions.where(F.col("region") == target).select(F.col("region").alias("t"), F.col("metro").alias("tm"), F.col("lat").alias("tlat"), F.col("lng").alias("tlng"), F.col("infra").alias("infra_days"))
    from_ = regions.select(F.col("region").alias("hub"), "metro", "lat", "lng")
    # A region's key is unique: two rows of the target are an error, and one is what is sent.
    one = to.groupBy("t").agg(*(F.first(c).alias(c) for c in to.columns if c != "t"), F.count(F.lit(1)).alias("n")).where(F.assert_true(F.col("n") == 1, F.lit("the target region stands twice")).isNull()).drop("n")
    both = from_.join(F.broadcast(one))
    km = pricing.distance_km(F.col("lat"), F.col("lng"), F.col("tlat"), F.col("tlng"))
    return both.select("hub", (F.col("hub") == F.col("t")).alias("same_region"), (F.col("metro") == F.col("tm")).alias("same_metro"), km.alias("km"), "infra_days")


def offer_table(offers: DataFrame, stores: DataFrame, regions: DataFrame, target: int | str, sort: str = "price") -> DataFrame:
    """Offers with store, delivery, shipping and discount, and tags of the cheapest and fastest of each product. A store without a hub has no estimate."""
    ways = routes(regions, target)
    rows = offers.join(small(stores), "store_id", "left").join(small(ways), "hub", "left")
    route = (F.col("same_region"), F.col("same_metro"), F.col("km"), F.col("infra_days"))
    rows = rows.withColumn("days", F.when(F.col("km").isNotNull(), pricing.delivery_days(*route, F.col("stock"))))
    rows = rows.withColumn("ship_fee", F.when(F.col("km").isNull(), F.col("fee")).otherwise(pricing.fee_to_region(F.col("fee"), *route)))
    rows = rows.withColumn("free", pricing.free_above(F.col("threshold"), F.col("price")))
    of = Window.partitionBy("id")
    rows = rows.withColumn("best_price", F.min("price").over(of) == F.col("price")).withColumn("fastest", F.coalesce(F.min("days").over(of) == F.col("days"), F.lit(False)))
    key = [F.asc("price")] if sort == "price" else [F.desc(F.coalesce("rating", F.lit(0.0)))]
    rows = rows.withColumn("rank", F.row_number().over(of.orderBy(*key, "store_id"))).withColumn("discount_pct", pricing.discount_pct(F.col("price"), F.col("list_price")))
    return rows.withColumn("shipping_label", pricing.shipping_label(F.col("ship_fee"), F.col("free"), F.lit(None).cast("double"), F.col("hub"))).withColumn("verified", F.coalesce("verified", F.lit(False)))


def regions_in_metro(regions: DataFrame, metro: int | str) -> DataFrame:
    return regions.where(F.col("metro") == metro)


def best_value(offers: DataFrame) -> DataFrame:
    """The offer of best value of each product with offers: 0.4 price + 0.3 rating + 0.3 stock; null store where it is the cheapest's."""
    of = Window.partitionBy("id")
    span = F.max("price").over(of) - F.min("price").over(of)
    price = 1 - F.when(span > 0, (F.col("price") - F.min("price").over(of)) / span).otherwise(0.0)
    stock = F.when(F.col("stock") == "in_stock", 1.0).when(F.col("stock") == "low_stock", 0.5).when(F.col("stock").isNull(), 0.5).otherwise(0.0)
    score = F.lit(0.4) * price + F.lit(0.3) * (F.coalesce("rating", F.lit(0.0)) / 5) + F.lit(0.3) * stock
    scored = offers.withColumn("score", score)
    best = scored.groupBy("id").agg(F.min_by(F.struct("store_id", "score"), F.struct(-F.col("score"), F.col("store_id"))).alias("b"), F.min_by("store_id", F.struct("price", "store_id")).alias("cheapest"))
    return best.select("id", "cheapest", F.when(F.col("b.store_id") != F.col("cheapest"), F.col("b.store_id")).alias("best_value_store"), F.col("b.score").alias("score"))


def explode_variants(products: DataFrame, offers: DataFrame, variants: DataFrame) -> DataFrame:
    """Offers, and for products of more than one colour variant a row for each variant over the first offer, without list price, labelled by colour."""
    counted = variants.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("n > 1")
    first = offers.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("k = 1").drop("k", "price", "list_price", "pos")
    label = F.concat_ws(" ", "color", F.when(F.col("condition") == "refurbished", "(Reacondicionado)"))
    many = counted.select("id", F.col("pos"), "price", label.alias("label")).join(first, "id").withColumn("list_price", F.lit(None).cast("double"))
    single = offers.join(counted.select("id").distinct(), "id", "left_anti").withColumn("label", F.lit(None).cast("string"))
    return single.unionByName(many)


def with_store(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Offers with their stores; an offer of an unknown store is an error."""
    rows = offers.join(small(stores.withColumn("known", F.lit(True))), "store_id", "left")
    return rows.where(F.assert_true(F.col("known").isNotNull(), F.concat(F.lit("unknown store "), F.col("store_id").cast("string"))).isNull()).drop("known")


def split_verified(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers whose price was verified, offers for reference); without a mark an offer is for reference."""
    return offers.where("verified"), offers.where("not coalesce(verified, false)")


def upsert_live(offers: DataFrame, live: DataFrame) -> DataFrame:
    """Live offers over stored ones by (id, store_id): live fields win, nulls too; fields that only stored offers have stay; new ones come last."""
    keys = ["id", "store_id"]
    fields = [c for c in live.columns if c not in keys]
    marked = live.select(*keys, *(F.col(c).alias(f"live_{c}") for c in fields), F.lit(True).alias("is_live"))
    both = offers.join(marked, keys, "full_outer")
    for c in fields:
        old = F.col(c) if c in offers.columns else F.lit(None)
        both = both.withColumn(c, F.when(F.col("is_live"), F.col(f"live_{c}")).otherwise(old))
    return both.drop("is_live", *(f"live_{c}" for c in fields))


def live_offers(payloads: DataFrame) -> DataFrame:
    """Live answers (id, store_id, price, shippingFree, shippingFee, rating, reviewCount, stock) as verified offers; without a price there is none."""
    fee = F.when(F.col("shippingFree"), F.lit(0.0)).otherwise(F.col("shippingFee"))
    return payloads.where("price is not null and price <> 0").select("id", "store_id", "price", fee.alias("fee"), "rating", F.coalesce("reviewCount", F.lit(0)).alias("review_count"), "stock", F.lit(True).alias("verified"))
