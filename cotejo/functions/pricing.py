"""Column functions on prices, shipping and delivery."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default shipping fees of stores.
DEFAULT_FEES = {"mercadolibre": 99, "sunsky": 150, "geekbuying": 180, "molnija": 200, "glasseslit": 100, "woodestic": 280, "aliexpress": 130, "alibaba": 350, "theluxurycloset": 500}
EARTH_KM = 6371.0


def half_up(x: Column) -> Column:
    """Rounds to whole numbers, halves upwards."""
    return F.floor(x + 0.5)


def discount_pct(price: Column, list_price: Column) -> Column:
    """Whole per cent off the list price; null unless that is above the price."""
    return F.when(list_price > price, half_up((1 - price / list_price) * 100))


def free_above(threshold: Column, price_usd: Column) -> Column:
    return F.coalesce((threshold.isNotNull()) & (price_usd >= threshold), F.lit(False))


def fee_info(fee: Column, threshold: Column, price_usd: Column, store: Column, defaults: dict | None = None) -> Column:
    """Struct of fee and estimated: a known fee, else none above the store's threshold, else the store's default as an estimate, else none."""
    table = F.create_map(*[F.lit(x) for pair in (defaults or DEFAULT_FEES).items() for x in (pair[0], float(pair[1]))])
    default = F.try_element_at(table, store)
    guess = fee.isNull() & ~free_above(threshold, price_usd) & default.isNotNull()
    return F.struct(F.coalesce(fee, F.when(guess, default), F.lit(0.0)).alias("fee"), guess.alias("estimated"))


def is_wholesale(store: Column) -> Column:
    return F.coalesce(store == "alibaba", F.lit(False))


def display_price(price: Column, fee: Column, include_shipping: bool) -> Column:
    return price + fee if include_shipping else price


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def delivery_days(same_region: Column, same_metro: Column, km: Column, infra: Column, stock: Column) -> Column:
    near = F.when(km < 15, 1).when(km < 40, 2).otherwise(3)
    base = F.when(same_region, 1).when(same_metro, near).otherwise(3 + half_up(km / 500))
    late = F.when(stock == "backorder", 3).otherwise(0)
    return F.least(base + infra + late, F.lit(10)).cast("int")


def fee_to_region(base: Column, same_region: Column, same_metro: Column, km: Column, infra: Column) -> Column:
    """Grows with the region's infrastructure days, and by distance to another metro; none stays none."""
    grown = base + infra * 20 + F.when(same_metro, 0).otherwise(half_up(km / 200) * 15)
    return F.when(base.isNull() | (base == 0) | same_region, base).otherwise(grown)


def delivery_label(days: Column) -> Column:
    return F.when(days <= 1, "Mañana").otherwise(F.concat(days.cast("string"), F.lit(" días")))


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(x, 0), 0))


def shipping_label(fee: Column, free: Column, estimate: Column, hub: Column) -> Column:
    return F.when(fee == 0, "Envío gratis").when(fee.isNotNull(), money(fee)).when(free, "Envío gratis").when(estimate.isNotNull(), F.concat(F.lit("~"), money(estimate))).when(hub.isNull(), "Envío internacional").otherwise("—")


def availability(stock: Column) -> Column:
    return F.when(stock == "in_stock", "https://schema.org/InStock").when(stock == "low_stock", "https://schema.org/LimitedAvailability").otherwise("https://schema.org/PreOrder")


def stock_label(stock: Column) -> Column:
    return F.when(stock == "in_stock", "En stock").when(stock == "low_stock", "Pocas unidades").when(stock == "backorder", "Bajo pedido").otherwise(F.coalesce(stock, F.lit("None")))


def stars(average: Column) -> Column:
    full = F.least(F.greatest(half_up(average), F.lit(0)), F.lit(5)).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), 5 - full))


def slider_bounds(low: Column, high: Column) -> Column:
    """Struct of step and the bounds snapped outwards to it."""
    span = high - low
    step = F.when(span > 20000, 500).when(span > 2000, 100).otherwise(10)
    return F.struct(step.alias("step"), (F.floor(low / step) * step).alias("low"), (F.ceil(high / step) * step).alias("high"))
