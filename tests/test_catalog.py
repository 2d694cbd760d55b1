"""Functions and operators of the catalog on hand-worked rows."""

import json

import pytest
from pyspark.sql import functions as F

from cotejo.functions import pricing, text
from cotejo.operators import catalog, matching, offers, popularity, relevance, reports, variants
from cotejo.sources.catalog import CatalogDocument, ListQuery, read_brands, read_feed, read_feeds, read_state
from cotejo.sources import files, packages, remote
from cotejo.streaming import counters, stateful

OFFER = "pos long, source string, source_id string, name string, brand string, identifier string"
ROWS = {
    "a": (1, "amazon_mx", "A1", "iPhone 15 128GB Negro", "Apple", "0194253000000"),
    "b": (2, "mercadolibre", "M1", "Apple iPhone 15 (128 GB) - Negro", "Apple", "0194253000000"),
    "c": (3, "liverpool", "L1", "Samsung Galaxy S24", "Samsung", "0194253000000"),
    "d": (4, "sunsky", "S1", "OnePlus Ace 5 Racing, 16GB+512GB, 6.77 inch", "OnePlus", None),
    "e": (5, "geekbuying", "G1", "OnePlus Ace 5 Racing 16GB 512GB Verde Global", "OnePlus", None),
    "f": (6, "liverpool", "S2", "OnePlus Ace 5 Racing, 16GB+256GB, 6.77 inch", "OnePlus", None),
    "g": (7, "sunsky", "S3", "Blackview Oscal Marine 2, 4GB+64GB rugged phone", "", None),
    "h": (8, "geekbuying", "G2", "HiBREW H21 Cafetera espresso", "", None),
    "k": (11, "sunsky", "S5", "Xiaomi Redmi 13C 5G 6GB 128GB", "Xiaomi", None),
    "l": (12, "geekbuying", "G4", "Xiaomi Redmi Note 13 5G 8GB 256GB", "Xiaomi", None),
}


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, " + schema).withColumn("v", column).orderBy("k").select("v").collect()]


def feed(spark, keys):
    return spark.createDataFrame([ROWS[k] for k in keys], OFFER)


def test_identifiers(spark):
    given = ["6922288940950", "6922-2889 40950", "B0CHX3QBQY", "", None, "12345", "0" * 14, "b0chx3qbqy", "ABC12345678", "1234567890"]
    assert values(spark, text.normal_identifier(F.col("x")), [(g,) for g in given], "x string") == ["6922288940950", "6922288940950", "B0CHX3QBQY", None, None, None, None, None, "12345678", None]


def test_texts(spark):
    assert "hk warehouse" not in values(spark, text.normal_text(F.col("x")), [("[HK Warehouse] Xiaomi POCO X8 Pro",)], "x string")[0]
    spec = values(spark, text.specs(F.col("x")), [("Xiaomi POCO X8 Pro, 12GB+512GB, 6.59 inch",), ("Laptop 16GB+1TB",), ("Cafetera",)], "x string")
    assert (spec[0]["ram_gb"], spec[0]["storage_gb"], spec[0]["screen_in"]) == (12, 512, 6.59)
    assert spec[1]["storage_gb"] == 1024 and spec[2]["ram_gb"] is None
    tokens = values(spark, text.model_tokens(F.col("x")), [("Monitor para juegos KTC H27T6 de 27 pulgadas",), ("OnePlus Ace 5 Racing, 16GB+512GB",)], "x string")
    assert "H27T6" in tokens[0] and {"ACE5", "5RACING", "16GB", "512GB"} <= set(tokens[1])
    assert values(spark, text.slug(F.col("x")), [("Ropa (hombre y mujer)",)], "x string") == ["ropa-hombre-y-mujer"]
    assert values(spark, text.escape_html(F.col("x")), [('<a href="x">&',)], "x string") == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert values(spark, text.without_brand(F.col("x"), F.col("b")), [("APPLE  Watch", "Apple"), ("Applesauce", "Apple")], "x string, b string") == ["Watch", "Applesauce"]


@pytest.mark.parametrize(("keys", "groups", "by"), [("ab", [{1, 2}], "identifier"), ("abc", [{1, 2}], "identifier"), ("de", [{4, 5}], "model_specs"), ("df", [], None), ("kl", [], None)])
def test_matching(spark, keys, groups, by):
    found, review = matching.match_offers(feed(spark, keys), 0.85)
    got: dict = {}
    for r in found.collect():
        assert r["matched_by"] == by
        got.setdefault(r["group_key"], set()).add(r["pos"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    left = {r["pos"]: r for r in review.collect()}
    assert set(left) == {ROWS[k][0] for k in keys} - set().union(*groups, set())
    if keys == "kl":
        assert left[11]["status"] == "pending" and "Redmi Note" in left[11]["question"]


def test_likeness(spark):
    score = lambda keys: matching.likeness(matching.prepare(feed(spark, keys))).first()["score"]
    assert score("de") >= 0.5
    assert score("gh") < 0.3


@pytest.mark.parametrize("walk", [1000, 5])
def test_greedy_pairs_equal_a_plain_walk(spark, monkeypatch, walk):
    import itertools
    import random

    monkeypatch.setattr(matching, "WALK", walk)

    r = random.Random(5)
    pairs = [(i, j, r.choice([0.6, 0.7, 0.9])) for i, j in itertools.combinations(range(14), 2) if r.random() < 0.5]
    used, want = set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not {i, j} & used:
            used |= {i, j}
            want.add((i, j))
    key = lambda c: F.format_string("%05d", F.col(c))
    scores = spark.createDataFrame(pairs, "a_pos long, b_pos long, score double").select("*", F.lit("b").alias("brand_key"), key("a_pos").alias("a_key"), key("b_pos").alias("b_key"))
    assert {(row["a_pos"], row["b_pos"]) for row in matching.greedy_pairs(scores).collect()} == want


def plain_matches(rows, threshold):
    """(groups, best) by walks over all pairs: rows are prepared offers. groups: {(step, positions)}; best: {pos: (candidate, score)} of offers in no group."""
    import difflib
    import itertools

    order = lambda r: tuple(r["ord"])
    same = lambda x, y: x is None or y is None or x == y
    fits = lambda a, b: all(same(a[c], b[c]) for c in ("ram_gb", "storage_gb", "screen_in"))
    groups, used = set(), set()
    buckets: dict = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        if r["identifier_key"]:
            buckets.setdefault(r["identifier_key"], []).append(r)
    for bucket in buckets.values():
        if len({r["source"] for r in bucket}) > 1:
            taken = bucket[:1]
            for r in bucket[1:]:
                if all(fits(r, t) and ("" in (r["brand_key"], t["brand_key"]) or r["brand_key"] == t["brand_key"]) for t in taken):
                    taken.append(r)
            if len(taken) > 1:
                groups.add(("identifier", tuple(sorted(t["pos"] for t in taken))))
                used |= {t["pos"] for t in taken}
    left = sorted((r for r in rows if r["pos"] not in used), key=order)
    for i, a in enumerate(left):
        if a["pos"] in used:
            continue
        star = [b for b in left[i + 1 :] if b["pos"] not in used and a["brand_key"] == b["brand_key"] and a["source"] != b["source"] and set(a["model"]) & set(b["model"]) and fits(a, b)]
        if star:
            taken = {a["pos"], *(b["pos"] for b in star)}
            groups.add(("model_specs", tuple(sorted(taken))))
            used |= taken
    left = [r for r in left if r["pos"] not in used]
    stop = set(text.STOP_WORDS)
    words = lambda r: {w for w in r["normal"].split() if len(w) > 1 and w not in stop}
    scored = []
    for a, b in itertools.combinations(left, 2):
        if a["brand_key"] == b["brand_key"] and a["source"] != b["source"]:
            x, y = words(a), words(b)
            shared = len(x & y) / len(x | y) if x and y else 0.0
            score = 0.5 * shared + 0.5 * difflib.SequenceMatcher(None, a["normal"], b["normal"]).ratio()
            scored.append((round(score * (1.0 if fits(a, b) else 0.3), 4), a, b))
    for s, a, b in sorted(scored, key=lambda p: (-p[0], order(p[1]), order(p[2]))):
        if s >= threshold and not {a["pos"], b["pos"]} & used:
            groups.add(("similarity", tuple(sorted((a["pos"], b["pos"])))))
            used |= {a["pos"], b["pos"]}
    best = {}
    for s, a, b in sorted(scored, key=lambda p: (-p[0], order(p[1]), order(p[2]))):
        for one, other in ((a, b), (b, a)):
            if s > 0 and one["pos"] not in used:
                best.setdefault(one["pos"], (other["pos"], s))
    return groups, {r["pos"]: best.get(r["pos"], (None, 0.0)) for r in left if r["pos"] not in used}


@pytest.mark.parametrize(("seed", "walk", "block"), [(1, 20_000, 2_000), (2, 20_000, 12), (3, 6, 5)])
def test_all_steps_equal_plain_walks(spark, monkeypatch, seed, walk, block):
    import random

    monkeypatch.setattr(matching, "WALK", walk)
    monkeypatch.setattr(matching.scored, "__defaults__", (block,))
    r = random.Random(seed)
    rows = []
    for i in range(90):
        name = " ".join(r.sample(["aero", "beam", "core", "dune", "echo"], r.randint(1, 3)))
        name += r.choice(["", " X7", " X7", " R2D", " Lite 5"]) + r.choice(["", " 8GB+128GB", " 12GB 256GB", " 128 GB"]) + r.choice(["", ' 6.1"', " 6.5 inch"])
        rows.append((i, f"s{r.randrange(3)}", f"S{i}", name, r.choice(["Uno", "Duo", ""]), r.choice([None] * 5 + ["69222889400%02d" % r.randrange(6)])))
    offers = spark.createDataFrame(rows, OFFER)
    groups, review = matching.match_offers(offers)
    got: dict = {}
    for g in groups.collect():
        got.setdefault((g["matched_by"], g["group_key"]), []).append(g["pos"])
    want, best = plain_matches(matching.prepare(offers).collect(), matching.THRESHOLD)
    assert {(m, tuple(sorted(v))) for (m, _), v in got.items()} == want
    assert {g["pos"]: (g["candidate"], g["score"]) for g in review.collect()} == best


def test_matching_pairs_meet_by_a_needed_token(spark):
    import random

    r = random.Random(4)
    word = lambda: r.choice(["galaxy", "note", "redmi", "poco", "pro", "max", "black", "usb", "fan", "kit", "128", "64", "x9"])
    said = [" ".join(word() for _ in range(r.randint(0, 7))) for _ in range(120)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string")
    a = rows.select(F.col("i").alias("a"), F.lit(1).alias("on"), relevance.prepared(F.col("s")).alias("q"))
    b = rows.select(F.col("i").alias("b"), F.lit(1).alias("on"), relevance.prepared(F.col("s")).alias("t"))
    want = {tuple(x) for x in a.join(b, "on").where(relevance.is_match_prepared(F.col("q"), F.col("t"))).select("a", "b").collect()}
    got = [tuple(x) for x in relevance.match_pairs(a, b, ["on"], ["a", "b"]).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_equal_texts_are_compared_once(spark):
    """Rows of equal texts are paired by the numbers of their classes: all pairs, and as many rows meet as there are classes."""
    said = spark.range(3000).select("id", F.lit(1).alias("on"), relevance.prepared(F.concat(F.lit("note "), (F.col("id") % 3).cast("string"))).alias("x"))
    pairs = relevance.match_pairs(said.select(F.col("id").alias("a"), "on", F.col("x").alias("q")), said.select(F.col("id").alias("b"), "on", F.col("x").alias("t")), ["on"], ["a", "b"])
    assert pairs.where("a % 3 = b % 3").count() == pairs.count() == 3 * 1000 * 1000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3 and not plan.lstrip().startswith("Aggregate")


def test_a_text_is_read_once(spark):
    """Not once for each accessory."""
    plan = spark.range(1).select(F.lit("a").alias("q"), F.col("id").cast("string").alias("t")).where(relevance.foreign_accessory(F.col("q"), F.col("t")))._jdf.queryExecution().analyzed().toString()
    contains = plan[plan.index("transform") :].split("lambdafunction(")[1]
    assert "translate" not in contains


def test_one_identifier_of_many_offers(spark):
    """Its distinct signatures are walked through, not its offers: the first of each decides for all of its kind."""
    given = [("Uno", None), ("", 128), ("Uno", 256), ("Dos", 128), ("Uno", 128), ("", None)]
    rows = [(i, f"s{i % 4}", f"S{i}", f"pot {given[i % 6][1]}GB" if given[i % 6][1] else "pot", given[i % 6][0], "0194253000000") for i in range(30_000)]
    found = matching.by_identifier(matching.prepare(spark.createDataFrame(rows, OFFER)))
    # Uno without a size, then 128 GB: 256 GB and Dos contradict.
    assert found.count() == 20_000 and {r[0] for r in found.select(F.col("pos") % 6).distinct().collect()} == {0, 1, 4, 5}


def broadcasts(df):
    """How many joins of a plan were broadcast in the end."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin")


def test_stars_are_not_broadcast(spark):
    """Tables that grow with the offers don't pass through the driver, however small their files are."""
    rows = matching.durable(matching.prepare(feed(spark, "abcdefghkl")), "offers")
    assert broadcasts(matching._earliest_fit(rows, matching._least_of_signs(rows, "entries"), "earlier")) == 0
    assert broadcasts(matching.prepare(feed(spark, "abcdefghkl"))) == 0


def test_few_names_are_compared():
    """The names whose characters are compared grow with the offers, not with their pairs."""
    import random

    import pandas as pd

    def block(n):
        r = random.Random(3)
        word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
        base = [(word(), word(), word()) for _ in range(n // 2)]
        names = [" ".join(b) for b in base] + [f"{a} {b} {word()}" for a, b, _ in base]
        rows = [(i, f"{i:09d}", f"s{i % 2 if i < n // 2 else (i + 1) % 2}", x, x.split(), True, None, None, None) for i, x in enumerate(names)]
        return pd.DataFrame(rows, columns=["pos", "key", "source", "normal", "words", "free", "ram_gb", "storage_gb", "screen_in"])

    small, large = (matching.compare_blocks(block(n), None, 0.6) for n in (200, 800))
    assert len(large[1]) == 800 and large[2] < 6 * small[2] and large[2] < 800 * 800 / 2 / 20


def test_rows_of_equal_name_and_sign_are_compared_as_one(spark):
    """Copies don't add to the comparisons, and a brand's blocks are dealt out to several tasks."""
    rows = [(i, f"s{i % 2}", f"S{i}", f"pot {'abcdefgh'[i % 8]} {128 + i % 8} GB", "Uno", None) for i in range(20_000)]
    of_items, items = matching.as_items(matching.prepare(spark.createDataFrame(rows, OFFER)).withColumn("free", F.lit(True)))
    assert of_items.count() == 20_000 and items.count() == 8
    # All names of the other source contradict: each has candidates, none a pair.
    found = matching.scored(items, 0.6, 2)
    assert found.where("not best").isEmpty() and found.select("item").distinct().count() == 8
    assert found.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize(("seed", "later"), [(1, True), (3, False), (4, False)])
def test_candidates_among_copies_equal_a_plain_walk(spark, seed, later):
    """Names are alike in one order more than in the other, so a later row of a name can be the better candidate."""
    import random

    r = random.Random(seed)
    names = ["".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(6)]
    kinds = [(f"s{r.randrange(3)}", f"{n} {128 + i} GB") for i, n in enumerate(names)]
    rows = [(i, *(kind := r.choice(kinds))[:1], f"S{i}", kind[1], "Uno", None) for i in range(80)]
    offers = spark.createDataFrame(rows, OFFER)
    _, review = matching.match_offers(offers)
    want, best = plain_matches(matching.prepare(offers).collect(), matching.THRESHOLD)
    assert not want and {g["pos"]: (g["candidate"], g["score"]) for g in review.collect()} == best
    first = {}
    for row in rows:
        first.setdefault(row[3], row[0])
    assert any(c is not None and c not in first.values() for c, _ in best.values()) == later


def test_report_of_a_run(spark):
    offers = feed(spark, "abckl")
    groups, review = matching.match_offers(offers, 0.85)
    said = {(r["section"], r["place"]): r["text"] for r in matching.report(offers, groups, review).collect()}
    assert said["group", 1] == "[identifier, 1.00] amazon_mx: iPhone 15 128GB Negro | mercadolibre: Apple iPhone 15 (128 GB) - Negro"
    assert "Redmi 13C" in said["pending", 1] and len(said) == 3


def test_a_report_broadcasts_nothing(spark):
    """Neither groups nor offers pass through the driver: of all groups only the first ones' keys do. A group of one source is not shown."""
    rows = [(i, f"s{i % 2 if i < 30 else 0}", f"S{i}", f"pot {i}", "Uno", None) for i in range(40)]
    offers = spark.createDataFrame(rows, OFFER)
    groups = spark.createDataFrame([(f"m:{39 - i // 2}", i, "model_specs", 0.9) for i in range(40)], "group_key string, pos long, matched_by string, confidence double")
    review = spark.createDataFrame([(40 + i, "pending", None, 0.0, f"{i}?") for i in range(3)], "pos long, status string, candidate long, score double, question string")
    report = matching.report(offers, groups, review, 20, 2)
    assert broadcasts(report) == 0
    want = [("group", k + 1, f"[model_specs, 0.90] s0: pot {2 * k} | s1: pot {2 * k + 1}") for k in range(15)] + [("pending", 1, "0?"), ("pending", 2, "1?")]
    assert sorted(map(tuple, report.collect())) == sorted(want)
    assert {r["place"] for r in matching.report(offers, groups, review, 2, 0).collect()} == {1, 2}


def test_prices(spark):
    days = pricing.delivery_days(F.col("r"), F.col("m"), F.col("km"), F.col("i"), F.col("s"))
    assert values(spark, days, [(True, True, 0.0, 1, "backorder"), (False, False, 1240.0, 2, "in_stock"), (False, False, 4000.0, 2, "backorder"), (False, True, 20.0, 0, None)], "r boolean, m boolean, km double, i int, s string") == [5, 7, 10, 2]
    fee = pricing.fee_to_region(F.col("b"), F.lit(False), F.lit(False), F.lit(1240.0), F.lit(2))
    assert values(spark, fee, [(99.0,), (0.0,), (None,)], "b double") == [229.0, 0.0, None]
    info = pricing.fee_info(F.col("f"), F.col("t"), F.col("p"), F.col("s"))
    assert values(spark, info, [(None, 50.0, 50.0, "sunsky"), (None, 50.0, None, "aliexpress"), (12.0, None, None, "x")], "f double, t double, p double, s string") == [(0.0, False), (130.0, True), (12.0, False)]
    assert values(spark, pricing.discount_pct(F.col("p"), F.col("l")), [(80.0, 99.99), (80.0, 80.0), (80.0, None)], "p double, l double") == [20, None, None]
    assert values(spark, pricing.availability(F.col("s")), [(None,), ("in_stock",)], "s string") == ["https://schema.org/PreOrder", "https://schema.org/InStock"]
    assert values(spark, pricing.stock_label(F.col("s")), [(None,)], "s string") == ["None"]


def test_best_value(spark):
    rows = [(1, 1, 100.0, 4.0, "backorder"), (1, 2, 102.0, 4.5, "in_stock"), (1, 3, 150.0, 5.0, None), (2, 1, 5.0, None, None)]
    got = {r["id"]: r for r in offers.best_value(spark.createDataFrame(rows, "id int, store_id int, price double, rating double, stock string")).collect()}
    assert (got[1]["best_value_store"], round(got[1]["score"], 3)) == (2, 0.954)
    assert got[2]["best_value_store"] is None


def test_popularity_and_lists(spark):
    ids = lambda n: spark.createDataFrame([(1,)] * n, "id int")
    stars = spark.createDataFrame([(1, 5), (1, 4), (1, 2), (1, 3)], "id int, rating int")
    product = spark.createDataFrame([(1, 1), (2, 2)], "id int, pos int")
    got = {r["id"]: r["popularity"] for r in popularity.popularity(product, ids(2), ids(5), stars).collect()}
    assert got == {1: 35, 2: 0}
    rows = spark.createDataFrame([(i, i, float(i % 7)) for i in range(121)], "id int, pos int, min_price double")
    last = catalog.page(rows, ListQuery(sort="price_asc", page=9)).collect()
    assert len(last) == 1 and last[0]["rank"] == 121
    scope = catalog.price_scope(spark.createDataFrame([(58.0,), (39380.0,)], "min_price double")).first()
    assert tuple(scope) == (58, 39380, 500, 0, 39500)
    assert tuple(catalog.price_scope(spark.createDataFrame([], "min_price double")).first())[:2] == (0, 1000)


def test_the_last_page_of_a_list_of_many(spark):
    """More than 10,000 pages: the one beyond the last is the last, not the ten thousandth."""
    from cotejo.plans.sites import first_and_last_pages

    rows = spark.range(20_005).select("id", F.col("id").alias("pos"), F.col("id").cast("double").alias("min_price"))
    found = first_and_last_pages(catalog.RankedList(rows, ListQuery(sort="price_asc"), 2))
    assert sorted(r["rank"] for r in found.collect()) == [1, 2, 5, 6, 20_003, 20_004, 20_005]


def test_related_are_the_nearest(spark):
    import random

    r = random.Random(2)
    rows = [(i, i, "x" if i % 3 else "y", float(r.randrange(12))) for i in range(60)]
    want = set()
    for i, p, c, price in rows:
        near = sorted((abs(price - q), o, j) for j, o, d, q in rows if d == c and j != i)[:4]
        want |= {(i, k + 1, j) for k, (_, _, j) in enumerate(near)}
    got = reports.related_products(spark.createDataFrame(rows, "id int, pos int, category string, min_price double"))
    assert {tuple(x) for x in got.collect()} == want


def test_relevance(spark):
    pairs = [("Honor X9b", "Honor X9d"), ("Honor X5 Plus", "Honor X9d 5G"), ("POCO X8 Pro 12GB 512GB", "POCO X8 Pro Max 12GB 512GB"), ("iPhone 15", "Funda para iPhone 15"), ("iPhone 15", "Apple iPhone 15 128 GB")]
    assert values(spark, relevance.is_match(F.col("q"), F.col("t")), pairs, "q string, t string") == [False, False, False, False, True]


def test_variant_titles(spark):
    said = [
        "Funda Rose Gold", "Redragon Dragonborn White K630 Teclado Negro", "iPhone 13 Azul (Reacondicionado)", "Galaxy S21 Morado Color Violeta", "Galaxy S21 Negro Space Gray", "Reloj GT color del Mar Azul marino, 46 mm",
        "Redmi 12 Azul - Open  Box, open box", "Moto G54 semi nuevo Negra", "Teléfono Café", "Rojo", "", "Blackberry Redmi", "Caja NEGRA blanca Color\t", "Funda rosa oro - ",
    ]
    got = values(spark, F.to_json(variants.title_parts(F.col("x")), {"ignoreNullFields": "false"}), [(t,) for t in said], "x string")
    assert [tuple(json.loads(g).values()) for g in got] == [
        ("funda rose", "Funda Rose", "Dorado", "new"), ("redragon dragonborn white k630 teclado", "Redragon Dragonborn White K630 Teclado", "Negro", "new"), ("iphone 13", "iPhone 13", "Azul", "refurbished"),
        ("galaxy s21", "Galaxy S21", "Morado", "new"), ("galaxy s21 negro space", "Galaxy S21 Negro Space", "Gris", "new"), ("reloj gt , 46 mm", "Reloj GT , 46 mm", "Azul marino", "new"),
        ("redmi 12 - ,".strip(" ,-"), "Redmi 12 - , open box", "Azul", "refurbished"), ("moto g54", "Moto G54", "Negro", "refurbished"), ("telefono", "Teléfono", "Café", "new"), ("", "", "Rojo", "new"), ("", "", None, "new"),
        ("blackberry redmi", "Blackberry Redmi", None, "new"), ("caja color", "Caja Color", "Blanco", "new"), ("funda", "Funda", "Dorado", "new"),
    ]


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 1, "iPhone 15 128 GB Negro", "Apple", "phones", 10.0, "u1"), (2, 2, "iPhone 15 (128 GB) - Azul", "Apple", "phones", 9.0, "u2"), (3, 3, "Otro", "X", "phones", 1.0, "u3")], "id int, pos int, name string, brand string, category string, price double, url string")
    keyed = variants.keyed(rows)
    merged = variants.merge_variants(keyed)
    row = merged.first()
    assert merged.count() == 1 and row["primary_id"] == 2 and [v["color"] for v in row["variants"]] == ["Azul", "Negro"]
    left = variants.merged_catalog(keyed, merged).select("id", "pos", "name", "brand", "category", "price", "url")
    assert {r["id"] for r in left.collect()} == {2, 3}
    assert variants.merge_variants(variants.keyed(left)).count() == 0


def test_entries(spark):
    offer = "array<struct<price:double,url:string,photo:string>>"
    known = "array<struct<color:string,condition:string,price:double,url:string,photo:string,mlQuery:string>>"
    rows = [
        (1, "iPhone Azul", "new", [("Color", "Verde oliva")], [(5.0, "u", None)], "q", []),
        (2, "x", "new", [("Color", "azul turquí")], [(6.0, "w", None)], "q", None),
        (3, "x", "new", [], [], None, [("Rojo", "new", 1.0, "r", None, "q"), (None, "refurbished", 2.0, "s", None, "q")]),
        (4, "x", "new", [], [], None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, color string, condition string, specs array<struct<label:string,value:string>>, offers {offer}, mlQuery string, colorVariants {known}")
    got = [(r["id"], r["color"], r["price"]) for r in variants.entries(variants.candidates(df)).orderBy("id", "variant_pos").collect()]
    assert got == [(1, "Verde oliva", 5.0), (2, "Azul Turquí", 6.0), (3, "Rojo", 1.0), (3, None, 2.0)]


def test_list_rows(spark):
    rows = spark.createDataFrame([(1, 7, "a", 4.4, 3, 1234.5, 10, 2, [("Condición", "Usado")])], "rank int, id int, name string, rating double, review_count long, min_price double, discount_pct long, offer_count long, specs array<struct<label:string,value:string>>")
    row = catalog.list_rows(rows, "popularity").first()
    assert (row["medal"], row["stars"], row["from_price"], row["condition"]) == ("crown", "★★★★☆", "$1,234", "used")
    assert catalog.list_rows(rows).first()["medal"] is None
    assert catalog.pagination(121, 9) == {"page": 3, "pages": 3, "first": 121, "last": 121, "has_previous": True, "has_next": False}
    query = ListQuery(brands=frozenset("ab"), size="M", magsafe_only=True).within({"b"}, {"S"}, False)
    assert (query.brands, query.size, query.magsafe_only) == (frozenset("b"), None, False)


def test_feeds(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text("id;title;vendor;price;sale_price\n1;Uno;A;;5.5\n2;Dos;B;abc;\n3;Tres;C;;\n4;Cuatro;;1_000;\n5;Cinco;D;12d;\n6;Seis;E; 12 ;\n")
    got = {r["source_id"]: (r["name"], r["price"]) for r in read_feed(spark, str(path), "s").collect()}
    assert got == {"1": ("Uno", 5.5), "3": ("Tres", 0.0), "4": ("Cuatro", 1000.0), "6": ("Seis", 12.0)}
    both = read_feeds(spark, [f"{path}:one", f"{path}:two"])
    assert both.select("pos").distinct().count() == 8 and both.where("source = 'two'").count() == 4


def test_documents(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text('{"stores":[{"id":"s"}],"products":[{"id":"p","offers":[{"storeId":"s","price":2},{"storeId":"t","price":1}],"specs":[{"label":"Condición","value":"Reacondicionado"}]}]}')
    doc = CatalogDocument(spark, str(path))
    assert [(r["pos"], r["price"]) for r in doc.offers.orderBy("pos").collect()] == [(0, 2.0), (1, 1.0)]
    used = doc.products.select(catalog.is_used(F.col("specs")).alias("spa"), catalog.is_used(F.col("specs"), False).alias("page"), catalog.condition_badge(F.col("specs")).alias("badge")).first()
    assert tuple(used) == (True, False, "refurbished")
    assert read_brands(spark, str(tmp_path / "none.json")).count() == 0
    assert read_state(spark, str(tmp_path / "none.json"), "id string", [("x",)]).count() == 1


def test_links():
    assert ListQuery.from_link("#/c/audio?sub=tv&q=a%20b") == ListQuery(category="audio", subcategory="tv", query="a b")


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")], "id int, seq int, v string").write.parquet(folder)
    stream = lambda: spark.readStream.schema("id int, seq int, v string").parquet(folder)
    counters.upsert_into(stream(), str(tmp_path / "t"), ["id"], "seq", str(tmp_path / "c1"))
    now = lambda: {tuple(r) for r in counters.read_latest(spark, str(tmp_path / "t"), "id int, seq int, v string").collect()}
    assert now() == {(1, 7, "y"), (2, 1, "z")}
    spark.createDataFrame([(2, 3, "later"), (1, 6, "late"), (9, 1, "new")], "id int, seq int, v string").write.mode("append").parquet(folder)
    counters.upsert_into(stream(), str(tmp_path / "t"), ["id"], "seq", str(tmp_path / "c1"))
    assert now() == {(1, 7, "y"), (2, 3, "later"), (9, 1, "new")}


def test_bucket_tables_stay_small_and_replays_change_nothing(spark, tmp_path):
    table = counters.BucketTable(spark, "file://" + str(tmp_path / "t"), "id long, seq long, v string", ["id"], buckets=4)
    batch = lambda n: spark.createDataFrame([(n % 7, n, f"v{n}"), (100 + n % 3, n, "w")], "id long, seq long, v string")
    files = lambda: [p for p in (tmp_path / "t").rglob("*.parquet")]
    for n in range(8):
        table.merge(batch(n), n, "seq")
        assert len(files()) <= counters.KEPT * (4 + 1)
    want = {(i, max(n for n in range(8) if n % 7 == i), f"v{max(n for n in range(8) if n % 7 == i)}") for i in range(7)} | {(100, 6, "w"), (101, 7, "w"), (102, 5, "w")}
    assert {tuple(r) for r in table.read().collect()} == want
    # The last batch again, and one that broke off between its data and its manifest.
    table.merge(batch(7), 7, "seq")
    assert {tuple(r) for r in table.read().collect()} == want
    batch(50).selectExpr("*", "0 as bucket").write.partitionBy("bucket").parquet(str(tmp_path / "t/data/v=8"))
    assert {tuple(r) for r in table.read().collect()} == want
    table.merge(spark.createDataFrame([], "id long, seq long, v string"), 8, "seq")
    assert {tuple(r) for r in table.read().collect()} == want


def test_state_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / "log")
    add = lambda rows: spark.createDataFrame(rows, "id long, request long, answer string").write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema("id long, request long, answer string").parquet(folder)
    read = lambda name, schema: {tuple(r) for r in counters.read_latest(spark, str(tmp_path / name / "table"), schema).collect()}

    def run():
        stateful.keep_latest(stateful.toggles(stream().select("id")), str(tmp_path / "on"))
        stateful.keep_latest(stateful.newest_answers(stream()), str(tmp_path / "new"))
        reviews = stream().selectExpr("id", "request as event_id", "5 as rating")
        stateful.keep_latest(stateful.review_numbers(reviews), str(tmp_path / "reviews"), ("id", "event_id"), "number", "append")

    add([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")])
    run()
    assert read("on", "id long, is_on boolean, version long") == {(1, False, 2), (2, True, 1)}
    assert read("new", "id long, request long, answer string, version long") == {(1, 7, "y", 1), (2, 1, "z", 1)}
    # A late answer to an older request changes nothing; the other keys go on from their state.
    add([(2, 3, "later"), (1, 6, "late"), (9, 1, "new")])
    run()
    assert read("on", "id long, is_on boolean, version long") == {(1, True, 3), (2, False, 2), (9, True, 1)}
    assert read("new", "id long, request long, answer string, version long") == {(1, 7, "y", 1), (2, 3, "later", 2), (9, 1, "new", 1)}
    assert read("reviews", "id long, event_id long, rating int, number long") == {(1, 5, 5, 1), (1, 7, 5, 2), (1, 6, 5, 3), (2, 1, 5, 1), (2, 3, 5, 2), (9, 1, 5, 1)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKSDB


def pages_of(spark, folder, n=95, size=20):
    for at in range(0, n, size):
        results = [{"id": f"MX{i}", "title": f"Thing {i} {'blue' if i % 3 else 'red'}", "price": i, "currency_id": "MXN"} for i in range(at, min(n, at + size))]
        (folder / "A").mkdir(parents=True, exist_ok=True)
        (folder / "A" / f"{at}.json").write_text(json.dumps({"status": 200, "paging": {"total": n}, "results": results}))


def test_remote_pages(spark, tmp_path):
    pages_of(spark, tmp_path / "c")
    path = "file://" + str(tmp_path / "c")
    got = remote.walk(spark, path, "A", 30, 25)
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(30, 55)) and got.rdd.getNumPartitions() == 2
    assert remote.walk(spark, path, "A", -5, 3).count() == 3 and remote.walk(spark, path, "A", 90, 20).count() == 5 and remote.walk(spark, path, "A", 200, 20).count() == 0
    assert [r["pos"] for r in remote.search(spark, path, "RED thing", ["A"], 2).orderBy("pos").collect()] == [0, 3]
    assert spark.read.format("paged_catalog").option("path", path).load().where("price > 92 and domain = 'A' and pos >= 91").count() == 2
    # A page with an error is one only for those who ask for it.
    (tmp_path / "c/A/60.json").write_text('{"status": 429}')
    assert remote.walk(spark, path, "A", 30, 25).count() == 25
    with pytest.raises(Exception, match="429"):
        remote.walk(spark, path, "A", 55, 10).collect()
    with pytest.raises(Exception, match="404"):
        remote.walk(spark, path, "Z", 0, 10).collect()


def test_remote_pages_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Catalog(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = parse_qs(urlparse(self.path).query)
            at, n = int(asked["offset"][0]), int(asked["limit"][0])
            allowed = self.headers["Authorization"] == "Bearer secret"
            self.send_response(200 if allowed else 401)
            self.end_headers()
            self.wfile.write(json.dumps({"paging": {"total": 30}, "results": [{"id": str(i), "title": "t"} for i in range(at, min(30, at + n))]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Catalog)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert [r["id"] for r in remote.walk(spark, base, "A", 18, 5, token="secret").orderBy("pos").collect()] == ["18", "19", "20", "21", "22"]
        with pytest.raises(Exception, match="401"):
            remote.walk(spark, base, "A", 0, 5).collect()
    finally:
        server.shutdown()


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    path = "file://" + str(tmp_path / "site")
    rows = spark.range(40).select(F.format_string("p/%d/index.html", "id").alias("name"), F.concat(F.lit("page "), "id").alias("body"))
    files.write_files(rows.repartition(5), path)
    there = lambda: sorted(str(p.relative_to(tmp_path / "site")) for p in (tmp_path / "site").rglob("*") if p.is_file())
    assert len(there()) == 40 and (tmp_path / "site/p/7/index.html").read_text() == "page 7" and not (tmp_path / "site/_staging").exists()
    before = there()
    bad = rows.select(F.concat(F.lit("new/"), "name").alias("name"), F.when(F.col("body") == "page 39", F.raise_error(F.lit("no page"))).otherwise(F.col("body")).alias("body"))
    for broken in (bad, rows.unionByName(rows), rows.withColumn("name", F.lit("../out"))):
        with pytest.raises(Exception):
            files.write_files(broken, path)
        assert there() == before and not (tmp_path / "out").exists()


def test_names_of_files_are_a_table(spark, tmp_path):
    """The driver gets no message for each file, and files are read again without a list of them."""
    path = "file://" + str(tmp_path / "site")
    rows = spark.range(300).select(F.format_string("p/%d/x.html", "id").alias("name"), F.concat(F.lit("ñ "), "id").alias("body"))
    names = files.put_files(rows.repartition(3), path)
    assert names.count() == 300 and not (tmp_path / "site/_staging").exists()
    assert {tuple(r) for r in files.read_files(names, path).collect()} == {tuple(r) for r in rows.collect()}


def test_packages_are_written_whole_or_not_at_all(spark, tmp_path):
    import zipfile

    path = "file://" + str(tmp_path / "site")
    rows = spark.range(300).select(F.format_string("p/%d/ñ.html", "id").alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("ñ "), "id")).alias("body"))
    names = packages.put_packages(rows.repartition(3), path, most=2_000)
    there = lambda: sorted(str(p.relative_to(tmp_path / "site")) for p in (tmp_path / "site").rglob("*"))
    before = there()
    assert 3 < len(before) < 100 and all(n.endswith(".zip") for n in before)
    want = {(r["name"], r["body"] or "") for r in rows.collect()}
    held = [zipfile.ZipFile(tmp_path / "site" / n) for n in before]
    assert sorted((n, z.read(n).decode()) for z in held for n in z.namelist()) == sorted(want)
    assert {tuple(r) for r in packages.read_packages(names, path).collect()} == want
    some = packages.read_packages(names.where("name < 'p/2'"), path)
    assert {tuple(r) for r in some.collect()} == {w for w in want if w[0] < "p/2"}
    bad = rows.withColumn("body", F.when(F.col("name") == "p/39/ñ.html", F.raise_error(F.lit("no page"))).otherwise(F.col("body")))
    odd = [rows.withColumn("name", F.lit(n)) for n in ("../out", "a/", "a\0b", None)]
    for broken in (bad, rows.unionByName(rows), *odd):
        with pytest.raises(Exception):
            packages.put_packages(broken, path)
        assert there() == before
    none = str(tmp_path / "none")
    assert packages.read_packages(packages.put_packages(rows.where("false"), "file://" + none), "file://" + none).count() == 0


def test_report_pages_are_few_files_from_one_shuffle(spark):
    """Pages lie in packages, not in a file and a folder each, and their lines are read and dealt out once."""
    from pathlib import Path

    from cotejo.plans.queries import QUERIES
    from cotejo.plans.sites import product_files
    from cotejo.sources.tables import Catalog

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "cotejo"
    before = set(shared.glob("site-*"))
    rows = QUERIES["report_pages"](spark, "/root/testdata/sf0.001")
    (folder,) = set(shared.glob("site-*")) - before
    assert rows.count() == 200 and len(list(folder.rglob("*"))) <= 2 * spark.sparkContext.defaultParallelism
    plan = product_files(Catalog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning(l_partkey") == 1 and plan.count("Exchange hashpartitioning(l_suppkey") == 0


def test_many_pages_are_read_in_runs(spark, tmp_path):
    """Partitions don't grow with the pages; all rows of all pages are there."""
    pages_of(spark, tmp_path / "c", n=2 * remote.RUNS + 51, size=1)
    rows = spark.read.format("paged_catalog").option("path", "file://" + str(tmp_path / "c")).option("page_size", "1").load()
    assert rows.rdd.getNumPartitions() <= remote.RUNS
    assert sorted(r["pos"] for r in rows.collect()) == list(range(2 * remote.RUNS + 51))


def test_options_are_counted_without_sorting(spark):
    from cotejo.plans.queries import QUERIES

    plan = QUERIES["product_options"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Join" not in plan


def test_unknown_stores_are_errors(spark):
    rows, stores = spark.createDataFrame([(1, 1), (1, 2)], "id int, store_id int"), spark.createDataFrame([(1, "one")], "store_id int, store string")
    assert offers.with_store(rows.where("store_id = 1"), stores).collect()[0]["store"] == "one"
    with pytest.raises(Exception, match="unknown store 2"):
        offers.with_store(rows, stores).collect()
