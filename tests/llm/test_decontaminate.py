"""Leaks that lie at unlucky places or beside others."""

import random

import brute
import pandas as pd
import pytest

from cotejo.llm.decontaminate import benchmark_leaks

FILL = "river of stone went under a small bridge where two old men sold bread and fish to people who came from far towns".split()
REPEATED = "On Monday morning he sold 5 apples for 3 dollars at the market. On Tuesday morning he sold 8 apples for 2 dollars at the market."
ITEM = "In 1984 the trader Boris sold 35 kg of apples for 12 euros near Lisbon, then Boris kept 7 kg for winter and told nobody about it."
VARIANT = "In 2020 the trader Maria sold 99 kg of apples for 41 euros near Athens, then Maria kept 3 kg for winter and told nobody about it."
ANOTHER = "In 2001 the trader Petra sold 11 kg of apples for 8 euros near Madrid, then Petra kept 2 kg for winter and told nobody about it."
MIXED = "In 2020 the trader Maria sold 99 kg of apples for 41 euros near Athens, then Petra kept 3 kg for winter and told nobody about it."


def found(spark, docs, items):
    got = benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"]) for r in got}


def test_alignments_are_judged_one_by_one(spark):
    said = [REPEATED, f"{ITEM} {' '.join(FILL)} {VARIANT}", f"{VARIANT} {' '.join(FILL)} {ANOTHER}", f"{ITEM} Later the trader Carla sold 4 kg of apples for 9 euros to us.", MIXED]
    docs = [(10 * i + k, " ".join([*FILL[:k], s])) for i, s in enumerate(said) for k in range(4)]
    got = found(spark, docs, [(1, REPEATED), (2, ITEM)])
    assert set(got) == {(d, 1 if d < 10 else 2) for d, _ in docs if d < 40}


@pytest.mark.parametrize("n", [1, 2, 4, 7, 8, 9, 10, 12, 20])
def test_verbatim_copies_at_any_place(spark, n):
    item = "Grey Boris counted 35 white pebbles before supper while nine patient herons slept near that quiet mill until rain arrived.".split()[:n]
    docs = [(k, " ".join([*FILL[:k], *item, *FILL[k:]])) for k in range(9)] + [(20, " ".join(FILL)), (21, " ".join(item))]
    assert set(found(spark, docs, [(1, " ".join(item)), (2, "?"), (3, None)])) == {(d, 1) for d, _ in docs if d != 20}


@pytest.mark.parametrize("n", [8, 9, 12])
def test_stretches_of_a_long_item_at_any_place(spark, n):
    item = "yesterday morning Boris counted 35 white pebbles before supper while nine patient herons slept near that quiet mill".split()
    other = ["99" if w == "35" else w for w in item]
    docs = [(k, " ".join([*FILL[:k], *other[2 : 2 + n], *FILL[k:]])) for k in range(1, 6)]
    assert set(found(spark, docs, [(1, " ".join(item))])) == {(d, 1) for d, _ in docs}


def test_short_items_with_other_numbers(spark):
    docs = [(1, "we saw 14 ripe apples cost 6 euros here"), (2, "we saw 14 ripe apples cost more"), (3, "we saw 35 kg here"), (4, "we saw 36 kg here")]
    assert set(found(spark, docs, [(1, "12 ripe apples cost 5 euros"), (2, "35 kg")])) == {(1, 1), (3, 2)}


def test_windows_of_many_placeholders_match_literally(spark):
    item = "12 kg, 35 cm, 7 min, 99 usd, 5 days, 41 mm"
    docs = [(k, " ".join([*FILL[:k], item, *FILL[k:]])) for k in range(4)] + [(9, "20 kg, 36 cm, 8 min, 98 usd, 6 days, 42 mm")]
    assert set(found(spark, docs, [(1, item)])) == {(k, 1) for k in range(4)}


def test_leaks_equal_a_plain_version(spark):
    r = random.Random(9)
    vocabulary = [*FILL[:9], "Boris", "Lima,", "35", "7", "kg", "km", "$12.50", "(1984)", "it's", "?", "über"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 4, 7, 8, 9, 11, 12, 20, 40]))) for i in range(40)] + [(90, ITEM), (91, REPEATED), (92, "?"), (90, VARIANT)]
    docs = [(d, f"{say(r.randint(0, 15))} {r.choice(items)[1]} {say(r.randint(0, 30))} {r.choice([MIXED, ANOTHER, REPEATED, ''])}") for d in range(150)] + [(500, ""), (501, "?")]
    assert set(found(spark, docs, items)) == brute.leaks(docs, items)


def test_query_equals_a_plain_version(spark):
    from cotejo.llm.queries import op5_benchmark_decontamination

    folder = "/root/testdata/sf0.001"
    docs, bench = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.leaks(list(zip(docs.doc_id, docs.text)), list(zip(bench.item_id, bench.text)))
    assert {(r["doc_id"], r["item_id"]) for r in op5_benchmark_decontamination(spark, folder).collect()} == want and want
