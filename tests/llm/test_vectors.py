"""Embedding near-dedup and centroid clustering against plain versions."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import embeddings, exponion
from cotejo.llm.embeddings import near_duplicate_vectors
from cotejo.llm.exponion import cluster_vectors

KIND = "vec_id long, embedding array<double>"
CLASHING = ("node", "cell", "pair", "salts", "side", "guest", "copies", "v", "k1", "n", "links", "component", "cluster", "part", "sums", "vec", "distance")


def extra(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def brute_links(rows, tau=0.9):
    """(vec_id, embedding) rows -> sorted (vec_id, n_links, component_id, kept)."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for g, (_, v) in zip(good, rows)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(len(rows)) if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= tau] for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        met, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in met:
                    met.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in met if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((d, len(near[i]), least, d == least))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def odd_rows():
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + r.normal(scale=0.15, size=8)).tolist()) for i in range(150)]
    rows += [(200 + i, base[0].tolist()) for i in range(40)]  # equal vectors
    rows += [(300, (2 * base[0]).tolist()), (301, None), (302, []), (303, [0.0] * 8), (304, [1.0, None, *[0.0] * 6]), (305, [math.nan, *[1.0] * 7]), (306, [math.inf, *[1.0] * 7])]
    rows += [(307, [1e300] * 8), (308, [1e300] * 8), (309, [1e-300] * 8), (310, [1.0, 2.0]), (311, [1.0, 2.1]), (None, base[1].tolist()), (None, [9.0, -9.0] * 4), (5, base[3].tolist()), (5, base[3].tolist())]
    return rows


@pytest.mark.parametrize("block", [embeddings.BLOCK, 20])
def test_links_equal_all_pairs(spark, block):
    rows = odd_rows()
    got = found(near_duplicate_vectors(extra(spark.createDataFrame(rows, KIND).repartition(5)), spread=math.inf, cells=6, block=block))
    assert got == brute_links(rows)


def test_large_cells_are_counted_without_products(spark):
    r = np.random.default_rng(5)
    center, other = np.eye(16)[0], np.eye(16)[1]
    tight = [center + r.normal(scale=0.03, size=16) for _ in range(300)]
    shell = [math.cos(a) * center + math.sin(a) * (other + r.normal(scale=0.02, size=16)) for a in np.linspace(0.2, 0.7, 80)]
    rows = [(i, x.tolist()) for i, x in enumerate([*tight, *shell])]
    assert found(near_duplicate_vectors(spark.createDataFrame(rows, KIND), cells=3, block=16)) == brute_links(rows)
    theta = math.acos(0.9)
    plan = embeddings.plan_cell([(False, 0, 100_000, 0.0, 0.02, 100_000, 0), (False, 9, 50, 0.3, 0.32, 50, 7)], theta, 1000)
    assert plan.compared[0] == [] and plan.linked[0] == 100_050 and plan.within[0]


def test_recall_of_pairs_at_the_threshold(spark):
    """Twins with a cosine of 0.9 to 0.92 that point anywhere: the hardest to keep in one cell."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(r.normal(size=(1500, 64)))
    off = r.normal(size=base.shape)
    off = unit(off - (off * base).sum(axis=1)[:, None] * base)
    c = r.uniform(0.9, 0.92, size=(1500, 1))
    x = np.concatenate((base, c * base + np.sqrt(1 - c * c) * off))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    true = (x @ x.T >= 0.9).sum() - len(x)
    got = near_duplicate_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.97 * true <= got <= true
    assert near_duplicate_vectors(df, spread=math.inf).agg(F.sum("n_links")).first()[0] == true


def test_no_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], KIND)).collect() == []
    assert found(near_duplicate_vectors(spark.createDataFrame([(1, None), (None, [])], KIND))) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=str)


def brute_clusters(rows, k, rounds, size):
    """Sorted rows of cluster_vectors in whole numbers of any size."""
    kept = [(d, [math.floor(64 * x) for x in v]) for d, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(64 * x) <= exponion.MOST for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{d}".encode()).hexdigest(), v) for d, v in kept if d is not None)[:k]
    cents = [v for _, v in seeds]
    if not cents:
        return []
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(cents)), key=lambda j: (apart(v, cents[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in range(len(cents)):
            of = [v for (_, v), o in zip(kept, own) if o == j]
            if of:
                cents = [*cents[:j], [sum(x) // len(of) for x in zip(*of)], *cents[j + 1 :]]
    rows = [(d, j := nearest(v), apart(v, cents[j])) for d, v in kept]
    inertia = [sum(x for _, o, x in rows if o == j) for j in range(len(cents))]
    return sorted(((d, j, x, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for d, j, x in rows), key=str)


@pytest.mark.parametrize("k, rounds", [(16, 3), (5, 12), (1, 2), (7, 0)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    r = np.random.default_rng(k)
    # Few values, so that vectors are often equally near to several centroids, and some seeds are equal.
    rows = [(i, (r.integers(-2, 3, size=4) / 64).tolist()) for i in range(400)]
    rows += [(1000 + i, (r.normal(size=4) * 40).tolist()) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [math.nan] * 4), (2005, [math.inf] * 4), (2006, [1e30] * 4), (None, [0.5] * 4), (7, [0.25] * 4), (7, [-0.25] * 4)]
    got = cluster_vectors(extra(spark.createDataFrame(rows, KIND).repartition(3)), k=k, rounds=rounds, size=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, k, rounds, 4)


def test_few_or_no_vectors_to_cluster(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.5, 0.25])]
    assert sorted(map(tuple, cluster_vectors(spark.createDataFrame(rows, KIND), size=2).collect()), key=str) == brute_clusters(rows, 16, 3, 2)
    assert cluster_vectors(spark.createDataFrame([(1, None)], KIND)).collect() == []
    assert cluster_vectors(spark.createDataFrame([], KIND)).collect() == []


def test_search_leaves_most_distances_out():
    r = np.random.default_rng(1)
    centers = r.integers(-2000, 2000, size=(16, 64))
    v = centers[r.integers(0, 16, 5000)] + r.integers(-40, 40, size=(5000, 64))
    before = exponion.Centroids.of(centers.astype(np.int64))
    cluster, upper, lower = exponion.full_scan(v, before)
    moved = exponion.Centroids.of((centers + r.integers(-3, 4, size=centers.shape)).astype(np.int64), before.at)
    got, _, _, count = exponion.search(v, cluster, upper, lower, moved)
    assert (got == exponion.full_scan(v, moved)[0]).all() and count < 0.02 * 16 * len(v)


def test_queries_equal_sql(spark):
    from cotejo.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("op11_embedding_near_dedup", "op12_conversation_prefix_trie", "op13_centroid_clustering"):
        df, want = QUERIES[name](spark, folder), con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
