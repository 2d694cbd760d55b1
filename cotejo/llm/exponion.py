"""Centroid clustering of whole-number vectors by Lloyd rounds with Exponion search."""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm import vectors
from cotejo.llm.shared import durable

#: Largest component, in absolute value, of which squared distances of 64 components still fit a long.
MOST = 1 << 27
#: Bounds are kept on the safe side of rounding by this share and this much.
_SHARE, _STEP = 1e-12, 1e-9
_STATE = "vec_id {id}, vec array<int>, cluster int, upper double, lower double, part int, sums array<long>, n long"


@dataclass(frozen=True)
class Centroids:
    """Centroids, how far each has moved in the last round, and for each the others by distance, itself first."""

    at: np.ndarray
    moved: np.ndarray
    order: np.ndarray
    sorted: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> "Centroids":
        apart = np.sqrt(squares(at, at).astype(np.float64))
        np.fill_diagonal(apart, -1.0)
        order = np.argsort(apart, axis=1, kind="stable")
        ranked = np.take_along_axis(apart, order, axis=1)
        ranked[:, 0] = 0.0
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(np.float64))
        return cls(at, moved, order, ranked)

    def nearest(self) -> np.ndarray:
        """Distance of each centroid to the one next to it."""
        return self.sorted[:, 1] if len(self.at) > 1 else np.full(len(self.at), np.inf)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all of c, exact."""
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


def _two_least(d: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest, ties to the smaller number; its squared distance; that of the second) in each row; numbers: one list for all rows, ascending."""
    best = d.argmin(axis=1)
    first = d[np.arange(len(d)), best]
    if d.shape[1] == 1:
        return numbers[best], first, np.full(len(d), -1, np.int64)
    rest = d.copy()
    rest[np.arange(len(d)), best] = np.iinfo(np.int64).max
    return numbers[best], first, rest.min(axis=1)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + _SHARE) + _STEP


def _below(squared: np.ndarray) -> np.ndarray:
    return np.where(squared < 0, np.inf, np.sqrt(np.maximum(squared, 0).astype(np.float64)) * (1 - _SHARE) - _STEP)


def full_scan(v: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound of its distance, lower bound of every other's)."""
    cluster, first, second = _two_least(squares(v, c.at), np.arange(len(c.at)))
    return cluster, _above(first), _below(second)


def search(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The bounds of the round before, after the centroids' moves -> those of this round, and how many distances were worked out.

    A vector whose upper bound lies below its lower bound, or below half the way to the centroid next to its own, stays.
    Others get their true distance u; if that doesn't settle it, only centroids within
    2 u + (distance of the next centroid) of the own one are scanned, a head of its sorted list. Neither the nearest
    nor the second nearest lies outside; the radius is inclusive, so equally near centroids are all seen.
    """
    cluster, upper, lower = cluster.copy(), upper + c.moved[cluster] + _STEP, lower.copy()
    largest = np.argsort(-c.moved, kind="stable")
    others = np.where(cluster == largest[0], c.moved[largest[1]] if len(largest) > 1 else 0.0, c.moved[largest[0]])
    lower -= others + _STEP
    near = c.nearest()
    half = near * (0.5 * (1 - _SHARE)) - _STEP
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    count = len(open_)
    own = ((v[open_] - c.at[cluster[open_]]) ** 2).sum(axis=1)
    upper[open_] = _above(own)
    open_ = open_[upper[open_] >= np.maximum(lower[open_], half[cluster[open_]])]
    radius = (2 * upper[open_] + near[cluster[open_]]) * (1 + _SHARE) + _STEP
    for a in np.unique(cluster[open_]):
        of = open_[cluster[open_] == a]
        heads = np.searchsorted(c.sorted[a], radius[cluster[open_] == a], "right")
        for m in np.unique(heads):
            rows = of[heads == m]
            inside = np.sort(c.order[a, :m])
            cluster[rows], first, second = _two_least(squares(v[rows], c.at[inside]), inside)
            upper[rows], lower[rows] = _above(first), _below(second)
            count += len(rows) * m
    return cluster, upper, lower, count


def _whole(batch: pa.RecordBatch, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the vectors that are kept, and floor(scale * x) of their components."""
    column = batch.column(1)
    keep = vectors.lengths(column) == size
    x = vectors.matrix(column, keep) * scale
    good = (np.isfinite(x) & (np.abs(x) <= MOST)).all(axis=1) if len(x) else np.zeros(0, bool)
    keep[np.flatnonzero(keep)[~good]] = False
    return keep, np.floor(x[good]).astype(np.int64) if len(x) else np.zeros((0, size), np.int64)


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters of the vectors with exactly `size` components, each made the whole number floor(scale * x).

    Returns a row for each kept vector: vec_id, cluster, distance (squared), cluster_inertia and inertia (sums of distance
    over the cluster and over all), centroid_sha256 (of the final centroid's components joined by commas).

    Centroids start as the k vectors with the smallest sha256 of `<seed>:<id>`. Each round assigns every vector to the
    nearest centroid, ties to the smaller number, and replaces centroids that have vectors by the floor of their mean;
    after the last round vectors are assigned once more. All of it is in whole numbers, so reruns agree to the bit.
    From the second round on a vector carries bounds and scans only what search() leaves. Every round is one pass over a written table,
    whose tasks also give their sums: k rows each, added up by Spark; k centroids come to the driver and go back.

    Left out: null vectors, another length, null or non-finite components, and components beyond MOST after scaling, whose
    distances fit no long. Repeated rows and ids each count; of equal ids the one with the least vector seeds first.
    A null id seeds nothing but is assigned. Fewer than k vectors: as many clusters as vectors with an id. No such vector: no rows.
    Sums that fit no long are null. Other columns are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def quantise(batches):
        for batch in batches:
            keep, v = _whole(batch, size, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), K.list_array(v.reshape(-1).astype(np.int32), np.arange(len(v) + 1) * size, pa.int32())], names=["vec_id", "vec"])

    kept = durable(rows.mapInArrow(quantise, f"vec_id {kind}, vec array<int>"), "whole-vectors")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.where("vec_id is not null").orderBy(by_hash, "vec").limit(k).select("vec").collect()
    if not seeds:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = np.array([r[0] for r in seeds], np.int64).reshape(-1, size)
    state, centroids = kept, Centroids.of(at)

    def matrix(batch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size)

    def step(first: bool, c: Centroids):
        def assign(batches):
            sums, counts = np.zeros((len(c.at), size), np.int64), np.zeros(len(c.at), np.int64)
            for batch in batches:
                v = matrix(batch)
                if first:
                    cluster, upper, lower = full_scan(v, c)
                else:
                    cluster, upper, lower, _ = search(v, batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy(), c)
                np.add.at(sums, cluster, v)
                counts += np.bincount(cluster, minlength=len(counts))
                none = pa.nulls(len(v), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.nulls(len(v), pa.int32()), pa.nulls(len(v), pa.list_(pa.int64())), none], names=names)
            some = np.flatnonzero(counts)
            empty = [pa.nulls(len(some), schema.field(i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(some.astype(np.int32)), K.list_array(sums[some].reshape(-1), np.arange(len(some) + 1) * size, pa.int64()), pa.array(counts[some])], names=names)

        return assign

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = spark.createDataFrame([], _STATE.format(id=kind)).schema
    schema, names = to_arrow_schema(shape), shape.names
    for r in range(rounds):
        out = durable(state.mapInArrow(step(r == 0, centroids), _STATE.format(id=kind)), "clusters")
        state = out.where("part is null").select("vec_id", "vec", "cluster", "upper", "lower")
        parts = out.where("part is not null").select("part", "n", F.posexplode("sums").alias("i", "s"))
        new = centroids.at.copy()
        for j, i, s, n in parts.groupBy("part", "i").agg(F.sum("s"), F.sum("n")).collect():
            new[j, i] = s // n
        centroids = Centroids.of(new, centroids.at)

    def last(batches):
        for batch in batches:
            v = matrix(batch)
            cluster = search(v, batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy(), centroids)[0] if rounds else full_scan(v, centroids)[0]
            apart = ((v - centroids.at[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(apart)], names=["vec_id", "cluster", "distance"])

    placed = durable(state.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "placed")
    sums = {j: int(s) for j, s in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda s: s if s < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids.at]
    table = [(j, fits(s), fits(sum(sums.values())), digest[j]) for j, s in sorted(sums.items())]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as centroids.
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    kept = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64"
    near = "SELECT k.rid, k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k, c{0} c"
    parts = [f"kept AS (SELECT row_number() OVER () AS rid, * FROM ({kept}))", f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT * FROM ({near.format(r)}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i)")
            parts.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    end = f"SELECT a.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"
    return f"WITH {', '.join(parts)} {end}"


ORACLE = _oracle()
