"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them, one representative per group."""

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from cotejo.llm import vectors
from cotejo.llm.graph import connected_components
from cotejo.llm.shared import durable
from cotejo.operators.ordering import numbered

#: Cells at most, whatever the number of vectors; and sampled vectors a cell, components of the sample at most. The driver holds no more.
MOST_CELLS, SAMPLE_PER_CELL, SAMPLE_COMPONENTS = 16384, 8, 1 << 24
#: Vectors on either side of one product.
BLOCK = 8192
#: Components of slices that are multiplied at once.
_SLICE = 1 << 22
#: Kept on the safe side of rounding.
_EPS = 1e-6
_JOB = ["cell", "pair", "salts"]


@dataclass(frozen=True)
class Cells:
    """Unit centroids, the largest cell first; at what distance from the border to a larger cell a vector is a guest there, and the width of the rings in which a cell's vectors are counted."""

    at: np.ndarray
    margin: float
    ring: float


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, k: int, tau: float, spread: float, rounds: int = 4) -> Cells:
    """Spherical k-means over a sample of unit rows, whose first k rows it starts from.

    Centroids closer to a larger cell's than half the angle of the threshold are dropped, so that a crowd of near
    copies has one cell however many of its vectors are in the sample. The margin is `spread` standard deviations of the part of
    two linked vectors' difference that lies across a border, if it points anywhere in the sample's effective dimensions (the participation ratio
    of its covariance); at sqrt(1 - tau^2), its largest value, no link is missed.
    """
    c, sizes = sample[:k], np.ones(min(k, len(sample)))
    step = max(1, _SLICE // max(1, len(c)))
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(sample), step)])
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        sizes = np.diff(np.append(starts, len(own)))
        length = np.sqrt((sums * sums).sum(axis=1))
        c, sizes = sums[length > _EPS] / length[length > _EPS, None], sizes[length > _EPS]
        if not len(c):
            c, sizes = sample[:1], np.ones(1)
    c = c[np.argsort(-sizes, kind="stable")]
    kept, half = np.ones(len(c), bool), math.cos(math.acos(tau) / 2)
    for i in range(len(c)):
        if kept[i]:
            kept[i + 1 :] &= c[i + 1 :] @ c[i] < half
    about = sample - sample.mean(axis=0)
    cov = about.T @ about
    effective = max(1.0, float(np.trace(cov)) ** 2 / max(float((cov * cov).sum()), 1e-300))
    margin = min(math.sqrt(1 - tau * tau), spread * math.sqrt(2 - 2 * tau) / math.sqrt(effective))
    return Cells(c[kept], margin, math.acos(tau) / 16)


def placements(x: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest, angle to the cell's centroid) of unit rows: each in its nearest centroid's cell, and as a guest in larger cells whose border is within the margin."""
    wide, c = x.shape[1], cells.at.shape[1]
    near = (x if wide <= c else x[:, :c]) @ cells.at[:, : min(wide, c)].T
    home = near.argmax(axis=1)
    top = near[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(2 - 2 * (cells.at @ cells.at.T), 1e-12))
    inside = top[:, None] - near <= cells.margin * apart[home]
    inside &= np.arange(len(cells.at)) < home[:, None]
    row, cell = np.nonzero(inside)
    rows, all_ = np.concatenate((np.arange(len(x)), row)), np.concatenate((home, cell))
    guest = np.repeat([False, True], [len(x), len(row)])
    return rows, all_, guest, np.arccos(np.clip(near[rows, all_], -1, 1))


@dataclass
class Plan:
    """How the vectors of a cell too large for one block are dealt out: bands of consecutive rings, each of one kind (home or guest) and split by hash of the vector into as many blocks as it needs."""

    band: dict[tuple[bool, int], int] = field(default_factory=dict)
    blocks: list[int] = field(default_factory=list)
    compared: list[list[int]] = field(default_factory=list)
    #: Copies in bands of which every vector is linked with all of this band, this band's own included; whether it is among them; a vector that stands for all these.
    linked: list[int] = field(default_factory=list)
    within: list[bool] = field(default_factory=list)
    star: list[int | None] = field(default_factory=list)


def plan_cell(rings: list[tuple[bool, int, int, float, float, int, int]], theta: float, block: int) -> Plan:
    """rings: (guest, ring, vectors, least and largest angle, copies, least node), of one cell.

    Two vectors at angles a and b from the centroid are linked if a + b lies within the threshold's angle, and aren't if |a - b| lies outside;
    only bands between which neither is sure are compared, so a crowd of near copies round a centroid costs no products.
    """
    plan, bands = Plan(), []
    for guest, ring, n, lo, hi, copies, node in sorted(rings):
        last = bands[-1] if bands else None
        if last and last["guest"] == guest and last["n"] + n <= block and not (2 * last["hi"] <= theta < 2 * hi):
            last.update(n=last["n"] + n, hi=max(last["hi"], hi), copies=last["copies"] + copies, node=min(last["node"], node))
        else:
            bands.append({"guest": guest, "n": n, "lo": lo, "hi": hi, "copies": copies, "node": node})
        plan.band[guest, ring] = len(bands) - 1
    for i, a in enumerate(bands):
        compared, linked, within, star = [], 0, False, None
        for j, b in enumerate(bands):
            if a["guest"] and b["guest"]:
                continue
            if a["hi"] + b["hi"] <= theta - _EPS:
                linked += b["copies"]
                within |= i == j
                if star is None or b["hi"] < bands[star]["hi"]:
                    star = j
            elif max(a["lo"] - b["hi"], b["lo"] - a["hi"]) <= theta + _EPS:
                compared.append(j)
        plan.blocks.append(-(-a["n"] // block))
        plan.compared.append(compared)
        plan.linked.append(linked)
        plan.within.append(within)
        plan.star.append(None if star is None else bands[star]["node"])
    return plan


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches over the edges (a, b)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        np.minimum.at(least, before, least)
        least = least[least]
        if (least == before).all():
            return least


def linked_in_block(x: np.ndarray, y: np.ndarray | None, xw: np.ndarray, yw: np.ndarray | None, guest: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(copies linked with each vector, one vector of each one's component) over x and y one after the other; y None: x with itself, guests not among each other."""
    n, other = len(x), x if y is None else y
    links = np.zeros(n + (0 if y is None else len(y)), np.int64)
    left, right = [], []
    step = max(1, _SLICE // 2 // max(1, len(other)))
    for i in range(0, n, step):
        hit = x[i : i + step] @ other.T >= tau
        if y is None:
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
            hit[guest[i : i + step]] &= ~guest
        r, s = np.nonzero(hit)
        if not len(r):
            continue
        np.add.at(links, r + i, (xw if y is None else yw)[s])
        if y is not None:
            np.add.at(links, s + n, xw[r + i])
        # One star a component of a slice is kept, not all its links.
        r, s = r + i, s + (0 if y is None else n)
        some, place = np.unique(np.concatenate((r, s)), return_inverse=True)
        root = some[forest(len(some), place[: len(r)], place[len(r) :])]
        left.append(some)
        right.append(root)
    if not left:
        return links, np.arange(len(links))
    return links, forest(len(links), np.concatenate(left), np.concatenate(right))


def _unit_slices(batch: pa.RecordBatch, at: int, cells: int):
    """(rows, unit matrix) for each length of vector in a batch, some rows at a time."""
    size = vectors.lengths(batch.column(at))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        for some in np.array_split(rows, -(-len(rows) * max(cells, int(d)) // _SLICE)):
            mask = np.zeros(len(size), bool)
            mask[some] = True
            yield int(d), some, unit(vectors.matrix(batch.column(at), mask))


def near_duplicate_vectors(
    df: DataFrame, tau: float = 0.9, spread: float = 2.2, cells: int | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Links vectors of equal length whose cosine, in double precision, is tau or more.

    Returns a row per row: vec_id, n_links (other vectors it is linked with), component_id (smallest id that links reach), kept (whether it is that one).

    1. Equal vectors are one from here on, with a count. A cell each for sqrt(n) / 2 centroids (at most MOST_CELLS) is fitted by spherical k-means on a
       sample of at most 8 vectors a cell and 2,048 more.
    2. Every vector is put in its nearest cell and, near a border, as a guest in the larger cell beyond it; the larger cell alone compares that pair.
    3. Within a cell all vectors are multiplied by blocks. A cell too large for one block is dealt out by bands of angle to the centroid (see plan_cell),
       of which only those are compared where neither linked nor apart is sure. A block gives counts and a spanning
       star of what is linked, never all pairs.

    No pair below tau is linked. Links across cells are missed where both vectors lie farther from the border than the margin (see fit_cells); `spread`
    sets it: 2.2 expects to find 97 in 100 links even of pairs that lie at the threshold itself and point anywhere, inf finds all.

    Null vectors, those without components, of zeros only, or with null or non-finite components have no links and are their own component.
    A vector counts as linked with its copies. Rows of equal id each count. A null id reaches no one's component_id: it stays null only where no
    other id is reached, and is kept there. Other columns are not looked at.
    """
    spark, theta = df.sparkSession, math.acos(tau)
    kind = df.schema[vector_col].dataType
    column = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), column.alias("v")).withColumn("ok", F.coalesce(good, F.lit(False)))
    keyed = rows.withColumns({"k1": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")), "k2": F.when(F.col("ok"), F.xxhash64(F.lit(2), "v"))})
    one = keyed.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    nodes, n = numbered(one, "node", 0, "vectors")
    plain = keyed.select("vec_id", "k1", "k2")
    done = {"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id"), "kept": F.lit(True)}
    if not n:
        return plain.select("vec_id", *(e.alias(c) for c, e in done.items()))

    k = min(MOST_CELLS, cells or math.ceil(math.sqrt(n) / 2))
    longest = nodes.agg(F.max(F.size("v"))).first()[0]
    want = max(1, min(SAMPLE_PER_CELL * k + 2048, SAMPLE_COMPONENTS // longest))
    drawn = nodes.where(F.pmod(F.xxhash64("k1"), F.lit(1_000_000)) * F.lit(n) < F.lit(want * 1_000_000)) if n > want else nodes
    found = drawn.select("k1", "k2", "v").limit(2 * want).toArrow()
    found = found.take(np.lexsort((found["k2"].to_numpy(), found["k1"].to_numpy())))
    column = found["v"].combine_chunks()
    size = vectors.lengths(column)
    sample = np.zeros((len(size), size.max(initial=1)))
    for d in np.unique(size):
        sample[size == d, :d] = unit(vectors.matrix(column, size == d))
    if not len(sample):
        raise RuntimeError("no vector drawn into the sample")
    shared = spark.sparkContext.broadcast(fit_cells(sample, k, tau, spread))

    def counted(batches):
        c = shared.value
        for batch in batches:
            node, copies = (batch.column(i).to_numpy() for i in (0, 1))
            for d, some, x in _unit_slices(batch, 2, len(c.at)):
                row, cell, guest, angle = placements(x, c)
                ring = np.floor(angle / c.ring).astype(np.int64)
                key = ((np.int64(d) * (MOST_CELLS + 1) + cell) * 2 + guest) * 1024 + ring
                order = np.argsort(key, kind="stable")
                u, starts, many = np.unique(key[order], return_index=True, return_counts=True)
                by = lambda f, v: f.reduceat(v[order], starts)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (u, many, by(np.minimum, angle), by(np.maximum, angle), by(np.add, copies[some][row]), by(np.minimum, node[some][row]))], names=["key", "n", "lo", "hi", "copies", "node"])

    # A row for each ring of a cell. Those of cells beyond one block, whose number is bounded by that of cells, come to the driver.
    rings = nodes.select("node", "copies", "v").mapInArrow(counted, "key long, n long, lo double, hi double, copies long, node long")
    rings = durable(rings.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("copies").alias("copies"), F.min("node").alias("node")).withColumn("cell", F.expr("key div 2048")), "rings")
    large = rings.groupBy("cell").agg(F.sum("n").alias("of_cell")).where(F.col("of_cell") > block).select("cell")
    by_cell: dict[int, list] = {}
    for key, m, lo, hi, copies, node, cell in rings.join(large, "cell").select("key", "n", "lo", "hi", "copies", "node", "cell").toLocalIterator():
        by_cell.setdefault(cell, []).append((bool(key // 1024 % 2), key % 1024, m, lo, hi, copies, node))
    plans = spark.sparkContext.broadcast({cell: plan_cell(r, theta, block) for cell, r in by_cell.items()})

    def bands(x: np.ndarray, d: int, c: Cells):
        """(row, cell, guest, plan, band): of rows in small cells plan and band are None."""
        row, cell, guest, angle = placements(x, c)
        ring = np.floor(angle / c.ring).astype(np.int64)
        cell = np.int64(d) * (MOST_CELLS + 1) + cell
        for u in np.unique(cell):
            at = np.flatnonzero(cell == u)
            plan = plans.value.get(int(u))
            if plan is None:
                yield row[at], u, guest[at], None, None
                continue
            band = np.array([plan.band[bool(g), int(r)] for g, r in zip(guest[at], ring[at])])
            for b in np.unique(band):
                yield row[at[band == b]], u, guest[at[band == b]], plan, int(b)

    def jobs(batches):
        c = shared.value
        for batch in batches:
            node = batch.column(0).to_numpy()
            for d, some, x in _unit_slices(batch, 2, len(c.at)):
                out = []
                for row, cell, guest, plan, b in bands(x, d, c):
                    row = some[row]
                    if plan is None:
                        out.append((row, np.full(len(row), cell), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), bool), guest))
                        continue
                    salt = node[row] % plan.blocks[b]
                    for o in plan.compared[b]:
                        for t in range(plan.blocks[o]):
                            # The first side is the smaller (band, block); one that meets itself has one side.
                            first = np.full(len(row), b < o) if b != o else salt <= t
                            lo, hi = np.where(first, salt, t), np.where(first, t, salt)
                            pair = (min(b, o) << 32) + max(b, o)
                            out.append((row, np.full(len(row), cell), np.full(len(row), pair), (lo << 32) + hi, ~first, guest))
                if out:
                    row, cell, pair, salts, side, guest = (np.concatenate(v) for v in zip(*out))
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pair), pa.array(salts), pa.array(side), pa.array(guest), *taken.columns], names=[*_JOB, "side", "guest", "node", "copies", "v"])

    def compare(table: pa.Table) -> pa.Table:
        side, guest, node, copies = (table[c].to_numpy() for c in ("side", "guest", "node", "copies"))
        column = table["v"].combine_chunks()
        order = np.lexsort((node, side))
        x = unit(vectors.matrix(column, np.ones(len(side), bool)))[order]
        side, guest, node, copies = side[order], guest[order], node[order], copies[order]
        m = int((~side).sum())
        same = table["salts"][0].as_py() >> 32 == table["salts"][0].as_py() & 0xFFFFFFFF and table["pair"][0].as_py() >> 32 == table["pair"][0].as_py() & 0xFFFFFFFF
        if same:
            links, root = linked_in_block(x, None, copies, None, guest, tau)
        else:
            links, root = linked_in_block(x[:m], x[m:], copies[:m], copies[m:], guest, tau)
        some = links > 0
        return pa.table([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["node", "links", "other"])

    element = nodes.schema["v"].dataType.simpleString()
    shipped = nodes.select("node", "copies", "v").mapInArrow(jobs, f"cell long, pair long, salts long, side boolean, guest boolean, node long, copies long, v {element}")
    links = shipped.groupBy(*_JOB).applyInArrow(compare, "node long, links long, other long")
    if by_cell:

        def sure(batches):
            c = shared.value
            for batch in batches:
                node, copies = (batch.column(i).to_numpy() for i in (0, 1))
                for d, some, x in _unit_slices(batch, 2, len(c.at)):
                    for row, _, _, plan, b in bands(x, d, c):
                        if plan is not None and plan.linked[b]:
                            row = some[row]
                            many = plan.linked[b] - (copies[row] if plan.within[b] else 0)
                            yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(many + np.zeros(len(row), np.int64)), pa.array(np.full(len(row), plan.star[b]))], names=["node", "links", "other"])

        links = links.unionByName(nodes.select("node", "copies", "v").mapInArrow(sure, "node long, links long, other long"))
    links = durable(links, "vector-links")
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.select("k1", "k2", "node", "rep", "copies").join(sums, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = whole.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    given = plain.where("k1 is not null").join(facts, ["k1", "k2"])
    linked = given.select("vec_id", F.col("links").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(plain.where("k1 is null").select("vec_id", *(e.alias(c) for c, e in done.items())))


#: The same in SQL, over all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS MATERIALIZED (SELECT r, vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(many.n, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN many ON many.a = v.vec_id
"""
