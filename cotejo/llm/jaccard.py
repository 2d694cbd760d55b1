"""Near-duplicate documents by an exact n-gram Jaccard join (grouped prefix join)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.exchange import PACK_SCHEMA, Packer, groups_of, read_packs
from cotejo.llm.graph import connected_components
from cotejo.llm.shared import bound_batches, durable, partitions

_ENTRY = np.dtype([("key", np.uint64), ("set", np.int64)])
#: Bucket entries that only pass through the exchange: a document's set.
_INFO_SCHEMA = "set long, shared long, doc_id long, n long, mark long"


def shingle_sets(batch_ids: list, data: np.ndarray, offsets: np.ndarray, n: int):
    """(row, sorted distinct shingle hashes) of every text that has words; a text of fewer than n words is one shingle."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(~K.SPACE[data], offsets)
    words = K.word_hashes(data, starts, ends)
    grams = K.gram_hashes(words, n)
    for row in range(len(batch_ids)):
        a, b = first[row], first[row + 1]
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            yield row, h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h
        elif b > a:
            short = np.array([b - a], np.uint64) * K._STEP[254]
            for k in range(b - a):
                short = short + words[a + k : a + k + 1] * K._STEP[k + 128]
            yield row, K.mix(short)


def set_id(hashes: np.ndarray) -> int:
    return int(K.mix(K.mix(np.array([hashes.sum(), hashes[0], len(hashes)], np.uint64)) * np.array([1, 3, 5], np.uint64)).sum().astype(np.int64))


def misses(n, num: int, den: int):
    """Most members of a set of size n that a linked set can lack; for numbers, arrays and columns."""
    if isinstance(n, Column):
        return (n - F.floor((num * n + (den - 1)) / F.lit(den))).cast("long")
    return n - (num * n + den - 1) // den


def spare(n):
    """How many shared members a linked pair has at least among the first misses + 1 + spare of each, less one."""
    if isinstance(n, Column):
        return F.greatest(F.floor(n / 25), F.lit(6)).cast("long")
    return max(n // 25, 6)


def _head(n: int, num: int, den: int) -> int:
    return min(n, misses(n, num, den) + 1 + spare(n))


def _several(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the keys in entries that are in order of key and set; for each entry, whether another set has its key too."""
    cut = groups_of(entries["key"])
    return cut, np.repeat(entries["set"][cut[:-1]] != entries["set"][cut[1:] - 1], np.diff(cut))


def _send_local(entries: np.ndarray):
    """Of a key that several sets share, the first and last set go out; the outcome of those between is known."""
    cut, several = _several(entries)
    several[cut[:-1]] = False
    several[cut[1:] - 1] = False
    return entries[~several], entries[several]


def _shared_counts(entries: np.ndarray, known: np.ndarray) -> pa.Table:
    sets = known["set"]
    if len(entries):
        sets = np.concatenate((sets, entries["set"][_several(entries)[1]]))
    sets, counts = np.unique(sets, return_counts=True)
    none = pa.nulls(len(sets), pa.int64())
    return pa.table([pa.array(sets, pa.int64()), pa.array(counts, pa.int64()), none, none, none], names=["set", "shared", "doc_id", "n", "mark"])


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Links texts whose n-word shingle sets have den * |A and B| >= num * |A or B|.

    Returns one row per row of docs: doc_id, n_shingles, component_id (the smallest id that
    links reach, its own included), mark (xxhash64 of the text, which tells rows of one id apart), cluster (a number for
    what links reach, null without words: unlike component_id it tells unlinked texts of one id apart).
    The join is exact, in these steps:

    1. Equal sets are one set from here on. Each sends a little more than a prefix of its
       hashes (in order of hash) through an exchange, which counts how many of them some
       other set has too. A linked pair has `spare + 1` of them in common, so sets with
       fewer leave.
    2. For the sets left, members are ordered by how many sets have them, rarest first;
       those of one set only stand in front and are merely counted. The prefix is the first
       `misses + 1` members. Sets of equal prefix and size form one group.
    3. Group pairs that share a prefix member pass a length and a positional filter, then
       are expanded, and their members are verified on all shingles. A first round pairs
       each group with one hub for each member; a second takes all pairs left between
       different components, so no link between components is lost while a group
       of thousands of near copies does not make all its pairs.

    No words or null text: n_shingles 0, linked with nothing, component_id its own id. Rows
    of equal id are kept each. A null id stays null and reaches others only as an equal set.
    Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = partitions(spark, docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))

    def heads(batches):
        packer = Packer(_ENTRY, buckets, _send_local)
        met = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, end, data, offsets in K.slices(batch.column(1)):
                keys, sets, info = [], [], {r: (0, 0) for r in range(row, end)}
                for r, h in shingle_sets(ids[row:end], data, offsets, n):
                    s = set_id(h)
                    info[row + r] = (s, len(h))
                    if s in met:
                        continue
                    met.add(s)
                    take = _head(len(h), num, den)
                    # The least hashes crowd at one end; mixed, they spread over all ranges.
                    keys.append(K.mix(h[:take]))
                    sets.append(np.full(take, s, np.int64))
                if keys:
                    yield from tagged(packer.add(key=np.concatenate(keys), set=np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(info), pa.int32()), pa.nulls(len(info), pa.binary()), pa.nulls(len(info), pa.binary()), pa.array([s for s, _ in info.values()], pa.int64()), pa.array([ids[r] for r in info], pa.int64()), pa.array([c for _, c in info.values()], pa.int64()), batch.column(2).slice(row, end - row)],
                    names=["bucket", "pack", "known", "set", "doc_id", "n", "mark"],
                )
        yield from tagged(packer.flush())

    def tagged(packs):
        for p in packs:
            none = pa.nulls(p.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*p.columns, none, none, none, none], names=[*p.schema.names, "set", "doc_id", "n", "mark"])

    # One pass over the texts: documents' own rows ride along with the packs as buckets of their own.
    seen = texts.mapInArrow(heads, PACK_SCHEMA + ", set long, doc_id long, n long, mark long")
    seen = seen.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "set"), F.lit(buckets)).cast("int")))

    def outcome(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("n").is_valid())
        packed = table.filter(table.column("pack").is_valid())
        found = _shared_counts(read_packs(packed, "pack", _ENTRY), read_packs(packed, "known", _ENTRY))
        return pa.concat_tables([found, pa.table([own["set"].combine_chunks(), pa.nulls(own.num_rows, pa.int64()), own["doc_id"].combine_chunks(), own["n"].combine_chunks(), own["mark"].combine_chunks()], names=found.schema.names)])

    info = durable(seen.groupBy("bucket").applyInArrow(outcome, _INFO_SCHEMA), "shingle-info")
    rows = info.where("n is not null").select("doc_id", "n", "set", "mark")
    sets = rows.where("n > 0").groupBy("set", "n").agg(F.min("doc_id").alias("rep"))
    shared = info.where("n is null").groupBy("set").agg(F.sum("shared").alias("shared"))
    head = F.least(F.col("n"), misses(F.col("n"), num, den) + 1 + spare(F.col("n")))
    left = sets.join(shared, "set").where(F.col("shared") >= head - misses(F.col("n"), num, den))
    links = _links(texts, left, n, num, den)
    component = connected_components(links).withColumnsRenamed({"node": "set", "component": "head"})

    # A component is named by a set; its smallest document comes from all sets in it.
    named = sets.join(component, "set", "left").withColumn("head", F.coalesce("head", "set"))
    least = named.groupBy("head").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "head").select("set", "n", "component_id", F.col("head").alias("cluster"))
    return rows.join(named, ["set", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark", "cluster")


def _links(texts: DataFrame, left: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Verified pairs (a, b) of sets that connect all that should be connected."""

    def members(batches):
        for batch in batches:
            ids, want = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, end, data, offsets in K.slices(batch.column(1)):
                got = [(want[row + r], h) for r, h in shingle_sets(ids[row:end], data, offsets, n) if set_id(h) == want[row + r]]
                if got:
                    sizes = np.array([len(h) for _, h in got])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _ in got], pa.int64()), pa.array(sizes, pa.int64()), K.list_array(np.concatenate([h for _, h in got]).view(np.int64), np.concatenate(([0], np.cumsum(sizes))), pa.int64())], names=["set", "n", "members"]
                    )

    found = texts.join(left.select(F.col("rep").alias("doc_id"), "set").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "set")
    full = durable(found.mapInArrow(members, "set long, n long, members array<long>"), "shingle-sets")
    member = full.select("set", "n", F.explode("members").alias("m"))
    freq = member.groupBy("m").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = member.join(freq, "m").groupBy("set", "n").agg(F.sort_array(F.collect_set(F.struct("df", "m"))).alias("c"))
    most = misses(F.col("n"), num, den)
    common = common.select("set", "n", F.expr("transform(c, x -> x.m)").alias("members"), (F.col("n") - F.size("c")).alias("own")).where(F.col("own") <= most)
    common = durable(common, "shingle-common")

    # Groups of equal size and prefix. hash of the prefix stands for it; members are verified one by one later.
    prefix = F.slice("members", F.lit(1), (misses(F.col("n"), num, den) + 1 - F.col("own")).cast("int"))
    prefixed = common.select("set", "n", "own", prefix.alias("prefix")).withColumn("by", F.xxhash64("prefix"))
    leaders = prefixed.groupBy("n", "own", "by").agg(F.min("set").alias("g"), F.count(F.lit(1)).alias("size"))
    grouped = durable(prefixed.join(leaders, ["n", "own", "by"]).select("set", "n", "own", "g", "size", F.when(F.col("set") == F.col("g"), F.col("prefix")).alias("prefix")), "shingle-groups")
    index = grouped.where("set = g").select("g", "n", "own", F.posexplode("prefix").alias("i", "m")).withColumn("pos", F.col("own") + F.col("i"))

    hub = index.groupBy("m").agg(F.min(F.struct("own", "g", "n", "pos")).alias("h")).select("m", F.col("h.g").alias("hg"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos"))

    def passes(na, pa_, nb, pb):
        """Length and positional filter on the sizes and places of a pair's common member."""
        a, b, x, y = map(F.col, (na, nb, pa_, pb))
        return (a * den >= b * num) & (b * den >= a * num) & ((F.least(a - x, b - y)) * (num + den) >= (a + b) * num)

    stars = index.join(hub, "m").where((F.col("g") != F.col("hg")) & passes("n", "pos", "hn", "hpos")).select("g", "hg").distinct()
    expanded = grouped.join(stars, "g").select(F.col("set").alias("a"), F.col("hg").alias("b"))
    within = grouped.where("set <> g").select(F.col("set").alias("a"), F.col("g").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        one = common.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
        two = common.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
        both = pairs.join(one, "a").join(two, "b").withColumn("same", F.size(F.array_intersect("ma", "mb")))
        return both.where(F.col("same") * den >= (F.col("na") + F.col("nb") - F.col("same")) * num).select("a", "b")

    first = durable(verified(expanded.unionByName(within)), "links")
    parts = connected_components(first)
    # A group's members can be in several components; a member that all of one component share makes no pair.
    placed = durable(grouped.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set")).select("set", "g", "size", "component"), "placed")
    span = placed.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    index = index.join(span, "g")
    mixed = index.groupBy("m").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select("m")
    rest = durable(index.join(mixed, "m"), "mixed")
    other = rest.select("m", *(F.col(c).alias(f"{c}2") for c in ("g", "n", "pos", "lo", "hi")))
    differ = (F.col("lo") != F.col("lo2")) | (F.col("hi") != F.col("hi2")) | (F.col("lo") != F.col("hi"))
    pairs = rest.join(other, "m").where((F.col("g") <= F.col("g2")) & differ & passes("n", "pos", "n2", "pos2")).select("g", F.col("g2")).where("g <> g2").distinct()
    split = span.where("lo <> hi").select("g", F.col("g").alias("g2"))
    a, b = placed.select("g", F.col("set").alias("a"), F.col("component").alias("ca")), placed.select(F.col("g").alias("g2"), F.col("set").alias("b"), F.col("component").alias("cb"))
    crossing = pairs.unionByName(split).join(a, "g").join(b, "g2").where("ca <> cb").select("a", "b")
    return first.unionByName(durable(verified(crossing), "links"))
