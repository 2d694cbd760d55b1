"""Removal of repeated byte strings by suffix arrays of shards, merged across shards."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.exchange import PACK_SCHEMA, Packer, groups_of, lists_by, read_packs
from cotejo.llm.repeats import _INFO, INFO_SCHEMA, anchor_table, first_texts, rows_only, searched, send_anchors, several_places, text_key, wanted_texts, with_empty
from cotejo.llm.shared import bound_batches, durable, partitions

_CLASS = np.dtype([("key", np.uint64), ("doc", np.int64), ("pos", np.uint32)])
_PRINT = np.dtype([("key", np.uint64), ("text", np.int64), ("pos", np.uint32), ("more", np.uint32)])
#: Bytes of candidate regions in one shard's suffix array.
SHARD_BYTES = 2 << 20
#: Bytes hashed for a fingerprint of the candidate search.
PRINT = 40
#: A place and how often its fingerprint stands anywhere make one number; 0 where that isn't known.
COUNT_BITS = 20
_MOST_COUNTED = (1 << COUNT_BITS) - 1


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number that sorts as they do; zeros stand past the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    return word


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array (Larsson-Sadakane refinement).

    Groups of equal prefix are refined by the rank of the suffix that starts where the
    known prefix ends, which doubles that prefix; suffixes alone in a group are left out.
    """
    n = len(data)
    first = big_endian_words(data)
    order = np.argsort(first, kind="stable")
    sorted_ = first[order]
    head = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if n else np.zeros(0, bool)
    known = 8
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group
    # Place in order of every suffix whose group has others.
    open_ = np.flatnonzero(~(head & np.concatenate((head[1:], [True])))) if n else np.zeros(0, np.int64)
    while len(open_):
        suffix = order[open_]
        # Both ranks fit in 31 bits: a shard is far smaller than 2 GB.
        key = (rank[suffix] << 32) | (rank[np.minimum(suffix + known, n)] + 1)
        by = np.argsort(key, kind="stable")
        order[open_] = suffix = suffix[by]
        key = key[by]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffix] = open_[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        open_ = open_[~(head & np.concatenate((head[1:], [True])))]
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of the prefix that each suffix shares with the one before it in order (Kasai).

    Kasai's walk in order of text: the length for the next suffix is at least one less. The
    text is walked in many lanes at once, each with a length of its own; 8 bytes are compared at a time.
    """
    n = len(data)
    result = np.zeros(n, np.int32)
    if n < 2:
        return result
    word = np.concatenate((big_endian_words(data), np.zeros(most + 8, np.uint64)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    step = max(64, int(n**0.5) // 4)
    lanes = np.arange(0, n, step)
    h = np.zeros(len(lanes), np.int64)
    for k in range(step):
        i = lanes + k
        live = i < n
        lanes, h, i = lanes[live], h[live], i[live]
        j = before[i]
        h = np.maximum(h - 1, 0)
        h[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (h < most))
        while len(going):
            x = word[i[going] + h[going]] ^ word[j[going] + h[going]]
            same = x == 0
            if not same.all():
                rest = x[~same]
                h[going[~same]] += sum((rest < np.uint64(1 << b)).astype(np.int64) for b in (56, 48, 40, 32, 24, 16, 8))
            going = going[same]
            h[going] += 8
            going = going[(h[going] < most) & (np.maximum(i[going], j[going]) + h[going] < n)]
        h = np.minimum(h, np.minimum(most, n - np.maximum(i, j)))
        result[rank[i]] = h
    return result


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Every place whose hash is the least of some run of `width` hashes."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    border = np.zeros(width - 1, np.uint64)
    least = np.concatenate((border, _sliding_least(hashes, width), border))
    return np.flatnonzero(hashes == ~_sliding_least(~least, width))


def send_prints(entries: np.ndarray):
    """As send_anchors; the first entry of a key also says how many stay behind."""
    cut = groups_of(entries["key"])
    entries["more"][cut[:-1]] = np.maximum(np.diff(cut) - 2, 0)
    return send_anchors(entries)


def shared_prints(entries: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of fingerprints that stand elsewhere too, each place with the number of places of its fingerprint."""
    cut, several = several_places(entries)
    order = np.lexsort((entries["pos"], entries["text"], entries["key"]))
    own = entries[order]
    other = np.ones(len(own), bool)
    other[1:] = (own["key"][1:] != own["key"][:-1]) | (own["text"][1:] != own["text"][:-1]) | (own["pos"][1:] != own["pos"][:-1])
    total = np.add.reduceat(other + own["more"].astype(np.int64), cut[:-1]) if len(own) else np.zeros(0, np.int64)
    total = np.repeat(np.minimum(total, _MOST_COUNTED), np.diff(cut))[several]
    places = np.concatenate(((entries["pos"][several].astype(np.int64) << COUNT_BITS) | total, known["pos"].astype(np.int64) << COUNT_BITS))
    return np.concatenate((entries["text"][several], known["text"])), places


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_text: bool = False) -> DataFrame:
    """Removes every byte of the UTF-8 texts that a string of `length` bytes covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also mark (xxhash64 of the text, which tells rows of
    one id apart) and kept_text (null where nothing was removed; code points cut by a border are left out).

    1. Candidates: of the hashes of 40 bytes inside every `length` bytes the least is a
       fingerprint (winnowing), chosen by content alone, so a repeated string has one that
       stands elsewhere too. Only the regions round such fingerprints go on.
    2. Regions lie near those that share their least fingerprint (a range partitioning, which
       splits frequent ones by document), in shards of bounded size. Kasai's common prefixes
       cut a shard's suffix array into classes of strings equal for `length` bytes. Classes
       of several members are settled.
    3. A class whose own fingerprint stands outside the shard too goes as one hash to its range
       of hashes, where the sorted lists of all shards
       are merged by binary search; a class that another shard has too is settled as well.
    4. Equal texts of `length` bytes or more are wholly repeated; one of them stands for all in steps 1 to 3.

    Null text is empty. Rows of equal id and text count as one document (a table read
    twice is not a repeat). Rows of equal id and different texts are a document each; a text of several ids goes whole.
    A null id takes no part. Other columns are not looked at.
    """
    spark, width = docs.sparkSession, length - PRINT + 1
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))

    def prints(buckets):
        def run(batches):
            packer, met = Packer(_PRINT, buckets, send_prints), set()
            for batch in batches:
                ids = batch.column(0)
                for row, end, data, offsets in K.slices(batch.column(1)):
                    view = memoryview(data)
                    shas = [hashlib.sha256(view[offsets[r] : offsets[r + 1]]).hexdigest() for r in range(end - row)]
                    sums = K.prefix_sums(data)
                    places = np.arange(max(0, len(data) - PRINT + 1))
                    hashes = K.span_hashes(sums, places, places + PRINT)
                    keys, owner, pos = [], [], []
                    text_keys = [text_key(s) for s in shas]
                    for r, (sha, k) in enumerate(zip(shas, text_keys)):
                        if offsets[r + 1] - offsets[r] < length or not ids[row + r].is_valid or sha in met:
                            continue
                        met.add(sha)
                        own = hashes[offsets[r] : offsets[r + 1] - PRINT + 1]
                        at = winnowed(own, width)
                        # The least hashes crowd at one end; mixed, they spread over all ranges.
                        keys.append(K.mix(own[at]))
                        owner.append(np.full(len(at), k, np.int64))
                        pos.append(at)
                    if keys:
                        yield from with_empty(packer.add(key=np.concatenate(keys), text=np.concatenate(owner), pos=np.concatenate(pos), more=0), _INFO)
                    yield rows_only([("doc_id", ids.slice(row, end - row)), ("size", pa.array(np.diff(offsets), pa.int64())), ("sha", pa.array(shas)), ("mark", batch.column(2).slice(row, end - row)), ("text_key", pa.array(text_keys, pa.int64()))])
            yield from with_empty(packer.flush(), _INFO)

        return run

    shared, info = anchor_table(texts, prints, INFO_SCHEMA, _PRINT, shared_prints)
    first_of = first_texts(info)
    some = durable(searched(texts, wanted_texts(first_of, shared)), "suffix-texts")
    parts = partitions(spark, docs)
    buckets = 2 * parts

    def regions(batches):
        """The stretches of the texts round their fingerprints; near: the least fingerprint in one."""
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for row, end, data, offsets in K.slices(batch.column(1)):
                sums = K.prefix_sums(data)
                for r in range(end - row):
                    listed = batch.column(3)[row + r]
                    if listed.is_valid:
                        marks = listed.values.to_numpy()
                    else:
                        places = np.arange(offsets[r], max(offsets[r], offsets[r + 1] - PRINT + 1))
                        marks = winnowed(K.span_hashes(sums, places, places + PRINT), width) << COUNT_BITS
                    if not len(marks):
                        continue
                    # Of a place listed twice the first, the smaller count, stays.
                    at, first = np.unique(marks >> COUNT_BITS, return_index=True)
                    low = np.maximum(at - width + 1, 0)
                    high = np.minimum(at + length, offsets[r + 1] - offsets[r])
                    cut = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
                    least = np.minimum.reduceat(K.span_hashes(sums, offsets[r] + at, offsets[r] + at + PRINT), cut)
                    for k, (i, j) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(at)])):
                        a, b = int(low[i]), int(high[j - 1])
                        if b - a >= length:
                            out.append((ids[row + r], a, int(least[k].view(np.int64)), data[offsets[r] + a : offsets[r] + b].tobytes(), marks[first[i:j]] - (a << COUNT_BITS)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "a", "near", "body", "marks"])

    def shards(batches):
        gathered, size = [], 0
        packer = Packer(_CLASS, buckets, lambda e: (e, e[:0]))
        runs = [("doc_id", pa.int64()), ("pos", pa.list_(pa.int64())), ("len", pa.list_(pa.int64()))]

        def settled(taken):
            for x in _settle(taken, length, packer):
                yield x if "len" in x.schema.names else next(with_empty([x], runs))

        for batch in batches:
            for doc, a, body, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)):
                gathered.append((doc, a, np.frombuffer(body.as_buffer(), np.uint8).copy(), marks.values.to_numpy()))
                size += len(gathered[-1][2])
                if size >= SHARD_BYTES:
                    yield from settled(gathered)
                    gathered, size = [], 0
        yield from settled(gathered)
        yield from with_empty(packer.flush(), runs)

    placed = some.mapInArrow(regions, "doc_id long, a long, near long, body binary, marks array<long>")
    placed = placed.repartitionByRange(parts, "near", "doc_id", "a").sortWithinPartitions("near", "doc_id", "a")
    classes = placed.mapInArrow(shards, f"{PACK_SCHEMA}, doc_id long, pos array<long>, len array<long>")
    classes = classes.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")))

    def merge(table: pa.Table) -> pa.Table:
        packed, own = table.filter(table["pack"].is_valid()), table.filter(table["pack"].is_null())
        entries = read_packs(packed, "pack", _CLASS)
        # Each shard sent a class once: two of a hash in the merged list are two shards.
        merged = entries["key"]
        times = np.searchsorted(merged, merged, "right") - np.searchsorted(merged, merged, "left")
        found = entries[(times > 1) & (entries["doc"] >= 0)]
        found = found[np.lexsort((found["pos"], found["doc"]))]
        start = found["pos"].astype(np.int64)
        cut = np.ones(len(found), bool)
        cut[1:] = (start[1:] != start[:-1] + 1) | (found["doc"][1:] != found["doc"][:-1])
        at = np.flatnonzero(cut)
        lengths = np.diff(np.concatenate((at, [len(found)])))
        one = lists_by(found["doc"][at], start[at], pa.int64(), ["doc_id", "pos"])
        two = lists_by(found["doc"][at], lengths, pa.int64(), ["doc_id", "len"])
        return pa.concat_tables([one.append_column("len", two["len"]), own.select(["doc_id", "pos", "len"])])

    settled = durable(classes.groupBy("bucket").applyInArrow(merge, "doc_id long, pos array<long>, len array<long>"), "settled")
    spans = settled.withColumnRenamed("doc_id", "doc").groupBy("doc").agg(F.flatten(F.collect_list("pos")).alias("pos"), F.flatten(F.collect_list("len")).alias("len"))

    def kept(batches):
        for batch in batches:
            less, count, shas, left = [], [], [], []
            for row, end, data, offsets in K.slices(batch.column(1)):
                for r in range(end - row):
                    own = data[offsets[r] : offsets[r + 1]]
                    at, n = batch.column(3)[row + r].values.to_numpy(), batch.column(4)[row + r].values.to_numpy()
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n - 1 + length, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    rest = own[stay].tobytes()
                    less.append(len(own) - len(rest))
                    count.append(int((~stay & np.concatenate(([True], stay[:-1]))).sum()))
                    shas.append(hashlib.sha256(rest).hexdigest())
                    if keep_text:
                        left.append(rest.decode("utf-8", "ignore"))
            columns = [batch.column(0), batch.column(2), pa.array(less, pa.int64()), pa.array(count, pa.int64()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left if keep_text else [None] * len(less), pa.string())], names=["doc_id", "sha", "less", "spans", "left_sha", "left_text"])

    changed = some.select("doc", "doc_id", "text", "sha").join(spans, "doc").select("doc_id", "text", "sha", "pos", "len").mapInArrow(kept, "doc_id long, sha string, less long, spans long, left_sha string, left_text string")
    whole = info.join(first_of.select("sha", "copies"), "sha", "left").join(changed, ["doc_id", "sha"], "left")
    copy = (F.col("copies") > 1) & (F.col("size") >= length)
    result = whole.select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.when(copy, F.col("size")).otherwise(F.coalesce("less", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("left_text")).alias("kept_text"),
        "mark",
    )
    return result if keep_text else result.drop("kept_text", "mark")


def _settle(regions: list, length: int, packer: Packer):
    """Suffix array, common prefixes and classes of one shard's regions."""
    if not regions:
        return
    data = np.concatenate([x[2] for x in regions])
    sizes = np.array([len(x[2]) for x in regions])
    base = np.concatenate(([0], np.cumsum(sizes)))
    order = suffix_order(data)
    common = common_prefixes(data, order, length)
    region = np.repeat(np.arange(len(sizes)), sizes)
    klass = np.cumsum(common < length)
    valid = order + length <= base[region[order] + 1]
    order, klass = order[valid], klass[valid]
    cut = groups_of(klass)
    docs = np.array([x[0] for x in regions], np.int64)
    shift = np.array([x[1] for x in regions], np.int64) - base[:-1]
    place = order + shift[region[order]]
    doc = docs[region[order]]
    heads = order[cut[:-1]]
    several = np.diff(cut) > 1
    sums = K.prefix_sums(data)
    # A string is known by the least fingerprint in it. If all places of that are here, no other shard has the string; if it isn't listed at all, the string stands once.
    prints = K.span_hashes(sums, np.arange(len(data) - PRINT + 1), np.arange(PRINT, len(data) + 1))
    listed = np.concatenate([x[3] + (int(at) << COUNT_BITS) for x, at in zip(regions, base)])
    names, which, here = np.unique(prints[listed >> COUNT_BITS], return_inverse=True, return_counts=True)
    fewest = np.full(len(names), _MOST_COUNTED)
    np.minimum.at(fewest, which, listed & _MOST_COUNTED)
    abroad = names[(fewest == 0) | (fewest > here) | (fewest == _MOST_COUNTED)]
    goes = np.isin(_sliding_least(prints, length - PRINT + 1)[heads], abroad)
    heads, first = heads[goes], cut[:-1][goes]
    keys = K.span_hashes(sums, heads, heads + length)
    alone = ~several[goes]
    yield from packer.add(key=keys, doc=np.where(alone, doc[first], -1), pos=np.where(alone, place[first], 0))
    found = np.repeat(several, np.diff(cut))
    doc, place = doc[found], place[found]
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        lengths = np.diff(np.concatenate((at, [len(doc)])))
        one, two = (lists_by(doc[at], v, pa.int64(), ["doc_id", n]) for v, n in ((place[at], "pos"), (lengths, "len")))
        yield rows_only([("doc_id", one["doc_id"].combine_chunks()), ("pos", one["pos"].combine_chunks()), ("len", two["len"].combine_chunks())])
