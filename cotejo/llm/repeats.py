"""Removal of word passages that occur earlier in the corpus (difference-cover anchors)."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.exchange import PACK_SCHEMA, PLACES_SCHEMA, Packer, compare, groups_of, placed, places_of, read_packs
from cotejo.llm.shared import bound_batches, durable, partitions
from cotejo.operators.ordering import ranked

#: A perfect difference set: any two places have a step below 13 after which both stand at a residue in it.
PERIOD, COVER = 13, (0, 1, 3, 9)
_ANCHOR = np.dtype([("key", np.uint64), ("text", np.int64), ("pos", np.uint32)])
_WINDOW = np.dtype([("key", np.uint64), ("doc", np.int64), ("pos", np.uint32)])
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def text_key(sha: str) -> int:
    """60 bits of a text's hash. Different texts of equal key are searched whole (see wanted_texts)."""
    return int(sha[:15], 16)


def send_anchors(entries: np.ndarray):
    """Sends the first and last entry of each key; those between are known to be shared if text or place differ."""
    cut, several = several_places(entries)
    several[cut[:-1]] = False
    several[cut[1:] - 1] = False
    middle = np.ones(len(entries), bool)
    middle[cut[:-1]] = False
    middle[cut[1:] - 1] = False
    return entries[~middle], entries[several]


def several_places(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = groups_of(entries["key"])
    if not len(entries):
        return cut, np.zeros(0, bool)
    low, high = np.minimum.reduceat(entries["pos"], cut[:-1]), np.maximum.reduceat(entries["pos"], cut[:-1])
    return cut, np.repeat((entries["text"][cut[:-1]] != entries["text"][cut[1:] - 1]) | (low != high), np.diff(cut))


def shared_anchors(entries: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each anchor that stands elsewhere too."""
    found = np.concatenate((entries[several_places(entries)[1]], known))
    return found["text"], found["pos"].astype(np.int64)


def anchor_table(texts: DataFrame, mapper, more: str, dtype: np.dtype = _ANCHOR, shared=shared_anchors) -> tuple[DataFrame, DataFrame]:
    """Runs mapper over texts once. Its packs of dtype are compared by shared; its other rows (of the columns in more) come back as they are.

    Returns (text_key, pos): the places of anchors that stand elsewhere too, and the other rows.
    """
    ranges = partitions(texts.sparkSession, texts)
    buckets = 2 * ranges
    names = [x.split()[0] for x in more.split(", ")]
    seen = texts.mapInArrow(mapper(buckets), f"{PACK_SCHEMA}, {more}")
    seen = seen.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")))

    def outcome(table: pa.Table) -> pa.Table:
        packed, own = table.filter(table["pack"].is_valid()), table.filter(table["pack"].is_null())
        found = placed(*shared(read_packs(packed, "pack", dtype), read_packs(packed, "known", dtype)), ranges)
        for name in names:
            found = found.append_column(name, pa.nulls(len(found), own.schema.field(name).type))
        head = pa.table([pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())], names=["near", "places"])
        for name in names:
            head = head.append_column(name, own[name])
        return pa.concat_tables([found, head])

    both = durable(seen.groupBy("bucket").applyInArrow(outcome, f"{PLACES_SCHEMA}, {more}"), "anchors")
    return places_of(both.where("near is not null").select("near", "places"), "text_key"), both.where("near is null").select(*names)


def with_empty(packs, fields: list[tuple[str, pa.DataType]]):
    for p in packs:
        yield pa.RecordBatch.from_arrays([*p.columns, *(pa.nulls(p.num_rows, t) for _, t in fields)], names=[*p.schema.names, *(n for n, _ in fields)])


def rows_only(columns: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    n = len(columns[0][1])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *(c for _, c in columns)], names=["bucket", "pack", "known", *(n for n, _ in columns)])


#: Columns of a document's own row: mark is a hash of its text, text_key the part of its sha that anchors carry.
_INFO = [("doc_id", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("mark", pa.int64()), ("text_key", pa.int64())]
INFO_SCHEMA = "doc_id long, size long, sha string, mark long, text_key long"


def first_texts(info: DataFrame) -> DataFrame:
    """Of the rows of each text hash the one with the smallest id: sha, rep (its id), mark (the hash of its text), text_key, copies (how many ids have it), doc (a number of the text, in order of rep and mark)."""
    least = F.min(F.struct("doc_id", "mark")).alias("first")
    one = info.where("doc_id is not null").groupBy("sha").agg(least, F.count_distinct("doc_id").alias("copies"), F.min("text_key").alias("text_key"))
    one = one.select("sha", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "text_key", "copies")
    # Written, so that a join with all rows of a frequent text is one that Spark can split.
    return ranked(one, [F.col("rep"), F.col("mark"), F.col("sha")], "doc", tag="first-texts")


def wanted_texts(first_of: DataFrame, places: DataFrame) -> DataFrame:
    """(rep, mark, sha, doc, pos): the texts that have places (text_key, pos). pos is null, all places, for texts whose key other texts have too: their places can't be told apart."""
    keyed = first_of.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("text_key"))).join(places, "text_key", "left")
    return keyed.where("alike > 1 or pos is not null").select("rep", "mark", "sha", "doc", F.when(F.col("alike") == 1, F.col("pos")).alias("pos"))


def searched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text, sha, pos, doc_id) of the wanted texts (rep, mark, sha, doc, pos): one copy of a repeated row, every text of an id."""
    met = texts.join(wanted.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), ["doc_id", "mark"])
    return met.dropDuplicates(["doc_id", "mark"]).select("doc", "text", "sha", "pos", "doc_id")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts earlier (smaller id, or earlier in the text).

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    1. Anchors, hashes of `window - 12` words, are taken only at places whose residue modulo 13
       is in a difference cover (4 of 13 places). Two equal windows have anchors at an equal
       step from their starts, so a window without an anchor that stands elsewhere too is new.
    2. Anchors that do are extended to the full windows round them, which are compared the
       same way: the first in order of (id, start) stays, all others count.
    3. Of equal texts, the one with the smallest id goes through the steps; the others are
       removed whole if they have a window at all.

    Null text is empty. Rows of equal id and text are one document, each row returned. Rows of equal id and
    different texts are a document each, in order of the text's hash. A null
    id takes no part: nothing is removed. Other columns are not looked at.
    """
    if window <= PERIOD:
        raise ValueError("window must be over 13 words")
    spark, length = docs.sparkSession, window - PERIOD + 1
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def anchors(buckets):
        def run(batches):
            packer, met = Packer(_ANCHOR, buckets, send_anchors), set()
            for batch in batches:
                ids = batch.column(0)
                for row, end, data, offsets in K.slices(batch.column(1)):
                    starts, ends, first = K.spans(~K.SPACE[data], offsets)
                    joined, cuts = K.joined_words(data, starts, ends, first)
                    view = memoryview(joined)
                    shas = [hashlib.sha256(view[cuts[r] : max(cuts[r], cuts[r + 1] - 1)]).hexdigest() for r in range(end - row)]
                    grams = K.gram_hashes(K.word_hashes(data, starts, ends), length)
                    of = K.texts_of(np.diff(first))
                    pos = np.arange(len(starts)) - first[of]
                    keys = np.array([text_key(s) for s in shas], np.int64)
                    fresh = np.array([not (x in met or met.add(x)) for x in shas], bool)
                    fresh &= ids.slice(row, end - row).is_valid().to_numpy(zero_copy_only=False)
                    take = np.flatnonzero(cover[pos % PERIOD] & (pos + length <= np.diff(first)[of]) & fresh[of])
                    yield from with_empty(packer.add(key=grams[take], text=keys[of[take]], pos=pos[take]), _INFO)
                    yield rows_only([("doc_id", ids.slice(row, end - row)), ("size", pa.array(np.diff(first), pa.int64())), ("sha", pa.array(shas)), ("mark", batch.column(2).slice(row, end - row)), ("text_key", pa.array(keys))])
            yield from with_empty(packer.flush(), _INFO)

        return run

    shared, info = anchor_table(texts, anchors, INFO_SCHEMA)
    first_of = first_texts(info)
    some = durable(searched(texts, wanted_texts(first_of, shared)), "passages")
    buckets = 2 * partitions(spark, docs)

    def windows(batches):
        def local(entries):
            cut = groups_of(entries["key"])
            head = np.zeros(len(entries), bool)
            head[cut[:-1]] = True
            return entries[head], entries[~head]

        packer = Packer(_WINDOW, buckets, local)
        for batch in batches:
            ids, anchored = batch.column(0).to_numpy(), batch.column(3)
            for row, end, data, offsets in K.slices(batch.column(1)):
                starts, ends, first = K.spans(~K.SPACE[data], offsets)
                grams = K.gram_hashes(K.word_hashes(data, starts, ends), window)
                near = np.zeros(len(starts) + 1, np.int64)
                lists = anchored.slice(row, end - row)
                begin = np.repeat(first[:-1], lists.value_lengths().fill_null(0).to_numpy())
                at = lists.flatten().to_numpy() + begin
                low = np.maximum(at - (PERIOD - 1), begin)
                np.add.at(near, low, 1)
                np.add.at(near, at + 1, -1)
                of = K.texts_of(np.diff(first))
                pos = np.arange(len(starts)) - first[of]
                whole = lists.is_null().to_numpy(zero_copy_only=False)
                take = np.flatnonzero(((np.cumsum(near[:-1]) > 0) | whole[of]) & (pos + window <= np.diff(first)[of]))
                yield from packer.add(key=grams[take], doc=ids[row:end][of[take]], pos=pos[take])
        yield from packer.flush()

    def later(entries, known):
        head = np.zeros(len(entries), bool)
        head[groups_of(entries["key"])[:-1]] = True
        found = np.concatenate((entries[~head], known))
        return placed(found["doc"], found["pos"].astype(np.int64), buckets // 2)

    found = durable(compare(some.mapInArrow(windows, PACK_SCHEMA), _WINDOW, later, PLACES_SCHEMA), "later")
    found = places_of(found, "doc")

    def kept(batches):
        for batch in batches:
            ids, n, removed, shas = batch.column(0), [], [], []
            for row, end, data, offsets in K.slices(batch.column(1)):
                starts, ends, first = K.spans(~K.SPACE[data], offsets)
                lists = batch.column(3).slice(row, end - row)
                at = lists.flatten().to_numpy() + np.repeat(first[:-1], lists.value_lengths().to_numpy())
                cover_ = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover_, at, 1)
                np.add.at(cover_, at + window, -1)
                stay = np.cumsum(cover_[:-1]) == 0
                joined, cuts = K.joined_words(data, starts[stay], ends[stay], np.concatenate(([0], np.cumsum(stay)))[first])
                view = memoryview(joined)
                for r in range(end - row):
                    shas.append(hashlib.sha256(view[cuts[r] : max(cuts[r], cuts[r + 1] - 1)]).hexdigest())
                    n.append(first[r + 1] - first[r])
                    removed.append(int((~stay[first[r] : first[r + 1]]).sum()))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(removed, pa.int64()), pa.array(shas)], names=["doc_id", "sha", "less", "left_sha"])

    changed = some.select("doc", "doc_id", "text", "sha").join(found, "doc").select("doc_id", "text", "sha", "pos").mapInArrow(kept, "doc_id long, sha string, less long, left_sha string")
    copies = info.join(first_of.select("sha", "rep"), "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)) & (F.col("size") >= window))
    whole = copies.join(changed, ["doc_id", "sha"], "left")
    return whole.select(
        "doc_id",
        F.col("size").alias("n_words"),
        F.when(F.col("copy"), F.col("size")).otherwise(F.coalesce("less", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY_SHA)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )
