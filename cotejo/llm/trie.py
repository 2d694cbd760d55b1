"""The trie of conversations that begin alike, by prefix-doubling names."""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.shared import bound_batches, durable
from cotejo.operators.ordering import numbered, positions, running_totals

WORD = r"[^\x20\x09-\x0D]+"
#: Characters of joined ids that make one piece of a hash.
PIECE = 1 << 16


def heads(conv: Column, every: int, most: int) -> tuple[Column, Column]:
    """(the conversation whose head a conversation takes over, how many of its turns)."""
    return conv - conv % every, F.crc32(conv.cast("string").cast("binary")) % most


def rebuilt_turns(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text) -> (convs (conv_id), a row per conversation that has turns; rows (conv_id, at, key, words) of the rebuilt ones).

    key stands for role and text: their sha256. Turns are in order of turn, null first, then of role and key.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    # Texts stay behind; equal turn numbers are in order of role and key.
    short = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), words.alias("words"))
    at = durable(positions(short, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")], "at", "turns").select("conv_id", "at", "key", "words"), "turns")
    base, h = heads(F.col("conv_id"), every, most)
    convs = durable(at.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base, "h": h.cast("long")}), "convs")
    # Of a conversation only its first turns are taken over, and only by those of its block.
    head = at.where((F.col("at") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "h").join(head, "base").where("at < h").select("conv_id", "at", "key", "words")
    had = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = convs.join(had, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("front"))
    own = at.join(shift, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("front")).alias("at"), "key", "words")
    return convs.select("conv_id"), durable(taken.unionByName(own), "rebuilt")


def _named(pairs: DataFrame, by: list[str], name: str, start: int, keep: list[str]) -> tuple[DataFrame, int]:
    """pairs with a dense number for each distinct value of `by`; numbers begin at start."""
    table, end = numbered(pairs.select(*by).distinct(), name, start, "names")
    return durable(pairs.join(table, by).select(*keep, name), "named"), end


def prefix_nodes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, at, key) -> (conv_id, depth, node): the number of each prefix of one turn or more; equal prefixes, and no others, have equal numbers.

    Blocks of 1, 2, 4, ... turns, each at a multiple of its length, are named in turn: a block's name is that of the pair of
    names of its halves. A prefix is cut into the blocks of the binary digits of its length, longest
    first; it is named by the pair of the name of all but its last block, and that block's.
    Both ways take as many rounds as the longest conversation's length has digits, and all rounds
    together name twice as many blocks, and as many prefixes, as there are turns.
    """
    longest = rows.agg(F.max("at")).first()[0] or 0
    level, _ = _named(rows.select("conv_id", F.col("at").alias("block"), "key"), ["key"], "name", 0, ["conv_id", "block"])
    levels = [level]
    while 1 << len(levels) <= longest + 1:
        even = F.col("block") % 2 == 0
        pairs = levels[-1].groupBy("conv_id", F.expr("block div 2").alias("half")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")).where("a is not null and b is not null")
        level, _ = _named(pairs.withColumnRenamed("half", "block"), ["a", "b"], "name", 0, ["conv_id", "block"])
        levels.append(level)
    # Number 0 is the empty prefix.
    found, begun = None, 1
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        last = levels[k].where("block % 2 = 0").select("conv_id", (F.col("block") * size).alias("depth"), F.col("name").alias("b"))
        if found is None:
            pairs = last.withColumn("a", F.lit(0).cast("long"))
        else:
            pairs = last.join(found.withColumnRenamed("node", "a"), ["conv_id", "depth"], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("long")))
        new, begun = _named(pairs.withColumn("depth", F.col("depth") + size), ["a", "b"], "node", begun, ["conv_id", "depth"])
        found = new if found is None else found.unionByName(new)
    return durable(found, "prefixes")


def digests_of_ids(rows: DataFrame) -> DataFrame:
    """rows (node, id) -> (node, digest): the sha256 of a node's ids in ascending order, joined by commas.

    Ids are sorted over all partitions and joined to pieces where they lie; a hash then runs over a node's pieces
    in order, one piece in memory at a time.
    """

    def join(batches):
        held, chars, node, first = [], 0, None, None
        for batch in batches:
            out = []
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or chars > PIECE:
                    if held:
                        out.append((node, first, ",".join(held)))
                    held, chars, node, first = [], 0, n, i
                held.append(str(i))
                chars += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "first", "ids"), x)) for x in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"node": node, "first": first, "ids": ",".join(held)}], schema)

    def digest(batches):
        node, h = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != node:
                    if h is not None:
                        out.append((node, h.hexdigest()))
                    node, h = n, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "digest"), x)) for x in out], result)
        if h is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "digest": h.hexdigest()}], result)

    bound_batches(rows.sparkSession)
    schema = pa.schema([("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    result = pa.schema([("node", pa.int64()), ("digest", pa.string())])
    pieces = rows.select("node", "id").repartitionByRange("node", "id").sortWithinPartitions("node", "id").mapInArrow(join, "node long, first long, ids string")
    return durable(pieces, "pieces").repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node long, digest string")


def conversation_trie(df: DataFrame, every: int = 20, most: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each distinct beginning of a conversation, the empty one included.

    Conversations are rebuilt first: each takes over the first h turns of conversation c - c % every, h = crc32(c) % most, and goes on with its own
    turns after its first h. Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes below, itself included), saved_tokens (over the subtree, (n_convs - 1) times the words
    of a node's last text), ends_sha256 (of the members that end here).

    Subtrees are summed along conversations: a node's values stand with its smallest member, are summed
    from that conversation's end to each of its depths, and the sums of all members of a node are its subtree's. No step
    keeps a conversation, or the members of a node, in one task.

    Null role or text is empty; rows with a null id are left out; turns of one number are in order of role, then of the hash
    of both. Repeated rows are repeated turns. c % every has the sign of c. An empty table has no rows, not even a root.
    Texts are hashed and counted where they lie and go no further, however long. Other columns are not looked at.
    """
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    convs, rows = rebuilt_turns(turns, every, most)
    prefixes = prefix_nodes(rows).join(rows.select("conv_id", (F.col("at") + 1).alias("depth"), "words"), ["conv_id", "depth"])
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("words"))
    members = durable(prefixes.select("conv_id", "depth", "node", "words").unionByName(root), "members")
    nodes = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = durable(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = durable(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # Of the nodes of one conversation, those that have it as smallest member hold their own values; from its end to each depth they add up.
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    along = members.select("conv_id", "depth", "node").join(own, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
    upto = running_totals(along, ["conv_id"], [F.col("depth").desc()], ["leaf", "saved"], "along")
    sums = upto.groupBy("node").agg(F.sum("leaf_upto").alias("n_leaves"), F.sum("saved_upto").alias("saved_tokens"))

    ends = members.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("e")).select(F.col("e.node").alias("node"), F.col("conv_id").alias("id"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    all_ = nodes.join(parents, "parent", "left").join(sums, "node").join(digests_of_ids(ends), "node", "left")
    return all_.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same in SQL: crc32 by its definition bit by bit, prefixes as lists of hashes.
ORACLE = r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
  xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)), CAST(4294967295 AS UBIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT c.conv_id, 0 AS own, t.pos, t.k, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.k, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY own, pos) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY path, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.path, len(n.path)) = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND left(n.path, greatest(len(n.path) - 64, 0)) = p.path),
below AS (SELECT a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens FROM linked a JOIN linked b ON b.depth >= a.depth AND left(b.path, len(a.path)) = a.path GROUP BY a.path),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, CAST(l.n_convs AS BIGINT) AS n_convs, CAST(l.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM linked l JOIN below b USING (path) LEFT JOIN ends e USING (path)
"""
