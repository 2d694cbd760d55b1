"""The conversation trie against a plain version."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from cotejo.llm.trie import conversation_trie, digests_of_ids

KIND = "conv_id long, turn long, role string, text string"
CLASHING = ("node", "depth", "at", "key", "words", "n", "base", "h", "piece", "place", "a", "b", "block", "name")


def brute(rows, every=20, most=4):
    own = {}
    key = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", key(role or "", text or ""), text or ""))
    for c in own:
        own[c] = [(x[2], x[4]) for x in sorted(own[c])]
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(1 for q in under if not any(len(x) == len(q) + 1 and x[:-1] == q for x in under))
        saved = sum((len(members[q]) - 1) * words[q] for q in under)
        ends = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_trie_equals_plain_version(spark):
    r = random.Random(7)
    rows = []
    for c in [*range(-25, 45), 100, 119, 7000]:
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([t, t, None, 2]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "long text\nof words"])))
    rows += rows[:10]  # repeated rows
    rows += [(None, 1, "user", "lost"), (61, 1, "u", "w " * 50_000)]
    rows += [(80, t, "user", f"t{t}") for t in range(70)] + [(81, t, "user", f"t{t}") for t in range(67)] + [(82, t, "user", f"t{t}" if t != 40 else "other") for t in range(70)]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in CLASHING})
    assert found(conversation_trie(df.repartition(5))) == brute(rows)


def test_turnless_and_empty(spark):
    # 27 takes three turns of 20, which is absent, and has none of its own after its third.
    absent = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(absent, 0, "user", "gone"), (absent, 1, "user", "gone too")]
    assert found(conversation_trie(spark.createDataFrame(rows, KIND))) == brute(rows)
    assert brute(rows) == [(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())]
    assert conversation_trie(spark.createDataFrame([], KIND)).collect() == []


def test_ids_are_hashed_over_partitions_in_order(spark, monkeypatch):
    monkeypatch.setattr("cotejo.llm.trie.PIECE", 200)
    ids = random.Random(2).sample(range(-10_000, 10_000), 5000)
    df = spark.createDataFrame([(i % 3 and 1, i) for i in ids], "node long, id long").repartition(7)
    want = {n: hashlib.sha256(",".join(str(i) for i in sorted(ids) if (i % 3 and 1) == n).encode()).hexdigest() for n in (0, 1)}
    assert dict(map(tuple, digests_of_ids(df).collect())) == want
