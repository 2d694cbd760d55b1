"""Exact operators against their plain versions, on generated rows with all the awkward cases."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from cotejo.llm.jaccard import near_duplicate_sets
from cotejo.llm.licenses import scan_licenses
from cotejo.llm.quality import quality_rules
from cotejo.llm.repeats import remove_repeated_passages
from cotejo.llm.suffixes import remove_repeated_bytes

SCHEMA = "doc_id long, text string"
# Names that the operators use inside must not clash with a table's own.
CLASHING = ("set", "n", "sha", "pos", "size", "mark", "rep", "bucket", "pack", "row", "letter", "said", "form", "cut", "rank", "kept_text", "component_id")


def corpus(seed: int, docs: int = 120) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdéñ") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [say(r.randint(22, 70)) for _ in range(4)]
    base, rows = say(150), []
    for i in range(docs):
        kind = i % 12
        if kind == 0:
            w = base[:]
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind == 1:
            w = base[r.randint(0, 25) :]
        elif kind == 2:
            w = say(r.randint(1, 30)) + r.choice(passages) + say(r.randint(1, 30)) + r.choice(passages)
        elif kind == 3:
            w = ["x"] * r.randint(1, 60)
        elif kind == 4:
            w = say(r.randint(1, 5))
        elif kind == 5:
            w = base[:]
        elif kind == 6:
            w = say(3) * r.randint(8, 40)
        else:
            w = say(r.randint(0, 120))
        text = "".join(x + r.choice([" "] * 12 + ["\n", "\t ", ". ", " "]) for x in w)
        rows.append((i, text.upper() if kind == 7 else text))
    rows += [(docs, None), (docs + 1, ""), (docs + 2, " \n\t "), (docs + 3, "One two"), (docs + 4, "one  TWO"), (docs + 5, "All rights reserved\n" * 3), (docs + 6, "# | * <a> [x]\n# | * <a> [x]\n"), (docs + 7, " ".join(say(9000)))]
    r.shuffle(rows)
    return rows


def table(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


OPERATORS = {
    "near_duplicates": (lambda d, s: near_duplicate_sets(d).select("doc_id", "n_shingles", "component_id"), brute.near_duplicates),
    "repeated_words": (lambda d, s: remove_repeated_passages(d).select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.repeated_words),
    "repeated_bytes": (lambda d, s: remove_repeated_bytes(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.repeated_bytes),
    "quality_counts": (lambda d, s: quality_rules(d, s.createDataFrame([], "doc_id long, quality int")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.quality_counts),
    "license_phrases": (lambda d, s: scan_licenses(d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), brute.license_phrases),
}


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("seed", [1, 2])
def test_whole_results(spark, name, seed):
    run, plain = OPERATORS[name]
    rows = corpus(seed)
    got = sorted((tuple(r) for r in run(table(spark, rows), spark).collect()), key=key)
    assert got == sorted(plain(rows), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](table(spark, []), spark).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_repeated_rows_and_ids_with_several_texts(spark, name):
    run, plain = OPERATORS[name]
    rows = corpus(3, 36)
    once = {tuple(r) for r in run(table(spark, rows), spark).collect()}
    twice = run(table(spark, rows + rows + [(None, rows[0][1]), (None, None)]), spark).collect()
    assert len(twice) == 2 * len(rows) + 2
    assert {tuple(r) for r in twice if r[0] is not None} == once
    # The same id with other texts: a row each, and no failure.
    mixed = run(table(spark, rows + [(d, (t or "") + " more of it") for d, t in rows] + [(d, "short") for d, _ in rows]), spark)
    assert mixed.count() == 3 * len(rows)


@pytest.mark.parametrize("name", ["repeated_words", "repeated_bytes"])
def test_texts_of_equal_keys(spark, monkeypatch, name):
    """Texts whose keys collide are searched whole: nothing is lost."""
    from cotejo.llm import repeats, suffixes

    for module in (repeats, suffixes):
        monkeypatch.setattr(module, "text_key", lambda sha: 7)
    run, plain = OPERATORS[name]
    rows = corpus(4, 48)
    assert sorted((tuple(r) for r in run(table(spark, rows), spark).collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("name", ["repeated_words", "repeated_bytes"])
def test_every_text_of_an_id_is_searched(spark, name):
    """Rows of one id and different texts are a document each, in order of the text's hash."""
    import xxhash

    run, plain = OPERATORS[name]
    rows = corpus(5, 40)
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = sorted({(d // 3, t or "") for d, t in rows} | {(d, f"{x} {passage} {x}") for d, x in [(90, "one"), (90, "two"), (91, "three"), (90, "four")]})
    mark = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    number = {r: k for k, r in enumerate(sorted(rows, key=lambda r: (r[0], mark(r[1]))))}
    seen, alone = set(), []
    for d, t in rows:
        # A text that several ids have is removed whole by either operator; here each text has one id.
        if t not in seen:
            alone.append((d, t))
        seen.add(t)
    want = sorted(plain([(number[r], r[1]) for r in alone]))
    back = {n: r[0] for r, n in number.items()}
    got = sorted((tuple(r) for r in run(table(spark, alone), spark).collect()), key=key)
    assert got == sorted(((back[r[0]], *r[1:]) for r in want), key=key)
    assert any(r[2] for r in got)
