"""Operators with a learnt or sampled part, archives, and the pipeline."""

import hashlib
import io
import itertools
import pathlib
import random
import zipfile
import zlib

import brute
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.llm import licenses, mixing, quality, toxicity, warc
from cotejo.llm.decontaminate import benchmark_leaks
from cotejo.llm.languages import identify_languages
from cotejo.llm.mixing import mix_sources
from cotejo.llm.quality import quality_rules
from cotejo.llm.toxicity import score_toxicity

FOLDER = "/root/testdata/sf0.001"
CLASHING = ("set", "n", "size", "target", "row", "letter", "said", "form", "cut", "rank", "hash", "name", "payload", "score", "held_out")
WORDS = "the river of stone went under a small bridge where two old men sold bread and fish to people who came from far towns every single morning".split()


def extra(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return sorted(con.execute(sql).fetchall(), key=lambda r: [(v is not None, v) for v in r])


# Sources to target weights


def mixed_rows():
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "c", "é", None])) for i in range(200)]
    return rows + [(200, None, "a"), (201, "", "empty"), (202, "w " * 5000, "big"), (203, " ", None)]


def test_mix_equals_sql_and_meets_targets(spark):
    rows = mixed_rows()
    got = mix_sources(extra(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    want = duck(mixing.ORACLE, documents=pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    key = lambda r: r[0]
    assert [tuple(r) for r in sorted(got, key=key)] == [(a, b, c, pytest.approx(d), e) for a, b, c, d, e in sorted(want, key=key)]
    taken: dict = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        t = taken.setdefault(source[r["doc_id"]], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(a - b) <= 60 for s, (a, b) in taken.items() if s != "big")


def test_mix_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == []
    rows = mixed_rows() * 2 + [(None, "a b", None)]
    once = mix_sources(spark.createDataFrame(rows, empty.schema)).collect()
    again = mix_sources(spark.createDataFrame(rows[::-1], empty.schema)).collect()
    key = lambda r: [(v is not None, v) for v in r]
    assert len(once) == len(rows) and sorted(map(tuple, once), key=key) == sorted(map(tuple, again), key=key)


# Benchmark decontamination

ITEM = "In 1984 the trader Boris sold 35 kg of apples for 12 euros near Lisbon, then Boris kept 7 kg for winter and told nobody about it."
OTHER = "In 2020 the trader Maria sold 99 kg of apples for 41 euros near Athens, then Maria kept 3 kg for winter and told nobody about it."
WRONG = "In 2020 the trader Maria sold 99 kg of apples for 41 euros near Athens, then Petra kept 3 kg for winter and told nobody about it."


def leak_rows():
    r = random.Random(9)
    rows = []
    for i in range(60):
        before = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 14)))
        said = [ITEM, OTHER, WRONG, "", ITEM.upper(), " ".join(ITEM.split()[3:16])][i % 6]
        rows.append((i, f"{before} {said} " + " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))))
    return [*rows, (60, None), (61, ""), (62, " "), (63, "short text")]


def test_leaks(spark):
    rows, items = leak_rows(), [(1, ITEM), (1, ITEM), (2, "too short"), (3, None), (4, " ".join(WORDS[:11]))]
    docs = extra(spark.createDataFrame(rows + rows[:9] + [(None, ITEM)], "doc_id long, text string"))
    got = benchmark_leaks(docs, extra(spark.createDataFrame(items, "item_id long, text string"))).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found) == len(got)
    assert found == brute.leaks(rows, [(i, t) for i, t in items if t])
    hit = {d for d, i in found if i == 1}
    assert {d for d, _ in rows[:60] if d % 6 in (0, 1, 5)} <= hit
    assert not {d for d, _ in rows if d % 6 in (2, 3) or d >= 60} & hit


def test_no_leaks(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert benchmark_leaks(docs, items).count() == 0
    assert benchmark_leaks(spark.createDataFrame([(1, ITEM)], docs.schema), items.limit(0)).count() == 0


# Archives


def page_rows():
    long = "<p>ñandú</p>" * 30
    return [(5, "u5", long), (3, "u3", long), (9, "u 9\n", long), (4, None, "short"), (6, "u6", "short"), (7, "u7", None), (8, "u8", ""), (1, "u1", "x" * 99), (2, "u2", "x" * 99), (10, "a", "y" * 100), (11, "b", "y" * 100), (12, "c", "\r\n\r\nWARC/1.1\r\n" * 20)]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = extra(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    got = warc.archive_round_trip(spark, pages).collect()
    want = duck(warc.ORACLE, pages=pa.table({"page_id": [r[0] for r in rows], "html": pa.array([r[2] for r in rows], pa.string())}))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
    twice = warc.archive_round_trip(spark, pages.unionByName(pages).unionByName(pages.limit(1).withColumn("page_id", F.lit(None).cast("long"))))
    assert twice.count() == 2 * len(rows) + 1


def test_zip64_directories():
    data = {"archive/data.warc": b"abc" * 50, "indexes/index.cdxj": b"x\n", "empty": b""}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in data.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(body)
        z.comment = b"PK\x05 a comment"
    raw = bytearray(out.getvalue())
    # The same package as a writer of packages beyond 4 GB ends it: a ZIP64 record, its locator, and an end record of overflowed fields.
    end = raw.rfind(b"PK\x05\x06")
    count, length, at = (int.from_bytes(raw[a:b], "little") for a, b in ((end + 10, end + 12), (end + 12, end + 16), (end + 16, end + 20)))
    n = lambda v, k: v.to_bytes(k, "little")
    far = b"PK\x06\x06" + n(44, 8) + n(45, 2) + n(45, 2) + n(0, 4) + n(0, 4) + n(count, 8) + n(count, 8) + n(length, 8) + n(at, 8)
    locator = b"PK\x06\x07" + n(0, 4) + n(end, 8) + n(1, 4)
    tail = raw[end : end + 8] + b"\xff" * 12 + raw[end + 20 :]
    for package in (bytes(raw), bytes(raw[:end]) + far + locator + bytes(tail)):
        with pa.BufferReader(package) as file:
            assert {name: package[a : a + k] for name, a, k in warc.package_members(file)} == data
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 100)
    for broken in (packed.getvalue(), b"no package"):
        with pytest.raises(ValueError), pa.BufferReader(broken) as file:
            warc.package_members(file)


def test_changed_payloads_are_noticed():
    raw = warc._record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), "response", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(raw)[2] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n", b"paylord\r\n"))


# Learnt operators


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_languages(spark):
    r = random.Random(3)
    tongues = {k: ["".join(r.choice(k) for _ in range(r.randint(2, 7))) for _ in range(200)] for k in ("abcde", "fghij", "klmñé")}
    say = lambda k, n: " ".join(r.choice(tongues[k]) for _ in range(n))
    names = list(tongues)
    rows = [(i, say(names[i % 3], 40), f"l{i % 3}") for i in range(150)]
    rows += [(150, None, None), (151, "", None), (152, "123 456 !", "l0"), (153, say("abcde", 60) + " " + say("fghij", 20), None), (154, say("klmñé", 5000), None), (None, say("fghij", 30), "l1")]
    got = identify_languages(extra(spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string"))).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(rows) + 5
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["lang_pred"] == f"l{i % 3}" for i in range(150))
    assert all(by[i]["held_out"] == held(i, 3, 1) for i in range(155)) and not by[None]["held_out"]
    assert [by[i]["lang_pred"] for i in (150, 151, 152)] == ["und"] * 3 and by[150]["score"] == 0
    assert by[153]["lang_pred"] == "l0" and 0.6 < by[153]["score"] < 0.9
    assert (by[154]["lang_pred"], by[None]["lang_pred"]) == ("l2", "l1")
    none = identify_languages(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert identify_languages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = identify_languages(docs).where("held_out").select("lang_pred", "row.lang")
    assert both.where("lang_pred = lang").count() >= 0.97 * both.where("lang is not null").count()


def test_toxicity_on_held_out_documents(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    got = score_toxicity(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = got[got.toxic == 1].score, got[got.toxic == 0].score
    better = np.mean([(s > good).mean() + 0.5 * (s == good).mean() for s in bad])
    assert better >= 0.93
    assert ((got.score >= toxicity.CUT) == (got.predicted == 1)).all()


def test_toxicity_of_awkward_rows(spark):
    r = random.Random(1)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, say(r.randint(0, 60)) + (" vilest rotter " if i % 3 == 0 else " ") + say(r.randint(0, 20))) for i in range(120)] + [(120, None), (121, ""), (122, say(20000)), (None, "vilest rotter")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = score_toxicity(extra(spark.createDataFrame(rows, "doc_id long, text string")), labels).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    assert all(by[i]["predicted"] == int(i % 3 == 0) and by[i]["held_out"] == held(i, 4, 2) for i in range(120))
    assert [by[i]["predicted"] for i in (120, 121, 122, None)] == [0, 0, 0, 1]
    assert score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0)).where("predicted = 1").count() == 0
    assert score_toxicity(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def test_viterbi_finds_the_best_labels():
    r = np.random.default_rng(0)
    lengths = [1, 4, 6, 2, 5]
    first = np.concatenate(([0], np.cumsum(lengths)))
    x, weights, moves = r.normal(size=(first[-1], quality.FEATURES)), r.normal(size=(quality.FEATURES, 2)), r.normal(size=(2, 2))
    labels = quality.viterbi(x, first, weights, moves)
    for a, b in zip(first, first[1:]):
        local = x[a:b] @ weights
        score = lambda y: sum(local[k, y[k]] for k in range(len(y))) + sum(moves[p, q] for p, q in zip(y, y[1:]))  # noqa: B023, E731
        assert score(labels[a:b]) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=b - a)))


def test_quality_keeps_clean_and_drops_marked_documents(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = quality_rules(read("documents"), read("labels")).join(read("labels"), "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() >= 0.95
    assert passed[passed.quality == 0].kept.mean() <= 0.3


def test_licenses_are_told_apart_by_the_words_that_name_them(spark):
    said = {
        "Released under the Apache License": "apache", "Released under the GPL License": "", "the film was released under the new license to critical praise": "", "Licensed under CC BY-SA 4.0": "cc-by", "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under the Eclipse License, Version 2.0": "epl-2.0", "This work is licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-3.0",
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-deed",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
        "Released under the MIT License. And: licensed under the Apache License, Version 2.0": "apache-2.0,mit", licenses.TEMPLATES["mit-full"]: "mit-full,mit-text", licenses.TEMPLATES["bsd-2-clause"].replace("COPYRIGHT HOLDERS", "REGENTS"): "bsd,bsd-2-clause",
    }
    rows = [(i, f"some words before it. {t} and after it") for i, t in enumerate(said)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {rows[i][1]: got[i] for i in got} == {r[1]: x for r, x in zip(rows, said.values())}


def test_license_join_is_exact(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = {f"t{k}": " ".join(r.sample(vocabulary, r.randint(3, 12))) for k in range(12)}
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 4)):
            base = r.choice(list(templates.values())).split()
            lines.append(" ".join(r.sample(base, r.randint(1, len(base))) + r.choices(vocabulary, k=r.randint(0, 6))))
        rows.append((i, "\n".join(lines)))
    rows += [(80, None), (81, "")]
    got = {x["doc_id"]: x for x in licenses.scan_licenses(extra(spark.createDataFrame(rows, "doc_id long, text string")), templates=templates).collect()}
    for i, text in rows:
        share = {t: best_window(t_text, text) for t, t_text in templates.items()}
        assert got[i]["labels"] == ",".join(sorted(t for t, v in share.items() if v >= 0.8))
        assert got[i]["score"] == pytest.approx(max((v for v in share.values() if v >= 0.8), default=0))


def best_window(template, text):
    """The best share of a template's words in a run of as many words of the text."""
    own, said = template.split(), (text or "").split()
    runs = [said[k : k + len(own)] for k in range(max(1, len(said) - len(own) + 1))]
    return max(len(set(own) & set(run)) / len(set(own)) for run in runs)


def test_many_templates_and_wrapped_text(spark):
    many = {f"x{k}": f"alpha{k} beta{k} gamma{k} delta{k} common words" for k in range(2500)} | {"mit-text": licenses.TEMPLATES["mit-text"], "mit": licenses.TEMPLATES["mit"]}
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the"
    rows = [(1, "so alpha7 beta7 gamma7 delta7\ncommon words end"), (1, "so alpha7 beta7 gamma7 delta7\ncommon words end"), (2, wrapped), (3, "the license of the mit students was released"), (4, None), (None, "alpha2400 beta2400 gamma2400 delta2400 common"), (5, "filler " * 5000 + wrapped)]
    got = sorted((r["doc_id"] or 0, r["labels"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=many).collect())
    assert got == [(0, "x2400"), (1, "x7"), (1, "x7"), (2, "mit-text"), (3, ""), (4, ""), (5, "mit-text")]


# The pipeline


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline

    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    judged = identify_languages(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("lang_pred <> 'und' and score >= 0.4").select("doc_id").toPandas()
    left = docs[docs.doc_id.isin(judged.doc_id)]
    near = brute.near_duplicates(list(zip(left.doc_id, left.text)))
    left = left[left.doc_id.isin([d for d, _, c in near if d == c])]
    kept = brute.kept_bytes(list(zip(left.doc_id, left.text)))
    left = left.assign(text=[kept[d] for d in left.doc_id])
    left = left[[bool(brute.words(t)) for t in left.text]]
    bench = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    leaks = brute.leaks(list(zip(left.doc_id, left.text)), list(zip(bench.item_id, bench.text)))
    left = left[~left.doc_id.isin([d for d, _ in leaks])]
    mix = {r[0]: r[4] for r in duck(mixing.ORACLE, documents=left)}
    want = {(d, t, mix[d]) for d, t in zip(left.doc_id, left.text) if mix[d] > 0}
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "cotejo"
    before = set(shared.glob("*"))
    got = corpus_pipeline.run(spark, FOLDER)
    # Nothing but the last stage's table is left behind.
    assert [p.name.split("-")[0] for p in set(shared.glob("*")) - before] == ["mixing_sources"]
    assert {(r["doc_id"], r["text"], r["taken"]) for r in got.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "mixing_sources"]


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    null = docs.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    for rows in (docs.limit(0), docs.limit(40).unionByName(docs.limit(10)).unionByName(null)):
        rows = rows.withColumns({c: F.lit("x") for c in (*CLASHING, "kept_text", "taken", "source_size")})
        before = {r[0] for r in rows.select("doc_id").collect()}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = rows.columns
            rows = stage(spark, rows, FOLDER).cache()
            ids = [r[0] for r in rows.select("doc_id").collect()]
            # Every stage's rows are rows of the one before; ids are unique after the near duplicates, and clean documents stay.
            assert set(ids) <= before and (k == 0 or len(ids) == len(set(ids)))
            assert (not before) == (not ids)
            assert rows.where("doc_id is not null and text is null").count() == 0
            before = set(ids)
            assert k == len(corpus_pipeline.STAGES) - 1 or rows.columns == columns


def test_pipeline_stages_on_rows_without_an_id(spark):
    import corpus_pipeline

    say = lambda k: " ".join(f"{w}{k}" for w in WORDS)
    rows = [(1, say("a"), "x"), (2, say("b"), "x"), (2, say("a"), "x"), (None, say("c"), "x"), (None, say("d"), "y"), (None, None, "y"), (3, say("e"), None), (1, say("f"), "x"), (None, say("b"), "z"), (9, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, FOLDER).collect()]
    # The text that id 2 shares with document 1 goes, its other text stays, and so does the other text of id 1; a copy without an id goes.
    assert sorted(got, key=str) == sorted([r for k, r in enumerate(rows) if k not in (2, 8)], key=str)
    mixed = corpus_pipeline.mixing_sources(spark, docs, FOLDER)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken", "text", "source"]
    took = [(r["doc_id"], r["text"], r["source"]) for r in mixed.collect()]
    assert (None, say("c"), "x") in took or (None, say("d"), "y") in took
    assert set(took) <= set(rows) and len(took) == len(set(took))


def test_pipeline_cleans_rows_that_share_an_id_or_have_none(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    passage, own = " ".join(f"p{k}assage" for k in range(60)), lambda k: " ".join(f"{w}{k}" for w in WORDS)
    rows = [(1, f"{own('a')} {item} {own('b')}"), (None, f"{own('c')} {item}"), (2, own("d")), (2, f"{own('e')} {item}"), (None, own("f")), (None, None), (3, f"{own('g')} {passage}"), (None, f"{own('h')} {passage}"), (3, f"{own('i')} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.benchmark_decontamination(spark, docs, FOLDER).collect()), key=str)
    assert got == sorted([r for r in rows if item not in (r[1] or "")], key=str)
    cut = sorted(map(tuple, corpus_pipeline.suffix_array_dedup(spark, docs, FOLDER).collect()), key=str)
    # The passage, and the blank before it, goes from all three texts, of one id or none.
    assert len(cut) == len(rows) and not [t for _, t in cut if t and "p7assage" in t]
    assert [r for r in cut if r[1] in (own("d"), own("f"))] == [(2, own("d")), (None, own("f"))]
