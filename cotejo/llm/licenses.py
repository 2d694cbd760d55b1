"""License text in documents: phrases, and an exact containment join with license templates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.shared import bound_batches

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Sentences that license texts ask to be shown or begin with, and short license texts as a whole.
TEMPLATES = {
    "apache": "Released under the Apache License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-deed": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "epl-2.0": "Licensed under the Eclipse Public License, Version 2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Of short notices, the words that name the license: a block has all of the first and none of the second, whatever share of the others it holds.
NAMED = {
    "apache": ("apache license", "version"),
    "apache-2.0": ("apache 2", ""),
    "cc-by": ("attribution commons", "noncommercial sharealike noderivatives noderivs nc sa nd"),
    "cc-by-nc": ("cc by nc", "sa nd"),
    "cc-by-nc-deed": ("attribution noncommercial", "sharealike noderivatives noderivs"),
    "cc-by-nc-sa": ("attribution noncommercial sharealike", ""),
    "cc-by-nd": ("attribution noderivatives", "noncommercial"),
    "cc-by-sa": ("attribution sharealike", "noncommercial"),
    "epl-2.0": ("eclipse 2", ""),
    "gpl": ("gnu general", "lesser affero library"),
    "gpl-3.0": ("gnu general 3", "lesser affero library"),
    "lgpl-3.0": ("gnu lesser 3", ""),
    "mit": ("mit license", ""),
    "mpl-2.0": ("mozilla 2", ""),
}
#: Share of a template's words that a block has to hold, in hundredths.
CONTAINMENT = 80
#: Words of all templates together that go to every task (about 100 bytes each); more raise an error.
MOST_WORDS = 2_000_000

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[:128] = [chr(b).isalnum() for b in range(128)]


def _hashes(text: str) -> np.ndarray:
    data = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = K.spans(_WORD_BYTE[data], np.array([0, len(data)]))
    return K.word_hashes(data, starts, ends)


def _words(data: np.ndarray, offsets: np.ndarray):
    data = K.LOWER[data]
    starts, ends, first = K.spans(_WORD_BYTE[data], offsets)
    return K.word_hashes(data, starts, ends), first


class TemplateIndex:
    """Templates as sets of words in the corpus's global order of frequency, rarest first, and their inverted prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[int, int], named: dict[str, tuple[str, str]] | None = None):
        self.names = list(templates)
        musts, nots = ([_hashes((named or {}).get(n, ("", ""))[k]).tolist() for n in templates] for k in (0, 1))
        found = [_hashes(t) for t in templates.values()]
        #: Words of each template, repeats counted: the length of its blocks.
        self.length = np.array([len(h) for h in found], np.int64)
        sets = [sorted(set(h.tolist()), key=lambda w: (frequency.get(w, 0), w)) for h in found]
        order = sorted({w for s in [*sets, *nots] for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.vocabulary = np.array(sorted(order), np.uint64)
        self.rank_of = np.array([self.rank[w] for w in self.vocabulary.tolist()], np.int64)
        self.sets = [np.sort([self.rank[w] for w in s]).astype(np.int64) for s in sets]
        self.musts, self.nots = ([np.array(sorted(self.rank[w] for w in x), np.int64) for x in y] for y in (musts, nots))
        self.least = np.array([-(-CONTAINMENT * len(s) // 100) for s in sets], np.int64)
        # The prefix: a block without any of a template's len - least + 1 rarest words lacks too many. One entry a word and template, by word.
        entries = sorted((int(r), t) for t, s in enumerate(self.sets) for r in s[: len(s) - self.least[t] + 1])
        self.prefix_rank = np.array([r for r, _ in entries], np.int64)
        self.prefix_of = np.array([t for _, t in entries], np.int64)

    def matches(self, words: np.ndarray, of: np.ndarray, first: np.ndarray):
        """(text, template, overlap) of every block near a prefix word that reaches the containment: blocks are all windows of a template's length of a text's words."""
        if not len(self.vocabulary) or not len(words):
            return
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == words)
        ranks = self.rank_of[at[known]]
        # Prefix filter: a hit for every template that has the word in its prefix.
        low, high = np.searchsorted(self.prefix_rank, ranks, "left"), np.searchsorted(self.prefix_rank, ranks, "right")
        n = high - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit, t = np.repeat(known, n), self.prefix_of[entry]
        # Positional filter: only words within a block's length of the hit can be in a block with it. Length filter: enough of them have to be some template's.
        begin = np.searchsorted(known, np.maximum(hit - self.length[t] + 1, first[of[hit]]))
        end = np.searchsorted(known, np.minimum(hit + self.length[t], first[of[hit] + 1]))
        open_ = np.flatnonzero(end - begin >= self.least[t])
        whole = set()
        for i in open_.tolist():
            k, text = int(t[i]), int(of[hit[i]])
            if (text, k) in whole:
                continue
            own = self.sets[k]
            r, p = ranks[begin[i] : end[i]], known[begin[i] : end[i]]
            bad = p[np.isin(r, self.nots[k])]
            place = np.searchsorted(own, r)
            place[place == len(own)] = 0
            mine = own[place] == r
            place, p = place[mine], p[mine]
            if len(np.unique(place)) < self.least[k]:
                continue
            # A block begins at one of the template's words.
            must, overlap = set(np.searchsorted(own, self.musts[k]).tolist()), 0
            for j in range(len(p)):
                stop = p[j] + self.length[k]
                held = set(place[j : np.searchsorted(p, stop)].tolist())
                if len(held) > overlap and must <= held and not ((bad >= p[j]) & (bad < stop)).any():
                    overlap = len(held)
            if overlap >= self.least[k]:
                if overlap == len(own):
                    whole.add((text, k))
                yield text, k, overlap


def word_frequency(texts: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """How often each word of the templates stands in all texts."""
    vocabulary = np.array(sorted({w for t in templates.values() for w in _hashes(t).tolist()}), np.uint64)

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column(0)):
                words, _ = _words(data, offsets)
                at = np.searchsorted(vocabulary, words)
                at[at == len(vocabulary)] = 0
                total += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], names=["word", "n"])

    rows = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r["word"]]): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, named: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where a phrase's words stand in a row. Method: a block is any run of as many
    words of a text as the template has, across lines, that begins with one of them; a block that holds 80 % of a template's
    distinct words carries its label, if it has all words that name the license and none that name another (`named`, by label; words that must be are the template's own). Blocks are found by prefix, positional and length filters over the words in global order
    of frequency (counted over all texts), then verified. score: the best containment of a template in a block; 1 where a phrase stands.

    Null and empty texts have no words; first_word, last_word are null without a base place.
    Rows of equal id are each scanned. Of templates with equal words all match. A very long text is scanned in one
    piece of memory, some 30 bytes a byte of text. Other columns are not looked at. Templates of more than 2,000,000 words together are an error.
    """
    named = named or (NAMED if templates is None else {})
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.split()) for t in templates.values()) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, word_frequency(texts.select("text"), templates), named))
    phrases = [(_hashes(p), label) for p, label in PHRASES.items()]

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, offsets in K.slices(batch.column(1)):
                words, first = _words(data, offsets)
                n = end - row
                of = K.texts_of(np.diff(first))
                count, low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                base: list[set] = [set() for _ in range(n)]
                score = np.zeros(n)
                for phrase, label in phrases:
                    m = max(0, len(words) - len(phrase) + 1)
                    hit = np.ones(m, bool)
                    for k, w in enumerate(phrase):
                        hit &= words[k : k + m] == w
                    hit = np.flatnonzero(hit)
                    hit = hit[hit + len(phrase) <= first[of[hit] + 1]]
                    for i in hit.tolist():
                        r = of[i]
                        p = i - first[r]
                        base[r].add(label)
                        count[r] += 1
                        low[r] = p if low[r] < 0 else min(low[r], p)
                        high[r] = max(high[r], p)
                        score[r] = 1
                labels = [set(b) for b in base]
                for r, t, overlap in index.value.matches(words, of, first):
                    labels[r].add(index.value.names[t])
                    score[r] = max(score[r], overlap / len(index.value.sets[t]))
                some = lambda v: pa.array(v, pa.int64(), mask=v < 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, n), pa.array(np.diff(first), pa.int64()), pa.array(count), some(low), some(high),
                        pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return texts.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
