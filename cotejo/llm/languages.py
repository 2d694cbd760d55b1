"""Language identification as a mixture of languages (expectation-maximisation with penalised likelihood)."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.samples import bounded_by_class, remainder
from cotejo.llm.shared import bound_batches

#: Hashed trigrams of the model, and the parts in which they are counted.
BINS, PARTS = 1 << 15, 16
#: Documents of each language that the model learns from, about. Of languages it can have samples.MOST_CLASSES.
TRAIN_DOCS = 1500
#: Nats that each further language of a document has to gain, besides half the log of its words.
PENALTY = 4.0


def gram_bins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bin of the three bytes from each place on; letters A-Z are lower-cased, white space is one symbol, which also stands behind each text's end."""
    x = K.LOWER[data]
    x = np.where(K.SPACE[data], np.uint8(32), x)
    x = np.concatenate((x, np.full(2, 32, np.uint8))).astype(np.uint32)
    n, ends = len(data), offsets[1:]
    second, third = x[1 : n + 1].copy(), x[2 : n + 2].copy()
    second[ends[ends >= 1] - 1] = third[ends[ends >= 1] - 1] = third[ends[ends >= 2] - 2] = 32
    h = (x[:n] << np.uint32(16) | second << np.uint32(8) | third) * np.uint32(2654435761)
    return h >> np.uint32(32 - 15)


@dataclass(frozen=True)
class LanguageModel:
    """names of the languages, and the log probability of each bin in each of them (bins x languages)."""

    names: tuple[str, ...]
    logs: np.ndarray


def learn(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, most: int = TRAIN_DOCS) -> LanguageModel:
    """A model from about `most` documents of each language, counted where they lie. The driver gets one table of BINS counts a language."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sample = bounded_by_class(rows, "lang", "doc_id", most).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, end, data, offsets in K.slices(batch.column(1)):
                bins = gram_bins(data, offsets)
                for r in range(end - row):
                    c = counts.setdefault(langs[row + r], np.zeros(BINS, np.int64))
                    c += np.bincount(bins[offsets[r] : offsets[r + 1]], minlength=BINS)
        # Only bins that stand in these texts go out, so a task sends no more than its own sample holds.
        for lang, c in counts.items():
            some = np.flatnonzero(c)
            part = some * PARTS // BINS
            cut = np.searchsorted(part, np.arange(PARTS + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * PARTS), pa.array(np.arange(PARTS, dtype=np.int32)), K.list_array(some.astype(np.int64), cut, pa.int64()), K.list_array(c[some], cut, pa.int64())], names=["lang", "part", "bins", "n"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BINS, np.int64)
        for bins, n in zip(table["bins"], table["n"]):
            total[bins.values.to_numpy()] += n.values.to_numpy()
        part, width = table["part"][0].as_py(), BINS // PARTS
        return pa.table([table["lang"][:1], table["part"][:1], pa.array([total[part * width : (part + 1) * width].tobytes()], pa.binary())], names=["lang", "part", "counts"])

    total: dict[str, np.ndarray] = {}
    summed = sample.mapInArrow(count, "lang string, part int, bins array<long>, n array<long>").groupBy("lang", "part").applyInArrow(add, "lang string, part int, counts binary")
    for lang, part, counts in summed.toLocalIterator():
        total.setdefault(lang, np.zeros((PARTS, BINS // PARTS), np.int64))[part] = np.frombuffer(counts, np.int64)
    names = tuple(sorted(total))
    if not names:
        return LanguageModel((), np.zeros((BINS, 0), np.float32))
    c = np.stack([total[x].reshape(-1) for x in names], axis=1) + 0.1
    return LanguageModel(names, np.log(c / c.sum(axis=0)).astype(np.float32))


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each text's words. Each is of its own words alone, so a text's scores don't depend on what stands beside it."""
    sums = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        sums[some] = np.add.reduceat(values, first[some], axis=0, dtype=np.float64)
    return sums


def _mixture(likely: np.ndarray, first: np.ndarray, of: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text by expectation-maximisation over its words, and the log likelihood beyond the words' offsets."""
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    n = np.maximum(np.diff(first), 1)[:, None]
    for _ in range(rounds):
        r = likely * share[of]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        share = _segment_sums(r, first) / n
    fit = np.log(np.maximum((likely * share[of]).sum(axis=1), 1e-30))
    return share, _segment_sums(fit[:, None], first)[:, 0]


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, most_mixed: int = 3, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(index of the main language, score) of each text."""
    starts, ends, first = K.spans(~K.SPACE[data], offsets)
    docs, languages = len(offsets) - 1, len(model.names)
    if not len(starts) or not languages:
        return np.zeros(docs, np.int64), np.zeros(docs)
    logs = model.logs[gram_bins(data, offsets)]
    # Sums over each word: reduceat runs to the next start; the blanks between are set to 0.
    logs[K.SPACE[data]] = 0
    words = np.add.reduceat(logs, starts, axis=0)
    top = words.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(words - top, -30))
    of, n = K.texts_of(np.diff(first)), np.diff(first)
    single = _segment_sums(words - top, first)
    best = single.argmax(axis=1)
    fit = single.max(axis=1)
    odds = np.exp(np.maximum(single - fit[:, None], -700))
    score = 1 / odds.sum(axis=1)
    share, _ = _mixture(likely, first, of, np.ones((docs, languages)), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, min(most_mixed, languages) + 1):
        allowed = np.zeros((docs, languages))
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        mixed, gain = _mixture(likely, first, of, allowed, rounds)
        gain -= (k - 1) * (PENALTY + 0.5 * np.log(np.maximum(n, 1)))
        better = gain > fit
        best = np.where(better, mixed.argmax(axis=1), best)
        score = np.where(better, mixed.max(axis=1), score)
        fit = np.maximum(fit, gain)
    return best, np.clip(score, 0, 1)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and every column of docs under its own name in struct `row`.

    A model of hashed byte trigrams is learnt from documents with a language whose
    crc32(id) mod 3 is not 1, about `train_docs` for each. A text is a mixture of languages
    by words: expectation-maximisation fits the proportions; of the sets of 1 to 3 languages, largest proportions first, the one with
    the best likelihood less a penalty for each further language is taken. lang_pred is its main language;
    score is that language's proportion, for a single one its posterior against the others.

    `und` with score 0: null text, no letter, or no language learnt. Rows of equal id are each
    judged by their own text. A null id is not held out. Equally likely languages: the first by name. A very long text
    is judged whole, in a slice of its own: memory grows with its bytes times the languages.
    """
    bound_batches(docs.sparkSession)
    train = docs.where(F.coalesce(remainder(id_col, 3), F.lit(0)) != 1)
    model = learn(train, text_col, lang_col, id_col, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 18, K.SLICE_BYTES // max(2, len(model.names)))

    def judge(batches):
        m = shared.value
        for batch in batches:
            best, score = [], []
            for _, _, data, offsets in K.slices(batch.column(2).field(at), limit):
                b, s = infer(m, data, offsets)
                best.append(b)
                score.append(s)
            if best:
                names = pa.array([m.names[k] if m.names else None for k in np.concatenate(best)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(np.concatenate(score))], names=["letter", "held_out", "row", "guess", "sure"])

    held_out = F.coalesce(remainder(id_col, 3) == 1, F.lit(False))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # The text goes to Python once, inside its row.
    rows = docs.select(letter.alias("letter"), held_out.alias("held_out"), row.alias("row"))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    schema = rows.schema["row"].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"letter boolean, held_out boolean, row {schema}, guess string, sure double")
    known = F.col("letter") & F.col("guess").isNotNull()
    return judged.select(F.col(f"row.`{id_col}`").alias("doc_id"), "held_out", F.when(known, F.col("guess")).otherwise("und").alias("lang_pred"), F.when(known, F.col("sure")).otherwise(0.0).alias("score"), "row")
