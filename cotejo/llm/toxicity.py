"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text."""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.samples import labelled_texts, remainder
from cotejo.llm.shared import bound_batches

#: Labelled documents of each class that are learnt from, about, and the most bytes of one that is.
TRAIN_DOCS, TRAIN_BYTES = 1500, 20_000
WINDOW_WORDS = 8
ORDINARY_BYTES, MOST_FRAGMENTS = 12_000, 256
#: Of the evidence that the strongest fragment gives for toxic text, the least part that another must give.
LEAST_EVIDENCE = 0.1
#: Letters of a word's beginning that can be a fragment, besides whole words.
BEGINNINGS = (5, 6, 7, 8)
CUT = 0.3
#: Behind windows and dictionaries: matches are not looked for in the last bytes, and of a few bytes none pays.
PAD = b" " * 24
#: Bytes that a window saves at least where the saving is clear, the most that count of one window, and numbers that features() gives.
CLEAR, MOST_SAVED, FEATURES = 2, 8, 4


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def compressors(self):
        """Equal settings, and dictionaries of equal length that begin with the ordinary text: only what the toxic part matches makes a difference."""
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        dictionary = lambda x: zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return tuple(zstandard.ZstdCompressor(dict_data=dictionary(x), compression_params=settings) for x in (self.ordinary + bytes(len(self.toxic)) + PAD, self.ordinary + self.toxic + PAD))


def features(data: np.ndarray, offsets: np.ndarray, compressors) -> np.ndarray:
    """For each text: the largest saving of the toxic dictionary in a window, and logs of the sum of clear savings, of their number and of the number of windows."""
    ordinary, toxic = (c.compress for c in compressors)
    starts, ends, first = K.spans(~K.SPACE[data], offsets)
    joined, cuts = K.joined_words(K.LOWER[data], starts, ends, first)
    raw = joined.tobytes()
    at = np.concatenate(([0], np.cumsum(ends - starts + 1))).tolist()
    out = np.zeros((len(offsets) - 1, FEATURES))
    for r in range(len(out)):
        saved = []
        for a in range(first[r], first[r + 1], WINDOW_WORDS):
            window = b" " + raw[at[a] : at[min(a + WINDOW_WORDS, first[r + 1])]] + PAD  # words end in a blank each
            saved.append(len(ordinary(window)) - len(toxic(window)))
        if saved:
            s = np.array(saved)
            clear = s[s >= CLEAR]
            out[r] = min(max(0, s.max()), MOST_SAVED), np.log1p(clear.sum()), np.log1p(len(clear)), np.log1p(len(s))
    return out


def fragments_of(text: bytes) -> Counter:
    """Whole words and word beginnings of a text, each with the blank before it, and how often they stand."""
    found: Counter = Counter()
    for word in text.split():
        found[b" " + word + b" "] += 1
        letters = word.decode("utf-8", "replace")
        for n in BEGINNINGS:
            if len(letters) > n:
                found[b" " + letters[:n].encode()] += 1
    return found


def evidence_of(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """Share in the log likelihood ratio of each fragment that three toxic texts have, by texts that have it at all or, if that tells more, twice."""
    evidence: dict[bytes, float] = {}
    counted = [[fragments_of(t) for t in texts] for texts in (toxic, ordinary)]
    for least in (1, 2):
        has, lacks = (Counter(f for c in texts for f, n in c.items() if n >= least) for texts in counted)
        for f, n in has.items():
            if n >= 3 and len(f) > 4:
                e = n * float(np.log((n / len(toxic)) / ((lacks[f] + 0.5) / (len(ordinary) + 1))))
                evidence[f] = max(evidence.get(f, 0.0), e)
    return evidence


def learn(toxic: list[bytes], ordinary: list[bytes]) -> ToxicityModel:
    """Dictionaries and calibration from lower-cased texts of both kinds.

    The toxic dictionary holds the fragments that tell toxic documents from ordinary ones,
    strongest last; the ordinary one lines spread evenly over ordinary texts that hold none of them.
    """
    evidence = evidence_of(toxic, ordinary)
    best = max(evidence.values(), default=0)
    fragments = sorted((f for f, e in evidence.items() if e >= LEAST_EVIDENCE * best > 0), key=lambda f: (evidence[f], f))[-MOST_FRAGMENTS:]
    size, taken = 0, []
    for line in sorted({line for text in ordinary for line in text.split(b"\n")}, key=lambda x: (hash_of(x), x)):
        if size >= ORDINARY_BYTES:
            break
        if not any(f.strip() in line for f in fragments):
            taken.append(line[:400])
            size += len(taken[-1]) + 1
    model = ToxicityModel(b" ".join(taken) + b" ", b"".join(fragments), ())
    both = [*((t, 1) for t in toxic), *((t, 0) for t in ordinary)]
    compressors = model.compressors()
    data = [features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), compressors)[0] for t, _ in both]
    return ToxicityModel(model.ordinary, model.toxic, calibrated(np.array(data).reshape(-1, FEATURES), np.array([y for _, y in both], float)))


def hash_of(x: bytes) -> int:
    return int(K.span_hashes(K.prefix_sums(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0])


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    if not len(y):
        return (-3.0, *[0.0] * FEATURES)
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return tuple(w.tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted.

    Labels are learnt from rows whose crc32(id) mod 4 is not 2, about `train_docs` of each class,
    documents of up to `train_bytes`, brought to the driver (60 MB at most by default). Every window of 8 words of every text is compressed with both dictionaries; savings are turned into
    a probability by logistic regression on the same sample, weighed back to the labels' own shares.

    Null and empty texts get the score of a text without savings. Without labels of both kinds all scores are low.
    Rows of equal id are each scored by their own text; a null id is not held out. Other columns are not looked at.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    marked = marked.where(remainder("doc_id", 4) != 2)
    shares = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= train_bytes)
    sample = labelled_texts(texts, marked, "toxic", train_docs)
    lower = lambda y: [x.encode().translate(bytes(K.LOWER)) for k, x in sample if k == y]
    toxic, ordinary = lower(True), lower(False)
    model = learn(toxic, ordinary)
    n, m = shares.get(True, 0), shares.get(False, 0)
    shift = float(np.log((n + 0.5) / (m + 0.5) * (len(ordinary) + 0.5) / (len(toxic) + 0.5)))
    model = ToxicityModel(model.ordinary, model.toxic, (model.weights[0] + shift, *model.weights[1:]))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        compressors, w = shared.value.compressors(), np.array(shared.value.weights)
        for batch in batches:
            x = [features(data, offsets, compressors) for _, _, data, offsets in K.slices(batch.column(2))]
            if x:
                x = np.concatenate(x)
                p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
