"""Quality rules: base counts, and a linear-chain conditional random field over lines."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm import kernels as K
from cotejo.llm.samples import labelled_texts
from cotejo.llm.shared import bound_batches

#: Labelled documents of each class that the field is fitted on, about, and the most bytes and lines of one that is.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_LINES = 600, 20_000, 200
#: Least share of a text's words in content lines, in hundredths.
CONTENT_SHARE = 50
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
#: Content and boilerplate, in this order, are the labels of a line.
CONTENT, BOILERPLATE = 0, 1
FEATURES = 14


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[offsets[1:]] - total[offsets[:-1]]


class Lines:
    """Words, lines and base counts of the texts in a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        self.starts, self.ends, self.first = K.spans(~K.SPACE[data], offsets)
        self.n_words = np.diff(self.first)
        self.word_chars = _sums(_CHAR[data] & ~K.SPACE[data], offsets)
        self.n_symbols = _sums(_SYMBOL[data], offsets)
        # A line ends at each \n and at each text's end.
        ends = np.sort(np.concatenate((np.flatnonzero(data == 10), offsets[1:])), kind="stable")
        breaks = _sums(data == 10, offsets) + 1
        self.first_line = np.concatenate(([0], np.cumsum(breaks)))
        begin = np.empty(len(ends), np.int64)
        begin[self.first_line[:-1]] = offsets[:-1]
        inner = np.ones(len(ends), bool)
        inner[self.first_line[:-1]] = False
        begin[inner] = ends[np.flatnonzero(inner) - 1] + 1
        self.begin, self.end = begin, ends
        self.text = K.texts_of(breaks)
        word_line = np.searchsorted(begin, self.starts, "right") - 1
        self.words = np.bincount(word_line, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
        sums = K.prefix_sums(data)
        same = K.span_hashes(sums, begin, ends) if len(begin) else np.zeros(0, np.uint64)
        order = np.lexsort((np.arange(len(begin)), same, self.text))
        again = np.zeros(len(begin), bool)
        again[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])
        self.again = again & (self.words > 0)
        self.n_dup_lines = np.bincount(self.text[self.again], minlength=texts)
        self.n_repeat_words = self._repeats(K.span_hashes(sums, self.starts, self.ends), texts)
        self.x = self._features(data)

    def _repeats(self, words: np.ndarray, texts: int) -> np.ndarray:
        grams = K.gram_hashes(words, 5)
        of = K.texts_of(self.n_words)
        inside = np.flatnonzero(of[: len(grams)] == of[4:]) if len(grams) else np.zeros(0, np.int64)
        key, owner = grams[inside], of[inside]
        order = np.lexsort((key, owner))
        equal = np.zeros(len(order), bool)
        equal[1:] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        equal[:-1] |= equal[1:]
        edge = np.zeros(len(words) + 1, np.int64)
        at = inside[order[equal]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        return np.bincount(of[np.cumsum(edge[:-1]) > 0], minlength=texts)

    def _features(self, data: np.ndarray) -> np.ndarray:
        def share(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return (total[self.end] - total[self.begin]) / np.maximum(size, 1)

        size = self.end - self.begin
        letters = share(_UPPER[data]) + share(_LOWER[data])
        upper = share(_UPPER[data]) / np.maximum(letters, 1e-9)
        symbols, digits, loud = share(_SYMBOL[data]), share(_DIGIT[data]), share(data == 33)
        last = data[np.maximum(self.end - 1, 0)] if len(data) else np.zeros(len(size), np.uint8)
        word = size / np.maximum(self.words, 1)
        x = np.column_stack(
            [np.ones(len(size)), self.words == 0, (self.words > 0) & (self.words <= 3), (self.words > 3) & (self.words <= 12), self.words > 12, symbols > 0, symbols > 0.05, upper > 0.5, loud > 0.02, digits > 0.2, np.isin(last, (46, 63)) & (self.words > 0), word > 11, word < 3.5, self.again]
        )
        return x.astype(np.float64)


def viterbi(x: np.ndarray, first: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest labels of each sequence's lines. All sequences of a slice step together, longest first."""
    local = x @ weights
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    labels = np.zeros(len(local), np.int64)
    if not len(local):
        return labels
    back = np.zeros((len(local), 2), np.int8)
    longest = n[order[0]]
    alive = np.searchsorted(-n[order], -np.arange(longest), "left")
    score = local[first[order]] if len(order) and n.min() > 0 else local[np.minimum(first[order], len(local) - 1)]
    for k in range(1, longest):
        m = alive[k]
        at = first[order[:m]] + k
        ways = score[:m, :, None] + moves[None]
        back[at] = ways.argmax(axis=1)
        score[:m] = ways.max(axis=1) + local[at]
    state = score.argmax(axis=1)
    labels[first[order] + n[order] - 1] = state
    for k in range(longest - 1, 0, -1):
        m = alive[k]
        at = first[order[:m]] + k
        ends = n[order[:m]] - 1 == k
        now = np.where(ends, labels[at], state[:m])
        state[:m] = back[at, now]
        labels[at - 1] = state[:m]
    return labels


def fit(sequences: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, train_lines: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores of the field, by gradient ascent on the conditional likelihood.

    sequences: features of a text's lines, and its label. Lines of good texts are content but for repeated ones; lines of bad texts are boilerplate.
    """
    weights, moves = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    sequences = [(x, y) for x, y in sequences if 0 < len(x) <= train_lines]
    if not sequences:
        return weights, moves
    n = np.array([len(x) for x, _ in sequences])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    padded = np.zeros((len(n), n[0], FEATURES))
    truth = np.zeros((len(n), n[0]), np.int64)
    for k, o in enumerate(order):
        x, y = sequences[o]
        padded[k, : len(x)] = x
        truth[k, : len(x)] = np.where(x[:, -1] > 0, BOILERPLATE, CONTENT) if y else BOILERPLATE
    real = np.arange(n[0])[None] < n[:, None]
    gold = np.eye(2)[truth] * real[..., None]
    gold_moves = np.einsum("ska,skb->ab", gold[:, :-1], gold[:, 1:])
    total = real.sum()
    for _ in range(rounds):
        local = padded @ weights
        ahead, behind = np.zeros_like(local), np.zeros_like(local)
        ahead[:, 0] = local[:, 0]
        for k in range(1, n[0]):
            step = np.logaddexp(ahead[:, k - 1, 0, None] + moves[0], ahead[:, k - 1, 1, None] + moves[1]) + local[:, k]
            ahead[:, k] = np.where(real[:, k, None], step, ahead[:, k - 1])
        for k in range(n[0] - 2, -1, -1):
            later = local[:, k + 1] + behind[:, k + 1]
            step = np.logaddexp(moves[:, 0] + later[:, 0, None], moves[:, 1] + later[:, 1, None])
            behind[:, k] = np.where(real[:, k + 1, None], step, 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead + behind - z[:, None, None]) * real[..., None]
        two = np.exp(ahead[:, :-1, :, None] + moves + (local + behind)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        weights = weights + rate * (np.einsum("skf,ska->fa", padded, gold - one) / total * 10 - 0.001 * weights)
        moves = moves + rate * ((gold_moves - two.sum(axis=(0, 1))) / total * 10 - 0.001 * moves)
    return weights, moves


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, train_lines: int = TRAIN_LINES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words.

    Base counts are exact over whole texts. A conditional random field, fitted on about
    `train_docs` labelled documents of each class (of up to `train_bytes` and `train_lines`, brought to the driver), labels every line
    content or boilerplate by Viterbi decoding; a text is kept if it passes the base rules and at least half of
    its words stand in content lines.

    Null and empty texts have no words and fail the base rules. Rows of equal id are each
    judged. Without labels of both classes every line is content. Other columns are not looked at.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    short = texts.where((F.octet_length("text") <= train_bytes) & (F.regexp_count("text", F.lit("\n")) < train_lines))
    encoded = [(np.frombuffer(t.encode(), np.uint8), int(y)) for y, t in labelled_texts(short, marked, "good", train_docs)]
    if len({y for _, y in encoded}) > 1:
        model = fit([(Lines(d, np.array([0, len(d)])).x, y) for d, y in encoded], train_lines=train_lines)
    else:
        model = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        weights, moves = shared.value
        for batch in batches:
            for row, end, data, offsets in K.slices(batch.column(1)):
                found = Lines(data, offsets)
                label = viterbi(found.x, found.first_line, weights, moves)
                content = np.bincount(found.text, weights=found.words * (label == CONTENT), minlength=end - row).astype(np.int64)
                n = found.n_words
                failed = (n < 10) | (100 * found.n_repeat_words > 20 * n)
                kept = ~failed & (100 * content >= CONTENT_SHARE * n)
                numbers = [pa.array(v.astype(np.int64)) for v in (n, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *numbers, pa.array(failed), pa.array(kept), pa.array(content)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"])

    return texts.mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long")
