"""Learnt operators against plain versions of what they do with what they have learnt."""

import math
import random

import brute
import numpy as np
import pytest

from cotejo.llm import languages, quality


def plain_features(line: bytes, again: bool) -> list[float]:
    size, words = len(line), len(line.split())
    count = lambda chars: sum(b in chars for b in line) / max(size, 1)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    loud, shares, width = upper / max(upper + lower, 1e-9), count(b"#*$%&|<>"), size / max(words, 1)
    return [
        1, words == 0, 0 < words <= 3, 3 < words <= 12, words > 12, shares > 0, shares > 0.05, loud > 0.5, count(b"!") > 0.02, count(b"0123456789") > 0.2,
        words > 0 and line[-1:] in (b".", b"?"), width > 11, width < 3.5, again,
    ]


def plain_lines(text: str) -> list[tuple[list[float], int]]:
    out, seen = [], set()
    for line in text.encode().split(b"\n"):
        words = len(line.split())
        out.append((plain_features(line, words > 0 and line in seen), words))
        seen.add(line)
    return out


def plain_labels(x: list[list[float]], weights, moves) -> list[int]:
    """Best labels by dynamic programming over whole paths."""
    best = {y: (float(np.dot(x[0], weights[:, y])), [y]) for y in (0, 1)}
    for row in x[1:]:
        best = {y: max(((s + moves[p[-1], y] + float(np.dot(row, weights[:, y])), [*p, y]) for s, p in best.values()), key=lambda c: c[0]) for y in (0, 1)}
    return max(best.values(), key=lambda c: c[0])[1]


def test_kept_equals_plain_decoding(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["river", "stone", "small", "bridge", "where", "people", "came"]) for _ in range(r.randint(5, 18))) + r.choice([".", ".", ""])
    bad = lambda: r.choice(["Home | About | Login", "$$$ BUY NOW !!!", "CLICK HERE", "12 34 56", "* * *", "Home | About | Login"])
    text = lambda share: "\n".join(good() if r.random() < share else bad() for _ in range(r.randint(1, 12)))
    rows = [(i, text(r.choice([0.05, 0.2, 0.5, 0.8, 0.95]))) for i in range(160)] + [(900, None), (901, ""), (902, "\n\n"), (903, "x " * 4000)]
    known = [(i, int(sum(len(t.split()) > 4 for t in rows[i][1].split("\n")) * 2 > len(rows[i][1].split("\n")))) for i in range(0, 160, 2)]
    marked = {i: y for i, y in known}
    sample = sorted((y == 1, rows[i][1]) for i, y in marked.items())
    weights, moves = quality.fit([(np.array([f for f, _ in plain_lines(t)], float), int(y)) for y, t in sample])
    want = {}
    base = {b[0]: b for b in brute.quality_counts(rows)}
    for i, t in rows:
        lines = plain_lines(t or "")
        labels = plain_labels([f for f, _ in lines], weights, moves)
        content = sum(n for (_, n), y in zip(lines, labels) if y == quality.CONTENT)
        want[i] = (content, not base[i][-1] and 100 * content >= quality.CONTENT_SHARE * base[i][1])
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int")).collect()
    assert {x["doc_id"]: (x["content_words"], x["kept"]) for x in got} == want
    assert 20 < sum(k for _, k in want.values()) < 140


def plain_inference(model: languages.LanguageModel, text: bytes, rounds: int = 6) -> tuple[int, float]:
    space = set(b" \t\n\x0b\x0c\r")
    at = lambda i: 32 if i >= len(text) or text[i] in space else text[i] + 32 * (65 <= text[i] <= 90)
    sums, word = [], None
    for i, b in enumerate(text):
        if b in space:
            word = None
            continue
        if word is None:
            word = np.zeros(len(model.names))
            sums.append(word)
        word += model.logs[(((at(i) << 16 | at(i + 1) << 8 | at(i + 2)) * 2654435761) % (1 << 32)) >> 17]
    if not sums:
        return 0, 0.0
    likely = [np.exp(np.maximum(w - w.max(), -30)) for w in sums]
    single = sum(w - w.max() for w in sums)

    def mixture(chosen):
        share = np.array([1 / len(chosen) if k in chosen else 0.0 for k in range(len(model.names))])
        for _ in range(rounds):
            parts = [x * share for x in likely]
            share = sum(p / max(p.sum(), 1e-30) for p in parts) / len(likely)
        return share, sum(math.log(max((x * share).sum(), 1e-30)) for x in likely)

    best, fit = int(single.argmax()), float(single.max())
    score = 1 / np.exp(np.maximum(single - fit, -700)).sum()
    order = np.argsort(-mixture(range(len(model.names)))[0], kind="stable")
    for k in range(2, min(3, len(model.names)) + 1):
        share, gain = mixture(set(order[:k].tolist()))
        gain -= (k - 1) * (languages.PENALTY + 0.5 * math.log(len(likely)))
        if gain > fit:
            best, score, fit = int(share.argmax()), float(share.max()), gain
    return best, score


@pytest.mark.parametrize("count", [1, 2, 5])
def test_inference_equals_a_plain_version(count):
    r = np.random.default_rng(count)
    model = languages.LanguageModel(tuple("abcde"[:count]), np.log(r.dirichlet(np.full(languages.BINS, 0.3), count).T + 1e-9).astype(np.float32))
    words = [bytes(r.integers(97, 123, r.integers(1, 9)).tolist()) for _ in range(60)]
    texts = [b"", b" ", b"x", b"Ab c"] + [b" ".join(words[k] for k in r.integers(0, 60, r.integers(1, 40))) + r.choice([b"", b" ", b"\n"]) for _ in range(80)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    best, score = languages.infer(model, data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    # Texts without words get `und` and 0 later, whatever stands here.
    want = {i: plain_inference(model, t) for i, t in enumerate(texts) if t.split()}
    assert {i: int(best[i]) for i in want} == {i: b for i, (b, _) in want.items()}
    assert [score[i] for i in want] == pytest.approx([s for _, s in want.values()], abs=1e-3)
