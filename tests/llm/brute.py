"""Plain versions of the operators' contracts, over rows in memory."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_duplicates(rows):
    """(doc_id, text) rows -> sorted (doc_id, n_shingles, component_id)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_shingle = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    shared = Counter()
    for members in by_shingle.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                shared[members[a], members[b]] += 1
    for (a, b), same in shared.items():
        if 100 * same >= 80 * (len(sets[a][1]) + len(sets[b][1]) - same):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def repeated_words(rows, window=20):
    """Sorted (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeated_bytes(rows, length=200):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    count = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        count.update(hash(b[i : i + length]) for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[hash(b[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def quality_counts(rows):
    """Sorted (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for d, t in rows:
        w, seen, dup = words(t), set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        windows = defaultdict(list)
        for i in range(len(w) - 4):
            windows[tuple(w[i : i + 5])].append(i)
        inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        symbols = sum(c in "[#*$%&|<>]" for c in t or "") - sum(c in "[]" for c in t or "")
        out.append((d, len(w), sum(map(len, w)), symbols, dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)))
    return sorted(out)


def license_phrases(rows):
    """Sorted (doc_id, n_words, n_base, first_word, last_word, base_labels)."""
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        at = [i for i, _ in hits]
        out.append((d, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    return sorted(out)


def kept_bytes(rows, length=200):
    """{doc_id: text} left by repeated_bytes()."""
    count = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[d] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


UNIT_WORDS = set("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs day days week weeks month months year years usd eur gbp dollars euros pounds cents percent kmh mph km/h m/s hz kb mb gb tb w kw v a k c f degrees".split())


def canonical_words(text):
    """(form, slot, plain) of each word of a text: a number, a unit behind one, and a capitalised word behind a small letter, a digit, a comma or a semicolon are placeholders."""
    import regex

    out, before, was_number = [], "", False
    for w in words(text):
        tail = regex.sub(r"[).,;:!?]+$", "", w)
        number = bool(regex.fullmatch(r"[$€£+\-(]?[0-9\p{Nd}][\p{Nd}.,:/\-]*[%°]?[\p{L}²³]{0,4}[).,;:!?]*", w))
        kind = "num" if number else "unit" if was_number and tail.lower() in UNIT_WORDS else "name" if regex.search(r"[\p{Ll}\p{Nd},;]$", before) and regex.fullmatch(r"\p{Lu}[\p{L}\-']*", tail) else None
        bare = regex.sub(r"[^\p{L}\p{N}]", "", w.lower())
        form = f"<{kind}>" if kind else regex.sub(r"[^\p{L}\p{N}<>]", "", w).lower()
        held = len(form) > 1 and form[0] == "<" and form[-1] == ">"
        plain = (regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w.lower()) if kind == "num" else bare) if held else form
        out.append((form, w.lower() if held else "", plain))
        # A name is seen where it stands; a number or unit isn't seen by the next word any more.
        before, was_number = ("<>" if kind in ("num", "unit") else w), number
    return out


def leak_windows(found, n):
    """(key, place, slots) of each window of n words; a whole window is compared without its first word, a shorter one with it."""
    for at in range(len(found) - n + 1):
        some = found[at + 1 : at + n]
        if n < 8:
            form, slot, plain = found[at]
            some = [(form, slot, plain) if form == "<num>" else (plain, "", plain), *some]
        slots = [s for _, s, _ in some if s]
        literal = len(slots) > len(some) - 3
        yield (n, literal, tuple(x[2] if literal else x[0] for x in some)), at, slots


def leaks(docs, items):
    """{(doc_id, item_id)}: windows at every place, matches judged by alignment."""
    theirs, size = defaultdict(list), {}
    for i, text in set(items):
        found = canonical_words(text)
        if not any(p for _, _, p in found):
            continue
        size[i, text] = len(found)
        for key, at, slots in leak_windows(found, min(8, len(found))):
            theirs[key].append(((i, text), at, slots))
    lengths = {8} | {n for n in size.values() if n < 8}
    out = set()
    for d, text in docs:
        met = defaultdict(lambda: (set(), set()))
        for n in lengths:
            for key, at, slots in leak_windows(canonical_words(text), n):
                for item, item_at, own in theirs.get(key, ()):
                    places, pairs = met[item, at - item_at]
                    places.add(at)
                    pairs.update(zip(own, slots))
        good = defaultdict(set)
        for (item, _), (places, pairs) in met.items():
            if len({a for a, _ in pairs}) == len(pairs):
                good[item] |= places
        out |= {(d, item[0]) for item, places in good.items() if len(places) >= 2 or size[item] <= 11}
    return out
