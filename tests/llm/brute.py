"""Plain, quadratic versions of the operators' contracts."""

import re
from collections import defaultdict
from hashlib import sha256
from itertools import combinations


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[low(text)].append(doc)
    return sorted((doc, max(g := groups[low(text)]), len(g), doc == max(g), sha256(low(text).encode()).hexdigest()) for doc, text in docs)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
            root[b] = a
    return sorted((d, len(s), docs[find(i)][0]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def repeats(docs, length=200):
    where = defaultdict(int)
    texts = [(d, (t or "").encode()) for d, t in docs]
    for _, t in texts:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha256(kept).hexdigest()))
    return sorted(out)


def leaks(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(low(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w = word.findall(low(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def private(docs):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    out = []
    for doc, text in docs:
        spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
        listed = ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))
        out.append((doc, *(sum(s[3] == n for s in spans) for n, *_ in kinds), sha256(listed.encode()).hexdigest()))
    return sorted(out)
