"""The operators' contracts, done plainly in Python."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(docs, items, size=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def quality(text):
    w = SPACED.findall(text or "")
    seen, hit, lines, dup = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set(), set(), 0
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            hit |= set(range(k, k + 5))
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(docs):
    """{index of row: (set size, least id)}, all pairs compared."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(docs)):
        groups[find(k)].append(docs[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return [(i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(docs, sets))]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_lines(a, b):
    """Word lists within one edit: of words if both have five, else of characters of short lines."""
    if min(len(a), len(b)) >= 5:
        return one_edit(a, b)
    x, y = " ".join(a), " ".join(b)
    return max(len(a), len(b)) <= 5 and 20 <= min(len(x), len(y)) and max(len(x), len(y)) <= 1000 and one_edit(tuple(x), tuple(y))


def lines_gone(docs):
    """{doc_id: (exact line numbers, near line numbers)}; ids must differ."""
    first, seen = {}, []
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            if w := tuple(SPACED.findall(line)):
                seen.append((i, k, w))
                first.setdefault(w, (i, k))
    near = {a for a in first for b in first if a != b and first[b] < first[a] and abs(len(a) - len(b)) < 2 and near_lines(a, b)}
    gone = defaultdict(lambda: (set(), set()))
    for i, k, w in seen:
        if w in near:
            gone[i][1].add(k)
        elif first[w] != (i, k):
            gone[i][0].add(k)
    return gone


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target}: excess reshared round by round."""
    total = defaultdict(int)
    for s, n in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = sum(total.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= cap * total[s]}
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap * total[s]
            left -= out[s]
        open_ -= full
    return out
