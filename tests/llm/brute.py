"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lines(rows, least=10):
    where = defaultdict(set)
    split = [(i, [(x, ascii_lower(x.strip(BLANK))) for x in (t or "").split("\n")]) for i, t in rows]
    for i, ls in split:
        for _, k in ls:
            if i is not None and len(k) >= least:
                where[k].add(i)
    out = []
    for i, ls in split:
        kept = [x for x, k in ls if not (i is not None and len(k) >= least and len(where[k]) > 1 and i > min(where[k]))]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def bytes_(rows, window=200):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if i is not None and count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def passages(rows, window=50):
    first = {}
    data = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingle_set(t, n=3):
    w = WORD.findall(ascii_lower(t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, percent=90):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def item_shingles(t, n=5):
    w = WORD.findall((t or "").lower())
    return {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def contaminated(docs, items, threshold=0.8):
    out = {}
    for i, t in docs:
        s = item_shingles(t)
        for j, u in items:
            q = item_shingles(u)
            if i is not None and j is not None and q and len(s & q) / len(q) >= threshold:
                out[i, j] = max(out.get((i, j), (0,))[0], len(s & q)), len(q)
    return sorted((i, j, q, n) for (i, j), (n, q) in out.items())
