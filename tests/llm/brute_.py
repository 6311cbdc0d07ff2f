"""Plain versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op2(docs, size=50, with_kept=False):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w not in first or d < first[w]:
                first[w] = d
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept), kept))
    return out if with_kept else [x[:5] for x in out]


def op3(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = set()
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                rep |= set(range(i, i + 8))
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed))
    return out


def op6(docs, size=35):
    words = [WORD.findall(t or "") for _, t in docs]
    c = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if c[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op7(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = tuple(ITEM.findall((t or "").translate(LOWER)))
        if w:
            for k in range(max(1, len(w) - size + 1)):
                windows[w[k : k + size]].add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = ITEM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if (x := tuple(w[k : k + s])) in windows:
                    hit |= set(range(k, k + s))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def op9(pages, rules):
    out = []
    for p, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fits = [(len(h) + len(q), len(h), h + q, v) for h, q, v in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        best = max(fits, default=(0, 0, None, "allow"))
        out.append((p, host, path, best[2], best[3]))
    return out


def shingles(t, size=5):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def op10(docs):
    sets = [shingles(t) for _, t in docs]
    post = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            post[x].append(i)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        c = Counter(j for x in s for j in post[x] if j < i)
        for j, n in c.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(docs):  # rows with one id are one document
        if sets[i]:
            parent[root(i)] = root(first.setdefault(d, i))
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(d, low.get(root(i), d))
    return [(d, len(s), low[root(i)], d == low[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
