"""Plain-Python forms of the operators, for small inputs."""

import base64
import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
sha = lambda b: hashlib.sha256(b).hexdigest()
big = lambda d: 2**63 - 1 if d is None else d


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def suffix(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], big(d)), big(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < big(d):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def substrings(rows, n=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, big(d)), big(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < big(d):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(t, n=5):
    w = words((t or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(rows, percent):
    sets = {d: shingles(t) for d, t in rows}

    def linked(a, b):
        n = len(sets[a] & sets[b])
        return n and 100 * n >= percent * len(sets[a] | sets[b])

    comp = components(sorted(sets), linked)
    return {(d, len(sets[d]), comp[d], comp[d] == d) for d in sets}


def lines(rows, percent=80, n=7):
    places = defaultdict(list)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if words(x):
                places[x].append((d, i))
    keys = sorted(places)
    sets = {k: {k[i : i + n] for i in range(max(1, len(k) - n + 1))} for k in keys}
    comp = components(keys, lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    groups = defaultdict(list)
    for k in keys:
        groups[comp[k]] += places[k]
    return {p for g in groups.values() for p in g if p != min(g)}


def contaminated(rows, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = defaultdict(set)
    for item, t in items:
        w = cut(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known[tuple(w[i : i + n])].add(item)
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for k, v in known.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    found |= v
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), ids))
    return out


def secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 8)
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        out += [(m.start(), 1, "access", m.end())] * (len(m[0]) >= 16)
    for m in re.finditer(r"[0-9a-f]+", t):
        out += [(m.start(), 2, "hex", m.end())] * (len(m[0]) >= 32)
    return [(k, a, b) for a, _, k, b in sorted(out)]


def quality(t):
    w = words(t)
    seen, hit = defaultdict(list), set()
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in range(i, i + 5)}
    rows = [x for x in (t or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    return len(w), sum(map(len, w)), symbols, len(rows) - len(set(rows)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def host_verdicts(docs):
    """(rate of the row's host, kept) per row (id, text, host): failures shrunk with a beta prior."""
    failed, hosts = [], {}
    for _, t, h in docs:
        n, _, symbols, dup, _, bad = quality(t)
        lines = len([x for x in (t or "").split("\n") if words(x)])
        failed.append(bad or 100 * symbols > 30 * n or 100 * dup > 60 * lines)
        k, f = hosts.get(h, (0, 0))
        hosts[h] = k + 1, f + failed[-1]
    n = sum(k for k, _ in hosts.values())
    m = sum(f for _, f in hosts.values()) / n
    spread = sum(f * f / k for k, f in hosts.values()) / n - m * m - m * (1 - m) * len(hosts) / n
    s = min(1e6, max(2.0, m * (1 - m) / spread - 1)) if spread > 1e-12 else 1e6
    rate = {h: (f + m * s) / (k + s) for h, (k, f) in hosts.items()}
    return [(rate[h], not quality(t)[-1] and rate[h] <= 0.6) for _, t, h in docs]


def base32_sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()
