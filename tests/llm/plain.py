"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_classes(rows):
    """rows [(id, text)] -> [(id, n, least id)], all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    meet = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            meet[g].append(k)
    for k, s in enumerate(sets):
        for j, o in Counter(j for g in s for j in meet[g] if j < k).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                par[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def copies(rows):
    """rows [(id, text)] -> [(id, keep, size, kept, digest)]."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, g in groups.items():
        g.sort(key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        h = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, g[0][0], len(g), k == 0, h) for k, (i, _) in enumerate(g)]
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for o, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                    "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def quality_counts(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep),
            len(w) < 50 or 100 * len(rep) > 50 * len(w))


def mix_targets(per_source, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """{source: size} -> {source: target}."""
    order = sorted(per_source, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = budget * sum(per_source.values()), set()
    while True:
        left = total - sum(cap * per_source[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        t = {s: cap * per_source[s] if s in full else left * w[s] / rest for s in order}
        over = {s for s in order if s not in full and t[s] >= cap * per_source[s]}
        if not over:
            return t
        full |= over
        if len(full) == len(order):
            return {s: cap * per_source[s] for s in order}
