"""Sets of 5-word shingles as 64-bit digests, for a block of texts at once in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A word's digest is a
polynomial over its bytes, taken from prefix sums over the whole block; a shingle mixes
the digests of its words. Two texts could only be miscounted if two of their different
shingles shared a digest.
"""

import numpy as np

WIDTH = 5
BLOCK = 1 << 20         # bytes of text handled at once; one longer text is a block
U = np.uint64
BASE, BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += U(32)


def mix(x):
    """A 64-bit finaliser; a bijection."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


_powers = {}


def powers(n: int):
    if _powers.get("n", 0) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE), np.full(size, BACK)
        up[0] = down[0] = U(1)
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def word_digests(data: np.ndarray):
    """(digest of every word, its first byte) of a block of bytes that ends in white space."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data] + U(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + mix((end - start).astype(np.uint64))), start


def sets_of(texts):
    """One sorted array of distinct digests per text (empty without words)."""
    out, block, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass") + b"\n"
        block.append(raw)
        size += len(raw)
        if size >= BLOCK:
            out += _sets(block)
            block, size = [], 0
    return out + (_sets(block) if block else [])


def _sets(block):
    with np.errstate(over="ignore"):
        data = np.frombuffer(b"".join(block), dtype=np.uint8)
        w, start = word_digests(data)
        bounds = np.searchsorted(start, np.cumsum([0] + [len(b) for b in block]))
        full = max(len(w) - WIDTH + 1, 0)
        s = w[:full].copy()
        for k in range(1, WIDTH):
            s = mix(s * M3 + w[k:full + k])
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= WIDTH:
                out.append(np.unique(s[lo:hi - WIDTH + 1]))
            elif hi > lo:       # the whole short sequence is the one shingle
                x = mix(U(hi - lo) * M1)
                for k in range(lo, hi):
                    x = mix(x * M3 + w[k])
                out.append(np.array([x], dtype=np.uint64))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out


def total(s, seed: int) -> int:
    """Order-free digest of a set, signed."""
    with np.errstate(over="ignore"):
        return int(np.sum(mix(s + mix(U(seed) * M2)), dtype=np.uint64).astype(np.int64))
