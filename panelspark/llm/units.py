"""Units of texts (words, or words with the space before them) numbered block by block in numpy.

A tokenizer that never merges across a unit's ends encodes each distinct unit once. The
units of a block of texts are found on the bytes of the Arrow column, known by two 64-bit
digests, and looked up in a table of fixed size; only units that the task has not met
are handed to ``learn``. Units beyond ``LONG`` bytes, and units whose first digests meet,
are told apart by their bytes.
"""

import itertools

import numpy as np

U = np.uint64
BLOCK = 1 << 20         # bytes whose digests are taken at once
UNITS = 1 << 18         # units looked up at once
LIMIT = 1 << 20         # units that a table remembers; it then starts anew
LONG = 256              # longer units are known by their bytes
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# first bytes of the three- and two-byte characters among which white space is found
DOUBTFUL = np.zeros(256, dtype=bool)
DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LETTER, STOP, LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
LETTER[65:91] = LETTER[97:123] = True
STOP[list(b",.;:!?")] = True
LOWER[65:91] += 32


def mixed(x):
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = {}


def powers(base, n: int):
    """base**i and base**-i for i < n."""
    up, down = _powers.get(int(base), (np.empty(0), None))
    if len(up) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, base), np.full(size, U(pow(int(base), -1, 1 << 64)))
        up[0] = down[0] = U(1)
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[int(base)] = up, down
    return up[:n], down[:n]


def digests(data, starts, ends):
    """Two digests of every span of a block."""
    out, size = [], mixed((ends - starts).astype(np.uint64))
    for base in BASES:
        up, down = powers(base, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + U(1)) * up[:len(data)], out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * down[starts] + size))
    return out


def text_blocks(column):
    """(first row, bytes, bounds of the texts) of blocks of an Arrow string column."""
    import pyarrow as pa
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1, lo + 1)
        yield lo, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def word_spans(data, bounds):
    """Runs of bytes other than white space, inside the texts, cut where a stop follows a letter."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    stop = LETTER[data[:-1]] & STOP[data[1:]]
    first[1:] &= ~word[:-1] | stop
    last[:-1] &= ~word[1:] | stop
    full = bounds[:-1] < bounds[1:]
    a, b = bounds[:-1][full], bounds[1:][full] - 1
    first[a], last[b] = word[a], word[b]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def spaced_spans(data, bounds, stops):
    """Texts cut before every space that surely follows a character other than white space.

    ``stops`` (letter, stop) tells further pairs of bytes that are cut apart.
    """
    cut = np.zeros(len(data), dtype=bool)
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    lead = np.where(two >= 0xC0, two, three)
    cut[at[np.where(one < 0x80, one > 32, ~DOUBTFUL[lead])]] = True
    cut[1:] |= stops[data[:-1], data[1:]]
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data))


class Units:
    """Numbers of units. ``learn(list of bytes)`` is told new ones, ``forget()`` that the table starts anew."""

    def __init__(self, learn, forget, limit: int = LIMIT):
        self.learn, self.forget, self.limit = learn, forget, limit
        self.mask = (1 << (2 * limit - 1).bit_length()) - 1
        self.reset()

    def reset(self):
        self.key = np.zeros((2, self.mask + 1), dtype=np.uint64)
        self.slot = np.full(self.mask + 1, -1, dtype=np.int32)
        self.n, self.exact, self.held = 0, {}, 0
        self.forget()

    def find(self, d1, d2):
        out, left = np.full(len(d1), -1, dtype=np.int64), np.arange(len(d1))
        p = (d1 & U(self.mask)).astype(np.int64)
        while left.size:
            s = self.slot[p]
            hit = (s >= 0) & (self.key[0][p] == d1[left]) & (self.key[1][p] == d2[left])
            out[left[hit]] = s[hit]
            on = (s >= 0) & ~hit
            left, p = left[on], (p[on] + 1) & self.mask
        return out

    def put(self, d1, d2, numbers):
        left, p = np.arange(len(d1)), (d1 & U(self.mask)).astype(np.int64)
        while left.size:
            free = self.slot[p] < 0
            self.slot[p[free]] = numbers[left[free]]
            won = free & (self.slot[p] == numbers[left])
            self.key[0][p[won]], self.key[1][p[won]] = d1[left[won]], d2[left[won]]
            left, p = left[~won], (p[~won] + 1) & self.mask

    def slices(self, data, starts, ends):
        """(i, j, numbers of the units i to j); a number holds until the next slice is asked for."""
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
            j = min(max(j, i + 1), i + UNITS, len(starts))
            yield i, j, self.numbers(data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
            i = j

    def numbers(self, data, starts, ends):
        if self.n + len(starts) > self.limit or self.held > 64 * BLOCK:
            self.reset()
        out = np.full(len(starts), -1, dtype=np.int64)
        odd = ends - starts > LONG
        plain = np.flatnonzero(~odd)
        if plain.size:
            with np.errstate(over="ignore"):
                d1, d2 = digests(data, starts[plain], ends[plain])
            got = self.find(d1, d2)
            miss = np.flatnonzero(got < 0)
            if miss.size:
                u, first, back = np.unique(d1[miss], return_index=True, return_inverse=True)
                u2 = d2[miss][first]
                same = d2[miss] == u2[back]
                numbers = np.arange(self.n, self.n + len(u))
                where = plain[miss[first]]
                self.learn([data[a:b].tobytes() for a, b in zip(starts[where].tolist(), ends[where].tolist())])
                self.put(u, u2, numbers)
                self.n += len(u)
                got[miss[same]] = numbers[back[same]]
                odd[plain[miss[~same]]] = True
            out[plain] = got
        for k in np.flatnonzero(odd).tolist():
            raw = data[starts[k]:ends[k]].tobytes()
            if raw not in self.exact:
                self.learn([raw])
                self.exact[raw] = self.n
                self.n += 1
                self.held += len(raw)
            out[k] = self.exact[raw]
        return out


class Ragged:
    """Rows of numbers of any length, appended in lots and gathered by row number."""

    def __init__(self, dtype):
        self.flat, self.at, self.rows, self.used = np.empty(1 << 16, dtype=dtype), np.zeros(1 << 14, dtype=np.int64), 0, 0

    def add(self, lists):
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(lists) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
        if total:
            self.flat[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(lists), self.flat.dtype, total)
        self.at[self.rows + 1:self.rows + len(lists) + 1] = self.used + np.cumsum(size)
        self.rows, self.used = self.rows + len(lists), self.used + total

    def take(self, rows):
        """(sizes of the rows, their numbers one after another)."""
        size = self.at[rows + 1] - self.at[rows]
        shift = np.repeat(self.at[rows] - (np.cumsum(size) - size), size)
        return size, self.flat[shift + np.arange(len(shift))]
