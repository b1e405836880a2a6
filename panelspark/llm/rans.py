"""Static range asymmetric numeral systems over shared frequencies, in numpy.

Symbols are coded in blocks of ``LANES`` interleaved coders with 64-bit states and 32-bit
words. A block starts from fresh states, so blocks are independent; every ``SEGMENT``
steps the states are kept as a checkpoint, so segments of a block decode on their own
as well, many at once along one axis.
"""

import numpy as np

U = np.uint64
LANES = 64
SEGMENT = 256                   # steps between checkpoints: 16,384 symbols
BLOCK = 4 * SEGMENT             # steps of a block: 65,536 symbols
LOW = U(1 << 31)                # states lie in [2^31, 2^63)


class Table:
    """Frequencies of all symbols in steps of 2^-bits; every symbol that occurs has one step at least."""

    def __init__(self, freq):
        self.freq = np.asarray(freq, dtype=np.uint64)
        total = int(self.freq.sum())
        self.bits = max(total.bit_length() - 1, 0)
        if total and total != 1 << self.bits:
            raise ValueError("frequencies do not add up to a power of two")
        self.low = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.pad = int(self.freq.argmax()) if total else 0

    @classmethod
    def of(cls, counts):
        """The table of exact counts; the rest of the division goes to the commonest symbol."""
        counts = [int(c) for c in counts]
        present, total = sum(c > 0 for c in counts), sum(counts)
        if not total:
            return cls(np.zeros(len(counts), dtype=np.uint64))
        steps = 1 << max(16, present.bit_length() + 4)
        freq = [1 + c * (steps - present) // total if c else 0 for c in counts]
        freq[max(range(len(counts)), key=counts.__getitem__)] += steps - sum(freq)
        return cls(np.array(freq, dtype=np.uint64))


def encode(table: Table, symbols):
    """Segments [(states, words)] of blocks given as an array (blocks, steps, LANES)."""
    blocks, steps, _ = symbols.shape
    if not table.freq[symbols].all():
        raise ValueError("a symbol without a frequency")
    bits, rest = U(table.bits), U(63 - table.bits)
    x = np.full((blocks, LANES), LOW)
    words = np.empty((blocks, steps, LANES), dtype=np.uint32)
    out = np.empty((blocks, steps, LANES), dtype=bool)
    marks = np.empty((blocks, -(-steps // SEGMENT), LANES), dtype=np.uint64)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t, :]
        f = table.freq[s]
        big = x >= f << rest
        words[:, t, :], out[:, t, :] = x.astype(np.uint32), big
        x = np.where(big, x >> U(32), x)
        q = x // f
        x = (q << bits) + (x - q * f) + table.low[s]
        if t % SEGMENT == 0:
            marks[:, t // SEGMENT, :] = x
    found = []
    for b in range(blocks):
        for k in range(marks.shape[1]):
            part = slice(k * SEGMENT, (k + 1) * SEGMENT)
            found.append((marks[b, k], words[b, part][out[b, part]]))
    return found


def decode(table: Table, segments, steps: int):
    """Symbols (segments, steps * LANES) of segments [(states, words)] of equal length."""
    x = np.stack([s for s, _ in segments])
    sizes = np.array([len(w) for _, w in segments], dtype=np.int64)
    buf = np.concatenate([w for _, w in segments] + [np.zeros(1, dtype=np.uint32)]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    end = at + sizes
    bits, mask = U(table.bits), U((1 << table.bits) - 1)
    out = np.empty((len(segments), steps, LANES), dtype=np.uint32)
    for t in range(steps):
        slot = x & mask
        s = table.symbol[slot]
        out[:, t, :] = s
        x = table.freq[s] * (x >> bits) + slot - table.low[s]
        need = x < LOW
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        x = np.where(need, (x << U(32)) | buf[np.minimum(np.maximum(place, 0), len(buf) - 1)], x)
        at += need.sum(axis=1)
    if (at != end).any():
        raise ValueError("a segment has more or fewer words than its symbols need")
    return out.reshape(len(segments), steps * LANES)
