"""Alignment of two tokenizers' ids, and how often each pair of ids ends together.

A and B cut the same bytes; places where tokens of both end cut a text into groups, and
the last ids of a group are a link. Two tokens that end together are suffixes of one
another, so no more than the vocabularies' bytes pairs exist (``bound``), whatever the
corpus: their keys and counts are vectors of a known size.

* First pass: tasks align their texts and keep one dense vector of counts over the
  pairs they have met; they hand on the keys of these pairs with the counts.
* The distinct keys, merged by a tree over key ranges, get a minimal perfect hash:
  keys alone at their bit of a level have found it, the others go on to the next
  level, and the rank of the bit is the hash. The tasks' counts become dense vectors
  indexed by it (keys are compared, not trusted), and are summed by a tree.
* Second pass: texts are aligned again, and the counts of their links looked up by
  hash, with the key stored there compared.

Neither tokenizer merges across a space that follows a character other than white
space, so a text is cut there, and a task aligns every distinct piece once. A also cuts
a stop from a letter before it, and B merges no two bytes that stand side by side in none
of its pieces; where both hold, the text is cut as well.

Defined results: texts that are null, empty, or not given back byte for byte by both
tokenizers have no tokens, zeros and an empty digest, and count for nothing; special
tokens written in a text are plain text; repeated rows count every time; an empty table
gives no rows; all columns of the input may be carried along under any names.
"""

import hashlib
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import units, vectors
from .text import cut, packed

U = np.uint64
RANGE = 1 << 14         # A ids of a range of keys
GAMMA = 2               # bits of a level for each key that is left
LEVELS = 64


def byte_tokens(lib):
    """Bytes of the entries of a byte-level vocabulary, by id."""
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others
    # for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary = lib.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        out[i] = bytes(back[c] for c in t)
    return out


def piece_tokens(lib):
    """Bytes of the pieces of a vocabulary with byte fallback, by id."""
    def one(p):
        byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", p)
        return bytes([int(byte[1], 16)]) if byte else p.replace("▁", " ").encode()
    return [one(lib.id_to_piece(i)) for i in range(lib.get_piece_size())]


class Pair:
    """Both tokenizers, with a memory of the aligned pieces of texts and of the pairs of ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_tokens(self.a), piece_tokens(self.b)
        self.n_b = len(self.bytes_b)
        if any(b" " in t.lstrip(b" ") for t in self.bytes_b):
            raise ValueError("a piece of B goes across a space, so texts cannot be cut there")
        self.stops = np.zeros((256, 256), dtype=bool)
        self.stops[np.ix_(units.LETTER, units.STOP)] = True
        for t in self.bytes_b:
            for x, y in zip(t, t[1:]):
                self.stops[x, y] = False
        # B puts a space before a text, so pieces without one are encoded after a letter they are cut from
        self.before = {" ": "a"} | {chr(y): chr(np.flatnonzero(self.stops[:, y])[0]) for y in np.flatnonzero(self.stops.any(axis=0))}
        self.before_size = {c: len(self.b.encode(x)) for c, x in self.before.items()}
        self.len_a, self.len_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.name_a, self.name_b = list(map(str, range(len(self.len_a)))), list(map(str, range(len(self.len_b))))
        self.keys, self.number = [], {}         # pairs of ids in the order in which they were met
        self.pieces = units.Units(self.learn, self.forget)

    def bound(self) -> int:
        """More pairs than two tokens of A and B can form by ending together."""
        in_a, in_b = Counter(self.bytes_a), Counter(self.bytes_b)
        # the shorter of two tokens that end together is a suffix of the longer
        return (sum(in_b[t[k:]] for t in self.bytes_a for k in range(len(t)))
                + sum(in_a[t[k:]] for t in self.bytes_b for k in range(1, len(t))))

    def forget(self):
        self.links = units.Ragged(np.int32)
        self.sizes = units.Ragged(np.int64)     # n_a, n_b, bad
        self.text = []

    def learn(self, pieces):
        texts = [p.decode("utf-8", "replace") for p in pieces]
        encoded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        own = [len(t) > 1 and t[0] == " " for t in texts]
        ids = self.b.encode([t[1:] if o else self.before[t[0]] + t for t, o in zip(texts, own)], num_threads=1)
        links, sizes = [], []
        for piece, text, o, ea, ib in zip(pieces, texts, own, encoded, ids):
            text, met, size = self.one(piece, ea.ids, ib if o else ib[self.before_size[text[0]]:])
            links.append(met)
            sizes.append(size)
            self.text.append(text)
        self.links.add(links)
        self.sizes.add(sizes)

    def one(self, piece, ia, ib):
        """(groups, links, (n_a, n_b, bad)) of a piece."""
        if b"".join([self.bytes_a[i] for i in ia]) != piece or b"".join([self.bytes_b[i] for i in ib]) != piece:
            return "", (), (0, 0, 1)
        la, lb, names_a, names_b, number, n_b = self.len_a, self.len_b, self.name_a, self.name_b, self.number, self.n_b
        groups, met, x, y, j, first_a, first_b = [], [], 0, 0, 0, 0, 0
        for i, a in enumerate(ia, 1):
            x += la[a]
            while y < x:
                b = ib[j]
                y += lb[b]
                j += 1
            if x == y:
                key = a * n_b + b
                n = number.get(key)
                met.append(self.numbered(key) if n is None else n)
                groups.append(",".join([names_a[k] for k in ia[first_a:i]]) + "|" + ",".join([names_b[k] for k in ib[first_b:j]]))
                first_a, first_b = i, j
        return ";".join(groups), met, (len(ia), len(ib), 0)

    def numbered(self, key):
        n = self.number[key] = len(self.keys)
        self.keys.append(key)
        return n

    def aligned(self, data, bounds, text: bool):
        """Per text n_a, n_b, number of links, groups; and all links as numbers of pairs."""
        n = len(bounds) - 1
        sizes, counts, links, parts = np.zeros((3, n), dtype=np.int64), np.zeros(n, dtype=np.int64), [], [[] for _ in range(n)]
        starts, ends = units.spaced_spans(data, bounds, self.stops)
        first = np.searchsorted(starts, bounds)
        for i, j, numbers in self.pieces.slices(data, starts, ends):
            own = np.searchsorted(bounds, starts[i:j], "right") - 1
            _, s = self.sizes.take(numbers)
            for row, values in zip(sizes, s.reshape(-1, 3).T):
                row += np.bincount(own, weights=values, minlength=n).astype(np.int64)
            size, flat = self.links.take(numbers)
            counts += np.bincount(own, weights=size, minlength=n).astype(np.int64)
            links.append(flat)
            if text:
                texts = [self.text[k] for k in numbers.tolist()]
                for d in range(int(own[0]), int(own[-1]) + 1):
                    lo, hi = max(first[d], i), min(first[d + 1], j)
                    if lo < hi:
                        parts[d].append(";".join(texts[lo - i:hi - i]))
        links = np.concatenate(links) if links else np.empty(0, dtype=np.int32)
        good = sizes[2] == 0
        links = links[np.repeat(good, counts)]
        counts[~good] = 0
        sizes[:, ~good] = 0
        return sizes[0], sizes[1], counts, [";".join(p) if g else "" for p, g in zip(parts, good)], links


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class PerfectHash:
    """Minimal perfect hash of distinct keys, levels of bits with ranks, and the keys themselves."""

    def __init__(self, keys):
        left, self.levels, base = np.asarray(keys, dtype=np.int64), [], 0
        while left.size:
            if len(self.levels) == LEVELS:
                raise ValueError("keys are not distinct")
            bits = GAMMA * len(left) + 1
            at = self.place(left, len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = (base + np.cumsum(alone) - alone).astype(np.int32)
            self.levels.append((alone, rank))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.key_at = np.zeros(base, dtype=np.int64)
        keys = np.asarray(keys, dtype=np.int64)
        self.key_at[self.ranks(keys)] = keys

    @staticmethod
    def place(keys, level, bits):
        with np.errstate(over="ignore"):
            return (units.mixed(keys.astype(np.uint64) + U(level + 1) * U(0x9E3779B97F4A7C15)) % U(bits)).astype(np.int64)

    def ranks(self, keys):
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self.place(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def __call__(self, keys):
        """Hashes of keys; a key that is not in the set is an error."""
        keys = np.asarray(keys, dtype=np.int64)
        got = self.ranks(keys)
        if (got < 0).any() or (self.key_at[got] != keys).any():
            raise ValueError("a pair that the first pass has not seen")
        return got


def met_pairs(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (range, part, keys, counts): the pairs of a task's texts with their counts."""
    def run(batches):
        import pyarrow as pa
        p, part = pair(path_a, path_b), TaskContext.get().partitionId()
        counts = np.zeros(0, dtype=np.int64)
        for b in batches:
            for _, data, bounds in units.text_blocks(b.column("t")):
                links = p.aligned(data, bounds, text=False)[-1]
                if len(p.keys) > len(counts):
                    counts = np.concatenate([counts, np.zeros(2 * len(p.keys) - len(counts), dtype=np.int64)])
                counts += np.bincount(links, minlength=len(counts))
        met = np.flatnonzero(counts)
        keys = np.array(p.keys, dtype=np.int64)[met]
        order = np.argsort(keys)
        keys, counts = keys[order], counts[met][order]
        ranges = keys // p.n_b // RANGE
        for r in np.unique(ranges):
            own = ranges == r
            yield pa.RecordBatch.from_pydict({
                "range": pa.array([r], pa.int32()), "part": pa.array([part % vectors.FAN], pa.int32()),
                "keys": [keys[own].astype("<i8").tobytes()], "counts": [counts[own].astype("<i8").tobytes()]})

    return texts.mapInArrow(run, "range int, part int, keys binary, counts binary")


def distinct_keys(rows: DataFrame) -> DataFrame:
    """(range, keys): the distinct keys of each range, by lot and then over the lots."""
    def merge(key, table):
        import pyarrow as pa
        found = np.empty(0, dtype="<i8")
        for raw in table.column("keys"):
            found = np.union1d(found, np.frombuffer(raw.as_py(), dtype="<i8"))
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([found.astype("<i8").tobytes()], pa.binary())})

    kind = "range int, keys binary"
    return (rows.select("range", "part", "keys").groupBy("range", "part").applyInArrow(merge, kind)
            .groupBy("range").applyInArrow(merge, kind))


def counted(rows: DataFrame, hashed):
    """The vector of counts over all tasks, indexed by the hash ``hashed`` (broadcast)."""
    def run(batches):
        import pyarrow as pa
        h, part = hashed.value, TaskContext.get().partitionId()
        dense = np.zeros(len(h.key_at), dtype=np.int64)
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts")):
                dense[h(np.frombuffer(keys.as_py(), dtype="<i8"))] += np.frombuffer(counts.as_py(), dtype="<i8")
        for chunk, lot, raw in vectors.chunks(part, dense):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([lot], pa.int32()), "counts": [raw]})

    return vectors.dense(rows.select("keys", "counts").mapInArrow(run, "chunk int, part int, counts binary"), len(hashed.value.key_at))


def pair_counts(texts: DataFrame, path_a: str, path_b: str):
    """(hash of all pairs, their counts, whether a pair is its B id's commonest)."""
    p = pair(path_a, path_b)
    rows = cut(met_pairs(texts, path_a, path_b))
    # bounded by the vocabularies' bytes, see the module's text
    keys = [np.frombuffer(r["keys"], dtype="<i8") for r in distinct_keys(rows).collect()]
    keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
    if len(keys) > p.bound():
        raise ValueError("more pairs than the vocabularies can form")
    h = PerfectHash(keys)
    counts = counted(rows, texts.sparkSession.sparkContext.broadcast(h))
    top = np.zeros(p.n_b, dtype=np.int64)
    np.maximum.at(top, h.key_at % p.n_b, counts)
    return h, counts, counts == top[h.key_at % p.n_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col="text", groups: bool = True) -> DataFrame:
    """All input columns and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    With ``groups`` also the groups themselves, as ``a1,a2|b1;a3|b2,b3``.
    """
    t = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = packed(docs).select("row", F.when(t == "", "").otherwise(F.concat(F.lit(" "), t)).alias("t"))
    table = rows.sparkSession.sparkContext.broadcast(pair_counts(rows.select("t"), path_a, path_b))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    cols = ", ".join(f"{c} bigint" for c in names) + ", groups_sha256 string" + ", groups string" * groups

    def run(batches):
        import pyarrow as pa
        p = pair(path_a, path_b)
        h, counts, best = table.value
        known = 0
        count_of, best_of = np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
        met_of = np.empty(0, dtype=bool)
        for b in batches:
            for lo, data, bounds in units.text_blocks(b.column("t")):
                na, nb, size, texts, links = p.aligned(data, bounds, text=True)
                if len(p.keys) > known:
                    # a worker may know pairs of other tables; those are never looked up
                    more = np.array(p.keys[known:], dtype=np.int64)
                    at = h.ranks(more)
                    there = (at >= 0)
                    there[there] = h.key_at[at[there]] == more[there]
                    at[~there] = 0
                    count_of = np.concatenate([count_of, counts[at] if len(counts) else np.zeros(len(at), dtype=np.int64)])
                    best_of = np.concatenate([best_of, best[at] if len(best) else np.zeros(len(at), dtype=bool)])
                    met_of = np.concatenate([met_of, there])
                    known = len(p.keys)
                if not met_of[links].all():
                    raise ValueError("a pair that the first pass has not seen")
                at = np.concatenate([[0], np.cumsum(size)])
                sums = [np.concatenate([[0], np.cumsum(v[links], dtype=np.int64)]) for v in (best_of, count_of)]
                found = [na, nb, size, size] + [s[at[1:]] - s[at[:-1]] for s in sums]
                digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").slice(lo, len(size))] + [pa.array(v, pa.int64()) for v in found] + [pa.array(digest, pa.string())]
                    + [pa.array(texts, pa.string())] * groups,
                    names=["row", *names, "groups_sha256"] + ["groups"] * groups)

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, {cols}").select("row.*", *[F.col(c.split()[0]) for c in cols.split(", ")])
