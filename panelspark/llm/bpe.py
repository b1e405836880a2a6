"""BPE ids of whole texts, and back, by tree concatenation of encoded pieces.

White space separates the units of this vocabulary, so a text cut at spaces encodes
piece by piece, and equal units are encoded once per task. Long texts become pieces
that are encoded in parallel tasks. Text without a space (one unit of any length) is
cut anywhere; its pieces are encoded in parallel tasks too, and the halves are joined along
a tree from the ids already made: only the text around a join is encoded again, in a window that doubles until it shares a token (same id and place)
with the left half and one with the right half. Every pair of neighbours in the joined
ids then stands in some valid encoding, and an encoding is the valid one exactly when
all neighbouring pairs are valid, so the join is exact.

Defined results: null text counts as empty; an empty text has no ids and decodes to an
empty text; special tokens written in a text become their ids, as the library does by
default; repeated rows are encoded alike; an empty table gives no rows; all columns of
the input may be carried along under any names.
"""

import hashlib
import os
import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .text import packed

PIECE = 32_768      # characters of a piece; longer texts are spread over tasks
WINDOW = 64         # first window: characters on each side of a join
CACHE = 600_000     # units remembered by a task

# The vocabulary's split of lower-case text, spelled out for the letters and
# numbers of Latin-1, and the characters for which that spelling holds.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile("[\n\t\x20-\x7e\xa1-\xff]*")
UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\n\t {LETTERS}{NUMBERS}]+")


class Codec:
    """The library's tokenizer with a memory of the units of a text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one task, one core
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.ids, self.out = {"": b""}, {"": ""}

    def triples(self, text: str):
        e = self.lib.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]

    def learn(self, units):
        """Encodes the new units; one that is longer than a piece goes along the tree."""
        new = list(set(units).difference(self.ids))
        if len(self.ids) + len(new) > CACHE:
            self.ids, self.out = {"": b""}, {"": ""}
            new = list(set(units).difference(self.ids))
        short = [u for u in new if len(u) <= PIECE]
        long = [u for u in new if len(u) > PIECE]
        encoded = [e.ids for e in self.lib.encode_batch_fast(short, add_special_tokens=False)]
        encoded += [self.tree(u)[:, 0].tolist() for u in long]
        for u, ids in zip(short + long, encoded):
            self.ids[u] = array("I", ids).tobytes()
            self.out[u] = self.lib.decode(ids, skip_special_tokens=False)

    def units(self, text: str):
        """Parts of a text that are encoded apart from each other."""
        if LATIN.fullmatch(text):
            return UNIT.findall(text.lower())
        return text.split(" ")

    def encode(self, text: str):
        """(ids as bytes, decoded text)."""
        if "<|" in text:
            ids, out = [], []
            for i, part in enumerate(self.split.split(text)):
                a, b = ((array("I", [self.special[part]]).tobytes(), part) if i % 2 else self.plain(part))
                ids.append(a)
                out.append(b)
            return b"".join(ids), " ".join(filter(None, out))
        return self.plain(text)

    def plain(self, text: str):
        units = self.units(text)
        ids = list(map(self.ids.get, units))
        if None in ids:
            self.learn(units)
            ids = map(self.ids.__getitem__, units)
        return b"".join(ids), " ".join(filter(None, map(self.out.__getitem__, units)))

    def table(self, text: str):
        """The triples as the columns of an array."""
        e = self.lib.encode(text, add_special_tokens=False)
        return np.column_stack([np.array(e.ids, dtype=np.int64), np.array(e.offsets, dtype=np.int64).reshape(-1, 2)])

    def tree(self, text: str, size: int = PIECE):
        """Triples of one unit, by halves."""
        cuts = range(0, max(len(text), 1), size)
        return self.joined(text, [(lo, self.table(text[lo:lo + size])) for lo in cuts], len(text))

    def joined(self, text, parts, last):
        """Triples of the text up to ``last`` from parts (first place, triples from there), by halves."""
        if len(parts) == 1:
            lo, t = parts[0]
            return t + np.array([0, lo, lo])
        half = len(parts) // 2
        at = parts[half][0]
        return self.join(text, parts[0][0], at, last, self.joined(text, parts[:half], at), self.joined(text, parts[half:], last))

    def join(self, text, first, at, last, left, right):
        """Triples of text[first:last] from those of text[first:at] and of text[at:last].

        Windows grow inside the text that both cover, and only the triples inside a window
        are looked at.
        """
        width = WINDOW
        while at - first > width or last - at > width:
            lo, hi = max(first, at - width), min(last, at + width)
            mid = [(i, a + lo, b + lo) for i, a, b in self.triples(text[lo:hi])]
            i0 = int(np.searchsorted(left[:, 1], lo)) if len(left) else 0
            m1 = int(np.searchsorted(right[:, 2], hi, "right")) if len(right) else 0
            start = (-i0, 0) if lo == first else first_shared([*map(tuple, left[i0:].tolist())], mid, at)
            if start is not None:
                i, j = i0 + start[0], start[1]
                end = last_shared(mid, [*map(tuple, right[:m1].tolist())], at) if hi < last else (len(mid), len(right))
                if end is not None:
                    k, m = end
                    if k >= j:
                        return np.concatenate([left[:i], np.array(mid[j:k], dtype=np.int64).reshape(-1, 3), right[m:]])
            width *= 2
        return self.table(text[first:last]) + np.array([0, first, first])


def first_shared(left, mid, at):
    """Places (in left, in mid) of a token that both have, whole, before the join."""
    seen = {}
    for i in range(len(left) - 1, -1, -1):
        if left[i][1] < mid[0][1] if mid else True:
            break
        seen.setdefault(left[i], i)
    count = {}
    for t in mid:
        count[t] = count.get(t, 0) + 1
    for j, t in enumerate(mid):
        if t[2] >= at:
            return None
        if j and t in seen and count[t] == 1:
            return seen[t], j
    return None


def last_shared(mid, right, at):
    """Places (in mid, in right) of a token that both have, whole, after the join."""
    seen = {}
    for i, t in enumerate(right):
        if not mid or t[2] > mid[-1][2]:
            break
        seen.setdefault(t, i)
    count = {}
    for t in mid:
        count[t] = count.get(t, 0) + 1
    for j in range(len(mid) - 2, -1, -1):
        t = mid[j]
        if t[1] <= at:
            return None
        if t in seen and count[t] == 1:
            return j, seen[t]
    return None


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def pieces(text: str, size: int = PIECE):
    """(text, joined) parts of a long text: cut at spaces, else anywhere (joined to the next)."""
    at, out = 0, []
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = text.rfind(" ", at + 1, end + 1)
            if space > 0:
                out.append((text[at:space], False))
                at = space
                continue
        out.append((text[at:end], end < len(text)))
        at = end
    return out


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """All input columns, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids.

    Texts of up to one piece are encoded where they are read. Longer ones are cut, their
    pieces dealt over the tasks, and each text is put together by one task, which encodes
    nothing but the windows around the joins.
    """
    import pyarrow as pa

    cols = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    plain = packed(docs).select("row", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("t"))

    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds += [("ids", pa.list_(pa.int32()))] * ids

    def finish(data, decoded):
        out = {"n_tokens": len(data) // 4, "ids_sha256": hashlib.sha256(data).hexdigest(),
               "decoded_sha256": hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()}
        if ids:
            a = array("I")
            a.frombytes(data)
            out["ids"] = a.tolist()
        return out

    def short(batches):
        c = codec(path)
        for b in batches:
            rows, ts, step = b.column("row"), b.column("t"), 64
            for lo in range(0, len(ts), step):
                done = [finish(*c.encode(t)) for t in ts.slice(lo, step).to_pylist()]
                part = [rows.slice(lo, step)]
                yield pa.RecordBatch.from_arrays(part + [pa.array([x[k] for x in done], kind) for k, kind in kinds],
                                                 names=["row"] + [k for k, _ in kinds])

    def cut_up(batches):
        for b in batches:
            for k, t in zip(b.column("key").to_pylist(), b.column("t").to_pylist()):
                before = False
                for i, (p, joined) in enumerate(pieces(t, PIECE)):
                    yield pa.RecordBatch.from_pydict({"key": [k], "i": [i], "t": [p], "joined": [joined], "run": [joined or before]})
                    before = joined

    def encode_pieces(batches):
        c = codec(path)
        for b in batches:
            for k, i, t, j, run in zip(*(b.column(x).to_pylist() for x in ("key", "i", "t", "joined", "run"))):
                if run:     # part of a run without a space: ids with their places, and the text around the joins
                    data, decoded = c.table(t).astype("<i4").tobytes(), t
                else:
                    data, decoded = c.encode(t)
                yield pa.RecordBatch.from_pydict({"key": [k], "i": [i], "joined": [j], "data": [data], "decoded": [decoded]})

    def put_together(key, table):
        c = codec(path)
        table = table.sort_by("i")
        js, data, decoded = (table.column(x).to_pylist() for x in ("joined", "data", "decoded"))
        parts, k = [], 0
        while k < len(js):
            end = k
            while js[end]:
                end += 1
            if end == k:
                parts.append((data[k], decoded[k]))
            else:       # an uncut run over several pieces
                starts = accumulate(map(len, decoded[k:end]), initial=0)
                tables = [(at, np.frombuffer(d, dtype="<i4").reshape(-1, 3).astype(np.int64)) for at, d in zip(starts, data[k:end + 1])]
                run = "".join(decoded[k:end + 1])
                ids = c.joined(run, tables, len(run))[:, 0]
                parts.append((ids.astype("<u4").tobytes(), c.lib.decode(ids.tolist(), skip_special_tokens=False)))
            k = end + 1
        whole = finish(b"".join(d for d, _ in parts), " ".join(x for _, x in parts if x))
        return pa.Table.from_pydict({"key": [key[0].as_py()], **{a: [v] for a, v in whole.items()}},
                                    schema=pa.schema([("key", pa.string()), *kinds]))

    row_type = plain.schema["row"].dataType.simpleString()
    near = plain.filter(F.length("t") <= PIECE).mapInArrow(short, f"row {row_type}, {cols}")
    far = plain.filter(F.length("t") > PIECE).withColumn("key", F.sha2("t", 256))
    cut_rows = far.select("key", "t").mapInArrow(cut_up, "key string, i bigint, t string, joined boolean, run boolean")
    done = (cut_rows.dropDuplicates(["key", "i"])      # equal texts are encoded once
            .mapInArrow(encode_pieces, "key string, i bigint, joined boolean, data binary, decoded string")
            .groupBy("key").applyInArrow(put_together, f"key string, {cols}"))
    far = far.select("row", "key").join(done, "key").drop("key")
    return near.unionByName(far).select("row.*", *[F.col(x.split()[0]) for x in cols.split(", ")])
