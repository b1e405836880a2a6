"""Token ids in compact files: static rANS blocks, written and read by a Python data source.

Texts are encoded by the tokenizers library, each distinct word once per task, and
every document ends with one more id. The counts of all ids, summed by a tree over the
tasks' dense vectors, give one table of frequencies for all files. Rows are
range-partitioned and sorted by document id, and each task writes one file; the job's
commit names the files that count, so the file of a lost or repeated task is never read.

A file holds, one after another,

* segments: ``LANES`` coder states (a checkpoint) and the 32-bit words up to the next
  one. Four segments of 16,384 ids make a block, blocks are coded independently;
* the index of segments: first byte, words, ids and CRC-32 of the ids of each;
* the documents in chunks of up to ``DOCS`` or ``SPAN`` ids: their ids and lengths;
* the index of chunks, and a footer with the places of both indexes.

The manifest holds the frequencies and, by file, its ids and the ids before it. Reading
deals ranges of chunks over tasks; a task decodes only the segments that its documents
touch, all at once, and compares each segment's checksum.

Defined results: null text counts as empty, and an empty text has the end id only;
special tokens written in a text become their ids, as the library does by default;
documents of equal ids are written next to each other, null ids first; the order of
repeated ids follows a hash of their tokens; an empty table gives files without rows;
columns other than the two named are not read.
"""

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from . import rans, units, vectors
from .text import cut

SCHEMA = "id bigint, start bigint, n_tokens bigint, ids binary"
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
TOGETHER = 200          # words of letters that the library encodes in one text
END = 1                 # id after every document
DOCS, SPAN = 4096, 1 << 20      # documents and ids of a chunk of documents
SPLIT = 1 << 22         # ids that a reading task takes
ROWS = 1 << 20          # ids in an Arrow batch that is read
LOT = 32                # blocks that are coded at once
FOOTER = struct.Struct("<8sQIQI")
MAGIC = b"RANSIDS1"
MANIFEST = "_manifest.json"


class WordCodec:
    """Ids of texts by the library, one call for each word that the task has not met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one task, one core
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in self.lib.get_vocab().items() if t.endswith("</w>")]] = True
        self.words = units.Units(self.learn, self.forget)

    def forget(self):
        self.ids = units.Ragged(np.uint32)

    def learn(self, words):
        texts = [w.decode("utf-8", "replace") for w in words]
        found = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if LETTERS.fullmatch(t)]
        other = [k for k, t in enumerate(texts) if not LETTERS.fullmatch(t)]
        lots = [" ".join(texts[k] for k in plain[i:i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        # every run of letters is one piece, whose last id ends a word
        flat = np.array([i for e in self.call(lots) for i in e.ids], dtype=np.uint32)
        for k, ids in zip(plain, np.split(flat, np.flatnonzero(self.ends[flat]) + 1)):
            found[k] = ids
        for k, e in zip(other, self.call([texts[k] for k in other])):
            found[k] = e.ids
        self.ids.add(found)

    def call(self, texts):
        return self.lib.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, data, bounds, end: int):
        """(ids of all texts, each followed by ``end``; sizes of the texts).

        The vocabulary is of lower case and cuts letters from stops, so words are looked up
        in lower case and without the stop that follows; not so near a special token.
        """
        if b"<|" not in data.tobytes():
            data = units.LOWER[data]
        starts, ends = units.word_spans(data, bounds)
        sizes, ids = [np.zeros(1, dtype=np.int64)], []
        for _, _, numbers in self.words.slices(data, starts, ends):
            size, flat = self.ids.take(numbers)
            sizes.append(size)
            ids.append(flat)
        before = np.cumsum(np.concatenate(sizes))
        ids = np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32)
        at = before[np.searchsorted(starts, bounds)]
        return np.insert(ids, at[1:], end), np.diff(at) + 1


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encoded(docs: DataFrame, tokenizer: str, end: int = END, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, ids, h) of the documents and rows (chunk, part, counts) of the ids' counts.

    ``ids`` are little-endian, of two bytes while the vocabulary allows it, else of four.
    """
    names = ["id", "ids", "h", "chunk", "part", "counts"]

    def run(batches):
        import pyarrow as pa
        c, part = codec(tokenizer), TaskContext.get().partitionId()
        counts = np.zeros(max(c.size, end + 1), dtype=np.int64)
        kind = "<u2" if len(counts) <= 1 << 16 else "<u4"
        for b in batches:
            for lo, data, bounds in units.text_blocks(b.column("t")):
                ids, size = c.encode(data, bounds, end)
                counts += np.bincount(ids, minlength=len(counts))
                n, raw = len(size), ids.astype(kind)
                at = np.concatenate([[0], np.cumsum(size)]) * raw.itemsize
                h = pa.array([zlib.crc32(memoryview(raw)[i // raw.itemsize:j // raw.itemsize]) for i, j in zip(at, at[1:])], pa.int64())
                rows = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, n), rows.cast(pa.binary()), h, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.binary())], names=names)
        for chunk, lot, packed in vectors.chunks(part, counts):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([chunk], pa.int32()),
                 pa.array([lot], pa.int32()), pa.array([packed], pa.binary())], names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "id bigint, ids binary, h bigint, chunk int, part int, counts binary")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col="doc_id", text_col="text") -> None:
    """Writes the ids of all documents under ``path``, in ascending order of their ids."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    both = cut(encoded(docs, tokenizer, end, id_col, text_col))
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end + 1)
    table = rans.Table.of(vectors.dense(both.filter("chunk is not null"), size))
    save(both.filter("chunk is null").select("id", "ids", "h"), path, table, 2 if size <= 1 << 16 else 4)


def save(rows: DataFrame, path: str, table: rans.Table, width: int) -> None:
    """Rows (id, ids, h) as files in ascending order of id and h."""
    rows.sparkSession.dataSource.register(TokenSource)
    (rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "ids").write
     .format("rans_ids").mode("append").option("path", path).option("width", str(width))
     .option("table", packed(table.freq.astype("<u4")).hex()).save())


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every document."""
    spark.dataSource.register(TokenSource)
    return spark.read.format("rans_ids").option("path", path).load()


def packed(a) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 6)


def unpacked(raw: bytes, kind):
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class TokenSource(DataSource):
    """Options: path; for writing also table (frequencies) and width (bytes of an id)."""

    @classmethod
    def name(cls):
        return "rans_ids"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite):
        return TokenWriter(self.options)


class Written(WriterCommitMessage):
    def __init__(self, part, name, ids, docs):
        self.part, self.name, self.ids, self.docs = part, name, ids, docs


class FileBuilder:
    """One file: ids are coded as soon as ``LOT`` blocks of them are there."""

    def __init__(self, out, table):
        self.out, self.table = out, table
        self.place = self.ids = self.docs = 0
        self.waiting, self.held = [], 0
        self.segments, self.chunks = [], []
        self.names, self.nulls, self.sizes, self.span = [], [], [], 0

    def put(self, raw: bytes):
        self.out.write(raw)
        self.place += len(raw)

    def add(self, names, nulls, sizes, ids):
        self.names += names
        self.nulls += nulls
        self.sizes += sizes
        self.docs += len(names)
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        block = rans.BLOCK * rans.LANES
        if self.held >= LOT * block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // block * block
            for lo in range(0, whole, LOT * block):
                self.code(flat[lo:min(lo + LOT * block, whole)], rans.BLOCK)
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def code(self, flat, steps):
        size = steps * rans.LANES
        full = np.full(-(-len(flat) // size) * size, self.table.pad, dtype=np.uint32)
        full[:len(flat)] = flat
        step = rans.SEGMENT * rans.LANES
        per = -(-size // step)
        for k, (states, words) in enumerate(rans.encode(self.table, full.reshape(-1, steps, rans.LANES))):
            lo = k // per * size + k % per * step
            mine = flat[lo:min(lo + step, (k // per + 1) * size)]
            self.segments.append((self.place, len(words), len(mine), zlib.crc32(mine.astype("<u4"))))
            self.put(states.astype("<u8").tobytes())
            self.put(words.astype("<u4").tobytes())

    def finish(self):
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.uint32)
        block = rans.BLOCK * rans.LANES
        whole = len(flat) // block * block
        if whole:
            self.code(flat[:whole], rans.BLOCK)
        if whole < len(flat):
            self.code(flat[whole:], -(-(len(flat) - whole) // rans.LANES))
        index = packed(np.array(self.segments, dtype="<i8").reshape(-1, 4))
        index_at, chunks, start, lo = self.place, [], 0, 0
        self.put(index)
        ends = np.cumsum(np.array(self.sizes, dtype=np.int64))
        while lo < len(self.sizes):
            hi = int(np.searchsorted(ends, start + SPAN, "right"))
            hi = min(max(hi, lo + 1), lo + DOCS)
            raw = packed(np.array([self.names[lo:hi], self.nulls[lo:hi], self.sizes[lo:hi]], dtype="<i8"))
            chunks.append((self.place, len(raw), start))
            self.put(raw)
            start, lo = int(ends[hi - 1]), hi
        chunk_index, chunks_at = packed(np.array(chunks, dtype="<i8").reshape(-1, 3)), self.place
        self.put(chunk_index)
        self.put(FOOTER.pack(MAGIC, index_at, len(index), chunks_at, len(chunk_index)))


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.width, self.table = options["path"], int(options["width"]), options["table"]

    def write(self, batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rans"
        table = rans.Table(unpacked(bytes.fromhex(self.table), "<u4"))
        where, root = system(self.path)
        out = file = None
        for b in batches:
            if not b.num_rows:
                continue
            if file is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(f"{root}/{name}")
                file = FileBuilder(out, table)
            ids = b.column(1)
            at = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset:ids.offset + len(ids) + 1]
            raw = np.frombuffer(ids.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
            keys = b.column(0)
            file.add(keys.fill_null(0).to_pylist(), keys.is_null().to_pylist(), (np.diff(at) // self.width).tolist(),
                     raw.view(f"<u{self.width}").astype(np.uint32))
        if file is None:
            return Written(part, None, 0, 0)
        file.finish()
        out.close()
        return Written(part, name, file.ids, file.docs)

    def commit(self, messages):
        """The files of the tasks that count, in the order of their documents."""
        where, root = system(self.path)
        where.create_dir(root, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "start": start, "ids": m.ids, "docs": m.docs})
            start += m.ids
        with where.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"table": self.table, "files": files}).encode())

    def abort(self, messages):
        where, root = system(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{root}/{m.name}")


class Split(InputPartition):
    def __init__(self, name, start, lo, hi):
        super().__init__(name)
        self.name, self.start, self.lo, self.hi = name, start, lo, hi


class TokenReader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def manifest(self):
        where, root = system(self.path)
        with where.open_input_file(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())

    def partitions(self):
        found = [Split(f["name"], f["start"], lo, lo + SPLIT) for f in self.manifest()["files"]
                 for lo in range(0, f["ids"], SPLIT)]
        return found or [Split(None, 0, 0, 0)]

    def read(self, split):
        if split.name is None:
            return
        table = rans.Table(unpacked(bytes.fromhex(self.manifest()["table"]), "<u4"))
        where, root = system(self.path)
        with where.open_input_file(f"{root}/{split.name}") as f:
            size = f.size()
            f.seek(size - FOOTER.size)
            magic, index_at, index_n, chunks_at, chunks_n = FOOTER.unpack(f.read(FOOTER.size))
            if magic != MAGIC:
                raise ValueError(f"{split.name} does not end in a footer")

            def at(place, n):
                f.seek(place)
                return f.read(n)

            segments = unpacked(at(index_at, index_n), "<i8").reshape(-1, 4)
            for place, n, first in unpacked(at(chunks_at, chunks_n), "<i8").reshape(-1, 3):
                if split.lo <= first < split.hi:
                    names, nulls, sizes = unpacked(at(int(place), int(n)), "<i8").reshape(3, -1)
                    ids = decoded(at, segments, table, int(first), int(first + sizes.sum()))
                    yield from batches(names, nulls, sizes, ids, split.start + int(first))


def decoded(at, segments, table, lo, hi):
    """Ids lo to hi of a file: the segments that hold them are decoded side by side."""
    ends = np.cumsum(segments[:, 2])
    first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left"))
    mine = segments[first:last + 1]
    width, out = 8 * rans.LANES, [None] * len(mine)
    steps = -(-mine[:, 2] // rans.LANES)
    begin, end = int(mine[0, 0]), int(mine[-1, 0] + width + 4 * mine[-1, 1])
    raw = at(begin, end - begin)
    for s in np.unique(steps):
        rows = np.flatnonzero(steps == s)
        parts = [(np.frombuffer(raw, "<u8", rans.LANES, int(p) - begin), np.frombuffer(raw, "<u4", int(w), int(p) - begin + width))
                 for p, w in mine[rows, :2]]
        for r, ids in zip(rows, rans.decode(table, parts, int(s))):
            ids = ids[:mine[r, 2]].astype("<u4")
            if zlib.crc32(ids) != mine[r, 3]:
                raise ValueError("a segment's checksum does not hold")
            out[r] = ids
    skip = int(ends[first] - segments[first, 2])
    return np.concatenate(out)[lo - skip:hi - skip]


def batches(names, nulls, sizes, ids, start):
    """Arrow batches of up to ``ROWS`` ids, or of one document."""
    import pyarrow as pa
    ends, lo = np.cumsum(sizes), 0
    begin = ends - sizes
    while lo < len(sizes):
        hi = max(int(np.searchsorted(ends, begin[lo] + ROWS, "right")), lo + 1)
        at = np.append(begin[lo:hi], ends[hi - 1]) - begin[lo]
        raw = ids[begin[lo]:ends[hi - 1]]
        rows = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(4 * at), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[lo:hi], pa.int64(), mask=nulls[lo:hi].astype(bool)), pa.array(start + begin[lo:hi]), pa.array(sizes[lo:hi]),
             rows.cast(pa.binary())], names=["id", "start", "n_tokens", "ids"])
        lo = hi
