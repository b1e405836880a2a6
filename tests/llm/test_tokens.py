"""Token files (op13) and alignment of two tokenizers (op11) against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import align, rans, tokenfile, units
from panelspark.llm.queries import QUERIES, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BITS = [" ", "  ", "\n", "\t", " ", "　", "a", "the", "Thing", ".", "!", "'s", "é", "é", "日", "▁", "<|endoftext|>",
        "<|ENDOFTEXT|>", "<s>", "7", "42", "\x0b", " ", "x", "ß", "🙂", "\x85", "​", "\r\n", "-", "<0x41>", "\x00", "ÀÉ",
        "don't", "a.b", "A,", "x"]


def scraps(n, seed):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))) for k in range(n)]


@pytest.fixture(scope="module")
def word_lib():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary())
    lib.no_truncation()
    lib.no_padding()
    return lib


def want_files(rows, lib):
    """[(id, start, n, crc)] in ascending order of ids; rows of equal ids are interchangeable."""
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def files_of(spark, df, path):
    tokenfile.write(df, str(path), vocabulary())
    return sorted((tuple(r) for r in tokenfile.read(spark, str(path)).selectExpr("id", "start", "n_tokens", "crc32(ids) c").collect()),
                  key=lambda r: r[1])


def test_token_files_match_the_library(spark, sf, tmp_path, edge, edge_rows, nothing, word_lib):
    rows = scraps(2000, 5)
    got = files_of(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), tmp_path / "a")
    assert got == want_files(rows, word_lib)
    got = files_of(spark, edge, tmp_path / "b")
    want = want_files([(r[0], r[1]) for r in edge_rows], word_lib)
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), n, c) for i, _, n, c in want)
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1]]
    assert [i for i, *_ in got] == [i for i, *_ in want]
    assert files_of(spark, nothing, tmp_path / "c") == []
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op13_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert got == want_files([tuple(r) for r in docs], word_lib)


def test_files_are_read_in_parts(spark, tmp_path, monkeypatch, word_lib):
    """Chunks, splits and Arrow batches smaller than a document, and blocks that documents cross."""
    monkeypatch.setattr(tokenfile, "SPLIT", 5000)
    rng = random.Random(2)
    ids = [np.array([rng.randrange(300) ** 2 for _ in range(n)], dtype=np.uint32) for n in (1, 70_000, 3, 16_384, 16_383, 140_000, 2, 1)]
    table = rans.Table.of(np.bincount(np.concatenate(ids), minlength=90_000))
    path = tmp_path / "x.rans"
    with open(path, "wb") as out:
        monkeypatch.setattr(tokenfile, "DOCS", 2)
        monkeypatch.setattr(tokenfile, "SPAN", 20_000)
        monkeypatch.setattr(tokenfile, "LOT", 1)
        f = tokenfile.FileBuilder(out, table)
        for k, x in enumerate(ids):
            f.add([k], [k == 3], [len(x)], x)
        f.finish()
    w = tokenfile.TokenWriter({"path": str(tmp_path), "width": "4", "table": tokenfile.packed(table.freq.astype("<u4")).hex()})
    w.commit([None, tokenfile.Written(1, "x.rans", f.ids, f.docs)])
    reader = tokenfile.TokenReader(str(tmp_path))
    splits = reader.partitions()
    assert len(splits) > 10
    got = [r for s in splits for b in reader.read(s) for r in zip(*(c.to_pylist() for c in b.columns))]
    at = np.cumsum([0] + [len(x) for x in ids])
    assert got == [(None if k == 3 else k, at[k], len(x), x.astype("<u4").tobytes()) for k, x in enumerate(ids)]
    raw = bytearray(path.read_bytes())
    raw[700] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="segment"):
        [b for s in reader.partitions() for b in reader.read(s)]


def test_coder_gets_close_to_the_entropy():
    rng = np.random.default_rng(0)
    x = np.minimum(rng.zipf(1.4, 4 * 65_536), 49_000).astype(np.uint32)
    counts = np.bincount(x, minlength=49_408)
    table = rans.Table.of(counts)
    assert table.freq.sum() == 1 << table.bits and ((table.freq > 0) == (counts > 0)).all()
    parts = rans.encode(table, x.reshape(4, rans.BLOCK, rans.LANES))
    assert (rans.decode(table, parts, rans.SEGMENT).ravel() == x).all()
    p = counts[counts > 0] / len(x)
    bits = 32 * sum(len(w) for _, w in parts)
    assert bits < 1.01 * len(x) * -(p * np.log2(p)).sum()
    with pytest.raises(ValueError):
        rans.encode(table, np.full((1, 1, rans.LANES), int(np.flatnonzero(counts == 0)[0])))
    one = rans.Table.of([0, 5])
    assert (rans.decode(one, rans.encode(one, np.ones((1, 2, rans.LANES), dtype=np.uint32)), 2) == 1).all()


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    ta = Tokenizer.from_file(vocabulary(A))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    ba, bb = align.byte_tokens(ta), align.piece_tokens(tb)
    docs, count = [], Counter()
    for i, t in rows:
        t = t or ""
        ia, ib, raw = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t), (" " + t).encode()
        if not t or b"".join(ba[x] for x in ia) != raw or b"".join(bb[x] for x in ib) != raw:
            docs.append((i, [], [], [], []))
            continue
        ends = [dict(zip(np.cumsum([len(v[x]) for x in ids]).tolist(), range(len(ids)))) for v, ids in ((ba, ia), (bb, ib))]
        groups, links, lo = [], [], (0, 0)
        for e in sorted(set(ends[0]) & set(ends[1])):
            hi = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ia[lo[0]:hi[0]])) + "|" + ",".join(map(str, ib[lo[1]:hi[1]])))
            links.append((ia[hi[0] - 1], ib[hi[1] - 1]))
            lo = hi
        count.update(links)
        docs.append((i, ia, ib, groups, links))
    top = defaultdict(int)
    for (_, b), c in count.items():
        top[b] = max(top[b], c)
    return [(i, len(ia), len(ib), len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if ia else "") for i, ia, ib, g, links in docs]


FIELDS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def alignment_of(df, **more):
    rows = align.aligned(df, vocabulary(A), vocabulary(B), **more).collect()
    return rows, sorted((tuple(r[c] for c in FIELDS) for r in rows), key=str)


def test_alignment(spark, sf, edge, edge_rows, nothing):
    rows = scraps(1500, 7) + [(None, None), (None, ""), (9, "one"), (9, "one"), (10, " "), (11, "a "), (12, "7" * 3000)]
    found, got = alignment_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert got == sorted(plain_alignment(rows), key=str)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in found)
    _, got = alignment_of(edge, groups=False)
    assert got == sorted(plain_alignment([(r[0], r[1]) for r in edge_rows]), key=str)
    assert alignment_of(nothing)[1] == []
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r[c] for c in FIELDS) for r in QUERIES["op11_token_alignment"](spark, sf).collect()), key=str)
    assert got == sorted(plain_alignment(docs), key=str)


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 100_000):
        keys = rng.choice(1 << 31, n, replace=False)
        h = align.PerfectHash(keys)
        assert sorted(h(keys).tolist()) == list(range(n))
        assert (h.key_at[h(keys)] == keys).all()
    with pytest.raises(ValueError):
        h(np.array([(1 << 31) + 5]))
    with pytest.raises(ValueError):
        align.PerfectHash(np.array([4, 4]))
    p = align.pair(vocabulary(A), vocabulary(B))
    assert len(p.keys) <= p.bound() < 1_000_000


def test_units_start_anew_and_tell_long_ones_by_bytes():
    met = []
    u = units.Units(met.extend, met.clear, limit=64)
    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}" for _ in range(3000)] + ["y" * 300, "y" * 301, "y" * 300]
    got = []
    for k in range(0, len(words), 50):
        data = np.frombuffer(" ".join(words[k:k + 50]).encode(), dtype=np.uint8)
        starts, ends = units.word_spans(data, np.array([0, len(data)]))
        for _, _, numbers in u.slices(data, starts, ends):
            got += [met[n].decode() for n in numbers]
    assert got == words
