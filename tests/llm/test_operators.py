"""Operators against plain versions, on edge cases and on the smallest tables."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelspark.llm import bpe, dedup, mixing, ngram_join, pii, quality, sharding
from panelspark.llm.queries import QUERIES, SQL, vocabulary
from tests.llm import plain
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, sf, name):
    msg = compare(QUERIES[name](spark, sf), connect(sf), SQL[name])
    # no payload repeats in the smallest pages
    assert msg in ("", "ALL-NULL columns ['refers_to']" if name.startswith("op8_") else ""), msg


def test_ngram_join(spark, sf, docs, edge, edge_rows, nothing):
    got = rows_of(QUERIES["op1_ngram_join"](spark, sf), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes([(d["doc_id"], d["text"]) for d in docs]), key=str)
    got = rows_of(ngram_join.linked(edge), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes([r[:2] for r in edge_rows]), key=str)
    assert ngram_join.linked(nothing).count() == 0
    kept = ngram_join.one_per_class(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in plain.jaccard_classes([r[:2] for r in edge_rows])} | {None}


@pytest.mark.parametrize("limit", [0, 16])
def test_ngram_boundary_changes_no_result(spark, monkeypatch, limit):
    texts = [" ".join(f"a{j}" for j in range(n)) for n in range(4, 26)]
    texts += [t.replace("a0", "b") for t in texts] + [t + " c" for t in texts] + [" ".join(t.split()[2:]) for t in texts]
    rows = list(enumerate(texts))
    monkeypatch.setattr(ngram_join, "boundary", lambda *a: limit)
    got = rows_of(ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes(rows), key=str)


@pytest.mark.parametrize("easy", [0, 8])
def test_ngram_hot_lists(spark, monkeypatch, easy):
    """Texts that share most of a common passage, and drifting near copies."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "EASY", easy)
    passage = " ".join(f"p{j}" for j in range(60))
    texts = [f"{passage} " + " ".join(f"o{k}_{j}" for j in range(k % 30)) for k in range(120)]
    drift = [f"d{j}" for j in range(100)]
    for k in range(60):
        drift = drift[:]
        drift[(k * 37) % 100] = f"n{k}"
        texts.append(" ".join(drift))
    rows = list(enumerate(texts))
    got = rows_of(ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes(rows), key=str)


def family(n, k):
    """n texts of 90 words of which half are their own, the others in k passages."""
    return [" ".join([f"c{i % k}_{j}" for j in range(45)] + [f"o{i // 2}_{j}" for j in range(45 + i % 2)]) for i in range(n)]


def test_ngram_keys_that_sets_share_are_told_apart(spark, monkeypatch):
    """With first keys of four bits nearly all sets share theirs, and take the second sum."""
    monkeypatch.setattr(ngram_join, "KEY_BITS", 4)
    texts = family(60, 3) + [" ".join(f"a{j}" for j in range(n)) for n in range(3, 20)]
    rows = list(enumerate(texts + texts[:5]))
    got = rows_of(ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes(rows), key=str)


def test_parity_bits_never_exceed_the_difference():
    import random
    import numpy as np
    from panelspark.llm import shingles
    draw = random.Random(5)
    for _ in range(200):
        pool = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(5, 400))]
        other = pool[:]
        for _ in range(draw.randrange(0, 12)):
            other[draw.randrange(len(other))] = "new"
        a, b = shingles.sets_of([" ".join(pool), " ".join(other)])
        apart = len(np.setxor1d(a, b))
        far = sum(bin(int(x) & (2 ** 64 - 1)).count("1") for x in ngram_join.parities(a) ^ ngram_join.parities(b))
        assert far <= apart and (far - apart) % 2 == 0


def test_ngram_passages_without_links_leave_no_pairs(spark, monkeypatch):
    """Texts that share half their words meet in lists, and their parity bits part them."""
    made = []
    cross = ngram_join.cross_pairs
    monkeypatch.setattr(ngram_join, "cross_pairs", lambda *a: made.append(cross(*a)) or made[-1])
    rows = list(enumerate(family(120, 2)))
    got = rows_of(ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes(rows), key=str)
    assert made and sum(d.count() for d in made) == 0       # lists meet, no pair is left


@pytest.mark.parametrize("hard", [0, ngram_join.HARD])
def test_ngram_near_pivots_change_no_result_and_run_where_pairs_cost_more(spark, monkeypatch, hard):
    """Few pairs of classes that pivots cannot part go to the last join at once."""
    turns = []
    near = ngram_join.near_pairs
    monkeypatch.setattr(ngram_join, "near_pairs", lambda *a: turns.append(a[-1]) or near(*a))
    monkeypatch.setattr(ngram_join, "EASY", 0)
    monkeypatch.setattr(ngram_join, "HARD", hard)
    rows = list(enumerate(family(120, 2)))
    got = rows_of(ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_classes(rows), key=str)
    assert turns == ([] if hard else [1, 3])


def test_boundary_follows_cost():
    sizes = {n: 100 for n in range(1, 30)}
    low, high = ngram_join.boundary(sizes, 0.0), ngram_join.boundary(sizes, 500.0)
    assert 0 < low < high <= ngram_join.MOST_LIGHT
    for a in range(1, 60):
        for b in ngram_join.partners(a):
            assert ngram_join.overlap(a, b) == min(o for o in range(0, a + b + 1) if 100 * o >= 80 * (a + b - o))


def test_mixing(spark, sf, edge, edge_rows, nothing):
    rows = mixing.taken(edge).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in edge_rows:
        sizes[s] += len(plain.words(t))
    want = plain.mix_targets(sizes)
    by_source = {round(t, 3): s for s, t in want.items()}
    assert len(rows) == len(edge_rows)
    got = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[by_source[round(r.target, 3)]]
        got[by_source[round(r.target, 3)]] += r.taken
    assert all(abs(got[s] - t) <= 1 for s, t in want.items())
    assert rows_of(mixing.taken(edge), "doc_id", "taken") == rows_of(mixing.taken(edge), "doc_id", "taken")
    assert mixing.taken(nothing).count() == 0 and mixing.sampled(nothing).count() == 0
    d = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.sampled(d)
    assert mix.columns == d.columns
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(plain.words(r.text))
    plan = {r.source: r.target for r in mixing.targets(mixing.sizes(d).groupBy("source").agg({"size": "sum"})
                                                       .withColumnRenamed("sum(size)", "source_size")).collect()}
    assert all(abs(words[s] - t) <= 1 for s, t in plan.items())
    # every shard of the tree holds an equal share of the drawn blocks of any source
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 400)], "source string, quota bigint")
    leaves = mixing.splitting_tree(quotas, 6).collect()
    assert sorted(Counter({s: sum(x.quota for x in leaves if x.shard == s) for s in range(6)}.values())) in ([239, 240], [239])
    assert {s: sum(x.quota for x in leaves if x.source == s) for s in ("a", "b", None)} == {"a": 1000, "b": 37, None: 400}


def test_bpe(spark, sf, docs, edge, edge_rows, nothing):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary())

    def want(t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out = lib.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()

    got = rows_of(QUERIES["op3_bpe"](spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((d["doc_id"], *want(d["text"])) for d in docs), key=str)
    full = bpe.encoded(edge, vocabulary())
    assert full.columns[:len(edge.columns)] == edge.columns
    got = rows_of(full, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((r[0], *want(r[1])) for r in edge_rows), key=str)
    ids = {r.doc_id: list(r.ids) for r in full.filter("doc_id = 20").collect()}
    assert ids[20] == lib.encode(next(r[1] for r in edge_rows if r[0] == 20), add_special_tokens=False).ids
    assert bpe.encoded(nothing, vocabulary()).count() == 0


def test_bpe_tree_joins_exactly(monkeypatch):
    import random
    monkeypatch.setattr(bpe, "PIECE", 40)
    monkeypatch.setattr(bpe, "WINDOW", 4)
    c, rnd = bpe.Codec(vocabulary()), random.Random(5)
    for k in range(800):
        chars = "abcdeeetthinson's!?12" if k % 2 else "aeinths'é́ß!?|\t　한ᄒ"
        s = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 300)))
        want = c.lib.encode(s, add_special_tokens=False).ids
        assert [i for i, _, _ in c.tree(s, 40)] == want
        assert c.encode(s)[0] == array("I", want).tobytes()


def test_bpe_joins_pieces_over_tasks(spark, monkeypatch):
    """Runs without a space, with special tokens at every place of a cut, from pieces encoded apart."""
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary())
    monkeypatch.setattr(bpe, "PIECE", 50)
    special = "<|endoftext|>"
    texts = ["thesone" * 8 + "x" * k + special + "inthe" * 30 + " a b " + "q" * (40 + k) for k in range(16)]
    texts += ["line\nend." * 40, "é" * 333, "\t" * 120 + "a" * 90 + "\n" * 70, special * 20, "한ᄒ" * 60]
    got = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"),
                                            vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(got[i].ids) == ids, i
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_encodes_a_run_once(monkeypatch):
    """Joins look at windows only: a run of 2 MB is not encoded again."""
    c, seen = bpe.Codec(vocabulary()), []
    run = "".join(f"{k * 7919 % 1000003:x}" for k in range(400_000))
    parts = [(lo, c.table(run[lo:lo + bpe.PIECE])) for lo in range(0, len(run), bpe.PIECE)]
    table = bpe.Codec.triples
    monkeypatch.setattr(bpe.Codec, "triples", lambda self, t: seen.append(len(t)) or table(self, t))
    monkeypatch.setattr(bpe.Codec, "table", lambda self, t: seen.append(len(t)) or None)
    assert c.joined(run, parts, len(run))[:, 0].tolist() == c.lib.encode(run, add_special_tokens=False).ids
    assert sum(seen) < len(run) // 20


def test_pii(spark, sf, docs, edge, edge_rows, nothing):
    def base(t):
        s = plain.base_spans(t)
        text = ",".join(f"{k}:{a}:{e}" for a, _, e, k in s)
        return (*(sum(x[3] == k for x in s) for k in plain.PII), hashlib.sha256(text.encode()).hexdigest())

    cols = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert rows_of(QUERIES["op4_pii"](spark, sf), *cols) == sorted(((d["doc_id"], *base(d["text"])) for d in docs), key=str)
    got = rows_of(pii.found(edge).selectExpr("doc_id", "n_email", "n_ip", "n_card", "n_phone"), *cols[:5])
    assert got == sorted(((r[0], *base(r[1])[:4]) for r in edge_rows), key=str)
    assert pii.found(nothing).count() == 0


def test_pii_terms_that_reveal(spark):
    """A nickname that only stands beside one person's address is marked; common words are not."""
    filler = [f"common words appear in every text number {i}" for i in range(40)]
    told = [f"the Zorro wrote again from jo@x.example.org about thing{i} today" for i in range(4)]
    rows = list(enumerate(filler + told + ["the Zorro without any address", "other ann@x.example.org once"]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(x.s, x.e, x.o) for x in r.spans] for r in pii.found(df, least=0.7).collect()}
    for i in range(40, 44):
        text = dict(rows)[i]
        terms = {text[a:e] for a, e, o in got[i] if o == 4}
        assert "Zorro" in terms and "thing0" not in terms and "the" in terms | {"the"}
        assert not terms & {"thing1", "thing2", "thing3"}
    assert got[44] == [] and all(got[i] == [] for i in range(40)) and len(got[45]) == 1
    clean = {r.doc_id: r.text for r in pii.sanitised(df, least=0.7).collect()}
    assert clean[0] == filler[0] and "[EMAIL]" in clean[40] and "Zorro" not in clean[40] and "jo@x" not in clean[40]


def test_sharding(spark, sf, docs, edge, edge_rows, nothing, tmp_path):
    for df, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), [(d["doc_id"], d["text"]) for d in docs]),
                     (edge, [r[:2] for r in edge_rows])):
        got = sharding.assigned(df).collect()
        raw = [(i, (t or "").encode()) for i, t in rows]
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
            ((i, len(b) + 1, zlib.crc32(b)) for i, b in raw), key=str)
        per = defaultdict(list)
        for r in got:
            per[r.shard].append(r)
        n = [len(per[s]) for s in range(16)]
        assert max(n) - min(n) <= 1
        assert all(sorted(r.slot for r in per[s]) == list(range(len(per[s]))) for s in per)
        order = [r.h for s in range(16) for r in sorted(per[s], key=lambda r: r.slot)]
        assert order == sorted(order)
    assert sharding.assigned(nothing).count() == 0
    # neighbours on the curve are neighbours in space, and the index is a bijection
    grid = spark.range(512).selectExpr("cast(id % 8 as int) a", "cast(id div 8 % 8 as int) b", "cast(id div 64 as int) c")
    at = {r.h: (r.a, r.b, r.c) for r in grid.withColumn("h", sharding.hilbert([grid.a, grid.b, grid.c], 3)).collect()}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(at[k], at[k + 1])) == 1 for k in range(511))
    # files cover small boxes: a filter on any dimension meets a part of them only
    out = str(tmp_path / "shards")
    sharding.write(spark.read.parquet(f"{sf}/documents.parquet"), out)
    import glob
    files = [pq.read_table(f).to_pydict() for f in glob.glob(f"{out}/*.parquet")]
    assert sum(len(f["doc_id"]) for f in files) == len(docs) and len(files) > 4
    met = sum(min(f["source"]) <= "src3" <= max(f["source"]) for f in files)
    assert met < len(files)


def test_levels_are_monotone(spark):
    df = spark.range(1, 5000).selectExpr("id * id * id as n")
    got = [r.l for r in df.orderBy("n").withColumn("l", sharding.size_level(df.n)).collect()]
    assert got == sorted(got) and max(got) < 512


def test_quality(spark, sf, docs, edge, edge_rows, nothing):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = rows_of(quality.judged(edge, labels), *cols)
    assert got == sorted(((r[0], *plain.quality_counts(r[1])) for r in edge_rows), key=str)
    assert quality.judged(nothing, labels).count() == 0
    kept = quality.filtered(edge, labels)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} <= {r[0] for r in edge_rows if not plain.quality_counts(r[1])[5]}


def test_quality_cutoffs_hold_their_bound(spark):
    """k* against the binomial law, and the cutoff against the order statistic."""
    from math import comb
    for n, tests in ((100, 1), (3000, 6), (10_000, 24)):
        k = spark.range(1).select(quality.allowed(quality.F.lit(n).cast("bigint"), quality.F.lit(tests), 0.01, 0.05)).first()[0]
        cdf, want = 0.0, -1
        for j in range(n):
            cdf += comb(n, j) * 0.01 ** j * 0.99 ** (n - j)
            if cdf > 0.05 / tests:
                break
            want = j
        assert k == want, (n, tests)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(60)) + " #" * (i % 50), "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id bigint, quality int, toxic int")
    j = quality.judged(docs, labels, alpha=0.05)
    out = j.filter("not kept").count()
    assert 0 < out <= 0.05 * 2000 * len(quality.RULES)
    worst = j.groupBy().agg(*[quality.F.sum((quality.F.col(f"v_{r}") > quality.F.col(f"c_{r}")).cast("int")).alias(r)
                              for r in quality.RULES]).first()
    assert all(worst[r] is None or worst[r] <= 0.05 * 2000 for r in quality.RULES)


@pytest.mark.parametrize("heavy", [1, 256])
def test_exact_dedup(spark, edge, edge_rows, nothing, heavy):
    rows = [r[:2] for r in edge_rows]
    got = rows_of(dedup.copy_groups(edge, heavy=heavy), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(plain.copies(rows), key=str)
    kept = dedup.keep_one(edge, heavy=heavy)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, _, k, _ in plain.copies(rows) if k), key=str)
    assert dedup.copy_groups(nothing).count() == 0 and dedup.keep_one(nothing).count() == 0


def dealt_plainly(rows, shards, seed, block):
    """{(doc, pass): (shard, place, taken)} of rows (doc, source, size), without Spark."""
    import numpy as np
    streams = defaultdict(list)
    for d, s, n in sorted(rows, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        streams[s].append((d, sum(x[2] for x in streams[s]), n))
    order = sorted(streams, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[2] for x in streams[s]) for s in order}
    target = plain.mix_targets(size)
    drawn, blocks = [], defaultdict(set)
    for s in order:
        want = int(target[s] + 0.5)
        for k in range(-(-want // size[s])):
            for d, at, n in streams[s]:
                got = min(n, max(0, want - k * size[s] - at))
                if got:
                    drawn.append((s, k, at // block, d, got))
                    blocks[s].add((k, at // block))
    name = {s: [] if s is None else [s] for s in order}
    for s in order:
        blocks[s] = sorted(blocks[s], key=lambda b: hashlib.md5(":".join([f"block{seed}", *name[s], *map(str, b)]).encode()).hexdigest())

    def split(lo, hi, quota):
        if hi - lo <= 1:
            return {lo: quota}
        mid = lo + (hi - lo + 1) // 2
        take, rest = sum(quota.values()) * (mid - lo) // (hi - lo), sum(quota.values())
        rng, go = np.random.default_rng([seed, lo, hi]), {}
        for s in order:
            rest -= quota[s]
            go[s] = (0 if take <= 0 or quota[s] <= 0 else min(quota[s], take) if rest <= 0
                     else int(rng.hypergeometric(quota[s], rest, take)))
            take -= go[s]
        return {**split(lo, mid, go), **split(mid, hi, {s: quota[s] - go[s] for s in order})}

    leaves, at = split(0, shards, {s: len(blocks[s]) for s in order}), {}
    for s in order:
        k = 0
        for shard in range(shards):
            for place in range(1, leaves[shard][s] + 1):
                at[s, blocks[s][k]] = (shard, place)
                k += 1
    return {(d, k): (*at[s, (k, b)], got) for s, k, b, d, got in drawn}


def test_mixing_tree_decides_shards(spark, monkeypatch):
    """Shard, place and words of every copy equal a plain tree, and follow its seed."""
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(1, 30)) for i in range(300)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id bigint, source string, text string")
    seen = []
    for seed in (0, 5):
        drawn = mixing.mixed(mixing.sizes(df), 6, seed=seed)[1]
        got = {(r.doc_id, r["pass"]): (r.shard, r.place, r.taken) for r in drawn.collect()}
        assert got == dealt_plainly(rows, 6, seed, 40)
        seen.append(got)
    assert seen[0] != seen[1]
    # without leaves nothing is drawn
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, *_: q.select("source", F.lit(0).alias("shard"), "quota").limit(0))
    assert {r.taken for r in mixing.taken(df).collect()} == {0}
