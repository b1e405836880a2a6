"""URL verdicts, WARC archives, license scans and the pipeline."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from panelspark.llm import licenses, urls, warc
from panelspark.llm.queries import QUERIES
from tests.llm import plain

URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q#f", "http://example.com/en/", "http://example.com/en",
        "http://b.example.com/en/z", "http://net/es/", "x://a.net/fr/9?x", "http://notnet/fr/1", None, "", "no scheme",
        "http://", "http://h#frag/en/", "http://u:p@Host:80/p//q", "a://b://c/d", "http://long.net/" + "p" * 50_000,
        "http://x.com", "http://ü.com/é"]


def want_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(plain.LOWER)
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, verdict2 string")
    got = urls.judged(df, urls.labelled_names(spark)).collect()
    for r in got:
        host, path, rule, verdict = want_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert len(got) == len(URLS)
    empty = df.limit(0)
    assert urls.judged(empty, urls.labelled_names(spark)).count() == 0
    none = urls.judged(df, urls.labelled_names(spark).limit(0)).filter("rule is null").collect()
    assert {r.verdict for r in none} == {"allow"}


def test_url_model_on_held_out_names(spark):
    """Trained without every fourth name, it tells the others' kind on new hosts."""
    bad = [n for i, n in enumerate(urls.BLOCKED)]
    model = urls.fit(urls.labelled_names(spark))
    held = ([(f"{a}-{b}.example.org", "/en/5", True) for a, b in zip(bad, bad[3:] + bad[:3])]
            + [(f"{a}{b}.example.net", "/fr/77", False) for a, b in zip(urls.ALLOWED[::2], urls.ALLOWED[1::2])])
    df = spark.createDataFrame(held, "host string, path string, bad boolean")
    w = urls.F.array(*[urls.F.lit(float(x)) for x in model[0]])
    got = df.withColumn("m", urls.margin(urls.features(), w, urls.F.lit(model[1])) > 0).collect()
    assert sum(r.m == r.bad for r in got) >= 0.9 * len(got)


def test_warc_round_trip(spark, sf, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "u\r\nx", ""), (4, "u", None),
            (5, "http://a/5", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "é", "é" * 100_000),
            (None, "http://n", "only"), (7, "http://a/7", "tail\r\n\r\n"), (8, "r", "rep"), (8, "r", "rep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write(df.repartition(3), path, compression=compression)
        got = sorted((tuple(r) for r in warc.pages_of(warc.read(spark, path)).collect()), key=str)
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            top = max((x for x, _, y in rows if (y or "") == (h or "")), key=lambda x: -1 if x is None else x)
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                         "response" if i == top else "revisit", None if i == top else top))
        assert got == sorted(want, key=str)
    everything = warc.read(spark, path)
    assert [bytes(r.payload).decode() for r in everything.filter("record_id = '<urn:page:5>'").collect()] == [rows[5][2]]
    only = everything.filter("warc_type = 'revisit' and target_uri like 'http://a/%'")
    assert sorted(r.target_uri for r in only.collect()) == ["http://a/1", "http://a/2"]
    assert "ArrowEvalPython" not in only._jdf.queryExecution().toString()
    assert {r.payload for r in warc.read(spark, path, payload=False).collect()} == {None}
    big = str(tmp_path / "big")
    warc.write(df, big, at_least=5)
    assert warc.read(spark, big).filter("warc_type = 'revisit'").count() == 0
    none = str(tmp_path / "none")
    warc.write(df.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_warc_predicates_skip_payloads():
    head = "WARC/1.1\r\nWARC-Type: {}\r\nX: a\r\n b\r\nContent-Length: {}\r\n\r\n"
    body = b"z" * 50
    raw = b"".join(head.format(t, 50).encode() + body + b"\r\n\r\n" for t in ("request", "response", "metadata"))
    import io

    class Count(io.BytesIO):
        pass

    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("content_length",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    got = list(warc.parse(io.BufferedReader(Count(raw)), reader.meets, True, "x"))
    assert [(r["warc_type"], r["payload"]) for r in got] == [("response", body)]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(raw[:-20]), lambda h: True, True, "x"))
    two = gzip.compress(raw) + gzip.compress(raw)      # a member per record is usual
    assert len(list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(two)), reader.meets, True, "x"))) == 2


def naive_align(a, b, a0=0, b0=0):
    """Patience alignment written by recursion over slices, with a quadratic longest run."""
    if not a or not b:
        return []
    ca, cb = Counter(a), Counter(b)
    pairs = sorted((a.index(w), b.index(w)) for w in ca if ca[w] == 1 and cb[w] == 1)
    if not pairs:
        out, lo = [], 0
        while lo < min(len(a), len(b)) and a[lo] == b[lo]:
            out.append((a0 + lo, b0 + lo))
            lo += 1
        k = 0
        while k < min(len(a), len(b)) - lo and a[-1 - k] == b[-1 - k]:
            out.append((a0 + len(a) - 1 - k, b0 + len(b) - 1 - k))
            k += 1
        return sorted(out)
    best = [1] * len(pairs)
    for x in range(len(pairs)):
        for y in range(x):
            if pairs[y][1] < pairs[x][1]:
                best[x] = max(best[x], best[y] + 1)
    return max(best), len(pairs)


def test_patience_alignment():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 14))]
        b = [rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 14))]
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        want = naive_align(a, b)
        if isinstance(want, tuple):
            assert len(got) >= want[0]
        else:
            assert got == want
        assert licenses.align(a, a) == [(i, i) for i in range(len(a))]


def test_license_scan(spark, sf):
    mit, line = licenses.TEMPLATES["MIT"], "Released under the MIT License."
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    filler = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, line), (2, f"{filler} {line} {filler} {line.upper()}"), (3, f"{filler}\n{cut}"), (4, filler), (5, None),
            (6, ""), (7, "the under license mit released"), (8, mit), (8, mit)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")
    got = {}
    for r in licenses.scanned(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.n_matches, r.coverage))
    assert got[1] == [("MIT-line", 1, 1.0)] and got[2] == [("MIT-line", 2, 1.0)]
    assert got[3][0][0] == "MIT" and 0.85 < got[3][0][2] < 1
    assert [got[k][0][0] for k in (4, 5, 6, 7)] == [None] * 4 and len(got[8]) == 2
    assert licenses.scanned(df.limit(0)).count() == 0
    # on the table: every text with a whole notice line is found
    from panelspark.sources.readers import table
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    found = {r.doc_id: r for r in QUERIES["op9_license_scans"](spark, sf).collect()}
    ready = licenses.prepared(licenses.TEMPLATES)
    for i, t in docs.items():
        w = licenses.words(t or "")
        holds = [n for n, (x, _) in ready.items() if any(w[k:k + len(x)] == x for k in range(len(w) - len(x) + 1))]
        assert (found[i].license is not None) >= bool(holds), i


def every_start(text, name):
    """Matches of one template: an alignment from every word that may start one, best first.

    Words inside a verbatim notice start none.
    """
    t, w = licenses.words(licenses.TEMPLATES[name]), licenses.words(text)
    need = -(-int(licenses.COVERAGE * 1000) * len(t) // 1000)
    width, found = max(len(t) + 2, int(len(t) * licenses.SLACK)), []
    done = -1
    for lo in range(len(w)):
        if lo > done and w[lo:lo + len(t)] == t:
            done = lo + len(t) - 1
        elif lo <= done:
            continue
        if w[lo] in t[:len(t) - need + 1]:
            got = licenses.align(w[lo:lo + width], t)
            if len(got) >= need:
                found.append((len(got), lo + got[0][0], lo + got[-1][0]))
    out = []
    for n, a, z in sorted(found, key=lambda m: (-m[0], m[2] - m[1], m[1])):
        if all(z < b or y < a for _, b, y in out):
            out.append((n, a, z))
    return sorted(out)


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0", "ISC", "MIT-line", "Reserved-line"])
def test_stray_words_hide_no_notice(name):
    """Layouts of pieces of a notice, other words and whole notices: each whole one is found whole."""
    t = licenses.words(licenses.TEMPLATES[name])
    ready = licenses.prepared({name: licenses.TEMPLATES[name]})
    rng = random.Random(name)
    for case in range(25):
        w, whole = [], []
        for _ in range(rng.randint(1, 3)):
            kind = rng.randrange(3)
            if kind == 0:
                w += t[int(len(t) * rng.uniform(0.4, 0.95)):]
            elif kind == 1:
                w += t[:int(len(t) * rng.uniform(0.1, 0.7))]
            else:
                w += [x for x in t if rng.random() < 0.85]
            w += [rng.choice(["other", "words", *t]) for _ in range(rng.randint(0, len(t)))]
            whole.append((len(w), len(w) + len(t) - 1))
            w += t
        text = " ".join(w)
        got = licenses.matches(text, ready)
        assert sorted((n, a, z) for _, _, n, a, z in got) == every_start(text, name), (name, case)
        full = {(a, z) for _, c, _, a, z in got if c == 1}
        assert full >= set(whole), (name, case)
    a, z = 3000, 3000 + len(t) - 1
    filler = [f"w{i}" for i in range(3000)]
    assert [m[1:] for m in licenses.matches(" ".join(filler + t + filler * 20), ready)] == [(1.0, len(t), a, z)]


def test_license_ties_and_long_texts():
    """Two templates of the same words: the first name is best; a long run of notices is found in full."""
    same = licenses.prepared({"b": "one two three four", "a": "One two, three four!"})
    assert [m[0] for m in licenses.matches("x one two three four x", same)] == ["a", "b"]
    got = licenses.matches(" ".join([licenses.TEMPLATES["MIT"]] * 400), licenses.prepared({"MIT": licenses.TEMPLATES["MIT"]}))
    assert len(got) == 400 and {m[1] for m in got} == {1.0}


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    import corpus_pipeline as cp
    from collections import defaultdict
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    held = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        held.append(([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]))
        assert k == 4 or docs.columns == before.columns
    a, b = held[0]
    assert {r["doc_id"] for r in b} <= {r["doc_id"] for r in a if not plain.quality_counts(r["text"])[5]}
    gone = {r["doc_id"] for r in a} - {r["doc_id"] for r in b}
    base = {r["doc_id"] for r in a if plain.quality_counts(r["text"])[5]}
    assert base <= gone and sum(labels.get(i) == 1 for i in gone - base) <= 0.02 * len(a)
    a, b = held[1]
    assert {r["doc_id"] for r in b} == {i for i, _, _, kept, _ in plain.copies([(r["doc_id"], r["text"]) for r in a]) if kept}
    a, b = held[2]
    assert {r["doc_id"] for r in b} == {c for _, _, c in plain.jaccard_classes([(r["doc_id"], r["text"]) for r in a])}
    a, b = held[3]
    size = defaultdict(int)
    for r in a:
        size[r["source"]] += len(plain.words(r["text"]))
    got = defaultdict(int)
    for r in b:
        got[r["source"]] += len(plain.words(r["text"]))
    assert all(abs(got[s] - t) <= 1 for s, t in plain.mix_targets(size).items())
    whole = {r["doc_id"]: r["text"] for r in a}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in b)
    assert max(Counter(r["doc_id"] for r in b).values()) <= 2
    a, b = held[4]
    from tokenizers import Tokenizer
    from panelspark.llm.queries import vocabulary
    lib = Tokenizer.from_file(vocabulary())
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in a)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in b) == want


def test_pipeline_leaves_the_stages_and_no_frames_they_cut(spark, sf, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from panelspark.llm.text import cut
    from panelspark.sources import store

    def halved(spark, docs, sf_dir):
        return cut(cut(docs).filter("doc_id % 2 = 0"))

    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(cp, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(cp, "STAGES", [("first", halved), ("second", halved)])
    got = sorted(r.doc_id for r in cp.run(spark, sf).select("doc_id").collect())
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert got == sorted(i for i in ids if i % 2 == 0)
    [root] = tmp_path.iterdir()     # neither frames nor their folders
    assert sorted(p.name for p in root.iterdir()) == ["0-first", "1-second"]

    def fails(spark, docs, sf_dir):
        cut(docs)
        raise ValueError("stage")

    monkeypatch.setattr(cp, "STAGES", [("fails", fails)])
    with pytest.raises(ValueError, match="stage"):
        cp.run(spark, sf)
    assert list(tmp_path.iterdir()) == [root]       # also of a stage that fails


def test_quality_cuts_only_texts_that_may_stay(spark, sf, monkeypatch):
    from panelspark.llm import quality
    held = []
    monkeypatch.setattr(quality, "cut", lambda df: held.append(store_cut(df)) or held[-1])
    from panelspark.llm.text import cut as store_cut
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.filtered(docs, labels)
    rows = held[0].selectExpr("base_failed", "row is null as gone").distinct().collect()
    assert {tuple(r) for r in rows} == {(True, True), (False, False)}
    assert all(f.endswith(".zstd.parquet") for f in held[0].inputFiles())
    ids = {r.doc_id for r in quality.judged(docs, labels).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids
