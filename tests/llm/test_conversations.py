"""Conversation repair (op12) against every repair of small conversations."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

from panelspark.llm import conversations as C
from panelspark.llm.queries import QUERIES

sys.setrecursionlimit(20_000)
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(codes):
    """(cost, audit) over all edits, by states of the grammar."""
    @lru_cache(None)
    def go(i, state, added):        # nothing yet, after s, u comes (may end), a comes
        found = [(0, "")] if i == len(codes) and state in (0, 2) else []
        need, then = ("a", 2) if state == 3 else ("u", 3)

        def put(price, edit, rest):
            if rest:
                found.append((price + rest[0], edit + rest[1]))

        if added < 3:
            put(2, "I", go(i, then, added + 1))
        if i < len(codes):
            low = codes[i].lower()
            put(3, "D", go(i + 1, state, 0))
            if low != "-":
                late = codes[i] != low
                if low == "s" and state == 0:
                    put(late, "K", go(i + 1, 1, 0))
                put(late + 2 * (low != need), "K" if low == need else "R", go(i + 1, then, 0))
        return min(found) if found else None
    return go(0, 0, 0)


def want(rows):
    """Plain version of the query for rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        deal = zlib.crc32(key.encode()) % 20
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        if deal:
            own += [(turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            c = role[:1] if role[:1] in tuple("sua") else "x"
            codes += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit = cheapest(codes)
        lines, k, before = [], 0, ""
        for e in audit:
            need = "assistant" if before == "u" else "user"
            if e == "I":
                lines.append(f"{need}:")
                before = need[0]
                continue
            _, role, text = own[k]
            k += 1
            if e != "D":
                role = role if e == "K" else need
                lines.append(f"{role}:{text}")
                before = role[0]
        stamps = {t for t, _, _ in own if t is not None}
        out.append((conv, max(stamps) - min(stamps) + 1 - len(stamps) if stamps else 0, *count.values(),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


FIELDS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def repaired(df):
    r = C.repaired(C.damaged(df)).withColumn("repaired_sha256", C.digest(C.F.col("turns")))
    return sorted((tuple(x[c] for c in FIELDS) for x in r.collect()), key=str)


def test_alignment_against_all_edits():
    rng = random.Random(1)
    for _ in range(4000):
        letters = rng.choice(["sua-xSUAX", "suuaaa-UA", "ua", "su-", "sx-S", "----su", "uauauauas-"])
        codes = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        assert C.aligned(codes) == cheapest(codes), codes


def test_long_alignment_with_few_rows_kept(monkeypatch):
    rng = random.Random(2)
    codes = ["".join("ua"[i % 2] if rng.random() < .85 else rng.choice("-UAsx") for i in range(120)) for _ in range(20)]
    whole = [C.aligned(c) for c in codes]
    assert whole == [cheapest(c) for c in codes]
    monkeypatch.setattr(C, "CELLS", 10)
    monkeypatch.setattr(C, "SPACING", 7)
    assert [C.aligned(c) for c in codes] == whole


def test_conversations(spark, sf):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "\U0001f642"]
    texts = ["Fine.", "Cut short", " ", None, "", "Same!", "Same!", "a ", "x.\n\t", "?", "é."]
    rows = [(c if c % 50 else None, rng.choice([None, *range(9)]), rng.choice(roles[:2] if c % 3 else roles), rng.choice(texts))
            for c in range(300) for _ in range(rng.randint(1, 8))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cost string")
    assert repaired(df.repartition(5)) == want(rows)
    gone = [(c, 0, "user", "Hi.") for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repaired(spark.createDataFrame(gone, SCHEMA))
    assert got == want(gone) and {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark.createDataFrame([], SCHEMA)) == []
    hot = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}" + "." * (t % 5 > 0)) for t in range(600)] + [(2, 1, "user", "z" * 200_000)]
    assert repaired(spark.createDataFrame(hot, SCHEMA)) == want(hot)
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = sorted((tuple(r[c] for c in FIELDS) for r in QUERIES["op12_conversation_repair"](spark, sf).collect()), key=str)
    assert got == want(given)


def test_repaired_turns_follow_the_grammar(spark, sf):
    for r in C.repaired(C.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.turns))
