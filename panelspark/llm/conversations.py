"""Repair of conversations: Wagner-Fischer alignment of the turns to an alternating grammar.

A repaired conversation reads, by first letters of its roles, ``(s?(ua)+)?``. Keeping a
turn costs 0, giving it the role user or assistant 2, deleting it 3, inserting an empty
turn of user or assistant 2; blank and repeated turns have to go, and a truncated turn
that stays adds 1.

Every feasible length of the grammar's string is a target. All strings end alike, so
one table of costs from the end, V[i][r] for the turns from i on and the last r letters
of a string, holds the alignment of every target without system turn; one with a system
turn deletes what precedes that turn and goes on in the same table. A greedy repair
gives an incumbent cost; a cell whose surplus or lack of letters alone costs more than
the incumbent allows cannot lie on a path as cheap (Ukkonen), so the table is a band whose
half width is half of what the incumbent pays beyond the unavoidable. Of the audits
of the cheapest targets the ASCII-least wins: they are traced back side by side from the
front, and those stay that can go on with the least letter. Of a long conversation every ``SPACING``-th
row of the band is kept, the others are computed again where the audit needs them.

A conversation is one record, as a text is: its rows meet in one task, which reads them
in order. Turns of equal pattern share their alignment inside a task.

Defined results: a null role or text counts as one space; null turns come first; equal
turns are ordered by role and text; rows of a null id form a conversation; an id all of
whose rows are gone has zeros and an empty repair; an empty table gives no rows; other
columns are not read.
"""

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .text import SPACES

RENAME, DROP, ADD, CUT_SHORT = 2, 3, 2, 1       # prices
FAR = 1 << 40
SPACING = 256           # rows of a band between those that are kept
CELLS = 1 << 22         # cells of a band that is kept whole
STOPS = ".!?"

# A turn is one letter: its role's first letter (s, u, a, else x), capital if it is cut
# short; "-" is a turn that has to go.


def keepable(codes):
    return sum(c != "-" for c in codes)


def greedy(codes) -> int:
    """Cost of one valid repair, read from the front."""
    cost, need, opened, any_pair = 0, "u", False, False
    left = keepable(codes)
    for c in codes:
        if c == "-":
            cost += DROP
            continue
        left -= 1
        low = c.lower()
        cost += CUT_SHORT * (c != low)
        if low == "s" and not opened and left:
            opened = True
            continue
        opened = True
        if low != need:
            if low in "ua":
                cost += ADD         # the letter between, then keep
                need = low
            else:
                cost += RENAME
        any_pair = True
        need = "a" if need == "u" else "u"
    if any_pair and need == "a":
        cost += ADD
    return cost


class Band:
    """V[i][r] within ``half`` of the letters that the keepable turns from i on would fill."""

    def __init__(self, codes: str, half: int):
        self.codes, self.half, n = codes, half, len(codes)
        self.rest = np.zeros(n + 1, dtype=np.int64)         # keepable turns from i on
        self.rest[:n] = np.cumsum([c != "-" for c in codes[::-1]], dtype=np.int64)[::-1]
        self.step = np.arange(2 * half + 1, dtype=np.int64)
        self.spacing = 1 if (n + 1) * (2 * half + 1) <= CELLS else SPACING
        self.rows, self.block = {}, None
        row = np.where(self.step >= half, ADD * (self.step - half), FAR)
        for i in range(n, -1, -1):
            if i < n:
                row = self.above(i, row)
            if i % self.spacing == 0 or i == n:
                self.rows[i] = row

    def above(self, i, below):
        """Row i from row i + 1."""
        c = self.codes[i]
        if c == "-":
            row = below + DROP
        else:
            low = c.lower()
            letters = self.rest[i] - self.half + self.step
            odd = letters % 2 == 1                          # an odd rest begins with a
            match = np.where(odd, 0 if low == "a" else RENAME, 0 if low == "u" else RENAME) + CUT_SHORT * (c != low)
            row = below + match                             # one letter less on both sides of the band
            row[:-1] = np.minimum(row[:-1], below[1:] + DROP)
            row = np.where(letters > 0, row, np.where(letters == 0, np.append(below[1:], FAR) + DROP, FAR))
        return np.minimum(np.minimum.accumulate(row - ADD * self.step) + ADD * self.step, FAR)

    def row(self, i):
        if i in self.rows:
            return self.rows[i]
        k = i // self.spacing
        if self.block is None or self.block[0] != k:
            hi = min((k + 1) * self.spacing, len(self.codes))
            found = {hi: self.rows[hi]}
            for j in range(hi - 1, k * self.spacing, -1):
                found[j] = self.above(j, found[j + 1])
            self.block = k, found
        return self.block[1][i]

    def cost(self, i, r) -> int:
        at = r - int(self.rest[i]) + self.half
        return int(self.row(i)[at]) if r >= 0 and 0 <= at <= 2 * self.half else FAR

    def costs(self, i, r):
        at = r - self.rest[i] + self.half
        inside = (at >= 0) & (at <= 2 * self.half)
        return np.where(inside, self.row(i)[np.where(inside, at, 0)], FAR)

    def audit(self, targets, here) -> str:
        """The ASCII-least edits of cost ``here`` over targets (system turn to keep or -1, r).

        All targets that are still equal have used the same edits, so they stand at the same
        turn and have the same cost ahead.
        """
        out, i, n = [], 0, len(self.codes)
        while True:
            moves = {}
            for first, r in targets:
                if i < first:
                    moves.setdefault("D", []).append((first, r))
                elif i == first:
                    moves.setdefault("K", []).append((-1, r))
                elif i < n and self.cost(i + 1, r) + DROP == here:
                    moves.setdefault("D", []).append((-1, r))
                elif r and self.cost(i, r - 1) + ADD == here:
                    moves.setdefault("I", []).append((-1, r - 1))
                elif i < n:
                    moves.setdefault("K" if self.codes[i].lower() == ("a" if r % 2 else "u") else "R", []).append((-1, r - 1))
            if not moves:
                return "".join(out)
            edit = min(moves)
            targets = set(moves[edit])
            out.append(edit)
            here -= {"D": DROP, "I": ADD, "K": 0, "R": RENAME}[edit]
            if edit in "KR":
                here -= CUT_SHORT * self.codes[i].isupper()
            i += edit != "I"


def aligned(codes: str):
    """(cost, audit) of the cheapest repair, the ASCII-least of equal ones."""
    whole = keepable(codes)
    unavoidable = DROP * (len(codes) - whole) + CUT_SHORT * sum(c.isupper() for c in codes)
    half = (greedy(codes) - unavoidable) // 2 + 2
    band = Band(codes, half)
    lengths = np.array([r for r in range(max(whole - half, 0), whole + half + 1) if r % 2 == 0])
    found = [(-1, band.costs(0, lengths))]
    for i, c in enumerate(codes):
        if whole - int(band.rest[i]) > half:        # too many turns before it would go
            break
        if c in "sS":       # a system turn is kept, those before it are deleted; two letters at least follow
            cost = DROP * i + CUT_SHORT * (c == "S") + band.costs(i + 1, lengths)
            found.append((i, np.where(lengths > 0, cost, FAR)))
    cheapest = int(min(cost.min() for _, cost in found))
    targets = [(i, int(r)) for i, cost in found for r in lengths[cost == cheapest]]
    return cheapest, band.audit(targets, cheapest)


@lru_cache(maxsize=100_000)
def aligned_short(codes: str):
    return aligned(codes)


def repair(codes: str):
    return aligned_short(codes) if len(codes) <= 64 else aligned(codes)


def coded(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "-"
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return c.upper() if fault == "truncated" else c


def repaired_turns(audit: str, turns):
    """Turns (role, text) of the repaired conversation."""
    out, rows = [], iter(turns)
    for edit in audit:
        need = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((need, ""))
            continue
        role, text = next(rows)
        if edit != "D":
            out.append((role if edit == "K" else need, text))
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after the damage that crc32('conv_id:turn') deals.

    Rows that are dropped stay, marked ``gone``, so that their conversation is not lost.
    """
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    deal = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    d = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), text("role").alias("role"),
                     text("text").alias("text"), deal.alias("deal"))
    body = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("deal") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", role.alias("role"), body.alias("text"), (F.col("deal") == 0).alias("gone"),
                    F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def last_char(text: Column) -> Column:
    """The last character that is not white space; empty without one."""
    return F.right(F.translate(text, SPACES, ""), F.lit(1))


SCHEMA = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, turns array<struct<role:string,text:string>>")


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text, gone): faults, cost, audit and repaired turns."""
    last = last_char(F.col("text"))
    d = turns.withColumns({"blank": last == "", "cut": ~F.contains(F.lit(STOPS), last)})
    d = (d.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
         .select("conv_id", "turn", "role", "text", "gone", "blank", "cut"))

    def run(batches):
        import pyarrow as pa
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        out, size = [], 0
        for row, weight in conversations(batches):
            out.append(row)
            size += weight
            if len(out) >= 1000 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return d.mapInArrow(run, SCHEMA)


def conversations(batches):
    """(result, characters) of each run of equal ids in sorted batches."""
    own, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and r[0] != own:
                yield one(own, rows)
                rows = []
            own = r[0]
            rows.append(r[1:])
    if rows:
        yield one(own, rows)


def one(conv_id, rows):
    rows = [r for r in rows if not r[3]]
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    seen, codes = set(), []
    for _, role, text, _, blank, cut_short in rows:
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if cut_short else ""
        if fault:
            count[fault] += 1
        seen.add((role, text))
        codes.append(coded(role, fault))
    stamps = [r[0] for r in rows if r[0] is not None]
    gaps = max(stamps) - min(stamps) + 1 - len(set(stamps)) if stamps else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = repair("".join(codes))
    turns = repaired_turns(audit, [(r[1], r[2]) for r in rows])
    found = (conv_id, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
             [{"role": a, "text": t} for a, t in turns])
    return found, sum(len(t) for _, t in turns)


def digest(turns: Column) -> Column:
    """SHA-256 of the repaired ``role:text`` lines."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)
