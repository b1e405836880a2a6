"""Jaccard self-join of word 5-gram sets: size-aware, light sets by subsets, heavy by lists.

Sets A and B link when 100 |A n B| >= 80 |A u B|, that is |A n B| >= c(a, b), the least
integer not below 4 (a + b) / 9. Equal sets are joined first, so one set stands for all
its copies.

* Light sets (up to a size chosen by cost) enumerate, for every size b that may link
  with their own a, all subsets of c(a, b) shingles. Two sets of these sizes link
  exactly if they share one, so whoever meets under (a, b, subset) is linked: the
  members of a bucket are joined to its least member of the other size and no pair is
  looked at. A subset's key is the 128-bit sum of its shingles' digests.
* Heavy sets go through inverted lists. Under one order of all shingles, rare ones
  first, two linked sets share ``SHARED`` (or all c of a link) among their first places:
  place i of a set of size a counts only for partners up to
  floor(9 (a - i - 1 + SHARED) / 4) - a, which is stored with each entry. Of two entries
  that meet, one is early (its place admits partners of its own size), so lists without
  an early entry are dropped and late entries never meet each other. The order comes from a sketch of ``BUCKETS`` counters over all documents; any
  order gives the same links.
* Candidates are not all pairs of a list: only pairs of different classes of sets already
  linked count. While long lists hold many of them, every set tests those ``PIVOTS`` sets
  that it meets most among a few pivots of each list (the least by as many hashes, so
  lists agree on them); a family of near copies becomes one class with a few tests for
  each member. The lists in which different classes still meet then give all their pairs
  across classes. No link between classes is lost, and a family of near copies costs its
  size and not its square.
* Two entries only make a pair if the parity bits of their sets allow a link: every shingle
  flips one of 64 ``WORDS`` bits of its set, so two sets that differ in d shingles differ in at
  most d bits, and a link allows d = n + m - 2 c(n, m). Lists of texts that share passages
  and do not link are looked at inside their join and leave it as few pairs.
* The boundary is the size with the least expected cost, from the histogram of sizes
  and the mean list length that the sketch implies (as far as pivots leave it).

Sets are known by a 64-bit sum of digests, which is checked: a second sum tells keys that
different sets share (about three among 10^10 sets), and their sets take another key. So two
sets are only confused when both sums agree, 128 bits.

Defined results: null text, or one without words, has an empty set and is linked with
nothing; fewer than five words are one shingle; repeated rows are in one class; null
ids are ignored by the least id (a class of null ids only has none, and rows with null
ids are not dropped by ``one_per_class``); an empty table gives no rows.
"""

import itertools
import zlib
from math import comb

from pyspark.sql import DataFrame, functions as F

from .components import components
from .text import cut, packed, small

BUCKETS = 1 << 20
CHUNK = 1 << 12         # counters in one row of the sketch
MOST_LIGHT = 24         # sizes up to which the cost of subsets is looked at
HOT = 10_000            # a shingle that more documents hold is kept out of single-task lists
SHARED = 10             # first shingles that a candidate pair must share
PIVOTS = 6              # pivots of a list, and partners that a set tests in a round
EASY = 8                # pairs across classes for each entry that are looked at without pivots
WORDS = 8               # longs of parity bits of a set
NEAR = 2                # rounds of near pivots at most
HARD = 2 * WORDS * PIVOTS   # pairs across classes for each entry from which they cost more than near pivots
BITS = [f"b{i}" for i in range(WORDS)]
KEY_BITS = 64           # bits of a set's first key


def overlap(a: int, b: int) -> int:
    """c(a, b): common shingles that a link needs."""
    return -(-4 * (a + b) // 9)


def partners(a: int):
    """Sizes that may link with size a."""
    return range(-(-4 * a // 5), 5 * a // 4 + 1)


def prefix(a: int) -> int:
    """Places that can be among the first ``SHARED`` common shingles of a link."""
    return min(a, a - -(-4 * a // 5) + SHARED)


def subset_count(a: int, limit: int) -> int:
    return sum(comb(a, overlap(a, b)) for b in partners(a) if b <= limit)


def boundary(histogram: dict, mean_list: float) -> int:
    """The size up to which sets enumerate subsets: least total expected cost.

    An entry of a list costs a look at the others of a short list; in a long one pivots
    bound it by ``EASY``.
    """
    entry = 1 + min(mean_list, EASY)

    def cost(x):
        light = sum(n * subset_count(a, x) for a, n in histogram.items() if a <= x)
        # sets that may meet larger ones are in the lists too
        return light + sum(n * prefix(a) * entry for a, n in histogram.items() if 5 * a // 4 > x)

    return min(range(0, MOST_LIGHT + 1), key=cost)


def keyed(s, bits: int, taken=frozenset()) -> int:
    """The key of a set; ``taken`` are first keys that different sets have."""
    from . import shingles
    key = shingles.total(s, 1)
    if bits < 64:
        key %= 1 << bits
    return shingles.total(s, 5) if key in taken else key


def parities(s):
    """One row of ``WORDS`` longs: bit i is set when an odd number of shingles falls on i."""
    import numpy as np
    at = (s >> np.uint64(40)).astype(np.int64) % (64 * WORDS)
    odd = np.bincount(at, minlength=64 * WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def surveyed(rows: DataFrame):
    """(sets, sketch rows) in one reading: sets (id, n, key, key2, bits, s), s only up to MOST_LIGHT."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from . import shingles
        counts = np.zeros(BUCKETS, dtype=np.int32)
        names = ["id", "n", "key", "key2", *BITS, "s", "chunk", "counts"]
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                ids = b.column("id").slice(lo, 512)
                sets = shingles.sets_of(b.column("t").slice(lo, 512).to_pylist())
                places = (np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64)
                counts += np.bincount(places, minlength=BUCKETS).astype(np.int32)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([keyed(s, KEY_BITS) for s in sets], pa.int64()),
                    pa.array([shingles.total(s, 5) for s in sets], pa.int64()), *map(pa.array, np.array([parities(s) for s in sets]).T),
                    pa.array([s.astype(np.int64) if len(s) <= MOST_LIGHT else None for s in sets], pa.list_(pa.int64())),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for i in range(0, BUCKETS, CHUNK):
            part = counts[i:i + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([
                    *[pa.nulls(1, pa.int64()) for _ in names[:-3]], pa.nulls(1, pa.list_(pa.int64())),
                    pa.array([i // CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)

    both = cut(rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["id", "n", "key", "key2", *BITS]) + ", s array<bigint>, chunk int, counts binary"))
    return both.filter("chunk is null").drop("chunk", "counts"), both.filter("chunk is not null").select("chunk", "counts")


def told_apart(sets: DataFrame):
    """(sets without key2, first keys that different sets share).

    Such keys come by chance, n^2 / 2^65 of n sets, so they fit the driver. Their sets take
    the second sum as key; if that is not free either, the query stops.
    """
    def clashes(d):
        per = d.groupBy("key").agg(F.min("key2").alias("a"), F.max("key2").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"))
        return per.filter("a <> b or c <> d").select("key")

    shared = frozenset(r.key for r in clashes(sets).collect())
    if not shared:
        return sets.drop("key2"), shared
    again = sets.withColumn("key", F.when(F.col("key").isin(*shared), F.col("key2")).otherwise(F.col("key")))
    if not clashes(again).isEmpty():
        raise RuntimeError("two different sets share both sums of their digests")
    return cut(again.drop("key2")), shared


def sketch(parts: DataFrame):
    """(counters as bytes, their sum, their sum of squares): a fixed 8 MB, whatever the input."""
    def add(key, table):
        import numpy as np
        import pyarrow as pa
        s = np.zeros(CHUNK, dtype=np.int64)
        for c in table.column("counts"):
            s += np.frombuffer(zlib.decompress(c.as_py()), dtype=np.int32)
        f = s.astype(float)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([s.tobytes()], pa.binary()),
                         "n": pa.array([float(f.sum())]), "sq": pa.array([float((f * f).sum())])})

    out, n, sq, width = bytearray(8 * BUCKETS), 0.0, 0.0, 8 * CHUNK
    for r in parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary, n double, sq double").collect():
        out[r.chunk * width:(r.chunk + 1) * width] = r.counts
        n, sq = n + r.n, sq + r.sq
    return bytes(out), n, sq


def listed(rows: DataFrame, counts, limit: int, taken=frozenset()) -> DataFrame:
    """Entries (x, key, n, most, hot) of the inverted lists: the first places of each set.

    ``taken`` are first keys that different sets share.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    names = ["x", "key", "n", "most", "hot"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from . import shingles
        counts = np.frombuffer(shared.value, dtype=np.int64)
        seen = set()        # copies inside a task are listed once
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cols = [[] for _ in names]
                for s in shingles.sets_of(batch.column("t").slice(lo, 256).to_pylist()):
                    n = len(s)
                    if 5 * n // 4 <= limit:
                        continue
                    key = keyed(s, KEY_BITS, taken)
                    if key in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    p = prefix(n)
                    c = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    first = np.lexsort((s, c))[:p]
                    most = 9 * (n - np.arange(p) - 1 + SHARED) // 4 - n
                    for col, v in zip(cols, (s[first].astype(np.int64), np.full(p, key), np.full(p, n), most,
                                             c[first] > HOT)):
                        col.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)

    return rows.select("t").mapInArrow(run, "x bigint, key bigint, n bigint, most bigint, hot boolean")


def subsets(sets: DataFrame, limit: int) -> DataFrame:
    """Entries (key, n, lo, hi, x, y) of the buckets: the subsets of each light set."""
    names = ["key", "n", "lo", "hi", "x", "y"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from . import shingles
        wrap = 1 << 64

        def signed(v):
            v %= wrap
            return v - wrap if v >= wrap // 2 else v

        for batch in batches:
            out = [[] for _ in names]
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("s").to_pylist()):
                with np.errstate(over="ignore"):
                    s = np.array(ids, dtype=np.int64).astype(np.uint64)
                    a, b = (shingles.mix(s + shingles.mix(np.uint64(k))).tolist() for k in (3, 4))
                n, ta, tb = len(ids), sum(a), sum(b)
                for m in partners(n):
                    if m > limit:
                        continue
                    for gone in itertools.combinations(range(n), n - overlap(n, m)):
                        row = (key, n, min(n, m), max(n, m), signed(ta - sum(a[i] for i in gone)),
                               signed(tb - sum(b[i] for i in gone)))
                        for c, v in zip(out, row):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    light = sets.filter(f"n between 1 and {int(limit)}").select("key", "s").dropDuplicates(["key"])
    return light.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def light_links(subsets: DataFrame) -> DataFrame:
    """Links of the subset buckets: everyone to the bucket's least set of the other size."""
    d = cut(subsets)
    on = ["lo", "hi", "x", "y"]
    least = d.groupBy(*on).agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("key"))).alias("a"),
                               F.min(F.when(F.col("n") == F.col("hi"), F.col("key"))).alias("b"),
                               F.count(F.lit(1)).alias("c"))
    least = least.filter("a is not null and b is not null and c > 1")
    return (d.join(least, on).select(F.col("key").alias("u"), F.when(F.col("n") == F.col("lo"), F.col("b"))
                                     .otherwise(F.col("a")).alias("v")).filter("u <> v").distinct())


def shared_lists(entries: DataFrame) -> DataFrame:
    """(key, n, places): per set its entries (x, most, m, hot) in lists that another set shares.

    Lists of the same sets become one list x that stands for ``m`` of them: near copies
    share whole passages, and their lists would give the same pairs over and over. A set's
    entry keeps its greatest ``most``, so no pair is lost and the test of pairs decides.
    Hot lists are kept whole and as they are. The others have at most ``HOT`` entries (the
    sketch never counts too few), so a window may hold one.
    """
    from pyspark.sql import Window
    # hot lists are not gathered; both windows share one column, else each would shuffle
    entries = entries.withColumn("own", F.when(F.col("hot"), F.col("key")))
    w = Window.partitionBy("x", "own")
    # a copy listed by several tasks repeats its entries
    e = entries.withColumn("again", F.lag("key").over(w.orderBy("key")).eqNullSafe(F.col("key"))).filter("not again")
    e = e.withColumns({"lo": F.min("key").over(w), "hi": F.max("key").over(w), "c": F.count(F.lit(1)).over(w),
                       "early": F.max(F.col("most") >= F.col("n")).over(w),
                       "s1": F.bit_xor(F.xxhash64("key", F.lit(1))).over(w), "s2": F.bit_xor(F.xxhash64("key", F.lit(2))).over(w)})
    e = e.filter("hot or (lo <> hi and early)")
    e = e.withColumn("x", F.when(F.col("hot"), F.col("x")).otherwise(F.xxhash64("s1", "s2", "c")))
    e = e.groupBy("x", "key", "n", "hot").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("m"))
    return e.groupBy("key", "n").agg(F.collect_list(F.struct("x", "most", "m", "hot")).alias("places"))


def read_sets(rows: DataFrame, sets: DataFrame, wanted: DataFrame, taken=frozenset()) -> DataFrame:
    """(key, s) of the wanted keys, read again from one document of each key.

    Nothing but keys and ids is shuffled; documents of equal ids may give a row twice.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from . import shingles
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                found = shingles.sets_of(b.column("t").slice(lo, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    pa.array([keyed(s, KEY_BITS, taken) for s in found], pa.int64()),
                    pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], names=["key", "s"])

    one = sets.join(small(wanted, 200_000), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    ids = cut(one.select("id").distinct())
    # null ids are not told apart by the join, so their rows are all read
    chosen = rows.join(small(ids, 200_000), "id", "left_semi").select("t").union(rows.filter("id is null").select("t"))
    return chosen.mapInArrow(run, "key bigint, s array<bigint>").join(small(wanted, 200_000), "key", "left_semi")


def tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that link."""
    left = sets.select(F.col("key").alias("u"), F.col("s").alias("su")).hint("merge")
    right = sets.select(F.col("key").alias("v"), F.col("s").alias("sv")).hint("merge")
    d = pairs.select("u", "v").join(left, "u").join(right, "v")
    d = d.withColumn("o", F.size(F.array_intersect("su", "sv")).cast("bigint"))
    return d.filter("100 * o >= 80 * (size(su) + size(sv) - o)").select("u", "v").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(id, n, key, comp) for rows (id, t): comp is the key of the class."""
    sets, parts = surveyed(rows)
    sets, taken = told_apart(sets)
    counts, total, squares = sketch(parts)
    sizes = {r.n: r.c for r in sets.filter(f"n between 1 and {2 * MOST_LIGHT}").groupBy("n")
             .agg(F.count(F.lit(1)).alias("c")).collect()}
    total = max(total, 1.0)
    mean_list = 1 + max((squares - total * total / BUCKETS) / total - 1, 0.0)      # less what chance puts together
    limit = boundary(sizes, mean_list)
    lists = cut(shared_lists(listed(rows, counts, limit, taken)))
    links = cut(light_links(subsets(sets, limit))) if limit else None
    labels = components(links) if links is not None else None
    before, near = float("inf"), 0
    while True:
        at, entries, across = meeting(lists, labels)
        if not across:
            break
        # pivots go on while they at least halve what is left, then near ones while pairs cost more
        stuck, before = bool(near) or 2 * across > before, across
        last = across <= EASY * entries or stuck and (near == NEAR or across <= HARD * entries)
        if last:
            pairs = cut(cross_pairs(at, sets))
        elif stuck:
            pairs, near = cut(near_pairs(at, sets, 1 + 2 * near)), near + 1
        else:
            pairs = cut(pivot_pairs(at))
        asked = cut(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct())
        found = cut(tested(pairs, cut(read_sets(rows, sets, asked, taken))))
        if not found.isEmpty():
            links = cut(links.union(found)) if links is not None else found
            labels = components(links)
        if last:
            break
    return with_class(sets.select("id", "n", "key"), labels)


def with_class(sets: DataFrame, labels) -> DataFrame:
    if labels is None:
        return sets.withColumn("comp", F.col("key"))
    found = labels.select(F.col("node").alias("key"), F.col("comp").alias("found"))
    return (sets.join(found.hint("merge"), "key", "left")
            .withColumn("comp", F.coalesce("found", "key")).drop("found"))


def meeting(lists: DataFrame, labels):
    """(entries of lists in which classes meet, their number, pairs across classes)."""
    at = with_class(lists, labels).select("key", "n", "comp", F.explode("places").alias("e")).select(
        "e.x", "key", "n", "e.most", "e.m", "e.hot", "comp")
    # early entries e meet early and late entries l: pairs of a list, less those inside classes
    one = F.col("most") >= F.col("n")
    per = at.groupBy("x", "comp").agg(F.count_if(one).cast("double").alias("e"), F.count_if(~one).cast("double").alias("l"))
    per = per.groupBy("x").agg(F.sum("e").alias("e"), F.sum("l").alias("l"),
                               F.sum(F.col("e") * F.col("e") / 2 + F.col("e") * F.col("l")).alias("own"))
    per = per.withColumns({"c": F.col("e") + F.col("l"),
                           "across": F.col("e") * F.col("e") / 2 + F.col("e") * F.col("l") - F.col("own")}).filter("across > 0")
    at = cut(at.join(per.select("x", "across", "c").hint("merge"), "x"))
    # every entry carries its list's totals, so one aggregate counts lists by their entries
    sums = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("across") / F.col("c")).alias("pairs")).first()
    return at.drop("across", "c"), sums.n, float(sums.pairs or 0)


def needed(n, m):
    """First shingles that linked sets of these sizes share at least."""
    return F.least(F.lit(SHARED), F.ceil(4 * (n + m) / 9))


def fits():
    """Entries p and q of one list may belong to linked sets."""
    return (F.col("p.most") >= F.col("q.n")) & (F.col("q.most") >= F.col("p.n"))


def met(pairs: DataFrame) -> DataFrame:
    """(u, v, c) of the pairs that share enough entries."""
    return (pairs.groupBy(F.col("p.key").alias("u"), F.col("q.key").alias("v"))
            .agg(F.sum("w").alias("c"), F.first("p.n").alias("n"), F.first("q.n").alias("m"))
            .filter(F.col("c") >= needed(F.col("n"), F.col("m"))).select("u", "v", "c"))


def near_pairs(at: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """(u, v): every set with the pivots that it meets most among entries with some of its parity bits.

    A family of near copies has its sets about equally far from each other, so that the few pivots
    of a list mostly miss those that an outlying set is linked to. Sets that agree in a whole band
    of 64 parity bits are likely near; a list is parted by each of 2 * ``WORDS`` bands (the longs,
    and halves of two of them, ``turn`` apart) and every part has its own pivots.
    """
    bits = sets.select("key", *BITS).dropDuplicates(["key"])
    low = (1 << 32) - 1
    own = [F.col(b) for b in BITS] if turn == 1 else [
        F.col(b).bitwiseAND(low).bitwiseOR(F.col(BITS[(i + turn - 1) % WORDS]).bitwiseAND(~low)) for i, b in enumerate(BITS)]
    mixed = [F.col(b).bitwiseAND(low).bitwiseOR(F.col(BITS[(i + turn) % WORDS]).bitwiseAND(~low)) for i, b in enumerate(BITS)]
    bands = F.array(*[F.xxhash64(F.lit(i), b) for i, b in enumerate(own + mixed)])
    bits = bits.select("key", bands.alias("bands"))
    at = at.join(bits.hint("merge"), "key").withColumn("band", F.explode("bands")).drop("bands")
    return pivot_pairs(at, "x", "band")


def pivot_pairs(at: DataFrame, *by: str) -> DataFrame:
    """(u, v): every set with the pivots of other classes that it meets most, in lists or in parts of them."""
    from pyspark.sql import Window

    def pivot(i):
        return F.min(F.when(F.col("most") >= F.col("n"), F.struct(
            F.xxhash64("key", F.lit(i)).alias("r"), "key", "n", "most", "comp")))

    by = list(by or ["x"])
    names = [f"q{i}" for i in range(PIVOTS)]
    w = Window.partitionBy(*by)         # at most HOT entries
    cold = at.filter("not hot").withColumns({q: pivot(i).over(w) for i, q in enumerate(names)})
    hot = at.filter("hot")
    hot = hot.join(hot.groupBy(*by).agg(*[pivot(i).alias(q) for i, q in enumerate(names)]).hint("merge"), by)
    own = F.filter(F.array_distinct(F.array(*names)), lambda q: (q["comp"] != F.col("comp")) & (q["n"] <= F.col("most"))
                   & (F.col("n") <= q["most"]))
    d = cold.unionByName(hot).select("key", "n", F.transform(own, lambda q: F.struct(
        q["key"].alias("key"), q["n"].alias("n"), F.col("m").alias("m"))).alias("qs"))
    # a set has as many rows as places, so its pivots are counted inside its own row
    d = d.groupBy("key", "n").agg(F.flatten(F.collect_list("qs")).alias("qs"))
    names = F.array_distinct(F.transform("qs", lambda q: F.struct(q["key"].alias("key"), q["n"].alias("n"))))
    counted = F.transform(names, lambda q: F.struct(
        F.aggregate(F.filter("qs", lambda x: x["key"] == q["key"]), F.lit(0).cast("bigint"), lambda c, x: c + x["m"]).alias("c"),
        q["key"].alias("v"), q["n"].alias("size")))
    top = F.slice(F.sort_array(F.filter(counted, lambda q: q["c"] >= needed(F.col("n"), q["size"])), False), 1, PIVOTS)
    d = d.select(F.col("key").alias("u"), F.explode(top).alias("q"))
    return d.select(F.least("u", "q.v").alias("u"), F.greatest("u", "q.v").alias("v")).distinct()


def alike():
    """The parity bits of entries p and q allow a link: sets that differ in d shingles differ in at most d bits."""
    far = sum((F.bit_count(F.col(f"p.{b}").bitwiseXOR(F.col(f"q.{b}"))) for b in BITS), F.lit(0))
    both = F.col("p.n") + F.col("q.n")
    return far <= both - 2 * F.ceil(4 * both / 9)


def cross_pairs(at: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different classes that meet often enough and whose parity bits allow a link."""
    bits = sets.select("key", *BITS).dropDuplicates(["key"])
    at = at.join(bits.hint("merge"), "key")
    early, other = at.filter("most >= n").alias("p"), at.alias("q").hint("merge")
    late = F.col("q.most") < F.col("q.n")
    d = early.join(other, F.col("p.x") == F.col("q.x")).filter(
        (late | (F.col("p.key") < F.col("q.key"))) & (F.col("p.comp") != F.col("q.comp"))).filter(fits() & alike())
    d = d.select(F.col("p.m").alias("w"), *[F.when(F.col("p.key") < F.col("q.key"), F.struct("p.key", "p.n")).otherwise(F.struct("q.key", "q.n")).alias("p"),
                   F.when(F.col("p.key") < F.col("q.key"), F.struct("q.key", "q.n")).otherwise(F.struct("p.key", "p.n")).alias("q")])
    return met(d).select("u", "v")


def linked(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    c = cut(classes(rows))
    full = c.filter("n > 0")
    least = full.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = full.join(least, "comp").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    empty = c.filter("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                                     F.col("id").alias("component_id"))
    return out.unionByName(empty)


def one_per_class(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with the least id of their class, with all their columns."""
    chosen = linked(docs, id_col, text_col).filter("doc_id <=> component_id").select(F.col("doc_id").alias("keep")).distinct()
    d = packed(docs, id_col).withColumnRenamed(id_col, "own")
    return d.join(chosen, F.col("own").eqNullSafe(F.col("keep")), "left_semi").select("row.*")
