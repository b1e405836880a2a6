"""Shards along a Hilbert curve over source, language and size.

Each dimension is quantised to ``BITS`` bits by a monotone rule (leading bytes after the
common prefix for names, exponent and leading bits for sizes), the curve index orders
the rows, and the order is cut into runs whose row counts differ by at most one. Rows
that are near in all dimensions share a shard, so file statistics prune on any of them.

The global rank needs no global sort: counts per curve cell are summed on three levels
(coarse cells, at most 4096; cells and hash parts inside one coarse cell; rows inside
one part), so no task holds more than one hash part of one cell.

Defined results: null text has size 1 and checksum 0; null names sort first; rows equal
in id, size and checksum are counted before the shuffle and take consecutive slots; an
empty table gives no rows. Extra columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import cut, let, packed, whole

BITS = 9
SHARDS = 16
PARTS = 64
COARSE = 15         # bits of the index inside a coarse cell: 2 ** (27 - 15) coarse cells


def size_level(n: Column) -> Column:
    """Exponent and the three bits below it: monotone, below 512 for any bigint."""
    e = F.length(F.bin(n)) - 1
    return F.when(n < 8, n.cast("int")).otherwise(
        ((e - 2) * 8 + F.expr("0") + (F.call_function("shiftright", n, e - 3) % 8)).cast("int"))


def name_code(c: Column, skip: Column) -> Column:
    """The three bytes after the first ``skip`` characters as a number; shorter ones are padded."""
    tail = F.hex(F.encode(F.coalesce(F.substring(c, skip + 1, F.lit(3)), F.lit("")), "utf-8"))
    return F.conv(F.rpad(F.substring(tail, 1, 6), 6, "0"), 16, 10).cast("bigint")


def common_prefix(low: Column, high: Column) -> Column:
    """Length of the common prefix of the least and the greatest name, so of all names."""
    chars = F.arrays_zip(F.split(low, "").alias("a"), F.split(high, "").alias("b"))
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct(
        (acc["n"] + F.when(acc["on"] & (x["a"] == x["b"]) & (x["a"] != ""), 1).otherwise(0)).alias("n"),
        (acc["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).alias("on")))["n"]


def hilbert(levels: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates (Skilling's transpose form)."""
    n = len(levels)

    def put(x, i, value):
        return F.transform(x, lambda v, j: F.when(j == i, value).otherwise(v))

    def undo(x, s):
        q, i = s["q"], s["i"]
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        t = (first.bitwiseXOR(own)).bitwiseAND(q - 1)
        flip = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v))
        swap = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(t)).otherwise(v))
        return F.when(own.bitwiseAND(q) != 0, flip).otherwise(F.when(i == 0, x).otherwise(swap))

    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)])

    def grey(x):
        def add(i):     # a lambda with a default would take it as the element's index
            return lambda a: put(a, i, F.get(a, F.lit(i)).bitwiseXOR(F.get(a, F.lit(i - 1))))

        for i in range(1, n):
            x = let(x, add(i))
        return x

    def tail(x):
        last = F.get(x, F.lit(n - 1))
        t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0),
                        lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return let(t, lambda v: F.transform(x, lambda a: a.bitwiseXOR(v)))

    def woven(x):
        places = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                           for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, s: acc * 2 + F.when(
            F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in levels]), undo)
    return let(let(grey(x), tail), woven)


def with_index(docs: DataFrame) -> DataFrame:
    """Adds the curve index ``h`` to rows with source, lang and size."""
    ends = docs.agg(*[f(c).alias(f"{c}_{k}") for c in ("source", "lang") for k, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.select(*[F.struct(
        F.coalesce(common_prefix(F.col(f"{c}_lo"), F.col(f"{c}_hi")), F.lit(0)).alias("skip"),
        F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")).alias(c) for c in ("source", "lang")]).first()
    levels = []
    for c in ("source", "lang"):
        skip = F.lit(ends[c].skip)
        lo, hi = name_code(F.lit(ends[c].lo), skip), name_code(F.lit(ends[c].hi), skip)
        level = ((name_code(F.col(c), skip) - lo) * ((1 << BITS) - 1) / F.greatest(hi - lo, F.lit(1))).cast("int")
        levels.append(F.greatest(F.lit(0), F.when(F.col(c).isNull(), 0).otherwise(level)))
    return docs.withColumn("h", hilbert([*levels, size_level(F.col("size"))], BITS))


def measured(docs: DataFrame) -> DataFrame:
    t = whole("text")
    return docs.select("doc_id", "source", "lang", (F.octet_length(t) + 1).cast("bigint").alias("size"),
                       F.crc32(F.encode(t, "utf-8")).alias("text_crc32"))


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, h, shard, slot."""
    rows = cut(with_index(cut(measured(docs))).groupBy("h", "doc_id", "size", "text_crc32")
               .agg(F.count(F.lit(1)).alias("m"))
               .withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int")))
    parts = (rows.groupBy("h", "part").agg(F.sum("m").alias("c"))
             .withColumn("coarse", F.call_function("shiftright", F.col("h"), F.lit(COARSE))))
    coarse = parts.groupBy("coarse").agg(F.sum("c").alias("c"))
    before = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)    # at most 4096 rows
    coarse = coarse.select("coarse", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("coarse_start"),
                           F.sum("c").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("coarse").orderBy("h", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    parts = (parts.join(F.broadcast(coarse), "coarse")
             .select("h", "part", (F.col("start") + F.col("coarse_start")).alias("start"), "total"))
    own = (Window.partitionBy("h", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
           .rowsBetween(Window.unboundedPreceding, -1))
    ranked = rows.withColumn("within", F.coalesce(F.sum("m").over(own), F.lit(0))).join(parts, ["h", "part"])
    ranked = ranked.withColumn("rank", F.explode(F.expr(
        "sequence(start + within, start + within + m - 1)")))
    n = int(shards)
    return (ranked.withColumn("shard", F.expr(f"cast(rank * {n} div total as int)"))
            .withColumn("slot", F.expr(f"rank - (shard * total + {n - 1}) div {n}"))
            .select("doc_id", "size", "text_crc32", "h", "shard", "slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes whole rows as about ``shards`` parquet files, each one run of the curve."""
    t = packed(docs, "source", "lang").withColumn("size", F.octet_length(whole(F.col("row.text"))) + 1)
    (with_index(t.withColumn("size", F.col("size").cast("bigint"))).repartitionByRange(shards, "h")
     .sortWithinPartitions("h").select("row.*").write.mode("overwrite").parquet(path))
