"""Mixing sources to target weights with exact block quotas.

Targets are words per source: shares of a budget by weight, none above twice the
source's size, the excess shared again. Every source is a stream of its documents in a
seeded order, cut into blocks of ``BLOCK`` words; a document belongs to the block where
it starts. Whole passes draw every block; the rest of the target draws the blocks up to
an exact word of the stream, whose document is taken in part. So the words taken meet
the target to a word, and no document is taken more than twice.

The drawn blocks are dealt over the output shards by a splitting tree: each node halves
its shards and draws how many blocks of each source go left from the multivariate
hypergeometric law, seeded by its place, so every shard holds an equal number of blocks
in random proportions and the leaves partition the exact quotas. Inside a source the
blocks are permuted, and each leaf draws the next blocks of that order by its quota: what
no leaf draws is not in the mix. Rows are shuffled inside their shard.

Offsets are prefix sums on two levels (hash parts of a source, rows of a part), so a
source of any size is spread over ``PARTS`` tasks.

Defined results: null text has size 0 and is never taken; null sources form one source
that sorts last; rows with equal ids and texts are placed next to each other and share
the taken words by place; an empty table gives no rows. Reruns agree.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .text import SPACES, cut, packed, small, whole, words

WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2.0
BLOCK = 4096
SHARDS = 16
PARTS = 256


def sizes(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """(doc_id, source, size, key): key is the seeded order of the stream."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    F.size(words(whole(text_col))).cast("bigint").alias("size"))
    return d.withColumn("key", F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string"))))


def targets(per_source: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """Adds weight and target to (source, source_size): one row per source.

    A source is capped when its share of what the sources before it (by cap over weight)
    leave is above its cap; the others share the rest by weight. One window over sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    d = per_source.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    d = d.withColumn("most", F.col("source_size") * float(cap))
    tight = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = tight.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    d = d.withColumns({"all": F.sum("source_size").over(everything) * float(budget),
                       "spent": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
                       "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
                       "weights": F.sum("weight").over(everything)})
    d = d.withColumn("capped", (F.col("all") - F.col("spent")) * F.col("weight")
                     >= F.col("most") * (F.col("weights") - F.col("gone")))
    full = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    rest = F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    return d.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("most")).otherwise(
        (F.col("all") - full) * F.col("weight") / F.when(rest > 0, rest)).alias("target"))


def placed(sized: DataFrame) -> DataFrame:
    """Adds ``at``, the first word of each row in its source's stream."""
    d = sized.withColumn("part", F.substring("key", 1, 2))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("c"))
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s2"), F.col("part").alias("p2"),
                         F.coalesce(F.sum("c").over(w), F.lit(0)).alias("start"))
    own = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.join(parts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    return d.withColumn("at", F.col("start") + F.col("inside")).drop("s2", "p2", "part", "start", "inside")


def draws(with_target: DataFrame) -> DataFrame:
    """Adds ``pass`` and ``taken``: a row for each pass that takes words of the document."""
    t, s = F.round("target").cast("bigint"), F.col("source_size")
    d = with_target.withColumn("want", t).filter("size > 0 and want > 0")
    d = d.withColumn("pass", F.explode(F.expr("sequence(0L, (want - 1) div source_size)")))
    left = F.col("want") - F.col("pass") * s
    return (d.withColumn("taken", F.least(F.col("size"), F.greatest(left - F.col("at"), F.lit(0).cast("bigint"))))
            .filter("taken > 0").withColumn("block", F.expr(f"at div {BLOCK}")).drop("want"))


def halves(lo: int, hi: int) -> int:
    return lo + (hi - lo + 1) // 2


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source, shard, quota) from (source, quota): level by level, one task per node.

    A node holds one row per source; its left half of the shards gets a number of blocks
    in proportion, drawn from the node's without replacement.
    """
    def split(table):
        import numpy as np
        import pyarrow as pa
        rows = sorted(table.to_pylist(), key=lambda r: (r["source"] is None, r["source"] or ""))
        lo, hi = rows[0]["lo"], rows[0]["hi"]
        if hi - lo <= 1:
            return table
        mid, total = halves(lo, hi), sum(r["quota"] for r in rows)
        # the left half of a node's shards gets its share of the blocks
        take = total * (mid - lo) // (hi - lo)
        rng, rest, out = np.random.default_rng([seed, lo, hi]), total, []
        for r in rows:      # conditional hypergeometric draws, any counts
            rest -= r["quota"]
            left = hypergeometric(rng, r["quota"], rest, take)
            take -= left
            out += [{**r, "hi": mid, "quota": left}, {**r, "lo": mid, "quota": r["quota"] - left}]
        return pa.Table.from_pylist(out, schema=table.schema)

    d = quotas.select("source", F.lit(0).alias("lo"), F.lit(int(shards)).alias("hi"), "quota")
    for _ in range(max(0, (int(shards) - 1).bit_length())):
        d = d.groupBy("lo", "hi").applyInArrow(split, d.schema)
    return d.select("source", F.col("lo").alias("shard"), "quota")


def hypergeometric(rng, good: int, bad: int, take: int) -> int:
    """Draw of the number of good ones among ``take``; numpy's limit is 10^9 each."""
    if take <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(good, take)
    if max(good, bad) < 10 ** 9:
        return int(rng.hypergeometric(good, bad, take))
    step = 10 ** 8      # larger counts are drawn in runs
    got = 0
    while take > 0:
        k = min(step, take)
        share = rng.binomial(k, good / (good + bad))
        share = max(k - bad, min(int(share), good))
        got, good, bad, take = got + share, good - share, bad - (k - share), take - k
    return got


def mixed(sized: DataFrame, shards: int = SHARDS, weights=WEIGHTS, budget=BUDGET, cap=CAP, seed: int = 0):
    """(rows, drawn): the placed rows with targets, and one row per drawn copy.

    A copy has its shard and ``place``, the rank of its block among those that the shard draws
    from the source.
    """
    sized = cut(sized)
    per = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap))
    t = per.select(F.col("source").alias("s3"), "source_size", "target")
    rows = cut(placed(sized).join(small(t), F.col("source").eqNullSafe(F.col("s3"))).drop("s3"))
    drawn = draws(rows)
    # every drawn block of a source gets a place in the source's permutation of blocks
    blocks = drawn.select("source", "pass", "block").distinct().withColumn(
        "mark", F.md5(F.concat_ws(":", F.lit(f"block{seed}"), "source", "pass", "block")))
    blocks = cut(blocks.withColumn("cell", F.substring("mark", 1, 2)))
    cells = blocks.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s4"), F.col("cell").alias("c4"),
                         F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("source", "cell").orderBy("mark", "pass", "block")
    blocks = (blocks.withColumn("k", F.row_number().over(own))
              .join(cells, F.col("source").eqNullSafe(F.col("s4")) & (F.col("cell") == F.col("c4")))
              .withColumn("k", F.col("k") + F.col("start")).drop("s4", "c4", "start", "cell", "mark"))
    quotas = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    leaves = splitting_tree(quotas, shards, seed)
    upto = Window.partitionBy("source").orderBy("shard")
    leaves = (leaves.withColumn("hi", F.sum("quota").over(upto)).withColumn("lo", F.col("hi") - F.col("quota"))
              .filter("quota > 0").groupBy("source")
              .agg(F.array_sort(F.collect_list(F.struct("hi", "shard", "lo"))).alias("runs")))
    leaves = leaves.select(F.col("source").alias("s5"), "runs")
    # the leaf that draws a block: the first whose run of the permutation reaches it
    dealt = (blocks.join(small(cut(leaves)), F.col("source").eqNullSafe(F.col("s5")))
             .withColumn("leaf", F.get(F.filter("runs", lambda r: r["hi"] >= F.col("k")), 0)).filter("leaf is not null")
             .select(F.col("source").alias("s6"), F.col("pass").alias("p6"), F.col("block").alias("b6"),
                     F.col("leaf.shard").alias("shard"), (F.col("k") - F.col("leaf.lo")).alias("place")))
    out = drawn.join(dealt, F.col("source").eqNullSafe(F.col("s6")) & (F.col("pass") == F.col("p6"))
                     & (F.col("block") == F.col("b6"))).drop("s6", "p6", "b6")
    return rows, out


def taken(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows, drawn = mixed(sizes(docs), shards)
    # per place in the stream: equal rows share ids but not places
    per = drawn.groupBy("source", "at", "doc_id", "size").agg(F.sum("taken").alias("taken"))
    per = per.select(F.col("source").alias("s7"), F.col("at").alias("a7"), F.col("doc_id").alias("d7"),
                     F.col("size").alias("z7"), "taken")
    on = (F.col("source").eqNullSafe(F.col("s7")) & (F.col("at") == F.col("a7"))
          & F.col("doc_id").eqNullSafe(F.col("d7")) & (F.col("size") == F.col("z7")))
    return (rows.join(per, on, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")))


def first_words(text, n):
    """The text up to the end of its n-th word."""
    gaps = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def step(acc, x):
        more = (x != "") & (acc["n"] < n)
        return F.struct((acc["at"] + F.length(x) + 1).alias("at"), (acc["n"] + more.cast("bigint")).alias("n"),
                        F.when(more, acc["at"] + F.length(x)).otherwise(acc["end"]).alias("end"))

    return F.substring(text, F.lit(1), F.aggregate(gaps, zero, step)["end"])


def sampled(docs: DataFrame, shards: int = SHARDS, weights=WEIGHTS, budget=BUDGET, cap=CAP, seed: int = 0) -> DataFrame:
    """The mix itself: the input's columns, one row per drawn copy, shuffled inside shards.

    A shard is spread over tasks by the first digits of its shuffled order, so neither its size
    nor the number of shards bounds the tasks; each task's rows are in that order.
    The one document of a source that is taken in part is cut after its last taken word.
    Ids are assumed to tell rows apart, save for repeated rows, which are drawn alike.
    """
    _, drawn = mixed(sizes(docs), shards, weights, budget, cap, seed)
    plan = drawn.select(F.col("doc_id").alias("d8"), F.col("source").alias("s8"), F.col("size").alias("z8"),
                        "taken", "shard", "pass").distinct()
    d = packed(docs, "doc_id", "source").withColumn("size", F.size(words(whole(F.col("row.text")))))
    d = d.join(plan, F.col("doc_id").eqNullSafe(F.col("d8")) & F.col("source").eqNullSafe(F.col("s8"))
               & (F.col("size") == F.col("z8")))
    text = F.when(F.col("taken") < F.col("size"), first_words(F.col("row.text"), F.col("taken"))).otherwise(F.col("row.text"))
    cols = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("pass").cast("string")))
    d = d.withColumns({"order": order, "cell": F.substring(order, 1, 2)})
    return d.repartition("shard", "cell").sortWithinPartitions("shard", "order").select(*cols)
