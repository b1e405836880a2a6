"""Exact deduplication by digest, with the frequent digests split off.

A Misra-Gries style sketch (``approx_top_k``, bounded counters per task) names
candidate frequent digests. An exact aggregation over those candidates finds their
winners: at most ``heavy`` rows, which are broadcast, and copies of them leave the job
on the map side. The other digests are shuffled; each of their groups is small,
because a larger one would be among the candidates.

Defined results: null text counts as empty; empty texts are equal to each other; of
equal texts the row with most code points stays, then the smallest id (null ids last);
of repeated rows (same id and text) exactly one stays; an empty table gives no rows.
Extra columns of any name are carried along.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .text import cut, packed, unspaced, whole

TRACKED = 8192      # counters of the sketch
HEAVY = 256         # winners that are broadcast at most


def digests(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n, h): id, code points of the original text, digest of the normal form."""
    t = whole(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.length(t).cast("long").alias("n"),
                       F.sha2(unspaced(t), 256).alias("h"))


def better():
    """Sorts the row that stays first."""
    return F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"))


def frequent_winners(d: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(h, win_n, win_id, group_size) of the frequent digests, exact, at most ``heavy`` rows."""
    named = (d.agg(F.expr(f"approx_top_k(h, {int(heavy)}, {int(tracked)})").alias("top"))
             .select(F.explode("top").alias("t")).select("t.item", "t.count")
             .filter("count > 1").select(F.col("item").alias("h")))
    won = (d.join(F.broadcast(named), "h").groupBy("h")
           .agg(F.count(F.lit(1)).alias("group_size"), F.min(better()).alias("w")))
    return cut(won.select("h", "group_size", (-F.col("w.col1")).alias("win_n"),
                          F.col("w.doc_id").alias("win_id")))


def copy_groups(docs: DataFrame, id_col="doc_id", text_col="text", heavy: int = HEAVY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    d = cut(digests(docs, id_col, text_col))
    marked = d.join(F.broadcast(frequent_winners(d, heavy)), "h", "left")
    is_winner = F.col("win_n").eqNullSafe(F.col("n")) & F.col("win_id").eqNullSafe(F.col("doc_id"))
    w = Window.partitionBy("h")
    order = w.orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last())
    rare = marked.filter("group_size is null").select(
        "doc_id", F.first("doc_id").over(order).alias("keep_id"),
        F.count(F.lit(1)).over(w).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"), F.col("h").alias("text_sha256"))
    heavy_rows = marked.filter("group_size is not null")
    gone = heavy_rows.filter(~is_winner).select(
        "doc_id", F.col("win_id").alias("keep_id"), "group_size", F.lit(False).alias("kept"),
        F.col("h").alias("text_sha256"))
    # repeated rows of a winner are counted, not gathered; the first of them stays
    stay = (heavy_rows.filter(is_winner).groupBy("h", "doc_id", "group_size").agg(F.count(F.lit(1)).alias("m"))
            .select("doc_id", F.col("doc_id").alias("keep_id"), "group_size",
                    F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), "m"), lambda i: i == 1)).alias("kept"),
                    F.col("h").alias("text_sha256")))
    return rare.unionByName(gone).unionByName(stay)


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", heavy: int = HEAVY) -> DataFrame:
    """The input rows that stay, with all their columns and nothing else."""
    won = frequent_winners(cut(digests(docs, id_col, text_col)), heavy)
    rows = packed(docs).select("row", F.col(f"row.`{id_col}`").alias("doc_id"),
                               whole(F.col(f"row.`{text_col}`")).alias("t"))
    rows = rows.select("row", "doc_id", F.length("t").cast("long").alias("n"),
                       F.sha2(unspaced(F.col("t")), 256).alias("h"))
    marked = rows.join(F.broadcast(won), "h", "left")
    order = Window.partitionBy("h").orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last())
    rare = (marked.filter("group_size is null").withColumn("rank", F.row_number().over(order))
            .filter("rank = 1").select("row"))
    heavy_rows = (marked.filter(F.col("win_n").eqNullSafe(F.col("n")) & F.col("win_id").eqNullSafe(F.col("doc_id"))
                                & F.col("group_size").isNotNull())
                  .groupBy("h").agg(F.first("row").alias("row")).select("row"))
    return rare.unionByName(heavy_rows).select("row.*")
