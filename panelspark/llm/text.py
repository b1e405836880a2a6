"""Small column helpers shared by the text operators."""

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import checkpointed

# The white space that separates words (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES_SQL = "[\\x20\\x09-\\x0D]"
WORD_SQL = "[^\\x20\\x09-\\x0D]+"


def whole(text) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words; no word gives an empty array."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), "")


def unspaced(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, SPACES, "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where inner lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of a bigint array, one entry longer than the array.

    ``aggregate`` copies its array at every step, so sums run inside blocks and over
    block totals: the work is n * block and not n * n.
    """
    start = F.array(F.lit(0).cast("bigint"))

    def scan(a):
        return F.aggregate(a, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def total(values):
        n = F.size(values)
        firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(block))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(firsts, lambda i: scan(F.slice(values, i, F.lit(block)))), joined)

    def joined(inner):
        return let(scan(F.transform(inner, lambda s: F.element_at(s, -1))), lambda outer: F.concat(
            F.flatten(F.transform(inner, lambda s, k: F.transform(
                F.slice(s, 1, F.size(s) - 1), lambda v: v + F.get(outer, k)))),
            F.array(F.element_at(outer, -1))))

    return let(values, total)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Broadcast a side whose row count was checked; a larger side joins by shuffle.

    ``df`` must be cheap to evaluate twice (a checkpoint or a written table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    return checkpointed(df)


def packed(df: DataFrame, *own: str) -> DataFrame:
    """All columns in one struct ``row``, besides copies of the named ones.

    Operators work beside ``row``, so extra columns cannot clash with their own names.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[F.col(f"`{c}`").alias(c) for c in own])
