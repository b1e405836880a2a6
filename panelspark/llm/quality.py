"""Quality rules with cutoffs whose false rejections are bounded per stratum.

Rules measure integers per document. For every stratum (language) and rule the cutoff
is an order statistic of the labelled good documents that pass the base rules: with n
of them, k* is the largest k with P(Bin(n, alpha) <= k) <= delta / (strata * rules)
(the exact binomial bound, Bonferroni over all cutoffs). The cutoff is the least value
above which at most k* of them lie, so with confidence 1 - delta no rule rejects more
than ``alpha`` of the good documents of any stratum. A stratum with too few labels to
certify even k = 0 gets no cutoff and rejects nothing beyond the base rules.

Defined results: null text counts as empty and fails the base rule; null language is a
stratum of its own; labels without a document, with null quality or null id are unused;
a document labelled more than once counts once, as good only if all its labels say so;
repeated rows are judged alike; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import cut, let, packed, small, unspaced, whole, words

ALPHA = 0.0025      # false rejection of good documents that each rule may cause
DELTA = 0.05        # chance that any of the cutoffs breaks that
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words", "digits")


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice; each word counts once."""
    def grams(w):
        n = F.size(w)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))

    def twice(s):
        return let(F.filter(s, lambda x, j: x["g"].eqNullSafe(F.get(s, j - 1)["g"])
                            | x["g"].eqNullSafe(F.get(s, j + 1)["g"])), positions)

    def positions(pairs):
        return let(F.array_sort(F.transform(pairs, lambda x: x["i"])), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    return F.coalesce(let(F.array_sort(let(w, grams)), twice), F.lit(0).cast("bigint"))


def measures(docs: DataFrame) -> DataFrame:
    """Adds the counts and rule values to rows that have ``t`` (whole text)."""
    t = F.col("t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: unspaced(x) != "")
    d = docs.withColumns({"w": words(t), "ls": lines})
    d = d.withColumns({
        "n_words": F.size("w").cast("long"), "word_chars": F.length(unspaced(t)).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("ls").cast("long"),
        "n_dup_lines": (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"),
        "n_digits": (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long"),
        "n_repeat_words": repeat_words(F.col("w"))}).drop("w", "ls", "t")
    mean = F.expr("least(10 * word_chars div greatest(n_words, 1), 1000)")
    return d.withColumns({
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        "v_symbols": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "v_dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "v_repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "v_long_words": mean, "v_short_words": 1000 - mean,
        "v_digits": F.expr("1000 * n_digits div greatest(word_chars, 1)")})


def allowed(n: Column, tests: Column, alpha=ALPHA, delta=DELTA) -> Column:
    """Largest k with P(Bin(n, alpha) <= k) <= delta / tests, or -1. Exact, in logarithms."""
    odds = F.log(F.lit(alpha / (1 - alpha)))
    zero = F.struct(F.lit(-1).cast("bigint").alias("k"), F.lit(0.0).alias("cdf"),
                    (n * F.log(F.lit(1 - alpha))).alias("term"))

    def step(acc, k):
        cdf = acc["cdf"] + F.exp(acc["term"])
        term = acc["term"] + F.log((n - k) / (k + 1.0)) + odds
        return F.struct(F.when(cdf <= delta / tests, k).otherwise(acc["k"]).alias("k"), cdf.alias("cdf"),
                        F.coalesce(term, F.lit(-1e300)).alias("term"))

    # the median of Bin(n, alpha) is at most its mean rounded up, so no k beyond it can do
    ks = F.sequence(F.lit(0).cast("bigint"), F.ceil(n * alpha).cast("bigint"))
    return F.aggregate(ks, zero, step)["k"]


def cutoffs(measured: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """(stratum, c_<rule> ...): one row per stratum with labels; null: no cutoff."""
    good = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id"))
    held = (measured.filter("not base_failed").distinct()
            .join(good, "doc_id", "left_semi"))
    bars = (held.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"v_{r}").alias("v")) for r in RULES])).alias("x"))
        .groupBy("stratum", "x.rule", "x.v").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("stratum", "rule")
    # a histogram has at most 1001 values per stratum and rule, whatever the labels
    bars = bars.withColumns({"n": F.sum("c").over(w),
                             "above": F.coalesce(F.sum("c").over(w.orderBy(F.col("v").desc())
                                                                 .rowsBetween(Window.unboundedPreceding, -1)),
                                                 F.lit(0))})
    tests = bars.agg((F.count_distinct("stratum", "rule")).alias("tests"))
    ks = (bars.select("stratum", "n").distinct().crossJoin(F.broadcast(tests))    # one row
          .select("stratum", allowed(F.col("n"), F.col("tests"), alpha, delta).alias("k")))
    found = (bars.join(ks.withColumnRenamed("stratum", "s2"), F.col("stratum").eqNullSafe(F.col("s2")))
             .filter("k >= 0 and above <= k")
             .groupBy("stratum", "rule").agg(F.min("v").alias("cut")))
    return found.groupBy("stratum").agg(*[
        F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"c_{r}") for r in RULES])


def verdicts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``kept``."""
    cuts = small(cut(cuts)).withColumnRenamed("stratum", "s2")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(f"v_{r}") > F.col(f"c_{r}"), F.lit(False))
    return (measured.join(cuts, F.col("stratum").eqNullSafe(F.col("s2")), "left")
            .withColumn("kept", ~(F.col("base_failed") | bad)).drop("s2"))


def judged(docs: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """One row per document: its counts, rule values, cutoffs and ``kept``."""
    m = cut(measures(docs.select("doc_id", F.col("lang").alias("stratum"), whole("text").alias("t"))))
    return verdicts(m, cutoffs(m, labels, alpha, delta))


def filtered(docs: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """The documents that are kept, with all their columns."""
    d = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("stratum"),
                            whole(F.col("row.text")).alias("t"))
    # with the rows that may stay: writing them costs less than measuring twice
    m = cut(measures(d).withColumn("row", F.when(~F.col("base_failed"), F.col("row"))))
    return verdicts(m, cutoffs(m.drop("row"), labels, alpha, delta)).filter("kept").select("row.*")
