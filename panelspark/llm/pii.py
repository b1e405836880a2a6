"""Personal data by patterns, and terms that give it away by corpus co-occurrence.

The base patterns find e-mails, IPv4 numbers, payment cards and phone numbers. The
values found are protected entities. A term t of a text that holds an entity e tells
PMI(e, t) = log2(n_et * N / (n_e * n_t)) of the IC(e) = log2(N / n_e) bits the entity
carries, with counts over all documents; where the share PMI / IC reaches a threshold
the term is marked in the texts that hold the entity: removed above the higher one,
generalised between the two. Pairs need ``SUPPORT`` different texts, so that a single
text, or copies of it, proves nothing. Texts without personal data are never touched.

All on the JVM: hits and the pieces between them come from the same pattern, offsets
are prefix sums of their lengths (code points), and nothing but rows with hits, pair
counts and term counts is shuffled.

Defined results: null text counts as empty and has no spans; repeated rows get equal
results; spans may overlap across kinds; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .text import SPACES, cut, let, lower_ascii, running, small, whole

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3             # different texts that hold an entity, and the pair
GENERALISE, REMOVE = 0.8, 0.95
TRIM = ".,;:!?()[]{}\"'"

# The patterns find what the plain ones find from left to right. The look-behinds keep a
# run from being tried again from each of its characters, \G allows a start right after
# a hit, and possessive parts keep the matcher's stack flat on very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(x: Column) -> Column:
    return F.translate(x, "+ ().-", "")


def luhn(x: Column) -> Column:
    """Digits pass when the sum, every second from the right doubled, ends in 0."""
    d = F.filter(F.split(F.reverse(x), "", -1), lambda c: c != "")
    total = F.aggregate(F.transform(d, lambda c, i: let(
        c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))),
        F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(f"^{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}$")
    if kind == "card":
        return let(F.translate(x, " -", ""), lambda d: F.length(d).between(12, 19) & luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def hits(t: Column, kind: str) -> Column:
    """Array of (s, o, e, v): start, order of the kind, end (exclusive), entity value."""
    p, o = F.lit(PATTERNS[kind]), KINDS.index(kind)
    value = {"email": lower_ascii, "ip": lambda x: x}.get(kind, digits)
    none = F.array().cast("array<struct<s:bigint,o:int,e:bigint,v:string>>")

    def placed(found):
        gaps = F.transform(F.split(t, PATTERNS[kind], -1), lambda x: F.length(x).cast("bigint"))
        sizes = F.transform(found, lambda x: F.length(x).cast("bigint"))
        return let(gaps, lambda g: let(sizes, lambda z: let(running(F.zip_with(
            F.slice(g, 1, F.size(z)), z, lambda a, b: a + b)), lambda at: F.filter(F.transform(
                found, lambda x, i: F.when(passes(kind, x), F.struct(
                    (F.get(at, i) + F.get(g, i)).alias("s"), F.lit(o).alias("o"),
                    (F.get(at, i) + F.get(g, i) + F.get(z, i)).alias("e"),
                    F.concat(F.lit(kind + ":"), value(x)).alias("v")))), lambda x: x.isNotNull()))))

    return let(F.regexp_extract_all(t, p, F.lit(0)), lambda found: F.when(
        F.size(found) > 0, placed(found)).otherwise(none))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, t): base spans by start and kind; the text only where there are some."""
    d = docs.select("doc_id", whole("text").alias("t"))
    d = d.withColumns({k: hits(F.col("t"), k) for k in PATTERNS})
    d = d.withColumn("base", F.array_sort(F.concat(*PATTERNS)))
    return d.select("doc_id", F.sha2("t", 256).alias("h"), *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
                    "base", F.when(F.size("base") > 0, F.col("t")).alias("t"))


def terms(t: Column, base: Column) -> Column:
    """Array of (s, e, w): the words of a text outside its base spans, trimmed, lower case."""
    pieces = F.split(F.translate(t, SPACES, " " * len(SPACES)), " ", -1)
    return let(pieces, lambda ps: let(
        running(F.transform(ps, lambda x: (F.length(x) + 1).cast("bigint"))), lambda at: F.filter(
            F.transform(ps, lambda x, i: F.struct(
                (F.get(at, i) + F.length(x) - F.length(F.ltrim(x, F.lit(TRIM)))).alias("s"),
                (F.get(at, i) + F.length(F.rtrim(x, F.lit(TRIM)))).alias("e"),
                lower_ascii(F.btrim(x, F.lit(TRIM))).alias("w"))),
            lambda y: (y["w"] != "") & ~F.exists(base, lambda b: (b["s"] < y["e"]) & (y["s"] < b["e"])))))


def words_of(t: Column) -> Column:
    """Distinct normal forms of a text's words."""
    pieces = F.split(F.translate(t, SPACES, " " * len(SPACES)), " ", -1)
    return F.array_distinct(F.transform(pieces, lambda x: lower_ascii(F.btrim(x, F.lit(TRIM)))))


def revealing(docs: DataFrame, base: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(v, w, share): terms that tell at least the share ``least`` of an entity's bits."""
    held = base.filter("t is not null").select("h", F.array_distinct(F.transform("base", lambda b: b["v"])).alias("vs"),
                                               "base", "t")
    ents = (held.select("h", F.explode("vs").alias("v")).groupBy("v", "h").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("v").agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("n_e"))
            .filter(F.col("texts") >= support).select("v", "n_e"))
    ents = cut(ents)
    # rows of one text have the same words, so a text is read once and counts its rows
    texts = held.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.first("vs").alias("vs"), F.first("base").alias("base"),
                                  F.first("t").alias("t"))
    pairs = (texts.withColumn("v", F.explode("vs")).join(small(ents), "v")
             .select("v", "n_e", "c", F.explode(F.array_distinct(F.transform(
                 terms(F.col("t"), F.col("base")), lambda y: y["w"]))).alias("w"))
             .groupBy("v", "w").agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("n_et"), F.first("n_e").alias("n_e"))
             .filter(F.col("texts") >= support).drop("texts"))
    pairs = cut(pairs)
    vocabulary = cut(pairs.select("w").distinct())
    counts = (docs.select(F.explode(words_of(whole("text"))).alias("w")).join(small(vocabulary), "w", "left_semi")
              .groupBy("w").agg(F.count(F.lit(1)).alias("n_t")))
    total = base.agg(F.count(F.lit(1)).alias("n"))
    share = F.log2(F.col("n_et") * F.col("n") / (F.col("n_e").cast("double") * F.col("n_t"))) / F.log2(
        F.col("n") / F.col("n_e"))
    return (pairs.join(counts, "w").crossJoin(F.broadcast(total))     # one row
            .filter("n_e < n").select("v", "w", share.alias("share")).filter(F.col("share") >= least))


def found(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """One row per input row: doc_id, h, counts, base spans and all spans (s, o, e, v)."""
    base = cut(base_spans(docs))
    told = cut(revealing(docs, base, support, least))
    texts = base.filter("t is not null").groupBy("h").agg(F.first("base").alias("base"), F.first("t").alias("t"))
    marked = (texts.select("h", F.explode(F.array_distinct(F.transform("base", lambda b: b["v"]))).alias("v"))
              .join(small(told), "v").groupBy("h", "w").agg(F.max("share").alias("share"))
              .groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("w", "share"))).alias("told")))
    spans = (texts.join(marked, "h").select("h", F.transform(F.filter(
        terms(F.col("t"), F.col("base")), lambda y: F.map_contains_key(F.col("told"), y["w"])), lambda y: F.struct(
            y["s"].alias("s"), F.lit(KINDS.index("term")).alias("o"), y["e"].alias("e"),
            F.when(F.element_at(F.col("told"), y["w"]) >= REMOVE, "remove").otherwise("generalise").alias("v")))
        .alias("more")))
    spans = cut(spans)
    # rows without personal data have no term spans and stay out of the join
    plain = base.filter("t is null").select("doc_id", "h", *[f"n_{k}" for k in PATTERNS], "base",
                                            F.col("base").alias("spans"))
    held = (base.filter("t is not null").drop("t").join(small(spans), "h", "left")
            .withColumn("spans", F.when(F.col("more").isNull(), F.col("base"))
                        .otherwise(F.array_sort(F.concat("base", "more")))).drop("more"))
    return plain.unionByName(held.select(*plain.columns))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """Input rows with spans replaced in the text: [EMAIL], ..., [TERM] or nothing."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    marks = found(docs, **how).filter(F.size("spans") > 0).select("h", "spans").dropDuplicates(["h"])
    d = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(whole("text"), 256).alias("h"))

    def rebuilt(t, spans):
        zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

        def step(acc, x):
            label = F.when(x["v"] == "remove", "").otherwise(F.get(names, x["o"]))
            return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(
                F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")),
                         label).alias("out"), x["e"].alias("at")))

        return F.aggregate(spans, zero, step, lambda acc: F.concat(
            acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))

    joined_rows = d.join(marks, "h", "left")
    cols = [F.when(F.col("spans").isNotNull(), rebuilt(F.col("row.text"), F.col("spans")))
            .otherwise(F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns]
    return joined_rows.select(*cols)
