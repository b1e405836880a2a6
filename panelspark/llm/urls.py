"""URL verdicts: suffix rules first, else a logistic model on hashed character n-grams.

The model is trained on a small labelled URL table (host, path, blocked): at most
``rows`` of it, those with the least digests, which bounds the fit whatever the table.
A URL is the set of its character 3-grams, of host and of path apart, hashed into
``buckets`` places. Full-batch gradient steps run inside one expression over that
bounded sample; the fitted weights are ``buckets`` + 1 numbers.

Defined results: a null URL or one without ``://`` has an empty host and path; equal
rules cannot tie, of equally long ones the first in code point order wins; with no
labelled rows, or a margin of exactly 0, the verdict is allow; repeated rows are judged
alike; an empty table gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, lower_ascii

BUCKETS = 1024
ROWS = 2048         # bound of the training sample
EPOCHS = 200
RATE, RIDGE = 8.0, 1e-5

# Names of the labelled URL table that the query trains on.
BLOCKED = ("adult", "ads", "bets", "casino", "farm-spam", "free-pills", "malware", "phishing", "pills", "poker",
           "spam", "tracker", "win-cash", "xxx", "cheap-loans", "slots")
ALLOWED = ("archive", "books", "city", "club", "data", "earth", "forum", "garden", "health", "history", "house",
           "journal", "kitchen", "library", "market", "math", "museum", "music", "nature", "news", "notes", "online",
           "other", "paper", "people", "photo", "press", "region", "school", "science", "shop", "station", "the",
           "their", "there", "thing", "tion", "travel", "union", "weather", "wiki", "world")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self):
        return self.host + self.path


# The rules of the query.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host_of(url) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits host and path, else null.

    One comparison per rule and row: meant for rule lists of up to some hundreds.
    """
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def grams(text: Column, side: str, buckets: int) -> Column:
    """Hash places of the character 3-grams of the text between marks."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "", -1)

    def places(c):
        c = F.filter(c, lambda x: x != "")
        return let(c, lambda a: F.when(F.size(a) >= 3, F.transform(
            F.sequence(F.lit(0), F.size(a) - 3),
            lambda i: F.pmod(F.xxhash64(F.lit(side), F.concat(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2))),
                             F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>")))

    return places(chars)


def features(buckets: int = BUCKETS) -> Column:
    """Sorted distinct places of host and path."""
    return F.array_sort(F.array_distinct(F.concat(grams(F.col("host"), "host", buckets),
                                                  grams(F.col("path"), "path", buckets))))


def margin(f: Column, w: Column, b: Column) -> Column:
    score = F.aggregate(f, F.lit(0.0), lambda a, j: a + F.get(w, j))
    return b + score / F.sqrt(F.greatest(F.size(f), F.lit(1)))


def fit(labelled: DataFrame, rows: int = ROWS, buckets: int = BUCKETS, epochs: int = EPOCHS):
    """(weights, bias) from a table (host, path, blocked boolean); None without rows."""
    sample = (labelled.filter("blocked is not null and host is not null and path is not null")
              .select("host", "path", "blocked").distinct()
              .withColumn("key", F.sha2(F.concat_ws("\n", "host", "path", F.col("blocked").cast("string")), 256))
              .orderBy("key").limit(rows))
    sample = sample.select(F.struct("key", F.col("blocked").cast("double").alias("y"),
                                    features(buckets).alias("f")).alias("r"))
    one = sample.agg(F.array_sort(F.collect_list("r")).alias("rs"))
    one = one.withColumn("n", F.size("rs").cast("double")).filter("n > 0")
    one = one.withColumn("rs", F.transform("rs", lambda r: F.struct(
        r["y"].alias("y"), r["f"].alias("f"), (1 / F.sqrt(F.greatest(F.size(r["f"]), F.lit(1)))).alias("x"),
        (1 / F.col("n")).alias("c"))))
    places = F.flatten(F.transform("rs", lambda r, i: F.transform(r["f"], lambda j: F.struct(j.alias("j"), i.alias("i")))))
    one = one.withColumn("hits", F.array_sort(places))
    posts = (one.select(F.explode("hits").alias("h")).groupBy("h.j")
             .agg(F.array_sort(F.collect_list("h.i")).alias("p")))
    posts = posts.agg(F.map_from_entries(F.collect_list(F.struct("j", "p"))).alias("m"))
    posts = posts.select(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda j: F.coalesce(
        F.element_at("m", j), F.array().cast("array<int>"))).alias("posts"))
    both = one.select("rs").join(F.broadcast(posts))    # one row each

    def step(acc, _):
        def moved(e):
            w = F.transform("posts", lambda p, j: F.get(acc["w"], j) * (1 - RATE * RIDGE) + RATE * F.aggregate(
                p, F.lit(0.0), lambda a, i: a + F.get(e, i)["g"]))
            return F.struct(w.alias("w"), (acc["b"] + RATE * F.aggregate(
                e, F.lit(0.0), lambda a, x: a + x["d"])).alias("b"))

        def slope(r):
            z = acc["b"] + F.aggregate(r["f"], F.lit(0.0), lambda a, j: a + F.get(acc["w"], j)) * r["x"]
            return (r["y"] - 1 / (1 + F.exp(-z))) * r["c"]

        return let(F.transform("rs", lambda r: let(slope(r), lambda d: F.struct(
            d.alias("d"), (d * r["x"]).alias("g")))), moved)

    zero = F.struct(F.transform("posts", lambda p: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))
    model = both.select(F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), zero, step).alias("m")).first()
    return (list(model.m.w), model.m.b) if model else None


def judged(urls: DataFrame, labelled: DataFrame, rules=RULES, url_col="url", buckets: int = BUCKETS) -> DataFrame:
    """Adds host, path, rule and verdict to (id columns, url)."""
    model = fit(labelled, buckets=buckets)
    d = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    d = d.withColumns({"rule": first_rule(rules, lambda r: r.text), "by_rule": first_rule(rules, lambda r: r.verdict)})
    guess = F.lit("allow")
    if model:
        w, b = F.array(*[F.lit(float(x)) for x in model[0]]), F.lit(float(model[1]))
        guess = F.when(margin(features(buckets), w, b) > 0, "block").otherwise("allow")
    return d.withColumn("verdict", F.coalesce("by_rule", guess)).drop("by_rule")


def labelled_names(spark, blocked=BLOCKED, allowed=ALLOWED) -> DataFrame:
    """A small labelled table: every name on the same hosts and paths, so only names tell."""
    fronts, ends = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org")
    paths = ("/en/12", "/de/305.html", "/fr/47/", "/es/860", "/")
    rows = [(f"{fronts[(i + k) % 4]}{name}.{ends[(i + 2 * k) % 3]}", paths[(3 * i + k) % 5], bad)
            for bad, names in ((True, blocked), (False, allowed)) for i, name in enumerate(names) for k in range(4)]
    return spark.createDataFrame(rows, "host string, path string, blocked boolean")
