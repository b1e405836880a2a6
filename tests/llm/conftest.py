import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(k, n=120):
    return " ".join(f"w{(k * 7919 + i * i * 31) % 997}x{i % 13}" for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    base = prose(1)
    long_words = prose(2, 9000)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (2, base), (3, base.upper()), (4, " ".join(near)), (5, None), (6, ""), (7, " \n\t "),
            (8, "one two three"), (9, "One two  three"), (10, "one two three four"), (11, long_words),
            (12, long_words + " tail"), (13, "x" * 200_000), (14, "7" * 120_000), (15, "a@b.c " * 3), (None, base),
            (None, None), (17, "é" * 70_000 + " <|endoftext|> end"), (18, base + "\n" + base), (19, "1 " * 60_000),
            (20, "mail me: jo@x.example.org, 10.0.0.256 10.0.0.1 4111 1111 1111 1111 +1 (555) 010-9999."),
            (21, " ".join(f"t{i}" for i in range(12))), (22, " ".join(f"t{i}" for i in range(13))),
            (23, "a.b.c@d" + ".e" * 30_000), (24, "dup line here\n" * 40)]
    langs, sources = ("en", None, "de"), ("b", "a", None)
    return [(i, t, langs[k % 3], sources[k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The rows with extra columns whose names the operators use themselves."""
    extra = ", ".join(f"{c} string" for c in ("row", "h", "key", "size", "comp", "t", "n", "rank", "taken", "words"))
    return spark.createDataFrame([r + tuple("x" for _ in range(10)) for r in edge_rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
