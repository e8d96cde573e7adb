import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words, another sequence for every seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 9 or ""))
    return " ".join(out)


#: Nulls, empty and blank texts, a very long one, repeated rows, equal and null ids, odd characters.
ODD = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, prose(1, 300)), (6, prose(1, 300)),
    (7, prose(1, 300).upper()), (8, prose(2, 9000)), (9, "it's <|endoftext|> and\x0b\x1c   É́ ß İ ½"),
    (9, "it's <|endoftext|> and\x0b\x1c   É́ ß İ ½"), (10, "a" * 5000), (10, "other text of the same id"),
    (None, "no id here"), (None, None), (-5, "negative id \U0001F600 日本語 text"), (11, prose(1, 299) + " changed"),
]
CLASHES = ("part", "pos", "rid", "seq", "node", "f", "sig", "root", "h", "key", "bucket", "score", "diff", "todo", "blob", "kind", "shard", "rank", "pii", "sketch")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with further columns that clash with names used inside the operators."""
    rows = [(i, t, *range(len(CLASHES))) for i, t in ODD]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}
