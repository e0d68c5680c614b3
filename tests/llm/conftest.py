import pytest

#: Names that operators use within, or return: as further columns of the input they must do no harm.
CLASHES = ["score", "ids", "n_tokens", "cls", "key", "keys", "c0", "k0", "size", "shard", "hub", "removed", "maybe", "bm_bits"]


def documents(spark, rows):
    """doc_id, text and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    data = [(i, t, "en", "s", None if t is None else len(t), *("x" for _ in CLASHES)) for i, t in rows]
    return spark.createDataFrame(data, schema)


LONG = " ".join(f"w{i * i % 9973} and{i % 7}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while the old farmer counts his sheep near the river and hums a quiet song about distant hills in autumn light."
EDGES = [
    (1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \t\n "), (None, "no id here at all, my friend"), (None, None),
    (5, LONG), (6, "é" * 3000), (7, "a"), (8, "Ünï çödé 日本語 😀 text")
]


@pytest.fixture()
def edge_docs(spark):
    return documents(spark, EDGES)


@pytest.fixture()
def no_docs(spark):
    return documents(spark, [])
