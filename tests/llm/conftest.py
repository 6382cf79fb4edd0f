import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_text(n=6000, seed=1):
    return " ".join(f"w{(i * 7919 + seed) % 4001}" for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in all columns, empty and blank texts, a very long one, copies, ties, repeated rows, odd characters."""
    base = "one two three four five six seven eight nine ten " * 6
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base.replace(" ", "\n"), "en", "a", len(base)),
        (3, base + "eleven", "en", "b", None),
        (4, "", "en", "b", 0),
        (5, None, None, None, None),
        (6, " \t\n ", "en", None, 4),
        (7, long_text(), "en", "a", None),
        (8, long_text(), "en", "c", None),
        (9, long_text(seed=2) + " tail", "en", "c", None),
        (10, "Ä ÖÜ ß 中文热搜 \U0001f600 x\x0by\x0cz\x85q é é", "xx", "ü", None),
        (11, "short", "en", "a", 5),
        (11, "short", "en", "a", 5),
        (12, "ONE TWO three four five six", "en", "a", 5),
        (13, "one two three FOUR five six", "en", "a", 5),
        (14, "<|endoftext|> it's a 'test' 123", "en", "a", 5),
    ]
    return rows


@pytest.fixture
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture
def null_key_docs(spark, edge_rows):
    return spark.createDataFrame([*edge_rows, (None, "no key here", "en", "a", 3), (None, edge_rows[0][1], "en", "a", 3), (None, None, None, None, None)], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing_docs(edge_docs):
    """Columns named like those that the operators add."""
    from pyspark.sql import functions as F

    names = "row_id size taken words score predicted held_out kept shard slot piece sequence_id component_id bucket band class text_crc32 target".split()
    return edge_docs.select("*", *[F.lit("mine").alias(n) for n in names])
