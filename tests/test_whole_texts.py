"""Queries over whole lines of documents."""

import pytest

from tidemark.queries import QUERIES
from tidemark.queries.base import titles

LONG = "x" * 300 + " tail"
TEXTS = [(1, f"first line\n\n  \n{LONG}\nThe and attion to thanedble the", "en", "src1"), (2, "", "en", "src2"), (3, None, "de", "src3")]


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_lines_are_whole(spark, few):
    got = {(r["seq"] >> 32, r["seq"] & 0xFFFFFFFF, r["title"]) for r in titles(spark, few).collect()}
    assert got == {(1, 0, "first line"), (1, 3, LONG), (1, 4, "The and attion to thanedble the")}


@pytest.mark.parametrize("name", ["search_fuzzy", "related_titles", "related_titles_by_text"])
def test_searches_find_later_lines(spark, few, name):
    assert [r["seq"] for r in QUERIES[name](spark, few).collect()] == [(1 << 32) + 4]


@pytest.mark.parametrize("name, n", [("reader_noise", 3), ("title_entities", 3), ("bound_events", 3)])
def test_every_line_counts(spark, few, name, n):
    assert QUERIES[name](spark, few).count() == n


def test_events_of_later_titles(spark, few):
    assert {r["display_title"] for r in QUERIES["event_candidates"](spark, few).collect()} == {"first line", LONG, "The and attion to thanedble the"}
