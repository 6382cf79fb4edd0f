"""Channel pages in any order, merged as a loop that goes back from cursor to cursor would."""

import random

import pytest

from tidemark.operators.paging import ordered_pages, scanned

PAGES = "feed_id string, page_id long, before long, cursor long"
POSTS = "page_id long, at long, url string, summary string, published_at string"


def looped(pages, posts, most):
    """{(feed, url): (page, at)}; feeds whose cursor doesn't fall give nothing."""
    out = {}
    for feed in {p[0] for p in pages}:
        of = sorted(p for p in pages if p[0] == feed)
        page = next((p for p in of if p[2] is None), None)
        if page is None:
            continue
        found = {x[2]: x for x in posts if x[0] == page[1]}
        cursor, ok = page[3], True
        for _ in range(most - 1):
            page = next((p for p in of if p[2] is not None and p[2] == cursor), None) if cursor is not None else None
            if page is None:
                break
            for x in (x for x in posts if x[0] == page[1]):
                if x[2] not in found or len(x[3] or "") > len(found[x[2]][3] or ""):
                    found[x[2]] = x
            if page[3] is not None and page[3] >= cursor:
                ok = False
                break
            cursor = page[3]
        if ok:
            out |= {(feed, url): (x[0], x[1]) for url, x in found.items()}
    return out


@pytest.mark.parametrize("most", [1, 2, 7, 10])
def test_scans_equal_the_loop(spark, most):
    rng, pages, posts, number = random.Random(most), [], [], 0
    for f in range(12):
        cursor, before = 1000, None
        for k in range(rng.choice([1, 2, 5, 13])):
            number += 1
            cursor = cursor + 5 if rng.random() < 0.04 else cursor - rng.randrange(1, 50)
            pages.append((f"f{f}", number, before, None if rng.random() < 0.05 else cursor))
            posts += [(number, at, f"u{rng.randrange(6)}-{f}", rng.choice([None, "", "a", "bb", "ccc"]), "t") for at in range(4)]
            before = cursor
    pages += [("orphan", 9001, 50, 40), ("round", 9002, 7, 7), ("f0", 9003, 123456, 5)]
    posts += [(9001, 0, "x", "s", "t"), (9002, 0, "x", "s", "t"), (9003, 0, "zz", "s", "t")]
    rng.shuffle(pages)
    got = scanned(spark.createDataFrame(pages, PAGES), spark.createDataFrame(posts, POSTS), most).collect()
    assert {(r["feed_id"], r["url"]): (r["page_id"], r["at"]) for r in got} == looped(pages, posts, most)


def test_places_and_bounds(spark):
    pages = spark.createDataFrame([("f", 3, 80, 70), ("f", 1, None, 90), ("f", 2, 90, 80), ("f", 4, 70, 75)], PAGES)
    assert sorted((r["page_id"], r["place"], r["stuck"]) for r in ordered_pages(pages).collect()) == [(1, 0, False), (2, 1, False), (3, 2, False), (4, 3, True)]
    assert ordered_pages(pages.limit(0)).count() == 0
    for bad in (0, 11):
        with pytest.raises(ValueError, match="between"):
            ordered_pages(pages, bad)
