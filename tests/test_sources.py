import json

from pyspark.sql import functions as F

from tidemark.sources import feeds, store


def test_ranked_items(spark):
    body = json.dumps({"status": "success", "items": [{"title": "a", "url": "u1"}, {"title": " ", "url": "x"}, {"title": "b", "url": "u2"}, {"title": "a", "url": "u3"}]})
    df = spark.createDataFrame([("s", body), ("t", '{"status": "error"}'), ("v", "no json"), ("w", None)], "source_id string, body string")
    got = {(r["source_id"], r["title"]): (r["ranks"], r["url"]) for r in feeds.ranked_items(df).collect()}
    assert got == {("s", "a"): ([1, 4], "u1"), ("s", "b"): ([3], "u2")}


def test_one_foreign_link_rejects_the_source(spark):
    items = spark.createDataFrame([("s", "https://a.x.com/1"), ("s", "http://x.com/2"), ("t", "https://y.com/1"), ("u", "ftp://z")], "source_id string, url string")
    domains = spark.createDataFrame([("s", "x.com"), ("t", "y.com")], "source_id string, domain string")
    assert sorted(r["source_id"] for r in feeds.on_domain(items, domains).collect()) == ["t", "u"]


def test_json_feed(spark):
    body = json.dumps({"version": "https://jsonfeed.org/version/1", "items": [{"id": "1", "content_text": "x" * 30, "date_published": "2024-01-02T03:04:05Z", "authors": [{"name": "A"}, {"name": "B"}]}, {"url": "u", "content_html": "a <b>c</b> &amp; d"}]})
    rows = feeds.json_feed_items(spark.createDataFrame([("f", body), ("g", "{}")], "feed_id string, body string")).orderBy("seq").collect()
    assert (rows[0]["title"], rows[0]["guid"], rows[0]["author"], str(rows[0]["published_at"])) == ("x" * 20 + "...", "1", "A, B", "2024-01-02 03:04:05")
    assert (rows[1]["title"], rows[1]["guid"], rows[1]["summary"], rows[1]["published_at"]) == ("u", "u", "a c & d", None)


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>u</link><pubDate>Tue, 2 Jan 2024 03:04:05 GMT</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item><item><link>v</link><pubDate>never</pubDate></item></channel></rss>")
    got = {r["url"]: r for r in feeds.rss_items(spark, str(tmp_path)).collect()}
    assert (got["u"]["title"], str(got["u"]["published_at"]), got["u"]["summary"]) == ("T", "2024-01-02 03:04:05", "x")
    assert (got["v"]["title"], got["v"]["published_at"], got["v"]["guid"]) == ("v", None, "v")


def test_listing_and_messages(spark):
    html = "<a href='/n/1'>News <b>One</b> Mar 4, 2024</a><a href='/n/1'>again March 5, 2024</a><a href='/x'>no date</a>"
    got = feeds.dated_listing(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "https://h").collect()
    assert [(r["url"], r["title"], str(r["published_at"])[:10]) for r in got] == [("https://h/n/1", "News One", "2024-03-04")]
    post = '<a data-post="c/{}"></a><time datetime="{}"></time><div class="text">{}</div>'
    page = post.format(1, "2024-01-01T00:00:00+00:00", "a") + post.format(2, "2024-01-01T00:00:00", "naive") + '<i data-before="7"></i><i data-before="5"></i>'
    later = post.format(1, "2024-01-01T00:00:00+00:00", "a <b>longer</b>")
    rows = feeds.messages(spark.createDataFrame([(1, page), (2, later)], "page_id long, html string")).collect()
    assert [(r["post"], r["text"]) for r in rows] == [("c/1", "a longer")]


def test_fetched_by_a_callable(spark):
    got = {r["source_id"]: r["body"] for r in feeds.fetched(spark, ["a", "b"], lambda x: None if x == "b" else f"<{x}>").collect()}
    assert got == {"a": "<a>", "b": None}


def test_partitions(spark, tmp_path):
    root, remote = str(tmp_path / "here"), str(tmp_path / "there")
    rows = spark.createDataFrame([("s", "t", 1, 1), ("s", "t", 2, 5), ("u", "v", 3, 1)], "source_id string, title string, seq int, rank int")
    for d in ("2024-01-01", "2024-01-02"):
        store.write_day(rows, root, "news", d)
    store.write_day(rows, remote, "news", "2024-01-03")
    assert store.available_dates(spark, root) == ["2024-01-02", "2024-01-01"]
    assert store.read_snapshot(spark, root, "2024-01-05") is None
    assert store.read_snapshot(spark, root, "2024-01-01", sources=["u"]).count() == 1
    assert {(r["title"], r["rank"]) for r in store.keyed_by_title(rows).collect()} == {("t", 5), ("v", 1)}
    assert store.pull_missing(spark, remote, root, "news", "2024-01-04", 3) == {"synced": ["2024-01-03"], "skipped": ["2024-01-02"], "missing": ["2024-01-04"]}
    assert store.drop_older(spark, root, "news", "2024-01-03", 1) == ["2024-01-01"]
    assert store.drop_older(spark, root, "news", "2030-01-01", 0) == []


def test_transcripts_and_samples(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"role": "user"}\nbroken\n\n' + "{}\n" * 5)
    got = store.transcripts(spark, str(tmp_path), 4)
    assert got.count() == 3 and got.where("parsed IS NULL").count() == 1
    lines = spark.createDataFrame([("# c",), ("a",), ("",)], "value string")
    assert {(r["title"], r["rank"]) for r in store.samples(lines, spark.createDataFrame([("a", 3), ("b", 2)], "title string, rank int")).collect()} == {("a", 3), ("b", 2)}
    files = spark.range(200).withColumnRenamed("id", "mtime")
    some = [r["mtime"] for r in store.evenly_sampled(files, "mtime").orderBy("mtime").collect()]
    assert len(some) == 45 and some[:10] == list(range(10)) and some[-15:] == list(range(185, 200))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "t", 1, "u")], "source_id string, title string, rank int, url string")
    store.write_text_snapshot(rows, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").first()[0] == "s\t1. t [URL:u]"
    store.write_json_artifact(rows, f"{tmp_path}/j")
    assert list(json.loads(spark.read.text(f"{tmp_path}/j").first()[0])) == ["rank", "source_id", "title", "url"]
    store.write_csv(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["title"] == "t"
    both = store.plan_and_receipt(spark.createDataFrame([("1",), ("2",)], "run_id string"), spark.createDataFrame([("2",), ("3",)], "run_id string"))
    assert {r["run_id"]: r["confidence"] for r in both.select("run_id", F.col("confidence")).collect()} == {"1": "low", "2": "high", "3": "medium"}
