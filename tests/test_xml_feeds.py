import json

from tidemark.sources.xml_feeds import broken_feeds, feed_items, newest_of_feed

RSS = """<?xml version="1.0" encoding="utf-8"?>
<!-- x --><rss version="2.0" xmlns:content="c" xmlns:dc="d" xmlns:atom="a"><channel><title>C</title><atom:link href="self" rel="self"/>
<item><title><![CDATA[A &amp; <b>b</b>]]></title><link> http://u/1 </link><guid isPermaLink="false">g1</guid><pubDate>Tue, 2 Jan 2024 03:04:05 GMT</pubDate><description>&lt;p&gt;x  y&lt;/p&gt;</description><dc:creator>Me &amp; you</dc:creator></item>
<item><link>http://u/2</link><content:encoded>one two three four five six</content:encoded><author>a@b (N)</author><pubDate>never</pubDate></item>
<item><description> </description><link>http://u/3</link></item><item><category>none of it</category></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">T &amp;amp; U</title><link rel="self" href="s"/><link rel="alternate" type="text/html" href="http://a/1"/>
<id>urn:1</id><updated>2024-01-02T03:04:05Z</updated><summary>sum</summary><author><name>N</name></author><author><name>M</name></author></entry>
<entry><title>two</title><link rel="enclosure" href="e"/><link rel="related" type="text/html; x" href="h"/><published>2024-01-03T00:00:00+08:00</published><updated>2024-02-01T00:00:00Z</updated></entry>
<entry><title>three</title><link rel="enclosure" href="e"/></entry><entry><title>four</title><link href="http://plain"/><content>text</content></entry></feed>"""
RDF = '<rdf:RDF xmlns:rdf="r" xmlns="p" xmlns:dc="d"><channel><title>C</title></channel><item rdf:about="x"><title>R</title><link>http://r/1</link><dc:date>2024-01-05T00:00:00Z</dc:date></item></rdf:RDF>'
JSON = json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "7", "url": "http://j", "title": "J", "summary": "s"}]})
BODIES = [("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("json", JSON), ("cut", "<rss><channel><item><title>cut"), ("text", "plain"), ("other", '{"version": "9"}'), ("null", None), ("empty", ""), ("bare", "<rss><channel><title>no items</title></channel></rss>")]


def test_entries_of_all_kinds(spark):
    feeds = spark.createDataFrame(BODIES, "feed_id string, body string")
    got = {(r["feed_id"], r["seq"]): tuple(None if v is None else str(v) for v in r[2:]) for r in feed_items(feeds).collect()}
    assert got == {
        ("rss", 0): ("A & b", "http://u/1", "g1", "2024-01-02 03:04:05", "x y", "Me & you"),
        ("rss", 1): ("one two three four f...", "http://u/2", "http://u/2", None, "one two three four five six", "a@b (N)"),
        ("rss", 2): ("http://u/3", "http://u/3", "http://u/3", None, None, None),
        ("atom", 0): ("T & U", "http://a/1", "urn:1", "2024-01-02 03:04:05", "sum", "N, M"),
        ("atom", 1): ("two", "h", "h", "2024-01-02 16:00:00", None, None),
        ("atom", 2): ("three", "e", "e", None, None, None),
        ("atom", 3): ("four", "http://plain", "http://plain", None, "text", None),
        ("rdf", 0): ("R", "http://r/1", "http://r/1", "2024-01-05 00:00:00", None, None),
        ("json", 0): ("J", "http://j", "7", None, "s", None),
    }
    assert sorted(r["feed_id"] for r in broken_feeds(feeds).collect()) == ["cut", "empty", "null", "other", "text"]
    assert sorted(r["feed_id"] for r in newest_of_feed(feed_items(feeds), 1).collect()) == ["atom", "json", "rdf", "rss"]


def test_long_texts(spark):
    body = f"<rss><channel><item><description>{'word ' * 400_000}</description></item></channel></rss>"
    row = feed_items(spark.createDataFrame([("f", body)], "feed_id string, body string")).first()
    assert row["title"] == "word word word word ..." and row["summary"] == ("word " * 100) + "..."
