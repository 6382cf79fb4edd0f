"""Text columns: normal forms, tokens, URLs, markup, redaction, identities."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Query parameters that only track, and those that a platform adds.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref referrer source channel _t timestamp _ random share_token share_id share_from".split()
PLATFORM_TRACKING = {"weibo": ["band_rank", "refer", "t"]}
#: Words that say nothing about a title's topic.
STOPWORDS = "the a an and or of in on at to for with by from is are was were be been it its this that as but not".split()
#: Chinese characters: the basic block, extension A, and extensions B to E.
CJK = r"一-鿿㐀-䶿\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}"
#: A Chinese character as fixed words have them. No other character becomes one in lower case.
IDEOGRAPH = "[\u3400-\u9fff]"
#: White space of any kind, as a class.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Characters that NFKC may change.
UNSURE = r"[^\x00-\x9f\xc0-\xff]"


def compatible(text: Column) -> Column:
    """text in NFKC. Only texts with characters that it may change go through Python."""
    unsure = text.rlike(UNSURE)
    return F.when(unsure, nfkc(F.when(unsure, text))).otherwise(text)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda row: None if row is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in row])


def compatible_each(texts: Column) -> Column:
    """A list of texts in NFKC; only lists with a text that it may change go through Python."""
    unsure = F.coalesce(F.exists(texts, lambda t: F.coalesce(t.rlike(UNSURE), F.lit(False))), F.lit(False))
    return F.when(unsure, nfkc_each(F.when(unsure, texts))).otherwise(texts)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html_lib.unescape(t))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two texts; it depends on their order."""
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def ratio_bound(text: Column, other: str) -> Column:
    """What sequence_ratio of a text and another can be at most: by their lengths, and by the letters they share.

    Matching blocks are of equal letters, so there are no more of a letter in them than the text has that has fewer.
    """
    both = F.length(text) + len(other)
    by_length = 2 * F.least(F.length(text), F.lit(len(other)))
    shared = F.lit(0)
    for letter, n in Counter(other).items():
        shared = shared + F.least(F.lit(n), F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit(""))))
    return F.when(both == 0, 1.0).otherwise(F.least(by_length, 2 * shared) / both)


def ratio_where(text: Column, other: str, least: Column | float) -> Column:
    """sequence_ratio(other, text) where it may come to least, and elsewhere 0; only those texts go through Python."""
    return sequence_ratio(F.lit(other), F.when(ratio_bound(text, other) >= least - 1e-9, text))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf" {WHITE}+|(?! ){WHITE}+", " "))  # a single space stays untouched


def normal_title(text: Column) -> Column:
    """NFKC, lower case, marks but the underscore to spaces, one space between words."""
    return F.trim(F.regexp_replace(F.lower(compatible(text)), r" [^\p{L}\p{N}_]+|[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*", " "))


def tokens_of_normal(title: Column) -> Column:
    """Distinct tokens of a normal title: words, and of runs of Chinese characters the pairs of neighbours, or the one there is.

    Without Chinese characters these are its parts between spaces.
    """
    parts = F.regexp_extract_all(title, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}_&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2)))
    each = F.transform(parts, lambda p: F.when(p.rlike(rf"^[{CJK}]") & (F.length(p) > 1), pairs(p)).otherwise(F.array(p)))
    words = F.array_remove(F.split(title, " "), "")
    return F.array_distinct(F.when(title.rlike(f"[{CJK}]"), F.flatten(each)).otherwise(words))


def topic_tokens(text: Column) -> Column:
    """Distinct tokens of a title in normal form."""
    return F.get(F.transform(F.array(normal_title(text)), tokens_of_normal), F.lit(0))  # the normal form is computed once


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))


def keywords(text: Column, least: int = 2) -> Column:
    """Words of at least two characters that aren't stopwords, without URLs and [labels]; repeats stay."""
    clean = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), r"\[[^\]]*\]", "")
    words = F.regexp_extract_all(F.lower(clean), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(STOPWORDS))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(0.0))


def may_share(text: Column, words: Column) -> Column:
    """Whether a text may have one of some keywords: it contains one, or has links or labels, without which others may come up."""
    low = F.lower(text)
    return F.exists(words, lambda w: F.contains(low, w)) | text.contains("[") | text.contains("http")


def normal_url(url: Column, platform: Column | None = None) -> Column:
    """The URL without tracking parameters and fragment, its other parameters in order of their names.

    A URL without a query stays as it is, fragment and all. Names and values are decoded and encoded again, an escape
    that is none being text; repeated names keep the order of their values; a name alone gets an equals sign. The
    platform's own parameters go too.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    base = F.concat(F.lower(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)?", 1)), F.regexp_replace(base, "^[A-Za-z][A-Za-z0-9+.-]*:", ""))
    escaped = lambda x: F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = lambda x: F.coalesce(F.try_url_decode(escaped(x)), F.replace(x, F.lit("+"), F.lit(" ")))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pieces, lambda p, i: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), i.alias("at"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    drop = lambda n: F.lower(n).isin(TRACKING)
    if platform is not None:
        common = drop
        own = F.create_map(*[x for k, v in PLATFORM_TRACKING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[platform]
        drop = lambda n: common(n) | F.coalesce(F.array_contains(own, F.lower(n)), F.lit(False))
    kept = F.array_sort(F.filter(named, lambda x: ~drop(x["name"])))
    rest = F.array_join(F.transform(kept, lambda x: F.concat(encoded(x["name"]), F.lit("="), encoded(x["value"]))), "&")
    return F.when(query == "", url).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), rest))


def event_url(url: Column) -> Column:
    """A URL as events compare it: trimmed, scheme and host in lower case, no fragment; path and query as they are."""
    bare = F.regexp_replace(F.regexp_replace(url, rf"^{WHITE}+|{WHITE}+$", ""), "#.*$", "")
    head = F.regexp_extract(bare, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?]*)?)", 1)
    return F.coalesce(F.concat(F.lower(head), F.substr(bare, F.length(head) + 1)), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))


def without_tags(markup: Column, by: str = "") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", by), r"\s+", " "))


def excerpt(markup: Column, most: int = 600) -> Column:
    return F.substring(without_tags(markup, " "), 1, most)


#: What is redacted, in this order.
REDACTIONS = [
    (r"sk-[A-Za-z0-9_-]{12,}", "[redacted]"),
    (r"(?i)(api[_-]?key|token|secret|password|passwd|Authorization)\s*[:=]\s*['\"]?[^'\"\s,}]+", "[redacted]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]"),
    (r"https?://\S+", "[redacted]"),
    (r"/Users/[^\s\"']+", "[redacted]"),
    (r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{32,}(?![A-Za-z0-9])", "[redacted]"),
    (r"(?<![\p{L}\p{N}_])\p{Nd}{8,}(?![\p{L}\p{N}_])", "[redacted]"),
    (r"(?<![\p{L}\p{N}_])[A-Z][a-z]+ [A-Z][a-z]+(?![\p{L}\p{N}_])", "[name]"),
]


def redacted(text: Column, most: int = 180) -> Column:
    """text with single spaces and without secrets, addresses and names, cut to most characters with three dots."""
    text = collapsed(F.coalesce(text, F.lit("")))
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    short = F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))
    return F.when(F.length(text) > most, short).otherwise(text)


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WHITE}+|{WHITE}+$", "")


def item_identity(kind: Column, source_id: Column, feed_id: Column, title: Column, url: Column) -> Column:
    """Identity of an observed item: kind, owner, and the title, or the link of a feed item that has one."""
    low = F.lower(trimmed(F.when(F.coalesce(kind, F.lit("")) == "", F.lit("unknown")).otherwise(kind)))
    owner = F.when(low == "hotlist", source_id).otherwise(feed_id)
    value = F.when((low == "rss") & (F.coalesce(url, F.lit("")) != ""), url).otherwise(title)
    return F.concat_ws("\x1f", low, trimmed(owner), trimmed(value))


def account_name(url: Column, kind: str) -> Column:
    """The account that an address without query, fragment, port or user names; null if it isn't one of that kind."""
    if kind == "telegram_html":
        return F.nullif(F.regexp_extract(url, r"^(?i:https://t\.me)/s/([A-Za-z][A-Za-z0-9_]{3,31})/*$", 1), F.lit(""))
    return F.nullif(F.regexp_extract(url, r"^(?i:https://(?:www\.)?(?:x|twitter)\.com)/([A-Za-z0-9_]{1,15})/*$", 1), F.lit(""))


def word_runs(title: Column, stopwords: list[str], least: int = 2) -> Column:
    """Words of a title for topics without rules: runs of Chinese characters, or of Latin letters and then digits.

    Links, [labels] and Chinese quotation marks and dots are taken out before; case and repeats stay.
    """
    bare = F.regexp_replace(F.regexp_replace(title, r"https?://\S+", ""), r"\[.*?\]", "")
    bare = F.regexp_replace(bare, "[【】《》「」『』\"'・·•]", "")
    runs = F.regexp_extract_all(bare, F.lit(r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z]{2,}[a-zA-Z0-9]*"), F.lit(0))
    return F.filter(runs, lambda w: (F.length(w) >= least) & ~F.lower(w).isin(stopwords) & ~w.isin(stopwords))


def event_title(title: Column) -> Column:
    """A title as events compare it: NFKC, single spaces, lower case; marks stay."""
    return F.lower(collapsed(F.coalesce(compatible(title), F.lit(""))))


def event_key(title: Column, version: str = "v1") -> Column:
    """Identity of an event: digest of its title as events compare it."""
    return F.concat(F.lit(f"event-{version}:"), F.sha2(F.concat(F.lit(f"{version}\x1f"), event_title(title)), 256))


def fingerprint_set(values: Column, digits: int = 16) -> Column:
    """Digest of the sorted distinct lower-cased values that aren't blank."""
    low = F.transform(values, lambda v: F.lower(F.regexp_replace(v, rf"^{WHITE}+|{WHITE}+$", "")))
    kept = F.array_sort(F.array_distinct(F.filter(low, lambda v: F.coalesce(v, F.lit("")) != "")))
    return F.substring(F.sha2(F.array_join(kept, "\n"), 256), 1, digits)


def url_fingerprint(urls: Column, digits: int = 16) -> Column:
    """Digest of the sorted distinct URLs, as events compare them, that aren't blank."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(urls, event_url), lambda v: v != "")))
    return F.substring(F.sha2(F.array_join(kept, "\n"), 256), 1, digits)


def stable_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("\x1f", *[F.trim(F.coalesce(p, F.lit(""))) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def contains_keyword(text: Column, word: str) -> Column:
    """A keyword of ASCII letters and digits needs other characters around it; any other is looked for as it is."""
    if re.fullmatch(r"[A-Za-z0-9]+", word):
        return text.rlike(rf"(?i)(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])")
    return F.lower(text).contains(word.lower())


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, each as contains_keyword takes it.

    All are three patterns; that of words with Chinese characters is only for texts with such characters.
    """
    plain = [w for w in words if re.fullmatch(r"[A-Za-z0-9]+", w)]
    other = [w.lower() for w in words if w not in plain]
    wide = [w for w in other if re.search(IDEOGRAPH, w)]
    rest = [w for w in other if w not in wide]
    each = lambda ws: f"(?=[{''.join(sorted({re.escape(w[0]) for w in ws}))}])(?:{'|'.join(map(re.escape, ws))})"
    found = F.lit(False)
    if plain:
        found = found | text.rlike(rf"(?i)(?=[{''.join(sorted({w[0] for w in plain}))}])(?<![A-Za-z0-9])(?:{'|'.join(plain)})(?![A-Za-z0-9])")
    if rest:
        found = found | F.lower(text).rlike(each(rest))
    if wide:
        found = found | (text.rlike(IDEOGRAPH) & F.lower(text).rlike(each(wide)))
    return found


def first_category(text: Column, categories: dict[str, list[str]]) -> Column:
    """The first category, in order, one of whose keywords occurs; null if none does."""
    out = F.lit(None).cast("string")
    for name, words in reversed(categories.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | contains_keyword(text, w)
        out = F.when(hit, name).otherwise(out)
    return out


def artifact_label(text: Column) -> Column:
    label = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "-"), "-{2,}", "-")
    label = F.regexp_replace(label, "^[-.]+|[-.]+$", "")
    return F.when(label == "", "run").otherwise(label)
