"""Entities of titles, found one kind after another so that no text counts twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words with a capital that are no names.
NO_NAMES = """
live breaking video watch says said new update updates exclusive report reports opinion analysis latest news
the and for with from after amid over what why how here this that more top into but not are was will has have amp
january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday
""".split()

RUN = r"[A-Za-z0-9.\-]*"
#: Amounts, results, percentages, models (runs with a letter and a digit), numbers and names. Python's digits are \p{Nd}.
AMOUNT = r"\$\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
RESULT = r"\p{Nd}{1,3}-\p{Nd}{1,3}"
PERCENTAGE = r"\p{Nd}+%"
MODEL = rf"(?={RUN}[A-Za-z])(?={RUN}[0-9])[A-Za-z0-9]{RUN}[A-Za-z0-9]"
NUMBER = r"\p{Nd}{3,}"
NAME = r"[A-Z][A-Za-z]{2,}"


def entities(title: Column, dictionary: dict[str, str] | None = None, no_names: list[str] = NO_NAMES) -> Column:
    """Sorted distinct entities of a title, each kind taken out before the next is looked for.

    Amounts without their commas; results such as 4-2; percentages from 2; models such as glm-5.2; numbers of three
    digits or more that aren't years from 1900 to 2100; names of three letters or more. All in lower case. Keys of the
    dictionary that occur in the title add their values. A null title has none.
    """
    each = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    text = F.coalesce(title, F.lit(""))
    known = [F.when(F.contains(title, F.lit(a)), F.lit(b)) for a, b in (dictionary or {}).items()]
    extra = F.filter(F.array(*known), lambda x: x.isNotNull()) if known else F.array().cast("array<string>")
    names_in = lambda rest: F.filter(F.transform(each(rest, NAME), F.lower), lambda x: ~x.isin(no_names))
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # value is computed once
    taken = lambda rest, pattern, then: once(F.regexp_replace(rest, pattern, " "), then)

    amounts = lambda rest: F.transform(each(rest, AMOUNT), lambda x: F.replace(x, F.lit(","), F.lit("")))
    shares = lambda rest: F.filter(each(rest, PERCENTAGE), lambda x: ~x.rlike("^0*[01]?%$"))
    models = lambda rest: F.transform(each(rest, MODEL), F.lower)
    numbers = lambda rest: F.filter(each(rest, NUMBER), lambda x: ~x.rlike("^0*(?:19[0-9]{2}|20[0-9]{2}|2100)$"))
    after_models = lambda rest: F.concat(numbers(rest), names_in(rest))
    after_shares = lambda rest: F.concat(models(rest), taken(rest, MODEL, after_models))
    after_results = lambda rest: F.concat(shares(rest), taken(rest, PERCENTAGE, after_shares))
    after_amounts = lambda rest: F.concat(each(rest, RESULT), taken(rest, RESULT, after_results))
    whole = F.concat(amounts(text), taken(text, AMOUNT, after_amounts))
    found = F.when(text.rlike(r"\p{Nd}"), whole).otherwise(names_in(text))  # all kinds but names have a digit
    return F.array_sort(F.array_distinct(F.concat(found, extra)))


def is_specific(entity: Column, common: list[str]) -> Column:
    """Whether an entity is telling: it has a digit, is an amount or a percentage, or isn't a common name."""
    return (entity != "") & (entity.rlike(r"\p{Nd}|^\$|%$") | ~entity.isin(common))


def admitted_feed_items(feed: DataFrame, topics: DataFrame, now: Column, hours: int = 36, cap: int = 3) -> DataFrame:
    """Feed items (seq, title, entities, published_at) that share entities with hot topics (topic_no, entities).

    Within the window, unknown dates included; each goes to the topic with most shared entities, ties to the first,
    and a topic takes at most cap, those with most shared entities first.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("published_at")
    fresh = feed.where(F.coalesce(age <= hours * 3600, F.lit(True)))
    shared = fresh.select("seq", F.explode("entities").alias("e")).join(topics.select("topic_no", F.explode("entities").alias("e")), "e")
    counts = shared.groupBy("seq", "topic_no").agg(F.countDistinct("e").alias("n"))
    best = counts.groupBy("seq").agg(F.max(F.struct("n", (-F.col("topic_no")).alias("first"))).alias("x")).select("seq", (-F.col("x.first")).alias("topic_no"), F.col("x.n").alias("n"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("topic_no").orderBy(F.desc("n"), "seq")))
    return ranked.where(F.col("place") <= cap)


def attached(feed: DataFrame, hot: DataFrame, common: list[str], least: int = 1) -> DataFrame:
    """Each feed item (seq, entities) with the one hot-list item (seq, rank, entities) that it fits best, if any.

    Most shared specific entities first, then the better rank, then the earlier item; items attach, they don't chain.
    """
    pairs = feed.select(F.col("seq").alias("feed"), F.explode("entities").alias("e")).join(hot.select(F.col("seq").alias("item"), "rank", F.explode("entities").alias("e")), "e")
    counts = pairs.groupBy("feed", "item", "rank").agg(F.count_if(is_specific(F.col("e"), common)).alias("n"))
    key = F.struct((-F.col("n")).alias("a"), F.coalesce("rank", F.lit(999)).alias("b"), F.col("item").alias("c"))
    return counts.where(F.col("n") >= least).groupBy("feed").agg(F.min_by("item", key).alias("item"))
