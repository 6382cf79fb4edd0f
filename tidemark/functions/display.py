"""Texts that readers see: reasons of alerts, statuses, notes and summaries made without a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import unescaped

#: How each reason of a score is shown.
REASONS = {"rank_movement": "rank↑%.1f", "new_burst": "burst+%.1f", "recency_momentum": "momentum+%.1f", "weak_persistence": "persist+%.1f"}
#: What a status is called for readers, by status and, without one, by section.
STATUS_NAMES = {
    "跨层有呼应": "多层来源呼应",
    "高热待核实": "单点高热，来源待补",
    "情绪聚集": "情绪传播集中",
    "沉默温差": "社交端响应偏弱",
    "中文源呼应(缺A/B背景)": "中文平台热度上升",
}
SECTION_NAMES = {
    "cross_layer_verified": "多层来源呼应",
    "high_heat_unverified": "单点高热，来源待补",
    "chinese_only_hot": "中文平台热度上升",
    "silence_gap": "社交端响应偏弱",
}
SECTION_OF = {
    "跨层有呼应": "cross_layer_verified",
    "中文源呼应(缺A/B背景)": "chinese_only_hot",
    "中文专业来源": "chinese_only_hot",
    "高热待核实": "high_heat_unverified",
    "沉默温差": "silence_gap",
}
#: Phrases of texts that say nothing of an event.
BOILERPLATE = "该事件存在传播风险 存在传播风险 事实仍待核验 事实待核验 仍待核验 待核实 待核验 需关注后续信息 需关注后续 关注后续".split()
BOILERPLATE_STARTS = "本组 该组 此组".split()
MARKS = " 。，、；：;:,.　\"'“”‘’"


def looked_up(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    return reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), table.items(), otherwise)


def _reason(text: Column, at: Column) -> Column:
    """(order, at, shown) of one reason 'key=score(more)'; shown is null for those that aren't shown."""
    part = lambda i: F.regexp_extract(text, r"^(\w+)=([0-9.]+)(?:\((.+)\))?$", i)
    score = part(2).try_cast("double")
    place = F.regexp_extract(part(3), r"rank=(\d+)", 1)
    shown = F.when((part(1) == "best_rank_heat") & (place != ""), F.concat(F.lit("#"), place)).when(part(1) == "hotlist_rss_cooccurrence", "cross")
    for name, form in REASONS.items():
        shown = shown.when(part(1) == name, F.format_string(form, F.bround(score, 1)))
    return F.struct((-score).alias("order"), at.alias("at"), F.when(score != 0, shown).alias("shown"))


def source_count(reasons: Column) -> Column:
    """The number of sources that the first such reason tells; 1 if none does."""
    found = F.filter(reasons, lambda r: r.rlike(r"^source_coverage_heat=[0-9.]+\(n=\d+\)$"))
    return F.coalesce(F.regexp_extract(F.get(found, F.lit(0)), r"n=(\d+)", 1).try_cast("int"), F.lit(1))


def trigger_summary(reasons: Column, most: int = 3) -> Column:
    """The strongest reasons of a score and its number of sources; 'score threshold' where none can be shown.

    Reasons of equal scores stay in their order. Null counts as no reasons.
    """
    parsed = F.filter(F.transform(reasons, _reason), lambda r: r["shown"].isNotNull())
    best = F.transform(F.slice(F.array_sort(parsed), 1, most), lambda r: r["shown"])
    shown = F.array_join(F.concat(best, F.array(F.concat(F.lit("src "), source_count(reasons).cast("string")))), "; ")
    return F.when(F.size(parsed) > 0, shown).otherwise("score threshold")


def without_urls(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+", ""))


def display_topic(topic: Column) -> Column:
    """A topic without links and without the prefix of items that have no group, unless nothing else is left."""
    raw = without_urls(topic)
    bare = F.trim(F.regexp_replace(raw, r"^(?:高热未归类|未归类)\s*[·:：|｜-]\s*", ""))
    return F.when(bare == "", raw).otherwise(bare)


def visible_length(markup: Column) -> Column:
    """Characters of a message once tags are gone and entities are read."""
    return F.char_length(unescaped(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", "")))


def is_boilerplate(text: Column, templates: list[str] | None = None) -> Column:
    """Whether a text is empty, one of the templates, or hardly more than a phrase of caution."""
    body = F.trim(F.coalesce(text, F.lit("")))
    says_nothing = (body == "") | body.isin(templates or [])
    for start in BOILERPLATE_STARTS:
        says_nothing = says_nothing | body.startswith(start)
    for phrase in BOILERPLATE:
        rest = F.btrim(F.replace(body, F.lit(phrase), F.lit("")), F.lit(MARKS))
        says_nothing = says_nothing | (body.contains(phrase) & (F.char_length(rest) <= 4))
    return says_nothing


def reader_status(section: Column, status: Column, tiers: Column, d_platforms: Column, platforms: Column) -> Column:
    """An event's status for readers: by Chinese coverage where tiers C and D have it alone, else its own, else its section's."""
    has = lambda t: F.coalesce(F.array_contains(tiers, t), F.lit(False))
    d, n = F.coalesce(d_platforms, F.lit(0)), F.coalesce(platforms, F.lit(0))
    covered = F.when((d >= 3) | (n >= 5), "中文多源覆盖").when((d >= 2) | (n >= 3), "中文多平台覆盖").otherwise("中文源有呼应")
    own = F.trim(F.coalesce(status, F.lit("")))
    named = F.when(own != "", looked_up(own, STATUS_NAMES, own)).otherwise(looked_up(section, SECTION_NAMES, F.lit("")))
    return F.when(has("C") & has("D") & ~has("A") & ~has("B"), covered).otherwise(named)


def event_section(section: Column, status: Column) -> Column:
    """The section an event counts in: that of its own status, else the one it came in."""
    return looked_up(F.trim(status), SECTION_OF, section)


def evidence_note(layers: Column, platforms: Column, heat: Column, feeling: Column) -> Column:
    known = lambda c: ~F.trim(F.coalesce(c, F.lit(""))).isin("", "-")
    return F.concat_ws(
        " · ",
        F.when(known(layers), F.concat(F.lit("层级 "), F.trim(layers))),
        F.when(platforms > 0, F.concat(platforms.cast("string"), F.lit(" 个来源"))),
        F.when(known(heat), F.trim(heat)),
        F.when(feeling, "情绪聚集"),
    )


def overview_sentence(anomalies: Column, cross_layer: Column, chinese_only: Column, high_heat: Column, silence_gap: Column, suppressed: Column) -> Column:
    """The day in one sentence, from counts alone."""
    named = [(cross_layer, " 个多层来源呼应"), (chinese_only, " 个中文源内部升温"), (high_heat, " 个社交平台单点高热"), (silence_gap, " 个背景源热、社交端静")]
    found = F.concat_ws("、", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(name))) for n, name in named])
    found = F.when(found == "", "未发现达到异常阈值的主信号").otherwise(found)
    rest = F.when(suppressed > 0, F.concat(F.lit("；另有 "), suppressed.cast("string"), F.lit(" 个非重点项已折叠"))).otherwise("")
    return F.concat(F.lit("今日识别 "), F.coalesce(anomalies, F.lit(0)).cast("string"), F.lit(" 个异常信号："), found, rest, F.lit("。"))


def sample_summary(title: Column, source: Column, tier: Column, rank: Column, seen_at: Column, excerpt: Column) -> Column:
    """What one piece of evidence supports: the place on a list for tier D, else the source's own words."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    head, name = text(title), F.when(text(source) == "", "未知来源").otherwise(text(source))
    subject = F.when(head == "", "相关内容").otherwise(F.concat(F.lit("“"), head, F.lit("”相关内容")))
    where = F.when(rank > 0, F.concat(F.lit("进入"), name, F.lit("榜单第"), rank.cast("string"), F.lit("名"))).otherwise(F.concat(F.lit("出现在"), name, F.lit("榜单中")))
    when = F.when(text(seen_at) == "", "").otherwise(F.concat(F.lit("，观测时间为"), text(seen_at)))
    on_list = F.concat(subject, where, when, F.lit("。采集记录未附来源正文，因此无法补充标题之外的信息。"))
    words = F.concat(name, F.lit("的来源摘录显示，"), text(excerpt), F.when(text(excerpt).rlike("[。.!！？?…]$"), "").otherwise("。"))
    record = F.when(head == "", "一条未提供标题的来源记录").otherwise(F.concat(F.lit("标题为『"), head, F.lit("』的来源记录")))
    bare = F.concat(name, F.lit("出现"), record, F.lit("。采集记录未附正文摘录。"))
    return F.when(F.coalesce(tier, F.lit("")) == "D", on_list).when(text(excerpt) != "", words).otherwise(bare)


def topic_summary(section: Column, status: Column, topic: Column, heat: Column, titles: Column) -> Column:
    """A topic's summary without a model: how far a heated one spread, else its first titles."""
    name, spread = display_topic(topic), F.trim(F.coalesce(heat, F.lit("")))
    shown = F.filter(F.array_distinct(F.transform(titles, without_urls)), lambda t: t != "")
    quoted = F.array_join(F.transform(F.slice(shown, 1, 2), lambda t: F.concat(F.lit("“"), t, F.lit("”"))), "；")
    where = F.when(spread.isin("", "-"), "形成高热传播").otherwise(F.concat(F.lit("进入"), spread))
    heated = F.concat(F.lit("“"), name, F.lit("”"), where, F.lit("；目前只能确认传播热度，不能据此确认标题中的说法。"))
    own = F.trim(F.coalesce(status, F.lit("")))
    is_heated = F.when(own != "", own == "高热待核实").otherwise(section == "high_heat_unverified")
    several = F.concat(F.lit("当前可核对的标题包括"), quoted, F.lit("；它们可能指向不同事件。"))
    one = F.concat(F.lit("当前可核对的标题为"), quoted, F.lit("。"))
    return F.when(is_heated & (name != ""), heated).when(F.size(shown) > 1, several).when(F.size(shown) == 1, one).otherwise("")
