"""Names of competitive games in titles: fixed values, and what has to stand around and beside them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import IDEOGRAPH


@dataclass(frozen=True)
class Names:
    """Names that tell of a subject where none of not_before and not_after touches them, and, if beside isn't empty, where
    the text has words of one of those lists too. lead is a pattern before each name; exact names keep their case."""

    names: str
    not_before: str = ""
    not_after: str = ""
    lead: str = ""
    beside: tuple[str, ...] = ()
    exact: bool = False

    def pattern(self) -> str:
        before = f"(?<![{self.not_before}])" if self.not_before else ""
        after = f"(?!{self.not_after})" if self.not_after else ""
        each = f"{self.lead}(?:{'|'.join(map(re.escape, self.names.split()))})"
        first = "" if self.lead else f"(?=[{''.join(sorted({re.escape(n[0]) for n in self.names.split()}))}])"  # most places end here
        return f"{'(?:' if self.exact else '(?i:'}{first}{before}{each}{after})"


LETTERS, LETTERS_AND_DIGITS = "a-z", "a-z0-9"

#: Names by what surrounds them.
GAMES = [
    Names("电竞 英雄联盟 王者荣耀 无畏契约 德玛西亚杯 德杯 进化者杯 上海冠军赛 上海全球冠军赛 全球总决赛 数据雷达图 赛后数据 S赛 IEM北京 Major重返 Major落地"),
    Names("LPL LCK LEC KPL VCT VCTCN IVL HLTV CSGO CS2 DOTA DOTA2", not_before=LETTERS, not_after="[a-z]"),
    Names("全球 赛 决赛 瑞士轮 淘汰赛 应援 全赛区 开赛", not_before=LETTERS_AND_DIGITS, lead=r"S\d{1,2}"),
    Names("Major", lead=r"CS\s*"),
    Names(
        "上海EDG.M 广州TTG 重庆狼队 长沙TES.A 北京WB FPX.ZQ LGDNBW EDGM 100T Vitality MOUZ NAVI GenG TYLOO FaZe TLAW MKOI WSIG",
        not_before=LETTERS_AND_DIGITS,
        not_after="[a-z]",
    ),
    Names("KSG BLG KBG LGD TES EDG JDG HLE PRX MVK BFX MRC T1 G2 C9", not_before=LETTERS_AND_DIGITS, not_after=r"[a-z0-9]|-\d"),
    Names("Faker donk NiKo Kyxsan Zuian Daeny Jinggg Smoggy happywei", not_before=LETTERS_AND_DIGITS, not_after="[a-z]"),
    Names("管泽元 Bin哥 宁王 一诺状态 369回国 369紧急 369出征 滔搏 CS主播茄子 Shy粉 1酱赛评 1酱评"),
    Names(
        "IG iG AL WE KC GE NS KT DK VIT RED AQ GEN MSI Spirit NRG LOUD FLY FUR Falcons",
        not_before=LETTERS_AND_DIGITS,
        not_after="[a-z]",
        beside=("contest",),
        exact=True,
    ),
    Names("Knight Viper Elk Canyon nobody", not_before=LETTERS_AND_DIGITS, not_after="[a-z]", beside=("contest", "playing")),
]
#: Words that settle names which mean something else too; a result such as 3:1 tells of a contest as well.
BESIDE = {
    "contest": r"(?i)vs\b|[0-5]\s*[:：-]\s*[0-5]|" + "|".join("对战 对阵 迎战 战胜 击败 夺冠 冠军 出征 赛 淘汰 横扫 零封 力克 取胜 晋级 队服 队友 地图 葬送 拿下".split()),
    "playing": "|".join("状态 开播 首播 选手 战队 队友 赛区 电竞".split()),
}


def _parts(table: list[Names], ideographs: bool) -> list[Names]:
    """The rows with those of their names that have Chinese characters, or with the others."""
    kept = [(row, [n for n in row.names.split() if bool(re.search(IDEOGRAPH, n)) == ideographs]) for row in table]
    return [replace(row, names=" ".join(names)) for row, names in kept if names]


def _one_of(rows: list[Names]) -> str:
    """The rows as one pattern. Those that no letter may stand before ask for that once, which most places of a text fail."""
    bounded, free = ["|".join(r.pattern() for r in rows if r.not_before.startswith(LETTERS) == b) for b in (True, False)]
    return "|".join(p for p in (bounded and f"(?<![{LETTERS}])(?:{bounded})", free) if p)


def named(text: Column, table: list[Names] = GAMES, beside: dict[str, str] = BESIDE) -> Column:
    """Whether a text has a name of the table. Names with the same words beside them are one condition.

    They are one pattern, and one for names with Chinese characters, which only texts with such characters are asked for.
    """
    found = F.lit(False)
    for words in dict.fromkeys(row.beside for row in table):
        rows = [row for row in table if row.beside == words]
        any_name = F.lit(False)
        for ideographs in (False, True):
            parts = _parts(rows, ideographs)
            if pattern := _one_of(parts):
                any_name = any_name | ((text.rlike(IDEOGRAPH) & text.rlike(pattern)) if ideographs else text.rlike(pattern))
        settled = F.lit(not words)
        for word in words:
            settled = settled | text.rlike(beside[word])
        found = found | (any_name & settled)
    return found
