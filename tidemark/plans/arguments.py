"""Arguments of queries: dates, ranges, limits, words, sources, and plans of the day."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from tidemark.functions.moments import named_range

RELATIVE = {"today": 0, "今天": 0, "yesterday": 1, "昨天": 1, "前天": 2, "the day before yesterday": 2, "大前天": 3}
WEEKDAYS = {n: i for i, ns in enumerate(["monday 一", "tuesday 二", "wednesday 三", "thursday 四", "friday 五", "saturday 六", "sunday 日 天"]) for n in ns.split()}


def day_of(text: str, today: date) -> date:
    """A day by name, distance, weekday or date; without a year the last such day that isn't in a later month."""
    t = text.strip().lower()
    if t in RELATIVE:
        return today - timedelta(days=RELATIVE[t])
    if m := re.fullmatch(r"(\d+)\s*(?:days? ago|天前)", t):
        if int(m[1]) > 365:
            raise ValueError("at most 365 days ago")
        return today - timedelta(days=int(m[1]))
    if m := re.fullmatch(r"(last|this)?\s*([a-z]+)", t) or re.fullmatch(r"(上周|本周|这周|周|星期|上星期)([一二三四五六日天])", t):
        if m[2] in WEEKDAYS:
            monday = today - timedelta(days=today.weekday())
            if m[1] in ("last", "上周", "上星期"):
                monday -= timedelta(days=7)
            found = monday + timedelta(days=WEEKDAYS[m[2]])
            return found if m[1] in ("last", "上周", "上星期", "this", "本周", "这周") or found <= today else found - timedelta(days=7)
    if m := re.fullmatch(r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?", t):
        return date(int(m[1]), int(m[2]), int(m[3]))
    if m := re.fullmatch(r"(\d{1,2})[-/月](\d{1,2})日?", t):
        year = today.year - 1 if int(m[1]) > today.month else today.year
        return date(year, int(m[1]), int(m[2]))
    raise ValueError(f"no date: {text!r}")


def range_of(value: dict | str | None, today: date, longest: int | None = None) -> tuple[date, date]:
    """(start, end) of a dict, its JSON, a named range or a day; inverted, future and too long ranges are errors."""
    if isinstance(value, str) and value.strip().startswith("{"):
        value = json.loads(value)
    if isinstance(value, dict):
        start, end = day_of(value["start"], today), day_of(value.get("end", value["start"]), today)
    elif value is None:
        start = end = today
    else:
        try:
            start, end = named_range(value.strip().lower().replace(" ", "_"), today)
        except ValueError:
            start = end = day_of(value, today)
    if start > end:
        raise ValueError("the range ends before it starts")
    if end > today:
        raise ValueError("the range ends in the future")
    if longest and (end - start).days + 1 > longest:
        raise ValueError(f"at most {longest} days")
    return start, end


def limit_of(value: int | str | None, default: int = 50, most: int = 1000) -> int:
    if value is None:
        return default
    n = int(value)
    if not 1 <= n <= most:
        raise ValueError(f"a limit is 1 to {most}")
    return n


def threshold_of(value: float | str | None, default: float, low: float = 0.0, high: float = 1.0) -> float:
    x = default if value is None else float(value)
    if not low <= x <= high:
        raise ValueError(f"a threshold is {low} to {high}")
    return x


def word_of(value: str) -> str:
    word = (value or "").strip()
    if not word or len(word) > 100:
        raise ValueError("a word has 1 to 100 characters")
    return word


def sources_of(value: list[str] | str | None, configured: list[str]) -> list[str]:
    """Sources as a list, its JSON or text with commas; unknown ones are errors, none means all."""
    if isinstance(value, str):
        value = json.loads(value) if value.strip().startswith("[") else [x.strip() for x in value.split(",") if x.strip()]
    if not value:
        return list(configured)
    if unknown := [x for x in value if x not in configured]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return list(value)


@dataclass(frozen=True)
class Period:
    name: str
    start: str
    end: str

    def _pieces(self) -> list[tuple[str, str]]:
        if self.start == self.end:
            return []
        return [(self.start, self.end)] if self.start < self.end else [(self.start, "24:00"), ("00:00", self.end)]

    def holds(self, clock: str) -> bool:
        return any(a <= clock < b for a, b in self._pieces())

    def overlaps(self, other: Period) -> bool:
        return any(a < d and c < b for a, b in self._pieces() for c, d in other._pieces())


def settings_at(now: datetime, default: dict, plans: dict[str, list[Period]], week: dict[int, str], own: dict[str, dict], last_wins: bool = False) -> dict:
    """Settings of the period that holds now in the plan of its weekday, over the default; overlaps are errors or the last wins."""
    active = [p for p in plans.get(week.get(now.weekday(), ""), []) if p.holds(now.strftime("%H:%M"))]
    if len(active) > 1 and not last_wins:
        raise ValueError(f"periods overlap: {', '.join(p.name for p in active)}")
    return {**default, "period": active[-1].name, **own.get(active[-1].name, {})} if active else {**default, "period": None}


def heartbeat(text: str | None, now: int, started: int, longest: int, skew: int = 300) -> str:
    """missing, invalid, future, before_start, stale or fresh, in this order."""
    if text is None:
        return "missing"
    if not re.fullmatch(r"\s*\d+\s*", text):
        return "invalid"
    at = int(text)
    if at > now + skew:
        return "future"
    if at < started:
        return "before_start"
    return "stale" if now - at > longest else "fresh"


def clock(text: str) -> time:
    return datetime.strptime(text.replace("-", ":"), "%H:%M").time()
