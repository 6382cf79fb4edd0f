"""Keyword rules: a small text format, and its meaning as columns.

Groups are parted by empty lines. A line is a word; /pattern/ a regular expression, +word required, !word a filter
that holds for all groups, @3 the most titles that the group shows, # a comment, and 'word => shown' a word with another
name; [name] in the first line is the group's name. From a first line [GLOBAL_FILTER], in any case, to [WORD_GROUPS]
each line is a plain text that rules a title out before anything else; lines with +, ! or @ are skipped there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL, GROUPS = "GLOBAL_FILTER", "WORD_GROUPS"


@dataclass(frozen=True)
class Word:
    text: str
    is_pattern: bool = False
    shown: str | None = None

    def occurs(self, low: Column) -> Column:
        """low is the title in lower case. A pattern that Spark's engine refuses is taken as plain text."""
        pattern = runnable(self.text) if self.is_pattern else None
        return low.contains(self.text.lower()) if pattern is None else low.rlike(pattern)

    def in_sql(self, low: str) -> str:
        """The same for other SQL engines."""
        quoted = self.text.replace("'", "''")
        return f"regexp_matches({low}, '(?i){quoted}')" if self.is_pattern else f"contains({low}, '{quoted.lower()}')"


def runnable(pattern: str) -> str | None:
    """A pattern in the form that Spark's engine runs, without regard to case; None if it can't."""
    java = "(?iu)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError:
        return None
    return java


@dataclass
class Group:
    position: int
    name: str
    required: list[Word] = field(default_factory=list)
    normal: list[Word] = field(default_factory=list)
    most: int = 0

    def _meets(self, each, every, some):
        parts = [each(w) for w in self.required]
        if self.normal:
            parts.append(some([each(w) for w in self.normal]))
        return every(parts)

    def matches(self, low: Column) -> Column:
        """All required words, and one of the normal ones if there are any."""
        return self._meets(lambda w: w.occurs(low), lambda p: reduce(Column.__and__, p), lambda p: reduce(Column.__or__, p))

    def matches_sql(self, low: str) -> str:
        return self._meets(lambda w: w.in_sql(low), lambda p: "(" + " AND ".join(p) + ")", lambda p: "(" + " OR ".join(p) + ")")


@dataclass
class Rules:
    groups: list[Group]
    filters: list[Word]
    global_filters: list[Word]

    @property
    def ruling_out(self) -> list[Word]:
        """Words that rule a title out; without groups only the global ones."""
        return [*self.global_filters, *(self.filters if self.groups else [])]

    def passes(self, title: Column) -> Column:
        """Whether a title is not blank and no word that rules it out occurs in it."""
        low, ok = F.lower(title), title.rlike(r"(?U)\S")
        for w in self.ruling_out:
            ok = ok & ~w.occurs(low)
        return F.coalesce(ok, F.lit(False))

    def first_group(self, title: Column) -> Column:
        """Position of the first group in file order that matches; null where none does or a filter holds."""
        low, out = F.lower(title), F.lit(None).cast("int")
        for g in reversed(self.groups):
            out = F.when(g.matches(low), F.lit(g.position)).otherwise(out)
        return F.when(self.passes(title), out)

    def all_groups(self, title: Column) -> Column:
        """Positions of all groups that match, in file order."""
        low = F.lower(title)
        hits = F.array(*[F.when(g.matches(low), F.lit(g.position)) for g in self.groups])
        return F.when(self.passes(title), F.filter(hits, lambda p: p.isNotNull())).otherwise(F.array().cast("array<int>"))

    def matches(self, title: Column) -> Column:
        """Whether a title passes and is in some group; without groups all that pass match."""
        return self.passes(title) if not self.groups else self.passes(title) & self.first_group(title).isNotNull()

    def passes_sql(self, title: str) -> str:
        return " AND ".join([f"trim({title}) <> ''", *[f"NOT {w.in_sql(f'lower({title})')}" for w in self.ruling_out]])

    def first_group_sql(self, title: str) -> str:
        cases = " ".join(f"WHEN {g.matches_sql(f'lower({title})')} THEN {g.position}" for g in self.groups)
        return f"CASE WHEN {self.passes_sql(title)} THEN CASE {cases} END END"


def parse_word(line: str) -> Word:
    """A pattern that doesn't compile is taken as plain text."""
    text, _, shown = (x.strip() for x in line.partition("=>"))
    m = re.fullmatch(r"/(.+)/[a-z]*", text)
    if m:
        try:
            re.compile(m[1])
            return Word(m[1], True, shown or None)
        except re.error:
            pass
    return Word(text, False, shown or None)


def _heading(lines: list[str]) -> str | None:
    return lines[0][1:-1].strip() if lines and lines[0].startswith("[") and lines[0].endswith("]") else None


def _group(position: int, name: str | None, lines: list[str], filters: list[Word]) -> Group:
    group = Group(position, name or "")
    for line in lines:
        mark, rest = line[0], line[1:]
        if mark == "@":
            if re.fullmatch(r"\s*\+?0*[1-9][0-9]*\s*", rest):
                group.most = int(rest)
        elif mark in "!+":
            (filters if mark == "!" else group.required).append(parse_word(rest))
        else:
            group.normal.append(parse_word(line))
    group.name = group.name or " / ".join(w.shown or w.text for w in [*group.normal, *group.required])
    return group


def parse_rules(source: str) -> Rules:
    rules, section = Rules([], [], []), GROUPS
    for block in source.split("\n\n"):
        lines = [x for x in map(str.strip, block.split("\n")) if x and not x.startswith("#")]
        heading = _heading(lines)
        if heading is not None and heading.upper() in (GLOBAL, GROUPS):
            section, lines = heading.upper(), lines[1:]
        if section == GLOBAL:
            rules.global_filters += [Word(x) for x in lines if x[0] not in "!+@"]
            continue
        name = _heading(lines)
        if name is not None and name.upper() not in (GLOBAL, GROUPS):
            lines = lines[1:]
        else:
            name = None
        group = _group(len(rules.groups), name, lines, rules.filters)
        if group.required or group.normal:
            rules.groups.append(group)
    return rules
