"""JSON records of conversations: who speaks, what is said, when."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Fields that are read before the others of a record.
PREFERRED = "content text message prompt cwd command summary title role type timestamp created_at".split()
PAYLOAD_TEXTS = "content message text summary arguments".split()
MESSAGE_TEXTS = "content text message".split()
TIMES = "timestamp created_at createdAt time date".split()
#: Messages inside messages are looked into so deep.
DEPTH = 3


def _texts(x: object, silent: set[int]) -> Iterator[str]:
    """Texts of two characters and more, depth first, preferred fields first and then all; silent: parts without any."""
    if isinstance(x, str):
        if len(x.strip()) >= 2:
            yield x
    elif isinstance(x, (dict, list)) and id(x) not in silent:
        parts = x if isinstance(x, list) else [*(x[k] for k in PREFERRED if k in x), *x.values()]
        heard = False
        for part in parts:
            for text in _texts(part, silent):
                heard = True
                yield text
        if not heard:
            silent.add(id(x))


def texts_of(x: object, most: int = 12) -> list[str]:
    return list(islice(_texts(x, set()), most))


def _parsed(line: str | None) -> object:
    try:
        return json.loads(line) if line is not None else None
    except (ValueError, RecursionError):
        return line


@F.pandas_udf(ArrayType(StringType()))
def strings(lines: pd.Series) -> pd.Series:
    """The first 12 texts of each record; a line that isn't JSON is a text itself, a null one has none."""
    return lines.map(lambda line: texts_of(_parsed(line)))


@F.pandas_udf(ArrayType(StringType()))
def spoken(lines: pd.Series, roles: pd.Series) -> pd.Series:
    """What a record says: texts of its payload's or message's own fields, else of the whole; tools and systems say nothing."""

    def said(line: str | None, role: str | None) -> list[str]:
        record = _parsed(line)
        if not isinstance(record, dict):
            return texts_of(record)
        if role in ("system", "tool"):
            return []
        for inside, fields in (("payload", PAYLOAD_TEXTS), ("message", MESSAGE_TEXTS)):
            body = record.get(inside)
            if isinstance(body, dict):
                found = [t for f in fields if f in body for t in texts_of(body[f], 20)]
                if found or inside == "payload":
                    return found or texts_of(body, 20)
        return texts_of(record, 20)

    return pd.Series([said(*x) for x in zip(lines, roles, strict=True)], index=lines.index, dtype=object)


def role_of(record: Column, depth: int = DEPTH) -> Column:
    """user, assistant, tool, system or unknown, by the payload's role or type, the record's own, and its message's."""
    field = lambda path: F.nullif(F.get_json_object(record, path), F.lit(""))
    inner = F.lower(F.coalesce(field("$.payload.role"), field("$.payload.type"), field("$.payload.item_type")))
    own = F.lower(F.coalesce(field("$.role"), field("$.type")))
    found = (
        F.when(inner.contains("user"), "user")
        .when(inner.contains("assistant") | inner.contains("agent"), "assistant")
        .when(inner.rlike("function_call|tool|command"), "tool")
        .when(inner.rlike("developer|system"), "system")
        .when(own.contains("user") | (own == "human"), "user")
        .when(own.contains("assistant") | own.contains("agent"), "assistant")
        .when(own.rlike("tool|command"), "tool")
    )
    message = field("$.message")
    deeper = F.when(message.startswith("{"), role_of(message, depth - 1)) if depth else F.lit(None).cast("string")
    return F.coalesce(found, deeper, F.lit("unknown"))


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("number", DoubleType())])))
def _times(lines: pd.Series) -> pd.Series:
    def found(line: str | None) -> list[dict]:
        out, rest = [], [_parsed(line)]
        while rest:
            x = rest.pop()
            if isinstance(x, dict):
                at = [x[k] for k in TIMES if isinstance(x.get(k), (str, int, float)) and not isinstance(x.get(k), bool)]
                out += [{"text": t, "number": None} if isinstance(t, str) else {"text": None, "number": float(t)} for t in at]
                if len(out) < 3:
                    rest += reversed(x.values())
        return out

    return lines.map(found)


def moment_of(record: Column, otherwise: Column) -> Column:
    """The first usable time of a record; numbers over 1e10 are milliseconds. Without one, the other column's."""
    seconds = lambda t: F.when(t["number"] > 1e10, t["number"] / 1000).otherwise(t["number"])
    number = lambda t: F.when(F.abs(seconds(t)) < 2.5e11, F.timestamp_seconds(seconds(t)))
    text = lambda t: F.when(t["text"].rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t["text"]))
    usable = F.filter(F.transform(_times(record), lambda t: F.coalesce(number(t), text(t))), lambda t: t.isNotNull())
    return F.coalesce(F.get(usable, F.lit(0)), otherwise)


def pattern_hits(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of the patterns one of whose terms occurs in a text, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for name, terms in patterns.items():
        hit = F.lit(False)
        for term in terms:
            hit = hit | low.contains(term.lower())
        hits.append(F.when(hit, name))
    return F.array_compact(F.array(*hits))
