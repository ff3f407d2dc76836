"""Expressions over raw items and records: dates, numbers, identities, money, classes of errors, and lines of text."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST = "2010-01-01"


def first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def when_posted(value: Column) -> Column:
    """A time from ISO text (Z too), or from digits: seconds, milliseconds beyond 1e12; else null."""
    digits = F.when(value.rlike(r"^\d+$"), value.try_cast("long"))
    seconds = F.when(digits > 10**12, F.floor(digits / 1000)).otherwise(digits)
    return F.coalesce(F.timestamp_seconds(seconds), F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(value, "Z$", "+00:00").try_cast("timestamp")))


def sane_date(value: Column, now: Column) -> Column:
    """A posting time between 2010 and now, else null."""
    at = when_posted(value)
    return F.when((at >= F.lit(EARLIEST).cast("timestamp")) & (at <= now), at)


def window_seconds(value: Column) -> Column:
    """Seconds of a span such as "12 hours"; null where the unit is unknown."""
    number = F.regexp_extract(value, r"^\s*(\d+)", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(value), r"^\s*\d+\s*([a-z]+?)s?\s*$", 1)
    each = F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800)
    return number * each


def content_key(*parts: Column) -> Column:
    """Name of what a post is about: 32 hex digits, '' where every part is empty."""
    plain = [F.coalesce(F.lower(F.trim(p)), F.lit("")) for p in parts]
    return F.when(F.concat(*plain) == "", F.lit("")).otherwise(F.substring(F.sha1(F.concat_ws("|", *plain).cast("binary")), 1, 32))


def short_hash(value: Column, size: int) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, size)


# Units behind a number, and beginnings of words for members.
UNITS = {
    1_000: ("k", "tys", "tysiąc", "tysiące", "tysięcy", "tyś", "tis", "tisíc", "tisic", "tsd", "tausend"),
    1_000_000: ("m", "mln", "mil", "milion", "miliony", "milionów", "mio"),
}
MEMBER_WORDS = ("człon", "czlon", "member", "mitglied", "člen", "clen", "osób")


def humanised(value: Column) -> Column:
    """The number of members in a text such as "3 posts a day, 12,5 tys. members".

    The first number with a unit of thousands or millions, or with a word for members
    in or behind the word at it; else the largest number; null without any.  A comma,
    dot or blank before three digits parts thousands; a unit is a whole word.
    """
    low = F.regexp_replace(F.lower(value), r"(?<=\d)[., \x{A0}](?=\d{3}(?!\d))", "")
    parts = [F.regexp_extract_all(low, F.lit(r"(\d+(?:[.,]\d+)?)\s*(\p{L}*)(?=([^\d]{0,16}))"), F.lit(k)) for k in (1, 2, 3)]

    def one(x: Column) -> Column:
        number = F.regexp_replace(x["0"], ",", ".").try_cast("double")
        unit = F.coalesce(*(F.when(x["1"].isin(*words), F.lit(n)) for n, words in UNITS.items()))
        said = unit.isNotNull() | F.concat(x["1"], x["2"]).rlike("|".join(MEMBER_WORDS))
        # Rounded first: 1.1 thousand is 1100, whatever its binary form.
        return F.struct(F.floor(F.round(number * F.coalesce(unit, F.lit(1)), 6)).cast("long").alias("n"), said.alias("said"))

    found = F.transform(F.arrays_zip(*parts), one)
    return F.coalesce(F.get(F.filter(found, lambda x: x["said"]), F.lit(0))["n"], F.array_max(F.transform(found, lambda x: x["n"])))


def error_class(message: Column, status: Column) -> Column:
    """What a failed call means: by words, then by status, then by other words."""
    low = F.lower(message)
    return (
        F.when(low.contains("quota") | low.contains("limit exceeded"), "exhausted")
        .when(status.isin(401, 403), "denied").when(status == 429, "throttled").when(status >= 500, "server")
        .when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("other")
    )


def first_class(text: Column, classes: dict[str, str], default: str) -> Column:
    """The first class whose pattern is found."""
    out = F
    for name, pattern in classes.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a noun behind a number in Polish."""
    return F.when(n == 1, one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*\[\]()~`>#+=|{}.!-])", r"\\$1")


def split_list(value: Column) -> Column:
    return F.filter(F.split(value, r"[\s,;]+"), lambda x: x != "")


def started_minutes(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("long")


def joined_notes(*notes: Column) -> Column:
    """Notes that are there, in a row."""
    return F.array_join(F.array_compact(F.array(*notes)), "; ")


def url_identity(url: Column) -> Column:
    """Scheme, host, port and path, without user and password."""
    return F.regexp_replace(F.regexp_replace(url, r"^([a-z]+://)[^/@]*@", "$1"), r"[?#].*$", "")


def url_label(url: Column) -> Column:
    """Host and the first part of the path; the rest as an ellipsis."""
    found = F.regexp_extract(url, r"^[a-z]+://([^/?#]+(?:/[^/?#]+)?)", 1)
    return F.when(F.length(url) > F.length(found) + F.length(F.regexp_extract(url, r"^([a-z]+://)", 1)) + 1, F.concat(found, F.lit("/…"))).otherwise(found)


def caption(head: Column, quote: Column, most: int = 1024, least: int = 60) -> Column:
    """Head and quote in ``most`` characters: only the quote shrinks, down to ``least``, below which it goes."""
    room = F.lit(most) - F.length(head) - 1
    cut = F.concat(F.substring(quote, F.lit(1), F.greatest(room - 1, F.lit(0))), F.lit("…"))
    return F.when(F.length(quote) <= room, F.concat_ws("\n", head, quote)).when(room >= least, F.concat_ws("\n", head, cut)).otherwise(F.substring(head, 1, most))


def endpoints_link(lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    """A map link; the way point only where both ends are known."""
    here, there = F.concat_ws(",", lat.cast("string"), lng.cast("string")), F.concat_ws(",", to_lat.cast("string"), to_lng.cast("string"))
    return F.when(lat.isNotNull() & to_lat.isNotNull(), F.concat(F.lit("https://maps.example/dir/"), here, F.lit("/"), there)).when(
        lat.isNotNull() | to_lat.isNotNull(), F.concat(F.lit("https://maps.example/at/"), F.when(lat.isNotNull(), here).otherwise(there))
    )


def any_set(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])


def place_label(name: Column, sure: Column, found: Column) -> Column:
    """A place with a mark where it is uncertain or was not recognised."""
    return F.when(name.isNull(), "?").when(~found, F.concat(name, F.lit(" (unknown)"))).when(~sure, F.concat(name, F.lit(" (?)"))).otherwise(name)


def usage_line(used: Column, limit: Column, warn: int = 90) -> Column:
    """Used of limit with per cent, marked from ``warn`` on; without a limit the use alone."""
    percent = F.round(F.try_divide(100 * used, limit)).cast("long")
    line = F.concat(used.cast("string"), F.lit(" / "), limit.cast("string"), F.lit(" ("), percent.cast("string"), F.lit(" %)"))
    return F.when(limit.isNull() | (limit == 0), used.cast("string")).otherwise(F.concat(F.when(percent >= warn, "! ").otherwise(""), line))


def _breadth_first(text: str | None, wanted: Callable[[dict], object]):
    """What ``wanted`` finds in the objects of a JSON text, level by level and in the order written; None without any."""
    try:
        queue = deque([json.loads(text)] if text else [])
    except ValueError:
        return None
    while queue:
        node = queue.popleft()
        if isinstance(node, dict):
            found = wanted(node)
            if found is not None:
                return found
            queue.extend(node.values())
        elif isinstance(node, list):
            queue.extend(node)
    return None


def number_anywhere(value: Column, names: list[str]) -> Column:
    """The first number under one of the names at any depth of a JSON text: the least deep, then as written; booleans are no numbers.

    Objects keep the order of their keys, which no built-in type of nested values does.
    """

    def wanted(node: dict) -> float | None:
        return next((float(node[n]) for n in names if isinstance(node.get(n), (int, float)) and not isinstance(node[n], bool)), None)

    @F.pandas_udf("double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_breadth_first(x, wanted) for x in texts], dtype="float64")

    return found(value)


def text_anywhere(value: Column, name: str) -> Column:
    """The first text that is not blank under a name at any depth of a JSON text; '' without one."""

    def wanted(node: dict) -> str | None:
        found = node.get(name)
        return found if isinstance(found, str) and found.strip() else None

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_breadth_first(x, wanted) or "" for x in texts], dtype=object)

    return found(value)
