"""Filters over notes and tasks as Column factories: one source for every query that filters.

LIKE-style matches ignore ASCII case only; equality is exact; a null never matches.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATUSES = ("todo", "in_progress", "done", "cancelled")
PRIORITIES = ("highest", "high", "medium", "low", "lowest")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_folder(path: Column, folder: str, recursive: bool = True) -> Column:
    """Paths below a folder, at segment borders; trailing slashes of folder are ignored."""
    head = folder.rstrip("/").translate(str.maketrans(UPPER, LOWER)) + "/"
    below = F.startswith(ascii_lower(path), F.lit(head))
    return below if recursive else below & ~F.contains(F.substr(path, F.lit(len(head) + 1)), F.lit("/"))


def has_tag(tags: Column, tag: str, exact: bool = False) -> Column:
    """The tag itself (its case counts) or, unless exact, one below it (its case does not)."""
    if exact:
        return F.array_contains(tags, tag)
    head = tag.translate(str.maketrans(UPPER, LOWER)) + "/"
    return F.exists(tags, lambda t: (t == tag) | F.startswith(ascii_lower(t), F.lit(head)))


def has_all(values: Column, wanted: Iterable[str]) -> Column:
    return all_of(F.array_contains(values, w) for w in wanted)


def property_equals(properties: Column, key: str, value: str | int | float | bool) -> Column:
    """A top-level property equal in type and value."""
    kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "double"
    types = {"boolean": ["BOOLEAN"], "string": ["STRING"], "double": ["BIGINT", "DOUBLE", "FLOAT"]}[kind]
    found = F.try_variant_get(properties, path_of(key), "variant")
    shape = F.schema_of_variant(found)
    right = shape.isin(types) if kind != "double" else shape.isin(types) | shape.startswith("DECIMAL")
    return F.coalesce(right & (F.try_variant_get(properties, path_of(key), kind) == F.lit(value)), F.lit(False))


def path_of(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def as_text(value: Column) -> Column:
    """A variant scalar as text, true and false as 1 and 0; nested values as JSON, null as null."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "1").otherwise("0")).when(kind.isin("VOID"), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def property_has(properties: Column, key: str, value: str) -> Column:
    """A scalar property equal to value as text, or a list property with such an element."""
    one = F.try_variant_get(properties, path_of(key), "variant")
    many = F.try_variant_get(properties, path_of(key), "array<variant>")
    return F.coalesce(F.when(F.schema_of_variant(one).startswith("ARRAY"), F.exists(many, lambda v: as_text(v) == value)).otherwise(as_text(one) == value), F.lit(False))


def calendar_day(text: str) -> str:
    """text, if it is a valid yyyy-MM-dd; else ValueError."""
    if len(text) != 10 or datetime.date.fromisoformat(text).isoformat() != text:
        raise ValueError(f"not a calendar day: {text!r}")
    return text


def day_bounds(day: Column, bounds: Mapping[str, str]) -> Column:
    """before and after exclude the day, on is the day."""
    test = {"before": lambda d: day < d, "after": lambda d: day > d, "on": lambda d: day == d}
    return all_of(test[k](calendar_day(v)) for k, v in bounds.items())


def modified_bounds(mtime_ms: Column, bounds: Mapping[str, str]) -> Column:
    """The same over epoch milliseconds, days being local to the session's time zone."""

    def start(day: str, plus: int = 0) -> Column:
        return F.unix_millis(F.to_timestamp(F.date_add(F.lit(calendar_day(day)).cast("date"), plus))).cast("double")

    test = {"before": lambda d: mtime_ms < start(d), "after": lambda d: mtime_ms >= start(d, 1), "on": lambda d: (mtime_ms >= start(d)) & (mtime_ms < start(d, 1))}
    return all_of(test[k](v) for k, v in bounds.items())


def statuses(wanted: Iterable[str]) -> list[str]:
    """not_done and all stand for several statuses; each once."""
    out: list[str] = []
    for w in wanted:
        out += {"not_done": ["todo", "in_progress"], "all": list(STATUSES)}.get(w, [w])
    return list(dict.fromkeys(out))


def has_priority(priority: Column, wanted: Iterable[str]) -> Column:
    """none stands for no priority."""
    wanted = list(wanted)
    named = priority.isin([w for w in wanted if w != "none"])
    return F.coalesce(named, F.lit(False)) | priority.isNull() if "none" in wanted else named


def visible(path: Column) -> Column:
    """No segment of the path begins with a dot."""
    return ~F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def limit_of(n: float) -> int:
    return max(0, int(n // 1))
