"""Edits of notes as pure functions of a text; apply them with apply_edit over a table of notes."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.functions import markdown as M


def section(lines: list[str], heading: str, level: int | None = None) -> dict:
    """The one heading of that text (and level); none or several is an error."""
    found = [h for h in M.headings(lines) if h["text"] == heading and level in (None, h["level"])]
    if len(found) != 1:
        raise ValueError(f"{len(found)} headings {heading!r}")
    return found[0]


def patch(text: str, heading: str, content: str, how: str = "append", level: int | None = None) -> str:
    """append or prepend to a section's body, replace it, or insert_before its heading."""
    lines = M.lines_of(text)
    h = section(lines, heading, level)
    new = content.strip("\n").split("\n")
    a, b = h["body_start"], h["body_end"]
    while b > a and not lines[b - 1].strip():
        b -= 1
    if how == "append":
        out = lines[:b] + new + lines[b:]
    elif how == "prepend":
        out = lines[:a] + new + lines[a:]
    elif how == "replace":
        child = next((x for x in M.headings(lines) if a <= x["start"] < b), None)
        if child and not any(M.ATX.match(x) for x in new):
            raise ValueError(f"the section holds the heading {child['text']!r}")
        out = lines[:a] + new + lines[b:]
    elif how == "insert_before":
        out = lines[: h["start"]] + new + [""] + lines[h["start"] :]
    else:
        raise ValueError(how)
    return "\n".join(out)


def replace(text: str, old: str, new: str, every: bool = False) -> str:
    """The first or every occurrence; where text is taken out, at most one blank line stays."""
    if old not in text:
        raise ValueError("text to replace not found")
    out = text.replace(old, new) if every else text.replace(old, new, 1)
    return re.sub(r"\n{3,}", "\n\n", out) if not new else out


def delete_span(text: str, first: str, last: str) -> str:
    """Without what lies from one anchor through the other; each must occur once, in order."""
    if text.count(first) != 1 or text.count(last) != 1:
        raise ValueError("an anchor must occur exactly once")
    a, b = text.index(first), text.index(last) + len(last)
    if b <= a:
        raise ValueError("the last anchor stands before the first")
    return re.sub(r"\n{3,}", "\n\n", text[:a] + text[b:])


def update_task(text: str, line: int, status: str, day: str | None = None) -> str:
    """Sets the status of the task on a line (from 1), and stamps or takes off its closing date."""
    lines = M.lines_of(text)
    found = M.task(lines[line - 1]) if 0 < line <= len(lines) else None
    if found is None:
        raise ValueError(f"no task on line {line}")
    char = {"todo": " ", "in_progress": "/", "done": "x", "cancelled": "-"}[status]
    new = re.sub(r"\[.\]", f"[{char}]", lines[line - 1], count=1)
    new = re.sub(r" ?(?:✅|❌)️? *\d{4}-\d{2}-\d{2}", "", new)
    if day and status in ("done", "cancelled"):
        sign = {"done": "✅", "cancelled": "❌"}[status]
        block = re.search(r" \^[a-zA-Z0-9-]+$", new)
        at = block.start() if block else len(new)
        new = f"{new[:at].rstrip()} {sign} {day}{new[at:]}"
    lines[line - 1] = new
    return "\n".join(lines)


def add_entry(text: str, heading: str, day: str, entry: str) -> str:
    """A dated bullet, newest first, in its section, which is made if it is missing; an entry that is there stays alone."""
    bullet = f"- **{day}**: {entry}"
    if bullet in M.lines_of(text):
        return text
    lines = M.lines_of(text)
    found = [h for h in M.headings(lines) if h["level"] == 2 and h["text"] == heading]
    if not found:
        return text.rstrip("\n") + f"\n\n## {heading}\n\n{bullet}\n"
    at = found[0]["body_start"]
    while at < found[0]["body_end"] and not lines[at].strip():
        at += 1
    return "\n".join(lines[:at] + [bullet] + lines[at:])


def relinked(text: str, moves: dict[str, str]) -> str:
    """Link targets changed as moves says; aliases, headings and everything else stay."""

    def wiki(m: re.Match) -> str:
        target = re.split(r"[|#\\]", m[2])[0]
        return m[0] if target.strip() not in moves else f"{m[1]}{moves[target.strip()]}{m[2][len(target):]}]]"

    def plain(m: re.Match) -> str:
        target = re.split("#", m[2])[0]
        new = moves.get(M.unquote(target))
        return m[0] if new is None else f"{m[1]}{new.replace(' ', '%20')}{m[2][len(target):]})"

    code = M.in_code(M.lines_of(text))
    return "\n".join(x if c else re.sub(r"(\]\()([^)\s]+)\)", plain, re.sub(r"(\[\[)([^\]]+)\]\]", wiki, x)) for x, c in zip(M.lines_of(text), code, strict=True))


def safe_path(path: str) -> str:
    """path, if it is relative, visible and stays inside the folder."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", "..") or p.startswith(".") for p in parts) or re.search(r"[\x00-\x1f\x7f]", path):
        raise ValueError(f"path not allowed: {path!r}")
    return path


def apply_edit(notes: DataFrame, edit: Callable[[str], str], text: str = "content") -> DataFrame:
    """notes with the text edited; error holds why an edit was refused, and then the text stays."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(t):
            try:
                return edit(t), None
            except ValueError as e:
                return t, str(e)

        return pd.DataFrame([one(t) for t in texts], columns=["text", "error"])

    return notes.withColumn("_edit", run(F.coalesce(text, F.lit("")))).withColumn(text, F.col("_edit.text")).withColumn("error", F.col("_edit.error")).drop("_edit")
