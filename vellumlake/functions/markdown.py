"""Grammars of notes: frontmatter, lines, headings, callouts, links, tasks, dated entries, canvases, chunks.

Each is a small pure function of one text, applied by the sources through Arrow
functions; nothing here knows Spark.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from urllib.parse import unquote

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def frontmatter(text: str) -> tuple[dict, str]:
    """(properties, body): a YAML block between --- lines at the top; not a mapping, or broken: no properties."""
    lines = lines_of(text)
    if not lines or lines[0].rstrip() != "---":
        return {}, text
    for i in range(1, len(lines)):
        if lines[i].rstrip() == "---":
            return yaml_mapping(lines[1:i]), "\n".join(lines[i + 1 :])
    return {}, text


def yaml_scalar(raw: str):
    """A plain or quoted scalar; dates and yes/no stay text."""
    raw = raw.strip()
    if raw[:1] == '"' and raw[-1:] == '"' and len(raw) > 1:
        try:
            return json.loads(raw)
        except ValueError:
            return raw[1:-1]
    if raw[:1] == "'" and raw[-1:] == "'" and len(raw) > 1:
        return raw[1:-1].replace("''", "'")
    raw = re.sub(r"\s+#.*$", "", raw)
    if raw in ("", "~", "null", "Null", "NULL"):
        return None
    if raw in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return raw.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", raw):
        return int(raw)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", raw):
        return float(raw)
    if raw[0] == "[" and raw[-1] == "]":
        return [yaml_scalar(x) for x in split_flow(raw[1:-1])]
    if raw[0] == "{" and raw[-1] == "}":
        return {k.strip(): yaml_scalar(v) for k, _, v in (x.partition(":") for x in split_flow(raw[1:-1]))}
    return raw


def split_flow(text: str) -> list[str]:
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not text[at:i].strip():
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x for x in [*out, text[at:]] if x.strip()]


def yaml_mapping(lines: list[str]) -> dict:
    """Block mappings and lists by indentation, flow lists and mappings, folded and literal texts: what frontmatter uses."""

    def block(i: int, indent: int):
        out: dict | list | None = None
        while i < len(lines):
            line = lines[i]
            if not line.strip() or line.lstrip().startswith("#"):
                i += 1
                continue
            here = len(line) - len(line.lstrip(" "))
            if here < indent:
                break
            body = line.strip()
            if body.startswith("- ") or body == "-":
                if out is None:
                    out = []
                if not isinstance(out, list):
                    break
                rest = body[1:].strip()
                if rest:
                    out.append(yaml_scalar(rest))
                    i += 1
                else:
                    item, i = block(i + 1, here + 1)
                    out.append(item)
                continue
            if isinstance(out, list):
                break
            m = re.match(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^:#]+?)\s*:(?:\s+(.*)|)$""", body)
            if not m:
                raise ValueError(line)
            out = {} if out is None else out
            key, rest = str(yaml_scalar(m[1])), (m[2] or "").strip()
            if rest[:1] in ("|", ">"):
                text, i = [], i + 1
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > here):
                    text.append(lines[i].strip())
                    i += 1
                out[key] = ("\n" if rest[0] == "|" else " ").join(text).strip()
            elif rest:
                out[key] = yaml_scalar(rest)
                i += 1
            else:
                j = i + 1
                while j < len(lines) and not lines[j].strip():
                    j += 1
                deeper = j < len(lines) and (len(lines[j]) - len(lines[j].lstrip(" ")) > here or lines[j].strip().startswith("- "))
                out[key], i = block(j, len(lines[j]) - len(lines[j].lstrip(" "))) if deeper else (None, i + 1)
        return out, i

    try:
        out, _ = block(0, 0)
    except (ValueError, RecursionError):
        return {}
    return out if isinstance(out, dict) else {}


def merged(old: dict, change: dict) -> dict:
    """old with change put in; a null takes its key out."""
    return {k: v for k, v in (old | change).items() if not (k in change and v is None)}


def in_code(lines: list[str]) -> list[bool]:
    """For each line whether it belongs to a fenced block or a %% comment %%."""
    out, fence, depth, comment = [], "", 0, False
    for line in lines:
        quote = re.match(r"^(?: {0,3}> ?)*", line)[0].count(">")
        body = re.sub(r"^(?: {0,3}> ?)*", "", line)
        if fence and quote < depth:
            fence = ""  # the quote that held the fence has ended
        m = FENCE.match(body)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip() and quote == depth:
                fence = ""
            continue
        if not comment and m and not (m[1][0] == "`" and "`" in m[2]):
            fence, depth = m[1], quote
            out.append(True)
            continue
        marks = line.count("%%")
        out.append(comment or (marks == 1))
        if marks % 2:
            comment = not comment
    return out


def headings(lines: list[str]) -> list[dict]:
    """level, text, start, body_start, body_end (lines from 0) of ATX and setext headings outside code and comments."""
    code, found = in_code(lines), []
    for i, line in enumerate(lines):
        if code[i]:
            continue
        if m := ATX.match(line):
            found.append({"level": len(m[1]), "text": (m[2] or "").strip(), "start": i, "body_start": i + 1})
        elif i and SETEXT.match(line) and lines[i - 1].strip() and not code[i - 1] and not re.match(r"^ {0,3}(?:#{1,6}[ \t]|>|[-*+][ \t]|\d+[.)][ \t]|\|)", lines[i - 1]) and not (found and found[-1]["body_start"] == i):
            found.append({"level": 1 if line.strip()[0] == "=" else 2, "text": lines[i - 1].strip(), "start": i - 1, "body_start": i + 1})
    for i, h in enumerate(found):
        h["body_end"] = next((x["start"] for x in found[i + 1 :] if x["level"] <= h["level"]), len(lines))
    return found


def leading_callout(body: str) -> dict | None:
    """type, title and body of a callout that opens the note, maybe after its first heading."""
    lines = lines_of(body)
    i = 0
    while i < len(lines) and (not lines[i].strip() or ATX.match(lines[i]) and not any(ATX.match(x) for x in lines[:i])):
        i += 1
    if i == len(lines) or not (m := re.match(r"^ {0,3}> ?\[!([^\]|]+)(?:\|[^\]]*)?\][+-]? ?(.*)$", lines[i])):
        return None
    inner = []
    for line in lines[i + 1 :]:
        if not re.match(r"^ {0,3}>", line):
            break
        inner.append(re.sub(r"^ {0,3}> ?", "", line))
    return {"type": m[1].strip().lower(), "title": m[2].strip(), "body": "\n".join(inner).strip()}


def shown(text: str) -> str:
    """Text with what links show in place of the links."""
    out, at = [], 0
    while (i := text.find("[", at)) >= 0:
        out.append(text[at:i])
        wiki, inline = text.find("]]", i + 2), text.find("](", i + 1)
        if text.startswith("[[", i) and wiki > i + 2 and "]" not in text[i + 2 : wiki]:
            target, _, label = text[i + 2 : wiki].partition("|")
            out.append(label or target)
            at = wiki + 2
        elif inline > i + 1 and "]" not in text[i + 1 : inline] and (end := text.find(")", inline + 2)) > inline + 2:
            out.append(text[i + 1 : inline])
            at = end + 1
        else:
            out.append("[")
            at = i + 1
    return "".join([*out, text[at:]])


def unmarked(text: str, mark: str) -> str:
    """Text without pairs of runs of an emphasis mark, three at most in a run."""
    run = lambda i: next((n for n in range(3) if text[i + n : i + n + 1] != mark), 3)
    out, at = [], 0
    while (i := text.find(mark, at)) >= 0:
        inner = i + run(i)
        end = text.find(mark, inner)
        if end <= inner:  # nothing between, or no second run
            out.append(text[at:inner])
            at = inner
        else:
            out += [text[at:i], text[inner:end]]
            at = end + run(end)
    return "".join([*out, text[at:]])


def unblocked(line: str) -> str:
    """A line without the marks of headings, their underlines, quotes and callouts."""
    bare = line.lstrip(" ")
    if len(line) - len(bare) < 4:
        head = bare.lstrip("#")
        if 0 < len(bare) - len(head) < 7 and head[:1] in ("", " ", "\t"):
            return head.lstrip(" \t")
        if bare and bare.strip(" \t") in (n * len(bare.strip(" \t")) for n in "=-") and bare[0] in "=-":
            return ""
    if line[:1] != ">":
        return line
    kind, closed, rest = line[1:].lstrip().partition("]")
    return rest.lstrip() if closed and kind.startswith("[!") else line[1:].removeprefix(" ")


def plain_text(text: str) -> str:
    """The words of a note: links as they show, no comments, marks or emphasis."""
    parts = text.split("%%")
    if len(parts) % 2 == 0:  # the last comment is open, so it is none
        parts[-2:] = ["%%".join(parts[-2:])]
    text = shown("".join(parts[::2]))
    for mark in "*_":
        text = unmarked(text, mark)
    return "\n".join(map(unblocked, text.split("\n")))


LEAST_WORDS, MOST_WORDS, WHOLE_WORDS = 50, 450, 500


def chunks(title: str, body: str) -> list[str]:
    """Pieces to embed, title first: the whole of a short note; else sections, small ones joined, large ones cut at paragraphs, then at words."""
    size = lambda t: len(t.split())
    plain = plain_text(body)

    def cut(text: str) -> list[str]:
        out: list[str] = []
        for paragraph in re.split(r"\n\n+", text):
            if out and size(out[-1]) + size(paragraph) <= MOST_WORDS:
                out[-1] += "\n\n" + paragraph
            else:
                out.append(paragraph)
        return [p for x in out for p in ([x] if size(x) <= MOST_WORDS else [" ".join(x.split()[i : i + MOST_WORDS]) for i in range(0, size(x), MOST_WORDS)])]

    lines = lines_of(body)
    heads = headings(lines)
    if size(plain) < WHOLE_WORDS:
        parts = [plain]
    elif not heads:
        parts = cut(plain)
    else:
        borders = [0, *(h["start"] for h in heads), len(lines)]
        sections = [plain_text("\n".join(lines[a:b])).strip() for a, b in zip(borders, borders[1:], strict=False)]
        joined: list[str] = []
        for text in sections:
            if not text:
                continue
            if joined and (size(joined[-1]) < LEAST_WORDS or size(text) < LEAST_WORDS):
                joined[-1] += "\n\n" + text
            else:
                joined.append(text)
        parts = [p for x in joined for p in cut(x)]
    return [f"{title}\n\n{p}".strip() for p in parts]


def link_targets(body: str) -> list[str]:
    """Distinct targets of wiki and Markdown links outside code, in order, without headings, aliases and outside addresses."""
    lines, out = lines_of(body), []
    for line, code in zip(lines, in_code(lines), strict=True):
        if code:
            continue
        line = re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", "", line)
        line = re.sub(r"<%.*?%>|\{\{.*?\}\}", "", line)
        for m in re.finditer(r"!?\[\[([^\]]+)\]\]|!?\[[^\]]*\]\(\s*<?([^)>\s]+)>?(?:\s+\"[^\"]*\")?\s*\)", line):
            if m[1] is not None:
                target = re.split(r"\\?\|", m[1])[0]
            else:
                target = unquote(m[2])
                if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", target):
                    continue
            target = re.split(r"[#^]", target)[0].strip()
            if target:
                out.append(target)
    return list(dict.fromkeys(out))


def property_links(value) -> list[str]:
    """Targets of wiki links anywhere in properties."""
    if isinstance(value, str):
        return [re.split(r"\\?\|", m)[0].split("#")[0].strip() for m in re.findall(r"\[\[([^\]]+)\]\]", value)]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [t for p in parts for t in property_links(p)]


#: Fixed values of the task grammar: signs and inline keys of each field.
TASK = re.compile(r"^[\s>]*(?:[-*+]|[0-9]+[.)]) +\[(.)\] *(.*)$")
DATES = {"done": ("✅", "completion"), "cancelled": ("❌", "cancelled"), "due": ("📅|📆|🗓", "due"), "scheduled": ("⏳|⌛", "scheduled"), "start": ("🛫", "start"), "created": ("➕", "created")}
PRIORITY = {"🔺": "highest", "⏫": "high", "🔼": "medium", "🔽": "low", "⏬": "lowest"}
OTHERS = {"recurrence": ("🔁", "repeat", r"[a-zA-Z0-9, !]+"), "on_completion": ("🏁", "onCompletion", r"[a-zA-Z]+"), "task_id": ("🆔", "id", r"[a-zA-Z0-9_-]+"), "depends_on": ("⛔", "dependsOn", r"[a-zA-Z0-9_-]+(?: *, *[a-zA-Z0-9_-]+ *)*")}
TAG = r"#[^ !@#$%^&*(),.?\":{}|<>]+"


def _field(signs: str, key: str, value: str) -> re.Pattern:
    return re.compile(rf"(?:(?:{signs})\ufe0f? *({value})|(?:\[ *{key}:: *({value}) *\]|\( *{key}:: *({value}) *\))(?: *,)?)\Z")


FIELDS = {k: _field(s, key, r"\d{4}-\d{2}-\d{2}") for k, (s, key) in DATES.items()} | {k: _field(s, key, v) for k, (s, key, v) in OTHERS.items()}
LEVEL = re.compile(r"(?:(🔺|⏫|🔼|🔽|⏬)\ufe0f?|(?:\[ *priority:: *(highest|high|medium|low|lowest) *\]|\( *priority:: *(highest|high|medium|low|lowest) *\))(?: *,)?)\Z")


def calendar(day: str) -> str | None:
    try:
        return day if datetime.date.fromisoformat(day).isoformat() == day else None
    except ValueError:
        return None


def task(line: str) -> dict | None:
    """The fields of one task line; they stand at its end, in any order."""
    m = TASK.match(line)
    if not m:
        return None
    out: dict = {"status_char": m[1], "status": {"x": "done", "X": "done", "-": "cancelled", "/": "in_progress"}.get(m[1], "todo"), "priority": None, "block_id": None, **dict.fromkeys([*DATES, *OTHERS]), "depends_on": []}
    rest = m[2].rstrip()
    if b := re.search(r" \^([a-zA-Z0-9-]+)\Z", rest):
        out["block_id"], rest = b[1], rest[: b.start()].rstrip()
    trailing: list[str] = []
    for _ in range(20):
        if p := LEVEL.search(rest):
            out["priority"] = PRIORITY.get(p[1]) or p[2] or p[3]
            rest = rest[: p.start()].rstrip()
            continue
        for key, pattern in FIELDS.items():
            if f := pattern.search(rest):
                value = next(x for x in f.groups() if x is not None)
                out[key] = calendar(value) if key in DATES else [x.strip() for x in value.split(",")] if key == "depends_on" else value.strip()
                rest = rest[: f.start()].rstrip()
                break
        else:
            t = re.search(rf"(?:^|\s)({TAG})\Z", rest)
            if not t:
                break
            trailing.insert(0, t[1])
            rest = rest[: t.start()].rstrip()
    description = " ".join([rest, *trailing]).strip()
    out["description"] = description
    out["tags"] = list(dict.fromkeys(t[1:] for t in re.findall(rf"(?:^|(?<=\s)){TAG}", description)))
    return out


def tasks(text: str) -> list[dict]:
    """All tasks of a note with their lines (from 1) and the nearest heading above."""
    lines = lines_of(text)
    code, out, heading = in_code(lines), [], None
    at = {h["start"]: h["text"] for h in headings(lines)}
    for i, line in enumerate(lines):
        heading = at.get(i, heading)
        if not code[i] and (found := task(line)):
            out.append({"line": i + 1, "heading": heading} | found)
    return out


def done_lanes(text: str) -> list[str]:
    """Headings of a board whose first words below are **Complete**."""
    lines = lines_of(text)
    return [h["text"] for h in headings(lines) if next((x.strip() for x in lines[h["body_start"] : h["body_end"]] if x.strip()), "") == "**Complete**"]


def entry_hash(section: str, day: str, text: str) -> str:
    return hashlib.sha256("\0".join((section, day, text)).encode()).hexdigest()


def memory_entries(body: str) -> list[dict]:
    """Dated bullets below second-level headings, with what continues them."""
    lines = lines_of(body)
    code, out = in_code(lines), []
    for h in (h for h in headings(lines) if h["level"] == 2):
        current: list[str] | None = None
        for i in range(h["body_start"], h["body_end"]):
            m = None if code[i] else re.match(r"^- \*\*(\d{4}-\d{2}-\d{2})\*\*:", lines[i])
            if m:
                current = [lines[i]]
                out.append({"section": h["text"], "date": m[1], "lines": current})
            elif not code[i] and ATX.match(lines[i]):
                current = None
            elif current is not None:
                current.append(lines[i])
    return [{"section": e["section"], "date": e["date"], "text": (t := "\n".join(e["lines"]).rstrip()), "entry_index": i, "content_hash": entry_hash(e["section"], e["date"], t)} for i, e in enumerate(out)]


def canvas_text(raw: str) -> str:
    """A canvas in reading order: groups with what they hold, then the labelled edges."""
    try:
        data = json.loads(raw)
    except ValueError:
        return ""
    nodes = [n for n in data.get("nodes", []) if isinstance(n, dict)]
    box = lambda n: tuple(float(n.get(k, 0)) for k in ("x", "y", "width", "height"))
    area = lambda n: box(n)[2] * box(n)[3]
    groups = [n for n in nodes if n.get("type") == "group"]

    def holder(n: dict) -> str | None:
        x, y, w, h = box(n)
        around = [g for g in groups if g is not n and box(g)[0] <= x and box(g)[1] <= y and box(g)[0] + box(g)[2] >= x + w and box(g)[1] + box(g)[3] >= y + h]
        return min(around, key=lambda g: (area(g), str(g.get("id"))))["id"] if around else None

    held: dict[str | None, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: (box(n)[1], box(n)[0], str(n.get("id")))):
        held.setdefault(holder(n), []).append(n)
    name = lambda n: str(n.get("text") or n.get("file") or n.get("url") or n.get("label") or "")
    out: list[str] = []

    def put(parent: str | None) -> None:
        for n in held.get(parent, []):
            if name(n):
                out.append(name(n))
            if n.get("type") == "group":
                put(n.get("id"))

    put(None)
    by_id = {n.get("id"): name(n).split("\n")[0] for n in nodes}
    out += [f"{by_id.get(e.get('fromNode'), '')} -> {by_id.get(e.get('toNode'), '')}: {e['label']}" for e in data.get("edges", []) if e.get("label")]
    return "\n\n".join(out)


def canvas_links(raw: str) -> list[str]:
    try:
        nodes = json.loads(raw).get("nodes", [])
    except ValueError:
        return []
    return list(dict.fromkeys(t for n in nodes for t in ([n["file"]] if n.get("type") == "file" and n.get("file") else link_targets(n.get("text", "")))))


def cut_bytes(text: str, most: int = 102_400) -> str:
    """text within so many UTF-8 bytes, no character cut."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore")


#: Date format tokens and their Java patterns.
MOMENT = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "dddd": "EEEE", "ddd": "EEE", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "A": "a", "Q": "Q", "DDDD": "DDD"}


def java_pattern(moment: str) -> str:
    """A date format of notes as a pattern of date_format; ValueError for a token it has not."""
    out = []
    for m in re.finditer(r"\[([^\]]*)\]|(([A-Za-z])\3*)|[^A-Za-z\[]+", moment):
        literal, token, other = m[1], m[2], m[0]
        if literal is not None:
            out.append("'" + literal.replace("'", "''") + "'")
        elif token:
            if token not in MOMENT:
                raise ValueError(f"unsupported date token {token!r}")
            out.append(MOMENT[token])
        else:
            out.append(other.replace("'", "''"))
    return "".join(out)
