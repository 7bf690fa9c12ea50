"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded on the tree.

Each block element is a node with features of its tag, attribute tokens, depth,
subtree density and siblings.  Boosted trees, trained on generated pages whose main
text is known, score each node; a dynamic program over the tree then keeps, drops or
divides whole subtrees, so that no node is kept within a dropped one or the reverse.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped

#: Fixed values of HTML: elements that make blocks, have no end tag, hold no text; and the ends that a start tag implies.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset figure figcaption blockquote pre address details summary dialog noscript object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of the silent ones: those that run to the page's end where no end tag comes, and the others.
RAW, SILENT = "script|style", frozenset("template svg iframe canvas video audio select textarea button".split())
#: What may stand in a head without ending it.
IN_HEAD = frozenset("html head title meta link base".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
BARRIER = frozenset("table ul ol dl div article main section nav header footer aside form blockquote figure body html td th".split())
#: Tokens of class, id and role by what they tell.
TOKENS = {
    "main": "article content main post entry body story text page copy prose",
    "menu": "nav menu navbar breadcrumb breadcrumbs navigation toc pager pagination tabs skip",
    "top": "header banner masthead top logo brand hero topbar",
    "bottom": "footer bottom copyright legal colophon credits",
    "side": "sidebar side aside widget related rail recommended more trending popular",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad",
    "talk": "comment comments reply replies discussion disqus respond thread",
    "notice": "cookie cookies notice consent alert gdpr message popup modal overlay warning",
    "form": "form login search subscribe newsletter signup share social contact",
}
TOKEN_SETS = [frozenset(x.split()) for x in TOKENS.values()]
TAGS = ("article", "main", "section", "div", "p", "h", "list", "li", "table", "nav", "header", "footer", "aside", "form", "figure", "quote")
TAG_OF = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "caption": "table", "figcaption": "figure", "blockquote": "quote", "pre": "quote"}
LEGAL = re.compile(r"\u00a9|\bcopyright\b|\ball rights reserved\b", re.I)
ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<silent>{RAW})\b[^>]*>.*?(?:</(?P=silent)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{ATTRS})/?>|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "flags", "depth", "text", "links", "own", "tags", "items", "index")

    def __init__(self, tag: str, parent: "Node | None", attrs: str):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.text = self.links = self.own = self.tags = 0
        self.items: list = []  # child nodes and pieces of text, in page order
        words = {w for m in ATTR.finditer(attrs) for w in re.split(r"[^a-z0-9]+", next(x for x in m.groups() if x is not None).lower())} if attrs else set()
        self.flags = [bool(words & s) for s in TOKEN_SETS] if words else [False] * len(TOKEN_SETS)


def silent_spans(page: str) -> dict[int, int]:
    """Where each silent element that has its end tag starts, and where it ends; the others are empty."""
    opened: dict[str, list[int]] = {}
    out = {}
    for m in PIECE.finditer(page):
        tag = (m["tag"] or "").lower()
        if tag not in SILENT and tag != "noscript":
            continue
        if not m["end"]:
            if not m[0].endswith("/>"):
                opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            out[opened[tag].pop()] = m.end()
    return out


def parse(page: str) -> list[Node]:
    """All block nodes in page order; the first is the root."""
    root = Node("body", None, "")
    nodes, stack, at, link = [root], [("body", root)], 0, 0
    spans, head, title = silent_spans(page), False, False
    opened: Counter = Counter()  # how many of each tag the stack holds

    def close(i: int) -> None:
        nonlocal link
        for t, _ in stack[i:]:
            opened[t] -= 1
            link -= t == "a"
        del stack[i:]

    def put(raw: str) -> None:
        nonlocal head
        if title or (head and not raw.strip()):
            return
        head = False  # text ends it
        if raw:
            text = entities.unescape(raw)
            node = stack[-1][1]
            node.items.append(text)
            n = len(text) - text.count(" ") if not text.isspace() else 0
            node.own += n
            if link:
                node.links += n

    while m := PIECE.search(page, at):
        tag = (m["tag"] or "").lower()
        if title and tag and tag not in IN_HEAD and (m["end"] or tag in BLOCKS):
            title = False  # it has no end tag
            at = m.start()
        put(page[at : m.start()])
        at = m.end()
        if not tag:
            if m["silent"]:
                stack[-1][1].items.append(" ")
            continue
        if tag in SILENT or (head and tag == "noscript"):  # elsewhere it may hold text
            at = spans.get(m.start(), at)
            stack[-1][1].items.append(" ")
            continue
        if tag == "head":
            head, title = not m["end"], False
            continue
        if head:
            if tag in IN_HEAD or m["end"]:
                title = tag == "title" and not m["end"]
                continue
            if title:  # text of the title
                continue
            head = False
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if tag in BLOCKS and tag not in ("html", "body"):
            closed = CLOSES.get(tag, {"p"})
            if any(opened[t] for t in closed):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closed:
                        close(i)
                        break
                    if stack[i][0] in BARRIER and not (tag in ("td", "th", "tr") and stack[i][0] in ("td", "th")):
                        break
            node = Node(tag, stack[-1][1], m["attrs"])
            node.parent.children.append(node)
            node.parent.items.append(node)
            nodes.append(node)
            stack.append((tag, node))
            opened[tag] += 1
        elif tag == "br" or tag == "hr":
            stack[-1][1].items.append(" ")
        elif tag not in VOID and tag not in ("html", "body"):
            stack[-1][1].tags += 1
            stack.append((tag, stack[-1][1]))
            opened[tag] += 1
            link += tag == "a"
    put(page[at:])
    for i, node in enumerate(nodes):
        node.index, node.text = i, node.own
    for node in reversed(nodes[1:]):
        up = node.parent
        up.text += node.text
        up.links += node.links
        up.tags += node.tags + 1
    return nodes


def is_legal(n: Node) -> bool:
    """Whether a short block is a line of rights."""
    return n.own <= 400 and any(LEGAL.search(x) for x in n.items if isinstance(x, str))


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node; sizes are also relative to the page's largest, which need no telling names."""
    total, out = max(1, nodes[0].text), []
    most_own = max(1, *(n.own for n in nodes))
    prose = [0] * len(nodes)  # of each subtree, text that is no link
    for n in reversed(nodes):
        plain = n.own - min(n.own, n.links)
        prose[n.index] += plain
        if n.parent is not None:
            prose[n.parent.index] += prose[n.index]
    all_prose = max(1, prose[0])
    legal = [float(is_legal(n)) for n in nodes]
    # of each node: its children, the most text in one, and how many have each tag
    below = [(len(n.children), max((c.text for c in n.children), default=0), Counter(c.tag for c in n.children)) for n in nodes]
    inherited = [[0.0] * len(TOKEN_SETS) for _ in nodes]
    above = [[0.0] * len(TAGS) for _ in nodes]
    for i, n in enumerate(nodes):
        kind = TAG_OF.get(n.tag, n.tag)
        tags = [float(kind == t) for t in TAGS]
        if n.parent is not None:
            j = n.parent.index
            inherited[i] = [max(float(f), x) for f, x in zip(n.parent.flags, inherited[j], strict=True)]
            above[i] = [max(float(TAG_OF.get(n.parent.tag, n.parent.tag) == t), x) for t, x in zip(TAGS, above[j], strict=True)]
            siblings, most, tags_ = below[j]
            around = [float(siblings), tags_[n.tag] / siblings, n.text / max(1, most), n.text / max(1, n.parent.text)]
        else:
            around = [1.0, 1.0, 1.0, 1.0]
        out.append([np.log1p(n.text), np.log1p(n.own), n.links / max(1, n.text), n.tags / max(1, n.text), n.text / total, n.depth, len(n.children), legal[i], n.own / most_own, prose[i] / all_prose, prose[i] / max(1, n.text), prose[n.parent.index] / max(1, n.parent.text) if n.parent is not None else 1.0, *around, *tags, *map(float, n.flags), *inherited[i], *above[i]])
    return np.array(out, float)


#: Elements of running text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre".split())


def decode(nodes: list[Node], odds: np.ndarray, divide: float = 0.5) -> list[bool]:
    """Which nodes' own text stays: each subtree is kept, dropped or divided, whatever adds up to the most.

    Running text that shows nothing of its own (no link, no telling token, no legal line)
    goes by its parent's odds, or by the mean of such siblings, where these are for the main text.
    """
    given, plain = odds, [n.parent is not None and n.tag in FLOW and not n.links and not any(n.flags) and not is_legal(n) for n in nodes]
    odds = odds.copy()
    for up in nodes:
        run = [c.index for c in up.children if plain[c.index]]
        if run:
            odds[run] += max(0.0, float(given[up.index]), float(given[run].mean()))
    worth = [float(o) * np.log1p(n.own + 0.1 * n.text) for n, o in zip(nodes, odds, strict=True)]
    whole, best, how = worth[:], [0.0] * len(nodes), [0] * len(nodes)
    split = [0.0] * len(nodes)
    for n in reversed(nodes):
        i = n.index
        own = abs(float(odds[i])) * np.log1p(n.own)
        options = (split[i] + own - divide, whole[i], -whole[i])
        how[i] = max(range(3), key=options.__getitem__) if n.children else (1 if whole[i] > 0 else 2)
        best[i] = options[how[i]]
        if n.parent is not None:
            j = n.parent.index
            whole[j] += whole[i]
            split[j] += best[i]
    stays = [False] * len(nodes)
    ruled: list[int] = [0] * len(nodes)
    for n in nodes:
        i = n.index
        ruled[i] = ruled[n.parent.index] if n.parent is not None and ruled[n.parent.index] else how[i]
        stays[i] = bool(odds[i] > 0) if ruled[i] == 0 else ruled[i] == 1
    return stays


def blocks(node: Node, stays: list[bool]) -> list[str]:
    """The kept blocks below a node in page order: text between the borders of block elements."""
    out: list[str] = []
    todo: list = [(node, iter(node.items), [])]
    while todo:
        n, items, run = todo[-1]
        for item in items:
            if isinstance(item, str):
                run.append(item)
            else:
                if stays[n.index] and (text := " ".join("".join(run).split())):
                    out.append(text)
                run.clear()
                todo.append((item, iter(item.items), []))
                break
        else:
            if stays[n.index] and (text := " ".join("".join(run).split())):
                out.append(text)
            todo.pop()
    return out


def generated_pages(count: int, seed: int = 7) -> list[tuple[str, str]]:
    """(html, mark) pages of many layouts; words of the main text contain the mark."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    said = lambda a, b, mark="": " ".join(word() + mark for _ in range(r.randint(a, b))) + r.choice(".!?")
    attr = lambda group: r.choice(["", f' class="{r.choice(TOKENS[group].split())}"', f' id="{r.choice(TOKENS[group].split())}"', f' class="{word()} {r.choice(TOKENS[group].split())}-{word()}"'])
    odd = lambda: r.choice([word() + "-" + str(r.randint(1, 99)), "x" + str(r.randint(1, 999)), word() + " " + word()])  # noqa: E731  a class that tells nothing
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 4)))}</a>'

    def links(group: str, tags: list[str], bare: bool = False) -> str:
        t, n = r.choice(tags), r.randint(3, 12)
        inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if r.random() < 0.7 else " ".join(link() for _ in range(n))
        if bare:
            if r.random() < 0.3:  # teasers: a heading over sentences that are links
                inner = f"<h3>{word()} {word()}</h3>" + "".join(f'<p><a href="/{word()}">{said(4, 25)}</a></p>' for _ in range(r.randint(3, 8)))
            return r.choice([f"<div>{inner}</div>", f'<div class="{odd()}">{inner}</div>', inner, f"<div><div>{inner}</div></div>"])
        return f"<{t}{attr(group)}>{inner}</{t}>"

    def box(group: str, tags: list[str], low: int = 3, high: int = 45, many: int = 1) -> str:
        t = r.choice(tags)
        inner = "".join(f"<p>{said(low, high)}</p>" if r.random() < 0.6 else said(low, high) + " " for _ in range(r.randint(1, many)))
        return f"<{t}{attr(group) if t == 'div' and r.random() < 0.1 else ' class=' + chr(34) + r.choice(TOKENS[group].split()) + chr(34) if t in ('div', 'section', 'p') else attr(group)}>{inner}</{t}>"

    def comments() -> str:
        t = r.choice(["div", "section"])
        name = r.choice(["class", "id"])
        return f'<{t} {name}="{r.choice(TOKENS["talk"].split())}"><h3>{word()}</h3>' + "".join(f"<div>{said(3, 60)}</div>" if r.random() < 0.4 else f"<p>{said(3, 60)}</p>" if r.random() < 0.5 else f"<div><b>{word()}</b><p>{said(3, 40)}</p></div>" for _ in range(r.randint(1, 8))) + f"</{t}>"

    def article(bare: bool) -> str:
        m, out = "q", [f"<h1>{' '.join(word() + 'q' for _ in range(r.randint(2, 10)))}</h1>"]
        if r.random() < 0.3:
            out.append(f"<p><b>{said(5, 40, m)}<br>")
        for _ in range(r.choice([1, 2, r.randint(1, 14), r.randint(3, 14), r.randint(3, 14)])):
            kind = r.random()
            if kind < 0.72:
                inner = said(1 if r.random() < 0.2 else 8, 90, m)
                if r.random() < 0.2:
                    inner += f' <a href="/x">{word()}q</a> ' + said(2, 20, m)
                out.append(f"<p>{inner}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{said(2, 25, m)}</li>" for _ in range(r.randint(2, 7))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<h2>{' '.join(word() + 'q' for _ in range(r.randint(1, 7)))}</h2>")
            elif kind < 0.88:
                out.append(f"<blockquote>{said(5, 40, m)}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{word()}q<td>{word()}q</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.94:
                out.append(f"<pre>{said(3, 20, m)}</pre>")
            else:
                out.append(box("advert", ["div", "aside"]))
        talk = comments() if r.random() < 0.2 else ""
        if bare:
            if r.random() < 0.25:  # lines instead of paragraphs
                out = ["<br><br>".join(said(8, 60, m) for _ in range(r.randint(3, 14)))]
            elif r.random() < 0.5:
                out = out[1:] or out  # no heading
            inner = "".join(out) + talk
            return r.choice([f"<div>{inner}</div>", f'<div class="{odd()}">{inner}</div>', f"<div><div>{inner}</div></div>", f'<div class="{odd()}"><div id="{odd()}">{inner}</div></div>', inner, f"<section>{inner}</section>"])
        out.append(talk)
        t = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        body = f"<{t}{attr('main') if t != 'div' or r.random() < 0.2 else ' class=' + chr(34) + r.choice(TOKENS['main'].split()) + chr(34)}>{''.join(out)}</{t}>"
        return f"<div>{body}</div>" if r.random() < 0.3 else body

    pages = []
    for _ in range(count):
        parts, bare, plain = [], r.random() < 0.5, r.random() < 0.5  # no telling names around the main text; around the rest
        if bare and r.random() < 0.08:  # no markup at all
            pages.append(("\n".join(said(20, 90, "q") for _ in range(r.randint(1, 8))), "q"))
            continue
        plain = plain and bare
        if r.random() < 0.4:
            parts.append(f"<header{attr('top')}>{said(1, 25)} {link()}</header>" if r.random() < 0.7 else box("top", ["div"]))
        menu = links("menu", ["nav", "nav", "div"], plain) if r.random() < 0.85 else ""
        if r.random() < 0.4:
            parts.append(box("notice", ["div", "section", "aside"], 4, 40))
        if r.random() < 0.5:
            parts.append(box("advert", ["div", "aside"]))
        main, side = article(bare), r.choice([links("side", ["aside", "div"], plain), box("side", ["aside", "div"], 3, 30, 4)]) if r.random() < 0.5 else ""
        if bare and r.random() < 0.25:  # a table lays out the page
            cells = [menu, main, side] if r.random() < 0.7 else [main, menu + side]
            parts.append("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells if c) + "</tr></table>")
        else:
            parts.insert(r.randint(0, len(parts)), menu)
            parts += [side, main] if r.random() < 0.4 else [main, side]
        if r.random() < 0.3:
            parts.append(comments())
        if r.random() < 0.3:
            parts.append(f"<form{attr('form')}><p>{said(2, 12)}</p><input><button>{word()}</button></form>")
        if r.random() < 0.85:
            foot = f"{r.choice(['&copy;', 'Copyright 20' + str(r.randint(10, 30))])} {said(2, 35)}"
            if plain:
                parts.append(r.choice([f"<div><p>{foot}</p></div>", f"<div>{foot} {link()}</div>", f'<p class="{odd()}">{foot}</p>', f"<div>{link()} {link()} {foot}</div>"]))
            else:
                parts.append(f"<footer{attr('bottom')}>{foot} {link() if r.random() < 0.5 else ''}</footer>" if r.random() < 0.75 else box("bottom", ["div"]))
        body = "".join(parts)
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{'<div>' + body + '</div>' if r.random() < 0.3 else body}</body></html>", "q"))
    return pages


def examples(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages: 1 where most of the subtree's text is main text."""
    xs, ys = [], []
    for page, mark in generated_pages(count):
        nodes = parse(page)
        good = [0] * len(nodes)
        for n in reversed(nodes):
            good[n.index] += sum(len(w) for x in n.items if isinstance(x, str) for w in x.split() if mark in w)
            if n.parent is not None:
                good[n.parent.index] += good[n.index]
        some = [n.index for n in nodes if n.text]
        xs.append(features(nodes)[some])
        ys += [float(2 * good[i] > nodes[i].text) for i in some]
    return np.concatenate(xs), np.array(ys)


class Trees:
    """Boosted regression trees as arrays, to score many nodes at once."""

    def __init__(self, model):
        self.trees, self.weights = [], list(model.treeWeights)
        for tree in model.trees:
            rows: list[list[float]] = []

            def walk(node, rows=rows) -> int:
                i = len(rows)
                rows.append([-1, 0.0, 0, 0, float(node.prediction())])
                if node.subtreeDepth():
                    split = node.split()
                    rows[i][:2] = [split.featureIndex(), float(split.threshold())]
                    rows[i][2], rows[i][3] = walk(node.leftChild()), walk(node.rightChild())
                return i

            walk(tree._java_obj.rootNode())
            self.trees.append(np.array(rows))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := tree[at, 0] >= 0).any():
                f = np.maximum(tree[at, 0], 0).astype(np.int64)
                go = np.where(x[every, f] <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(np.int64)
                at = np.where(inner, go, at)
            total += weight * tree[at, 4]
        return 2 * total


@lru_cache(maxsize=4)
def trained(count: int = 1200, rounds: int = 36, depth: int = 5) -> Trees:
    """The trees, fitted once per driver on `count` generated pages; they do not depend on the input."""
    spark = SparkSession.active()
    x, y = examples(count)
    rows = spark.createDataFrame(pa.table({"x": pa.array(list(x), pa.list_(pa.float64())), "label": y})).coalesce(2)
    rows = rows.select(array_to_vector("x").alias("features"), "label")
    return Trees(GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.3, seed=3).fit(rows))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of each row's html, blocks joined by one space.

    Null or empty html gives an empty text; rows that repeat a page_id are read each
    by itself; rows without a page_id are left out; pages of any length are read whole;
    of subtrees that are worth as much kept as dropped the worth decides, above 0
    kept; an empty table gives no rows; other columns are ignored.
    """
    trees = trained()

    def read(batch: pa.RecordBatch) -> dict[str, object]:
        parsed = [parse(x) for x in batch.column("html").to_pylist()]
        odds = trees(np.concatenate([features(p) for p in parsed]))
        out, at = [], 0
        for nodes in parsed:
            stays = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append(" ".join(blocks(nodes[0], stays)))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())}

    d = pages.where("page_id is not null").select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return mapped(d, read, "page_id long, url string, text string", text="html")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """extracted() of the whole table pages; see there for nulls, empty and repeated rows."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
