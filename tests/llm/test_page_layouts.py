"""Main text of pages that no generated training page was made from: layouts without telling names."""

import random

import pytest

from vellumlake.llm import html_extraction

WORDS = "the of and to in is was for on that with as by at from it an be are this which or had not but his they have one river market winter letters engine harbour village council silver bridges paper window".split()


def sentence(r, mark=""):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(8, 22))).capitalize() + mark + "."


def layouts(r):
    """name -> html; sentences of the article end in ZZ, those of readers' comments in CC."""
    article = [" ".join(sentence(r, "ZZ") for _ in range(3)) for _ in range(12)]
    ps = "".join(f"<p>{x}</p>" for x in article)
    nav = "<ul>" + "".join(f'<li><a href="/{i}">{r.choice(WORDS)} {r.choice(WORDS)}</a></li>' for i in range(9)) + "</ul>"
    foot = "<div><p>Copyright 2024 Some Company. All rights reserved.</p></div>"
    side = "<div><h3>More stories</h3>" + "".join(f'<p><a href="/s{i}">{sentence(r)}</a></p>' for i in range(6)) + "</div>"
    comments = '<section id="comments"><h3>Comments</h3>' + "".join(f"<div><b>{r.choice(WORDS)}</b><p>{sentence(r, 'CC')}</p></div>" for _ in range(5)) + "</section>"
    page = lambda body: f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"
    return {
        "a div without a class": page(f"<div>{nav}</div><div>{ps}</div>{foot}"),
        "paragraphs of the body": page(f"{nav}{ps}{foot}"),
        "a table": page(f"<table><tr><td>{nav}</td><td>{ps}</td></tr></table>{foot}"),
        "classes that tell nothing": page(f'<div class="xq1 css-9ab"><div class="k3">{nav}</div><div class="css-77 zz1">{ps}</div></div>{foot}'),
        "no markup": " ".join(article),
        "comments within main": page(f"<nav>{nav}</nav><main>{ps}{comments}</main><footer>{foot}</footer>"),
        "lines": page(f"<div>{nav}</div><div>{'<br><br>'.join(article)}</div>{foot}"),
        "stories beside": page(f"<div>{nav}</div><div><div>{ps}</div>{side}</div>{foot}"),
        "a short article": page(f"<nav>{nav}</nav><article><h1>TitleZZ here</h1><p>{sentence(r, 'ZZ')}</p></article>{foot}"),
        "a telling class": page(f'<nav>{nav}</nav><div class="content">{ps}</div>{foot}'),
    }


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_layouts(spark, seed):
    pages = layouts(random.Random(seed))
    rows = spark.createDataFrame(list(enumerate(pages.values())), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    got = {r.page_id: r.text for r in html_extraction.extracted(rows).collect()}
    for i, (name, html) in enumerate(pages.items()):
        assert got[i].count("ZZ") >= 0.95 * html.count("ZZ"), name
        assert "CC" not in got[i] and "Copyright" not in got[i] and "More stories" not in got[i], name
