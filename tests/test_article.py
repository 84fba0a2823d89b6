"""Articles come out of pages without what was planted around them."""

import pytest
from pyspark.sql import functions as F

from copperleaf.functions.article import article, article_text

BODY = [
    "The first campaign reached nearly a million people in four weeks, and its cost stayed well below what the team had planned for it.",
    "Short copy won over long copy in every market but one, which the authors put down to the season in which the test was run there.",
    "They end with advice: change one thing at a time, wait until the numbers have settled, and write down what you expected before you look.",
]
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li><li><a href="/s">Sign in now</a></li></ul>'
RELATED = "".join(f'<div><a href="/{i}">Read the next story number {i} today</a></div>' for i in range(6))
CORE = "".join(f"<p>{p}</p>" for p in BODY)

PAGES = {
    "plain": f"<html><head><title>T</title></head><body><nav>{MENU}</nav><article>{CORE}</article><footer>© All rights</footer></body></html>",
    "no nav tag": f"<body><div>{MENU}</div>{CORE}<div>{RELATED}</div></body>",
    "scripts": f"<script>var a = '<p>{'word ' * 40}</p>';</script><style>p {{ x: y }}</style>{CORE}<script>track()</script>",
    "comments": f"<!-- {'hidden words ' * 30} -->{CORE}<!-- unclosed? no -->",
    "aside": f"{CORE}<aside><p>{'buy this now ' * 20}</p></aside>",
    "unclosed nav": f"<div><nav>{MENU}</div><div>{CORE}</div>",
    "unclosed p": "<body>" + "".join(f"<p>{p}" for p in BODY),
    "stray ends": f"</div></p></nav>{CORE}</section></span></body></html></div>",
    "upper case": f"<BODY><NAV>{MENU}</NAV>{CORE.replace('<p>', '<P>').replace('</p>', '</P>')}</BODY>",
    "attributes": CORE.replace("<p>", '<p class="a > b" data-x=\'<p>\'>'),
    "form": f"<form><label>Mail</label><input><button>{'subscribe to all of our news ' * 5}</button></form>{CORE}",
    "header": f"<header><h1>Site</h1><p>{'our claim is long and says little ' * 5}</p></header>{CORE}",
    "select": f"<select><option>{'many words of a choice that nobody reads at all here ' * 3}</select>{CORE}",
    "noscript": f"<noscript><p>{'please turn it on ' * 10}</p></noscript>{CORE}",
    "links at the end": f"{CORE}<p>{RELATED}</p>",
    "divs": "".join(f"<div>{p}</div>" for p in BODY),
    "breaks": "<br>".join(BODY),
    "spans": "".join(f"<p><span>{p[:40]}</span><b>{p[40:60]}</b>{p[60:]}</p>" for p in BODY),
    "white space": "".join(f"<p>\n\t {p.replace(' ', '  ', 3)} \n</p>" for p in BODY),
    "cut": f"{CORE}<div><a href='/x'>cut he",
}


@pytest.mark.parametrize("name", PAGES)
def test_planted_boilerplate_is_gone(name):
    assert article(PAGES[name]).split("\n") == BODY


def test_entities_tables_headings_and_odd_pages(spark):
    said = article(f"<h2>Results &amp; costs</h2><p>{BODY[0]} caf&eacute; &#8364;5 &lt;b&gt;</p><table><tr><td>{BODY[1]}</td><td>12</td></tr></table>")
    assert said.split("\n") == ["Results & costs", f"{BODY[0]} café €5 <b>", f"{BODY[1]} 12"]
    assert article(None) is None and article("") == "" and article("<p>too short</p>") == "" and article("<" * 2000) == article("<" * 2000)
    deep = "<div>" * 20_000 + f"<p>{BODY[0]}</p>" + "</i>" * 20_000
    assert article(deep) == BODY[0]
    rows = spark.createDataFrame([(1, PAGES["plain"]), (2, None), (3, "")], "id long, html string").select("id", article_text(F.col("html")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == {1: "\n".join(BODY), 2: None, 3: ""}
