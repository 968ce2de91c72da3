"""Extraction of pages without article or main: nothing but chrome and menus is lost."""

import html
import re

import pytest

from sparrowdex.llm import htmltext

INTRO = " ".join(f"intro{i}" for i in range(120))
MORE = " ".join(f"more{i}" for i in range(80))
NAV = '<div class="links"><ul><li><a href="/a">First page of it all here</a></li><li><a href="/b">Second page of it all here</a></li></ul></div>'


@pytest.mark.parametrize("body,want", [
    (f'<div class="content"><section class="intro"><p>{INTRO}</p></section><section class="details"><p>{MORE}</p></section></div>', [INTRO, MORE]),
    (f'<div class="lead"><p>{MORE}</p></div><div class="body"><p>{INTRO}</p></div>', [MORE, INTRO]),
    (f'<div class="row"><div class="col-a"><p>{INTRO}</p></div><div class="col-b"><p>{MORE}</p></div></div>', [INTRO, MORE]),
    (f'<div><h1>Headline</h1><div class="text"><p>{INTRO}</p></div></div>', ["Headline", INTRO]),
    (f'<div class="wrap"><div class="text"><p>{INTRO}</p></div></div><div><div><p>{MORE}</p></div></div>', [INTRO, MORE]),
    (f'{NAV}<div class="lead"><p>{MORE}</p></div><div class="body"><p>{INTRO}</p></div>{NAV}', [MORE, INTRO]),
    (f'<div class="text"><p>{INTRO}</p><ul><li><a href="/s">A source of the text as one link</a></li></ul></div>', [INTRO, "A source of the text as one link"]),
    (f'<div class="sidebar"><p>{MORE}</p></div><div class="body"><p>{INTRO}</p></div><div class="comments"><p>{MORE}</p></div>', [INTRO]),
    (f'<div class="text"><p>{INTRO}</p></div><div>(c) 2024</div>', [INTRO]),
    (f'<div class="text"><p>{INTRO}</p></div><h2>After</h2>', [INTRO]),
    (f"<div><h1>Headline</h1><article><p>{INTRO}</p></article></div>", ["Headline", INTRO]),
    (f"<div><h1>Site</h1></div><article><h1>Own</h1><p>{INTRO}</p></article><p>other text</p>", ["Own", INTRO]),
    (f'<article><p>{INTRO}</p><p class="red-alert">An alarm</p><div class="legal-notice">By law</div><div class="site-notice">gone</div><div class="post-comments">gone</div><div class="notice">gone</div></article>', [INTRO, "An alarm", "By law"]),
])
def test_text_in_several_containers(spark, body, want):
    page = f"<html><body><nav>menu</nav>{body}<footer>f</footer></body></html>"
    assert htmltext.extract(page, []).split("\n") == want
    blocks, containers, scores = htmltext.read(page)
    assert htmltext.extract(page, [htmltext.own_path(blocks, containers, scores)]).split("\n") == want  # as the host votes


def test_a_page_with_more_than_its_host_s_others(spark):
    """One page in thirty has a second section: its host's path is that of the first, and nothing of it is lost."""
    rows = [(i, f"http://a.x/{i}", f'<body><div class="c"><section class="intro"><p>{INTRO} {i}</p></section></div></body>') for i in range(29)]
    rows.append((29, "http://a.x/29", f'<body><div class="c"><section class="intro"><p>{INTRO}</p></section><section class="details"><p>{MORE}</p></section></div></body>'))
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[29] == f"{INTRO}\n{MORE}" and got[3] == f"{INTRO} 3"


def test_hosts_with_a_path_for_each_page(spark, monkeypatch):
    """Hashed class names give a path a page; such a host is hot, has no winner, and its pages use their own."""
    from sparrowdex.llm import common

    monkeypatch.setattr(common, "CHUNK_ROWS", 8)
    letters = "abcdefghij"
    name = lambda i: letters[i // 10] + letters[i % 10] + "x"
    rows = [(i, "http://hot.x/p", f'<body><div class="{name(i)}"><p>{INTRO} {i}</p></div></body>') for i in range(60)] + [(100, "http://b.x/", "<body><p>b</p></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r.host, r.paths) for r in htmltext.host_paths(df).collect()] == [("b.x", ["body"])]
    assert {r.page_id: r.text for r in htmltext.extract_pages(df).collect()} == {i: f"{INTRO} {i}" for i in range(60)} | {100: "b"}


def test_stripped_pages_against_brute_force(spark, sf_dir):
    """The fixture without its article tags: all blocks but those of nav, footer, advert, script and style."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    stripped = [(r.page_id, r.url, re.sub("</?article>", "", r.html)) for r in pages]
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(stripped, "page_id long, url string, html string")).collect()}
    for page_id, _, source in stripped:
        left = re.sub(r'(?s)<(nav|footer|script|style|head)\b.*?</\1>|<div class="ad">.*?</div>', "", source)
        left = re.sub(r"</?(?:p|h1|div|body|html|ul|li)\b[^>]*>|<!doctype[^>]*>", "\0", left.replace("<br>", " "), flags=re.I)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in left.split("\0")]
        assert got[page_id] == "\n".join(filter(None, blocks))
