"""Main-text extraction by consensus host paths.

Every page's containers are scored by the text that their paragraphs hold. From the best one the page climbs outwards as
long as a container around it adds text (a block of LEAST_WORDS words that is no menu, or a headline before it), so that a
lead, a second section or a column is not left behind; articles and mains are not left. The page votes for the path of
where it arrives, generalised to tags and first classes without digits. The votes of a host are counted in Spark, and its
winners (paths with at least ``min_share`` of its votes) are joined to its pages, which are then read again: a page whose
own best container, or where it arrives, is a winner uses its own; of the winners that another page has, the one that
scores highest there gives the text; a page without any uses its own too. A headline (h1) before an article without one
belongs to it where it lies in an element around the article.

A container's text is its blocks without chrome: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, known by tag, role, or class and id words. Character references are decoded, white space in
a block becomes one blank, blocks are trimmed and joined by newlines; nothing else is dropped or cut. Drawings, frames,
templates and form fields count as markup; formulas, fallback texts (noscript, object, canvas) and an article's own
headline stay. Of what climbing adds, parts that are links by more than half are menus and go; a name that ends in a word
that texts use too (`red-alert`, `legal-notice`) is no chrome inside an article.

Cases: a null html is an empty one, with an empty text; a null or odd url has the empty host. Broken markup is read as
far as it goes: a closing tag closes what is open inside, one without an opening tag is ignored, the end closes all; an
element that would go with its content, but is closed in its own tag or never, goes alone (scripts and styles reach the
end of the page). Ties: of containers with equal scores the outer one, of paths with equal votes the smaller one, and of
winners with equal scores the one with more votes. Repeated rows are read alike and vote each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, stored, tidy

# How markup is read.
_TOKEN = re.compile(r"<!--|<(/?)([a-z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+>)|<[!?/][^>]*+>", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|[\"'][^\"']*", re.S)
_NAMES = frozenset("class id role hidden aria-hidden".split())
#: Elements that go with all that is in them, if they are closed. The first two reach the page's end if they are not.
_RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style template svg iframe textarea select title annotation annotation-xml".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_INLINE |= frozenset("math semantics mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover".split())
_CONTAINER = frozenset("body article main section div td".split())
_CHROME_TAGS = frozenset("head nav aside footer form button dialog fieldset datalist menu".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments disqus respond replies reply widget widgets toolbar pagination pager".split()
)
#: What stands after a word of chrome where the name is that of chrome: `share-buttons` is, `share-price` is not.
_STRUCTURE_WORDS = frozenset(
    "ad area bar block bottom box button buttons col column container form group holder icon icons inner item items left link links list module outer panel posts region right row section slot stories text title top unit wrap wrapper".split()
)
_TEXT_WORDS = frozenset("content article main post entry body text page story".split())
#: Words that name chrome at the end of a name too, but in an article only beside words of chrome, structure or the site.
_MILD_WORDS = frozenset("alert banner login modal notice notices overlay popup promotion related replies reply respond search signup social subscription widget widgets".split())
_SITE_WORDS = frozenset("cookie cookies gdpr global page privacy site top user".split())
_STATE_WORDS = frozenset("has with no without is js".split())
#: What an article has in its class where it is none of the page's own.
_OTHER_ARTICLES = frozenset("ad ads advert comment comments promo recommended related replies reply sponsored".split())
#: Over so many hosts the winners are joined by a shuffle with each host's pages dealt to SALTS tasks.
MAX_BROADCAST_HOSTS = 50_000
SALTS = 16
#: Words of a block without which a container around the best one does not count as more of its text.
LEAST_WORDS = 5


def _name_words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


def _is_chrome_name(name: str, in_article: bool = False) -> bool:
    """Whether a class or an id names chrome: a last word that does, or a first one that only words of structure follow.

    The header of a text (`entry-header`) is none, nor is any header in an article.
    """
    words = _name_words(name)
    if not words or words[0] in _STATE_WORDS:
        return False
    if words[-1] == "header" and (in_article or words[0] in _TEXT_WORDS and words[0] != "page"):
        return False
    if words[0] in _CHROME_WORDS and all(w in _STRUCTURE_WORDS or w in _CHROME_WORDS for w in words[1:]):
        return True
    if in_article and words[-1] in _MILD_WORDS:
        return all(w in _SITE_WORDS or w in _STRUCTURE_WORDS or w in _CHROME_WORDS for w in words[:-1])
    return words[-1] in _CHROME_WORDS


class Block(NamedTuple):
    """A block of text: its container, whether most of it is links, and 1 or 2 where it is a headline of that order."""

    container: int
    text: str
    links: bool
    headline: int


def read(source: str) -> tuple[list[Block], list[tuple[int, str, str]], list[float]]:
    """The blocks, the containers (parent, tag, path) and their scores.

    Chrome is left out. Container 0 is the page itself. A block adds its length without blanks at its ends to its
    container and half to each next one outwards, but in full to articles and mains around it.
    """
    containers: list[tuple[int, str, str]] = [(-1, "", "")]
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, chrome, container
    chrome_depth, here, at = 0, 0, 0
    held: list[str] = []
    in_article = linked = 0
    in_link = False

    def flush() -> None:
        nonlocal held, linked
        if held:
            raw = "".join(held)
            text = " ".join(html_lib.unescape(raw).split())
            if text:
                own = stack[-1][0] if stack else ""
                blocks.append(Block(here, text, 2 * linked > len(raw.strip()), 1 if own == "h1" else 2 if own == "h2" else 0))
            held, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal chrome_depth, here, in_article
        while len(stack) > depth:
            tag, chrome, container = stack.pop()
            chrome_depth -= chrome
            in_article -= tag in ("article", "main")
            here = container

    def open_at(tags: tuple[str, ...], stop: tuple[str, ...]) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                break
        return -1

    unclosed: set[str] = set()
    while m := _TOKEN.search(source, at):
        if m.start() > at and not chrome_depth:
            held.append(source[at : m.start()])
            linked += in_link and len(held[-1])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            if m.group() == "<!--":
                # A comment that is never closed ends with its first bracket.
                end = source.find("-->", at - 2) if "-->" not in unclosed else -1
                if end >= 0:
                    at = end + 3
                else:
                    unclosed.add("-->")
                    at = end + 1 if (end := source.find(">", at)) >= 0 else len(source)
            continue
        if tag in _RAW:
            if not m.group(1) and not (m.group().endswith("/>") and tag not in ("script", "style")):
                end = _RAW[tag].search(source, at) if tag not in unclosed else None
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(source)
                else:
                    unclosed.add(tag)
            continue
        inline = tag in _INLINE
        if tag == "a":
            in_link = not m.group(1) and "href" in (m.group(3) or "").lower()
        if m.group(1):
            if tag in _VOID:
                continue
            k = open_at((tag,), ())
            if not inline:
                flush()
                if k >= 0:
                    pop_to(k)
            elif k >= 0 and stack[-1][0] == tag:
                pop_to(k)
            continue
        if tag in _VOID:
            if tag in ("br", "wbr"):
                if not chrome_depth:
                    held.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        raw = m.group(3)
        names: dict[str, str] = {}
        if raw and not raw.isspace():
            for a, x, y, z in _ATTRIBUTE.findall(raw):
                if (a := a.lower()) in _NAMES:
                    names.setdefault(a, x or y or z)
        chrome = False
        if tag == "article":
            chrome = any(not _OTHER_ARTICLES.isdisjoint(_name_words(c)) for c in names.get("class", "").split())
        elif tag not in ("html", "body", "main"):
            chrome = tag in _CHROME_TAGS or tag == "header" and not in_article or bool(names) and (
                "hidden" in names or names.get("aria-hidden", "").lower() == "true" or names.get("role", "").lower() in _CHROME_ROLES
                or any(_is_chrome_name(c, in_article > 0) for c in names.get("class", "").split()) or _is_chrome_name(names.get("id", ""), in_article > 0)
            )
        if tag in ("article", "main") and not chrome and chrome_depth:
            # A form around the whole page is no form of the page.
            for k, (own, was, container) in enumerate(stack):
                if own == "form" and was:
                    stack[k] = (own, False, container)
                    chrome_depth -= 1
        if inline:
            # Only inline chrome, and what has the same tag inside it, is kept track of.
            if chrome or chrome_depth and stack and stack[-1][0] == tag:
                stack.append((tag, chrome, here))
                chrome_depth += chrome
            continue
        flush()
        if tag == "body" or tag == "head":
            pop_to(0)
        elif tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            stop = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}.get(tag, ("div", "article", "section", "main", "td", "li", "body", "aside", "nav", "form", "footer", "header"))
            k = open_at({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)), stop)
            if k >= 0:
                pop_to(k)
        elif stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        stack.append((tag, chrome, here))
        chrome_depth += chrome
        in_article += tag in ("article", "main")
        if tag in _CONTAINER and not chrome_depth:
            first = names.get("class", "").split()[:1]
            step = tag + ("." + re.sub(r"\d+", "#", first[0].lower()) if first else "")
            containers.append((here, tag, f"{containers[here][2]}>{step}" if containers[here][2] else step))
            here = len(containers) - 1
    if not chrome_depth:
        held.append(source[at:])
        linked += in_link and len(held[-1])
    flush()
    scores = [0.0] * len(containers)
    for c, text, *_ in blocks:
        share = float(len(text))
        while c >= 0:
            scores[c] += len(text) if containers[c][1] in ("article", "main") else share
            share, c = share / 2, containers[c][0]
    return blocks, containers, scores


def best_container(containers: list[tuple[int, str, str]], scores: list[float]) -> int:
    """The container with the highest score; of equals the first, which is the outer one."""
    return max(range(len(scores)), key=lambda i: (scores[i], -i))


def _chain(containers: list[tuple[int, str, str]], c: int) -> list[int]:
    """c and the containers around it, outwards."""
    out = []
    while c >= 0:
        out.append(c)
        c = containers[c][0]
    return out


def climb(blocks: list[Block], containers: list[tuple[int, str, str]], start: int) -> tuple[int, set[int]]:
    """The outermost container that adds text to start, and the blocks in it that are menus; see above.

    A part is what a container on the way holds beside the next one inwards: a whole container, or a block of its own.
    """
    chain = _chain(containers, start)
    place = {c: i for i, c in enumerate(chain)}
    if any(containers[c][1] in ("article", "main") for c in chain):
        return start, set()
    roots: dict[int, tuple[int, int]] = {c: (i, -1) for c, i in place.items()}  # where it joins the way, and by which part

    def joins(c: int) -> tuple[int, int]:
        way = []
        while c not in roots:
            way.append(c)
            c = containers[c][0]
        at, part = roots[c]
        for w in reversed(way):
            part = w if part < 0 else part
            roots[w] = at, part
        return at, part

    parts: dict[tuple[int, int], list[int]] = {}
    first = len(blocks)
    for b, block in enumerate(blocks):
        at, part = joins(block.container)
        if at == 0:
            first = min(first, b)
        else:
            parts.setdefault((at, part if part >= 0 else -2 - b), []).append(b)
    top, menus = 0, []
    for (at, _), own in parts.items():
        length = sum(len(blocks[b].text) for b in own)
        if 2 * sum(len(blocks[b].text) for b in own if blocks[b].links) > length:
            menus += own
        elif at > top and any(b < first and blocks[b].headline or not blocks[b].links and len(blocks[b].text.split()) >= LEAST_WORDS for b in own):
            top = at
    return chain[top], set(menus)


def own_path(blocks: list[Block], containers: list[tuple[int, str, str]], scores: list[float]) -> str:
    """The path that a page votes for."""
    return containers[climb(blocks, containers, best_container(containers, scores))[0]][2]


def extract(source: str, winners: list[str]) -> str:
    """The main text of a page whose host has these winning paths."""
    blocks, containers, scores = read(source)
    if not blocks:
        return ""
    by_path: dict[str, float] = {}
    for (_, _, path), score in zip(containers, scores, strict=True):
        if score > by_path.get(path, 0.0):
            by_path[path] = score
    there = [w for w in winners if w in by_path]
    best = best_container(containers, scores)
    top, menus = climb(blocks, containers, best)
    path = None
    if containers[best][2] in there:
        path = containers[best][2]
    elif there and containers[top][2] not in there:
        path = max(there, key=lambda w: by_path[w])
        top, menus = next(i for i, c in enumerate(containers) if c[2] == path), set()
    inside = [False] * len(containers)
    for i, (parent, _, own) in enumerate(containers):
        inside[i] = i == top or own == path or parent >= 0 and inside[parent]
    kept = [b for b, block in enumerate(blocks) if inside[block.container] and b not in menus]
    around = set(_chain(containers, top)[1:])
    if kept and containers[top][1] in ("article", "main") and not any(blocks[b].headline == 1 for b in kept):
        kept = [b for b in range(kept[0]) if blocks[b].headline == 1 and blocks[b].container in around][-1:] + kept
    return "\n".join(blocks[b].text for b in kept)


def _hosts(df: DataFrame, url_col: str) -> DataFrame:
    return df.withColumn("__host", F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit(""))))


def host_paths(df: DataFrame, url_col: str = "url", html_col: str = "html", min_share: float = 0.1) -> DataFrame:
    """host and paths, its winners, most votes first (of equals the smaller path)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks, containers, scores = read(source.as_py() or "")
                if blocks:
                    key = host, own_path(blocks, containers, scores)
                    votes[key] = votes.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])

    cast = _hosts(df, url_col).select(F.col("__host").alias("host"), F.col(html_col).alias("html")).mapInArrow(tidy(vote), "host string, path string, votes long")
    counted = stored(cast.groupBy("host", "path").agg(F.sum("votes").alias("votes")), "host-votes")
    # A host may have a path for each page: its total is summed up before the shuffle, and its paths never meet in a task.
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    hot = hot_keys(counted.groupBy("host").agg(F.count("*").alias("n")), ["host"], "n")
    shared = dealt_join(counted, totals, ["host"], hot, ["path"]).filter(F.col("votes") >= min_share * F.col("total"))
    return shared.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("w")).select("host", F.transform("w", lambda x: x["path"]).alias("paths"))


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_share: float = 0.1) -> DataFrame:
    """Per row: id, url, text."""
    winners = stored(host_paths(df, url_col, html_col, min_share), "host-paths").withColumnRenamed("host", "__host")
    pages = _hosts(df.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html")), url_col)
    if winners.count() <= MAX_BROADCAST_HOSTS:
        joined = pages.join(F.broadcast(winners), "__host", "left")
    else:
        salt = F.pmod(F.xxhash64(id_col, url_col), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("__salt", salt).join(winners.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "__salt"], "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(source.as_py() or "", paths or []) for source, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    kind = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string"
    return joined.select(id_col, url_col, "__html", "paths").mapInArrow(tidy(each), kind)
