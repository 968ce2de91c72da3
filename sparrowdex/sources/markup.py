"""Converters of foreign markup to Markdown: HTML, reStructuredText, DocC render JSON. Pandas UDFs, one text at a time."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_DROP = frozenset("script style noscript nav header footer aside form template svg button iframe".split())
_BLOCK = frozenset("p div section article main ul ol table tr blockquote pre figure dl dt dd".split())


class _Markdown(HTMLParser):
    """Collects Markdown while it reads HTML."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[str] = []
        self.href: list[str | None] = []
        self.pre = 0

    def _block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in _DROP:
            if tag in _DROP:
                self.skip.append(tag)
            return
        given = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
            self._block()
        elif tag == "li":
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("1. " if self.lists[-1:] == ["ol"] else "- "))
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.href.append(given.get("href"))
            self.out.append("[")
        elif tag == "img" and given.get("alt"):
            self.out.append(f"![{given['alt']}]({given.get('src', '')})")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _BLOCK:
            self._block()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._block()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.out.append(f"]({href})" if href else "]")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self._block()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(source: str | None) -> str:
    """The page's body (its main or article, if it has one) as Markdown."""
    text = source or ""
    for tag in ("main", "article", "body"):
        found = re.search(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", text)
        if found:
            text = found[1]
            break
    reader = _Markdown()
    reader.feed(text)
    reader.close()
    lines = [line.rstrip() for line in "".join(reader.out).split("\n")]
    cleaned = re.sub(r"\[\s*\]\([^)]*\)", "", "\n".join(lines))
    return re.sub(r"\n{3,}", "\n\n", cleaned).strip()


def rst_to_markdown(source: str | None) -> str:
    """Headings by the order in which their adornments appear; code, notes, links and roles."""
    lines, out, marks = (source or "").split("\n"), [], []
    adornment = lambda s: bool(re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}", s.rstrip()))
    i = 0
    while i < len(lines):
        line = lines[i]
        over = adornment(line) and i + 2 < len(lines) and lines[i + 2].rstrip() == line.rstrip() and lines[i + 1].strip()
        under = line.strip() and not adornment(line) and i + 1 < len(lines) and adornment(lines[i + 1]) and len(lines[i + 1].rstrip()) >= len(line.strip())
        if over or under:
            mark = ("over", line[0]) if over else ("under", lines[i + 1][0])
            if mark not in marks:
                marks.append(mark)
            out.append("#" * min(6, marks.index(mark) + 1) + " " + _rst_inline((lines[i + 1] if over else line).strip()))
            i += 3 if over else 2
            continue
        directive = re.match(r"^(\s*)\.\. ([\w:-]+)::\s*(.*)$", line)
        if directive:
            indent, name, rest = len(directive[1]), directive[2], directive[3]
            body, i = [], i + 1
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > indent):
                body.append(lines[i])
                i += 1
            text = [b for b in body if not re.match(r"^\s+:[\w-]+:", b)]
            pad = min((len(b) - len(b.lstrip()) for b in text if b.strip()), default=0)
            text = "\n".join(b[pad:] for b in text).strip("\n")
            if name in ("code-block", "code", "sourcecode", "highlight"):
                out += [f"```{rest}", text, "```", ""]
            elif name in ("note", "warning", "tip", "important", "caution", "seealso"):
                out += [f"> **{name.capitalize()}** {_rst_inline(' '.join((rest + ' ' + text).split()))}".rstrip(), ""]
            elif name == "image":
                out += [f"![]({rest})", ""]
            elif name == "toctree":
                out += [*(f"- {t.strip()}" for t in text.split("\n") if t.strip()), ""]
            continue
        if re.match(r"^\s*\.\. ", line) or re.fullmatch(r"\s*\.\.", line):
            i += 1
            continue
        out.append(_rst_inline(line))
        i += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def _rst_inline(text: str) -> str:
    text = re.sub(r"``(.+?)``", r"`\1`", text)
    text = re.sub(r"`([^`<]+?)\s*<([^>`]+)>`__?", r"[\1](\2)", text)
    return re.sub(r":[\w:.+-]+:`~?([^`<]+?)(?:\s*<[^>`]*>)?`", r"`\1`", text)


def docc_to_markdown(source: str | None) -> str:
    """Title, abstract and content blocks of a DocC render document; references become links."""
    try:
        doc = json.loads(source or "{}")
    except ValueError:
        return ""
    refs = doc.get("references") or {}

    def inline(nodes) -> str:
        out = ""
        for n in nodes or []:
            kind = n.get("type")
            if kind == "text":
                out += n.get("text", "")
            elif kind == "codeVoice":
                out += f"`{n.get('code', '')}`"
            elif kind in ("emphasis", "strong"):
                mark = "*" if kind == "emphasis" else "**"
                out += mark + inline(n.get("inlineContent")) + mark
            elif kind == "reference":
                to = refs.get(n.get("identifier"), {})
                out += f"[{to.get('title', n.get('identifier', ''))}]({to.get('url', '')})"
            else:
                out += inline(n.get("inlineContent"))
        return out

    def blocks(nodes, depth: int = 0) -> list[str]:
        out = []
        for n in nodes or []:
            kind = n.get("type")
            if kind == "heading":
                out.append("#" * n.get("level", 2) + " " + n.get("text", ""))
            elif kind == "paragraph":
                out.append(inline(n.get("inlineContent")))
            elif kind == "codeListing":
                out.append(f"```{n.get('syntax') or ''}\n" + "\n".join(n.get("code") or []) + "\n```")
            elif kind in ("unorderedList", "orderedList"):
                mark = "-" if kind == "unorderedList" else "1."
                out.append("\n".join("  " * depth + f"{mark} " + "\n".join(blocks(i.get("content"), depth + 1)) for i in n.get("items") or []))
            elif kind == "aside":
                out.append("> " + " ".join(blocks(n.get("content"), depth)))
            elif kind == "table":
                rows = [[" ".join(blocks(c, depth)) for c in r] for r in n.get("rows") or []]
                out.append("\n".join(["| " + " | ".join(r) + " |" for r in rows[:1]] + ["|" + " --- |" * len(r) for r in rows[:1]] + ["| " + " | ".join(r) + " |" for r in rows[1:]]))
        return out

    title = (doc.get("metadata") or {}).get("title", "")
    parts = [f"# {title}" if title else "", inline(doc.get("abstract"))]
    for section in doc.get("primaryContentSections") or []:
        parts += blocks(section.get("content"))
    for topic in doc.get("topicSections") or []:
        parts.append("## " + topic.get("title", ""))
        parts.append("\n".join(f"- [{refs.get(i, {}).get('title', i)}]({refs.get(i, {}).get('url', '')})" for i in topic.get("identifiers") or []))
    return "\n\n".join(p for p in parts if p).strip()


def docc_links(source: str | None) -> list[str]:
    """The pages of its own bundle that a render document refers to, sorted."""
    try:
        doc = json.loads(source or "{}")
    except ValueError:
        return []
    return sorted({r["url"] for r in (doc.get("references") or {}).values() if isinstance(r, dict) and str(r.get("url", "")).startswith("/documentation/")})


@F.pandas_udf(StringType())
def markdown_of_html(s: pd.Series) -> pd.Series:
    return s.map(html_to_markdown)


@F.pandas_udf(StringType())
def markdown_of_rst(s: pd.Series) -> pd.Series:
    return s.map(rst_to_markdown)


@F.pandas_udf(StringType())
def markdown_of_docc(s: pd.Series) -> pd.Series:
    return s.map(docc_to_markdown)


@F.pandas_udf(ArrayType(StringType()))
def links_of_docc(s: pd.Series) -> pd.Series:
    return s.map(docc_links)
