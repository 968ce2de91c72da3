"""Column functions over text: tokens, titles, snippets, sizes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that carry no meaning in a question.
STOP_WORDS = tuple(
    "a an and are as at be been being by can could do does for from how i in into is me my of on define or project quick quickest run should the to up use way we what when where which why with would write you".split()
)
# Titles that say nothing about their page.
GENERIC_TITLES = (
    "cli reference", "api reference", "reference", "documentation", "docs", "overview", "welcome", "index", "home",
    "global flags", "usage", "flags", "examples", "parameters", "options", "configuration", "table of contents",
)


def query_tokens(q: Column) -> Column:
    """Lower-case runs of letters, digits, `_` and `-`."""
    return F.filter(F.split(F.lower(F.regexp_replace(q, r"[^\p{L}\p{Nd}_-]", " ")), r"\s+"), lambda x: x != "")


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order: what the index holds of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def without_stop_words(tokens: Column) -> Column:
    """tokens without stop words, or all of them if nothing would be left."""
    kept = F.filter(tokens, lambda x: ~x.isin(*STOP_WORDS))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def fold(term: str) -> str:
    """term without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))


class Porter:
    """The Porter stemmer (M. F. Porter, 1980) for lower-case words, as rules by step."""

    # Suffixes and their replacements by step.
    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(word: str) -> str:
        """word as c (consonant) and v (vowel) for each letter."""
        out = ""
        for i, ch in enumerate(word):
            out += "v" if ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c" else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        return len(re.findall("v+c+", cls.shape(stem)))

    @classmethod
    def short(cls, stem: str) -> bool:
        return cls.shape(stem).endswith("cvc") and stem[-1] not in "wxy"

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        cut = None
        if w.endswith("eed"):
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        elif w.endswith("ed") and "v" in cls.shape(w[:-2]):
            cut = w[:-2]
        elif w.endswith("ing") and "v" in cls.shape(w[:-3]):
            cut = w[:-3]
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                cut += "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and cls.shape(cut)[-1] == "c" and cut[-1] not in "lsz":
                cut = cut[:-1]
            elif cls.measure(cut) == 1 and cls.short(cut):
                cut += "e"
            w = cut
        if w.endswith("y") and "v" in cls.shape(w[:-1]):
            w = w[:-1] + "i"
        for rules in (cls.STEP2, cls.STEP3):
            found = max((s for s in rules if w.endswith(s)), key=len, default=None)
            if found and cls.measure(w[: -len(found)]) > 0:
                w = w[: -len(found)] + rules[found]
        found = max((s for s in (*cls.STEP4, "ion") if w.endswith(s)), key=len, default=None)
        if found and cls.measure(w[: -len(found)]) > 1 and (found != "ion" or w[: -len(found)].endswith(("s", "t"))):
            w = w[: -len(found)]
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or m == 1 and not cls.short(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and cls.measure(w) > 1:
            w = w[:-1]
        return w


@F.pandas_udf(StringType())
def stem(terms: pd.Series) -> pd.Series:
    """Folded and stemmed terms; apply it to distinct terms."""
    return terms.map(lambda t: None if t is None else Porter.stem(fold(t)))


_STEMS: dict[str, str] = {}


def _stem(term: str) -> str:
    """The folded stem of a term; a worker remembers those of a million terms."""
    if (found := _STEMS.get(term)) is None:
        if len(_STEMS) > 1_000_000:
            _STEMS.clear()
        found = _STEMS[term] = Porter.stem(fold(term))
    return found


@F.pandas_udf(ArrayType(StringType()))
def stems(terms: pd.Series) -> pd.Series:
    """Folded and stemmed terms of arrays."""
    return terms.map(lambda ts: None if ts is None else [_stem(t) for t in ts])


def html_title(html: Column) -> Column:
    """The title element without the site's name: what follows a bar, a dash before `docs`, or two prefixes."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(name), F.lit(ch))
    t = F.trim(F.regexp_replace(F.regexp_replace(raw, " ", " "), r"\s+", " "))
    t = F.regexp_replace(t, r"^(.+) \| .*$", "$1")
    t = F.trim(F.when(F.lower(t).rlike(r"^.+ - [^-]*(docs|documentation)"), F.regexp_replace(t, r"^(.+) - .*$", "$1")).otherwise(t))
    two = (F.length(t) - F.length(F.replace(t, F.lit(": "), F.lit("")))) >= 4
    return F.trim(F.when(two, F.element_at(F.split(t, ": "), -1)).otherwise(t))


def page_title(path: Column, body: Column) -> Column:
    """Front matter title, first heading, second-level heading behind a generic first, or the file's name."""
    generic = lambda t: F.lower(t).isin(*GENERIC_TITLES)
    none = lambda t: F.when(F.trim(t) == "", None).otherwise(F.trim(t))
    front = none(F.regexp_extract(body, r"(?s)\A---\n(?:(?!\n---).)*?\n?title:[ \t]*[\"']?([^\"'\n]+)", 1))
    h1 = none(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1))
    h2 = none(F.regexp_extract(body, r"(?m)^##[ \t]+(.+)$", 1))
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.mdx?$", "")
    name = none(F.when(base == "index", "").otherwise(F.translate(base, "-_", "  ")))
    good = lambda t: F.when(~generic(t), t)
    return F.coalesce(good(front), good(h1), F.when(h1.isNotNull(), good(h2)), name, h1, F.lit(""))


def without_front_matter(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n?", "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the trimmed bytes, rounded up."""
    return F.floor((F.octet_length(F.trim(text)) + 3) / 4).cast("long")


def slug(path: Column, limit: int = 120) -> Column:
    """A file name from the last telling segment of a URL path."""
    digits = lambda s: F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))
    telling = F.filter(F.split(path, "/"), lambda s: (F.length(s) >= 4) & (2 * digits(s) < F.length(s)))
    last = F.coalesce(F.try_element_at(telling, F.lit(-1)), F.lit("index"))
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(last), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", ""), 1, limit)


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("long")


def snippets(body: Column, query: Column, most: int = 3, size: int = 160) -> Column:
    """The lines with most distinct query words (line, text), at most `most`; see cut()."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != ""))
    lines = F.transform(F.split(body, "\n"), lambda t, i: F.struct((-F.size(F.filter(tokens, lambda w: F.contains(F.lower(t), w)))).alias("score"), (i + 1).alias("line"), t.alias("text")))
    best = F.slice(F.sort_array(F.filter(lines, lambda x: x["score"] < 0)), 1, most)
    return F.transform(best, lambda x: F.struct(x["line"].alias("line"), cut(F.trim(x["text"]), size).alias("text")))


def first_bytes(text: Column, size: int) -> Column:
    """The longest beginning of text with at most `size` bytes of UTF-8; no character is split."""
    raw = F.encode(text, "UTF-8")
    # A character that begins in the last bytes and ends beyond them goes; one that begins there and ends there stays.
    tail = F.reverse(F.sequence(F.greatest(F.lit(1), F.lit(size - 2)), F.lit(size + 1)))
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    start = F.get(F.filter(tail, lambda i: (byte(i) < 0x80) | (byte(i) >= 0xC0)), F.lit(0))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.coalesce(start, F.lit(size + 1)) - 1), "UTF-8"))


def cut(text: Column, size: int) -> Column:
    """text, or if it has over `size` bytes as much of it as fits with dots behind it."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(first_bytes(text, size - 3), F.lit("...")))


def chunks(texts: Iterator[pd.Series], size: int) -> Iterator[pd.Series]:
    """Pieces of at most `size` bytes, cut at the last blank line of a piece's second half where there is one."""

    def split(text: str | None) -> list[str]:
        raw, out, at = (text or "").encode(), [], 0
        while at < len(raw):
            end = min(len(raw), at + size)
            if end < len(raw):
                gap = raw.rfind(b"\n\n", at + size // 2, end)
                if gap > at:
                    end = gap
                while end > at + 1 and raw[end] & 0xC0 == 0x80:
                    end -= 1
            piece = raw[at:end].decode(errors="ignore").strip("\n ")
            if piece:
                out.append(piece)
            at = end
        return out

    # Some texts at a time, so that not all pieces of a batch are held.
    for s in texts:
        for start in range(0, len(s), 128):
            yield s.iloc[start : start + 128].map(split)


def text_chunks(text: Column, size: int = 2000) -> Column:
    @F.pandas_udf("array<string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return chunks(it, size)

    return run(text)


def dedupe_snippets(hits):
    """hits (qid, place, path, snippets) without snippets that a better hit of the query shows already; no hit is lost."""
    from pyspark.sql import Window

    each = hits.select("qid", "place", "path", F.posexplode_outer("snippets").alias("idx", "s"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("qid", F.trim("s.text")).orderBy("place", "idx")))
    kept = F.sort_array(F.collect_list(F.when((F.col("n") == 1) & F.col("s").isNotNull(), F.struct("idx", "s"))))
    return first.groupBy("qid", "place", "path").agg(F.transform(kept, lambda x: x["s"]).alias("snippets"))


def document_window(body: Column, line: Column, size: int = 8000) -> Column:
    """start, text: the lines around a line that fit `size` bytes, as many before it as a quarter of the size allows."""

    @F.pandas_udf("start int, text string")
    def window(bodies: pd.Series, lines: pd.Series) -> pd.DataFrame:
        def of(text: str | None, at: int | None) -> tuple[int, str]:
            rows = (text or "").split("\n")
            here = min(max((at or 1) - 1, 0), len(rows) - 1)
            first, used = here, 0
            while first > 0 and used + len(rows[first - 1].encode()) + 1 <= size // 4:
                first -= 1
                used += len(rows[first].encode()) + 1
            out, used = [], 0
            for row in rows[first:]:
                cost = len(row.encode()) + bool(out)
                if used + cost > size:
                    if not out:
                        out.append(row.encode()[:size].decode(errors="ignore"))
                    break
                out.append(row)
                used += cost
            return first + 1, "\n".join(out)

        return pd.DataFrame([of(b, n) for b, n in zip(bodies, lines, strict=True)], columns=["start", "text"])

    return window(body, line)
