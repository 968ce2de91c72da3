"""Where pages come from: sitemaps, llms.txt, page data, batch and fixture files, link crawls. Fetching is injected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored


class HttpError(OSError):
    """What a fetcher raises for a status of 400 or more; after: the seconds of its Retry-After, if it has one."""

    def __init__(self, status: int, after: float = 0.0):
        super().__init__(f"HTTP {status}")
        self.status, self.after = status, after

    def __reduce__(self):
        return HttpError, (self.status, self.after)


def fetch(urls: DataFrame, fetcher: Callable[[str], str], tries: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, parallel: int = 0) -> DataFrame:
    """url, body, error of each URL by an injected fetcher.

    Tried again where it raises OSError, but not for an HttpError of another status than 429 or 500 and up. Waits double
    from `wait` seconds on; a Retry-After goes before them. parallel: into how many tasks the URLs are dealt (0: as they
    are), which bounds how many are fetched at once.
    """

    def one(url: str) -> tuple[str, str | None, str | None]:
        pause = wait
        for n in range(tries):
            try:
                return url, fetcher(url), None
            except OSError as e:
                final = isinstance(e, HttpError) and e.status != 429 and e.status < 500
                if final or n + 1 == tries:
                    return url, None, str(e)
                sleep(e.after if isinstance(e, HttpError) and e.after > 0 else pause)
                pause *= 2
        return url, None, "not tried"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(url) for url in pdf["url"]], columns=["url", "body", "error"])

    each = urls.select("url").repartition(parallel) if parallel else urls.select("url")
    return each.mapInPandas(run, "url string, body string, error string")


def sitemap_locations(xml: Column) -> Column:
    """The loc values of a sitemap or a sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def sitemap_urls(spark: SparkSession, start: str, fetcher: Callable[[str], str], depth: int = 5) -> DataFrame:
    """All page URLs of a sitemap, indexes followed level by level; more than `depth` levels of them are an error.

    Each level is fetched once. An index that was met before is not followed again.
    """
    level, pages, seen = spark.createDataFrame([(start,)], "url string"), None, spark.createDataFrame([(start,)], "url string")
    for _ in range(depth):
        got = stored(fetch(level, fetcher).filter("body IS NOT NULL"), "sitemaps")
        locs = got.select(F.col("body").contains("<sitemapindex").alias("index"), F.explode(sitemap_locations(F.col("body"))).alias("url"))
        own = locs.filter("NOT index").select("url")
        pages = own if pages is None else pages.unionByName(own)
        level = stored(locs.filter("index").select("url").distinct().join(seen, "url", "left_anti"), "sitemap-level")
        if level.isEmpty():
            return pages.distinct()
        seen = seen.unionByName(level)
    raise ValueError(f"{level.count()} sitemaps lie deeper than {depth} levels; raise depth")


def crawl(edges: DataFrame, start: DataFrame, prefix: str = "", limit: int = 0) -> DataFrame:
    """path and depth of what is reached from start (path) along edges (path, to) below prefix, nearest first.

    A frontier step is a join with the edges less what was seen; steps end when nothing new is found, or where a crawl has
    a budget (limit above 0), when as much is found.
    """
    seen = start.select("path").distinct().withColumn("depth", F.lit(0))
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.join(edges, "path").select(F.col("to").alias("path")).filter(F.col("path").startswith(prefix)).distinct()
        frontier = stored(step.join(seen, "path", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.isEmpty():
            seen = seen.unionByName(frontier)
            if not limit or seen.count() < limit:
                continue
        found = seen.orderBy("depth", "path")
        return found.limit(limit) if limit else found


def crawl_documents(spark: SparkSession, start: str, fetcher: Callable[[str], str], links: Callable[[str], list[str]], prefix: str = "", limit: int = 0, parallel: int = 0) -> DataFrame:
    """path, depth, body of the documents reached from start by the links that `links` reads in a body.

    Each level is fetched once and stored; a document that can't be fetched has no links. limit: as in crawl().
    """
    level = spark.createDataFrame([(start,)], "url string")
    seen, depth = level, 0
    out = None
    found_in = F.pandas_udf(lambda bodies: bodies.map(lambda b: [] if b is None else list(links(b))), "array<string>")
    while True:
        got = stored(fetch(level, fetcher, parallel=parallel).select(F.col("url").alias("path"), F.lit(depth).alias("depth"), "body"), "crawled")
        out = got if out is None else out.unionByName(got)
        next_ = got.select(F.explode(found_in("body")).alias("url")).filter(F.col("url").startswith(prefix)).distinct().join(seen, "url", "left_anti")
        level, depth = stored(next_, "crawl-level"), depth + 1
        if level.isEmpty() or limit and seen.count() >= limit:
            ordered = out.filter("body IS NOT NULL").orderBy("depth", "path")
            return ordered.limit(limit) if limit else ordered
        seen = seen.unionByName(level)


def llms_pages(text: Column) -> Column:
    """path and body of a combined llms.txt (`===/path===` before each page)."""
    parts = F.split(text, r"(?m)^===")
    real = F.filter(parts, lambda x: x.rlike(r"\A/[^\n=]*===\n?"))
    return F.transform(real, lambda x: F.struct(F.regexp_extract(x, r"\A(/[^\n=]*)===", 1).alias("path"), F.regexp_replace(F.regexp_replace(x, r"\A[^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("body")))


def llms_links(text: Column) -> Column:
    """The links of an llms.txt list as Markdown pages: `.md` added, a directory's index named."""
    links = F.regexp_extract_all(text, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    return F.transform(links, lambda x: F.when(x.endswith(".md"), x).when(x.endswith("/"), F.concat(x, F.lit("index.md"))).otherwise(F.concat(x, F.lit(".md"))))


def page_data_slugs(pages: DataFrame) -> DataFrame:
    """slug of page-data files (path, text): of the queries in them the one with most slugs, without private segments."""
    slugs = F.from_json(F.get_json_object("text", "$.data.allMdx.nodes"), "array<struct<fields:struct<slug:string>,slug:string>>")
    each = pages.select("path", F.transform(slugs, lambda n: F.coalesce(n["slug"], n["fields"]["slug"])).alias("slugs")).filter(F.size("slugs") > 0)
    best = each.agg(F.max_by("slugs", F.struct(F.size("slugs"), F.col("path"))).alias("slugs"))
    private = lambda s: F.exists(F.split(s, "/"), lambda x: x.startswith("_"))
    return best.select(F.explode(F.filter("slugs", lambda s: s.isNotNull() & ~private(s))).alias("slug"))


def batch_questions(spark: SparkSession, text: str) -> DataFrame:
    """query_id, query, source of a JSON array of questions, as strings or as objects with query (or q) and source."""
    rows = []
    for i, x in enumerate(json.loads(text)):
        q, source = (x, None) if isinstance(x, str) else (x.get("query") or x.get("q"), x.get("source"))
        if not q or not q.strip():
            raise ValueError(f"question {i} is empty")
        rows.append((i, q, source))
    if not rows:
        raise ValueError("no questions")
    return spark.createDataFrame(rows, "query_id long, query string, source string")


def fixture(spark: SparkSession, text: str) -> DataFrame:
    """qid, q, expect, source, query_type, note of a YAML (or JSON) fixture; each question needs q and expect."""
    try:
        import yaml

        doc = yaml.safe_load(text)
    except ImportError:
        doc = json.loads(text)
    rows = []
    for i, x in enumerate(doc.get("queries") or []):
        if not x.get("q") or not x.get("expect"):
            raise ValueError(f"question {i} lacks q or expect")
        rows.append((i, x["q"], list(x["expect"]), x.get("source"), x.get("query_type") or doc.get("query_type"), x.get("note")))
    if not rows:
        raise ValueError("no questions")
    return spark.createDataFrame(rows, "qid long, q string, expect array<string>, source string, query_type string, note string")


def thread_markdown(source: str | None) -> str:
    """A discussion's JSON (a listing of the post, a listing of comments) as Markdown, replies indented below."""
    try:
        post, comments = json.loads(source or "")[:2]
        head = post["data"]["children"][0]["data"]
    except (ValueError, KeyError, IndexError, TypeError):
        return ""

    def replies(listing, depth: int) -> list[str]:
        out = []
        for child in (listing or {}).get("data", {}).get("children", []) if isinstance(listing, dict) else []:
            d = child.get("data", {})
            if d.get("body"):
                out.append("  " * depth + f"- **{d.get('author', '')}** ({d.get('score', 0)}): " + " ".join(d["body"].split()))
            out += replies(d.get("replies"), depth + 1)
        return out

    return "\n\n".join(x for x in (f"# {head.get('title', '')}", head.get("selftext", "").strip(), "\n".join(replies(comments, 0))) if x)


def command_markdown(spec: dict) -> str:
    """A command of a CLI's YAML reference as Markdown: title, summary, usage and flags."""
    flags = "\n".join(f"- `{f.get('name', '')}` {f.get('description', '')}".rstrip() for f in spec.get("flags") or [])
    parts = [f"# {spec.get('title') or spec.get('id', '')}", spec.get("summary", ""), spec.get("description", ""), f"```sh\n{spec['usage']}\n```" if spec.get("usage") else "", f"## Flags\n\n{flags}" if flags else ""]
    return "\n\n".join(p.strip() for p in parts if p and p.strip())


def local_changes(files: DataFrame, manifest: DataFrame, max_bytes: int = 2_000_000, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, sha256, change (new, changed, same) of documentation files (path, content) that are neither too large nor excluded."""
    from ..operators.policy import glob_regex

    kept = files.filter(F.lower("path").rlike(r"\.(md|mdx|mdoc|rst)$") & (F.octet_length("content") <= max_bytes))
    for g in exclude:
        kept = kept.filter(~F.col("path").rlike(glob_regex(g)))
    now = kept.select("path", F.sha2("content", 256).alias("sha256"))
    both = now.join(manifest.select("path", F.col("sha256").alias("old")), "path", "left")
    change = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("sha256"), "same").otherwise("changed")
    return both.select("path", "sha256", change.alias("change"))
