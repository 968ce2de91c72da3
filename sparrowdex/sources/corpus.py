"""The corpus: one row a page (path, source, rel, title, body, url), from files, documents or web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_title, page_title

# Locale codes of translated pages.
LOCALES = tuple("ar bg cs da de el es fi fr he hi id it ja ko nl no pl pt pt-br ro ru sv th tr uk vi zh zh-cn zh-hans zh-hant zh-tw".split())
NOTE_SOURCES = ("kb", "vault")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Every *.md below root, the first directory as its source; index files are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    below = F.regexp_replace(F.input_file_name(), r"^.*?" + root.rstrip("/").replace("file://", "").replace(".", r"\.") + "/", "")
    return with_paths(files.select(below.alias("path"), F.col("value").alias("body"), F.lit(None).cast("string").alias("url"))).filter(~F.col("path").rlike(r"(^|/)_INDEX\.md$"))


def with_paths(pages: DataFrame) -> DataFrame:
    """source, rel and title from path and body."""
    rel = F.regexp_replace("path", "^[^/]*/", "")
    return pages.select("path", F.substring_index("path", "/", 1).alias("source"), rel.alias("rel"), page_title(F.col("path"), F.col("body")).alias("title"), "body", "url")


def from_documents(docs: DataFrame) -> DataFrame:
    """A documents table as a corpus; the title is the first line up to its first full stop."""
    title = F.trim(F.substring_index(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), ".", 1))
    path = F.concat(F.col("source"), F.lit("/docs/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    rel = F.concat(F.lit("docs/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(path.alias("path"), "source", rel.alias("rel"), title.alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.lit(None).cast("string").alias("url"))


def from_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A pages table: host as source, the URL's path as file name; null paths for pages without a URL. keep: further columns."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    inner = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), r"^/+|/+\z", "")
    rel = F.concat(F.when(inner == "", "index").otherwise(inner), F.lit(".md"))
    return pages.select(F.concat(host, F.lit("/"), rel).alias("path"), host.alias("source"), rel.alias("rel"), html_title(F.col("html")).alias("title"), F.col("html").alias("body"), "url", *keep)


def translated(rel: Column) -> Column:
    """Whether one of the first three segments names another locale than English."""
    return F.exists(F.slice(F.split(rel, "/"), 1, 3), lambda x: F.regexp_replace(F.lower(x), r"\.md$", "").isin(*LOCALES))


def indexable(corpus: DataFrame, note_markers: tuple[str, ...] = ()) -> DataFrame:
    """Rows that belong in the index: no index file, no warning of low content, no translation, no marked note, a body."""
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    marked = F.lit(False)
    for m in note_markers:
        marked = marked | name.contains(m)
    warning = F.coalesce(F.col("warning"), F.lit("")) if "warning" in corpus.columns else F.lit("")
    return corpus.filter(~F.col("rel").rlike(r"(^|/)_INDEX\.md$") & ~warning.contains("low-content") & ~translated(F.col("rel")) & ~(F.col("source").isin(*NOTE_SOURCES) & marked) & (F.trim("body") != ""))


def with_hub_flag(corpus: DataFrame) -> DataFrame:
    """is_hub: the corpus has a directory with the page's name beside it."""
    parts = F.split("path", "/")
    dirs = corpus.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).filter(F.size(F.split("dir", "/")) > 0).distinct()
    stem = F.regexp_replace("path", r"\.md$", "")
    return corpus.join(dirs.withColumn("is_hub", F.lit(True)), stem == F.col("dir"), "left").drop("dir").withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))


def canonical_path(path: Column) -> Column:
    """A logical path: forward slashes, no `.` or empty segments; null where it is absolute or leaves its root."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    return F.when(p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0), None).otherwise(F.array_join(parts, "/"))
