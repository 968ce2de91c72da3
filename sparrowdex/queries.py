"""The engine's registered queries over the driver's tables, and DuckDB SQL for them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.tables import shared_dir
from .operators import bm25 as B
from .operators import calls as CA
from .operators import evaluation as EV
from .operators import manifest as M
from .operators import policy as P
from .operators import rank as R
from .operators import segments as SG
from .operators import telemetry as TL
from .operators import urls as U
from .operators import vectors as V
from .plans import query as Q
from .plans import search as S
from .sources import corpus as C
from .sources import discover as D
from .sources import markup as MU
from .streaming import corpora as CO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_documents(table(spark, sf_dir, "documents"))


CORPUS = "corpus AS (SELECT source || '/docs/doc-' || doc_id || '.md' AS path, source, 'docs/doc-' || doc_id || '.md' AS rel, trim(split_part(split_part(coalesce(text, ''), chr(10), 1), '.', 1)) AS title, coalesce(text, '') AS body FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS qid, regexp_replace(trim(text), '\\s+', ' ', 'g') AS q FROM benchmark)"
TOKENS = (
    "fields AS (SELECT path, source, unnest(['title', 'path', 'body']) AS field, unnest([title, path, body]) AS txt FROM corpus), "
    "lists AS (SELECT path, source, field, list_filter(regexp_split_to_array(lower(txt), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS ts FROM fields), "
    "toks AS (SELECT path, source, field, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM lists)"
)
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"WITH {CORPUS} SELECT source, count(*) AS n_pages, CAST(sum(length(body)) AS BIGINT) AS n_chars, count(DISTINCT title) AS n_titles FROM corpus GROUP BY source")
def corpus_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_pages"), F.sum(F.length("body").cast("long")).alias("n_chars"), F.count_distinct("title").alias("n_titles"))


@query(f"WITH {CORPUS}, {TOKENS} SELECT field, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, count(DISTINCT path) AS n_pages FROM toks GROUP BY field")
def index_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tokens(corpus(spark, sf_dir)).groupBy("field").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"), F.count_distinct("path").alias("n_pages"))


@query(f"WITH {QUESTIONS}, t AS (SELECT qid, list_filter(regexp_split_to_array(lower(regexp_replace(q, '[^\\p{{L}}\\p{{Nd}}_-]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS ts FROM questions), k AS (SELECT qid, ts, list_filter(ts, lambda x: NOT list_contains({STOPS}, x)) AS kept FROM t) SELECT qid, array_to_string(ts, ' ') AS tokens, array_to_string(CASE WHEN len(kept) = 0 THEN ts ELSE kept END, ' ') AS kept FROM k")
def query_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.query_tokens(F.col("text")).alias("ts"))
    return q.select("qid", F.array_join("ts", " ").alias("tokens"), F.array_join(T.without_stop_words(F.col("ts")), " ").alias("kept"))


def index_of(spark: SparkSession, sf_dir: str, stemmed: bool) -> B.Index:
    """The stored index of the documents, brought up to them: built at first, then by what has changed since.

    It lies in the session's shared folder under a name made from the table's path; where the table's files are the same as
    at the last call nothing is read.
    """
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir} {stemmed}".encode()).hexdigest()[:24]
    return SG.refresh(corpus(spark, sf_dir), f"{shared_dir(spark)}/index-{name}", stemmed, SG.fingerprint(spark, f"{sf_dir}/documents.parquet")).index


def _strict(spark: SparkSession, sf_dir: str, weights: dict[str, float], phrase: bool = False, index: B.Index | None = None) -> DataFrame:
    """Strict body tier over unstemmed terms."""
    rows = []
    for qid, q, _ in S.questions_of(table(spark, sf_dir, "benchmark")):
        terms = [w for t in Q.tokenize(q) for w in Q._phrase(t)]
        parts = [terms] if phrase else [[t] for t in dict.fromkeys(Q.without_stop_words(terms))]
        rows += [(qid, "body", 0, i, i, p, None) for i, p in enumerate(parts) if p]
    found = B.ranked(index or index_of(spark, sf_dir, False), spark.createDataFrame(rows, B.LEAF_SCHEMA), {"body": (weights, B.FIELDS)})
    return B.top(found, 10).select("qid", "path", R.tier_score(F.col("rank")).alias("score"), F.round("rank", 6).alias("rank"))


def _strict_sql(weights: tuple[int, int, int], phrase: bool = False) -> str:
    if phrase:
        leaves = "leaves AS (SELECT qid, 0 AS leaf, ts AS terms FROM qt)"
        tf = (
            "lt AS (SELECT qid, leaf, len(terms) AS m, unnest(terms) AS term, unnest(range(len(terms))) AS off FROM leaves), "
            "st AS (SELECT qid, leaf, path, field, pos - off AS start FROM toks JOIN lt USING (term) GROUP BY qid, leaf, path, field, pos - off, m HAVING count(DISTINCT off) = m), "
            "hit AS (SELECT qid, leaf, path, field, count(*) AS tf FROM st GROUP BY ALL)"
        )
    else:
        leaves = f"kept AS (SELECT qid, CASE WHEN len(list_filter(ts, lambda x: NOT list_contains({STOPS}, x))) = 0 THEN ts ELSE list_filter(ts, lambda x: NOT list_contains({STOPS}, x)) END AS ts FROM qt), leaves AS (SELECT DISTINCT qid, unnest(ts) AS leaf FROM kept)"
        tf = "hit AS (SELECT qid, leaf, path, field, count(*) AS tf FROM toks JOIN leaves ON term = leaf GROUP BY ALL)"
    return f"""
WITH {CORPUS}, {TOKENS},
qt AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') AS ts FROM benchmark),
{leaves}, {tf},
f AS (SELECT qid, leaf, path, sum(tf * CASE field WHEN 'title' THEN {weights[0]} WHEN 'path' THEN {weights[1]} ELSE {weights[2]} END) AS f FROM hit GROUP BY ALL),
len_ AS (SELECT path, count(*) AS n FROM toks GROUP BY path), st_ AS (SELECT count(*) AS np, avg(n) AS av FROM len_),
df AS (SELECT qid, leaf, count(*) AS df FROM f GROUP BY ALL), need AS (SELECT qid, count(*) AS need FROM leaves GROUP BY qid),
s AS (SELECT f.qid, f.path, count(*) AS have, -sum(greatest(ln((np - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av))) AS rank FROM f JOIN df USING (qid, leaf) JOIN len_ USING (path), st_ GROUP BY f.qid, f.path),
m AS (SELECT s.qid, path, rank, row_number() OVER (PARTITION BY s.qid ORDER BY round(rank, 9), string_split(path, '/')) AS place FROM s JOIN need ON need.qid = s.qid AND have = need)
SELECT qid, path, CAST(trunc(round(-rank * 10, 9)) AS INT) AS score, round(rank, 6) AS rank FROM m WHERE place <= 10
"""


@query(_strict_sql((1, 1, 1)))
def search_strict_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir, {"title": 1, "path": 1, "body": 1})


def _earlier(c: DataFrame) -> DataFrame:
    """The corpus as it may have been: a part of the pages older, a part missing, and some that are gone now."""
    part = F.pmod(F.xxhash64("path"), F.lit(40))
    older = c.withColumn("body", F.when(part == 0, F.concat(F.lit("older words stood here "), F.substring("body", 1, 500))).otherwise(F.col("body")))
    old_pages = c.filter(part == 1).select(F.concat("path", F.lit(".old")).alias("path"), *(x for x in c.columns if x != "path"))
    return older.filter(part != 2).unionByName(old_pages)


@query(_strict_sql((1, 1, 1)))
def index_segments_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict tier over an index that was built for an earlier corpus, and brought up by upserts and deletes in two versions."""
    c, folder = corpus(spark, sf_dir), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    first = SG.build(_earlier(c), folder)
    changed, lost = SG.difference(first, c)
    SG.apply(spark, folder, fresh=changed)
    return _strict(spark, sf_dir, {"title": 1, "path": 1, "body": 1}, index=SG.apply(spark, folder, removed=lost).index)


@query(_strict_sql((5, 3, 1)))
def search_strict_documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir, {"title": 5, "path": 3, "body": 1})


@query(_strict_sql((1, 1, 1), True))
def search_exact_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir, {"title": 1, "path": 1, "body": 1}, True)


@query()
def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers with stemming, re-ranked; tests hold the tiers against SQLite, and the re-ranking against a plain model."""
    hits = S.search(corpus(spark, sf_dir), S.questions_of(table(spark, sf_dir, "benchmark")), index=index_of(spark, sf_dir, True))
    return hits.select("qid", "place", "path", "source", "title", F.col("score").cast("long").alias("score"), F.to_json("snippets").alias("snippets"))


SCAN = """
qt AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ts FROM benchmark),
w AS (SELECT path, unnest(list_filter(regexp_split_to_array(lower(body), '\\s+'), lambda x: x <> '')) AS word FROM corpus),
v AS (SELECT path, word, count(*) AS n FROM w GROUP BY ALL), asked AS (SELECT qid, t, count(*) AS k FROM (SELECT qid, unnest(ts) AS t FROM qt) GROUP BY ALL),
occ AS (SELECT word, t, (length(word) - length(replace(word, t, ''))) // length(t) AS k FROM (SELECT DISTINCT word FROM v), (SELECT DISTINCT t FROM asked) WHERE contains(word, t)),
pt AS (SELECT path, t, sum(n * k) AS n FROM v JOIN occ USING (word) GROUP BY ALL),
pb AS (SELECT qid, path, sum(k * n) AS score FROM pt JOIN asked USING (t) GROUP BY ALL),
ti AS (SELECT DISTINCT qid, path FROM (SELECT path, lower(title) AS title FROM corpus), asked WHERE contains(title, t)),
s AS (SELECT qid, path, CAST(coalesce(score, 0) + CASE WHEN ti.qid IS NULL THEN 0 ELSE 5 END AS BIGINT) AS score FROM pb FULL JOIN ti USING (qid, path)),
scanned AS (SELECT qid, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM s WHERE score > 0 QUALIFY place <= 10)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q")))


@query(f"WITH {CORPUS}, {SCAN} SELECT qid, path, score, place FROM scanned")
def search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("qid", "path", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query("""
WITH d AS (SELECT doc_id, source, lang || '/' || CASE WHEN doc_id % 7 = 0 THEN '_INDEX.md' ELSE doc_id || '.md' END AS rel, coalesce(text, '') AS body FROM documents)
SELECT source, count(*) AS n FROM d WHERE rel NOT LIKE '%_INDEX.md' AND split_part(rel, '/', 1) NOT IN ('de', 'es', 'fr') AND trim(body) <> '' GROUP BY source
""")
def indexable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rel = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "_INDEX").otherwise(F.col("doc_id").cast("string")), F.lit(".md"))
    pages = d.select("source", rel.alias("rel"), F.coalesce("text", F.lit("")).alias("body"))
    return C.indexable(pages).groupBy("source").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
c AS (SELECT page_id, host || '/' || CASE WHEN trim(path, '/') = '' THEN 'index' ELSE trim(path, '/') END || '.md' AS path FROM p),
d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM c, (SELECT unnest(range(1, 12)) AS k) WHERE k < len(string_split(path, '/')))
SELECT page_id, c.path, d.dir IS NOT NULL AS is_hub FROM c LEFT JOIN d ON d.dir = regexp_replace(c.path, '\\.md$', '')
""")
def hub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.from_pages(table(spark, sf_dir, "pages"), ("page_id",)).select("page_id", "path")
    return C.with_hub_flag(c).select("page_id", "path", "is_hub")


@query("""
WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages),
u AS (SELECT page_id, trim(regexp_replace(t, '^(.+) \\| .*$', '\\1')) AS t FROM t)
SELECT page_id, CASE WHEN len(string_split(t, ': ')) > 2 THEN trim(list_last(string_split(t, ': '))) ELSE t END AS title FROM u
""")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS link FROM pages)
SELECT link, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM l WHERE link <> '' AND link NOT LIKE '#%' AND NOT regexp_matches(lower(link), '^(mailto|javascript|tel|data):') GROUP BY link
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(U.html_links(F.col("html"))).alias("link"))
    return each.groupBy("link").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query("""
WITH u AS (SELECT page_id AS idx, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[.,;:]+$', '') AS url FROM pages)
SELECT min(idx) AS idx, url FROM u WHERE url <> '' GROUP BY url
""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.dedupe_urls(table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url"))


LOCALE_URLS = "u AS (SELECT page_id * 2 + k AS idx, regexp_replace(url, '[?#].*$', '') || CASE WHEN k = 0 THEN '?hl=' || page_id % 3 WHEN page_id % 2 = 0 THEN '?ref=' || page_id ELSE '?lang=x' END AS url FROM pages, (SELECT unnest([0, 1]) AS k))"


@query(f"""
WITH {LOCALE_URLS}, h AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS key, regexp_matches(url, '(?i)[?&](hl|lang|locale|language)=') AS has FROM u)
SELECT min(idx) OVER (PARTITION BY key) AS idx, url FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY has, idx) = 1
""")
def url_locale_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    end = F.when(F.col("k") == 0, F.concat(F.lit("?hl="), (F.col("page_id") % 3).cast("string"))).when(F.col("page_id") % 2 == 0, F.concat(F.lit("?ref="), F.col("page_id").cast("string"))).otherwise("?lang=x")
    return U.dedupe_locales(p.select((F.col("page_id") * 2 + F.col("k")).alias("idx"), F.concat("u", end).alias("url")))




@query("""
WITH p AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
r AS (SELECT DISTINCT host, unnest([0, 1]) AS idx, unnest(['/fr/', '/']) AS prefix, unnest(['fr-' || host, host]) AS source FROM p),
m AS (SELECT DISTINCT url, idx, source, trim(substring(path, length(prefix) + 1), '/') AS rest FROM p JOIN r USING (host) WHERE starts_with(path, prefix))
SELECT url, source, CASE WHEN rest = '' THEN 'index' ELSE rest END || '.md' AS rel FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY idx) = 1
""")
def url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    hosts = pages.select(host.alias("host")).distinct()
    routes = hosts.select(F.lit(0).alias("idx"), "host", F.lit("/fr/").alias("prefix"), F.concat(F.lit("fr-"), "host").alias("source")).unionByName(hosts.select(F.lit(1).alias("idx"), "host", F.lit("/").alias("prefix"), F.col("host").alias("source")))
    return U.route(pages.select("url").distinct(), routes)


FIRST_157 = "left(trim(txt), list_max(list_filter(range(0, 158), lambda n: strlen(left(trim(txt), n)) <= 157)))"


@query(f"""WITH {CORPUS}, {SCAN}, l AS (SELECT qid, path, ts, unnest(string_split(body, chr(10))) AS txt, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM scanned JOIN corpus USING (path) JOIN qt USING (qid)),
h AS (SELECT qid, path, line, txt, len(list_filter(list_distinct(ts), lambda t: contains(lower(txt), t))) AS hits FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY hits DESC, line) AS n FROM h WHERE hits > 0)
SELECT qid, path, CAST(line AS INT) AS line, CASE WHEN strlen(trim(txt)) > 160 THEN {FIRST_157} || '...' ELSE trim(txt) END AS text FROM r WHERE n <= 3""")
def snippet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every question's hits by the scan, the lines with most of its words."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    both = _scanned(spark, sf_dir).select("qid", "path").join(corpus(spark, sf_dir).select("path", "body"), "path").join(q, "qid")
    return both.select("qid", "path", F.explode(T.snippets(F.col("body"), F.col("q"))).alias("s")).select("qid", "path", "s.line", "s.text")


@query(f"WITH {CORPUS} SELECT path, CAST((strlen(trim(body)) + 3) // 4 AS BIGINT) AS tokens, strlen(trim(body)) < 200 AS low_content FROM corpus")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path", T.approx_tokens(F.col("body")).alias("tokens"), (F.octet_length(F.trim("body")) < 200).alias("low_content"))


MANIFEST = "m AS (SELECT page_id % 3 AS run, regexp_replace(url, '[?#].*$', '') AS url, 'p' || page_id % 40 AS path, CAST(page_id AS VARCHAR) AS fetched_at FROM pages)"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select((F.col("page_id") % 3).alias("run"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.concat(F.lit("p"), (F.col("page_id") % 40).cast("string")).alias("path"), F.col("page_id").cast("string").alias("fetched_at"))


@query(f"WITH {MANIFEST} SELECT url, max(run) AS run FROM m GROUP BY url")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_runs(_manifest(spark, sf_dir)).select("url", "run")


@query(f"WITH {MANIFEST} SELECT url, path, fetched_at FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY fetched_at DESC, url) = 1")
def manifest_dedupe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedupe_paths(_manifest(spark, sf_dir)).select("url", "path", "fetched_at")


FATES = """
o AS (SELECT 'u' || page_id AS url, 'p' || page_id AS path FROM pages WHERE page_id % 5 <> 0), n AS (SELECT 'u' || page_id AS url, 'q' || page_id AS path, page_id % 4 = 0 AS skipped FROM pages WHERE page_id % 3 <> 0),
f AS (SELECT coalesce(o.url, n.url) AS url, o.path AS op, n.path AS np, CASE WHEN n.url IS NULL THEN 'pruned' WHEN skipped AND o.url IS NOT NULL THEN 'kept' WHEN skipped THEN 'skipped' ELSE 'fresh' END AS fate FROM o FULL JOIN n ON o.url = n.url)
"""


def _fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("i"))
    old = p.filter("page_id % 5 <> 0").select(F.concat(F.lit("u"), "i").alias("url"), F.concat(F.lit("p"), "i").alias("path"))
    new = p.filter("page_id % 3 <> 0").select(F.concat(F.lit("u"), "i").alias("url"), F.concat(F.lit("q"), "i").alias("path"), (F.col("page_id") % 4 == 0).alias("skipped"))
    return M.replace_manifest(old, new)


@query(f"WITH {FATES} SELECT url, CASE WHEN fate = 'fresh' THEN np ELSE op END AS path, fate FROM f")
def manifest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fates(spark, sf_dir).select("url", "path", "fate")


@query(f"WITH {FATES}, c AS (SELECT count(op) AS n_old, count(*) FILTER (fate = 'pruned') AS n_pruned FROM f) SELECT n_old, n_pruned, NOT (n_pruned >= 50 OR (n_pruned >= 5 AND n_pruned > 0.1 * n_old)) AS allowed FROM c")
def manifest_deletion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.deletion_guard(_fates(spark, sf_dir))


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE 'old' END AS body FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 10 = 0")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    base, fresh = o.filter("path % 7 <> 0").withColumn("body", F.lit("old")), o.filter("path % 10 = 0").withColumn("body", F.lit("new"))
    return M.upsert(base, fresh)


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 7 = 0")
def index_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return M.missing(o, o.filter("path % 7 <> 0"))


@query(f"WITH {CORPUS} SELECT path, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE title END AS title FROM corpus WHERE source NOT IN ('src1', 'src2') OR length(body) > 500")
def index_replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    fresh = c.filter(F.col("source").isin("src1", "src2") & (F.length("body") > 500)).withColumn("title", F.lit("new"))
    return M.replace_source(c, fresh).select("path", "title")


@query(f"""
WITH {CORPUS}, p AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS path, coalesce(html, '') AS html FROM pages),
c AS (SELECT path, source, sha256(body) AS digest FROM corpus UNION ALL SELECT host || '/' || CASE WHEN path = '' THEN 'index' ELSE path END || '.md', host, sha256(html) FROM p)
SELECT path, source, CASE WHEN source = 'src1' THEN 'swapped' ELSE max(digest) END AS digest FROM c WHERE source <> 'src2' AND path IS NOT NULL GROUP BY path, source
""")
def corpus_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus kept by two streams with checkpoints of their own, of the documents and of the pages; then one source is swapped and one taken out."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, pages_of in (("documents", C.from_documents), ("pages", C.from_pages)):
        # A pattern, as a stream can't start from the path of a single file.
        rows = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")
        changes = pages_of(rows).select("path", "source", F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"))
        CO.upsert_stream(changes, folder, f"{folder}-{name}").awaitTermination()
    CO.swap_source(spark, folder, CO.current(spark, folder).filter("source = 'src1'").withColumn("digest", F.lit("swapped")), "src1")
    CO.publish(spark, folder, sources=["src2"])
    return CO.current(spark, folder)


@query(f"WITH {CORPUS} SELECT source, 'docs' AS grp, rel, '- [' || title || '](' || rel || ')' AS line FROM corpus")
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_index(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT source, count(*) AS n, '- [' || source || '](' || source || '/_INDEX.md) (' || count(*) || ')' AS line FROM corpus GROUP BY source")
def top_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_index(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT source, 'docs' AS section, path, '- [' || title || '](' || path || ')' AS line FROM corpus")
def llms_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.llms_txt(corpus(spark, sf_dir))


# Vectors: path = labelL/vec-N; those whose id is divisible by 20 are the questions, against all.
VECS = "v AS (SELECT vec_id, 'label' || label || '/vec-' || vec_id AS path, embedding FROM embeddings), q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0)"
COSINE = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))))"
NEAREST = f"{VECS}, s AS (SELECT qid, path, round({COSINE} - 0.005, 9) AS score FROM v, q), n AS (SELECT qid, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM s QUALIFY place <= 10)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("label"), F.col("label").cast("string"), F.lit("/vec-"), F.col("vec_id").cast("string"))
    return e.select("vec_id", path.alias("path"), "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(f"WITH {NEAREST} SELECT qid, path, round(score, 6) AS score, place FROM n")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return V.nearest(v, q, 10).select("qid", "path", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {VECS}, s AS (SELECT qid, vec_id, round({COSINE}, 6) AS score FROM v, q) SELECT * FROM s")
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's cosine with every vector: the stated queries against all rows, in blocks."""
    v, q = _vectors(spark, sf_dir)
    return V.cosines(v.select("vec_id", "embedding"), q, digits=6)


@query(f"WITH {VECS}, c AS (SELECT qid, 'page' || vec_id % 50 AS path, max(round({COSINE}, 9)) AS score FROM v, q GROUP BY ALL) SELECT qid, path, round(score, 6) AS score FROM c")
def vector_chunk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    page = F.concat(F.lit("page"), (F.col("vec_id") % 50).cast("string")).alias("path")
    return V.best_cosines(v.select(page, "embedding"), q).select("qid", "path", F.round("score", 6).alias("score"))


TEXT_HITS = "h AS (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY path DESC) AS place FROM (SELECT qid, 'label' || label || '/vec-' || vec_id AS path FROM embeddings JOIN (SELECT vec_id AS qid, vec_id // 20 AS g FROM embeddings WHERE vec_id % 20 = 0) ON vec_id // 20 = g OR vec_id = qid + 21))"


def _text_hits(v: DataFrame, q: DataFrame) -> DataFrame:
    """Made-up hits of a text search: the twenty vectors from a question's on, and the one after."""
    from pyspark.sql import Window

    spans = q.select("qid", F.explode(F.sequence(F.col("qid"), F.col("qid") + 21)).alias("vec_id")).filter("vec_id <> qid + 20")
    return v.join(spans, "vec_id").select("qid", "path", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("path"))).alias("place"))


@query(f"WITH {NEAREST}, {TEXT_HITS}, f AS (SELECT h.qid, h.path, h.place AS tp, round(0.7 / (60 + h.place) + coalesce(0.3 / (60 + n.place), 0), 12) AS fused FROM h LEFT JOIN n USING (qid, path)) SELECT qid, path, round(fused, 9) AS fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, tp) AS place FROM f")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return V.fuse(_text_hits(v, q), V.nearest(v, q, 10)).select("qid", "path", F.round("fused", 9).alias("fused"), F.col("place").cast("long").alias("place"))


@query(f"WITH {NEAREST}, {TEXT_HITS}, u AS (SELECT qid, path, 0 AS part, place FROM h UNION ALL SELECT qid, path, 1, place FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = n.qid AND h.path = n.path)) SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY part, place, path) AS place, 1 - part AS from_text FROM u")
def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return V.hybrid_candidates(_text_hits(v, q), V.nearest(v, q, 10)).select("qid", "path", F.col("place").cast("long").alias("place"), "from_text")


@query(f"WITH {NEAREST}, ab AS (SELECT qid, max(score) FILTER (place = 1) AS a, max(score) FILTER (place = 2) AS b FROM n GROUP BY qid) SELECT qid, coalesce(a > 0 AND (a - b) / a >= 0.5, false) AS confident FROM ab")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return V.confident(V.nearest(v, q, 10), 0.5)


@query(f"WITH {NEAREST}, o AS (SELECT qid, CASE place WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 1000 END AS pos, path, place FROM n) SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY pos, place) AS new_place FROM o")
def reranker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    orders = q.select("qid", F.array(F.lit(3), F.lit(99), F.lit(3), F.lit(1)).alias("order"))
    return V.apply_order(V.nearest(v, q, 10), orders).select("qid", "path", F.col("new_place").cast("long").alias("new_place"))


def _count_blanks(text: str) -> int:
    """Stands for a model: counts blanks, and refuses every seventh count."""
    n = text.count(" ")
    if n % 7 == 0:
        raise ValueError("refused")
    return n


@query("""WITH t AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN 0 ELSE strlen(text) // 4 END AS n, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, text, n, sum(n) OVER (ORDER BY h) <= (SELECT sum(n) // 2 FROM t) AS sent, length(text) - length(replace(text, ' ', '')) AS blanks FROM t),
s AS (SELECT *, CASE WHEN text IS NULL THEN 'empty' WHEN NOT sent THEN 'over budget' WHEN blanks % 7 = 0 THEN 'refused' ELSE 'answered' END AS state FROM r)
SELECT doc_id, state, CASE WHEN state IN ('answered', 'refused') THEN 1 ELSE 0 END AS tries, CAST(CASE WHEN state IN ('answered', 'refused') THEN n ELSE 0 END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN state = 'answered' THEN blanks END AS BIGINT) AS answer FROM s""")
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each document, within half of all documents' tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = F.floor(F.octet_length("text") / 4).cast("long")
    budget = (docs.agg(F.sum(tokens)).first()[0] or 0) // 2
    done = CA.call(docs, "doc_id", "text", _count_blanks, "long", CA.Limits(budget=budget, seconds=0), tokens)
    return done.select("doc_id", "state", "tries", "prompt_tokens", "answer")


def _by_path(q: str, paths: list[str]) -> list[int]:
    """Stands for a reranker: the last path first; every fifth length of a question is refused."""
    if len(q) % 5 == 0:
        raise D.HttpError(400)
    return [i + 1 for i in sorted(range(len(paths)), key=paths.__getitem__, reverse=True)]


@query(f"WITH {CORPUS}, {SCAN}, a AS (SELECT item_id AS qid, length(text) % 5 = 0 AS refused FROM benchmark) SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN refused THEN place END, path DESC) AS place, NOT refused AS reranked FROM scanned JOIN a USING (qid)")
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.tables import stored

    hits = stored(_scanned(spark, sf_dir).select("qid", "path", "place"), "scan-hits")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    ranked, calls = CA.rerank(hits, asked, _by_path)
    known = calls.select("qid", (F.col("state") == "answered").alias("reranked"))
    return ranked.join(known, "qid").select("qid", "path", F.col("place").cast("long").alias("place"), "reranked")


@query("SELECT 'm' || label % 3 AS model, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY 1")
def vector_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return V.models(e.select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"), F.size("embedding").cast("long").alias("dim")))


@query("SELECT vec_id AS path FROM embeddings WHERE vec_id % 6 <> 0 AND NOT (vec_id % 2 = 0 AND vec_id % 3 = 0)")
def vectors_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.col("vec_id").alias("mtime_ns"), F.lit("m").alias("model"))
    return V.to_embed(e, e.filter("path % 6 = 0")).select("path")


# Evaluation: a question expects the pages in whose body its item's words stand side by side; the hits are the scan's.
EXPECT = """its AS (SELECT item_id AS qid, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> ''), ' ') || ' ' AS ph FROM benchmark),
bodies AS (SELECT path, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> ''), ' ') || ' ' AS b FROM corpus), x AS (SELECT qid, path FROM its JOIN bodies ON contains(b, ph) WHERE trim(ph) <> '')"""
CASES = f"""{CORPUS}, {SCAN}, {EXPECT}, hits AS (SELECT qid, path, place, CAST((strlen(trim(body)) + 3) // 4 AS BIGINT) AS tokens FROM scanned JOIN corpus USING (path)), ne AS (SELECT qid, count(*) AS n_expected FROM x GROUP BY qid),
j AS (SELECT hits.*, sum(tokens) OVER (PARTITION BY hits.qid ORDER BY place) AS so_far, x.path IS NOT NULL AS ok FROM hits LEFT JOIN x ON x.qid = hits.qid AND x.path = hits.path),
g AS (SELECT qid, min(place) FILTER (ok) AS first, count(*) FILTER (ok AND place <= 5) AS in5, count(*) AS returned, sum(tokens) AS tokens, min(so_far) FILTER (ok) AS tth FROM j GROUP BY qid),
c AS (SELECT qid, n_expected, coalesce(first, 0) AS first_hit, coalesce(first <= 1, false) AS hit_1, coalesce(first <= 3, false) AS hit_3, coalesce(first <= 5, false) AS hit_5, coalesce(first <= 10, false) AS hit_10, coalesce(in5, 0) / n_expected AS recall_5, coalesce(returned, 0) AS returned, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(tth, 0) AS BIGINT) AS tokens_to_hit FROM ne LEFT JOIN g USING (qid))"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(qid, "body", 0, 0, 0, terms, None) for qid, q, _ in S.questions_of(table(spark, sf_dir, "benchmark")) if (terms := [w for t in Q.tokenize(q) for w in Q._phrase(t)])]
    found = B.ranked(index_of(spark, sf_dir, False), spark.createDataFrame(rows, B.LEAF_SCHEMA), {"body": ({"body": 1}, ("body",))})
    return found.select("qid", "path").groupBy("qid").agg(F.collect_set("path").alias("expect"))


def _eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus(spark, sf_dir).select("path", T.approx_tokens(F.col("body")).alias("tokens"))
    return EV.cases(_expected(spark, sf_dir), _scanned(spark, sf_dir).join(pages, "path"), F.col("tokens"))


@query(f"WITH {CASES} SELECT * FROM c")
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir)


@query(f"""WITH {CASES}, t AS (SELECT coalesce(list_sort(list(tokens) FILTER (tokens > 0)), []) AS ts FROM c)
SELECT count(*) AS n, avg(CAST(hit_1 AS DOUBLE)) AS hit_1, avg(CAST(hit_3 AS DOUBLE)) AS hit_3, avg(CAST(hit_5 AS DOUBLE)) AS hit_5, avg(CAST(hit_10 AS DOUBLE)) AS hit_10, round(avg(CASE WHEN first_hit > 0 THEN 1.0 / first_hit ELSE 0 END), 9) AS mrr, round(avg(recall_5), 9) AS recall_5,
any_value(ts[CAST(floor((len(ts) - 1) * 0.5) AS INT) + 1]) AS tokens_p50, any_value(ts[CAST(floor((len(ts) - 1) * 0.99) AS INT) + 1]) AS tokens_p99 FROM c, t""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.summary(_eval(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mrr", "recall_5")})


@query(f"WITH {CASES} SELECT budget, avg(CAST(first_hit > 0 AND tokens_to_hit <= budget AS DOUBLE)) AS rate FROM c, (SELECT unnest([400, 4000, 40000]) AS budget) GROUP BY budget")
def eval_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.within_budget(_eval(spark, sf_dir), [400, 4000, 40_000])


RUNS = "a AS (SELECT item_id AS qid, 'q' || item_id % 30 AS q, item_id % 6 AS first_hit FROM benchmark), b AS (SELECT item_id AS qid, 'q' || item_id % 35 AS q, item_id % 4 AS first_hit FROM benchmark WHERE item_id > 1)"


@query(f"""WITH {RUNS}, x AS (SELECT q, arg_max(first_hit, qid) AS before FROM a GROUP BY q), y AS (SELECT q, arg_max(first_hit, qid) AS now FROM b GROUP BY q),
z AS (SELECT coalesce(x.q, y.q) AS q, before, now, CASE WHEN now > 0 THEN now ELSE 100 END - CASE WHEN before > 0 THEN before ELSE 100 END AS d FROM x FULL JOIN y ON x.q = y.q)
SELECT q, before, now, CASE WHEN before IS NOT NULL AND now IS NOT NULL THEN d END AS delta, CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN d < 0 THEN 'better' WHEN d > 0 THEN 'worse' ELSE 'same' END AS kind FROM z""")
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    run = lambda d, n, m: d.select("qid", F.concat(F.lit("q"), (F.col("qid") % n).cast("string")).alias("q"), (F.col("qid") % m).alias("first_hit"))
    return EV.compare(run(b, 30, 6), run(b.filter("qid > 1"), 35, 4))


@query("WITH a AS (SELECT source, count(*) AS before FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src3' GROUP BY source), b AS (SELECT source, count(*) AS now FROM documents WHERE doc_id % 5 <> 0 AND source <> 'src4' GROUP BY source) SELECT coalesce(a.source, b.source) AS source, coalesce(before, 0) AS before, coalesce(now, 0) AS now FROM a FULL JOIN b ON a.source = b.source WHERE coalesce(before, 0) <> coalesce(now, 0)")
def eval_source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return EV.source_drift(d.filter("doc_id % 3 <> 0 AND source <> 'src3'"), d.filter("doc_id % 5 <> 0 AND source <> 'src4'"))


@query(f"WITH {CORPUS}, {EXPECT} SELECT qid, path FROM x WHERE CAST(regexp_extract(path, '([0-9]+)\\.md$', 1) AS BIGINT) % 2 = 1")
def eval_unknown_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = C.from_documents(table(spark, sf_dir, "documents").filter("doc_id % 2 = 0")).select("path")
    return EV.unknown_expectations(_expected(spark, sf_dir), known)


LOG = "log AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'q ' || user_id % 97 AS query, CASE event_type WHEN 'view' THEN 'eval' WHEN 'click' THEN 'shell' WHEN 'error' THEN 'agent' WHEN 'signup' THEN 'web' ELSE 'bench' END AS run_context, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS result_count FROM events)"
TRAFFIC = "CASE WHEN regexp_matches(run_context, 'eval|bench|test') THEN 'evaluation' WHEN regexp_matches(run_context, 'agent|bot|batch|cron|ci') THEN 'automated' ELSE 'human' END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.expr("CASE event_type WHEN 'view' THEN 'eval' WHEN 'click' THEN 'shell' WHEN 'error' THEN 'agent' WHEN 'signup' THEN 'web' ELSE 'bench' END")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.concat(F.lit("q "), (F.col("user_id") % 97).cast("string")).alias("query"), context.alias("run_context"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("result_count"), F.lit(None).cast("string").alias("top_path"))


@query(f"WITH {LOG} SELECT {TRAFFIC} AS traffic, count(*) AS entries, count(DISTINCT query) AS queries, round(avg(CAST(result_count = 0 AS DOUBLE)), 9) AS zero FROM log GROUP BY 1")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.summary(_log(spark, sf_dir)).withColumn("zero", F.round("zero", 9))


@query(f"WITH {LOG} SELECT query AS q, max(timestamp) AS timestamp FROM log WHERE {TRAFFIC} = 'human' AND result_count >= 1 AND query NOT IN ('q 1', 'q 2') GROUP BY query")
def telemetry_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Q  1",), ("q 2",)], "q string")
    return TL.mine(_log(spark, sf_dir), known).select("q", "timestamp")


HITS = "hits AS (SELECT CAST(user_id % 50 AS BIGINT) AS qid, 'src' || event_id % 9 || '/docs/' || event_id || '.md' AS path, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS place FROM events)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    path = F.concat(F.lit("src"), (F.col("event_id") % 9).cast("string"), F.lit("/docs/"), i, F.lit(".md"))
    return e.select((F.col("user_id") % 50).alias("qid"), path.alias("path"), F.row_number().over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id")).alias("place"))


@query(f"""WITH {HITS}, p AS (SELECT *, CASE WHEN contains(path, 'src3/') THEN 20 WHEN contains(path, '/docs/1') THEN 5 ELSE 0 END AS penalty FROM hits),
k AS (SELECT *, min(place) FILTER (penalty = 0) OVER w AS c, min(place) FILTER (penalty > 0) OVER w AS d FROM p WINDOW w AS (PARTITION BY qid)),
n AS (SELECT qid, path, penalty, row_number() OVER (PARTITION BY qid ORDER BY penalty, place) AS new_place FROM k WHERE NOT coalesce(c < d, false) OR penalty = 0)
SELECT * FROM n WHERE new_place <= 10""")
def hygiene_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir).withColumn("penalty", P.hygiene_penalty(F.col("path"), F.lit(None).cast("string"), [("src3/", 20), ("/docs/1", 5)]))
    return P.apply_hygiene(h, 10).select("qid", "path", "penalty", F.col("new_place").cast("long").alias("new_place"))


@query(f"WITH {HITS}, s AS (SELECT *, split_part(path, '/', 1) AS stem FROM hits), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, stem ORDER BY place) = 1) SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY place) AS new_place FROM f QUALIFY new_place <= 5")
def version_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collapse_versions(_hits(spark, sf_dir), F.split("path", "/")[0], 5).select("qid", "path", F.col("new_place").cast("long").alias("new_place"))


@query(f"WITH {CORPUS} SELECT path, source = 'src1' OR (source = 'src2' AND regexp_matches(path, '/docs/doc-[^/]*2\\.md$')) AS in_profile, source = 'src2' AND regexp_matches(path, '/docs/doc-[^/]*2\\.md$') AS in_profile_sub FROM corpus")
def profile_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_match(corpus(spark, sf_dir), [("src1", None), ("src2", "docs/doc-*2.md")]).select("path", "in_profile", "in_profile_sub")


@query(f"WITH {CORPUS}, e AS (SELECT unnest(['src1', 'src2', 'src2']) AS source, unnest(['', 'docs/doc-*2.md', 'nothing/?']) AS \"glob\", unnest(['^.*$', '^docs/doc-[^/]*2\\.md$', '^nothing/[^/]$']) AS re) SELECT source, \"glob\" AS pattern, count(*) FILTER (regexp_matches(rel, re)) AS n FROM e JOIN corpus USING (source) GROUP BY source, \"glob\"")
def profile_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_lint(corpus(spark, sf_dir), [("src1", None), ("src2", "docs/doc-*2.md"), ("src2", "nothing/?")]).withColumnRenamed("glob", "pattern")


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'fam' || c_nationkey || '__v' || c_custkey % 5 ELSE 'fam' || c_nationkey END AS source FROM customer),
v AS (SELECT c_custkey, regexp_extract(source, '^(.*?)(__v|$)', 1) AS family, nullif(regexp_extract(source, '__v(.+)$', 1), '') AS version FROM s)
SELECT c_custkey, family, version, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN version IS NULL THEN 500 ELSE 100 END WHEN c_custkey % 7 = 0 THEN 600 WHEN version IS NULL THEN 300 ELSE 450 END AS score FROM v""")
def version_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.concat(F.lit("fam"), F.col("c_nationkey").cast("string"))
    source = F.when(F.col("c_custkey") % 3 == 0, F.concat(family, F.lit("__v"), (F.col("c_custkey") % 5).cast("string"))).otherwise(family)
    c = table(spark, sf_dir, "customer").select("c_custkey", P.version_of(source).alias("v"))
    return c.select("c_custkey", "v.family", "v.version", P.lane_score(F.col("v.lane"), F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 7 == 0).alias("score"))


@query("""WITH e AS (SELECT 'f' || l_partkey % 20 AS family, 's' || l_suppkey AS scope, CAST(l_quantity AS BIGINT) % 4 AS version, 'file' || l_linenumber AS file, l_linenumber = 1 AS lockfile FROM lineitem),
b AS (SELECT * FROM e QUALIFY lockfile OR NOT bool_or(lockfile) OVER (PARTITION BY family, scope))
SELECT family, scope, version, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM b WHERE version <> 0 GROUP BY family, scope, version""")
def version_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.concat(F.lit("f"), (F.col("l_partkey") % 20).cast("string")).alias("family"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scope"), (F.col("l_quantity").cast("long") % 4).alias("version"), F.concat(F.lit("file"), F.col("l_linenumber").cast("string")).alias("file"), (F.col("l_linenumber") == 1).alias("lockfile"))
    latest = e.select("family").distinct().withColumn("latest_version", F.lit(0).cast("long"))
    return P.pins(e, latest).withColumn("files", F.array_join("files", ","))


@query()
def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms of the corpus with their stems; tests hold the stemmer against SQLite."""
    terms = B.tokens(corpus(spark, sf_dir)).select("term").distinct()
    return terms.select("term", T.stem("term").alias("stem"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("path", F.posexplode(T.text_chunks(F.col("body"), 2000)).alias("chunk_idx", "chunk"))
    return c.select("path", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.octet_length("chunk").cast("long").alias("n_bytes"), F.sha2("chunk", 256).alias("sha256"))


@query()
def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", MU.markdown_of_html("html").alias("markdown"))


@query("SELECT 'src' || c_custkey % 4 AS source, count(*) AS n, min(c_name) AS first, max(c_name) AS last, count(*) - count(DISTINCT c_nationkey) AS n_same FROM customer GROUP BY 1")
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), (F.col("c_custkey") % 4).cast("string")).alias("source"), F.col("c_name").alias("fetched_at"), F.col("c_nationkey").alias("path"))
    return M.status(c).select("source", "n", "first", "last", "n_same")


@query("WITH f AS (SELECT p_partkey AS path, p_size || '.' || p_partkey % 10 || '.0' AS v, p_partkey % 3 AS k FROM part) SELECT path, 'dep' || k AS package, v AS version, k <> 1 AS exact FROM f")
def package_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".0"))
    k = (F.col("p_partkey") % 3).cast("string")
    text = F.concat(F.lit('{"dependencies": {"dep'), k, F.lit('": "'), F.when(k == "1", F.lit("^")).otherwise(F.lit("")), v, F.lit('"}}'))
    return P.package_pins(p.select(F.col("p_partkey").alias("path"), text.alias("text")))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey + 1 AS p, unnest([2 * n_nationkey + 2, 2 * n_nationkey + 3, n_nationkey // 2]) AS t FROM nation),
r AS (SELECT 1 AS p, 0 AS depth UNION SELECT t, depth + 1 FROM r JOIN e USING (p) WHERE depth < 60)
SELECT 'n' || p AS path, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY p""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages link to two below them and one above; all that is linked is reached."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("p"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = n.select(name(F.col("p")).alias("path"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1, F.expr("(p - 1) div 2").cast("int"))).alias("t")).select("path", name(F.col("t")).alias("to"))
    return D.crawl(edges, n.filter("p = 1").select(F.lit("n1").alias("path")), "n").select("path", F.col("depth").cast("long").alias("depth"))


@query("SELECT 'u' || c_custkey AS url, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS unchanged FROM customer WHERE c_custkey % 2 = 0")
def unchanged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("body"))
    new = c.filter("c_custkey % 2 = 0").select("url", F.when(F.col("c_custkey") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"))
    return M.unchanged(c.filter("c_custkey % 4 <> 0").select("url", "body"), new)


@query("SELECT vec_id, 'm' || vec_id % 2 AS model FROM embeddings WHERE vec_id % 2 = 1 OR label <> 1 OR vec_id % 3 = 0")
def vector_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("label"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"))
    v = e.select("vec_id", path.alias("path"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"))
    return V.prune(v, v.filter("vec_id % 3 = 0"), "m0", "label1").select("vec_id", "model")


@query("SELECT 'f' || l_partkey % 20 AS family, 's' || l_suppkey AS scope FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT 'f' || l_partkey % 20, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 2")
def orphan_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", F.concat(F.lit("f"), (F.col("l_partkey") % 20).cast("string")).alias("family"), F.lit(1).alias("version"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scope"))
    pins = lambda n: li.filter(F.col("l_linenumber") == n).drop("l_linenumber").distinct()
    return P.orphans(pins(1), pins(2)).select("family", "scope")


@query(f"WITH {HITS}, b AS (SELECT qid, path FROM hits WHERE place BETWEEN 2 AND 4), d AS (SELECT hits.* FROM hits WHERE place <= 3 AND NOT EXISTS (SELECT 1 FROM b WHERE b.qid = hits.qid AND b.path = hits.path)) SELECT qid, string_agg(path, ',' ORDER BY place) AS paths FROM d GROUP BY qid")
def displacing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    return EV.displacing(h.withColumn("place", F.col("place") - 1).filter("place > 0"), h).select("qid", F.array_join("paths", ",").alias("paths"))


@query(f"WITH {RUNS}, x AS (SELECT q, arg_max(first_hit, qid) AS before FROM a GROUP BY q), y AS (SELECT q, arg_max(first_hit, qid) AS now FROM b GROUP BY q) SELECT q, before, now, CASE WHEN now = 0 THEN 'lost' WHEN now > 10 THEN 'pushed out' ELSE 'slipped' END AS suspect FROM x JOIN y USING (q) WHERE CASE WHEN now > 0 THEN now ELSE 100 END > CASE WHEN before > 0 THEN before ELSE 100 END")
def eval_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    run = lambda d, n, m: d.select("qid", F.concat(F.lit("q"), (F.col("qid") % n).cast("string")).alias("q"), (F.col("qid") % m).alias("first_hit"))
    return EV.suspects(run(b, 30, 6), run(b.filter("qid > 1"), 35, 4))


@query("WITH t AS (SELECT strlen(coalesce(text, '')) // 4 AS k FROM documents) SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens, round(sum(k) * 2.0 / 1000000, 6) AS cents FROM t")
def embedding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    return V.embedding_cost(rows, 2.0).withColumn("cents", F.round("cents", 6))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents WHERE strlen(text) <= 2000000 AND doc_id % 10 <> 7")
def local_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    known = files.filter("doc_id % 3 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content")), 256).alias("sha256"))
    return D.local_changes(files, known, exclude=("*7.md",)).select(F.regexp_replace("path", r"\.md$", "").cast("long").alias("path"), "change")


@query()
def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the default size around the first, the middle and the last line; tests hold them against a plain version."""
    lines = F.size(F.split("body", "\n"))
    c = corpus(spark, sf_dir).select("path", "body", F.explode(F.array_distinct(F.array(F.lit(1), F.ceil(lines / 2).cast("int"), lines))).alias("line"))
    w = c.select("path", "line", "body", T.document_window(F.col("body"), F.col("line")).alias("w"))
    return w.select("path", "line", "w.start", F.octet_length("w.text").alias("n_bytes"), F.sha2("w.text", 256).alias("sha256"))


@query()
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each page is embedded; tests hold the cut against a plain version."""
    text = V.embedding_input(F.col("title"), F.col("body"))
    return corpus(spark, sf_dir).select("path", text.alias("t")).select("path", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("sha256"))


@query("""WITH b AS (SELECT 'v' || vec_id AS path, vec_id % 4 AS chunk_idx, 'm' || vec_id % 2 AS model, label, len(embedding) AS dim, 'old' AS age FROM embeddings WHERE vec_id % 3 <> 0),
f AS (SELECT 'v' || vec_id AS path, unnest([0, 1]) AS chunk_idx, 'm' || vec_id % 2 AS model, label, len(embedding) AS dim, 'new' AS age FROM embeddings WHERE vec_id % 2 = 0)
SELECT * FROM f UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = b.path AND f.model = b.model)""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks, some pages embedded anew, with every dimension checked."""
    e = table(spark, sf_dir, "embeddings")
    path, model = F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model")
    rest = [model, "label", F.size("embedding").alias("dim"), "embedding"]
    before = e.filter("vec_id % 3 <> 0").select(path, (F.col("vec_id") % 4).cast("int").alias("chunk_idx"), *rest, F.lit("old").alias("age"))
    fresh = e.filter("vec_id % 2 = 0").select(path, F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_idx"), *rest, F.lit("new").alias("age"))
    return V.upsert_vectors(before, fresh, True).drop("embedding").withColumns({"dim": F.col("dim").cast("long"), "chunk_idx": F.col("chunk_idx").cast("long")})


@query(f"""WITH {CASES}, n AS (SELECT *, CASE qid % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'odd_type' ELSE 'unknown' END AS name FROM c),
gr AS (SELECT name, count(*) AS n, avg(CAST(hit_1 AS DOUBLE)) AS hit_1, avg(CAST(hit_10 AS DOUBLE)) AS hit_10, round(avg(CASE WHEN first_hit > 0 THEN 1.0 / first_hit ELSE 0 END), 9) AS mrr, list_sort(list(tokens)) AS ts FROM n GROUP BY name)
SELECT row_number() OVER (ORDER BY CASE name WHEN 'lexical' THEN 4 WHEN 'unknown' THEN 99 ELSE 50 END, name) AS place, name, n, hit_1, hit_10, mrr, ts[CAST(floor((len(ts) - 1) * 0.99) AS INT) + 1] AS tokens_p99 FROM gr""")
def eval_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("qid") % 3 == 0, "lexical").when(F.col("qid") % 3 == 1, "odd_type").otherwise("unknown")
    rows = EV.overview(_eval(spark, sf_dir).withColumn("type", kind), "type")
    return rows.select(F.col("place").cast("long").alias("place"), "name", "n", "hit_1", "hit_10", F.round("mrr", 9).alias("mrr"), "tokens_p99")


@query(f"""WITH {CORPUS}, m AS (SELECT coalesce(source, '') AS source, path, CASE WHEN source = 'src1' THEN NULL ELSE strftime(TIMESTAMP '2024-01-01' + to_days(CAST((length(path) * 7 + length(body)) % 50 AS INT)), '%Y-%m-%dT%H:%M:%SZ') END AS fetched_at FROM corpus),
p AS (SELECT source, count(*) AS n_pages, count(*) FILTER (trim(body) <> '') AS n_indexable FROM corpus GROUP BY source),
f AS (SELECT source, min(fetched_at) AS oldest, max(fetched_at) AS last FROM m GROUP BY source),
a AS (SELECT p.source, n_pages, n_indexable, last, oldest, last IS NULL AS missing_fresh, CASE WHEN date_diff('second', CAST(last AS TIMESTAMP), TIMESTAMP '2024-03-01') > 3600 * 264 THEN date_diff('second', CAST(last AS TIMESTAMP), TIMESTAMP '2024-03-01') // 3600 ELSE 0 END AS age_hours FROM p JOIN f USING (source))
SELECT *, row_number() OVER (ORDER BY missing_fresh DESC, age_hours DESC, source) AS place FROM a""")
def corpus_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    days = ((F.length("path") * 7 + F.length("body")) % 50).cast("int")
    at = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), days).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    manifest = c.select("source", "path", F.when(F.col("source") != "src1", at).alias("fetched_at"))
    out = M.staleness(c, manifest, "2024-03-01T00:00:00Z", 264).drop("n_same")
    return out.withColumns({"place": F.col("place").cast("long")})


@query(f"WITH {CORPUS} SELECT count(*) AS n_pages, count(*) AS n_indexed, 0 AS n_missing, 0 AS n_gone, true AS matches FROM corpus")
def index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, False)
    return M.index_match(corpus(spark, sf_dir), B.alive(index.pages, index.gone)).withColumns({c: F.col(c).cast("long") for c in ("n_pages", "n_indexed", "n_missing", "n_gone")})


@query("""WITH f AS (SELECT p_partkey AS k, 'w/' || CASE WHEN p_partkey % 7 = 0 THEN 'node_modules/' ELSE '' END || 'proj' || p_partkey % 3 || '/' || p_partkey || '/' AS dir, p_size || '.' || p_partkey % 10 || '.0' AS v FROM part),
e AS (SELECT k, dir || 'package.json' AS file, 'dep' || k % 5 AS package, v AS version, v AS declared, false AS lockfile FROM f WHERE k % 4 = 0 AND k % 3 <> 1
  UNION ALL SELECT k, dir || 'package-lock.json', 'dep' || k % 5, v, NULL, true FROM f WHERE k % 4 = 1
  UNION ALL SELECT k, dir || 'pnpm-lock.yaml', 'dep' || k % 5, v, '^' || v, true FROM f WHERE k % 4 = 2
  UNION ALL SELECT k, dir || 'go.mod', 'example.com/dep' || k % 5, v, 'v' || v, true FROM f WHERE k % 4 = 3)
SELECT 'fam' || k % 5 AS family, CASE WHEN k % 3 = 2 THEN 'two' ELSE 'all' END AS scope, package, version, declared, file, lockfile FROM e WHERE k % 5 < 3 AND k % 7 <> 0""")
def pin_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What made-up package manifests and lock files of all four kinds say about three families."""
    k = F.col("p_partkey")
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(".0"))
    directory = F.concat(F.lit("w/"), F.when(k % 7 == 0, "node_modules/").otherwise(""), F.lit("proj"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit("/"))
    dep, range_ = F.concat(F.lit("dep"), (k % 5).cast("string")), F.when(k % 3 == 1, "^").otherwise("")
    texts = {
        "package.json": F.concat(F.lit('{"devDependencies": {"'), dep, F.lit('": "'), range_, v, F.lit('", "local": "workspace:*"}}')),
        "package-lock.json": F.concat(F.lit('{"packages": {"": {"version": "1.0.0"}, "node_modules/'), dep, F.lit('": {"version": "'), v, F.lit('"}}}')),
        "pnpm-lock.yaml": F.concat(F.lit("importers:\n  .:\n    dependencies:\n      '"), dep, F.lit("':\n        specifier: ^"), v, F.lit("\n        version: "), v, F.lit("(peer@1.0.0)\n")),
        "go.mod": F.concat(F.lit("module example.com/own\n\nrequire (\n\texample.com/"), dep, F.lit(" v"), v, F.lit("\n)\n")),
    }
    name = F.get(F.array(*(F.lit(n) for n in texts)), (k % 4).cast("int"))
    files = table(spark, sf_dir, "part").select(F.concat(directory, name).alias("path"), F.get(F.array(*texts.values()), (k % 4).cast("int")).alias("text"))
    packages = spark.createDataFrame([(f"{p}dep{i}", f"fam{i}") for i in range(3) for p in ("", "example.com/")], "package string, family string")
    return P.pin_evidence(files, packages, {"w": "all", "w/proj2": "two"})


@query("""WITH h AS (SELECT c_custkey, 'fam' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '__v' || c_custkey % 5 ELSE '' END AS source, CASE WHEN c_custkey % 4 = 1 THEN 'docs/v' || c_custkey % 4 || '/x.md' ELSE 'docs/x.md' END AS rel FROM customer),
i AS (SELECT *, regexp_extract(source, '^(.*?)(__v|$)', 1) AS family, coalesce(nullif(regexp_extract(source, '__v(.+)$', 1), ''), CASE WHEN CAST(substring(split_part(source, '__', 1), 4) AS INT) < 12 AND rel LIKE 'docs/v%' THEN '1' END) AS version FROM h),
l AS (SELECT *, CAST(substring(family, 4) AS INT) < 12 AS known FROM i)
SELECT c_custkey, family, version, CASE WHEN known AND version = '2' THEN 'lts' WHEN version IS NOT NULL AND NOT (known AND version = '3') THEN 'pinned' WHEN known THEN 'latest' ELSE 'unversioned' END AS lane, coalesce(version = '1' AND family IN ('fam1', 'fam2'), false) AS pinned_here FROM l""")
def version_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    source = F.concat(F.lit("fam"), F.col("c_nationkey").cast("string"), F.when(k % 3 == 0, F.concat(F.lit("__v"), (k % 5).cast("string"))).otherwise(""))
    rel = F.when(k % 4 == 1, F.concat(F.lit("/docs/v"), (k % 4).cast("string"), F.lit("/x.md"))).otherwise("/docs/x.md")
    hits = table(spark, sf_dir, "customer").select("c_custkey", source.alias("source"), F.concat(source, rel).alias("path"))
    latest = spark.createDataFrame([(f"fam{i}", "3", "2") for i in range(12)], "family string, latest_version string, lts_version string")
    pins = spark.createDataFrame([("fam1", "here", "1"), ("fam2", "here", "1"), ("fam3", "there", "1")], "family string, scope string, version string")
    return P.version_info(hits, pins, latest, "here").drop("source", "path")
