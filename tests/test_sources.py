"""Sources, converters, upkeep and streams on small inputs."""

import json

from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import manifest as M
from sparrowdex.operators import policy as P
from sparrowdex.operators import vectors as V
from sparrowdex.sources import corpus as C
from sparrowdex.sources import ddl, discover, markup
from sparrowdex.streaming import corpora, logs


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_titles_and_paths(spark):
    title = lambda path, body: one(spark, T.page_title(F.lit(path), F.lit(body)))
    assert title("s/get-started.md", "no heading") == "get started"
    assert title("s/x.md", "---\ntitle: Front\n---\n# Head") == "Front"
    assert title("s/x.md", "# Overview\n## Real") == "Real"
    assert one(spark, C.canonical_path(F.lit("a\\.\\b//c"))) == "a/b/c"
    assert one(spark, C.canonical_path(F.lit("../x"))) is None
    assert one(spark, T.slug(F.lit("/2024/01/my-Great_post!/123456/"))) == "my-great_post"


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "s/sub").mkdir(parents=True)
    (tmp_path / "s/a.md").write_text("# A\ntext")
    (tmp_path / "s/_INDEX.md").write_text("index")
    (tmp_path / "s/sub/b.md").write_text("text")
    rows = {r.path: r.title for r in C.read_markdown(spark, str(tmp_path)).collect()}
    assert rows == {"s/a.md": "A", "s/sub/b.md": "b"}


def test_converters():
    assert markup.html_to_markdown("<body><nav>x</nav><h2>T</h2><p>a <b>b</b> <a href='/c'>c</a></p><ul><li>i</ul></body>") == "## T\n\na **b** [c](/c)\n\n- i"
    rst = "Title\n=====\n\n``code`` and `link <http://x>`_\n\n.. note:: mind\n\nSub\n---\n\n.. code-block:: py\n\n   x = 1\n"
    assert markup.rst_to_markdown(rst) == "# Title\n\n`code` and [link](http://x)\n\n> **Note** mind\n\n## Sub\n\n```py\nx = 1\n```"
    doc = {"metadata": {"title": "T"}, "abstract": [{"type": "text", "text": "A"}], "references": {"r": {"title": "R", "url": "/documentation/r"}}, "primaryContentSections": [{"content": [{"type": "paragraph", "inlineContent": [{"type": "reference", "identifier": "r"}]}]}]}
    assert markup.docc_to_markdown(json.dumps(doc)) == "# T\n\nA\n\n[R](/documentation/r)"
    assert markup.docc_links(json.dumps(doc)) == ["/documentation/r"] and markup.docc_to_markdown("no json") == ""


def test_discovery(spark):
    web = {"m": "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>", "a": "<urlset><url><loc>http://x/1</loc></url><url><loc>http://x/2</loc></url></urlset>"}
    assert sorted(r.url for r in discover.sitemap_urls(spark, "m", web.__getitem__).collect()) == ["http://x/1", "http://x/2"]
    pages = one(spark, discover.llms_pages(F.lit("===/a===\nA text\n===/b===\nB")))
    assert [(p.path, p.body) for p in pages] == [("/a", "A text"), ("/b", "B")]
    assert one(spark, discover.llms_links(F.lit("[a](https://x/a) [b](https://x/b/)"))) == ["https://x/a.md", "https://x/b/index.md"]
    assert discover.batch_questions(spark, '["a", {"q": "b", "source": "s"}]').count() == 2


def test_ddl(spark):
    rows = [
        ("20240102000000_b.sql", "ALTER TABLE t ADD COLUMN c numeric(10,2); alter table t rename column a to z; ALTER TABLE t ENABLE ROW LEVEL SECURITY;"),
        ("20240101000000_a.sql", "-- note\nCREATE TABLE t (a int, b text default 'x,y', primary key (a));\nCREATE TABLE gone (x int);"),
        ("20240103000000_c.sql", "DROP TABLE gone;"),
    ]
    m = spark.createDataFrame(rows, "base string, sql string")
    states = {r.name: [(c.name, c.type) for c in r.columns] for r in ddl.table_states(m).collect()}
    assert states == {"public.t": [("z", "int"), ("b", "text default 'x,y'"), ("c", "numeric(10,2)")]}
    kinds = {(r.kind, r.name): r.n for r in ddl.objects(m).collect()}
    assert kinds["alter table", "public.t"] == 2 and kinds["enable rls", "public.t"] == 1 and kinds["drop table", "public.gone"] == 1


def test_profile_globs(spark):
    assert P.glob_regex("a/**/b*.md") == r"^a/.*b[^/]*\.md$"
    pages = spark.createDataFrame([("s/x/1.md", "s"), ("t/y/2.md", "t"), ("u/z.md", "u")], "path string, source string")
    got = {r.path: (r.in_profile, r.in_profile_sub) for r in P.profile_match(pages, [("s", None), ("t", "y/*.md")]).collect()}
    assert got == {"s/x/1.md": (True, False), "t/y/2.md": (True, True), "u/z.md": (False, False)}


def test_embedding_halves_refused_batches(spark):
    def embedder(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise ValueError("too large")
        return [[float(len(texts[0]))]]

    pages = spark.createDataFrame([("a", "xx"), ("b", "bad"), ("c", "y")], "path string, text string").coalesce(1)
    assert {r.path: r.embedding for r in V.embed(pages, embedder).collect()} == {"a": [2.0], "c": [1.0]}


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"query": "x", "run_context": "eval", "result_count": 0}\nno json\n{"query": "", "run_context": ""}\n{"query": "y", "run_context": "", "result_count": 2}\n')
    assert logs.read_log(spark, str(log)).count() == 2
    q = logs.live_summary(logs.read_log(spark, str(log), True)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.traffic: r.entries for r in spark.table("live").collect()} == {"evaluation": 1, "human": 1}
    src = tmp_path / "changes"
    for body in ("one", "two"):
        spark.createDataFrame([("p", body), (body, body)], "path string, body string").write.mode("append").parquet(str(src))
        changes = spark.readStream.schema("path string, body string").parquet(str(src))
        corpora.upsert_stream(changes, str(tmp_path / "corpus"), str(tmp_path / "cp")).awaitTermination()
    assert {r.path: r.body for r in corpora.current(spark, str(tmp_path / "corpus")).collect()} == {"p": "two", "one": "one", "two": "two"}


def test_upkeep(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    fresh = spark.createDataFrame([("b", 2), ("c", 2)], "path string, v int")
    assert {tuple(r) for r in M.upsert(base, fresh).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert [r.path for r in M.missing(fresh, base).collect()] == ["c"]
