"""What decides between ways of working by size is forced, one way and the other: the results stay the same."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import common, decontam, htmltext, ngramjoin, suffix

from .test_operators import WORDS, brute_components, brute_hits, brute_repeats


def some_texts(seed, n=14):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice("abcdefgh é") for _ in range(k))
    shared, tail = say(900), say(260)
    return [say(r.randint(0, 900)) + shared[i * 10 : 900 - i * 20] + say(r.randint(0, 90)) + tail[: 150 + 10 * i] + say(300) for i in range(n)] + ["ab" * 400, tail, None, ""]


@pytest.mark.parametrize("hot,load,chunk", [(4, 1 << 24, 256), (8, 0, 2), (1, 0, 256), (16384, 0, 2)])
def test_repeats_by_every_way(monkeypatch, spark, hot, load, chunk):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "LOAD", load)
    monkeypatch.setattr(common, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(suffix, "MAX_BROADCAST", 0 if load == 0 else 48_000_000)
    texts = some_texts(hot)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_bytes, tuple(map(tuple, x.spans)), bytes(x.kept)) for x in suffix.remove_repeats(df).collect()]
    assert sorted(got) == brute_repeats(rows, 200)


@pytest.mark.parametrize("load", [1 << 24, 0])
def test_repeats_of_rows_without_an_id(monkeypatch, spark, load):
    monkeypatch.setattr(suffix, "LOAD", load)
    r = random.Random(4)
    lone, both = ("".join(r.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(None, lone + "x"), (None, "y" + both), (1, "z" + lone), (2, both + "w"), (5, "short")], "doc_id long, text string")
    got = {x.n_bytes: bytes(x.kept) for x in suffix.remove_repeats(df).filter("doc_id IS NOT NULL").collect()}
    assert got == {301: b"z"} | {301: b"w"} | {5: b"short"} or sorted(bytes(x.kept) for x in suffix.remove_repeats(df).filter("doc_id IS NOT NULL").collect()) == [b"short", b"w", b"z"]
    assert all(x.n_removed == 0 for x in suffix.remove_repeats(df).filter("doc_id IS NULL").collect())


def test_joins_deal_hot_keys(monkeypatch, spark):
    monkeypatch.setattr(common, "CHUNK_ROWS", 3)
    large = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(7)).otherwise(F.col("id") % 90).cast("long").alias("k"), F.col("id").alias("i"))
    small = spark.range(0, 90, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    hot = common.hot_keys(large.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert hot.filter("k = 7").first()["chunks"] > 100
    for how in ("inner", "left", "left_semi"):
        got = common.dealt_join(large, small, ["k"], hot, ["i"], how)
        assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr) == sorted(map(tuple, (want := large.join(small, "k", how)).select(*sorted(want.columns)).collect()), key=repr)


# similar sets
def families(seed, n=220):
    """Groups of near copies of two bases that share most words but are not linked, and texts of a few common passages."""
    r = random.Random(seed)
    say = lambda k: [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(k)]
    base = say(150)
    other = base[:110] + say(40)
    passages = [say(30) for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(base if i % 2 else other)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed" + str(r.randint(0, 5))
        rows.append((i, " ".join(words)))
    rows += [(n + i, " ".join(w for p in r.sample(passages, r.randint(3, 6)) for w in p)) for i in range(60)]
    return rows + [(2 * n + i, " ".join(say(r.randint(1, 12)))) for i in range(40)] + [(3 * n, None), (3 * n + 1, "")]


@pytest.mark.parametrize("block,chunk,shared,ids", [(1024, 256, 500_000, 2_000_000), (3, 2, 500_000, 0), (8, 4, 0, 2_000_000)])
def test_components_by_every_way(monkeypatch, spark, block, chunk, shared, ids):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(common, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ngramjoin, "MAX_SHARED", shared)
    monkeypatch.setattr(ngramjoin, "MAX_BROADCAST_IDS", ids)
    rows = families(block, 220 if block > 3 else 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(df).collect()}
    assert got == brute_components(rows, 4, 85) and len({c for _, c in got.values()}) > 20


@pytest.mark.parametrize("pairs", [0, 8, 10_000])
def test_components_of_loose_groups(monkeypatch, spark, pairs):
    """Members that are near each other, but not all near one leader: by other leaders, or by all pairs."""
    monkeypatch.setattr(ngramjoin, "PAIRS", pairs)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base if i % 3 else [*base[:70], *(f"v{j}" for j in range(50))])
        for _ in range(r.randint(0, 5)):
            at = r.randrange(110)
            words[at : at + 3] = [f"x{r.randint(0, 3)}"] * 3
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.jaccard_components(df).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("boundary", [0, 30, 10_000])
def test_components_with_light_and_heavy_sets(monkeypatch, spark, boundary):
    """All sets heavy, some light, all light: the same links, by single shingles, by both, by pairs of shingles."""
    whole = ngramjoin._boundary
    monkeypatch.setattr(ngramjoin, "_boundary", lambda *a: (boundary, whole(*a)[1]))
    rows = families(7, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(df).collect()}
    assert got == brute_components(rows, 4, 85)


def test_two_large_groups_cost_no_pairs(monkeypatch, spark):
    """Near copies of two bases that share most shingles: rings around pivots part them, so few pairs are compared."""
    compared = []
    whole = ngramjoin._pairs_of_long_lists
    monkeypatch.setattr(ngramjoin, "_pairs_of_long_lists", lambda *a: compared.append(whole(*a).count()) or whole(*a))
    r = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    other = base[:150] + [f"v{i}" for i in range(50)]
    rows = []
    for i in range(20_000):
        words = list(base if i % 2 else other)
        words[r.randrange(200)] = f"x{r.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in ngramjoin.jaccard_components(df).collect()}
    assert all(c == d % 2 for d, c in got.items()) and sum(compared) < 10 * len(rows)


def test_pairs_left_are_compared_from_the_likeliest_on(monkeypatch, spark):
    """All pairs of two groups of near copies and a chain between strangers: few are compared in full, no link is lost."""
    r = random.Random(3)
    rows = []
    for group in range(2):
        for i in range(60):
            words = [f"g{group}w{j}" for j in range(150)]
            words[r.randrange(150)] = f"x{i}"
            rows.append((100 * group + i, " ".join(words)))
    rows += [(300 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))) for i in range(12)] + [(400, "all alone " * 9)]
    docs = spark.createDataFrame(rows, "id long, text string")
    prefixes = common.stored(ngramjoin._prefixes(docs, 4, 85, (np.zeros(0, np.uint64), np.zeros(0, np.int64))), "prefixes")
    ids = sorted(x.id for x in prefixes.select("id").collect())
    everything = [(a, b, abs(a - b) % 7) for a in ids for b in ids if a < b]
    compared, verified = [], ngramjoin._verified
    monkeypatch.setattr(ngramjoin, "_verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    none = spark.createDataFrame([], "id long, component long")
    rest = common.stored(spark.createDataFrame(everything, "a long, b long, apart int"), "rest")
    for most, few in ((8, True), (10_000, False)):
        compared.clear()
        monkeypatch.setattr(ngramjoin, "PAIRS", most)
        found = {x.id: x.component for x in ngramjoin._settled(none, rest, prefixes, docs, 4, 85).collect()}
        assert {i: found.get(i, i) for i in ids} == {i: c for i, (_, c) in brute_components(rows, 4, 85).items() if i in ids}
        assert (sum(compared) < len(everything)) == few


# decontamination
def test_a_short_item_costs_little():
    r = random.Random(1)
    words = [f"w{i}".encode() for i in range(2000)]
    docs = [[b"the" if r.random() < 0.1 else r.choice(words) for _ in range(150)] for _ in range(3000)]
    long = [(str(i), docs[r.randrange(3000)][5:45] if i % 4 == 0 else [b"the" if r.random() < 0.1 else r.choice(words) for _ in range(40)]) for i in range(400)]
    seen = []
    for blocks in ([decontam.Items(long, 10)], [decontam.Items(long, 10), decontam.Items([("x", [b"the"])], 10)]):
        tracemalloc.start()
        began = time.process_time()
        found = decontam.scan(docs, iter(blocks))
        seen.append((time.process_time() - began, tracemalloc.get_traced_memory()[1], found))
        tracemalloc.stop()
    assert seen[1][0] < 2 * seen[0][0] + 1 and seen[1][1] < 2 * seen[0][1]
    assert all(("x" in f[2]) == (b"the" in d) for f, d in zip(seen[1][2], docs, strict=True))
    assert all(a[2] == [x for x in b[2] if x != "x"] and (a[3] == b[3] if a[3] else b[3] is None or b[3][3] == 1) for a, b in zip(seen[0][2], seen[1][2], strict=True))


def test_longest_matches_are_the_longest(spark):
    r = random.Random(6)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([2, 5, 14])))) for i in range(25)]
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("longest", F.lit("clash"))
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), window=6, keep=("n_words", "text", "longest")).collect()
    assert sorted((x.doc_id, x.n_words, sum(h.end - h.start for h in x.hits), tuple(x["items"])) for x in got) == brute_hits(rows, items, 6)
    by_name = {str(i): t.split() for i, t in items}
    for x in got:
        d = x.text.split()
        # Matches of as many words as a window at least, or as the item.
        best = max((n for t in by_name.values() for a in range(len(t)) for b in range(len(d)) for n in [_common(t[a:], d[b:])] if n >= min(6, len(t))), default=0)
        assert (x.longest.n_words if x.longest else 0) == best
        if x.longest:
            assert by_name[x.longest.item][x.longest.item_start :][:best] == d[x.longest.start : x.longest.start + best]


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


# extraction
def page(inner, before="", around="article"):
    return f"<html><body><nav>menu</nav>{before}<{around}><h1>T</h1><p>before</p>{inner}<p>after the thing</p></{around}><footer>f</footer></body></html>"


@pytest.mark.parametrize("inner,want", [
    ("<svg/>", None), ("<p>a<svg/>b</p>", "ab"), ('<iframe src="x"/>', None), ('<object data="x"/>', None), ("<p>a<textarea>b</p>", "ab"), ("<iframe>never closed", "never closed"),
    ("<p>m <math><mi>x</mi><mo>=</mo><mn>1</mn></math> n</p>", "m x=1 n"), ("<math><semantics><mi>x</mi><annotation>tex</annotation></semantics></math>", "x"), ("<noscript>fallback</noscript>", "fallback"), ("<canvas>fallback</canvas>", "fallback"),
    ("<svg><text>gone</text></svg>", None), ("<select><option>gone</select>", None), ("<template><p>gone</template>", None), ("<script>if (a<b) gone</script>", None), ("<p hidden>gone</p>", None),
    ('<header class="entry-header"><h2>Headline</h2></header>', "Headline"), ('<div class="entry-header"><h2>Headline</h2></div>', "Headline"), ('<p class="share-price">Price 5</p>', "Price 5"), ('<p class="ad-free">keep</p>', "keep"),
    ('<div class="share-buttons">gone</div>', None), ('<div class="ad-slot">gone</div>', None), ('<div class="related-posts">gone</div>', None), ('<div id="comments"><p>gone</p></div>', None), ('<div role="search">gone</div>', None),
    ('<p data-id="comments" title="a class of">stay</p>', "stay"), ('<p title="x > y">q</p>', "q"), ('<p class="a>q</p>', "q"), ("<!-- gone -->", None), ("<!-- open <p>x</p>", "x"), ("<!--><p>x</p>", "x"),
])
def test_no_text_is_lost(inner, want):
    assert htmltext.extract(page(inner), []) == "\n".join(filter(None, ["T", "before", want, "after the thing"]))


def test_forms_around_the_page_and_articles_of_comments():
    assert htmltext.extract("<body><form id=f><p>Search <input></p><article><p>inside</p></article></form></body>", []) == "inside"
    assert htmltext.extract('<div><article class="comment"><p>a long comment, a long comment</p></article><article><p>own</p></article></div>', []) == "own"


@pytest.mark.parametrize("hosts", [50_000, 0])
def test_the_host_decides(monkeypatch, spark, hosts):
    """A page whose longest container is a teaser follows the other pages of its host; that of another host does not."""
    monkeypatch.setattr(htmltext, "MAX_BROADCAST_HOSTS", hosts)
    usual = '<body><div class="teaser"><p>short</p></div><div class="story-{i}"><p>The own text of page {i}, which is long enough.</p><p>More</p></div></body>'
    odd = '<body><div class="teaser"><p>A teaser that is far longer than the text of this page, very far longer than that.</p></div><div class="story-9"><p>Own</p></div></body>'
    rows = [(i, f"http://a.x/{i}", usual.format(i=i)) for i in range(12)] + [(20, "http://a.x/odd", odd), (21, "http://b.x/odd", odd)]
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "The own text of page 0, which is long enough.\nMore" and got[20] == "Own" and got[21].startswith("A teaser") and "Own" not in got[21]
    assert dict.fromkeys(got, 1) == {r[0]: 1 for r in rows}


def test_repeated_pages_and_ties(spark):
    html = "<body><div class='a'><p>same</p></div><div class='b'><p>same</p></div></body>"
    rows = [(1, "http://c.x/1", html)] * 2 + [(2, "http://c.x/2", html)]
    got = [(r.page_id, r.text) for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "same\nsame"), (1, "same\nsame"), (2, "same\nsame")]  # the outer container of equal scores


def test_carried_columns_may_clash(spark):
    from sparrowdex.llm import bpe, linededup

    from .test_operators import tokenizers_files

    df = spark.createDataFrame([(1, "a b", 5, 6, "x.y")], "doc_id long, text string, n_tokens long, ids long, __gone_id string").withColumn("a.b", F.lit(1)).withColumn("source", F.lit("s"))
    got = bpe.bpe_encode(df, tokenizers_files.path("byte_bpe_multi_50k.tiktoken"), tokenizers_files.PATTERN, keep=("n_tokens", "text", "ids", "text")).first()
    assert got.text == "a b" and got.n_tokens == len(got.ids) == 2
    cleaned = linededup.line_dedup(df)
    assert cleaned.columns == [*df.columns, "n_lines", "n_removed", "removed"] and cleaned.first()["__gone_id"] == "x.y" and cleaned.first()["a.b"] == 1




def test_jaccard_of_templated_texts(spark):
    """Texts of one template that differ in a word meet in many lists, and in none that a linked pair could meet in first."""
    words = "this page could not be found on our site please".split()
    rows = [(i, " ".join([*words, f"w{i}"])) for i in range(3000)] + [(5000 + i, " ".join([*words, "log", "in", f"w{i}"])) for i in range(500)]
    rows += [(9000, " ".join([*words, "w7"])), (9001, " ".join([*words, "w7", "w8"])), (9002, "x " + " ".join([*words, "w9"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = df.select(F.col("doc_id").alias("id"), "text")
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    prefixes = ngramjoin._prefixes(docs, 4, 85, none)
    boundary, hot = ngramjoin._boundary(prefixes, 85)
    assert hot.count() > 0
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(df).collect()}
    sets = {i: set(ngramjoin.shingles(t).tolist()) for i, t in rows}
    few = [i for i in sets if i < 200 or i >= 5400]
    linked = {(a, b) for a in few for b in few if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    least = {i: i for i in few}
    for _ in range(5):
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: got[i] for i in few} == least


@pytest.mark.parametrize("cells", [1, 40_000])
def test_languages_in_slices(spark, monkeypatch, cells):
    from sparrowdex.llm import langid

    r = random.Random(cells)
    rows = [(i, f"l{i % 60:02}", " ".join(r.choices([f"{'abcdefghij'[i % 10]}{'klmnop'[i % 60 // 10]}{c}" for c in "xyz"], k=30))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    languages, matrix = langid.train(df)
    whole = {x.doc_id: (x.lang_pred, round(x.score, 9)) for x in langid.identify(df, languages, matrix).collect()}
    monkeypatch.setattr(langid, "CELLS", cells)
    assert {x.doc_id: (x.lang_pred, round(x.score, 9)) for x in langid.identify(df, languages, matrix).collect()} == whole
    assert len(languages) == 60 and sum(whole[i][0] == lang for i, lang, _ in rows) > 200
