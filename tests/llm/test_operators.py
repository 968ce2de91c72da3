"""The operators against brute force, on the small tables and on odd rows: nulls, empty and long texts, repeated rows,
empty tables, extra columns with clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import bpe, decontam, htmltext, langid, licenses, linededup, ngramjoin, quality, queries, shards, suffix

tokenizers_files = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, h string, key string, spans string, kept string, lines string, h1 int, removed int"
WORDS = "the of and to alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def odd_rows():
    r = random.Random(5)
    say = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(k))
    base = say(400)
    near = base.split()
    near[7] = "changed"
    long = " ".join(say(12) + "\n" for _ in range(6000))
    texts = [None, "", " \t\n", "one", "one two", base, base, " ".join(near), base + " more", say(60), "é ü\nß É.\n" * 40, "word " * 200, long, long[1000:200_000], "Released under the MIT License.", "x" * 70_000, "ab" * 300, "common line here\n" + say(30)]
    rows = [(i, t, None if i % 5 == 4 else ["en", "de", "fr"][i % 3], None if i == 9 else f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, "common line here\n" + say(40 + i), "en", f"site{i}", 1) for i in range(12)]
    rows.append(rows[5])
    return [(*x, 1, 2, "h", "k", "s", "t", "l", 3, 4) for x in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1
def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for v in by.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard(docs, odd, k, percent):
    for df in (docs, odd):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(df, k=k, percent=percent).collect()}
        assert got == brute_components(texts_of(df), k, percent)


def test_jaccard_of_many_small_sets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abc") if r.random() < 0.02 else "xyzuvw"[j % 6] for j in range(r.randint(1, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.jaccard_components(df).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_empty_and_null_ids(spark, empty):
    assert ngramjoin.jaccard_components(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.n_shingles) for x in ngramjoin.jaccard_components(df).collect()) == [(0, 2), (2, 2), (3, 2)]


def test_long_words_and_chunks():
    text = "a " * 5 + "b" * (ngramjoin.CHUNK + 5) + " " + "c d " * 10
    assert len(ngramjoin.shingles(text)) == len({tuple(text.split()[i : i + 4]) for i in range(len(text.split()) - 3)})


# 2
def test_language_id(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    languages, matrix = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, languages, matrix).join(docs, "doc_id").filter(langid.held_out(F.col("doc_id")) & (F.length("text") > 100)).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, languages, matrix).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and len(got) == odd.select("doc_id").distinct().count()
    assert langid.identify(empty, languages, matrix).count() == 0
    none, m = langid.train(empty)
    assert none == [] and {r.lang_pred for r in langid.identify(odd, none, m).collect()} == {"und"}


def plain_grams(text):
    """The hashed n-grams of a text, one by one, in Python's integers."""
    m, out = 1 << 32, []
    kept = [32]
    for ch in text.lower():
        if ch.isalpha():
            kept.append(ord(ch))
        elif kept[-1] != 32:
            kept.append(32)
    for i in range(1, len(kept)):
        one = kept[i] * 2654435761 % m
        two = (kept[i - 1] * 2246822519 + one) % m ^ 0x9E3779B9
        grams = [one, two]
        if i >= 2:
            before = (kept[i - 2] * 2246822519 + kept[i - 1] * 2654435761) % m ^ 0x9E3779B9
            grams.append((before * 3266489917 + one) % m)
        out += [(g ^ g >> 15) * 2246822519 % m >> 17 for g in grams]
    return out


@pytest.mark.parametrize("batch,slice_", [(1 << 18, 1 << 20), (500, 1 << 20), (1, 1 << 20), (1 << 18, 50)])
def test_language_id_equals_plain_naive_bayes(monkeypatch, spark, docs, batch, slice_):
    monkeypatch.setattr(langid, "BATCH", batch)
    monkeypatch.setattr(langid, "SLICE", slice_)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 -- 4", "fr"), (1003, "a", None), (1004, "  Été\n", "fr"), (1005, "x", "zz"), (1005, "x", "zz"), (1006, "日本語 text", "fr"), (1007, "a" * 400, "de")]
    rows = [(r.doc_id, (r.text or "")[:1500], r.lang) for r in docs.limit(60).collect()] + odd
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, matrix = langid.train(df.filter(~langid.held_out(F.col("doc_id"))))
    learned = [(t, lang) for d, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5 and any(c.isalpha() for c in t)]
    assert languages == sorted({lang for _, lang in learned})
    counts = {lang: Counter(g for t, own in learned if own == lang for g in plain_grams(t)) for lang in languages}
    for d, pred, score in langid.identify(df, languages, matrix).collect():
        text = next(t for i, t, _ in rows if i == d)
        if not text or not any(c.isalpha() for c in text):
            assert (pred, score) == ("und", 0.0)
            continue
        sums = {lang: math.log(sum(own == lang for _, own in learned) / len(learned)) + sum(math.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * 32768)) for g in plain_grams(text)) for lang in languages}
        best = max(sums.values())
        assert sums[pred] > best - 1e-6 and abs(score - 1 / sum(math.exp(x - best) for x in sums.values())) < 1e-6


def test_accuracy_on_all_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    languages, matrix = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, languages, matrix).join(docs.filter("lang IS NOT NULL"), "doc_id").filter(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.9


def test_ngrams_do_not_depend_on_slices(monkeypatch):
    text = "Der Fluß, 12 Bäume -- x" * 50
    whole = langid.ngram_counts(text, 1 << 12)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert (langid.ngram_counts(text, 1 << 12) == whole).all()


# 3
def test_bpe(odd, empty):
    import tiktoken

    path = tokenizers_files.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.bpe_encode(odd, path, tokenizers_files.PATTERN, digests=True, keep=("text",)).collect():
        want = enc.encode_ordinary(r.text or "")
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert bpe.decode(want, path, tokenizers_files.PATTERN).decode() == (r.text or "")
    assert bpe.bpe_encode(empty, path, tokenizers_files.PATTERN).count() == 0
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab'’ s\n\t\r\x1c\xa0  1²,.é") for _ in range(300))
        assert bpe.encode(t, enc, tokenizers_files.PATTERN, 16) == enc.encode_ordinary(t)


# 4
def test_pfor_round_trip():
    r = np.random.default_rng(0)
    for _ in range(100):
        ids = r.integers(0, r.choice([0, 1, 255, 60000, 2**32 - 1]), int(r.integers(1, 1500)), dtype=np.uint64, endpoint=True).astype(np.uint32)
        ids[r.integers(0, len(ids))] = 2**32 - 1
        blocks = shards.pack(ids, float(r.choice([50, 90, 100])))
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert (shards.unpack(b"".join(blocks), starts) == ids).all()


def test_token_shards(odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    manifest = shards.write_shards(odd, path, out_dir=str(tmp_path), partitions=3)
    got = sorted(tuple(r) for r in shards.read_shards(manifest).collect())
    want, start = [], 0
    for d, x in sorted(texts_of(odd), key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert shards.read_shards(shards.write_shards(empty, path)).count() == 0
    r = random.Random(2)
    texts = ["".join(r.choice("ab'’sS 3²½é×,.\n\t\r _-tlß жあ\xa0") for _ in range(r.randint(0, 14))) for _ in range(2000)] + ["a<|endoftext|>b"]
    texts += ["".join(r.choice("ab'’sS 3²½é×,.\n\t\r _-ßªµ–€ɏ") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    assert all(a.tolist() == t.encode(b, add_special_tokens=False).ids for a, b in zip(shards.encode_batch(texts, path), texts, strict=True))


@pytest.mark.parametrize("window,remembered", [(16, 1_600_000), (1 << 20, 20), (16, 20)])
def test_pieces_do_not_depend_on_windows_and_memory(monkeypatch, window, remembered):
    monkeypatch.setattr(shards, "WINDOW", window)
    monkeypatch.setattr(shards, "REMEMBERED", remembered)
    encoder = shards.Encoder(tokenizers_files.path("byte_bpe_50k.json"))
    r = random.Random(window + remembered)
    texts = [None, "", " " * 100, "a" * 90 + " b", "x" + "é" * 50] + ["".join(r.choice("ab'sS 3é×,.\n\t ß–ж") for _ in range(r.randint(0, 60))) for _ in range(800)]
    for at in range(0, len(texts), 100):
        assert all(a.tolist() == encoder.whole.encode(b or "", add_special_tokens=False).ids for a, b in zip(encoder.encode(texts[at : at + 100]), texts[at : at + 100], strict=True))


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    paths = [tokenizers_files.path("word_bpe_49k.json")]
    with open(tokenizers_files.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        kind = json.load(f)
    for i, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": kind["pre_tokenizer"] | {"add_prefix_space": True}})):
        paths.append(str(tmp_path / f"{i}.json"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            json.dump(kind | change, f)
    for path in paths:
        whole, texts = Tokenizer.from_file(path), ["The Quick brown fox's", " two  blanks\n", "é ü", ""]
        assert [x.tolist() for x in shards.encode_batch(texts, path)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


# 5
def brute_lines(rows, min_sites):
    strip = " \t\n\x0b\x0c\r"
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if k := line.strip(strip):
                sites[k].add(s or "")
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = [i for i, x in enumerate(lines) if (k := x.strip(strip)) and len(sites[k]) >= min_sites and first[k] != (d, i)]
        out.append((d, len(lines), tuple(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 10])
def test_line_dedup(docs, odd, min_sites):
    for df in (docs, odd):
        got = [(r.doc_id, r.n_lines, tuple(r.removed), r.text) for r in linededup.line_dedup(df, min_sites=min_sites).collect()]
        assert sorted(got, key=repr) == brute_lines([(r.doc_id, r.text, r.source) for r in df.collect()], min_sites)


def test_line_dedup_empty(empty):
    assert linededup.line_dedup(empty).count() == 0


# 6
def test_licenses(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/src/a.py", "code"), (3, "p/src/deep/b.py", None), (4, "p/src/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        (5, "q/c.py", ""), (6, "p/src/d.py", "import x\nThis work is licensed under the GNU General Public License, version 3.\n" + "code " * 50), (7, None, "All rights reserved."), (8, "q/e.py", "license of drivers"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("depth", F.lit(9))
    got = {r.id: (r.license, r.origin, r.depth) for r in licenses.license_scan(df).collect()}
    assert got[1] == ("MIT", "own", None) and got[4] == ("Apache-2.0", "own", None) and got[6] == ("GPL-3.0", "own", None)
    assert got[2] == ("Apache-2.0", "inherited", 0) and got[3] == ("Apache-2.0", "inherited", 1) and got[7][0] == "Proprietary"
    assert got[5] == ("Proprietary", "inherited", 1) and got[8][1] == "inherited"
    assert licenses.license_scan(df.limit(0)).count() == 0


# 7
def brute_hits(rows, items, window):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall((t or "").encode().lower().decode())
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[k : k + window])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("block_words", [2_000_000, 50])
def test_decontamination(spark, docs, odd, sf_dir, block_words):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    extra = spark.createDataFrame([(500, "one two"), (501, "alpha"), (502, None), (503, ""), (None, "The of AND"), (504, " ".join(WORDS * 2)), (504, "beta gamma")], "item_id long, text string")
    for df, b in ((docs, bench), (odd, bench.unionByName(extra)), (docs, extra)):
        got = [(r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), tuple(r["items"])) for r in decontam.decontaminate(df, b, block_words=block_words).collect()]
        assert sorted(got) == brute_hits(texts_of(df), [tuple(r) for r in b.select("item_id", "text").collect()], 10)


def test_decontamination_longest_and_empty(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x y c d e f g h i j k l m n z"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r.longest for r in decontam.decontaminate(df, items).collect()}
    assert tuple(got[1]) == ("1", 2, 2, 12) and got[2] is None
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(df, items.limit(0)).filter(F.size("hits") > 0).count() == 0


# 8
def test_quality_counts(docs, odd):
    for df in (docs, odd):
        got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(df).collect())
        want = []
        for d, t in texts_of(df):
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            many, cover = Counter(tri), set()
            for i, x in enumerate(tri):
                if many[x] > 1:
                    cover |= {i, i + 1, i + 2}
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
        assert got == sorted(want)


def test_quality_verdicts(spark, sf_dir, empty):
    root = sf_dir.replace("sf0.001", "sf0.01")
    out = quality.quality_rules(spark.read.parquet(f"{root}/documents.parquet")).filter("NOT base_failed").join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r.n for r in out.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]
    assert quality.quality_rules(empty).count() == 0


def test_distances_by_hand(spark):
    text = "a b " * 2000 + "c d e " * 1000
    df = spark.createDataFrame([(1, text, "en"), (2, "a b c d e " * 20, "en"), (3, "### *** " * 40, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(df, common_words=2).collect()}
    p, q = [20 / 100, 20 / 100, 60 / 100], [2020 / 7100, 2020 / 7100, 3060 / 7100]
    js = sum(0.5 * a * math.log2(2 * a / (a + b)) + 0.5 * b * math.log2(2 * b / (a + b)) for a, b in zip(p, q, strict=True))
    assert abs(got[2].word_distance - math.sqrt(js)) < 1e-9 and not got[3].kept and got[3].class_distance > 0.185


# 9
PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><ul class="menu"><li>One<li>Two</ul><div class="wrapper"><div class="main-content with-sidebar">
<article class="post post-{i}"><header><h1>Title &amp; more</h1></header><div class="entry-content"><p>First para {i} with <b>bold</b>text<br>next
<p>Second &#233; para <span class="ad">BUY</span> end<ul><li>Item a<li>Item b</ul><div class="ad-slot">advert</div></div><footer>posted by</footer></article>
<section id="comments"><div class="comment"><p>A comment that is much longer than the article itself, really very long indeed, on and on and on and on and on.</p></div></section></div>
<aside>Side</aside></div><form><input name=q><button>Go</button></form><footer>foot</footer><script>if(a<b){{}}</script></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", PAGE.format(i=i)) for i in range(6)] + [(7, None, None), (8, "::", ""), (9, "http://h0.x/", "<p>short<p>b &lt;x&gt;</p> tail"), (10, "http://h0.x/", "a < b and <b c='x>y'>z</b> <un"), (0, "http://h0.x/0", PAGE.format(i=0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("paths", F.lit(1))
    got = {r.page_id: r.text for r in htmltext.extract_pages(df).collect()}
    for i in range(6):
        assert got[i] == f"Title & more\nFirst para {i} with boldtext next\nSecond é para end\nItem a\nItem b"
    assert got[7] == got[8] == "" and got[9] == "short\nb <x>\ntail" and got[10] == "a < b and z <un"
    assert htmltext.extract_pages(df.limit(0)).count() == 0


def test_html_pages(spark, sf_dir):
    import html

    for r in htmltext.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, blocks))


# 10
def brute_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        change = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        cover = np.cumsum(change)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(int), [0]))))
        out.append((d, len(b), tuple(map(tuple, edges.reshape(-1, 2).tolist())), bytes(np.frombuffer(b, np.uint8)[~cover])))
    return sorted(out)


@pytest.mark.parametrize("hot", [16384, 1])
def test_repeats(monkeypatch, docs, odd, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SORTED", 500)
    for df in (docs, odd.filter("doc_id NOT IN (12, 13)")):
        got = [(r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in suffix.remove_repeats(df).collect()]
        assert sorted(got) == brute_repeats(texts_of(df), 200)


def test_repeats_across_chunks(monkeypatch, spark, empty):
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    r = random.Random(9)
    say = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = say(900)
    rows = [(i, say(r.randint(0, 2500)) + shared[i * 10 : 900 - i * 20] + say(700)) for i in range(12)] + [(50, "ab" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_bytes, tuple(map(tuple, x.spans)), bytes(x.kept)) for x in suffix.remove_repeats(df).collect()]
    assert sorted(got) == brute_repeats(rows, 200)
    assert suffix.remove_repeats(empty).count() == 0


def test_maximal_repeats_are_maximal():
    a, b = b"x" + b"abcdefghij" * 3, b"y" + b"abcdefghij" * 3
    found = suffix.maximal_repeats([a, b], np.array([12, 12]), np.array([11, 11]), np.array([0, 0]), 20)
    assert {(d, tuple(sorted(zip(r.tolist(), p.tolist(), strict=True)))) for d, r, p in found} == {(30, ((0, 1), (1, 1)))}


# registered queries
def test_queries_equal_their_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf_dir)
        cols = sorted(got.columns)
        rel = c.sql(sql)
        assert sorted(rel.columns) == cols
        want = [tuple(r[rel.columns.index(x)] for x in cols) for r in rel.fetchall()]
        assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_all_ten_are_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 11))
