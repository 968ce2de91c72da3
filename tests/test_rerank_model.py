"""The re-ranking against a plain version that goes through the candidates one by one."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import rank as R
from sparrowdex.plans import query as Q

WORDS = "token tokens auth policy policies key secret deploy row level security cache tokenize log use".split()
CONFIG = Q.Config(source_keywords={"acme": ("acme",), "blue": ("blue",)}, boosts=(R.Boost("acme", "guides/", 40), R.Boost("blue", "docs/", 50, True, 150)))


def same_stem(a, b):
    return a == b or any(x in (y + "s", y + "es") or y.endswith("y") and x == y[:-1] + "ies" for x, y in ((a, b), (b, a)))


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def concept_in(words, concept):
    text = " " + " ".join(words) + " "
    part = lambda w, t: len(w) >= 3 and len(t) >= 3 and (t in w or w in t)
    return any((" " in t and f" {t} " in text) or any(same_stem(w, t) or part(w, t) for w in words) for t in concept)


def model(cands, plan, strong, titles, limit):
    """cands: (path, source, score, from_title, from_path, from_relaxed, relaxed_place)."""
    out = []
    keywords = {k for s in plan.intended for k, names in CONFIG.source_keywords.items() if s in names}
    for path, source, score, title, inpath, relaxed, place in cands:
        low, inner = titles[path].strip().lower(), path.split("/", 1)[1].lower()
        base = inner.rsplit("/", 1)[-1].removesuffix(".md").removesuffix(".mdx")
        own = source in plan.intended
        tokens = [t for t in plan.scoring if not (own and t in keywords)]
        if title or inpath:
            score = max(score, 200)
        in_title, in_base = sum(t in low for t in tokens), sum(t in base for t in tokens)
        score += 5 * in_title + 30 * own
        for b in CONFIG.boosts:
            if source == b.source and inner.startswith(b.prefix) and (relaxed or not b.relaxed):
                topic = inner.split("/")[1] if "/" in inner else ""
                score += b.points + (b.topic_points if any(concept_in(words_of(topic), c) for c in plan.concepts) else 0)
        score += 5 * sum(t in inner for t in tokens)
        score += 10 * sum(same_stem(base, t) for t in tokens if not CONFIG.others(t, CONFIG.synonyms))
        named = low != "" and low == base.replace("-", " ").replace("_", " ") and in_title >= 1 and in_base >= 1
        score += named or in_title >= 2 and in_base >= 2
        surface = words_of(base) + words_of(low) + words_of(inner)
        n_surface, n_base = sum(concept_in(surface, c) for c in plan.concepts), sum(concept_in(words_of(base), c) for c in plan.concepts)
        if relaxed:
            if n_surface >= 2:
                score = max(score, 180)
            score += 20 * n_surface
            if n_base:
                score += 100 + 20 * (n_base - 1) + 100 * n_base // max(1, len(words_of(base)))
        score += max(-16, -2 * inner.count("/"))
        out.append({"path": path, "source": source, "score": int(score), "tie": int(named), "place": place, "low": low})
    best = max([0, *(c["score"] for c in out)])
    for c in out:
        if best > 0 and c["place"]:
            c["score"] += best // c["place"]
    best = max([0, *(c["score"] for c in out)])
    for c in out:
        if c["low"] == " ".join(plan.scoring):
            c["score"] += best + 100
    key = lambda c: (-c["score"], -c["tie"], c["path"])
    mine, others = [c for c in out if c["source"] == strong], [c for c in out if c["source"] != strong]
    if mine and others and min(mine, key=key)["score"] <= max(c["score"] for c in others):
        min(mine, key=key)["score"] = max(c["score"] for c in others) + 1
    return [(c["path"], c["score"], c["tie"]) for c in sorted(out, key=key)[:limit]]


@pytest.mark.parametrize("seed", range(4))
def test_rerank_equals_the_model(spark, seed):
    r = random.Random(seed)
    name = lambda k: r.choice("-_").join(r.choice(WORDS) for _ in range(k))
    titles = {}
    for i in range(60):
        source = r.choice(["acme", "blue", "red"])
        path = "/".join([source, *(r.choice(["guides", "docs", "Api", *WORDS]) for _ in range(r.randint(0, 4))), name(r.randint(1, 3)) + r.choice([".md", f"-{i}.md", ".mdx"])])
        base = path.rsplit("/", 1)[-1].split(".")[0]
        titles[path] = r.choice([base.replace("-", " ").replace("_", " ").title(), " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))), "", base])
    questions = ["how to use acme tokens", "row-level security policy key", "blue sdk deploy secret cache log", "auth", "token", "tokens cache", "acme api auth policy rotate log"]
    plans = [Q.plan(i, q, None, CONFIG) for i, q in enumerate(questions)]
    words = lambda p: sorted({k for s in p.intended for k, names in CONFIG.source_keywords.items() if s in names})
    known = spark.createDataFrame([(p.qid, p.scoring, p.synonymed, p.concepts, p.intended, words(p), p.strong) for p in plans], "qid long, scoring array<string>, synonymed array<string>, concepts array<array<string>>, intended array<string>, source_words array<string>, strong string")
    rows, want = [], []
    for p in plans:
        own = [(x, x.split("/")[0], r.randint(0, 260), r.random() < 0.2, r.random() < 0.3, (rel := r.random() < 0.5), r.randint(1, 5) if rel and r.random() < 0.5 else None) for x in r.sample(sorted(titles), 25)]
        rows += [(p.qid, *c) for c in own]
        want += [(p.qid, i + 1, *x) for i, x in enumerate(model(own, p, p.strong, titles, 10))]
    cands = spark.createDataFrame(rows, "qid long, path string, source string, score int, from_title boolean, from_path boolean, from_relaxed boolean, relaxed_place int")
    pages = spark.createDataFrame(list(titles.items()), "path string, title string")
    got = R.rerank(cands, known, pages, 10, CONFIG.boosts).select("qid", "place", "path", "score", "tie").collect()
    assert sorted(tuple(x) for x in got) == want


def test_rules_that_were_wrong(spark):
    """A word of a longer file name earns nothing as a name; a part of it counts for the alignment with the title."""
    plan = Q.plan(1, "security")
    assert plan.scoring == ["security"]
    known = spark.createDataFrame([(1, plan.scoring, [], plan.concepts, [], [], None)], "qid long, scoring array<string>, synonymed array<string>, concepts array<array<string>>, intended array<string>, source_words array<string>, strong string")
    pages = [("s/row-level-security.md", "x"), ("s/security.md", "x"), ("s/other.md", "x")]
    cands = spark.createDataFrame([(1, p, "s", 0, False, False, False, None) for p, _ in pages], "qid long, path string, source string, score int, from_title boolean, from_path boolean, from_relaxed boolean, relaxed_place int")
    got = {x.path: x.score for x in R.rerank(cands, known, spark.createDataFrame(pages, "path string, title string").withColumn("title", F.col("title"))).collect()}
    assert got == {"s/row-level-security.md": 5, "s/security.md": 15, "s/other.md": 0}
