"""The quality rules against a plain version, with every way of joining the references."""

import math
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from sparrowdex.llm import quality

from .test_operators import odd_rows

CLASSES = [r"[a-zA-Z\x09-\x0D\x20\p{L}\p{M}]", r"[#*$%&|<>]", r"\p{Nd}", r"[!-/:-@\[-`{-~]"]


def part(p, q):
    return (p * math.log2(2 * p / (p + q)) if p > 0 else 0.0) + (q * math.log2(2 * q / (p + q)) if q > 0 else 0.0)


def distance(pairs):
    return math.sqrt(max(sum(part(p, q) for p, q in pairs) / 2, 0.0))


def classes(text):
    out = []
    for c in CLASSES:
        rest = regex.sub(c, "", text)
        out.append(len(text) - len(rest))
        text = rest
    return [*out, len(text)]


def brute_kept(rows):
    """doc_id -> kept, of (doc_id, text, lang)."""
    read = [(d, t or "", lang or "", [w for w in regex.split(r"[^\p{L}\p{M}]+", (t or "").lower()) if w]) for d, t, lang in rows]
    tokens, shares = defaultdict(Counter), defaultdict(list)
    for _, text, lang, words in read:
        tokens[lang].update(words)
        if text:
            shares[lang].append([c / len(text) for c in classes(text)])
    references = {}
    for lang, counts in tokens.items():
        total = sum(counts.values())
        if total:
            top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:32]
            references[lang] = [(w, n / total) for w, n in top], [sorted(x)[(len(x) + 1) // 2 - 1] for x in zip(*shares[lang], strict=True)]
    out = {}
    for d, text, lang, words in read:
        w = regex.findall(r"[^\x20\x09-\x0D]+", text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many, cover = Counter(tri), set()
        for i, x in enumerate(tri):
            if many[x] > 1:
                cover |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        if not failed and lang in references:
            common, medians = references[lang]
            counts = Counter(words)
            n = len(words)
            bins = [(counts[x] / n, q) for x, q in common] + [((n - sum(counts[x] for x, _ in common)) / n, max(1 - sum(q for _, q in common), 0.0))] if n else []
            failed = distance([(c / len(text), q) for c, q in zip(classes(text), medians, strict=True)]) > 0.185 or (distance(bins) if n else 1.0) > 0.30 + 0.9 / math.sqrt(len(w))
        out[d] = not failed
    return out


@pytest.mark.parametrize("languages,literals", [(4096, 8192), (0, 0)])
def test_verdicts(monkeypatch, spark, sf_dir, languages, literals):
    monkeypatch.setattr(quality, "MAX_BROADCAST_LANGUAGES", languages)
    monkeypatch.setattr(quality, "MAX_LITERALS", literals)
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + r[0], r[1], r[2]) for r in odd_rows()], docs.schema)
    both = docs.unionByName(odd)
    want = brute_kept([tuple(r) for r in both.collect()])
    for parts in (3, 7):
        got = {r.doc_id: r.kept for r in quality.quality_rules(both.repartition(parts, F.rand(parts))).select("doc_id", "kept").collect()}
        assert got == want
    assert 50 < sum(want.values()) < len(want) - 50
