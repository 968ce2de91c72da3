"""The pipeline and each of its stages against brute-force versions."""

import re

import corpus_pipeline
from sparrowdex.llm import bpe

from .test_operators import brute_components, brute_hits, brute_lines, odd_rows, tokenizers_files
from .test_quality_brute import brute_kept


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def after_quality(rows):
    kept = brute_kept([r[:3] for r in rows])
    return [r for r in rows if kept[r[0]]]


def after_lines(rows):
    cleaned = {d: (gone, t) for d, _, gone, t in brute_lines([(r[0], r[1], r[3]) for r in rows], 10)}
    out = []
    for d, text, lang, source, n in rows:
        gone, left = cleaned[d]
        if not gone or re.sub(r"[ \t-\r]", "", left):
            out.append((d, left, lang, source, len(left) if gone else n))
    return out


def after_duplicates(rows):
    comp = brute_components([r[:2] for r in rows], 5, 80)
    return list({r[0]: r for r in rows if comp[r[0]][1] == r[0]}.values())


def after_decontamination(rows, items):
    dirty = {d for d, _, n, _ in brute_hits([r[:2] for r in rows], items, 10) if n}
    return [r for r in rows if r[0] not in dirty]


def test_stages_and_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([r[:5] for r in odd_rows()], docs.schema).filter("doc_id < 12 OR doc_id > 13")
    both = docs.unionByName(odd.withColumn("doc_id", odd.doc_id + 10_000))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [tuple(r) for r in bench.collect()]
    rows = rows_of(both)
    for stage, want in ((corpus_pipeline.quality_rules, after_quality), (corpus_pipeline.line_dedup, after_lines), (corpus_pipeline.near_duplicates, after_duplicates), (corpus_pipeline.decontamination, lambda r: after_decontamination(r, items))):
        out = stage(spark, spark.createDataFrame(rows, docs.schema), str(tmp_path))
        assert out.columns == docs.columns
        got, rows = rows_of(out), want(rows)
        assert sorted(got, key=repr) == sorted(rows, key=repr), stage.__name__
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final.keys() == {r[0] for r in rows} and len(rows) < both.count()
    enc = bpe.encoding(tokenizers_files.path("byte_bpe_multi_50k.tiktoken"), tokenizers_files.PATTERN)
    assert all(bytes(enc.decode_bytes(list(final[r[0]].ids))).decode() == r[1] for r in rows)


def test_no_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_rows_without_an_id_and_other_columns(spark, sf_dir):
    """A near-duplicate stage leaves rows without an id alone; the stages return what they are given."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(None, text, "en", "a", 1), (None, text, "en", "b", 1), (1, text, "en", "c", 1), (2, text + " more", "en", "d", 1)], schema)
    got = corpus_pipeline.near_duplicates(spark, df, sf_dir).select("doc_id").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1]
