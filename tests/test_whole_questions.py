"""Registered queries without SQL: whole questions, and plain versions of their results."""

from sparrowdex import queries


class Asked(Exception):
    pass


def test_search_full(spark, sf_dir, monkeypatch):
    def search(corpus, questions, index=None):
        raise Asked(questions)

    monkeypatch.setattr(queries.S, "search", search)
    monkeypatch.setattr(queries, "index_of", lambda *_: None)
    try:
        queries.search_full(spark, sf_dir)
    except Asked as asked:
        questions = asked.args[0]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    assert questions == [(r.item_id, " ".join(r.text.split()), None) for r in sorted(items, key=lambda r: r.item_id)]


def test_document_windows(spark, sf_dir):
    """The registered windows against a plain version: whole lines around a line, a quarter of the size before it."""
    import hashlib

    got = {(r.path, r.line): (r.start, r.n_bytes, r.sha256) for r in queries.document_windows(spark, sf_dir).collect()}
    bodies = {r.path: r.body for r in queries.corpus(spark, sf_dir).collect()}
    assert {p for p, _ in got} == set(bodies)
    for (path, line), (start, n, digest) in got.items():
        rows = [x.encode() for x in bodies[path].split("\n")]
        first = line
        while first > 1 and sum(len(x) + 1 for x in rows[first - 2 : line - 1]) <= 2000:
            first -= 1
        last = first
        while last < len(rows) and len(b"\n".join(rows[first - 1 : last + 1])) <= 8000:
            last += 1
        text = b"\n".join(rows[first - 1 : last])
        if len(text) > 8000:
            text = text[:8000].decode(errors="ignore").encode()
        assert (start, n, digest) == (first, len(text), hashlib.sha256(text).hexdigest())


def test_embedding_inputs(spark, sf_dir):
    import hashlib

    got = {r.path: (r.n_bytes, r.sha256) for r in queries.embedding_inputs(spark, sf_dir).collect()}
    for r in queries.corpus(spark, sf_dir).collect():
        text = ((r.title + "\n\n" if r.title else "") + r.body).encode()[:16_000].decode(errors="ignore").encode()
        assert got[r.path] == (len(text), hashlib.sha256(text).hexdigest())
