"""The class shares of a language's reference are exact medians, beyond the accuracy of approximate ones too."""

from collections import defaultdict

from pyspark.sql import functions as F

from sparrowdex.llm import quality


def test_exact_medians(spark):
    n = 40_001
    size = lambda k: (F.col("id") * 7919 * k) % (97 + 114 * k) + 1
    text = F.concat(F.repeat(F.lit("a"), size(1).cast("int")), F.repeat(F.lit("1"), size(2).cast("int")), F.repeat(F.lit("#"), size(3).cast("int")))
    df = spark.range(0, n, 1, 7).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("lang"))
    got = {r.lang: r.ref_classes for r in quality.references(df).collect()}
    shares = defaultdict(list)
    for i in range(n):
        a, b, c = ((i * 7919 * k) % (97 + 114 * k) + 1 for k in (1, 2, 3))
        shares["de" if i % 50 == 0 else "en"].append([x / (a + b + c) for x in (a, c, b, 0, 0)])
    want = {lang: [sorted(x)[(len(x) - 1) // 2] for x in zip(*rows, strict=True)] for lang, rows in shares.items()}
    assert got == want
