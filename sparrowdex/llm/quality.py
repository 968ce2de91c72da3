"""Quality rules: repetition counts, and the divergence of a document from its language.

DataFrame functions only. A document's histograms of character classes and of common words are compared with
references of its language by the Jensen-Shannon distance (base 2, 0 to 1). The references come from the whole input,
so they grow with it; what is joined to the documents is one short row for each language.

Cases: a null text is an empty one (all counts 0, base_failed). Documents with a null language form a language of their
own. A language without any word gives no verdict (the base rules alone decide), nor does a document with fewer than
``min_words`` words; else a language's reference is that of its documents, few or many. Repeated rows are scored alike; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, words

#: The symbols counted, and the character classes in the order in which they are taken away.
SYMBOLS = r"[#*$%&|<>]"
CLASSES = {"letter or white space": r"[a-zA-Z\x09-\x0D\x20\p{L}\p{M}]+", "symbol": SYMBOLS + "+", "digit": r"\p{Nd}+", "punctuation": r"\p{Punct}+"}
#: Beyond so many languages the references are joined without a broadcast.
MAX_BROADCAST_LANGUAGES = 4096
#: Approximate quantiles are off by 1 in ACCURACY ranks at most; exact medians are looked for within MARGIN around them.
ACCURACY, MARGIN = 10000, 0.002
#: Up to so many common words of all languages stand in the plan as a set.
MAX_LITERALS = 8192


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; w is bound by let().

    Equal windows have equal hashes, so only windows whose hash occurs again are compared as words.
    """

    def paired(s: Column, name: str) -> Column:
        """Of the sorted s, those whose neighbour has the same value in the field name."""

        def same(x: Column, k: Column) -> Column:
            return F.coalesce(x[name] == F.get(s, k - 1)[name], F.lit(False)) | F.coalesce(x[name] == F.get(s, k + 1)[name], F.lit(False))

        return F.filter(s, same)

    def ordered(values: Column, name: str) -> Column:
        return F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias(name), i.alias("i"))))

    def exact(s: Column) -> Column:
        windows = F.transform(paired(s, "h"), lambda x: F.struct(F.concat_ws(" ", F.get(w, x["i"]), F.get(w, x["i"] + 1), F.get(w, x["i"] + 2)).alias("g"), x["i"].alias("i")))
        starts = let(F.sort_array(windows), lambda g: F.sort_array(F.transform(paired(g, "g"), lambda x: x["i"])))
        reach = let(starts, lambda d: F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3)))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered(h, "h"), exact))

    hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, of))


def _tokens(text: Column) -> Column:
    """Lower-case runs of letters; the ends may be empty strings."""
    return F.split(F.lower(text), r"[^\p{L}\p{M}]+")


def _with_classes(df: DataFrame, name: str) -> DataFrame:
    """df with how many characters of the column text are in each class, and last in none."""
    rest, cols = F.col("text"), df
    for i, pattern in enumerate(CLASSES.values()):
        cols = cols.withColumn(f"rest{i}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"rest{i}")
    left = [F.length("text"), *(F.length(f"rest{i}") for i in range(len(CLASSES)))]
    return cols.withColumn(name, F.array(*(a - b for a, b in zip(left, left[1:], strict=False)), left[-1]))


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, lang, text, the counts that the rules use, and row, the whole input row."""
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    split = base.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    first = split.select("id", "row", "lang", "text", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), let(F.col("w"), _repeat_words).alias("n_repeat_words"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return _with_classes(first, "classes").select("id", "row", "lang", "text", "n_words", "word_chars", F.get("classes", F.lit(1)).alias("n_symbols"), "n_dup_lines", "n_repeat_words", "classes")


def _medians(shares: DataFrame) -> DataFrame:
    """lang and medians, the exact lower medians of its columns c0, c1, ... in order.

    Approximate quantiles on both sides of a median bound it; only the values between them are brought together.
    """
    each = shares.select("lang", F.posexplode(F.array(*(f"c{i}" for i in range(len(CLASSES) + 1)))).alias("i", "v"))
    around = F.percentile_approx("v", F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN)), F.lit(ACCURACY))
    ends = stored(each.groupBy("lang", "i").agg(around.alias("ends"), F.floor((F.count("*") + 1) / 2).alias("target")), "median-bounds")
    bounded = each.join(F.broadcast(ends) if ends.count() <= MAX_BROADCAST_LANGUAGES * (len(CLASSES) + 1) else ends, ["lang", "i"]).filter(F.col("v") <= F.get("ends", F.lit(1)))
    # All values below the bounds are one group, whose value is null; it sorts first.
    values = bounded.groupBy("lang", "i", "target", F.when(F.col("v") >= F.get("ends", F.lit(0)), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    inner = values.groupBy("lang", "i", "target").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
    upto = F.aggregate("s", start, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["n"] < F.col("target"), x["v"]).otherwise(a["v"]).alias("v")))
    checked = inner.withColumn("m", upto).select("lang", "i", F.when((F.col("m.n") >= F.col("target")) & F.col("m.v").isNotNull(), F.col("m.v")).otherwise(F.raise_error(F.lit("a median is outside its bounds")).cast("double")).alias("v"))
    return checked.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("medians"))


def references(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common_words: int = 32) -> DataFrame:
    """For each language: its commonest words in order, their shares, and the shares of the character classes.

    Ties of count go to the smaller word. Every document counts; a class's share is the median over the documents with
    text, so that a minority of odd documents does not move it.
    """
    base = df.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = base.select("lang", F.explode(_tokens(F.col("text"))).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= common_words)
    total = each.groupBy("lang").agg(F.sum("n").alias("total"))
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    sized = _with_classes(base.filter("text <> ''"), "classes")
    shares = sized.select("lang", *((F.get("classes", F.lit(i)) / F.length("text")).alias(f"c{i}") for i in range(len(CLASSES) + 1)))
    medians = _medians(stored(shares, "class-shares"))
    return (
        top.join(total, "lang")
        .join(medians, "lang")
        .select("lang", F.transform("top", lambda x: x["word"]).alias("ref_words"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("ref_shares"), F.col("medians").alias("ref_classes"))
    )


def _part(p: Column, q: Column) -> Column:
    """What a bin with shares p and q adds to twice the divergence."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def _word_distance(found: Column, ref_shares: Column) -> Column:
    """found: n, the number of tokens, and r, the sorted ranks of those among the reference's words."""
    n = found["n"].cast("double")
    other = F.greatest(1.0 - F.aggregate(ref_shares, F.lit(0.0), lambda a, y: a + y), F.lit(0.0))

    def over(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("r"), i.alias("i"), F.coalesce(F.get(s, i + 1) != x, F.lit(True)).alias("last"))), lambda x: x["last"])

        def runs(e: Column) -> Column:
            def each(x: Column, k: Column) -> Column:
                p = (x["i"] - F.coalesce(F.get(e, k - 1)["i"], F.lit(-1))) / n
                return let(F.struct(p.alias("p"), F.get(ref_shares, x["r"].cast("int") - 1).alias("q")), lambda b: _part(b["p"], b["q"]) - b["q"])

            # A bin without tokens adds its reference share.
            return F.aggregate(F.transform(e, each), 1.0 - other, lambda a, b: a + b) + _part((n - F.size(s)) / n, other)

        return let(ends, runs)

    return F.when(found["n"] == 0, F.lit(1.0)).otherwise(_distance(let(found["r"], over)))


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common_words: int = 32,
    min_words: int = 50,
    max_class_distance: float = 0.185,
    max_word_distance: float = 0.30,
    short_allowance: float = 0.9,
) -> DataFrame:
    """Per row: id, the counts, both distances (null without a verdict), the verdict kept, and row, the whole input row.

    A document fails where the distance of its character classes is over max_class_distance, or that of its common
    words over max_word_distance + short_allowance / sqrt(n_words), which leaves room for the chance deviation of short
    texts.
    """
    refs = references(df, id_col, text_col, lang_col, common_words)
    scored = counts(df, id_col, text_col, lang_col)
    refs = stored(refs, "language-references")
    joined = scored.join(F.broadcast(refs) if refs.count() <= MAX_BROADCAST_LANGUAGES else refs, "lang", "left")
    # A word that is common in no language has rank 0 in any; sorting ranks needs the others only.
    vocabulary = [r[0] for r in refs.select(F.explode("ref_words")).distinct().limit(MAX_LITERALS + 1).collect()]
    common = (lambda x: x.isin(vocabulary)) if vocabulary and len(vocabulary) <= MAX_LITERALS else (lambda x: x != "")
    tokens = F.filter(_tokens(F.col("text")), lambda x: x != "")
    ranks = let(tokens, lambda t: F.struct(F.size(t).alias("n"), F.sort_array(F.filter(F.transform(F.filter(t, common), lambda x: F.array_position(F.col("ref_words"), x)), lambda r: r > 0)).alias("r")))
    judged = F.col("ref_words").isNotNull() & (F.col("n_words") >= min_words)
    total = F.greatest(F.length("text"), F.lit(1))
    class_distance = _distance(F.aggregate(F.zip_with("classes", "ref_classes", lambda c, q: let(c / total, lambda p: _part(p, q))), F.lit(0.0), lambda a, x: a + x))
    measured = joined.withColumn("ranks", F.when(judged, ranks)).select("*", F.when(judged, class_distance).alias("class_distance"), F.when(judged, _word_distance(F.col("ranks"), F.col("ref_shares"))).alias("word_distance"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    room = F.lit(short_allowance) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    diverges = (F.col("class_distance") > max_class_distance) | (F.col("word_distance") > max_word_distance + room)
    long = {c: F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return measured.select(F.col("id").alias(id_col), *long.values(), base_failed.alias("base_failed"), (~base_failed & ~F.coalesce(diverges, F.lit(False))).alias("kept"), "class_distance", "word_distance", "row")


def kept_rows(df: DataFrame, **rules) -> DataFrame:
    """The rows of df that the rules keep, as they are.

    A generator, not a filter: the optimizer would move a filter down and compute the whole verdict again there.
    """
    return quality_rules(df, **rules).select(F.inline(F.when(F.col("kept"), F.array("row"))))
