"""Retrieval evaluation: case metrics, summaries, budgets, drift, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISS = 100


def order_statistics(rows: DataFrame, column: str, ps: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, and for each name the element at the truncated index p (n - 1) of the sorted values; nulls don't count.

    Values are counted first, so a group is as large as it has different values.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    placed = counts.withColumns({"__upto": F.sum("__c").over(upto), "__n": F.sum("__c").over(all_)})
    at = lambda p: F.min(F.when(F.col("__upto") > F.floor((F.col("__n") - 1) * F.lit(p)), F.col("__v")))
    return placed.groupBy(*by).agg(*(at(p).alias(name) for name, p in ps.items()))


def cases(questions: DataFrame, hits: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Per question: first_hit (0: none), hit_1, hit_3, hit_5, hit_10, recall_5, returned, tokens, tokens_to_hit.

    questions: qid, expect (paths); without any it is left out. hits: qid, path, place, and whatever tokens counts.
    """
    wanted = questions.filter(F.size("expect") > 0).select("qid", F.explode(F.array_distinct("expect")).alias("path"))
    n = wanted.groupBy("qid").agg(F.count("*").alias("n_expected"))
    each = hits.select("qid", "path", "place", (tokens if tokens is not None else F.lit(0)).cast("long").alias("tokens"))
    each = each.withColumn("so_far", F.sum("tokens").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    judged = each.join(wanted.withColumn("right", F.lit(True)), ["qid", "path"], "left")
    right = F.coalesce("right", F.lit(False))
    got = judged.groupBy("qid").agg(
        F.min(F.when(right, F.col("place"))).alias("first"), F.count_if(right & (F.col("place") <= 5)).alias("in_5"), F.count("*").alias("returned"), F.sum("tokens").alias("tokens"), F.min(F.when(right, F.col("so_far"))).alias("tokens_to_hit")
    )
    c = n.join(got, "qid", "left")
    first = F.coalesce("first", F.lit(0)).cast("long")
    within = lambda k: ((first > 0) & (first <= k)).alias(f"hit_{k}")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return c.select("qid", "n_expected", first.alias("first_hit"), *(within(k) for k in (1, 3, 5, 10)), (F.coalesce("in_5", F.lit(0)) / F.col("n_expected")).alias("recall_5"), zero("returned"), zero("tokens"), zero("tokens_to_hit"))


def summary(case_rows: DataFrame, by: tuple[str, ...] = (), zeros: bool = False) -> DataFrame:
    """n, hit rates, mrr, recall_5, p50 and p99 of tokens over all cases or groups; tokens of 0 count only with zeros.

    With latency_ms in the cases also avg_ms, p50_ms, p95_ms, p99_ms.
    """
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    timed = "latency_ms" in case_rows.columns
    rates = case_rows.groupBy(*by).agg(
        F.count("*").alias("n"), rate("hit_1"), rate("hit_3"), rate("hit_5"), rate("hit_10"), F.avg(F.when(F.col("first_hit") > 0, 1 / F.col("first_hit")).otherwise(0.0)).alias("mrr"), F.avg("recall_5").alias("recall_5"),
        *([F.avg("latency_ms").alias("avg_ms")] if timed else []),
    )
    counted = case_rows.withColumn("__t", F.col("tokens") if zeros else F.when(F.col("tokens") > 0, F.col("tokens")))
    parts = [order_statistics(counted, "__t", {"tokens_p50": 0.5, "tokens_p99": 0.99}, by)]
    if timed:
        parts.append(order_statistics(case_rows, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, by))
    for part in parts:
        # one row a group
        rates = rates.join(part, list(by), "left") if by else rates.crossJoin(part)
    return rates.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens_p50", "tokens_p99")})


#: The order of question types in an overview; others stand between, unknown ones last.
TYPE_ORDER = {"library_search": 0, "tech_stack_search": 1, "production_telemetry": 2, "natural_language": 3, "lexical": 4, "unknown": 99}


def named(case_rows: DataFrame) -> DataFrame:
    """case_rows with library (the expected source, that of the first expected path, or the one asked) and type."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    first = F.get("expect", F.lit(0))
    of_path = F.when(F.contains(first, F.lit("/")), F.split(first, "/")[0])
    return case_rows.withColumns({"library": F.coalesce(some("expected_source"), some(of_path), some("source"), F.lit("unknown")), "type": F.coalesce(some("query_type"), F.lit("unknown"))})


def overview(case_rows: DataFrame, by: str) -> DataFrame:
    """place, name and summary() of the groups of a column of named(): libraries, worst first; types in their fixed order."""
    rows = summary(case_rows, (by,), zeros=True).withColumnRenamed(by, "name")
    slow = [F.desc("p95_ms")] if "p95_ms" in rows.columns else []
    kind = F.coalesce(*(F.when(F.col("name") == t, n) for t, n in TYPE_ORDER.items()), F.lit(50))
    order = [kind, F.col("name")] if by == "type" else [F.col("hit_5"), *slow, F.col("name")]
    return rows.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"), *rows.columns)


def write_report(case_rows: DataFrame, folder: str, now: str) -> None:
    """An evaluation's artefacts: cases and summary as JSON lines, the summary appended to a log, a Markdown report.

    The report has the summary, the overviews by library and type where cases are named(), and the misses, one line each;
    lines are written by the tasks that hold them, in order.
    """
    total = summary(case_rows)
    case_rows.write.mode("overwrite").json(f"{folder}/cases")
    total.write.mode("overwrite").json(f"{folder}/summary")
    total.select(F.lit(now).alias("timestamp"), F.struct("*").alias("summary")).write.mode("append").json(f"{folder}/log")
    line = lambda *cols: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in cols)), F.lit(" |"))
    head = lambda k, *texts: total.sparkSession.createDataFrame([(k, i, t) for i, t in enumerate(texts)], "part int, n int, line string")
    cols = ("n", "hit_1", "hit_5", "mrr", "recall_5", "tokens_p50", "tokens_p99")
    parts = [head(0, "# Evaluation", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)), total.select(F.lit(1).alias("part"), F.lit(0).alias("n"), line(*cols).alias("line"))]
    for k, by in ((2, "library"), (4, "type")):
        if by in case_rows.columns:
            parts.append(head(k, "", f"## By {by}", "", "| name | n | hit_1 | hit_5 | mrr |", "|" + " --- |" * 5))
            parts.append(overview(case_rows, by).select(F.lit(k + 1).alias("part"), F.col("place").alias("n"), line("name", "n", "hit_1", "hit_5", "mrr").alias("line")))
    parts.append(head(6, "", "## Misses", ""))
    parts.append(case_rows.filter("first_hit = 0").select(F.lit(7).alias("part"), F.col("qid").cast("int").alias("n"), F.concat(F.lit("- "), F.col("qid").cast("string")).alias("line")))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    report.orderBy("part", "n").select("line").write.mode("overwrite").text(f"{folder}/report")


def within_budget(case_rows: DataFrame, budgets: list[int]) -> DataFrame:
    """budget and the share of cases whose first right hit comes within it."""
    each = case_rows.select("first_hit", "tokens_to_hit", F.explode(F.array(*(F.lit(b) for b in budgets))).alias("budget"))
    ok = (F.col("first_hit") > 0) & (F.col("tokens_to_hit") <= F.col("budget"))
    return each.groupBy("budget").agg(F.avg(ok.cast("double")).alias("rate"))


def gate(summary_row: DataFrame, least: dict[str, float]) -> list[str]:
    """What of a one-row summary is below its threshold."""
    row = summary_row.first()
    return [f"{k}: {row[k]:.4f} < {v}" for k, v in least.items() if row[k] < v]


def compare(before: DataFrame, now: DataFrame) -> DataFrame:
    """q, before, now, delta, kind (better, worse, same, added, removed) of first places by question; a miss counts MISS.

    Of questions that occur twice the last counts (the highest qid).
    """
    last = lambda d, name: d.groupBy("q").agg(F.max(F.struct("qid", "first_hit"))["first_hit"].alias(name))
    both = last(before, "before").join(last(now, "now"), "q", "full_outer")
    place = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(MISS)
    delta = place("now") - place("before")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(delta < 0, "better").when(delta > 0, "worse").otherwise("same")
    return both.select("q", "before", "now", F.when(F.col("before").isNotNull() & F.col("now").isNotNull(), delta).alias("delta"), kind.alias("kind"))


def displacing(before: DataFrame, now: DataFrame, top: int = 3) -> DataFrame:
    """qid and paths that are among the first `top` now and were not before, by place."""
    new = now.filter(F.col("place") <= top).join(before.filter(F.col("place") <= top).select("qid", "path"), ["qid", "path"], "left_anti")
    return new.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def source_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """source, before, now of sources whose number of pages changed; none counts 0."""
    n = lambda d, name: d.groupBy("source").agg(F.count("*").alias(name))
    both = n(before, "before").join(n(now, "now"), "source", "full_outer").na.fill(0, ["before", "now"])
    return both.filter("before <> now")


def unknown_expectations(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, path of expected pages that the corpus lacks."""
    return questions.select("qid", F.explode("expect").alias("path")).join(corpus.select("path"), "path", "left_anti").select("qid", "path")


def slowest(case_rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return case_rows.orderBy(F.desc(column), "qid").limit(n)


def suspects(before: DataFrame, now: DataFrame) -> DataFrame:
    """q and kind of what got worse: lost (no hit now), pushed out (beyond ten), slipped, from compare()'s rows."""
    worse = compare(before, now).filter("kind = 'worse'")
    kind = F.when(F.col("now") == 0, "lost").when(F.col("now") > 10, "pushed out").otherwise("slipped")
    return worse.select("q", "before", "now", kind.alias("suspect"))
