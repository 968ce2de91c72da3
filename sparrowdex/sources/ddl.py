"""Tables from SQL migrations: statements are found by patterns, then replayed in order table by table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r'(?:"?[\w$]+"?\.)?"?[\w$]+"?'


def without_comments(sql: str) -> str:
    """sql without comments; quoted text stays as it is."""
    return re.sub(r"('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)


def qualified(name: str) -> str:
    plain = name.replace('"', "").lower()
    return plain if "." in plain else f"public.{plain}"


def objects(migrations: DataFrame) -> DataFrame:
    """base, kind, name, n of the objects that migrations (base, sql) create, alter and drop."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda x: without_comments(x or ""))

    bare = migrations.select("base", clean("sql").alias("sql"))
    kinds = {
        "create table": rf"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?({_NAME})", "alter table": rf"(?i)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_NAME})",
        "drop table": rf"(?i)drop\s+table\s+(?:if\s+exists\s+)?({_NAME})", "create index": rf"(?i)create\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({_NAME})",
        "create policy": r'(?i)create\s+policy\s+("[^"]+"|\w+)', "enable rls": rf"(?i)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_NAME})\s+enable\s+row\s+level\s+security",
        "create function": rf"(?i)create\s+(?:or\s+replace\s+)?function\s+({_NAME})", "create view": rf"(?i)create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+({_NAME})",
    }
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("sql", F.lit(p), F.lit(1)).alias("names")) for k, p in kinds.items()))
    rows = bare.select("base", F.explode(each).alias("e")).select("base", "e.kind", F.explode("e.names").alias("name"))
    name = F.lower(F.replace("name", F.lit('"'), F.lit("")))
    full = F.when(F.col("kind") == "create policy", name).when(name.contains("."), name).otherwise(F.concat(F.lit("public."), name))
    counted = rows.groupBy("base", "kind", full.alias("name")).agg(F.count("*").alias("n"))
    # An ALTER that only switches row security on is told by that alone.
    rls = counted.filter("kind = 'enable rls'").select("base", "name", F.col("n").alias("r"))
    both = counted.join(rls, ["base", "name"], "left")
    n = F.when(F.col("kind") == "alter table", F.col("n") - F.coalesce("r", F.lit(0))).otherwise(F.col("n"))
    return both.select("base", "kind", "name", n.alias("n")).filter("n > 0")


def split_top(text: str, at: str = ",") -> list[str]:
    """text at its commas (or another mark) outside of brackets and quotes."""
    out, depth, held, quote = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        if ch == at and not depth and not quote:
            out.append(held.strip())
            held = ""
        else:
            held += ch
    return [x for x in [*out, held.strip()] if x]


def _column(entry: str) -> tuple[str, str] | None:
    if re.match(r"(?i)(primary|foreign|unique|check|constraint|exclude|like)\b", entry):
        return None
    m = re.match(r'"?([\w$]+)"?\s+(.*)', entry, re.S)
    return (m[1].lower(), " ".join(m[2].split())) if m else None


def replay(statements: Iterator[str]) -> dict[str, str] | None:
    """name -> definition of a table's columns after its statements in order; None once it is dropped."""
    columns: dict[str, str] | None = None
    for s in statements:
        if m := re.match(rf"(?is)\s*create\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\((.*)\)", s):
            columns = dict(c for e in split_top(m[1]) if (c := _column(e)))
        elif re.match(r"(?i)\s*drop\s+table", s):
            columns = None
        elif m := re.match(rf"(?is)\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_NAME}\s+(.*)", s):
            for action in split_top(m[1]):
                if a := re.match(r"(?is)add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(.*)", action):
                    if c := _column(a[1]):
                        columns = {**(columns or {}), c[0]: c[1]}
                elif a := re.match(r'(?is)drop\s+(?:column\s+)?(?:if\s+exists\s+)?"?([\w$]+)"?', action):
                    columns = {k: v for k, v in (columns or {}).items() if k != a[1].lower()}
                elif a := re.match(r'(?is)rename\s+(?:column\s+)?"?([\w$]+)"?\s+to\s+"?([\w$]+)"?', action):
                    columns = {a[2].lower() if k == a[1].lower() else k: v for k, v in (columns or {}).items()}
                elif a := re.match(r'(?is)alter\s+(?:column\s+)?"?([\w$]+)"?\s+(.*)', action):
                    key = a[1].lower()
                    if columns and key in columns:
                        columns = {**columns, key: f"{columns[key]} [{' '.join(a[2].split())}]"}
    return columns


def order_key(base: Column) -> list[Column]:
    """Migrations with a timestamp first, by it, then by name."""
    ts = F.regexp_extract(base, r"^(\d{14})_", 1)
    return [ts == "", ts, base]


def table_states(migrations: DataFrame) -> DataFrame:
    """name, columns (array of name, type) of the tables that are left after all migrations (base, sql).

    Statements are dealt by table; a table's own history is replayed in one place, in order.
    """

    @F.pandas_udf("array<struct<n:int,name:string,sql:string>>")
    def statements(s: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[tuple[int, str, str]]:
            out = []
            for i, part in enumerate(split_top(without_comments(text or ""), ";")):
                m = re.match(rf"(?is)\s*(?:create\s+table\s+(?:if\s+not\s+exists\s+)?|alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?|drop\s+table\s+(?:if\s+exists\s+)?)({_NAME})", part)
                if m:
                    out.append((i, qualified(m[1]), part))
            return out

        return s.map(lambda x: [{"n": a, "name": b, "sql": c} for a, b, c in of(x)])

    each = migrations.select("base", F.explode(statements("sql")).alias("s")).select("base", "s.n", "s.name", "s.sql")
    keyed = each.select("name", "sql", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order_key(F.col("base")))), F.col("n")).alias("k"))
    histories = keyed.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "sql"))), lambda x: x["sql"]).alias("history"))

    @F.pandas_udf("array<struct<name:string,type:string>>")
    def state(h: pd.Series) -> pd.Series:
        def of(history) -> list[dict] | None:
            got = replay(iter(history))
            return None if got is None else [{"name": k, "type": v} for k, v in got.items()]

        return h.map(of)

    return histories.select("name", state("history").alias("columns")).filter("columns IS NOT NULL")


def render_tables(states: DataFrame) -> DataFrame:
    """name, markdown of table_states(): a heading and a row for each column."""
    row = lambda c: F.concat(F.lit("| "), c["name"], F.lit(" | "), F.replace(c["type"], F.lit("|"), F.lit("\\|")), F.lit(" |"))
    body = F.array_join(F.transform("columns", row), "\n")
    return states.select("name", F.concat(F.lit("# "), "name", F.lit("\n\n| column | type |\n| --- | --- |\n"), body).alias("markdown"))


def render_migrations(found: DataFrame) -> DataFrame:
    """base, markdown of objects(): what each migration does, by kind and name."""
    line = F.concat(F.lit("- "), "kind", F.lit(" `"), "name", F.lit("`"), F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(""))
    return found.groupBy("base").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "name", line.alias("line")))), lambda x: x["line"]), "\n").alias("list")).select("base", F.concat(F.lit("# "), "base", F.lit("\n\n"), "list").alias("markdown"))
