"""Profiles, versions, hygiene: what a hit's path and source say about it, and what that does to its place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """`**` crosses directories (and takes the slash behind it), `*` and `?` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            i += glob.startswith("/", i)
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def profile_match(pages: DataFrame, profile: list[tuple[str, str | None]]) -> DataFrame:
    """pages with in_profile and in_profile_sub. profile: (source, glob below it, or None for the whole source)."""
    whole = [s for s, g in profile if g is None]
    rel = F.regexp_replace("path", "^[^/]*/", "")
    sub = F.lit(False)
    for source, glob in profile:
        if glob is not None:
            sub = sub | ((F.col("source") == source) & rel.rlike(glob_regex(glob)))
    all_ = F.col("source").isin(*whole) if whole else F.lit(False)
    return pages.withColumns({"in_profile": all_ | sub, "in_profile_sub": sub & ~all_})


def hygiene_penalty(path: Column, url: Column, patterns: list[tuple[str, int]]) -> Column:
    """The highest penalty of the patterns that path or URL hold."""
    text = F.lower(F.concat(path, F.lit("\n"), F.coalesce(url, F.lit(""))))
    return F.greatest(F.lit(0), F.lit(0), *(F.when(F.contains(text, F.lit(p)), v).otherwise(0) for p, v in patterns))


def apply_hygiene(hits: DataFrame, limit: int) -> DataFrame:
    """hits (qid, path, place, penalty) by penalty and place; where a clean hit leads the first penalised one, only clean ones."""
    q = Window.partitionBy("qid")
    clean, dirty = F.min(F.when(F.col("penalty") == 0, F.col("place"))).over(q), F.min(F.when(F.col("penalty") > 0, F.col("place"))).over(q)
    kept = hits.withColumns({"c": clean, "d": dirty}).filter(~F.coalesce(F.col("c") < F.col("d"), F.lit(False)) | (F.col("penalty") == 0)).drop("c", "d")
    placed = kept.withColumn("new_place", F.row_number().over(q.orderBy("penalty", "place")))
    return placed.filter(F.col("new_place") <= limit) if limit > 0 else placed


def over_fetch(limit: int) -> int:
    """How many candidates hygiene needs for so many hits."""
    return min(max(5 * limit, limit + 10), max(50, limit))


def version_of(source: Column) -> Column:
    """family, version and lane from a source's name: family__v1.2, or the latest."""
    family = F.regexp_extract(source, r"^(.*?)(__v|$)", 1)
    version = F.regexp_extract(source, r"__v(.+)$", 1)
    return F.struct(family.alias("family"), F.when(version != "", version).alias("version"), F.when(version != "", "pinned").otherwise("latest").alias("lane"))


def lane_score(lane: Column, prefer_latest: Column, pinned_here: Column) -> Column:
    """Points of a lane: for questions about the latest, for pins of the reader's own project, or in general."""
    latest = F.when(lane == "latest", 500).when(lane == "lts", 250).when(lane == "pinned", 100).otherwise(0)
    usual = F.when(pinned_here, 600).when(lane == "pinned", 450).when(lane == "latest", 300).when(lane == "lts", 150).when(lane == "unversioned", 50).otherwise(0)
    return F.when(prefer_latest, latest).otherwise(usual)


def matches_version(hit: Column, source_id: str | None = None, family: str | None = None, latest_only: bool = False, version: str | None = None) -> Column:
    """Whether a hit (struct of source, family, version, lane) fits: a source alone decides, then family, latest, version."""
    if source_id:
        return hit["source"] == source_id
    ok = F.lit(True) if not family else hit["family"] == family
    if latest_only:
        return ok & (hit["lane"] == "latest")
    return ok & (hit["version"].eqNullSafe(F.lit(version))) if version else ok


def collapse_versions(hits: DataFrame, stem: Column, limit: int = 0) -> DataFrame:
    """The first hit of each stem of a query, places renumbered."""
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy("qid", stem).orderBy("place"))).filter("__n = 1").drop("__n")
    placed = first.withColumn("new_place", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    return placed.filter(F.col("new_place") <= limit) if limit > 0 else placed


def pins(evidence: DataFrame, latest: DataFrame) -> DataFrame:
    """family, scope, version, files of each project's pins: lock files outrank other evidence; the latest is no pin.

    evidence: family, scope, version, file, lockfile. latest: family, latest_version.
    """
    own = Window.partitionBy("family", "scope")
    best = evidence.withColumn("any_lock", F.max("lockfile").over(own)).filter(F.col("lockfile") | ~F.col("any_lock"))
    grouped = best.groupBy("family", "scope", "version").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return grouped.join(latest, "family", "left").filter(~F.coalesce(F.col("version") == F.col("latest_version"), F.lit(False))).drop("latest_version")


def orphans(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pins (family, version, scope) that nothing asks for any more."""
    return before.join(now, ["family", "version", "scope"], "left_anti")


def package_pins(files: DataFrame) -> DataFrame:
    """path, package, version, exact of package manifests (path, text), from their dependencies."""
    both = F.map_concat(*(F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")))
    each = files.select("path", F.explode(both).alias("package", "spec"))
    return each.select("path", "package", F.regexp_replace("spec", r"^[\^~=v]+", "").alias("version"), F.col("spec").rlike(r"^=?v?\d+(\.\d+)*([-+].*)?$").alias("exact"))


def clean_version(version: Column) -> Column:
    """A version without range marks and v in front, and without what a lock file adds in brackets behind it."""
    return F.regexp_replace(F.regexp_replace(F.trim(version), r"\(.*$", ""), r"^[\^~=v]+", "")


def is_pinned(spec: Column) -> Column:
    """Whether a package manifest's version names one release: no range, no local or workspace reference."""
    local = F.trim(spec).rlike(r"^(workspace|file|link|portal|catalog):")
    return (F.trim(spec) != "") & ~local & ~spec.rlike(r"[\^~<>=*xX|]") & (clean_version(spec) != "")


SKIPPED_FOLDERS = ("\\.git", "\\.claude", "node_modules", "_worktrees", "feat", "dist", "build", "\\.next", "archive", "archives")


def pin_evidence(files: DataFrame, packages: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """family, scope, package, version, declared, file, lockfile of what files (path, text) say about the packages.

    Read are package.json, package-lock.json, pnpm-lock.yaml and go.mod, outside SKIPPED_FOLDERS. packages: package,
    family. scopes: root -> scope; a file belongs to the longest root that it lies in, or to none and is left out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    f = files.filter(~F.col("path").rlike("(^|/)(" + "|".join(SKIPPED_FOLDERS) + ")/")).withColumn("name", name)
    roots = sorted(scopes, key=len)
    scope = F.lit(None).cast("string")
    for r in roots:  # longer roots come later and win
        scope = F.when(F.startswith("path", F.lit(r.rstrip("/") + "/")), F.lit(scopes[r])).otherwise(scope)
    f = f.withColumn("scope", scope).filter("scope IS NOT NULL")
    as_map = lambda text, of: F.coalesce(F.from_json(text, of), F.create_map().cast(of))
    deps = [F.map_entries(as_map(F.get_json_object("text", f"$.{k}"), "map<string,string>")) for k in ("dependencies", "devDependencies")]
    declared = f.filter("name = 'package.json'").select("path", "scope", F.explode(F.concat(*deps)).alias("d")).select("path", "scope", F.col("d.key").alias("package"), F.col("d.value").alias("declared"))
    declared = declared.filter(is_pinned(F.col("declared"))).withColumns({"version": F.col("declared"), "lockfile": F.lit(False)})
    locked = f.filter("name = 'package-lock.json'").select("path", "scope", F.explode(as_map(F.get_json_object("text", "$.packages"), "map<string,struct<version:string>>")).alias("key", "value"))
    locked = locked.filter(F.startswith("key", F.lit("node_modules/"))).select("path", "scope", F.expr("substring(key, 14)").alias("package"), F.lit(None).cast("string").alias("declared"), F.col("value.version").alias("version"), F.lit(True).alias("lockfile"))
    # Importers of a pnpm lock: a name at one depth, its specifier and version one deeper.
    pnpm = r"(?m)^ {6,8}'?([^\s:']+)'?:\n\s+specifier: ([^\n]+)\n\s+version: ([^\n]+)$"
    hits = f.filter("name = 'pnpm-lock.yaml'").select("path", "scope", F.explode(F.regexp_extract_all("text", F.lit(pnpm), F.lit(0))).alias("hit"))
    part = lambda i: F.regexp_replace(F.trim(F.regexp_extract("hit", pnpm, i)), "^['\"]|['\"]$", "")
    yaml = hits.select("path", "scope", part(1).alias("package"), part(2).alias("declared"), part(3).alias("version"), F.lit(True).alias("lockfile"))
    gomod = r"(?m)^(?:require )?\s*([a-z][\w.-]*\.[a-z]+/\S+)\s+(v\S+)"
    mods = f.filter("name = 'go.mod'").select("path", "scope", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"(?m)^\s*(//|replace|exclude|module).*$", ""), F.lit(gomod), F.lit(0))).alias("hit"))
    mods = mods.select("path", "scope", F.regexp_extract("hit", gomod, 1).alias("package"), F.regexp_extract("hit", gomod, 2).alias("version"), F.lit(True).alias("lockfile")).withColumn("declared", F.col("version"))
    cols = ["path", "scope", "package", "declared", "version", "lockfile"]
    every = declared.select(*cols).unionByName(locked.select(*cols)).unionByName(yaml.select(*cols)).unionByName(mods.select(*cols))
    found = every.join(packages, "package").withColumn("version", clean_version(F.col("version"))).filter(F.coalesce(F.col("version"), F.lit("")) != "")
    return found.select("family", "scope", "package", "version", "declared", F.col("path").alias("file"), "lockfile")


def kept_orphans(orphan_pins: DataFrame, marked: DataFrame, now: str, grace_days: int = 30) -> DataFrame:
    """The orphans with since (when each was first seen as one) and gone: whether it may go, after the grace time.

    marked: family, version, scope, since (ISO 8601) of the last run; a pin that is asked for again has lost its mark.
    """
    both = orphan_pins.join(marked, ["family", "version", "scope"], "left").withColumn("since", F.coalesce("since", F.lit(now)))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("since").cast("timestamp"))
    return both.withColumn("gone", age > 86_400 * grace_days)


def version_info(hits: DataFrame, pins: DataFrame, latest: DataFrame, scope: str | None) -> DataFrame:
    """hits with family, version, lane and pinned_here, from their source and path, the pins and the registry.

    A pinned source is `family__vVERSION`; a path segment `vN` or `N.M` below a known family is its version too. Families
    of the registry (latest: family, latest_version, lts_version) without a version are `latest`, all others unversioned.
    pins: family, scope, version.
    """
    own = version_of(F.col("source"))
    h = hits.withColumn("__v", own).withColumn("family", F.col("__v.family"))
    inner = F.regexp_extract("path", r"^[^/]+/(?:[^/]+/)*?(v\d+(?:\.\d+)*|\d+\.\d+(?:\.\d+)*)/", 1)
    # both are tables of the deployment's families
    h = h.join(latest.withColumn("known", F.lit(True)), "family", "left")
    version = F.coalesce(F.col("__v.version"), F.when(F.col("known") & (inner != ""), F.regexp_replace(inner, "^v", "")))
    h = h.withColumn("version", version)
    lane = F.when(version.isNotNull() & (version == F.col("lts_version")), "lts").when(version.isNotNull() & ~F.coalesce(version == F.col("latest_version"), F.lit(False)), "pinned").when(F.col("known"), "latest").otherwise("unversioned")
    here = pins.filter(F.col("scope") == F.lit(scope)).select("family", "version").distinct().withColumn("pinned_here", F.lit(True))
    return h.withColumn("lane", lane).drop("__v", "known", "latest_version", "lts_version").join(here, ["family", "version"], "left").withColumn("pinned_here", F.coalesce("pinned_here", F.lit(False))).select(*hits.columns, "family", "version", "lane", "pinned_here")


def family_of(source: str | None, families: set[str]) -> tuple[str | None, str | None]:
    """A caller's source as (source, family): a pinned source stays one; the name of a family asks for all its sources."""
    if source and source not in families:
        return source, None
    return None, source or None


def seed_plan(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """source, family, version, action of pinned sources: seed what is asked for and not there, keep the rest.

    wanted: family, version (pins()). there: source. A seeded source is written beside the old ones under its own name, so
    that the swap is the source's appearance; streaming.corpora.seed() publishes them, and rollback() takes that back.
    """
    w = wanted.select("family", "version").distinct().withColumn("source", F.concat("family", F.lit("__v"), F.col("version").cast("string")))
    both = w.join(there.select("source").distinct().withColumn("here", F.lit(True)), "source", "left")
    return both.select("source", "family", "version", F.when(F.col("here"), "keep").otherwise("seed").alias("action"))


def profile_lint(pages: DataFrame, profile: list[tuple[str, str | None]]) -> DataFrame:
    """source, glob, n: how many pages each entry of a profile matches; 0 is worth a warning."""
    spark = pages.sparkSession
    entries = spark.createDataFrame([(s, g or "", glob_regex(g) if g else "^.*$") for s, g in profile], "source string, glob string, re string")
    rel = pages.select("source", F.regexp_replace("path", "^[^/]*/", "").alias("rel"))
    hit = rel.join(entries, "source").filter(F.expr("rel rlike re")).groupBy("source", "glob").agg(F.count("*").alias("n"))
    return entries.drop("re").join(hit, ["source", "glob"], "left").select("source", "glob", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
