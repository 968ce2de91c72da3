"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance by directory.

DataFrame functions only. A unit is a sentence of a file (a header or notice), or the whole file. Units with a cue word
are compared with the templates of their kind: term counts times smoothed inverse document frequencies over the
templates (a term in no template has the highest), cosine, best template of each unit from ``threshold`` on; of a file's
units the best one names its licence. Whole files, and runs of sentences with cue words at most GAP apart, are also
compared with notices of several sentences and whole licences (licensetexts.texts()), sentences with the further single
sentences there; these have their own inverse document frequencies. A match of a whole text or of several sentences goes
before any single sentence, as ``All rights reserved.`` stands in many licences. A file is a licence file where its name
says so, or where the sentences that match, or the run, hold at least ``file_share`` of its words. A file without a licence of its own takes that of the licence file in its
nearest ancestor directory, by a join on directory paths whose keys are salted, as one directory may hold most files.

The templates (two fixed lists of MAX_TEMPLATES at most) are broadcast; nothing else is.

Cases: a null text has no units; a null path lies in the root directory. Ties go to the higher cosine, then the smaller
licence name, then (among licence files of a directory) the smaller path. Files with the same id share one result row
each; extra columns are ignored; an empty table gives an empty result. Cosines are rounded to 6 digits before they are
compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from .licensetexts import texts

SALTS = 16
MAX_TEMPLATES = 1000
#: Sentences with cue words form one run with so many places from one to the next.
GAP = 8
# Cue words, names of licence files, and short templates of common notices.
CUES = r"(?i)licen[cs]|copyright|copyleft|public domain|rights reserved|permission|warranty|redistribut"
RUN_CUES = CUES + r"|liabl|liabilit|damages|merchantab|free software|\bgnu\b"
SENTENCES = r"\n+|(?<=[.!?;])\s+"
LICENSE_FILES = r"(?i)^(un)?licen[cs]e|^copying|^copyright|^notice(\.|$)"
TEMPLATES = [
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "header", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "file", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "header", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "header", "To the extent possible under law, the author has dedicated all copyright to the public domain."),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "header", "Released under the MIT License."),
    ("MIT", "header", "Licensed under the MIT License."),
    ("MIT", "file", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "header", "All rights reserved."),
]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}.-]+"), lambda x: F.regexp_replace(x, r"[.-]+", "") != "")


def _clean(term: Column) -> Column:
    return F.regexp_replace(term, r"^[.-]+|[.-]+$", "")


def template_vectors(spark, templates: list[tuple[str, str, str]]) -> tuple[DataFrame, float]:
    """license, kind, tid, term, weight (of unit length) with the term's idf; and the idf of a term that none has."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "tid int, license string, kind string, text string")
    terms = rows.select("tid", "license", "kind", F.explode(_terms(F.col("text"))).alias("term")).withColumn("term", _clean(F.col("term")))
    counts = terms.groupBy("tid", "license", "kind", "term").agg(F.count("*").alias("tf"))
    n = float(len(templates))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("tid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = weighed.join(norms, "tid").select("license", "kind", "tid", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))
    # Some thousand rows that a scan reads twice: written once, so that no plan holds how they are made.
    return stored(vectors, "license-vectors"), math.log(1 + n) + 1


def _cued(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return files.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(CUES))


def _matches(units: DataFrame, templates: list[tuple[str, str, str]], threshold: float) -> DataFrame:
    """Of id, unit, kind, text: id, unit, n_terms, license and cosine of each unit that matches a template of its kind."""
    vectors, rare = template_vectors(units.sparkSession, templates)
    terms = units.select("id", "unit", "kind", F.explode(F.transform(_terms(F.col("text")), _clean)).alias("term"))
    counts = terms.groupBy("id", "unit", "kind", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(vectors.select("term", "idf").distinct())
    weighed = counts.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare))).drop("idf")
    norms = weighed.groupBy("id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_terms"))
    dots = weighed.join(F.broadcast(vectors.select("license", "kind", "tid", "term", "weight")), ["kind", "term"]).groupBy("id", "unit", "tid", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["id", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license", "n_terms")).alias("b")
    found = scored.groupBy("id", "unit").agg(best).select("id", "unit", F.col("b.n_terms").alias("n_terms"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    # A row for each unit that matches: later steps read it several times.
    return stored(found, "license-matches")


def _units(texts: DataFrame) -> DataFrame:
    """id, unit, kind, text of the sentences with a cue word (header) and of the whole files (file, unit -1)."""
    sentences = texts.select("id", F.posexplode(F.split("text", SENTENCES)).alias("unit", "text")).filter(F.col("text").rlike(CUES)).withColumn("kind", F.lit("header"))
    return sentences.unionByName(texts.select("id", F.lit(-1).alias("unit"), "text", F.lit("file").alias("kind")))


def _runs(texts: DataFrame) -> DataFrame:
    """id, unit (-2 and below), kind (file), text of the runs of several sentences with cue words."""
    s = texts.select("id", F.split("text", SENTENCES).alias("s"))
    s = s.withColumn("at", F.filter(F.transform("s", lambda x, i: F.when(x.rlike(RUN_CUES), i)), lambda i: i.isNotNull()))
    near = lambda i, k: F.coalesce(F.abs(i - F.get(F.col("at"), k)) <= GAP, F.lit(False))
    ends = [F.filter("at", lambda i, k: ~near(i, k - 1)).alias("first"), F.filter("at", lambda i, k: ~near(i, k + 1)).alias("last")]
    runs = s.select("id", "s", F.posexplode(F.arrays_zip(*ends)).alias("n", "run")).filter("run.last > run.first")
    text = F.array_join(F.slice("s", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1), "\n")
    return runs.select("id", (-2 - F.col("n")).alias("unit"), F.lit("file").alias("kind"), text.alias("text"))


def notices(files: DataFrame, id_col: str = "id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None, threshold: float = 0.6) -> DataFrame:
    """id, unit (sentence number, or -1 for the whole file), n_terms, license and cosine of each unit that matches."""
    return _matches(_units(_cued(files, id_col, text_col)), templates or TEMPLATES, threshold)


def text_notices(files: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """The same against licensetexts.texts(); units from -2 down are runs of sentences."""
    cued = _cued(files, id_col, text_col)
    return _matches(_units(cued).unionByName(_runs(cued)), texts(), threshold)


def _ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, the root last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def license_scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None, threshold: float = 0.6, file_share: float = 0.3) -> DataFrame:
    """Per row: id, path, license (null if none), cosine (of the match that names it), origin (own, inherited, none), license_file, depth.

    license_file: whether the file is one; depth: directories between an inheriting file and the licence file's.
    With templates of the caller's own, only these are compared.
    """
    found = notices(files, id_col, text_col, templates, threshold).withColumn("several", F.lit(False))
    if not templates:
        found = found.unionByName(text_notices(files, id_col, text_col, threshold).withColumn("several", F.col("unit") < 0))
        one = F.min(F.struct((~F.col("several")).alias("single"), (-F.col("cosine")).alias("c"), "license", "n_terms")).alias("b")
        found = found.groupBy("id", "unit").agg(one).select("id", "unit", F.col("b.n_terms").alias("n_terms"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), (~F.col("b.single")).alias("several"))
    terms = lambda which: F.coalesce(F.sum(F.when(which, F.col("n_terms"))), F.lit(0))
    best = F.min(F.struct((~F.col("several")).alias("single"), (-F.col("cosine")).alias("c"), "license", "unit")).alias("b")
    own = found.groupBy("id").agg(best, F.greatest(terms(F.col("unit") >= 0), terms(F.col("unit") < -1)).alias("matched"), F.max(F.col("unit") == -1).alias("whole"))
    base = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    size = F.when(F.col("text").rlike(CUES), F.size(_terms(F.col("text")))).otherwise(0)
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILES)
    all_ = base.select("id", "path", size.alias("n")).join(own, "id", "left")
    all_ = all_.select("id", "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), F.coalesce(F.col("b").isNotNull() & (named | F.col("whole") | (F.col("matched") >= file_share * F.col("n"))), F.lit(False)).alias("license_file"))
    all_ = stored(all_, "licensed-files")
    directory = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    dirs = all_.filter("license_file").select(directory.alias("dir"), "license", "cosine", "path").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "path")).alias("b"))
    dirs = dirs.select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    bare = all_.filter("license IS NULL")
    up = bare.select("id", "path", F.posexplode(_ancestors(F.col("path"))).alias("depth", "dir")).withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    hit = F.when(F.col("dir_license").isNotNull(), F.struct("depth", "dir_license", "dir_cosine"))
    heir = up.join(dirs, ["dir", "salt"], "left").groupBy("id", "path").agg(F.min(hit).alias("d"))
    inherited = heir.select("id", "path", F.col("d.dir_license").alias("license"), F.col("d.dir_cosine").alias("cosine"), F.when(F.col("d").isNull(), "none").otherwise("inherited").alias("origin"), F.lit(False).alias("license_file"), F.col("d.depth").alias("depth"))
    direct = all_.filter("license IS NOT NULL").select("id", "path", "license", "cosine", F.lit("own").alias("origin"), "license_file", F.lit(None).cast("int").alias("depth"))
    return direct.unionByName(inherited).select(F.col("id").alias(id_col), F.col("path").alias(path_col), "license", "cosine", "origin", "license_file", "depth")


def document_paths(docs: DataFrame) -> DataFrame:
    """id, path, text of a document table: source/lang/thousand/id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.expr("doc_id div 1000").cast("string"), F.lit("none")), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text")
