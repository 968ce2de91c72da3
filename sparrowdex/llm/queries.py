"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, bpe, decontam, divergence, htmltext, langid, licenses, linededup, mixing, ngramjoin, quality, shards, suffix
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op8_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}]+'), lambda x: x <> '') AS tokens, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  regexp_replace(text, '[a-zA-Z\x09-\x0D\x20\p{L}\p{M}]+', '', 'g') AS r0 FROM t),
r AS (SELECT *, regexp_replace(r0, '[#*$%&|<>]+', '', 'g') AS r1, regexp_replace(regexp_replace(r0, '[#*$%&|<>]+', '', 'g'), '\p{Nd}+', '', 'g') AS r2 FROM w),
c AS (SELECT *, [length(text) - length(r0), length(r0) - length(r1), length(r1) - length(r2), length(r2) - length(regexp_replace(r2, '[[:punct:]]+', '', 'g')), length(regexp_replace(r2, '[[:punct:]]+', '', 'g'))] AS cs FROM r),
tri AS (SELECT doc_id, k, array_to_string(ws[k:k + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS spot FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS m FROM tri) WHERE m > 1) GROUP BY doc_id),
tok AS (SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest(tokens) AS tok FROM w) GROUP BY lang, tok),
ref AS (SELECT lang, tok, n / total AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rk FROM tok) WHERE rk <= 32),
oth AS (SELECT lang, greatest(1 - sum(q), 0) AS q FROM ref GROUP BY lang),
med AS (SELECT lang, i, quantile_disc(cs[i] / length(text), 0.5) AS q FROM c, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE text <> '' GROUP BY lang, i),
cd AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM (SELECT doc_id, cs[i] / greatest(length(text), 1) AS p, q FROM c JOIN med USING (lang)) GROUP BY doc_id),
n AS (SELECT doc_id, lang, len(tokens) AS n FROM w),
cnt AS (SELECT doc_id, lang, tok, count(*) AS k FROM (SELECT doc_id, lang, unnest(tokens) AS tok FROM w) SEMI JOIN ref USING (lang, tok) GROUP BY ALL),
bin AS (SELECT n.doc_id, coalesce(k, 0) / n.n AS p, q FROM n JOIN ref USING (lang) LEFT JOIN cnt ON cnt.doc_id = n.doc_id AND cnt.tok = ref.tok WHERE n.n > 0
  UNION ALL SELECT n.doc_id, (n.n - coalesce((SELECT sum(k) FROM cnt WHERE cnt.doc_id = n.doc_id), 0)) / n.n, q FROM n JOIN oth USING (lang) WHERE n.n > 0),
wd AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM bin GROUP BY doc_id),
f AS (SELECT c.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars, cs[2] AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  oth.q IS NOT NULL AND len(ws) >= 50 AND (cd.d > 0.185 OR (CASE WHEN len(tokens) = 0 THEN 1 ELSE wd.d END) > 0.30 + 0.9 / sqrt(greatest(len(ws), 1))) AS diverges
  FROM c LEFT JOIN rep USING (doc_id) LEFT JOIN oth USING (lang) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR diverges) AS kept FROM f
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, site, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM t),
k AS (SELECT doc_id, site, pos, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line, min(struct_pack(id := doc_id, pos := pos)) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (SELECT k.doc_id, k.pos, k.raw, b.line IS NOT NULL AND NOT (b.first.id = k.doc_id AND b.first.pos = k.pos) AS gone FROM k LEFT JOIN b ON b.line = k.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)
"""


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ids=False, digests=True)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, matrix = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, languages, matrix)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return shards.read_shards(shards.write_shards(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json")))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLES["op7_decontamination"] = r"""
WITH w AS (SELECT 0 AS item, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
l AS (SELECT item, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM w),
k AS (SELECT id AS item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM l WHERE item = 1 AND len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM k),
p AS (SELECT id AS doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM l, (SELECT DISTINCT n FROM win) WHERE item = 0 AND len(ws) >= n),
hit AS (SELECT doc_id, k, p.n, item_id FROM p JOIN win ON win.n = p.n AND win.win = array_to_string(ws[k:k + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM l LEFT JOIN c ON c.doc_id = l.id LEFT JOIN i ON i.doc_id = l.id WHERE item = 0
"""


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(licenses.document_paths(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").withColumn("depth", F.col("depth").cast("long"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


ORACLES["op6_license_scan"] = rf"""
WITH tpl(tid, license, kind, txt) AS (VALUES {_values([(i, *t) for i, t in enumerate(licenses.TEMPLATES)])}),
tt AS (SELECT tid, license, kind, unnest(regexp_split_to_array(lower(txt), '[^\p{{L}}\p{{Nd}}.-]+')) AS term FROM tpl),
tc AS (SELECT tid, license, kind, trim(term, '.-') AS term, count(*) AS tf FROM tt WHERE trim(term, '.-') <> '' GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {len(licenses.TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term),
tw AS (SELECT tid, license, kind, term, tf * idf AS w FROM tc JOIN idf USING (term)),
tv AS (SELECT tid, license, kind, term, w / sqrt(sum(w * w) OVER (PARTITION BY tid)) AS weight FROM tw),
d AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 1000 AS VARCHAR), doc_id || '.txt') AS path, coalesce(regexp_matches(text, '{licenses.CUES}'), false) AS cue FROM documents),
s0 AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n+|([.!?;])\s+', '\1' || chr(1), 'g'), chr(1))) AS txt, generate_subscripts(string_split(regexp_replace(text, '\n+|([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS unit FROM d WHERE cue),
u AS (SELECT doc_id, unit, 'header' AS kind, txt FROM s0 WHERE regexp_matches(txt, '{licenses.CUES}') UNION ALL SELECT doc_id, -1, 'file', text FROM d WHERE cue),
ut AS (SELECT doc_id, unit, kind, trim(unnest(regexp_split_to_array(lower(txt), '[^\p{{L}}\p{{Nd}}.-]+')), '.-') AS term FROM u),
uc AS (SELECT doc_id, unit, kind, term, count(*) AS tf FROM ut WHERE term <> '' GROUP BY ALL),
uw AS (SELECT doc_id, unit, kind, term, tf, tf * coalesce(idf, ln(1.0 + {len(licenses.TEMPLATES)}) + 1) AS w FROM uc LEFT JOIN idf USING (term)),
un AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm, sum(tf) AS n_terms FROM uw GROUP BY ALL),
sc AS (SELECT uw.doc_id, uw.unit, tv.license, round(sum(uw.w * tv.weight) / any_value(un.norm), 6) AS cosine, any_value(un.n_terms) AS n_terms FROM uw JOIN tv ON tv.kind = uw.kind AND tv.term = uw.term JOIN un ON un.doc_id = uw.doc_id AND un.unit = uw.unit GROUP BY uw.doc_id, uw.unit, tv.tid, tv.license HAVING round(sum(uw.w * tv.weight) / any_value(un.norm), 6) >= 0.6),
bu AS (SELECT doc_id, unit, cosine, license, n_terms FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY cosine DESC, license) = 1),
ow AS (SELECT doc_id, first(license ORDER BY cosine DESC, license, unit) AS license, max(cosine) AS cosine, sum(n_terms) FILTER (unit >= 0) AS matched, bool_or(unit < 0) AS whole FROM bu GROUP BY doc_id),
sz AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}.-]+')), '.-') AS term FROM d WHERE cue) WHERE term <> '' GROUP BY doc_id),
a AS (SELECT d.doc_id, d.path, string_split(d.path, '/') AS p, ow.license, ow.cosine, ow.license IS NOT NULL AND (ow.whole OR coalesce(ow.matched, 0) >= 0.3 * n) AS license_file FROM d LEFT JOIN ow USING (doc_id) LEFT JOIN sz USING (doc_id)),
g AS (SELECT array_to_string(p[1:len(p) - 1], '/') AS dir, first(license ORDER BY cosine DESC, license, path) AS license, max(cosine) AS cosine FROM a WHERE license_file GROUP BY 1),
x AS (SELECT a.doc_id, k AS depth, g.license, g.cosine FROM a, (SELECT unnest(range(0, 4)) AS k), g WHERE a.license IS NULL AND g.dir = array_to_string(a.p[1:len(a.p) - 1 - k], '/')),
b AS (SELECT doc_id, min(depth) AS depth, arg_min(license, depth) AS license, arg_min(cosine, depth) AS cosine FROM x GROUP BY doc_id)
SELECT a.doc_id, a.path, coalesce(a.license, b.license) AS license, coalesce(a.cosine, b.cosine) AS cosine,
  CASE WHEN a.license IS NOT NULL THEN 'own' WHEN b.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, a.license_file, CASE WHEN a.license IS NULL THEN b.depth END AS depth
FROM a LEFT JOIN b USING (doc_id)
"""


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id
"""


@query
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op11_source_mix"] = rf"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, CAST(sum(source_size) OVER () AS HUGEINT) AS words FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM w),
p AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_sum FROM r),
l AS (SELECT 3 * words - 4 * full_size AS rest, w_sum FROM p WHERE (3 * words - 4 * full_size) * weight <= 4 * source_size * w_sum ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, n_docs, CASE WHEN source_size = 0 THEN 0.0 WHEN l.rest * weight > 4 * source_size * l.w_sum THEN 2.0 * source_size ELSE CAST(weight * l.rest AS DOUBLE) / CAST(2 * l.w_sum AS DOUBLE) END AS target FROM p LEFT JOIN l ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS base, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget FROM t),
c AS (SELECT d.*, b.* EXCLUDE (source), sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, min(h) FILTER (upto > budget) AS edge FROM c GROUP BY source),
n AS (SELECT c.source, shift, count(*) FILTER (c.h >> shift = e.edge >> shift) AS n FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source, (SELECT unnest([60, 50, 40, 30, 20, 10, 0]) AS shift) GROUP BY ALL),
f AS (SELECT source, max(shift) FILTER (n <= {mixing.REFINE} OR shift = 0) AS shift FROM n GROUP BY source),
g AS (SELECT c.*, f.shift, e.edge, coalesce(c.h >> f.shift < e.edge >> f.shift, false) AS below, coalesce(c.h >> f.shift = e.edge >> f.shift, false) AS inside FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source JOIN f ON c.source IS NOT DISTINCT FROM f.source),
u AS (SELECT source, h, sum(size) AS size FROM g WHERE inside AND size > 0 AND budget > 0 GROUP BY source, h),
v AS (SELECT source, list(struct_pack(h := h, size := size) ORDER BY h) AS us FROM u GROUP BY source),
y AS (SELECT source, budget - coalesce(sum(size) FILTER (below), 0) AS rest FROM g GROUP BY source, budget),
z AS (SELECT v.source, us, list_reduce(us, lambda a, x: CASE WHEN x.size <= a.rest THEN struct_pack(rest := a.rest - x.size, hs := list_append(a.hs, x.h)) ELSE a END, struct_pack(rest := y.rest, hs := CAST([] AS BIGINT[]))) AS got FROM v JOIN y ON v.source IS NOT DISTINCT FROM y.source),
o AS (SELECT source, got.hs AS hs, list_min(list_transform(list_filter(us, lambda x: NOT list_contains(got.hs, x.h) AND x.size < 2 * got.rest), lambda x: struct_pack(off := abs(x.size - got.rest), h := x.h))).h AS more FROM z)
SELECT doc_id, size, source_size, target, base + CAST(base < 2 AND (below OR inside AND coalesce(list_contains(o.hs, h) OR o.more IS NOT DISTINCT FROM h, false)) AS INT) AS copies,
  size * (base + CAST(base < 2 AND (below OR inside AND coalesce(list_contains(o.hs, h) OR o.more IS NOT DISTINCT FROM h, false)) AS INT)) AS taken
FROM g LEFT JOIN o ON g.source IS NOT DISTINCT FROM o.source
"""


@query
def op12_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.clicks_to_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


ORACLES["op12_asof_orders"] = """
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT click_id AS id FROM clicks UNION SELECT sale_id FROM sales),
h AS (SELECT id, xor(list_reduce(list_transform(range(1, length(CAST(id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(id AS VARCHAR)[i]) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM ids, tab WHERE id IS NOT NULL),
c0 AS (SELECT click_id, client_id, epoch_us(ts) AS us FROM clicks QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts NULLS LAST, client_id NULLS LAST) = 1),
c AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - us % 21600000000 ELSE us END AS ts_us FROM c0 LEFT JOIN h ON h.id = click_id),
s AS (SELECT sale_id, client_id, h, CASE WHEN h % 2 = 1 THEN epoch_us(sold_at) - epoch_us(sold_at) % 21600000000 ELSE epoch_us(sold_at) END AS t, CASE WHEN abs(total) < 9e16 THEN CAST(floor(100 * total + 0.5) AS BIGINT) END AS total_cents FROM sales LEFT JOIN h ON h.id = sale_id),
o AS (SELECT client_id, t, sale_id, total_cents FROM s UNION ALL SELECT client_id, t, -1 - sale_id, total_cents FROM s WHERE h % 3 <> 0),
b AS (SELECT client_id, t, count(*) AS n, first(struct_pack(c := total_cents, s := sale_id) ORDER BY total_cents DESC NULLS LAST, sale_id DESC NULLS LAST) AS top FROM o WHERE client_id IS NOT NULL AND t IS NOT NULL GROUP BY client_id, t),
m AS (SELECT c.*, b.t, b.n, b.top FROM c ASOF LEFT JOIN b ON c.client_id = b.client_id AND c.ts_us >= b.t)
SELECT click_id, client_id, ts_us, CASE WHEN ts_us - t <= 2592000000000 THEN top.s END AS sale_id, CASE WHEN ts_us - t <= 2592000000000 THEN ts_us - t END AS lag_us, CASE WHEN ts_us - t <= 2592000000000 THEN top.c END AS total_cents, CASE WHEN ts_us - t <= 2592000000000 THEN n ELSE 0 END AS n_tied FROM m
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5) // (n.n + 5 * v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.c + 5) // (v.n + 5 * v.v) AS q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm) QUALIFY part = 'pair' OR rank <= 50
"""
