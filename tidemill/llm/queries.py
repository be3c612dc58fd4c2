"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.llm.clustering import centroid_clustering
from tidemill.llm.common import shared_dir, table
from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.exact_dedup import exact_dedup
from tidemill.llm.html_text import html_text
from tidemill.llm.language_id import language_id
from tidemill.llm.line_dedup import line_dedup
from tidemill.llm.merkle import FIELDS, merkle_manifest
from tidemill.llm.ngram_join import ngram_jaccard_join
from tidemill.llm.packing import best_fit_packing
from tidemill.llm.quality_rules import BOILERPLATE, MOST_LOST, quality_rules
from tidemill.llm.token_counts import token_counts
from tidemill.llm.url_filter import RULES, url_filter
from tidemill.llm.warc import warc_derivatives


def op1_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100, count_links=False).select("doc_id", "n_shingles", "component_id")


def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tidemill-rollup-{uuid.uuid4().hex}")


def op4_html_text(spark, sf_dir):
    return html_text(table(spark, sf_dir, "pages"))


def op5_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark, sf_dir):
    out = warc_derivatives(table(spark, sf_dir, "pages"))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "content_length", F.decode("block", "UTF-8").alias("block_text"))


def op8_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in RULES])))
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op10_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark, sf_dir):
    return centroid_clustering(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard_join, op3_token_counts, op4_html_text, op5_decontamination, op6_best_fit_packing, op7_warc_derivatives, op8_language_id, op9_url_filter, op10_quality_rules, op11_exact_dedup, op12_merkle_manifest, op13_centroid_clustering)}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = rf"list_filter(string_split_regex({LOWER_SQL}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ALNUM_SQL = rf"list_filter(string_split_regex({LOWER_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1_SQL = r"""
WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
a AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM p),
l AS (SELECT doc_id, pos, raw, trim(regexp_replace(raw, '[\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM a),
t AS (SELECT line, length(line) AS m FROM l WHERE length(line) >= 20 GROUP BY line),
c AS (SELECT x.line AS a, y.line AS b, x.m AS m FROM t x JOIN t y ON y.m = x.m AND left(x.line, x.m // 2) = left(y.line, x.m // 2) AND x.line <> y.line
  UNION SELECT x.line, y.line, x.m FROM t x JOIN t y ON y.m = x.m AND right(x.line, x.m - x.m // 2) = right(y.line, x.m - x.m // 2) AND x.line <> y.line
  UNION SELECT x.line, y.line, x.m FROM t x JOIN t y ON y.m = x.m - 1 AND left(x.line, x.m // 2) = left(y.line, x.m // 2)
  UNION SELECT x.line, y.line, x.m FROM t x JOIN t y ON y.m = x.m - 1 AND right(x.line, x.m - x.m // 2) = right(y.line, x.m - x.m // 2)),
e AS (SELECT a, b FROM c WHERE len(list_filter(range(m), lambda q: left(a, q) = left(b, q) AND right(a, m - 1 - q) = right(b, m - 1 - q))) > 0),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, a AS b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
k AS (SELECT a AS line, min(b) AS class FROM r GROUP BY 1),
o AS (SELECT l.doc_id, l.pos, coalesce(k.class, l.line) AS class FROM l LEFT JOIN k USING (line) WHERE length(l.line) >= 20),
d AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY class ORDER BY doc_id, pos) AS n FROM o) WHERE n > 1),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '') AS text
  FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.pos = l.pos GROUP BY 1)
SELECT x.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(length(s.text), 0)::BIGINT AS n_chars, md5(s.text) AS text_md5
FROM documents x LEFT JOIN s ON s.doc_id = x.doc_id
"""

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN m ON m.a = n.doc_id
"""

OP3_SQL = rf"""
WITH d AS (SELECT *, text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY source, lang, text) AS copy FROM documents),
c AS (SELECT source, lang, 'words-1' AS tokenizer, len({WORDS_SQL}) AS n, coalesce(length(text), 0) AS k FROM d WHERE NOT copy
  UNION ALL SELECT source, lang, 'letters-1', length(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')), coalesce(length(text), 0) FROM d WHERE NOT copy)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens, sum(k)::BIGINT AS n_chars FROM c GROUP BY 1, 2, 3
"""

OP5_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item_id, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k+size-1], ' '))) AS win FROM v),
d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
z AS (SELECT DISTINCT size FROM x),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, z WHERE len(w) >= size),
h AS (SELECT p.doc_id, p.k, p.size, x.item_id FROM p JOIN x ON x.size = p.size AND x.win = array_to_string(p.w[p.k:p.k+p.size-1], ' ')),
q AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9_SQL = f"""
WITH r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT h.page_id, max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) AS b FROM h JOIN r
  ON (h.host = split_part(r.rule, '/', 1) OR ends_with(h.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(h.path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1)) GROUP BY 1)
SELECT h.page_id, h.host, h.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""

QUOTE = "'"
_FAILS = rf"""(10 * length(regexp_replace(x, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) > 3 * length(x)
  OR (length(regexp_replace(x, '[^|>»›•·]', '', 'g')) >= 3 AND 3 * length(regexp_replace(x, '[^|>»›•·]', '', 'g')) >= len(string_split_regex(trim(x, ' '), '[\x20\x09-\x0D]+')) - length(regexp_replace(x, '[^|>»›•·]', '', 'g')))
  OR {" OR ".join(f"contains(lower(x), '{p.replace(QUOTE, QUOTE * 2)}')" for p in BOILERPLATE)})"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY 1),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS line_chars, list_filter(lines, lambda x: {_FAILS}) AS gone FROM d LEFT JOIN h USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(list_sum(list_transform(gone, lambda x: length(x))), 0) * 100 <= line_chars * {MOST_LOST} AS kept, len(gone)::BIGINT AS n_removed_lines FROM b
"""

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER_SQL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def _merkle_sql(levels: int = 14, tops: int = 5) -> str:
    """The manifest's SQL with so many levels written out: sources of up to 3^levels rows, 3^tops sources."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = "sha256(concat(" + ", ".join(map(value, FIELDS)) + "))"
    # CRC-32 bit by bit over the digits: its lowest bit tells which rows are tampered with.
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    for _ in range(7):
        step = f"list_transform([{step}], lambda c: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_transform([xor(a, x)], lambda c: {step})[1]), 4294967295)"
    ctes = [f"d AS MATERIALIZED (SELECT doc_id, source AS g, {leaf} AS h, CASE WHEN {crc} % 2 = 0 THEN {leaf.replace('text', "replace(text, chr(10), '')")} ELSE {leaf} END AS f FROM documents)"]

    def tree(t: str, top: str, many: int) -> None:
        ctes.append(f"{t}0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY {top}) - 1 AS p, count(*) OVER (PARTITION BY g) AS n, h FROM {'d' if t == 'a' else 's'})")
        for k in range(many):
            kids = f"SELECT g, p // 3 AS p, n, list(h ORDER BY p) AS run FROM {t}{k} GROUP BY 1, 2, 3"
            ctes.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, p, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, CASE WHEN n > 1 THEN run END AS run FROM ({kids}))")

    tree("a", "doc_id NULLS FIRST, h", levels)
    ctes.append(f"s AS MATERIALIZED (SELECT 0 AS g, g AS source, h FROM a{levels})")
    tree("b", "source NULLS FIRST", tops)
    ctes.append("o AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS q FROM s)")
    ctes.append("w0 AS MATERIALIZED (SELECT d.doc_id, d.g, d.h AS leaf, d.f, o.q, row_number() OVER (PARTITION BY d.g ORDER BY d.doc_id NULLS FIRST, d.h) - 1 AS p, '' AS proof FROM d JOIN o ON d.g IS NOT DISTINCT FROM o.source)")
    for k, t in enumerate([*[f"a{i + 1}" for i in range(levels)], *[f"b{i + 1}" for i in range(tops)]]):
        sides = "array_to_string(list_filter(run, lambda x, i: i < w.p % 3 + 1), '') AS l, array_to_string(list_filter(run, lambda x, i: i > w.p % 3 + 1), '') AS r"
        step = f"SELECT w.*, x.run, {sides} FROM w{k} w JOIN {t} x ON {'x.g IS NOT DISTINCT FROM w.g' if t[0] == 'a' else 'x.g = 0'} AND x.p = w.p // 3"
        place = "q" if k == levels - 1 else "p // 3"  # a source's place among the sources
        ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT doc_id, g, leaf, q, {place} AS p, CASE WHEN run IS NULL THEN proof ELSE proof || l || r END AS proof, CASE WHEN run IS NULL THEN f ELSE sha256(l || f || r) END AS f FROM ({step}))")
    last = levels + tops
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM w{last} w JOIN s ON s.source IS NOT DISTINCT FROM w.g CROSS JOIN b{tops} r"


def _cluster_sql(rounds: int = 10) -> str:
    """The clustering's SQL with its rounds written out."""
    ctes = ["e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"]
    ctes.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1 AS k, v FROM e ORDER BY k LIMIT 8)")
    nearest = "SELECT vec_id, v, min({d: list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k: k}) AS b FROM (SELECT e.vec_id, e.v, c.v AS w, c.k FROM e CROSS JOIN c%d c) GROUP BY 1, 2"
    for i in range(rounds):
        sums = f"SELECT b.k AS k, i, floor_div(sum(x), count(*)) AS x FROM (SELECT b, unnest(v) AS x, unnest(range(64)) AS i FROM ({nearest % i})) GROUP BY 1, 2"
        sums = sums.replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)")
        ctes.append(f"n{i} AS MATERIALIZED (SELECT k, list(x::BIGINT ORDER BY i) AS v FROM ({sums}) GROUP BY 1)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n USING (k))")
    ctes.append(f"a AS MATERIALIZED ({nearest % rounds})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, b.k::INTEGER AS cluster, b.d::BIGINT AS distance, (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.k = a.b.k"


ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_token_counts": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_centroid_clustering": _cluster_sql(),
}
