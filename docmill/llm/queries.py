"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm.common import table
from docmill.llm.op10_embedding_dedup import embedding_dedup
from docmill.llm.op11_pii import personal_data, span_digest
from docmill.llm.op12_prefix_trie import prefix_trie
from docmill.llm.op13_collocations import collocations
from docmill.llm.op1_toxicity import toxicity
from docmill.llm.op2_mix import mix, position
from docmill.llm.op3_pieces import encode
from docmill.llm.op4_licenses import scan_licenses
from docmill.llm.op5_jaccard_join import jaccard_components
from docmill.llm.op6_exact_dedup import exact_dedup
from docmill.llm.op7_warc import warc_round_trip
from docmill.llm.op8_line_dedup import line_dedup
from docmill.llm.op9_suffix_dedup import suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_mix", f"""
WITH sized AS (
 SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce('=' || cast(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS kind FROM sizes),
weighted AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM ranked),
leveled AS (SELECT *,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
   / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level FROM weighted
  WINDOW b AS (ORDER BY cap / weight::DOUBLE, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT *, first_value(CASE WHEN level <= cap / weight::DOUBLE THEN level END IGNORE NULLS) OVER (
  ORDER BY cap / weight::DOUBLE, source IS NULL, encode(source)
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS low FROM leveled),
plan AS (SELECT source, source_size, kind,
  CASE WHEN low IS NULL OR cap / weight::DOUBLE <= low THEN cap::DOUBLE ELSE weight * low END AS target FROM chosen),
queued AS (SELECT doc_id, size, source_size, kind, target, floor(target + 0.5)::BIGINT AS whole,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, CASE WHEN source_size > 0 THEN (whole // source_size) * size
  + greatest(0, least(whole % source_size - start, size)) ELSE 0 END::BIGINT AS taken FROM queued),
shared AS (SELECT *, CASE WHEN taken > 0 THEN start / whole::DOUBLE END AS share FROM taken)
SELECT doc_id, size, source_size, target, taken,
 {position("kind", "share")} AS position FROM shared
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op3_pieces")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


@query("op4_licenses")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("twin")


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
 min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM r
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


@query("op10_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
 AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(n, r) AS (SELECT vec_id, vec_id FROM embeddings UNION
 SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.n WHERE reach.r < links.b),
low AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON n = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) ON a = vec_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op13_collocations", f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
 FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 6) AS t(k))),
counts AS (SELECT lang, k, g, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING f >= 100),
kept AS (SELECT * FROM counts c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM counts d WHERE d.lang = c.lang
 AND d.k > c.k AND d.f >= c.f AND contains(' ' || d.g || ' ', ' ' || c.g || ' '))),
cuts AS (SELECT lang, g, f, cut, array_to_string(string_split(g, ' ')[1:cut], ' ') AS left_g,
 array_to_string(string_split(g, ' ')[cut + 1:], ' ') AS right_g
 FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT lang, g, c.f AS a, n, cut, x.f AS l, y.f AS r,
 ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
 FROM cuts c JOIN totals USING (lang) JOIN (SELECT lang, g AS left_g, f FROM counts) x USING (lang, left_g)
 JOIN (SELECT lang, g AS right_g, f FROM counts) y USING (lang, right_g)),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank,
 g AS phrase, a, l, r, n, score FROM low QUALIFY rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


# the standard checksum, bit by bit: each byte, then eight shifts (-1)
_CRC32 = """list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length({0}) + 1), lambda i:
 [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
 WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""


@query("op12_prefix_trie", f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT conv_id, pos, length(text) AS chars, dense_rank() OVER (ORDER BY role, text) AS name FROM turns),
lists AS (SELECT conv_id, list({{'name': name, 'chars': chars}} ORDER BY pos) AS own,
 xor(4294967295, {_CRC32.format("CAST(conv_id AS VARCHAR)")}) % 6 AS h FROM named GROUP BY conv_id),
built AS (SELECT a.conv_id, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS path
 FROM lists a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 100),
steps AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM built),
members AS (SELECT conv_id, depth, len(path) = depth AS ends, path[1:depth].name AS key, path[depth].chars AS chars
 FROM (SELECT conv_id, depth, path FROM steps)),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(chars), 0) AS chars,
 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
 FROM members GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
facts AS (SELECT nodes.*, coalesce(c.n, 0) AS n_children FROM nodes LEFT JOIN children c USING (depth, key)),
above AS (SELECT key[1:d] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
 FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM facts) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
 saved::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN above USING (key) LEFT JOIN facts p ON p.depth = f.depth - 1 AND p.key = f.key[1:f.depth - 1]
""".replace("path[1:depth].name", "list_transform(path[1:depth], lambda x: x.name)"))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op11_pii")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(personal_data(table(spark, sf_dir, "documents")))
