"""The registered queries of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import bpe, divergence, exact_dedup, fingerprint, langid, line_dedup, lm, mixing, passages, resampling, sharding, simhash, warc
from sextant.llm.common import table

N_SHARDS = 24


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; the same path must exist on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("in_history")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.archive_report(headers, payloads)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_sharding": op2_sharding,
        "op3_language_id": op3_language_id,
        "op4_bpe": op4_bpe,
        "op5_line_dedup": op5_line_dedup,
        "op6_warc": op6_warc,
        "op7_mixing": op7_mixing,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_simhash": op9_simhash,
        "op10_fingerprints": op10_fingerprints,
        "op11_divergence": op11_divergence,
        "op12_passages": op12_passages,
        "op13_resampling": op13_resampling,
    }


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP6_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM m
"""


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)),
k AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(any_value(s.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) AS s USING (lang, source)
  GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + {divergence.PRIOR})) // (g.n + {divergence.PRIOR} * v) AS p,
         1 + ({divergence.SCALE}::HUGEINT * (total + {divergence.PRIOR})) // (lang_n + {divergence.PRIOR} * v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


def _op7_sql() -> str:
    sql = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
r AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 12))::BIGINT::DOUBLE
             + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, count(*) AS n_rows,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM r GROUP BY source),
l AS (
  SELECT *, source_size * 2 AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, weight * level >= cap AS capped,
         first_value(CASE WHEN weight * level < cap THEN level END IGNORE NULLS)
           OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM l),
t AS (
  SELECT *, CASE WHEN capped THEN cap ELSE weight * final END AS target FROM f),
p AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS certain,
         target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * source_size AS need,
         ceil(n_rows / {mixing.BIN_ROWS}::DOUBLE) AS bins
  FROM t),
z AS (SELECT source, size, count(*) AS c FROM r WHERE size > 0 GROUP BY source, size),
q AS (
  SELECT source, size,
         coalesce(sum(size::HUGEINT * c) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS above,
         (sum(size::HUGEINT * size * c) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS below
  FROM z),
o AS (
  SELECT q.source, q.size, (need - above) / below AS scale FROM q JOIN p ON q.source IS NOT DISTINCT FROM p.source
  WHERE (need - above) / below * q.size <= 1),
h AS (SELECT source, arg_max(scale, size) AS scale FROM o GROUP BY source),
k AS (
  SELECT r.doc_id, r.source, r.size, r.u, p.* EXCLUDE (source), coalesce(h.scale, 0) AS scale, coalesce(h.scale, 0) * r.size AS prob
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN h ON r.source IS NOT DISTINCT FROM h.source),
k1 AS (SELECT *, CASE WHEN prob > 0 AND prob < 1 THEN (u / (1 - u)) / (prob / (1 - prob)) END AS ratio FROM k),
k2 AS (
  SELECT *, CASE WHEN size = 0 THEN 1 WHEN scale <= 0 OR prob >= 1 THEN 0 ELSE ratio / (1 + ratio) END AS rank FROM k1),
w0 AS (SELECT *, least(floor(rank * bins), bins - 1) AS bin, false AS chosen, need AS gap FROM k2)"""
    for i in range(mixing.FILLS):
        sql += f""",
a{i} AS (SELECT *, NOT chosen AND size > 0 AND size <= gap AS fits FROM w{i}),
c{i} AS (SELECT source, bin, any_value(gap) AS gap, sum(size)::DOUBLE AS words FROM a{i} WHERE fits GROUP BY source, bin),
e{i} AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bin) AS up_to FROM c{i}),
g{i} AS (
  SELECT source, min(bin) AS border, arg_min(gap - (up_to - words), bin) AS room FROM e{i} WHERE up_to > gap GROUP BY source),
b{i} AS (
  SELECT a{i}.*, g{i}.border, g{i}.room, fits AND coalesce(bin = g{i}.border, false) AS here
  FROM a{i} LEFT JOIN g{i} ON a{i}.source IS NOT DISTINCT FROM g{i}.source),
y{i} AS (
  SELECT *, CASE WHEN here
      THEN sum(size) OVER (PARTITION BY source, here ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= room
      ELSE fits AND (border IS NULL OR bin < border) END AS now
  FROM b{i}),
w{i + 1} AS (
  SELECT * EXCLUDE (fits, here, border, room, now, gap, chosen), chosen OR now AS chosen,
         gap - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM y{i})"""
    return sql + f"""
SELECT doc_id, size, source_size::BIGINT AS source_size, target, ((certain + chosen::INT) * size)::BIGINT AS taken FROM w{mixing.FILLS}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op7_mixing": _op7_sql(), "op11_divergence": OP11_SQL}
