"""DuckDB SQL for the registered queries, put together from shared table expressions."""

from __future__ import annotations

import re

from sextant.config import DEFAULT
from sextant.functions import rules
from sextant.functions.text import CONTEXT_GROUPS, CONTEXT_PATTERN, CONTEXT_SKIP, SYMBOL_PATTERNS
from sextant.plans import corpus, queries

NL = "chr(10)"


def _list(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def _re2(pattern: str) -> str:
    return pattern.replace(r"(\w+)", r"([\p{L}\p{N}_]+)").replace("'", "''")


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\s\p{{Z}}\x0b\x85]+'), lambda w: w <> '')"


def camel(word: str) -> str:
    """Cuts are marked by chr(1): after a lower-case letter, and before a capital and a lower-case one."""
    marked = rf"regexp_replace({word}, '(\p{{Ll}})(\p{{Lu}})', '\1' || chr(1) || '\2', 'g')"
    marked = rf"regexp_replace({marked}, '([^\x01])(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g')"
    return f"list_transform(list_filter(string_split({marked}, chr(1)), lambda p: strlen(p) > 1), lambda p: lower(p))"


def word_tokens(word: str) -> str:
    parts = rf"list_transform(regexp_split_to_array({word}, '[-_.]'), lambda p: lower(regexp_replace(p, '[^\p{{L}}\p{{N}}]', '', 'g')))"
    whole = rf"lower(regexp_replace({word}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"
    humps = f"CASE WHEN {word} <> lower({word}) THEN {camel(word)} ELSE [] END"
    return f"list_distinct(list_filter(list_concat({humps}, {parts}, [{whole}]), lambda t: strlen(t) > 1))"


def tokens(text: str) -> str:
    return f"list_distinct(flatten(list_transform({words(text)}, lambda x: {word_tokens('x')})))"


def symbols(text: str) -> str:
    found = ", ".join(f"regexp_extract_all({text}, '{_re2(p)}', {g})" for p, n in SYMBOL_PATTERNS for g in range(1, n + 1))
    return f"list_distinct(list_transform(list_filter(flatten([{found}]), lambda s: s <> ''), lambda s: lower(s)))"


def identifier(q: str) -> str:
    return rf"(trim({q}) <> '' AND NOT contains(trim({q}), ' ') AND (regexp_matches({q}, '[-_.]') OR (regexp_matches({q}, '\p{{Lu}}') AND regexp_matches({q}, '\p{{Ll}}'))))"


def prefix(text: str, n: int) -> str:
    """Longest prefix of at most n bytes: characters are cut as long as bytes are too many."""
    return f"CASE WHEN strlen({text}) <= {n} THEN {text} ELSE left({text}, list_max(list_filter(range({n // 4}, {n} + 1), lambda k: strlen(left({text}, k::INT)) <= {n}))::INT) END"


def _split(lines: str) -> str:
    return f"string_split({lines}, {NL})"


def _size(items: str) -> str:
    return f"coalesce(len({items}), 0)"


_DIR = f"NOT list_has_any({{parts}}, [{_list(rules.IGNORED_DIRS)}]) AND len(list_filter({{parts}}, lambda p: regexp_matches(p, '({'|'.join(map(re.escape, rules.IGNORED_DIR_SUFFIXES))})$|^({'|'.join(map(re.escape, rules.IGNORED_DIR_PREFIXES))})'))) = 0"
_EXT = f"regexp_extract(lower({{path}}), '(\\.[^.]*)$', 1) IN ({_list(rules.CODE_EXTENSIONS)})"


def _kept(path: str, with_name: bool = True) -> str:
    parts = f"string_split({path}, '/')" + ("" if with_name else "[:-2]")
    return f"({_DIR.format(parts=parts)} AND {_EXT.format(path=path)})"


FILES = rf"""
files AS (
  SELECT doc_id, CASE WHEN source = 'src7' THEN 'node_modules/' ELSE 'src/' END || source || '/doc_' || doc_id
         || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.rs' ELSE '.log' END AS path,
         'fn ' || regexp_extract(text, '^[A-Za-z]*') || {NL} || text AS content,
         {corpus.FIRST_MTIME} + doc_id * 60 AS mtime FROM documents),
scanned AS (SELECT * FROM files WHERE {_kept('path')})"""


def _chunks(source: str) -> str:
    return rf"""
lines AS (SELECT path, mtime, {_split('content')} AS ls FROM {source}),
win AS (
  SELECT path, mtime, ls, unnest(range(0, CASE WHEN len(ls) <= 60 THEN 1 ELSE (ceil((len(ls) - 60) / 45.0) * 45 + 1)::INT END, 45)) AS i
  FROM lines),
body AS (
  SELECT path, mtime, i, len(ls) AS n, array_to_string(ls[i + 1:i + 60], {NL}) AS content, least(i + 60, len(ls)) AS line_end FROM win),
chunks AS (
  SELECT path || '#' || chunk_index AS chunk_id, path AS file_path, * FROM (
    SELECT path, mtime, content, i + 1 AS line_start, line_end, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS chunk_index
    FROM body WHERE n <= 60 OR regexp_matches(content, '\S')))"""


def _postings(source: str, key: str, text: str, name: str = "postings") -> str:
    return f"""
{name} AS (
  SELECT token, {key}, count(*) AS tf FROM (
    SELECT {key}, unnest({word_tokens('word')}) AS token FROM (SELECT {key}, unnest({words(text)}) AS word FROM {source}))
  GROUP BY token, {key})"""


CHUNKS = FILES + "," + _chunks("scanned")
INDEX = CHUNKS + "," + _postings("chunks", "chunk_id", "content") + f""",
doc_freq AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
stats AS (SELECT count(*) AS n FROM chunks),
chunk_meta AS (
  SELECT chunk_id, file_path, chunk_index, content, line_start, {tokens('file_path')} AS file_name_tokens, {symbols('content')} AS symbols
  FROM chunks)"""
QUERIES = f"""
queries AS (
  SELECT item_id::BIGINT AS query_id, text AS query FROM benchmark
  UNION ALL SELECT {corpus.BLANK_QUERY[0]}, ' ' || chr(9)),
terms AS (
  SELECT *, lower(query) AS lowered, {tokens('query')} AS query_tokens, {symbols('query')} AS query_symbols
  FROM queries WHERE regexp_matches(query, '[^\\s\\p{{Z}}]'))"""
IDF = "ln((n + 1) / (df + 1)::DOUBLE) + 1"
WEIGHT = "CASE WHEN strlen(token) > 4 THEN 1.5::DOUBLE ELSE 1 END * least(tf, 5) * idf"
SEARCH_BASE = INDEX + "," + QUERIES + f""",
wanted AS (
  SELECT query_id, token, max(scored) AS scored FROM (
    SELECT query_id, unnest(query_tokens) AS token, 1 AS scored FROM terms
    UNION ALL SELECT query_id, unnest(query_symbols), 0 FROM terms) GROUP BY ALL),
weighted AS (SELECT query_id, token, scored * ({IDF}) AS idf FROM wanted JOIN doc_freq USING (token), stats),
candidates AS (
  SELECT query_id, chunk_id, sum({WEIGHT}) AS token_score, sum(idf) AS idf_mass
  FROM weighted JOIN postings USING (token) GROUP BY ALL)"""


def _search(cap: int | None = DEFAULT.candidate_cap, boost: float = 1.2) -> str:
    limit = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(idf_mass, 9) DESC, chunk_id) <= {cap}" if cap else ""
    return SEARCH_BASE + f""",
pruned AS (SELECT * FROM candidates {limit}),
scored AS (
  SELECT query_id, chunk_id, file_path, chunk_index, content, lowered, query_tokens, file_name_tokens,
         len(query_tokens) > 1 AND contains(lower(content), lowered) AS phrase,
         {boost}::DOUBLE * (CASE WHEN len(query_tokens) > 1 AND contains(lower(content), lowered) THEN 30 ELSE 0 END
           + 10 * {_size('list_intersect(query_symbols, symbols)')}
           + 10 * {_size('list_intersect(query_tokens, file_name_tokens)')} + token_score) AS raw
  FROM pruned JOIN terms USING (query_id) JOIN chunk_meta USING (chunk_id)),
best AS (
  SELECT * FROM scored WHERE raw > 0
  QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY round(raw, 9) DESC, chunk_index) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, file_path, chunk_index) AS rank FROM best),
results AS (
  SELECT query_id, rank, chunk_id, file_path, raw, raw / max(raw) OVER (PARTITION BY query_id) AS score
  FROM ranked WHERE rank <= {DEFAULT.top_k})"""


RESULT_COLUMNS = "query_id, rank, chunk_id, round(raw, 6) AS raw, round(score, 6) AS score"
MATCHED = f"""
matches AS (
  SELECT r.*, t.query_tokens, c.content, c.line_start,
         list_sort(list_filter(t.query_tokens, lambda x: list_contains(c.own, x))) AS matched,
         list_sort(list_filter(t.query_tokens, lambda x: NOT list_contains(c.own, x))) AS missing
  FROM results r JOIN terms t USING (query_id) JOIN (SELECT *, {tokens('content')} AS own FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM results)) c USING (chunk_id))"""


def context(content: str, line_start: str) -> str:
    groups = ", ".join(f"nullif(regexp_extract(x, '{_re2(CONTEXT_PATTERN)}', {g}), '')" for g in range(1, CONTEXT_GROUPS + 1))
    up = f"list_reverse({_split(content)}[1:least(greatest({line_start} - 1, 0), len({_split(content)}) - 1) + 1])"
    return f"list_filter(list_transform({up}, lambda x: coalesce({groups})), lambda v: v IS NOT NULL AND v NOT IN ({_list(CONTEXT_SKIP)}))[1]"


def _ignore_sql() -> str:
    patterns = []
    for line in map(str.strip, queries.IGNORE_TEXT.split("\n")):
        if line and line[0] not in "#!":
            bare = line.rstrip("/")
            patterns.append(bare.rstrip("*/") if "*" in bare else bare)
    patterns = sorted({p for p in patterns if p} | set(rules.BUILT_IN_PATTERNS))
    plain, nested = [p for p in patterns if "/" not in p], [p for p in patterns if "/" in p]
    hits = " OR ".join(f"contains(path, '{p}')" for p in nested) or "false"
    return f"WITH {FILES} SELECT path FROM files WHERE {_kept('path', False)} AND NOT list_has_any(string_split(path, '/'), [{_list(plain)}]) AND NOT ({hits})"


COMMITS = f"""
turns AS (
  SELECT *, CASE WHEN turn % 2 = 1 THEN 'src/t' || turn || '.py' ELSE 'node_modules/t' || turn || '.js' END AS path,
         CASE WHEN role = 'assistant' THEN '+' ELSE '-' END AS sign FROM conversations),
blocks AS (
  SELECT *, 'diff --git a/' || path || ' b/' || path || {NL} || '--- a/' || path || {NL} || '+++ b/' || path || {NL}
         || sign || replace(text, {NL}, {NL} || sign) || {NL} AS block FROM turns),
cut AS (
  SELECT *, CASE WHEN strlen(block) > {DEFAULT.diff_block_bytes} THEN {prefix('block', DEFAULT.diff_block_bytes)} || {NL} ELSE block END AS kept
  FROM blocks),
whole AS (
  SELECT conv_id AS seq, md5(conv_id::VARCHAR) AS hash, trim(coalesce(max(text) FILTER (turn = 0), '')) AS message,
         coalesce(string_agg(kept, '' ORDER BY turn) FILTER (turn > 0 AND turn % 2 = 1), '') AS long_diff
  FROM cut GROUP BY conv_id),
recent AS (
  SELECT hash, seq, message, {prefix('long_diff', DEFAULT.diff_bytes)} AS diff_text FROM whole),
commits AS (SELECT * FROM recent WHERE message <> '' OR diff_text <> '')"""
ITEMS = COMMITS + f""",
items AS (
  SELECT hash AS id, CASE WHEN diff_text = '' THEN message ELSE message || {NL} || {prefix('diff_text', DEFAULT.commit_diff_bytes)} END AS text
  FROM (SELECT * FROM recent ORDER BY seq DESC LIMIT {DEFAULT.commit_limit}) WHERE message <> '' OR diff_text <> '')"""


def _items_search(key: str = "id") -> str:
    return _postings("items", key, "text", "item_postings") + f""",
item_df AS (SELECT token, count(*) AS df FROM item_postings GROUP BY token),
item_stats AS (SELECT count(*) AS n FROM items),
item_weights AS (
  SELECT query_id, token, {IDF} AS idf FROM (SELECT query_id, unnest(query_tokens) AS token FROM terms) JOIN item_df USING (token), item_stats),
item_sums AS (
  SELECT query_id, {key}, sum({WEIGHT}) AS token_score FROM item_weights JOIN item_postings USING (token) GROUP BY ALL),
item_raw AS (
  SELECT query_id, {key}, CASE WHEN len(query_tokens) > 1 AND contains(lower(text), lowered) THEN 30 ELSE 0 END + token_score AS raw
  FROM item_sums JOIN items USING ({key}) JOIN terms USING (query_id)),
item_scored AS (SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM item_raw WHERE raw > 0)"""


def _hashed(name: str, source: str, key: str, text: str, dim: int = 32) -> str:
    """Stand-in vectors: ``name`` with (key, vec); texts without a token have none."""
    return f"""
{name}_tokens AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h FROM (
    SELECT {key}, unnest({word_tokens('word')}) AS token FROM (SELECT {key}, unnest({words(text)}) AS word FROM {source}))),
{name}_entries AS (
  SELECT {key}, h % {dim} AS pos, sum(1 - 2 * ((h // {dim}) % 2))::DOUBLE AS x FROM {name}_tokens GROUP BY ALL),
{name} AS (
  SELECT {key}, list(coalesce(x, 0.0::DOUBLE) ORDER BY pos) AS vec FROM (
    SELECT k.{key}, r.pos, e.x FROM (SELECT DISTINCT {key} FROM {name}_entries) k CROSS JOIN (SELECT unnest(range({dim})) AS pos) r
    LEFT JOIN {name}_entries e ON e.{key} = k.{key} AND e.pos = r.pos) GROUP BY {key})"""


def _cosine(a: str, b: str) -> str:
    zero = f"list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0"
    return f"CASE WHEN {zero} THEN 0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"


_ASKED = f"asked AS (SELECT query_id, '{DEFAULT.query_prefix}' || query AS text FROM queries)"
COMMIT_VECTORS = (
    f"texts AS (SELECT id, '{DEFAULT.doc_prefix}' || {prefix('text', DEFAULT.embed_bytes)} AS text FROM items), {_ASKED},"
    + _hashed("item_vec", "texts", "id", "text") + "," + _hashed("query_vec", "asked", "query_id", "text") + f""",
commit_near AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT query_id, id, {_cosine('q.vec', 'i.vec')} AS score FROM query_vec q, item_vec i))"""
)


def _rerank(listed: str, weights: str, query_vec: str, id_vec: str, name: str = "reranked") -> str:
    """listed(query_id, id, rank), weights(query_id, w), vectors (query_id, vec) and (id, vec)."""
    return f"""
{name}_v AS (
  SELECT l.query_id, l.id, l.rank AS lexical_rank, w.w, CASE WHEN q.vec IS NULL OR i.vec IS NULL THEN NULL ELSE {_cosine('q.vec', 'i.vec')} END AS vector_score
  FROM {listed} l JOIN {weights} w USING (query_id) LEFT JOIN {query_vec} q ON q.query_id = l.query_id LEFT JOIN {id_vec} i ON i.id = l.id),
{name}_f AS (
  SELECT *, w / (60 + lexical_rank) + CASE WHEN vector_score IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + row_number() OVER (
    PARTITION BY query_id, vector_score IS NULL ORDER BY round(vector_score, 9) DESC, lexical_rank)) END AS fused FROM {name}_v),
{name} AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, lexical_rank) AS rank, vector_score,
         fused / max(fused) OVER (PARTITION BY query_id) AS score FROM {name}_f)"""


HYBRID = f"""
listed AS (SELECT query_id, chunk_id AS id, rank FROM results),
weights AS (SELECT query_id, CASE WHEN {identifier('query')} THEN 1.5::DOUBLE ELSE 1 END AS w FROM queries),
chunk_texts AS (
  SELECT chunk_id AS id, '{DEFAULT.doc_prefix}' || {prefix('content', DEFAULT.embed_bytes)} AS text FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM results)),
asked_code AS (SELECT query_id, '{DEFAULT.query_prefix}' || query AS text FROM queries),""" + (
    _hashed("code_vec", "chunk_texts", "id", "text") + "," + _hashed("code_query_vec", "asked_code", "query_id", "text")
    + "," + _rerank("listed", "weights", "code_query_vec", "code_vec")
)
VECTORS = f"""
vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
asked_vec AS (SELECT id AS query_id, vec, label FROM vecs WHERE id % {corpus.QUERY_STEP} = 0),
near AS (
  SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank
  FROM (SELECT q.query_id, i.id, {_cosine('q.vec', 'i.vec')} AS cosine FROM asked_vec q, vecs i))"""


def _evaluate(ranked: str, qrels: str, k: int = 10, recall_k: int = 100) -> str:
    return f"""
judged AS (SELECT r.query_id, r.rank, coalesce(q.rel, 0) AS rel FROM {ranked} r LEFT JOIN {qrels} q USING (query_id, id)),
own AS (
  SELECT query_id, sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (rel > 0) AS first_hit,
         count(*) FILTER (rel > 0 AND rank <= {recall_k}) AS hits_recall, count(*) FILTER (rel > 0 AND rank <= {k}) AS hits_k
  FROM judged GROUP BY query_id),
ideal AS (
  SELECT query_id, sum(CASE WHEN place <= {k} THEN rel / log2(place + 1) ELSE 0 END) AS idcg, count(*) FILTER (rel > 0) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS place FROM {qrels}) GROUP BY query_id),
evaluated AS (
  SELECT query_id, CASE WHEN coalesce(idcg, 0) > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg, coalesce(1.0::DOUBLE / first_hit, 0) AS mrr,
         CASE WHEN coalesce(relevant, 0) > 0 THEN coalesce(hits_recall, 0) / relevant::DOUBLE ELSE 0 END AS recall,
         coalesce(hits_k, 0) / {k}::DOUBLE AS precision
  FROM own FULL JOIN ideal USING (query_id))"""


QRELS = f"""
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
qrels AS (
  SELECT b.item_id AS query_id, f.path AS id, 1.0::DOUBLE + CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS rel
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN files f USING (doc_id) LEFT JOIN good g USING (doc_id)),
ranked_files AS (SELECT query_id, file_path AS id, rank FROM results)"""
MEASURES = "round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(precision, 6) AS precision"
KEYED = f"""
keyed AS (
  SELECT doc_id, source, sha256('{DEFAULT.model_tag}' || chr(0) || '{DEFAULT.dim}' || chr(0) || '{DEFAULT.doc_prefix}' || {prefix('text', DEFAULT.embed_bytes)}) AS key
  FROM documents)"""
BANDS = "CASE WHEN p >= 80 THEN 'strong' WHEN p >= 50 THEN 'good' WHEN p >= 25 THEN 'weak' ELSE 'marginal' END"


def preview(content: str, n_bytes: int | None, n_lines: int = 3) -> str:
    head = f"{_split(content)}[1:{n_lines}]"
    cut = f"list_transform({head}, lambda x: {prefix('x', n_bytes)})" if n_bytes else head
    return f"array_to_string({cut}, {NL})"


def _report(search: str, lines: int, n_bytes: int | None, columns: str | None) -> str:
    def code(name: str, rows: str) -> str:
        return f"""
{name} AS (
  SELECT '{name}' AS section, m.query_id, m.rank, m.chunk_id AS id, round(m.score * 100, 6) AS percent, {BANDS} AS band,
         round(len(list_filter(t.query_tokens, lambda x: list_contains(c.own, x))) / len(t.query_tokens)::DOUBLE * 100, 6) AS coverage,
         md5({preview('c.content', n_bytes, lines)}) AS preview_md5, {context('c.content', 'c.line_start')} AS context, c.line_start,
         len({_split('s.content')}) AS total_lines
  FROM (SELECT *, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9::DOUBLE) * 100 AS p FROM {rows}) m
  JOIN terms t USING (query_id) JOIN (SELECT *, {tokens('content')} AS own FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM results)) c USING (chunk_id)
  JOIN scanned s ON s.path = c.file_path)"""

    def commit(name: str, rows: str, percent: str) -> str:
        none = ", ".join(f"NULL AS {c}" for c in ("band", "coverage", "preview_md5", "context", "line_start", "total_lines"))
        return f"SELECT '{name}' AS section, query_id, rank, id, round({percent}, 6) AS percent, {none}, short_hash, subject, files, plus, minus FROM {rows} JOIN info USING (id) WHERE rank <= {DEFAULT.top_k}"

    return f"""{search}, {HYBRID}, {ITEMS}, {_items_search()}, {COMMIT_VECTORS},
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM item_scored),
hybrid_rows AS (SELECT query_id, rank, id AS chunk_id, score FROM reranked),{code('code_lexical', 'results')},{code('code_hybrid', 'hybrid_rows')},
info AS (
  SELECT hash AS id, left(hash, 12) AS short_hash, CASE WHEN length(head) > 100 THEN left(head, 100) || '…' ELSE head END AS subject,
         len(list_filter(ls, lambda x: starts_with(x, 'diff --git'))) AS files,
         len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++ '))) AS plus,
         len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '--- '))) AS minus
  FROM (SELECT *, {_split('diff_text')} AS ls, {_split('message')}[1] AS head FROM commits)),
report AS (
  SELECT *, NULL AS short_hash, NULL AS subject, NULL AS files, NULL AS plus, NULL AS minus FROM code_lexical
  UNION ALL SELECT *, NULL, NULL, NULL, NULL, NULL FROM code_hybrid
  UNION ALL {commit('commits_lexical', 'lex', 'score * 100')}
  UNION ALL {commit('commits_vector', 'commit_near', '(score + 1) / 2 * 100')})
SELECT {columns or '*'} FROM report"""


def oracle_sql() -> dict[str, str]:
    search = "WITH " + _search()
    return {
        "scan_filter": f"WITH {FILES} SELECT path, strlen(content) AS n_bytes, mtime FROM scanned",
        "ignore_rules": _ignore_sql(),
        "recency_cap": f"WITH {CHUNKS} SELECT chunk_id, mtime FROM chunks ORDER BY mtime DESC, file_path, chunk_index LIMIT {queries.RECENT}",
        "chunk_lines": f"""WITH joined AS (
            SELECT 'src/long_' || (doc_id // 10) || '.txt' AS path, string_agg(text, {NL} ORDER BY doc_id, text) AS content, {corpus.FIRST_MTIME} + doc_id // 10 AS mtime
            FROM documents GROUP BY doc_id // 10), {_chunks('joined')}
            SELECT chunk_id, chunk_index, line_start, line_end, md5(content) AS content_md5 FROM chunks""",
        "chunk_pages": rf"""WITH p AS (
            SELECT 'site/page_' || page_id || '.html' AS path, string_split(replace(html, '<p>', chr(12) || '<p>'), chr(12)) AS pages FROM pages),
            u AS (SELECT path, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS chunk_index FROM p)
            SELECT path || '#' || chunk_index AS chunk_id, chunk_index, chunk_index + 1 AS line_start,
                   md5(regexp_replace(page, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS content_md5 FROM u WHERE regexp_matches(page, '[^\s\p{{Z}}]')""",
        "camel_split": f"""WITH {FILES}, w AS (SELECT DISTINCT unnest({words('content')}) AS word FROM files),
            h AS (SELECT word, word || 'Xy' || reverse(word) AS pair FROM w)
            SELECT word, array_to_string({camel('pair')}, '|') AS parts FROM h""",
        "tokenize_tf": f"WITH {INDEX} SELECT token, chunk_id, tf FROM postings",
        "doc_freq_idf": f"WITH {INDEX} SELECT token, df, round({IDF}, 6) AS idf FROM doc_freq, stats",
        "symbols": f"WITH {INDEX} SELECT chunk_id, array_to_string(list_sort(symbols), '|') AS symbols FROM chunk_meta",
        "enclosing_context": f"WITH {CHUNKS} SELECT chunk_id, {context('content', 'line_start')} AS context FROM chunks",
        "identifier_query": f"WITH {FILES} SELECT word, {identifier('word')} AS is_identifier FROM (SELECT DISTINCT unnest({words('content')}) AS word FROM files)",
        "lexical_search": f"WITH {_search(boost=1.0)} SELECT {RESULT_COLUMNS} FROM results".replace("text AS query FROM benchmark", "lower(text) AS query FROM benchmark"),
        "lexical_search_batch": f"{search} SELECT {RESULT_COLUMNS} FROM results",
        "lexical_search_uncapped": f"WITH {_search(None)} SELECT {RESULT_COLUMNS} FROM results",
        "lexical_search_blocks": f"WITH {_search(None)} SELECT {RESULT_COLUMNS} FROM results",
        "block_lists": f"WITH {INDEX} SELECT token, count(*) AS postings, count(*) AS listed, max(least(tf, {DEFAULT.max_tf})) AS max_tf FROM postings GROUP BY token",
        "tree_scan": f"""SELECT coalesce(source, 'none') AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS n_bytes,
                   sum(len({_split("coalesce(text, '')")}))::BIGINT AS n_lines
            FROM documents WHERE source IS NULL OR source NOT IN ('src3', 'src7') GROUP BY ALL""",
        "lexical_search_items": f"""WITH items AS (SELECT conv_id || '/' || turn AS id, text FROM conversations), {QUERIES}, {_items_search()}
            SELECT query_id, id, round(raw, 6) AS raw, round(score, 6) AS score FROM item_scored""",
        "candidate_prune": f"{search} SELECT query_id, chunk_id, round(idf_mass, 6) AS idf_mass FROM pruned",
        "phrase_bonus": f"{search} SELECT query_id, chunk_id FROM scored WHERE phrase",
        "filename_bonus": f"""WITH {INDEX}, f AS (SELECT file_path, {tokens("string_split(file_path, '/')[-1]")} AS q FROM chunk_meta WHERE chunk_index = 0)
            SELECT chunk_id, {_size('list_intersect(q, file_name_tokens)')} AS matches FROM f JOIN chunk_meta USING (file_path)""",
        "vector_search_topk": f"WITH {VECTORS} SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM near WHERE rank <= {DEFAULT.top_k}",
        "vector_search_pruned": f"WITH {VECTORS} SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM near WHERE rank <= {DEFAULT.top_k}",
        "mrl_truncate": f"""WITH {VECTORS}, s AS (SELECT id, vec[1:16] AS v FROM vecs)
            SELECT id, unnest(range(16)) AS at, round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS x FROM s""",
        "rrf_merge": """WITH a AS (
              SELECT concat_ws('/', source, lang) AS query_id, doc_id AS id, length(text) >= 100 AS long,
                     row_number() OVER (PARTITION BY concat_ws('/', source, lang) ORDER BY length(text) DESC, doc_id) AS ra,
                     row_number() OVER (PARTITION BY concat_ws('/', source, lang), length(text) >= 100 ORDER BY doc_id) AS rb FROM documents),
            f AS (SELECT query_id, id, 1.5::DOUBLE / (60 + ra) + CASE WHEN long THEN 1.0::DOUBLE / (60 + rb) ELSE 0 END AS fused FROM a)
            SELECT query_id, id, round(fused / max(fused) OVER (PARTITION BY query_id), 6) AS fused FROM f""",
        "hybrid_rerank": f"""WITH {VECTORS}, l AS (
              SELECT q.query_id, i.id, row_number() OVER (PARTITION BY q.query_id ORDER BY i.id) AS rank FROM asked_vec q JOIN vecs i USING (label)),
            listed AS (SELECT * FROM l WHERE rank <= {queries.RERANK_DEPTH}),
            weights AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 1.5::DOUBLE ELSE 1 END AS w FROM asked_vec), {_rerank('listed', 'weights', 'asked_vec', 'vecs')}
            SELECT query_id, id, rank, round(vector_score, 6) AS vector_score, round(score, 6) AS score FROM reranked""",
        "embed_text": f"""SELECT doc_id, strlen(t) AS n_bytes, md5(t) AS text_md5 FROM (
            SELECT doc_id, '{DEFAULT.doc_prefix}' || {prefix('text', DEFAULT.embed_bytes)} AS t FROM documents)""",
        "cache_misses": f"WITH {KEYED} SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM keyed WHERE doc_id % 2 = 0)",
        "cache_sweep": f"""WITH {KEYED} SELECT count(*) AS removed, count(*) * 16 AS bytes_freed FROM (
            SELECT DISTINCT key FROM keyed WHERE doc_id % 2 = 0) WHERE key NOT IN (SELECT key FROM keyed WHERE source <> 'src2')""",
        "diff_filter": f"WITH {COMMITS} SELECT hash, strlen(diff_text) AS n_bytes, md5(diff_text) AS diff_md5 FROM commits",
        "diff_stats": f"""WITH {COMMITS}, s AS (SELECT *, {_split('diff_text')} AS ls, {_split('message')}[1] AS head FROM commits)
            SELECT left(hash, 12) AS short_hash, CASE WHEN length(head) > 100 THEN left(head, 100) || '…' ELSE head END AS subject,
                   len(list_filter(ls, lambda x: starts_with(x, 'diff --git'))) AS files,
                   len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++ '))) AS plus,
                   len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '--- '))) AS minus FROM s""",
        "commit_search": f"""WITH {ITEMS}, {QUERIES}, {_items_search()}
            SELECT query_id, rank, id, round(score, 6) AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM item_scored) WHERE rank <= {DEFAULT.top_k}""",
        "commit_vector_search": f"WITH {ITEMS}, {QUERIES}, {COMMIT_VECTORS} SELECT query_id, rank, id, round(score, 6) AS score FROM commit_near WHERE rank <= {DEFAULT.top_k}",
        "explain_tokens": f"""WITH {INDEX}, {QUERIES}, u AS (SELECT query_id, {identifier('query')} AS is_identifier_query, unnest(query_tokens) AS token FROM terms)
            SELECT query_id, token, coalesce(df, 0) AS doc_freq, round(ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1, 6) AS idf, is_identifier_query
            FROM u LEFT JOIN doc_freq USING (token), stats""",
        "explain_results": f"{search}, {MATCHED} SELECT query_id, rank, chunk_id, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing FROM matches",
        "coverage_bands": f"""{search}, {MATCHED}, b AS (
              SELECT m.*, len({_split('s.content')}) AS total_lines, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9::DOUBLE) * 100 AS p
              FROM matches m JOIN scanned s ON s.path = m.file_path)
            SELECT query_id, rank, chunk_id, total_lines, round(p, 6) AS percent_of_best, {BANDS} AS band,
                   round(len(matched) / len(query_tokens)::DOUBLE * 100, 6) AS coverage, {context('content', 'line_start')} AS context FROM b""",
        "eval_report": f"{search}, {QRELS}, {_evaluate('ranked_files', 'qrels')} SELECT query_id, {MEASURES} FROM evaluated",
        "eval_mean": f"""{search}, {QRELS}, {_evaluate('ranked_files', 'qrels')}
            SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM evaluated""",
        "vector_eval": f"""WITH {VECTORS}, listed AS (SELECT query_id, id, rank FROM near WHERE rank <= 100),
            judgments AS (SELECT q.query_id, i.id, 1.0::DOUBLE AS rel FROM asked_vec q JOIN vecs i USING (label)), {_evaluate('listed', 'judgments')}
            SELECT query_id, {MEASURES} FROM evaluated""",
        "state_diff": f"""WITH {FILES}, old AS (
              SELECT CASE WHEN doc_id % 7 = 0 THEN 'old/' ELSE '' END || path AS file_path, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS old_mtime
              FROM files WHERE doc_id % 3 <> 0), new AS (SELECT path AS file_path, mtime AS new_mtime FROM files)
            SELECT file_path, CASE WHEN old_mtime IS NULL THEN 'added' WHEN new_mtime IS NULL THEN 'removed' WHEN old_mtime = new_mtime THEN 'unchanged' ELSE 'changed' END AS state,
                   old_mtime, new_mtime FROM old FULL JOIN new USING (file_path)""",
        "sync_index": f"""WITH {FILES}, {_chunks('files')}, {_postings('chunks', 'chunk_id', 'content')}
            SELECT token, count(*) AS df, (SELECT count(*) FROM chunks) AS n FROM postings GROUP BY token""",
        "vector_scores": f"WITH {VECTORS} SELECT query_id, id, round(cosine, 6) AS cosine FROM near",
        "cache_upsert": f"""WITH {KEYED}, old AS (SELECT key, min(doc_id) AS x FROM keyed WHERE doc_id % 2 = 0 GROUP BY key),
            new AS (SELECT key, -max(doc_id) AS x FROM keyed WHERE doc_id % 3 = 0 GROUP BY key)
            SELECT key, coalesce(new.x, old.x)::DOUBLE AS x FROM old FULL JOIN new USING (key)""",
        "embed_cached": f"""WITH {KEYED}, old AS (SELECT key, min(doc_id)::DOUBLE AS x FROM keyed WHERE doc_id % 2 = 0 GROUP BY key),
            need AS (SELECT key, min('{DEFAULT.doc_prefix}' || {prefix('text', DEFAULT.embed_bytes)}) AS text FROM keyed JOIN documents USING (doc_id)
                     WHERE key NOT IN (SELECT key FROM old) GROUP BY key), {_hashed('fresh', 'need', 'key', 'text')},
            unit AS (SELECT key, list_transform(vec, lambda x: x / CASE WHEN list_dot_product(vec, vec) > 0 THEN sqrt(list_dot_product(vec, vec)) ELSE 1 END) AS v FROM fresh)
            SELECT key, 4 AS n, round(x, 6) AS first, round(x, 6) AS fourth FROM old
            UNION ALL SELECT key, len(v), round(v[1], 6), round(v[4], 6) FROM unit""",
        "utf8_files": "SELECT 'page_' || page_id AS path, strlen(html) AS n_bytes, page_id::BIGINT AS mtime, md5(html) AS content_md5 FROM pages WHERE page_id % 5 <> 0",
        "index_round_trip": f"{search} SELECT {RESULT_COLUMNS} FROM results",
        "previews": f"{search} SELECT query_id, rank, md5({preview('content', 80)}) AS preview_md5 FROM results JOIN chunks USING (chunk_id)",
        "few_commits": f"WITH {COMMITS} SELECT hash, seq FROM (SELECT * FROM recent ORDER BY seq DESC, hash LIMIT {queries.FEW_COMMITS}) WHERE message <> '' OR diff_text <> ''",
        "sync_tree": f"""WITH {INDEX}, old AS (
              SELECT CASE WHEN doc_id % 7 = 0 THEN 'old/' ELSE '' END || path AS path, content, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime
              FROM scanned WHERE doc_id % 3 <> 0), {_chunks('old').replace('lines AS', 'old_lines AS').replace('FROM lines)', 'FROM old_lines)').replace('win AS', 'old_win AS').replace('FROM win)', 'FROM old_win)').replace('body AS', 'old_body AS').replace('FROM body', 'FROM old_body').replace('chunks AS', 'old_chunks AS')},
            now AS (SELECT DISTINCT {prefix('content', DEFAULT.embed_bytes)} AS t FROM chunks),
            then_ AS (SELECT DISTINCT {prefix('content', DEFAULT.embed_bytes)} AS t FROM old_chunks)
            SELECT (SELECT count(*) FROM postings) AS postings, (SELECT sum(tf)::BIGINT FROM postings) AS tf, (SELECT count(DISTINCT token) FROM postings) AS tokens,
                   (SELECT count(*) FROM then_ WHERE t IN (SELECT t FROM now)) AS cached, n FROM stats""",
        "stream_ingest": f"WITH {INDEX} SELECT token, df, n FROM doc_freq, stats",
        "stream_versions": f"""WITH {FILES}, left_files AS (
              SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'fn again' || {NL} || content ELSE content END AS content, mtime
              FROM scanned WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0), {_chunks("left_files")}, {_postings("chunks", "chunk_id", "content")},
            doc_freq AS (SELECT token, count(*) AS df FROM postings GROUP BY token)
            SELECT token, df, n FROM doc_freq, (SELECT count(*) AS n FROM chunks)""",
        "stream_serve": f"{search} SELECT {RESULT_COLUMNS} FROM results",
        "stream_serve_live": f"""SELECT 1::BIGINT AS version, * FROM ({search.replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 0)")} SELECT {RESULT_COLUMNS} FROM results) WHERE query_id % 2 = 0
            UNION ALL SELECT 3::BIGINT, * FROM ({search} SELECT {RESULT_COLUMNS} FROM results) WHERE query_id % 2 <> 0""",
        "corpus_summary": f"WITH {CHUNKS} SELECT count(DISTINCT file_path) AS files, count(*) AS chunks FROM chunks",
        "hybrid_search": f"{search}, {HYBRID} SELECT query_id, rank, id AS chunk_id, round(vector_score, 6) AS vector_score, round(score, 6) AS score FROM reranked",
        "search_report": _report(search, 3, 80, None),
        "server_report": _report(search, 5, None, "section, query_id, rank, id, percent, line_start, preview_md5, short_hash, subject"),
    }
