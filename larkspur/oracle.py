"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from larkspur.functions.text import MARKED, PLAIN, PREVIEW_BYTES, STOP_WORDS, SYNONYMS
from larkspur.operators.chunker import MAX_BYTES

_quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SYNONYM_CASES = "CASE w " + " ".join(f"WHEN '{k}' THEN {_quoted([k, *v])}" for k, v in SYNONYMS.items()) + " ELSE [w] END"


def raw_tokens(c: str) -> str:
    words = f"string_split(regexp_replace(lower(replace({c}, 'İ', 'i')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({_quoted(STOP_WORDS)}, w))"


def tokens(c: str) -> str:
    return f"(SELECT flatten(list_transform(x, lambda w, i: CASE WHEN list_position(x, w) = i THEN {_SYNONYM_CASES} ELSE [w] END)) FROM (SELECT {raw_tokens(c)} AS x))"


def folded_terms(c: str) -> str:
    fold = f"translate(regexp_replace(lower(replace({c}, 'İ', 'i')), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '{MARKED}', '{PLAIN}')"
    return f"list_filter(string_split_regex({fold}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda w: w <> '')"


def fnv(c: str) -> str:
    return f"list_reduce(list_transform(string_split({c}, ''), lambda x: ascii(x)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def frontmatter(c: str) -> str:
    return f"""(SELECT CASE WHEN regexp_matches(s, '^---[\\n\\r]') AND strpos(substr(s, 4), chr(10) || '---') > 0
      THEN regexp_replace(substr(substr(s, 4), strpos(substr(s, 4), chr(10) || '---') + 4), '^[\\r\\n]+', '') ELSE s END
      FROM (SELECT regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n', chr(10), 'g'), '\\r$', ''), '^[ \\t\\r\\n]+', '') AS s))"""


FILES = """files AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path,
  '# Doc ' || doc_id || chr(10) || '## ' || lang || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS body FROM documents)"""


def sections(files: str = "files") -> str:
    """CTE sec(doc_id, gi, si, heading, content) of files(doc_id, body)."""
    return f"""
gr AS (SELECT doc_id, unnest(l) AS g, generate_subscripts(l, 1) AS gi FROM (SELECT doc_id,
  string_split(regexp_replace({frontmatter('body')}, '(?m)^(#{{1,2}} )', chr(1) || '\\1', 'g'), chr(1)) AS l FROM {files})),
se AS (SELECT doc_id, gi, unnest(l) AS s, generate_subscripts(l, 1) AS si,
  CASE WHEN starts_with(g, '## ') THEN {trim("substr(split_part(g, chr(10), 1), 4)")} ELSE '' END AS top
  FROM (SELECT doc_id, gi, g, string_split(regexp_replace(g, '(?m)^(### )', chr(1) || '\\1', 'g'), chr(1)) AS l FROM gr)),
sec AS (SELECT * FROM (SELECT doc_id, gi, si,
  CASE WHEN regexp_matches(s, '^#{{1,3}} ') THEN {trim("CASE WHEN starts_with(s, '### ') AND top <> '' THEN top || ' / ' ELSE '' END || regexp_replace(split_part(s, chr(10), 1), '^#{1,3} ', '')")} ELSE '' END AS heading,
  {trim("CASE WHEN NOT regexp_matches(s, '^#{1,3} ') THEN s WHEN strpos(s, chr(10)) > 0 THEN substr(s, strpos(s, chr(10)) + 1) ELSE '' END")} AS content
  FROM se) WHERE heading <> '' OR content <> '')"""


def chunks(files: str = "files") -> str:
    """CTE ch(doc_id, chunk_idx, heading, content, chunk_id)."""
    return f"""{sections(files)},
pk AS (SELECT doc_id, gi, si, heading, content, CASE WHEN strlen(content) <= {MAX_BYTES} THEN [content] ELSE
  (SELECT list_append(r.parts, {trim('r.held')}) FROM (SELECT list_reduce(
    list_transform(string_split(content, chr(10) || chr(10)), lambda p: {{'parts': []::VARCHAR[], 'held': p}}),
    lambda s, e: CASE WHEN s.held <> '' AND strlen(s.held) + strlen(e.held) > {MAX_BYTES}
      THEN {{'parts': list_append(s.parts, {trim('s.held')}), 'held': e.held}}
      ELSE {{'parts': s.parts, 'held': CASE WHEN s.held = '' THEN e.held ELSE s.held || chr(10) || chr(10) || e.held END}} END) AS r)) END AS parts FROM sec),
ch AS (SELECT doc_id, chunk_idx, heading, content, (doc_id << 20) + chunk_idx AS chunk_id FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gi, si, n) - 1 AS chunk_idx,
    CASE WHEN heading = '' OR n = 1 THEN heading ELSE heading || ' (' || n || ')' END AS heading, content
  FROM (SELECT doc_id, gi, si, heading, unnest(parts) AS content, generate_subscripts(parts, 1) AS n FROM pk)))"""


CORPUS = f"{FILES},\n{chunks()}"
POSTINGS = f"""
tm AS MATERIALIZED (SELECT chunk_id, unnest({folded_terms("heading || ' ' || content")}) AS term FROM ch),
po AS MATERIALIZED (SELECT term, chunk_id, count(*)::BIGINT AS tf FROM tm GROUP BY ALL),
le AS (SELECT chunk_id, len({folded_terms("heading || ' ' || content")})::BIGINT AS n_tokens FROM ch)"""
QUERY_SET = "qu AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
PHRASES = f"""
ph AS MATERIALIZED (SELECT query_id, mode, phrase, count(*) AS times FROM (
  SELECT query_id, 'all' AS mode, unnest({raw_tokens('query')}) AS phrase FROM qu
  UNION ALL SELECT query_id, 'any', unnest({tokens('query')}) FROM qu) GROUP BY ALL),
ex AS MATERIALIZED (SELECT phrase, term FROM (SELECT DISTINCT phrase FROM ph) JOIN (SELECT DISTINCT term FROM po) ON starts_with(term, phrase)),
hi AS MATERIALIZED (SELECT phrase, chunk_id, sum(tf)::DOUBLE AS f FROM po JOIN ex USING (term) GROUP BY ALL),
id AS (SELECT phrase, CASE WHEN ln((r - n + 0.5) / (n + 0.5)) > 0 THEN ln((r - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, mean
  FROM (SELECT phrase, count(*) AS n FROM hi GROUP BY phrase), (SELECT count(*) AS r, avg(n_tokens) AS mean FROM le)),
pa AS MATERIALIZED (SELECT phrase, chunk_id, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / mean)) AS part FROM hi JOIN id USING (phrase) JOIN le USING (chunk_id)),
ma AS MATERIALIZED (SELECT s.query_id, s.mode, chunk_id, score FROM (SELECT query_id, mode, chunk_id, round(sum(part * times), 10) AS score, count(*) AS held FROM ph JOIN pa USING (phrase) GROUP BY ALL) s
  JOIN (SELECT query_id, mode, count(*) AS asked FROM ph GROUP BY ALL) a ON a.query_id = s.query_id AND a.mode = s.mode WHERE s.mode = 'any' OR held = asked)"""
LEXICAL = f"""WITH {CORPUS}, {POSTINGS}, {QUERY_SET}, {PHRASES}"""


def lexical(k: int) -> str:
    return f"""fts AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT *, min(mode) OVER (PARTITION BY query_id) AS use FROM ma) WHERE mode = use QUALIFY rank <= {k})"""


_WHOLE = "heading || ' ' || content"
VOCAB = f"""
vo AS MATERIALIZED (SELECT term, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (
  SELECT term, count(*)::BIGINT AS df FROM (SELECT unnest(list_distinct({tokens(_WHOLE)})) AS term FROM ch) GROUP BY term), (SELECT count(*)::DOUBLE AS n FROM ch))"""


def hashed(source: str, key: str, default: str, name: str) -> str:
    """CTEs for unit vectors `name` of source(key, tokens)."""
    return f"""
{name}_tf AS (SELECT {key}, term, count(*) / any_value(total)::DOUBLE AS tf FROM (SELECT {key}, len(tokens) AS total, unnest(tokens) AS term FROM {source}) GROUP BY {key}, term),
{name}_h AS MATERIALIZED (SELECT term, {fnv('term')} AS h FROM (SELECT DISTINCT term FROM {name}_tf)),
{name}_c AS (SELECT {key}, ((h >> 1) % 1024)::INTEGER AS dim, sum(CASE WHEN h & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * tf * coalesce(idf, idf_default)) AS w
  FROM {name}_tf JOIN {name}_h USING (term) LEFT JOIN vo USING (term), ({default}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, dim, CASE WHEN norm > 0 THEN w / norm ELSE w END AS w FROM {name}_c JOIN (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name}_c GROUP BY {key}) USING ({key}))"""


VECTORS = f"""{VOCAB},
ct AS (SELECT chunk_id, list_concat(list_concat(list_concat(h, h), h), {tokens('content')}) AS tokens FROM (SELECT *, {tokens('heading')} AS h FROM ch)),
{hashed('ct', 'chunk_id', 'SELECT ln((count(*)::DOUBLE + 1) / 1) + 1 AS idf_default FROM ch', 'cv')}"""
VECTOR_QUERIES = f"""
qt AS (SELECT query_id, {tokens('query')} AS tokens FROM qu),
{hashed('qt', 'query_id', 'SELECT ln((count(DISTINCT chunk_id)::DOUBLE + 11) / 1) + 1 AS idf_default FROM cv', 'qv')}"""


def vector(k: int) -> str:
    return f"""vec AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(cv.w * qv.w), 9) AS score FROM cv JOIN qv USING (dim) GROUP BY ALL) WHERE score >= 0.01 QUALIFY rank <= {k})"""


def hybrid(limit: int) -> str:
    return f"""{LEXICAL}, {lexical(4 * limit)}, {VECTORS}, {VECTOR_QUERIES}, {vector(4 * limit)},
fu AS (SELECT query_id, chunk_id, sum(part) AS exact, round(sum(part), 9) AS score FROM (
  SELECT query_id, chunk_id, 4.0::DOUBLE / (rank + 60) AS part FROM fts UNION ALL SELECT query_id, chunk_id, 0.5::DOUBLE / (rank + 60) FROM vec) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu QUALIFY rank <= {limit}),
res AS (SELECT query_id, rank::INTEGER AS rank, chunk_id, path, heading, content, score,
  CASE WHEN exact >= 0.04 THEN 'strong match' WHEN exact >= 0.015 THEN 'relevant' ELSE 'weak match' END AS label
  FROM top JOIN ch USING (chunk_id) JOIN files USING (doc_id))"""


_EDIT = """(SELECT CASE WHEN start IS NULL THEN regexp_replace(body, '\\n+$', '') || chr(10) || chr(10) || target || chr(10) || chr(10) || new || chr(10)
  ELSE array_to_string(list_concat(list_concat(l[1:start - 1], [target, '']), list_concat(list_concat(string_split(new, chr(10)), ['']), CASE WHEN stop IS NULL THEN [] ELSE l[stop:] END)), chr(10)) END
  FROM (SELECT *, list_min(list_filter(range(start + 1, len(l) + 1), lambda i: regexp_matches(l[i], '^#+ '))) AS stop
    FROM (SELECT l, target, new, list_min(list_filter(range(1, len(l) + 1), lambda i: rtrim(l[i], ' ') = target)) AS start
      FROM (SELECT string_split(body, chr(10)) AS l, '## ' || {heading} AS target, {new} AS new))))"""


def edited(heading: str, new: str) -> str:
    return _EDIT.replace("{heading}", heading).replace("{new}", new)


_SECOND = """second AS (SELECT doc_id, path, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN body || chr(10) || '## Note' || chr(10) || 'checked' ELSE body END AS body
  FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
#: Ids in the order of paths, as a store gives them.
_BY_PATH = FILES.replace("SELECT doc_id,", "SELECT row_number() OVER (ORDER BY source || '/' || doc_id || '.md') AS doc_id,").replace("'# Doc ' || doc_id", "'# Doc ' || documents.doc_id").replace("source || '/' || doc_id || '.md' AS path", "source || '/' || documents.doc_id || '.md' AS path").replace("(ORDER BY source || '/' || doc_id", "(ORDER BY source || '/' || documents.doc_id")
_EDITED = """edited AS (
  SELECT f.doc_id, f.path, coalesce(s.body, f.body) AS body, s.doc_id IS NOT NULL AS again FROM files f LEFT JOIN (SELECT * FROM second WHERE starts_with(path, 'src1/')) s USING (doc_id)
  WHERE f.path <> (SELECT max(path) FROM files))"""

_SECOND_BY_PATH = _BY_PATH.replace("files AS (SELECT ", "first_files AS (SELECT documents.doc_id AS own_id, ", 1) + ", " + _SECOND.replace("FROM files", "FROM first_files").replace("second AS", "files AS", 1).replace("doc_id IN", "own_id IN").replace("doc_id NOT IN", "own_id NOT IN")

_CUTS = ", ".join(f"try(decode(encode(text)[1:{PREVIEW_BYTES - k}]))" for k in range(4))

ORACLE: dict[str, str] = {
    "tokenize_raw": f"SELECT doc_id, array_to_string({raw_tokens('text')}, ' ') AS tokens FROM documents",
    "tokenize_expanded": f"""SELECT doc_id, array_to_string({tokens("text || ' OOMKilled drain ' || lang || ' oomkilled timeout'")}, ' ') AS tokens FROM documents""",
    "index_terms": f"SELECT doc_id, array_to_string({folded_terms('text')}, ' ') AS terms FROM documents",
    "hashed_terms": f"""WITH t AS (SELECT DISTINCT unnest({tokens('text')}) AS term FROM documents), h AS (SELECT term, {fnv('term')} AS hash FROM t)
      SELECT term, hash, ((hash >> 1) % 1024)::INTEGER AS dim, CASE WHEN hash & 1 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM h""",
    "term_frequency": f"""SELECT doc_id, term, count(*) AS n, round(count(*) / any_value(total)::DOUBLE, 6) AS tf
      FROM (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)) GROUP BY doc_id, term""",
    "vocabulary": f"WITH {CORPUS}, {VOCAB} SELECT term, df, round(idf, 9) AS idf FROM vo",
    "sections": f"WITH {FILES}, {sections()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gi, si) - 1 AS idx, heading, content FROM sec",
    "chunk_documents": f"WITH {CORPUS} SELECT doc_id, chunk_idx::INTEGER AS chunk_idx, heading, content FROM ch",
    "frontmatter": f"""SELECT doc_id, {frontmatter("CASE WHEN lang = 'en' THEN '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text WHEN lang = 'fr' THEN '---' || chr(10) || text ELSE chr(10) || text END")} AS body FROM documents""",
    "postings": f"WITH {CORPUS}, {POSTINGS} SELECT term, chunk_id, tf FROM po",
    "chunk_lengths": f"WITH {CORPUS}, {POSTINGS} SELECT chunk_id, n_tokens FROM le",
    "prefix_terms": f"{LEXICAL} SELECT phrase, term FROM ex",
    "match_all_or_any": f"{LEXICAL} SELECT query_id, mode, count(*) AS chunks, round(sum(score), 4) AS score FROM ma GROUP BY ALL",
    "bm25_topk": f"{LEXICAL}, {lexical(20)} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM fts",
    "tfidf_vectors": f"WITH {CORPUS}, {VECTORS} SELECT chunk_id, dim, round(w, 6) AS w FROM cv",
    "vector_topk": f"WITH {CORPUS}, {VECTORS}, {QUERY_SET}, {VECTOR_QUERIES}, {vector(20)} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM vec",
    "dense_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)
      SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 50 = 0) QUALIFY rank <= 20)""",
    "hybrid_search": f"{hybrid(5)} SELECT * FROM res",
    "search_in_path": f"{hybrid(10)} SELECT query_id, rank, path, heading, score FROM res WHERE starts_with(path, 'src1')",
    "list_documents": f"""WITH {CORPUS} SELECT path, 'Doc ' || doc_id AS title, array_to_string(list(heading ORDER BY chunk_idx), ' | ') AS headings, count(*) AS sections
      FROM ch JOIN files USING (doc_id) WHERE starts_with(path, 'src1') GROUP BY doc_id, path""",
    "upsert_documents": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN text ELSE 'q' || l.quality || ' ' || text END AS body
      FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id""",
    "prune_documents": f"WITH {CORPUS} SELECT doc_id, count(*) AS chunks FROM ch WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY doc_id",
    "cascade_delete": f"""WITH {CORPUS} SELECT files.doc_id, path, count(ch.chunk_idx) AS chunks FROM files LEFT JOIN ch USING (doc_id)
      WHERE files.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL""",
    "next_chunk_idx": f"WITH {CORPUS} SELECT doc_id, (max(chunk_idx) + 1)::INTEGER AS next_idx FROM ch GROUP BY doc_id",
    "store_ingest": f"""WITH {FILES}, {_SECOND}, {chunks('second')} SELECT path, 'Doc ' || doc_id AS title, chunk_idx::INTEGER AS chunk_idx, heading, content FROM ch JOIN second USING (doc_id)""",
    "store_statistics": f"""WITH {FILES}, {_SECOND}, {chunks('second')}, {POSTINGS}, {VOCAB}
      SELECT coalesce(p.term, vo.term) AS term, coalesce(chunks, 0)::BIGINT AS chunks, coalesce(times, 0)::BIGINT AS times, coalesce(df, 0)::BIGINT AS df, round(coalesce(idf, 0), 9) AS idf
      FROM (SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS times FROM po GROUP BY term) p FULL JOIN vo ON p.term = vo.term""",
    "store_edit": f"""WITH {FILES}, {_SECOND}, {_EDITED}, {chunks('edited')},
      l AS (SELECT path, 'Doc ' || doc_id AS title, array_to_string(list(heading ORDER BY chunk_idx), ' | ') AS headings, CASE WHEN again THEN 2 ELSE 1 END AS stamp
        FROM ch JOIN edited USING (doc_id) GROUP BY doc_id, path, again),
      a AS (SELECT path, title, CASE WHEN path = (SELECT min(path) FROM files) THEN headings || ' | Added' ELSE headings END AS headings, stamp FROM l
        UNION ALL SELECT 'zz/new.md', 'Fresh', 'Fresh', 3)
      SELECT row_number() OVER (ORDER BY stamp DESC, path)::INTEGER AS place, path, title, headings FROM a""",
    "store_search": f"{hybrid(5).replace(FILES, _BY_PATH)} SELECT query_id, rank, path, heading, content, score, label FROM res",
    "store_pages": f"""WITH {CORPUS} SELECT path, 'Doc ' || doc_id AS title, array_to_string(list(heading ORDER BY chunk_idx), ' | ') AS headings
      FROM ch JOIN files USING (doc_id) WHERE starts_with(path, 'src1/') GROUP BY doc_id, path ORDER BY path LIMIT 5 OFFSET 5""",
    "store_edited_search": f"{hybrid(5).replace(FILES, _SECOND_BY_PATH)} SELECT query_id, rank, path, heading, content, score, label FROM res",
    "vector_bytes": "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same, CASE WHEN vec_id % 4 = 0 THEN len(embedding) ELSE 0 END AS left FROM embeddings",
    "replace_section": f"""WITH {FILES}, x AS (SELECT f.doc_id, f.body, d.lang, d.source FROM files f JOIN documents d USING (doc_id))
      SELECT doc_id, {edited('lang', "'New text of ' || doc_id || chr(10) || 'and more'")} AS replaced, {edited('source', "'Added to ' || doc_id")} AS added FROM x""",
    "first_code_block": f"""WITH x AS (SELECT doc_id, text, string_split('intro' || chr(10) || '```' || lang || chr(10) || text || CASE WHEN lang = 'en' THEN chr(10) || '```' || chr(10) || 'rest' ELSE '' END, chr(10)) AS l FROM documents),
      y AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '```')) AS f FROM x)
      SELECT doc_id, {trim("array_to_string(l[f[1] + 1:coalesce(f[2] - 1, len(l))], chr(10))")} AS code FROM y""",
    "preview": f"""WITH x AS (SELECT doc_id, text, coalesce({_CUTS}) AS p FROM documents),
      y AS (SELECT doc_id, text, p, length(p) - strpos(reverse(p), ' ') AS cut FROM x)
      SELECT doc_id, CASE WHEN strlen(text) <= {PREVIEW_BYTES} THEN text WHEN strpos(p, ' ') > 0 AND strlen(substr(p, 1, cut)) > {PREVIEW_BYTES - 60} THEN substr(p, 1, cut) ELSE p END AS preview FROM y""",
    "heading_lines": f"WITH {FILES} SELECT doc_id, len(list_filter(string_split(body || chr(10) || '### sub' || chr(10) || '#no', chr(10)), lambda x: regexp_matches(x, '^#+ '))) AS headings FROM files",
    "unit_vectors": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares,
      round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 9) AS own_cosine FROM embeddings""",
}
ORACLE["dense_clusters"] = ORACLE["dense_topk"]
ORACLE["folder_follow"] = ORACLE["store_ingest"]
ORACLE |= {f"sql_{name}": ORACLE[name] for name in ("sections", "replace_section", "vocabulary")}
ORACLE["sql_chunks"] = ORACLE["chunk_documents"]
ORACLE["bm25_blocks"] = ORACLE["bm25_topk"]
ORACLE["markdown_tree"] = ORACLE["chunk_documents"]
