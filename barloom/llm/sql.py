"""DuckDB twins of the operator queries that SQL can express.

Without a twin: the trained classifiers (op3, op4), the guess cost of op5, the frame
schedule of op7, edit distance over code points (op9; DuckDB counts bytes), the markup of op12 and the
pipeline. Tests hold those against brute force or held-out accuracy.
"""

from __future__ import annotations

from .queries import LISTED_ENDS, LISTED_LABELS, LISTED_LANGUAGES, LISTED_NUMBERS, URL_RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, k FROM (
    SELECT item_id, least(10, len(w)) AS n,
           unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS k
    FROM item_words WHERE len(w) > 0)
), slices AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'s': i, 'k': array_to_string(w[i:i + n - 1], ' ')}})) AS x
  FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT doc_id, x.s AS s, n, item_id FROM slices JOIN windows USING (n) WHERE x.k = windows.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op2() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    lists = [", ".join(f"'{x}'" for x in names) for names in (LISTED_LABELS, LISTED_ENDS, LISTED_LANGUAGES)]
    listed = " CROSS JOIN ".join(f"(SELECT unnest([{x}]) AS {c})" for x, c in zip(lists, "abc"))
    return rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), keyed AS (
  SELECT *, regexp_replace(host, '^(?:www|m|blog)\.', '') || CASE WHEN suffix(path, '.html') THEN left(path, length(path) - 5) ELSE rtrim(path, '/') END AS k FROM split
), listed AS (
  SELECT a || '.example.' || b || '/' || c || '/' || i AS k FROM {listed} CROSS JOIN range({LISTED_NUMBERS}) n(i)
)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN k <> '' AND k IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed
"""


_OP6 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s)
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), top AS (
  SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN top USING (doc_id)
"""

_CONTROL = r"([<\[])(/?(?:s>|INST\]|SYS\]|ROLE))"
_ESCAPED = rf"regexp_replace(replace({{0}}, chr(92), chr(92) || chr(92)), '{_CONTROL}', '\1\\\2', 'g')"
_ESC_TEXT, _ESC_ROLE = _ESCAPED.format("text"), "replace(" + _ESCAPED.format("role") + ", ']', chr(92) || ']')"
_OP8 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length({_ESC_TEXT}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13
         ELSE 16 + length({_ESC_ROLE}) END AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP10 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT * FROM vectors WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), top AS (
  SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM vectors LEFT JOIN top USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


_BYTES = "octet_length(encode({0})) || ':' || {0}"
_PART = "coalesce(" + _BYTES + ", '-')"


def _op11() -> str:
    """Levels of all trees as one recursion, proofs and folds as another; crc32 by the table of its polynomial."""
    parts = lambda n: " || ".join(_PART.format(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n} AS VARCHAR)", "text"))
    return f"""
WITH RECURSIVE crc_step AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_step WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8
), rows AS (
  SELECT doc_id, lang, sha256({parts('n_chars')}) AS leaf, sha256({parts('(n_chars + 1)')}) AS more,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, crc
), leaves AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    CASE WHEN coalesce(hit, false) AND more IS NOT NULL THEN more ELSE leaf END AS start FROM rows
), up AS (
  SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL SELECT tree, level + 1, i // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY i) AS nxt FROM up WHERE n > 1) WHERE i % 2 = 0
), nodes AS MATERIALIZED (SELECT * FROM up
), subroots AS MATERIALIZED (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1
), over AS (
  SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (ORDER BY i) AS nxt FROM over WHERE n > 1) WHERE i % 2 = 0
), tops AS MATERIALIZED (SELECT * FROM over
), fold AS (
  SELECT doc_id, leaf, l.i AS place, tree, s.i AS j, height, 0 AS level, CASE WHEN height = 0 THEN s.i ELSE l.i END AS at, start AS h, '' AS proof FROM leaves l JOIN subroots s USING (tree)
  UNION ALL SELECT doc_id, leaf, place, f.tree, j, height, f.level + 1,
    CASE WHEN f.level + 1 = height THEN j ELSE f.at // 2 END,
    sha256(CASE WHEN f.at % 2 = 1 THEN coalesce(x.h, y.h, '') || f.h ELSE f.h || coalesce(x.h, y.h, '') END), proof || coalesce(x.h, y.h, '')
    FROM fold f LEFT JOIN nodes x ON f.level < height AND x.tree = f.tree AND x.level = f.level AND x.i = xor(f.at, 1)
    LEFT JOIN tops y ON f.level >= height AND y.level = f.level - height AND y.i = xor(f.at, 1)
    WHERE f.level < height + (SELECT max(level) FROM tops)
)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM fold JOIN subroots USING (tree) WHERE level = fold.height + (SELECT max(level) FROM tops)
"""


_OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT t.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), ran AS (
  SELECT part, o, step, f[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS one, good, toxic
  FROM flags, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), sums AS (
  SELECT part, o, step, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed, count(*) FILTER (gone AND fails) AS redundant,
    count(*) FILTER (fails AND one) AS unique_fails, count(*) FILTER (NOT gone AND fails AND good) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
  FROM ran GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM sums
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": _OP1,
        "op2_url_filter": _op2(),
        "op6_minhash_dedup": _OP6,
        "op8_chat_format": _OP8,
        "op10_embedding_dedup": _OP10,
        "op11_merkle_manifest": _op11(),
        "op13_filter_audit": _OP13,
    }
