"""DuckDB SQL for the queries that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

from tracklake.llm import urls
from tracklake.llm.repetition import RepetitionPolicy

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP2 = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
c AS (SELECT vec_id, list_transform(range(1, 65), lambda j: CAST(list_sum(list_transform(range(j, len(e) + 1, 64), lambda i: e[i])) > 0 AS INTEGER)) AS s FROM e),
p AS (SELECT q.vec_id AS query_id, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(q.s, b.s), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS INTEGER) AS distance FROM c q JOIN c b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM p QUALIFY rank <= 10"""

OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) c ON c.node = d.doc_id"""

def _rules(shown) -> str:  # noqa: ANN001
    cases = (f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{shown(r)}'" for r in sorted(urls.RULES, key=lambda r: -len(r.text)))
    return f"CASE {' '.join(cases)} END"


OP7 = f"""WITH r AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{urls.TRACKING}='))) AS query FROM r),
c AS (SELECT *, CASE WHEN host = '' AND path = '' THEN trim(url) ELSE regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM h),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{urls.UNWANTED_HOST}'))
SELECT page_id, host, path, {_rules(lambda r: r.text)} AS rule, coalesce({_rules(lambda r: r.verdict)}, CASE WHEN canonical IN (FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM c"""

_P = RepetitionPolicy()
_SHARES = ", ".join(f"({n}, {s}::DOUBLE)" for n, s in _P.ngram_share.items())
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
t AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
sizes(n, bound) AS (VALUES {_SHARES}),
g AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS gram FROM d, sizes WHERE len(words) >= n),
k AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) > 1 AS later, count(*) OVER (PARTITION BY doc_id, n, gram) > 1 AS twice FROM g),
v AS (SELECT w.doc_id, s.n, w.i, length(word) AS c, max(CASE WHEN later THEN w.i END) OVER u AS last_later, max(CASE WHEN twice THEN w.i END) OVER u AS last_twice FROM w CROSS JOIN sizes s LEFT JOIN k ON k.doc_id = w.doc_id AND k.n = s.n AND k.i = w.i WINDOW u AS (PARTITION BY w.doc_id, s.n ORDER BY w.i ROWS UNBOUNDED PRECEDING)),
a AS (SELECT doc_id, n, sum(CASE WHEN last_later > i - n THEN c ELSE 0 END) AS covered, count(*) FILTER (last_twice > i - n) AS words_twice FROM v GROUP BY 1, 2),
b AS (SELECT a.doc_id, max(covered / word_chars) AS top_share, bool_or(covered / word_chars > bound) AS failed, max(words_twice) FILTER (a.n = 5) AS n_repeat_words FROM a JOIN t USING (doc_id) JOIN sizes USING (n) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
m AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS later FROM l WHERE regexp_matches(line, '{_WORD}')),
o AS (SELECT doc_id, count(*) AS n_dup_lines, sum(CAST(list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x))) AS BIGINT)) AS c FROM m WHERE later GROUP BY 1),
f AS (SELECT t.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(failed, false) AS failed, coalesce(top_share, 0) AS top_share, coalesce(o.c / word_chars, 0) AS line_share FROM t LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_P.min_words} OR 100 * n_repeat_words > {_P.max_repeat_percent} * n_words AS base_failed, NOT (n_words < {_P.min_words} OR 100 * n_repeat_words > {_P.max_repeat_percent} * n_words OR failed OR line_share > {_P.line_share}::DOUBLE) AS kept, round(top_share, 9) AS top_share, round(line_share, 9) AS line_share FROM f"""

# A checksum is taken byte by byte over a table of 256 remainders; near words meet on what is left without one letter.
_POLY = 0xEDB88320
OP11 = f"""WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, {_POLY}) ELSE a // 2 END, CAST(i AS BIGINT))) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, '{_UP}', '{_LOW}') AS run, count(*) AS n FROM r GROUP BY 1, 2),
x AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM l),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(len(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM x, crc_table),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(n) >= 2),
w AS (SELECT word, n FROM v WHERE length(word) >= 7),
d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM d),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT e.word, e.n, w.word, w.n FROM e JOIN w ON w.word = e.rest
  UNION SELECT w.word, w.n, e.word, e.n FROM e JOIN w ON w.word = e.rest),
c AS (SELECT word, count(*) AS n_near FROM p GROUP BY 1),
f AS (SELECT word, near AS form, near_n AS form_n FROM p WHERE near_n >= 10 * n QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
t AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n FROM w LEFT JOIN c USING (word) LEFT JOIN f USING (word)),
g(word, reached, step) AS (SELECT word, word, 0 FROM t UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.reached)
SELECT t.word, form, g.reached AS root, n, n_near, form_n FROM t JOIN (SELECT word, arg_max(reached, step) AS reached FROM g GROUP BY 1) g ON g.word = t.word""".replace("WITH crc_table", "WITH RECURSIVE crc_table", 1)

OP12 = """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256 FROM t
WINDOW g AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""

ORACLE_SQL = {"op2_multi_index_hashing": OP2, "op5_minhash_near_dedup": OP5, "op7_url_filter": OP7, "op9_repetition_rules": OP9, "op11_spelling_variants": OP11, "op12_exact_dedup": OP12}
