"""SQL for the queries that SQL can express, over the driver's tables in DuckDB."""

from __future__ import annotations

from .chat import HEAD
from .common import LOWER, UPPER
from .urls import RULES

WORDS = "[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+"


def folded(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


ESCAPE = "([<\\[])(\\\\*)(/?s>|/?INST\\]|<SYS>>|</SYS>>|\\|[^|<>]*\\|>)"
SAFE = f"regexp_replace(text, '{ESCAPE}', '\\1\\\\\\2\\3', 'g')"
SAFE_ROLE = f"regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{ESCAPE}', '\\1\\\\\\2\\3', 'g')"

OP2 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(HEAD)} + sum(CASE WHEN role = 'assistant' THEN length({SAFE}) + 4 ELSE length({SAFE_ROLE}) + length({SAFE}) + 16 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def op4(terms: int = 150, follow: float = 0.85) -> str:
    """Ranks as the sum of what arrives after 0, 1, 2 ... links, scaled to 1."""
    rules = ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in RULES)
    link = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']?((?:https?:)?//[^\"''\\s>]+)"
    out = [
        f"""WITH RECURSIVE rules(kind, h, p) AS (VALUES {rules}),
pg AS (SELECT page_id, html, {host('url')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS kind FROM pg, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
judged AS (SELECT pg.*, rule, kind FROM pg LEFT JOIN fits USING (page_id)),
hosts AS (SELECT host, count(*) FILTER (kind = 'allow') AS a, count(*) FILTER (kind = 'block') AS b FROM judged WHERE host <> '' GROUP BY host),
found AS (SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS u FROM pg),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")} AS dst FROM found) x WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst)"""
    ]
    for name, col, src, dst in (("t", "a", "src", "dst"), ("d", "b", "dst", "src")):
        out.append(f"{name}e AS MATERIALIZED (SELECT {src} AS s, {dst} AS d, n / sum(n) OVER (PARTITION BY {src}) AS share FROM links)")
        out.append(f"{name}x(i, host, x) AS (SELECT 0, host, {col} / CAST(sum({col}) OVER () AS DOUBLE) FROM hosts WHERE {col} > 0 UNION ALL SELECT i + 1, d, sum({follow} * share * x) FROM {name}x JOIN {name}e ON host = s WHERE i < {terms} GROUP BY i, d)")
        out.append(f"{name} AS (SELECT host, sum(x) / sum(sum(x)) OVER () AS rank FROM {name}x GROUP BY host)")
    return ",\n".join(out) + " SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN coalesce(d.rank, 0) > 0.5 * (coalesce(t.rank, 0) + coalesce(d.rank, 0)) THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN t USING (host) LEFT JOIN d USING (host)"


OP7 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({folded('text')}, '{WORDS}') AS ws FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({folded('text')}, '{WORDS}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, len(v) AS n, array_to_string(v, ' ') AS s FROM (SELECT item, list_slice(ws, i, i + least(len(ws), 10) - 1) AS v FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0) x) y),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n) x),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) x GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = e.vec_id) AS component_id, (SELECT min(b) FROM reach WHERE a = e.vec_id) = e.vec_id AS kept
FROM embeddings e"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d) x),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM win) x WHERE r > 1),
runs AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM late),
spans AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM runs) x GROUP BY doc_id, g),
edges AS (SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS b FROM spans UNION ALL SELECT doc_id, 0, min(lo) FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS kept FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN rest USING (doc_id)"""

#: White space at the ends of a line, and what a word has none of.
BLANK = "' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160) || chr(12288)"
NTH = range(1, 6)


def least_run(step: str) -> str:
    """The shortest run of lines with five words from a line on (lead) or up to it (lag): (lines, number of lines)."""
    out = "NULL"
    for k in reversed(NTH):
        total = " + ".join(f"coalesce({step}(n, {j}) OVER w, 0)" for j in range(k))
        lines = ", ".join(f"{step}(line, {j}) OVER w" for j in (range(k) if step == "lead" else range(k - 1, -1, -1)))
        out = f"CASE WHEN {step}(n, {k - 1}) OVER w IS NOT NULL AND {total} >= 5 THEN [{lines}] ELSE {out} END"
    return out


OP8 = f"""
WITH parts AS (
  SELECT doc_id, place, raw, trim(raw, {BLANK}) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
        WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL GROUP BY doc_id HAVING count(*) = 1)) x),
lines AS (
  SELECT doc_id, place, line, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i
  FROM parts WHERE line <> ''),
runs AS (
  SELECT doc_id, i, {least_run("lead")} AS ahead, {least_run("lag")} AS behind
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
places AS (
  SELECT doc_id, i, i + len(ahead) - 1 AS last, ahead AS run FROM runs WHERE ahead IS NOT NULL
  UNION ALL SELECT doc_id, i - len(behind) + 1, i, behind FROM runs WHERE behind IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i
  FROM (SELECT doc_id, i, last, min(doc_id) OVER (PARTITION BY run) AS owner FROM places) x WHERE owner < doc_id),
kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, trim(coalesce(string_agg(p.raw, chr(10) ORDER BY p.place) FILTER (g.i IS NULL), ''), chr(10)) AS text
  FROM parts p LEFT JOIN lines l ON l.doc_id = p.doc_id AND l.place = p.place LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
  GROUP BY p.doc_id HAVING count(g.i) > 0)
SELECT d.doc_id, CAST(len(list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: trim(x, {BLANK}) <> '')) AS BIGINT) AS n_lines,
  coalesce(k.n_removed, 0) AS n_removed, CAST(length(coalesce(k.text, d.text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(k.text, d.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

#: The checksum is the table-driven crc32 with the polynomial 0xEDB88320, over the bytes of the UTF-8 text.
OP11 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) x GROUP BY doc_id, run),
hexed AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
bytes AS (SELECT run, c, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h // 256, t[(xor(h, x) & 255) + 1]))) AS h FROM bytes, crc_table),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) x),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
form AS (
  SELECT w.word, min(x.other) AS form, min(b.most) AS form_n
  FROM words w JOIN best b USING (word) JOIN near x ON x.word = w.word AND x.n = b.most WHERE b.most >= 2 * w.n GROUP BY w.word),
walk AS (SELECT word, form AS root FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.root),
ends AS (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM form))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN form f USING (word) LEFT JOIN ends e USING (word)"""

ORACLE_SQL = {"op2_chat_format": OP2, "op4_url_filter": op4(), "op7_decontaminate": OP7, "op8_line_dedup": OP8, "op9_vector_near_dedup": OP9, "op10_substring_dedup": OP10, "op11_spelling_variants": OP11}
