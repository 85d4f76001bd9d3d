"""DuckDB SQL of the queries that SQL can express."""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i:
      substr('{_BASE32}', 1 + (((('0x' || substr(sha1(h), 1 + (i // 4) * 5, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lo FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lo THEN lo END AS refers_to
FROM f
"""


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_OP3 = f"""
WITH iw AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
its AS (SELECT item_id, least(len(w), 5) AS wd, unnest(list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: array_to_string(w[k:k + least(len(w), 5) - 1], ' ')))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM its GROUP BY item_id),
dw AS (SELECT doc_id, {_words("text")} AS w FROM documents),
ds AS (SELECT doc_id, wd, unnest(list_distinct(list_transform(range(1, len(w) - wd + 2), lambda k: array_to_string(w[k:k + wd - 1], ' ')))) AS s FROM dw, (SELECT DISTINCT wd FROM its) WHERE len(w) >= wd),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (wd, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item_shingles
"""

_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS total,
    sum(23 + length(replace(replace(replace(role, '\', '\b'), '<|', '<\p'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\b'), '<|', '<\p'))) OVER o AS upto
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = total)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_have >= 80 * (p.n_shingles + q.n_shingles - both_have)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n_shingles, c.component_id FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = n.doc_id
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(right('000' || p, 3) AS INT), 999) <= 255))"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k: CASE WHEN k % 2 = 0 THEN substr(d, length(d) - k, 1)::INT WHEN substr(d, length(d) - k, 1)::INT > 4 THEN substr(d, length(d) - k, 1)::INT * 2 - 9 ELSE substr(d, length(d) - k, 1)::INT * 2 END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
)


def _found(kind: int, pattern: str) -> str:
    return f"SELECT row, doc_id, {kind} AS kind, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM t"


def _lengths(values: str) -> str:
    return f"coalesce(list_sum(list_transform({values}, lambda g: length(g))), 0)"


_OP1 = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(k, p) for k, (_, p, _) in enumerate(_KINDS))}),
e AS (SELECT row, doc_id, kind, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, ({_lengths("gs[1:i]")} + {_lengths("ms[1:i - 1]")})::BIGINT AS start
 FROM f, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)),
b AS (SELECT *, start + length(m) AS stop FROM e WHERE CASE kind {" ".join(f"WHEN {k} THEN {c}" for k, (_, _, c) in enumerate(_KINDS))} END),
ents AS (SELECT DISTINCT row, kind || ' ' || lower(m) AS entity, 0 AS cls FROM b
 UNION ALL SELECT DISTINCT row, 'class ' || kind || ' ' || CASE kind WHEN 0 THEN split_part(lower(m), '@', 2) WHEN 1 THEN array_to_string(string_split(m, '.')[1:3], '.') WHEN 2 THEN left(d, 6) ELSE left(d, 4) END, 1 FROM b),
live AS (SELECT * FROM ents JOIN (SELECT entity, count(*) AS n_entity FROM ents GROUP BY entity, cls HAVING count(*) >= 2 + cls AND count(*) < (SELECT count(*) FROM t)) USING (entity)),
words AS (SELECT DISTINCT row, lower(w) AS term FROM (SELECT row, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) AS w FROM t) WHERE regexp_matches(lower(w), '^\\p{{L}}')),
pairs AS (SELECT entity, cls, n_entity, term, count(*) AS n_both FROM live JOIN words USING (row) GROUP BY ALL HAVING count(*) >= 2 + cls),
told AS (SELECT entity, term FROM pairs JOIN (SELECT term, count(*) AS n_term FROM words GROUP BY ALL) USING (term), (SELECT count(*)::DOUBLE AS n FROM t) WHERE n_term <= n_both * pow(n / n_entity, 1 - 0.8) * (1 + 1e-12)),
here AS (SELECT DISTINCT row, term FROM live JOIN told USING (entity) JOIN words USING (row, term)),
runs AS (SELECT row, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS ws, string_split_regex(t, '[\\p{{L}}\\p{{N}}]+') AS gs FROM t WHERE row IN (SELECT row FROM here)),
places AS (SELECT row, lower(ws[k]) AS term, length(ws[k]) AS n, sum(length(gs[k]) + length(ws[k])) OVER (PARTITION BY row ORDER BY k) AS stop FROM runs, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS k)),
added AS (SELECT row, 4 AS kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM places JOIN here USING (row, term)),
every AS (SELECT row, kind, start, stop FROM b UNION ALL SELECT row, kind, start, stop FROM added a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.row = a.row AND b.start < a.stop AND a.start < b.stop)),
s AS (SELECT row, string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS spans,
 string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY kind, start) FILTER (kind < 4) AS base,
 {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, (n, _, _) in enumerate(_KINDS))} FROM every GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n, _, _ in _KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (row)
"""

SQL = {"op1_pii": _OP1, "op2_warc": _OP2, "op3_decontamination": _OP3, "op4_chat": _OP4, "op5_ngram_join": _OP5}


def _crc_table() -> list[int]:
    """The 256 steps of the reflected checksum 0xEDB88320."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return table


def _crc32(text: str) -> str:
    """Unsigned checksum of a text's UTF-8 bytes."""
    data = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    step = "xor(acc >> 8, crc[1 + (xor(acc, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda acc, b: {step}), 4294967295)"


_OP12 = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, {_crc32("key")} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, {_crc_table()}::BIGINT[] AS crc FROM l WHERE length(run) >= 7)),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS gone FROM w, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.gone = b.gone AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM k a JOIN w ON a.gone = w.word
  UNION SELECT w.word, a.word, a.n FROM k a JOIN w ON a.gone = w.word),
b AS (SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS best FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, n FROM f UNION ALL SELECT c.word, f.form, f.form_n FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, f.n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, n) AS root FROM c GROUP BY word) USING (word)
"""

SQL |= {"op12_spelling_variants": _OP12}

_OP13 = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""

SQL |= {"op13_hard_negatives": _OP13}
