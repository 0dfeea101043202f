"""DuckDB SQL for the queries of this folder."""

from __future__ import annotations



def _vector_codes(rounds: int = 6) -> str:
    """Product codes by plain comparison of every part with every entry."""
    steps = ["""WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, k, e[k * len(e) // 8 + 1 : (k + 1) * len(e) // 8] AS x FROM v, range(8) t(k)),
c0 AS MATERIALIZED (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS entry, x
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))"""]
    gap = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.k, p.x, arg_min(c.entry, ({gap}, c.entry)) AS entry, CAST(min({gap}) AS BIGINT) AS error
  FROM p JOIN c{r} c ON c.k = p.k GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT k, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{r}, range(1, 513) t(i)
  WHERE i <= len(x) GROUP BY k, entry, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.k, c.entry, coalesce(n.x, c.x) AS x FROM c{r} c
  LEFT JOIN (SELECT k, entry, list(y ORDER BY i) AS x FROM m{r} GROUP BY k, entry) n USING (k, entry))""")
    last = f"a{rounds}"
    return ",\n".join(steps) + f""",
d AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY k) AS code,
             CAST(sum(error) AS BIGINT) AS error FROM {last} GROUP BY vec_id, label),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM d, b
"""


SQL: dict[str, str] = {
    "op4_va_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l'))
            + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + 15 AS size,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS learn FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(learn)) AS BIGINT) AS loss_chars,
       sha256(string_agg(learn, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS e FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m
              ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
""",
    "op12_vector_codes": _vector_codes(),
    "op1_substring_dedup": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS u FROM documents),
w AS MATERIALIZED (
  SELECT rid, i, u[i] AS word, CASE WHEN i + 34 <= len(u) THEN md5(array_to_string(u[i:i + 34], ' ')) END AS h
  FROM d, unnest(range(1, len(u) + 1)) t(i)),
r AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
c AS (
  SELECT w.rid, w.i, w.word, max(CASE WHEN r.h IS NOT NULL THEN 1 ELSE 0 END)
         OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN r ON r.h = w.h),
k AS (SELECT rid, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS u FROM documents),
s AS MATERIALIZED (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(u) >= 5
         THEN list_transform(range(1, len(u) - 3), lambda i: md5(array_to_string(u[i:i + 4], ' ')))
         WHEN len(u) > 0 THEN [md5(array_to_string(u, ' '))] ELSE [] END) AS k FROM d),
t AS MATERIALIZED (SELECT rid, len(k) AS n, unnest(k) AS h FROM s),
links AS MATERIALIZED (
  SELECT a.rid AS x, b.rid AS y FROM t a JOIN t b ON a.h = b.h AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT rid AS x, rid AS y FROM s
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.k) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT r.x, min(o.doc_id) AS c FROM reach r JOIN s o ON o.rid = r.y GROUP BY r.x) m ON m.x = s.rid
""",
}
