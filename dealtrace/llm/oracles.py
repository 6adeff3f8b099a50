"""SQL twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Targets by filling sources up in the order of size to weight, as integers up
# to the last division; documents by the hash of their id until the rest is full.
OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents
),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sources),
weighed AS (SELECT *, [5, 2, 1][CAST(r % 3 AS INTEGER) + 1] AS w FROM ranked),
filled AS (
  SELECT *,
    CAST((sum(s) OVER ()) - 3 * coalesce(sum(s) OVER f, 0) AS BIGINT) AS remaining,
    CAST((sum(w) OVER ()) - coalesce(sum(w) OVER f, 0) AS BIGINT) AS weights
  FROM weighed
  WINDOW f AS (ORDER BY CAST(s AS DOUBLE) / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shared AS (
  SELECT *, (SELECT CAST(x.remaining AS DOUBLE) / x.weights FROM filled x
    WHERE 3 * x.s * x.weights >= x.w * x.remaining ORDER BY CAST(x.s AS DOUBLE) / x.w, x.r LIMIT 1) AS unit
  FROM filled
),
targets AS (
  SELECT source, s, CASE WHEN 3 * s * weights < w * remaining THEN CAST(3 * s AS DOUBLE)
    ELSE least(w * unit, CAST(3 * s AS DOUBLE)) END AS target
  FROM shared
),
budgets AS (
  SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS copies FROM targets
),
s0 AS (
  SELECT source, copies, target - copies * s AS rest, CAST(0 AS BIGINT) AS lo, CAST('inf' AS DOUBLE) AS room FROM budgets
)@STEPS@
SELECT d.doc_id, d.size, b.s AS source_size, b.target,
  CAST(d.size * (b.copies + CASE WHEN @TAKEN@ THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d
JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
@JOINS@"""

# One threshold of every source: sums in the order of hashes over the documents
# that may be taken, up to where the budget ends.
_STEP = """,
h{i} AS (
  SELECT d.source, d.hash, CAST(sum(d.size) AS BIGINT) AS n, any_value(p.rest) AS rest
  FROM sized d JOIN s{before} p ON d.source IS NOT DISTINCT FROM p.source
  WHERE d.hash >= p.lo AND d.size <= p.room GROUP BY d.source, d.hash
),
r{i} AS (
  SELECT *, coalesce(CAST(sum(n) OVER (PARTITION BY source ORDER BY hash
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM h{i}
),
e{i} AS (SELECT * FROM r{i} WHERE before <= rest
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY hash DESC) = 1),
t{i} AS (
  SELECT p.source, p.copies, p.lo, p.room, coalesce(e.hash, 0) + CASE WHEN e.before + e.n <= p.rest THEN 1 ELSE 0 END
    AS below, p.rest - coalesce(e.before, 0) - CASE WHEN e.before + e.n <= p.rest THEN e.n ELSE 0 END AS left_over
  FROM s{before} p LEFT JOIN e{i} e ON p.source IS NOT DISTINCT FROM e.source
),
s{i} AS (SELECT source, copies, left_over AS rest, greatest(lo, below) AS lo, left_over AS room FROM t{i})"""
OP2 = (
    OP2.replace("@STEPS@", "".join(_STEP.format(i=i, before=i - 1) for i in (1, 2, 3)))
    .replace(
        "@TAKEN@", " OR ".join(f"(d.hash >= t{i}.lo AND d.hash < t{i}.below AND d.size <= t{i}.room)" for i in (1, 2, 3))
    )
    .replace("@JOINS@", "\n".join(f"JOIN t{i} ON d.source IS NOT DISTINCT FROM t{i}.source" for i in (1, 2, 3)))
)

# Lengths by the template: 34 characters of marks a turn, one more for each
# control string.
OP3 = r"""
WITH rows_all AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t
  FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'),
    (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
),
turns AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '([<\[])(\\*)(\||/?s>|/?INST\])')) AS escapes
  FROM rows_all
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(32 + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

# Units by the contract's pattern; the parts are joined lists of units.
OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
),
drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
    CAST('0x' || substr(hash, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(hash, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(hash, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

# Six rounds written out one after another; every distance is computed.
OP11 = r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS v FROM kept, range(8) AS r(p)
),
c0 AS MATERIALIZED (SELECT p, id - 1 AS j, v FROM parts WHERE id <= 16)@ROUNDS@,
books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, j, pos)) AS codebooks_sha256
  FROM (SELECT p, j, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c6)
),
coded AS (
  SELECT id, string_agg(format('{:02x}', best.j), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a6 GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id), books
"""
_ASSIGNED = """,
a{i} AS MATERIALIZED (
  SELECT x.id, x.p, min({{'d': CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
    AS BIGINT), 'j': c.j}}) AS best
  FROM parts x JOIN c{i} c USING (p) GROUP BY x.id, x.p
)"""
_MOVED = """,
m{i} AS (
  SELECT p, j, list(x ORDER BY pos) AS v FROM (
    SELECT p, j, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (
      SELECT a.p, a.best.j AS j, unnest(x.v) AS x, generate_subscripts(x.v, 1) AS pos
      FROM a{i} a JOIN parts x USING (id, p)) GROUP BY p, j, pos) GROUP BY p, j
),
c{after} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (p, j))"""
OP11 = OP11.replace(
    "@ROUNDS@",
    "".join(_ASSIGNED.format(i=i) + _MOVED.format(i=i, after=i + 1) for i in range(6)) + _ASSIGNED.format(i=6),
)

LLM_ORACLES: dict[str, str] = {"op2_source_mix": OP2, "op3_chat_format": OP3, "op11_part_codes": OP11, "op13_fill_middle": OP13}
