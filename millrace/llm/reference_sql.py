"""DuckDB SQL of the operators that SQL can express: the repair of conversations and the codes of vectors."""

from __future__ import annotations

from millrace.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE

#: CRC-32 of an ASCII text ``k``, bit by bit.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce("
    "list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
)

#: Each step of the recursion consumes one row, after at most two inserts; a state keeps its cheapest, then least, audit.
OP11_SQL = rf"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), marked AS (SELECT *, {_CRC} % 20 AS fault FROM plain),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c.copy
  FROM marked, (VALUES (0), (1)) AS c(copy) WHERE fault <> 0 AND (c.copy = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS sound FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, sound = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), faults AS (
  SELECT *, again AND NOT blank AS duplicate, NOT blank AND NOT again AND right(sound, 1) NOT IN ('.', '!', '?') AS truncated FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated,
         sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id
),
-- states: 0 start, 1 after s, 2 after u, 3 after a; inserts lead on to the state in which the next row is taken
jumps(q, letters, price, q2, lines) AS (VALUES (0, '', 0, 0, ''), (0, 'I', 3, 2, E'user:\n'), (0, 'II', 6, 3, E'user:\nassistant:\n'), (1, '', 0, 1, ''), (1, 'I', 3, 2, E'user:\n'), (1, 'II', 6, 3, E'user:\nassistant:\n'),
  (2, '', 0, 2, ''), (2, 'I', 3, 3, E'assistant:\n'), (2, 'II', 6, 2, E'assistant:\nuser:\n'), (3, '', 0, 3, ''), (3, 'I', 3, 2, E'user:\n'), (3, 'II', 6, 3, E'user:\nassistant:\n')),
moves(q, letter, initial, price, q2, wanted) AS (VALUES (0, 'D', NULL, 4, 0, NULL), (1, 'D', NULL, 4, 1, NULL), (2, 'D', NULL, 4, 2, NULL), (3, 'D', NULL, 4, 3, NULL),
  (0, 'K', 's', 0, 1, NULL), (0, 'K', 'u', 0, 2, NULL), (1, 'K', 'u', 0, 2, NULL), (2, 'K', 'a', 0, 3, NULL), (3, 'K', 'u', 0, 2, NULL),
  (0, 'R', NULL, 3, 2, 'user'), (1, 'R', NULL, 3, 2, 'user'), (2, 'R', NULL, 3, 3, 'assistant'), (3, 'R', NULL, 3, 2, 'user')),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS lines, n FROM counted
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.lines, n FROM (
    SELECT p.conv_id, p.i + 1 AS i, m.q2 AS q, any_value(p.n) AS n, min({{'cost': p.cost + j.price + m.price + CASE WHEN f.truncated AND m.letter <> 'D' THEN 3 ELSE 0 END, 'audit': p.audit || j.letters || m.letter,
           'lines': p.lines || j.lines || CASE WHEN m.letter = 'D' THEN '' ELSE coalesce(m.wanted, f.role) || ':' || f.text || E'\n' END}}) AS b
    FROM paths p JOIN jumps j ON j.q = p.q JOIN moves m ON m.q = j.q2 JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    WHERE (m.letter = 'D' OR NOT (f.blank OR f.duplicate)) AND (m.letter <> 'K' OR m.initial = f.initial)
    GROUP BY p.conv_id, p.i, m.q2)
), ended AS (
  SELECT p.conv_id, min({{'cost': p.cost + j.price, 'audit': p.audit || j.letters, 'lines': p.lines || j.lines}}) AS b FROM paths p JOIN jumps j ON j.q = p.q WHERE p.i = p.n AND j.q2 IN (0, 3) GROUP BY p.conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
       coalesce(e.b.cost, 0)::BIGINT AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(left(e.b.lines, length(e.b.lines) - 1), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds as a chain of common tables: assign every component's part to the nearest entry, then floor the means."""
    nearest = """near{k} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM cells v JOIN book{k} b ON b.p = v.p AND b.o = v.o GROUP BY v.r, v.p, b.e) GROUP BY r, p)"""
    update = """book{n} AS MATERIALIZED (SELECT b.p, b.e, b.o, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT v.p, n.best.e AS e, v.o, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
      FROM cells v JOIN near{k} n ON n.r = v.r AND n.p = v.p GROUP BY v.p, n.best.e, v.o) m ON m.p = b.p AND m.e = b.e AND m.o = b.o)"""
    chain = [step for k in range(rounds) for step in (nearest.format(k=k), update.format(k=k, n=k + 1))] + [nearest.format(k=rounds)]
    return f"""
WITH good AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT r, (pos - 1) // (w // {parts}) AS p, (pos - 1) % (w // {parts}) AS o, floor({SCALE} * x::DOUBLE)::HUGEINT AS x FROM (SELECT r, len(embedding) AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM good)
), book0 AS MATERIALIZED (SELECT p, r AS e, o, x FROM cells WHERE r < {entries}),
{', '.join(chain)},
coded AS (SELECT r, string_agg(format('{{:02x}}', best.e::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT g.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY g.label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, o)) FROM book{rounds}) AS codebooks_sha256, g.label
FROM good g JOIN coded c ON c.r = g.r
"""


OP12_SQL = codes_sql()
