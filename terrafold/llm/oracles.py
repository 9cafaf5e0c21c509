"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op2_poisson_mixing": """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS all_n, sum(power(CAST(n AS DOUBLE), 0.7)) AS all_target FROM n),
rates AS (SELECT source, 1.0::DOUBLE * (power(CAST(n AS DOUBLE), 0.7) / all_target) * all_n / n AS rate FROM n, whole),
terms(source, rate, k, p, f) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), f + p * rate / (k + 1) FROM terms WHERE k < rate + 10 * sqrt(rate) + 10),
d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS key FROM documents),
u AS (SELECT *, (CAST('0x' || substr(md5(key || ':mix-1'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.key, t.rate, CAST(min(t.k) AS INTEGER) AS copies
  FROM u JOIN terms t ON u.source IS NOT DISTINCT FROM t.source AND t.f >= u.u GROUP BY ALL),
e AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM c)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS mix_rate, copies AS mix_copies, CAST(copy AS INTEGER) AS mix_copy,
  round((CAST('0x' || substr(md5(key || ':' || copy || ':mix-1:order'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE, 12) AS mix_order
FROM e""",
    # the table's texts hold no tool JSON: calls and results are derived as `turns_as_calls` says
    "op4_tool_calls": """
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, CAST(conv_id AS VARCHAR) AS c FROM conversations),
k AS (SELECT *, CASE
    WHEN role = 'assistant' AND n % 11 = 0 THEN c || ':' || (turn + 1)
    WHEN role = 'assistant' AND n % 13 = 0 THEN 'none:' || turn
    WHEN role = 'assistant' THEN c || ':' || (turn - 1)
    WHEN role = 'user' AND n % 6 = 0 THEN c || ':' || (turn + 2)
    WHEN role = 'user' AND n % 9 = 0 THEN c || ':' || (turn - 2) END AS result_of FROM m),
calls AS (
  SELECT conv_id, turn, 1 AS pos, CASE WHEN n % 5 = 0 THEN c || ':' || (turn - 2) ELSE c || ':' || turn END AS id, CASE WHEN n % 7 = 0 THEN 'search' ELSE 'reply' END AS name,
    CASE WHEN n % 3 = 0 THEN '{"chars":"' || n || '"}' ELSE '{"chars":' || n || '}' END AS args, n % 7 <> 0 AND n % 3 <> 0 AS valid FROM k WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 2, c || ':' || turn || ':b', 'reply', '{"chars":' || n || ',"extra":1}', FALSE FROM k WHERE role = 'user' AND n % 4 = 0),
owner AS (SELECT conv_id, id, min(turn) AS call_turn FROM calls GROUP BY ALL),
told AS (SELECT DISTINCT conv_id, result_of AS id FROM k WHERE result_of IS NOT NULL),
answered AS (SELECT conv_id, call_turn AS turn, count(*) AS n_answered FROM owner JOIN told USING (conv_id, id) GROUP BY ALL),
arc AS (SELECT k.conv_id, k.turn, max(o.call_turn) AS up FROM k JOIN owner o ON o.conv_id = k.conv_id AND o.id = k.result_of GROUP BY ALL),
reach(conv_id, turn, top) AS (SELECT conv_id, turn, up FROM arc UNION SELECT r.conv_id, r.turn, a.up FROM reach r JOIN arc a ON a.conv_id = r.conv_id AND a.turn = r.top),
cycle AS (SELECT DISTINCT conv_id, turn FROM reach WHERE top = turn),
free AS (SELECT * FROM arc ANTI JOIN cycle USING (conv_id, turn)),
way(conv_id, turn, top, behind) AS (
  SELECT DISTINCT conv_id, turn, turn, 0 FROM k
  UNION ALL SELECT w.conv_id, w.turn, f.up, w.behind + CASE WHEN f.up >= f.turn THEN 1 ELSE 0 END FROM way w JOIN free f ON f.conv_id = w.conv_id AND f.turn = w.top),
level AS (SELECT conv_id, turn, max(top + behind) AS level FROM way GROUP BY ALL),
made AS (SELECT conv_id, turn, count(*) AS n_calls, sum(CASE WHEN valid THEN 0 ELSE 1 END) AS n_invalid,
    string_agg('{"arguments":' || args || ',"id":' || CAST(to_json(id) AS VARCHAR) || ',"name":' || CAST(to_json(name) AS VARCHAR) || ',"valid":' || valid || '}', ',' ORDER BY pos) AS json FROM calls GROUP BY ALL)
SELECT k.conv_id, k.turn, CAST(l.level AS BIGINT) AS level, y.turn IS NOT NULL AS cyclic, CAST(coalesce(d.n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(a.n_answered, 0) AS BIGINT) AS n_answered,
  CAST(coalesce(d.n_invalid, 0) AS BIGINT) AS n_invalid, k.result_of IS NOT NULL AND o.call_turn IS NULL AS orphan,
  '{"calls":[' || coalesce(d.json, '') || '],"content":' || CAST(to_json(k.text) AS VARCHAR) || ',"result_of":' || CAST(to_json(coalesce(k.result_of, '')) AS VARCHAR) || ',"role":' || CAST(to_json(k.role) AS VARCHAR) || '}' AS json
FROM k JOIN level l USING (conv_id, turn) LEFT JOIN cycle y USING (conv_id, turn) LEFT JOIN made d USING (conv_id, turn) LEFT JOIN answered a USING (conv_id, turn)
  LEFT JOIN owner o ON o.conv_id = k.conv_id AND o.id = k.result_of""",
    "op11_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.r, k.doc_id, k.pos, k.line, often.key IS NOT NULL AND k.doc_id <> often.top AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id""",
    "op13_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
ng AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS all_n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS all_n FROM c GROUP BY ALL),
p AS (SELECT kept.lang, ng.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // CAST(ng.all_n + 2 * v.v AS BIGINT) AS p
  FROM kept JOIN v ON v.lang = kept.lang JOIN ng ON ng.lang = kept.lang LEFT JOIN c ON c.lang = kept.lang AND c.source = ng.source AND c.term = kept.term),
q AS (SELECT x.lang, x.term, 1 + (1000000000 * (x.n + 2)) // CAST(nl.all_n + 2 * v.v AS BIGINT) AS q
  FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) x JOIN nl ON nl.lang = x.lang JOIN v ON v.lang = x.lang),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
