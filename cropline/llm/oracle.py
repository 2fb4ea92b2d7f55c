"""DuckDB statements of the registered queries that SQL can express, written from the contracts, not from the operators."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"'[^ \t\n\x0B\x0C\r]+'"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, {WORD}) AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS full_lines FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT rid, win FROM windows GROUP BY rid, win HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT windows.rid, unnest(range(i, i + 5)) AS p FROM windows JOIN again USING (rid, win)) GROUP BY rid),
lines AS (SELECT rid, source, x, no FROM (
    SELECT rid, source, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS no FROM d)
    WHERE regexp_matches(x, {WORD})),
norms AS (SELECT rid, source, no, len(regexp_extract_all(x, {WORD})) AS words, regexp_replace(translate(
    array_to_string(regexp_extract_all(x, {WORD}), ' '), '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g') AS norm FROM lines),
common AS (SELECT source, norm FROM norms GROUP BY source, norm HAVING count(DISTINCT rid) > 5),
gone AS (SELECT rid, sum(words) AS words, count(*) AS n FROM norms
         JOIN common ON norms.norm = common.norm AND norms.source IS NOT DISTINCT FROM common.source GROUP BY rid),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.words, 0) AS BIGINT) AS n_removed_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_lines
      FROM w LEFT JOIN covered USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 10 AND 2 * (n_words - n_removed_words) >= n_words AS kept FROM b
"""

TOKEN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {TOKEN}) AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {TOKEN}) AS ws FROM benchmark),
grams AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (
    SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i
    FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
windows AS (SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (
    SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT DISTINCT rid, i, windows.size, item_id FROM windows JOIN grams USING (gram, size)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(low.b, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

OP7 = """
WITH RECURSIVE l AS (SELECT doc_id, CAST(no AS INTEGER) AS line_no, trim(x, ' ' || chr(9) || chr(13)) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)),
k AS (SELECT * FROM l WHERE length(line) >= 24),
u AS (SELECT line, length(line) AS n, length(line) // 3 AS s FROM (SELECT DISTINCT line FROM k)),
p AS (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + 2
      WHERE a.line <> b.line AND (contains(b.line, a.line[1:a.s]) OR contains(b.line, a.line[a.s + 1:2 * a.s])
            OR contains(b.line, a.line[2 * a.s + 1:a.n])) AND levenshtein(a.line, b.line) <= 2),
links AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT line, least(line, coalesce(min(b), line)) AS class FROM u LEFT JOIN reach ON a = line GROUP BY line),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a),
firsts AS (SELECT class, min({'d': doc_id, 'n': line_no}) AS f FROM k JOIN named USING (line) GROUP BY class)
SELECT k.doc_id, k.line_no, f.d AS class_doc, f.n AS class_line, CAST(coalesce(degrees.n, 0) AS BIGINT) AS n_links,
       f.d <> k.doc_id OR f.n <> k.line_no AS removed
FROM k JOIN named USING (line) JOIN firsts USING (class) LEFT JOIN degrees ON degrees.a = k.line
"""

#: Damage, order and faults of conversations; then the cheapest edits row by row over the four states of the right role order.
OP11 = r"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab
    FROM range(256) AS t(b)),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                            lambda x: CAST(ord(x) AS BIGINT)) AS chars FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(chars, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS fault
      FROM c, bits),
h AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM n),
r AS (SELECT conv_id, turn, role, text, pos, role[1:1] AS ini, CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\x0C\r]') THEN 'b'
             WHEN seen > 1 THEN 'd' WHEN regexp_matches(text, '[^ \t\n\x0B\x0C\r.!?][ \t\n\x0B\x0C\r]*$') THEN 't' ELSE '' END AS fault FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
                  count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated FROM r GROUP BY conv_id),
pairs AS (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM r),
bad AS (SELECT conv_id, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []),
    (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']),
    (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])) AS t(p, q, cost, audit, lines)),
steps AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) AS t(p, q, ini)),
edits AS (
    SELECT conv_id, pos, p, p AS q, 4 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS lines FROM r, range(4) AS t(p)
    UNION ALL SELECT conv_id, pos, p, q, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM r JOIN steps USING (ini) WHERE fault IN ('', 't')
    UNION ALL SELECT conv_id, pos, p, q, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', [CASE steps.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM r, steps WHERE fault IN ('', 't') AND steps.ini <> 's'),
way(conv_id, pos, state, best) AS (
    SELECT conv_id, 0, q, {'cost': cost, 'audit': audit, 'lines': CAST(lines AS VARCHAR[])} FROM (SELECT DISTINCT conv_id FROM r), ins WHERE p = 0
    UNION ALL
    SELECT way.conv_id, way.pos + 1, ins.q, min({'cost': best.cost + edits.cost + ins.cost, 'audit': best.audit || edits.audit || ins.audit,
                                                 'lines': best.lines || edits.lines || CAST(ins.lines AS VARCHAR[])})
    FROM way JOIN edits ON edits.conv_id IS NOT DISTINCT FROM way.conv_id AND edits.pos = way.pos + 1 AND edits.p = way.state
    JOIN ins ON ins.p = edits.q GROUP BY way.conv_id, way.pos, ins.q),
ends AS (SELECT way.conv_id, min(best) AS best FROM way JOIN (SELECT conv_id, max(pos) AS pos FROM r GROUP BY conv_id) AS n
         ON n.conv_id IS NOT DISTINCT FROM way.conv_id AND n.pos = way.pos WHERE state IN (0, 3) GROUP BY way.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE: dict[str, str] = {
    "op1_line_frequency": OP1, "op2_decontamination": OP2, "op7_line_edit_join": OP7, "op8_ngram_jaccard": OP8,
    "op11_conversation_repair": OP11,
}
