"""DuckDB text of the queries that SQL can express."""

SQL: dict[str, str] = {}

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op1"] = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
        FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, ks WHERE len(w) >= k),
occ AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t FROM pos) JOIN win USING (k, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

SQL["op4"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT doc_id, s FROM sh WHERE s IN (SELECT s FROM sh GROUP BY 1 HAVING count(*) > 1)),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM common a JOIN common b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
both_ways AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT y, r FROM reach JOIN both_ways ON x = doc_id)
SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1"""

_SPACE = r"[\x20\x09-\x0D]"


def _quality(docs: str) -> str:
    """CTEs up to ``judged`` (doc_id, counts, base_failed, kept) over a relation of documents."""
    bin_of = "(greatest(length(bin({0})) - 4, 0) * 8 + ({0} >> greatest(length(bin({0})) - 4, 0)))"
    fences = """SELECT {keys} measure, max(total) AS total,
  min(CASE WHEN 4 * below >= total THEN ((b - 8 * e) << e) END) AS q1, min(CASE WHEN 4 * below >= 3 * total THEN ((b - 8 * e) << e) + (1 << e) - 1 END) AS q3,
  max(CASE measure WHEN 'm_word_length' THEN 100 ELSE 250 END) AS slack
 FROM (SELECT *, CASE WHEN b < 16 THEN 0 ELSE b // 8 - 1 END AS e, sum(c) OVER (PARTITION BY {keys} measure ORDER BY b) AS below,
              sum(c) OVER (PARTITION BY {keys} measure) AS total
       FROM (SELECT {keys} measure, b, CAST(sum(c) AS BIGINT) AS c FROM sk GROUP BY ALL)) GROUP BY {group} measure"""
    return rf"""
qw AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs}),
qr AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
   SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
     SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM qw)))
   WHERE n > 1) GROUP BY 1),
qb AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM qw LEFT JOIN qr USING (doc_id)),
qm AS (SELECT *, 100 * word_chars // greatest(n_words, 1) AS m_word_length, 1000 * n_symbols // greatest(n_words, 1) AS m_symbols,
        1000 * n_dup_lines // greatest(n_lines, 1) AS m_dup_lines FROM qb),
ql AS (SELECT lang, source, unnest(['m_word_length', 'm_symbols', 'm_dup_lines']) AS measure, unnest([m_word_length, m_symbols, m_dup_lines]) AS v FROM qm WHERE n_words >= 20),
sk AS (SELECT lang, source, measure, {bin_of.format("v")} AS b, count(*) AS c FROM ql GROUP BY ALL),
f2 AS ({fences.format(keys="lang, source,", group="lang, source,")}),
f1 AS ({fences.format(keys="lang,", group="lang,")}),
f0 AS ({fences.format(keys="", group="")}),
ft AS (SELECT f2.lang, f2.source, measure,
   CASE WHEN f2.total >= 50 THEN f2.q1 - greatest(3 * (f2.q3 - f2.q1), f2.slack) WHEN f1.total >= 50 THEN f1.q1 - greatest(3 * (f1.q3 - f1.q1), f1.slack)
        ELSE f0.q1 - greatest(3 * (f0.q3 - f0.q1), f0.slack) END AS low,
   CASE WHEN f2.total >= 50 THEN f2.q3 + greatest(3 * (f2.q3 - f2.q1), f2.slack) WHEN f1.total >= 50 THEN f1.q3 + greatest(3 * (f1.q3 - f1.q1), f1.slack)
        ELSE f0.q3 + greatest(3 * (f0.q3 - f0.q1), f0.slack) END AS high
  FROM f2 JOIN f1 USING (measure) JOIN f0 USING (measure) WHERE f2.lang IS NOT DISTINCT FROM f1.lang),
qo AS (SELECT doc_id, bool_or(v < low OR v > high) AS bad FROM (
   SELECT doc_id, lang, source, unnest(['m_word_length', 'm_symbols', 'm_dup_lines']) AS measure, unnest([m_word_length, m_symbols, m_dup_lines]) AS v FROM qm) x
  JOIN ft USING (measure) WHERE x.lang IS NOT DISTINCT FROM ft.lang AND x.source IS NOT DISTINCT FROM ft.source GROUP BY 1),
judged AS (SELECT *, base_failed = FALSE AND NOT coalesce(bad, FALSE) AS kept FROM (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM qm LEFT JOIN qo USING (doc_id)))"""


SQL["op8"] = f"WITH {_quality('documents')}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL["op11"] = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, l[i] AS line, i, translate(trim(l[i], {_STRIP}), '{_UPPER}', '{_LOWER}') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
held AS (SELECT k, max(doc_id) AS top FROM ln WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT ln.*, top IS NOT NULL AND top <> doc_id AS gone FROM ln LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

# crc32 with the reversed polynomial 0xEDB88320, a byte at a time through its table.
_CRC_TABLE = """tab AS (SELECT list(list_reduce(range(0, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab FROM range(0, 256) t(b))"""
_CRC = "xor(list_reduce({bytes}, lambda c, x: xor(c >> 8, tab[CAST(xor(c & 255, x) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"

#: Out of a state (0 nothing, 1 system, 2 user, 3 assistant written): letters, cost, the role that a kept row must have, next state.
#: At most two rows are inserted at a place, as three lead back to where one did.
_MOVES = """moves AS (WITH nxt(q, t) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)), ins AS (
    SELECT q, '' AS a, 0 AS c, q AS t FROM nxt UNION ALL SELECT q, 'I', 3, t FROM nxt UNION ALL SELECT x.q, 'II', 6, y.t FROM nxt x JOIN nxt y ON x.t = y.q),
  kept(q, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))
  SELECT list({'q': q, 'a': a, 'c': c, 'r': r, 't': t, 'stay': stay}) AS moves FROM (
    SELECT ins.q, a || 'D' AS a, c + 4 AS c, '' AS r, ins.t, FALSE AS stay FROM ins
    UNION ALL SELECT ins.q, a || 'R', c + 3, '', nxt.t, TRUE FROM ins JOIN nxt ON ins.t = nxt.q
    UNION ALL SELECT ins.q, a || 'K', c, r, kept.t, TRUE FROM ins JOIN kept ON ins.t = kept.q))"""

SQL["op12"] = f"""
WITH RECURSIVE {_CRC_TABLE}, {_MOVES},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT raw.*, {_CRC.format(bytes="list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))")} % 20 AS h FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
   FROM hashed WHERE h <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS r FROM dam),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
   lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM pos),
tot AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
   count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal
   FROM faults GROUP BY 1),
back AS (SELECT conv_id, n AS i, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS f FROM tot
   UNION ALL SELECT back.conv_id, back.i - 1, list_transform(range(0, 4), lambda q: list_min(list_transform(
      list_filter(moves, lambda m: m.q = q AND (m.r = '' OR m.r = faults.r) AND NOT (m.stay AND fault IN (1, 2))),
      lambda m: {{'c': CAST(m.c + CASE WHEN m.stay AND fault = 3 THEN 3 ELSE 0 END + f[m.t + 1].c AS INTEGER), 'a': m.a || f[m.t + 1].a}})))
   FROM back JOIN faults ON back.conv_id IS NOT DISTINCT FROM faults.conv_id AND back.i = faults.i, moves),
plan AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit FROM back WHERE i = 0),
letters AS (SELECT conv_id, audit[p] AS e, p, len(replace(audit, 'D', '')) % 2 AS odd, len(replace(audit[1:p], 'I', '')) AS i, len(replace(audit[1:p], 'D', '')) AS k
   FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM plan)),
lines AS (SELECT x.conv_id, p, CASE WHEN e = 'K' THEN role WHEN (k + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
   FROM letters x LEFT JOIN faults y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS t FROM lines GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
   coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN tot ON o.conv_id IS NOT DISTINCT FROM tot.conv_id
LEFT JOIN plan ON o.conv_id IS NOT DISTINCT FROM plan.conv_id LEFT JOIN texts ON o.conv_id IS NOT DISTINCT FROM texts.conv_id"""

SQL["op13"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT d, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
   unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, {_CRC.format(bytes="list_transform(string_split(regexp_replace(hex(encode(d || ':' || run)), '(..)', ',\\1', 'g')[2:], ','), lambda x: CAST('0x' || x AS BIGINT))")} AS h
   FROM runs, tab WHERE length(run) >= 5),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed)
   WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT * FROM (SELECT a.word, a.n, b.word AS v, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION ALL SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'m': -m, 'v': v}}) AS top FROM near GROUP BY 1),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 2 * words.n THEN top.v END AS form, CASE WHEN -top.m >= 2 * words.n THEN -top.m END AS form_n
   FROM words LEFT JOIN best ON words.word = best.word),
walk AS (SELECT word, word AS here, form AS ahead FROM forms UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = ahead)
SELECT forms.word, n, n_near, form, form_n, here AS root FROM forms JOIN walk ON walk.word = forms.word AND ahead IS NULL"""
