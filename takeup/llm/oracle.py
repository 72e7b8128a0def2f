"""DuckDB SQL for the queries of this subpackage that SQL can express, written apart from their code."""

from __future__ import annotations

#: words of a text: runs of anything but ASCII white space
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: the schedules fall from 1.5 to 0.5, stay at 1, and rise from 0.5 to 1.5; every round takes the sources that are above the limit out and deals the rest anew
MIX = rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
src AS (SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
rounds AS (
    SELECT 0 AS step, (SELECT sum(source_size) FROM src)::BIGINT AS remaining, (SELECT sum(weight) FROM src)::BIGINT AS shares
    UNION ALL
    SELECT step + 1,
        ((SELECT sum(source_size) FROM src) - coalesce((SELECT sum(3 * source_size) FROM src
            WHERE 3 * source_size * shares <= weight * remaining), 0))::BIGINT,
        coalesce((SELECT sum(weight) FROM src WHERE NOT 3 * source_size * shares <= weight * remaining), 0)::BIGINT
    FROM rounds WHERE shares > 0 AND step < (SELECT count(*) FROM src)),
settled AS (SELECT remaining, shares FROM rounds WHERE shares > 0 ORDER BY step DESC LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN 3 * source_size * shares <= weight * remaining THEN (3 * source_size)::DOUBLE
    ELSE remaining::DOUBLE * weight / shares END AS target, weight FROM src, settled),
dealt AS (SELECT doc_id, size, source_size, target, weight,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix-' || doc_id), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (SELECT *, least(size, greatest(floor(target - passes * source_size + 0.5)::BIGINT - before, 0)) AS part FROM dealt)
SELECT doc_id, size, source_size, target, (size * passes + part)::BIGINT AS taken,
    CASE WHEN size = 0 OR passes + part = 0 THEN NULL WHEN weight = 1 THEN 1.5 - sqrt(greatest(2.25 - 2 * (before / target), 0))
        WHEN weight = 2 THEN before / target WHEN before / target < 0.375 THEN sqrt(0.25 + 2 * (before / target)) - 0.5
        ELSE 0.5 + (sqrt(1 + 2 * (before / target - 0.375)) - 1) END AS first_position
FROM taken"""

_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: all windows of all texts, compared as lists of words
CONTAMINATION = rf"""
WITH doc AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, {_LETTERS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM item WHERE len(w) > 0),
item_window AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
doc_window AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM doc, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size)),
met AS (SELECT d.doc_id, d.i, d.size, t.item_id FROM doc_window d JOIN item_window t ON d.size = t.size AND d.win = t.win),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


#: quartiles are read off the sorted cells; a fence is compared per rule and joined by group
QUALITY = rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s,
    coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS three FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM doc)),
often AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, three) > 1),
repeated AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM often) GROUP BY rid),
counted AS (SELECT rid, doc_id, l, s, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words
    FROM doc LEFT JOIN repeated USING (rid)),
base AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
rate AS (SELECT rid, l, s, base_failed, unnest([
    struct_pack(rule := 'length', slack := 900, v := 1000 * word_chars // greatest(n_words, 1)),
    struct_pack(rule := 'symbols', slack := 80, v := 1000 * n_symbols // greatest(n_words, 1)),
    struct_pack(rule := 'lines', slack := 420, v := 1000 * n_dup_lines // greatest(len(lines), 1)),
    struct_pack(rule := 'repeats', slack := 230, v := 1000 * n_repeat_words // greatest(n_words, 1))], recursive := true) FROM base),
cells AS (SELECT l, s, rule, v // (1 << greatest(length(bin(v)) - 6, 0)) * (1 << greatest(length(bin(v)) - 6, 0)) AS cell
    FROM rate WHERE NOT base_failed),
level AS (SELECT l, s, rule, count(*) AS n, list_sort(list(cell)) AS c, grouping(l) AS all_l, grouping(s) AS all_s FROM cells
    GROUP BY GROUPING SETS ((l, s, rule), (l, rule), (rule))),
quart AS (SELECT *, c[(n + 3) // 4] AS q1, c[(3 * n + 3) // 4] AS q3 FROM level),
fence AS (SELECT own.l, own.s, own.rule, CASE WHEN own.n >= 100 THEN own.q1 WHEN lang.n >= 100 THEN lang.q1 ELSE total.q1 END AS q1,
    CASE WHEN own.n >= 100 THEN own.q3 WHEN lang.n >= 100 THEN lang.q3 ELSE total.q3 END AS q3
    FROM quart own JOIN quart lang ON own.l = lang.l AND own.rule = lang.rule AND lang.all_l = 0 AND lang.all_s = 1
    JOIN quart total ON own.rule = total.rule AND total.all_l = 1 WHERE own.all_s = 0),
judged AS (SELECT rid, bool_and(v <= q3 + greatest(4 * (q3 - q1), slack) AND (rule <> 'length' OR v >= q1 - greatest(4 * (q3 - q1), slack))) AS fits
    FROM rate JOIN fence USING (l, s, rule) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(fits, false) AS kept FROM base LEFT JOIN judged USING (rid)"""


#: markup of a turn: 18 characters for user, 6 for assistant, 26 and the role for others; one more for each control string or backslash in a text
_ESCAPED = r"length({0}) + len(regexp_extract_all({0}, '</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]|\\'))"
CHAT = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum({_ESCAPED.format('text')} + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
        ELSE 26 + {_ESCAPED.format('role')} END)::BIGINT AS formatted_chars, 0::INTEGER AS rewrites
FROM turns GROUP BY conv_id"""


#: a base32 digit is five bits, found in two neighbouring hexadecimal digits of the SHA-1
_NIBBLE = "(strpos('0123456789abcdef', substr(hex, {0}, 1)) - 1)"
ARCHIVE = rf"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(0, 160, 5), lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((16 * {_NIBBLE.format('1 + b // 4')} + {_NIBBLE.format('2 + b // 4')})
        >> (3 - b % 4)) & 31))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY body) AS newest FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> newest THEN newest END AS refers_to FROM named"""


#: the CRC table by eight halvings of every byte, and the CRC of every distinct run of words byte by byte
RESAMPLING = rf"""
WITH RECURSIVE step AS (SELECT b::BIGINT AS b, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
    UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_LETTERS} AS w FROM documents),
item AS (SELECT {_LETTERS} AS w FROM benchmark),
doc_gram AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM doc),
item_gram AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM item),
gram AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM doc_gram UNION SELECT g FROM item_gram)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2),
        lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM gram, tab),
ds AS (SELECT bucket, count(*) AS s FROM doc_gram JOIN hashed USING (g) GROUP BY 1),
bt AS (SELECT bucket, count(*) AS t FROM item_gram JOIN hashed USING (g) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM ds) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM bt), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM ds LEFT JOIN bt USING (bucket)),
weighed AS (SELECT rid, count(*)::BIGINT AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM doc_gram JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM doc LEFT JOIN weighed USING (rid)),
placed AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= (SELECT 25 * count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM placed"""
