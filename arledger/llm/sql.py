"""DuckDB SQL for the results of the operators' queries, written from their contracts."""

from __future__ import annotations

#: Words of op1 and op4, and words of op2 after A-Z is lower-cased.
WORDS, WORDS_ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_az(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


REPETITION_OF = """
WITH d AS (SELECT row_number() OVER () AS rid, {id} AS doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT *, regexp_extract_all(t, '{words}') AS ws FROM d),
base AS (SELECT rid, doc_id, len(ws) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{words}') GROUP BY rid),
at8 AS (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT rid, list(i) AS places FROM at8 GROUP BY rid, g HAVING count(*) > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, unnest(places) AS i FROM twice)) GROUP BY rid),
at101 AS (SELECT rid, md5(array_to_string(list_slice(ws, i, i + 100), ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 99)) AS i FROM w)),
overlong AS (SELECT DISTINCT rid FROM (SELECT rid FROM at101 GROUP BY rid, g HAVING count(*) > 1)),
m AS (SELECT base.rid, doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, overlong.rid IS NOT NULL AS too_long
    FROM base LEFT JOIN dup USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN overlong USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR too_long) AS kept FROM m
"""


def repetition(docs: str = "documents", id_column: str = "doc_id") -> str:
    return REPETITION_OF.format(docs=docs, id=id_column, words=WORDS)


REPETITION = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({repetition()})"

JUMPS = """
key AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16)) AS UBIGINT) AS key0 FROM rows_in),
keys AS (SELECT DISTINCT key0 FROM key),
jump AS (
    SELECT key0, CAST(key0 AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM keys
    UNION ALL
    SELECT key0, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT key0, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jump WHERE j < 41)),
shards AS (SELECT key0, CAST(max(b) FILTER (b < 40) AS INTEGER) AS shard, CAST(max(b) FILTER (b < 41) AS INTEGER) AS grown_shard FROM jump GROUP BY key0)
"""

#: DuckDB has no crc32: the checksum is folded byte by byte over its table of 256 values, which is made here.
CRC = """
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
crc AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(text) + 1), lambda p: CAST(('0x' || substr(hex(encode(text)), 2 * p - 1, 2)) AS BIGINT))),
    lambda c, x: xor(c // 256, t[1 + xor(c & 255, x)]))) AS text_crc32 FROM (SELECT DISTINCT coalesce(text, '') AS text FROM rows_in), crc_table)
"""

SHARDS = f"""
WITH RECURSIVE rows_in AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {JUMPS.strip()},
{CRC.strip()}
SELECT doc_id, strlen(text) + 16 AS size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY key0, doc_id NULLS FIRST, strlen(text), text_crc32) - 1 AS slot, grown_shard
FROM key JOIN shards USING (key0) JOIN crc USING (text)
"""

MIXTURE_OF = """
n AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS weight FROM {docs} GROUP BY source),
rate AS (SELECT source, weight / (SELECT sum(weight) FROM n) * CAST((SELECT sum(n) FROM n) AS DOUBLE) / n AS rate FROM n),
lo AS (SELECT source, rate, greatest(0, floor(rate - (12 * sqrt(rate) + 25)))::BIGINT AS least, ceil(rate + (12 * sqrt(rate) + 25))::BIGINT AS most FROM rate),
steps AS (SELECT *, unnest(range(least, most + 1)) AS k FROM lo),
logs AS (SELECT *, sum(CASE WHEN k = least THEN 0.0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS log_mass FROM steps),
mass AS (SELECT *, exp(log_mass - max(log_mass) OVER (PARTITION BY source)) AS mass FROM logs),
cdf AS (SELECT source, least, k, sum(mass) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(mass) OVER (PARTITION BY source) AS cdf FROM mass),
tables AS (SELECT source, least, list(cdf ORDER BY k) AS cdf FROM cdf GROUP BY source, least),
drawn AS (SELECT d.*, CAST(('0x' || substr(md5('7' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM {docs} d),
counted AS (SELECT drawn.*, least + len(list_filter(cdf, lambda c: c <= u)) AS times FROM drawn JOIN tables ON drawn.source IS NOT DISTINCT FROM tables.source)
"""

MIXTURE = f"WITH {MIXTURE_OF.format(docs='documents').strip()}\nSELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1)) AS copy FROM counted"


HITS_OF = """
WITH d AS (SELECT row_number() OVER () AS rid, {id} AS doc_id, regexp_extract_all({lower}, '{words}') AS ws FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lower}, '{words}') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(list_slice(ws, i, i + 9), ' ') AS g
    FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
places AS (SELECT rid, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
    FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))),
found AS (SELECT rid, i, k, item FROM places JOIN windows USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT d.rid, doc_id, coalesce(len(ws), 0) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(items.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def hits(docs: str = "documents", id_column: str = "doc_id") -> str:
    return HITS_OF.format(docs=docs, id=id_column, words=WORDS_ALNUM, lower=lower_az("text"))


HITS = f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({hits()})"

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, line, i, {lower_az(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k
    FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d)),
rep AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, doc_id > first IS TRUE AS away FROM l LEFT JOIN rep USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (away) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT away), '')) AS kept_sha256
FROM m GROUP BY rid
"""


#: Tables shingles (doc_id, g), sizes (doc_id, n), links (x, y) and component (doc_id, component_id) of rows with a doc_id.
COMPONENTS_OF = """
jw AS (SELECT {id} AS doc_id, regexp_extract_all({lower}, '{words}') AS ws FROM {docs} WHERE {id} IS NOT NULL),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {n} - 1), ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {n} + 1) + 1)) AS i FROM jw WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
half AS (SELECT x, y FROM overlap o JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * o.n >= {percent} * (a.n + b.n - o.n)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT DISTINCT doc_id AS x, doc_id AS y FROM jw UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
"""


def components(docs: str = "documents", id_column: str = "doc_id", n: int = 3, percent: int = 90) -> str:
    return COMPONENTS_OF.format(n=n, percent=percent, docs=docs, id=id_column, words=WORDS, lower=lower_az("text")).strip()


JACCARD = f"""
WITH RECURSIVE {components()}
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN component USING (doc_id)
"""

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text,
    md5((CASE WHEN role IS NULL THEN '0' ELSE '1' END) || coalesce(role, '') || chr(31) || (CASE WHEN text IS NULL THEN '0' ELSE '1' END) || coalesce(text, '')) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list(d ORDER BY turn NULLS FIRST, role NULLS FIRST, d) AS ds,
    list('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, role NULLS FIRST, d) AS shown FROM t GROUP BY conv_id),
prefixes AS (SELECT DISTINCT list_slice(ds, 1, k) AS ds FROM (SELECT ds, unnest(range(1, n)) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id FROM c WHERE ds NOT IN (SELECT ds FROM prefixes) GROUP BY ds)
SELECT conv_id, CAST(s AS INTEGER) AS segment, n AS n_turns, array_to_string(list_slice(shown, 256 * s + 1, 256 * s + 256), '') AS chat
FROM (SELECT c.*, unnest(range(0, (n + 255) // 256)) AS s FROM c JOIN kept USING (conv_id))
"""


#: Of every part and set of failed filters (bit 0: A): documents, those of quality 1 and those labelled toxic.
AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
f AS (SELECT part, doc_id,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS failed
    FROM d JOIN firsts USING (t)),
kinds AS (SELECT part, failed, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 65 AS i,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0)::INT AS before
    FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders)),
judged AS (SELECT part, filter_order, step, i, n, good, toxic, failed & before = 0 AS reached, failed & (1 << i) <> 0 AS fails, failed = 1 << i AS alone FROM steps, kinds),
m AS (SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (reached AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (reached AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND NOT reached), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (reached AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (reached AND fails), 0)::BIGINT AS toxic_lost FROM judged GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM m
"""


#: ``k``: turns of the base conversation that come first; ``path``: digests of the rebuilt turns.
TRIE = f"""
WITH rows_in AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS text FROM conversations WHERE conv_id IS NOT NULL),
{CRC.strip()},
turn_of AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM turn_of),
sized AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
convs AS (SELECT s.conv_id, s.conv_id - s.conv_id % 20 AS base, text_crc32 % 4 AS h, least(text_crc32 % 4, coalesce(b.n, 0)) AS k
    FROM sized s JOIN crc ON text = CAST(s.conv_id AS VARCHAR) LEFT JOIN sized b ON b.conv_id = s.conv_id - s.conv_id % 20),
again AS (SELECT c.conv_id, pos, d, words FROM convs c JOIN placed p ON p.conv_id = c.base AND pos <= k
    UNION ALL SELECT conv_id, pos - h + k, d, words FROM convs JOIN placed USING (conv_id) WHERE pos > h),
paths AS (SELECT conv_id, coalesce(list(d ORDER BY pos) FILTER (d IS NOT NULL), []) AS path, list(words ORDER BY pos) AS words
    FROM convs LEFT JOIN again USING (conv_id) GROUP BY conv_id),
begins AS (SELECT conv_id, depth, len(path) = depth AS ends, md5(array_to_string(list_slice(path, 1, depth), ',')) AS key,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_slice(path, 1, depth - 1), ',')) END AS up, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words
    FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM paths)),
node AS (SELECT key, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM begins GROUP BY key, depth),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up, depth),
below AS (SELECT b.key, b.depth, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(n.saved) AS saved FROM node n LEFT JOIN children c ON c.up = n.key AND c.depth = n.depth
    JOIN begins b ON b.conv_id = n.conv_id AND b.depth <= n.depth GROUP BY b.key, b.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below USING (key, depth) LEFT JOIN children c ON c.up = n.key AND c.depth = n.depth LEFT JOIN node p ON p.key = n.up AND p.depth = n.depth - 1
"""
