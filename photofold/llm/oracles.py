"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
),
keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
frequent AS (
    SELECT key, max(doc_id) AS last_doc FROM keyed
    WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
    SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone
    FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# Windows are slices of bytes; what is kept is put together as hex text, two characters a byte.
SUFFIX_DEDUP = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
    SELECT doc_id, i, md5(r[i + 1 : i + 200]) AS w
    FROM (SELECT doc_id, r, unnest(range(0, octet_length(r) - 199)) AS i FROM raw)
),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (
    SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) AS new
    FROM windows SEMI JOIN again USING (w)
),
numbered AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y, run FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY run)
    UNION ALL
    SELECT r.doc_id, coalesce(max(b), 0), octet_length(any_value(r.r)), coalesce(max(run), 0) + 1
    FROM raw r LEFT JOIN spans s ON s.doc_id = r.doc_id GROUP BY r.doc_id
),
kept AS (
    SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY run) AS k
    FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id
)
SELECT r.doc_id, octet_length(r.r) AS n_bytes, octet_length(r.r) - len(k) // 2 AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM raw r JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) s USING (doc_id)
"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
    FROM sized GROUP BY source
),
weighted AS (
    SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][number % 3 + 1] AS weight, 1.5::DOUBLE * sum(n) OVER () AS budget FROM sources
),
filled AS (
    SELECT *, 2 * n / weight AS level, (budget - coalesce(sum(2 * n) OVER before, 0)) / sum(weight) OVER after AS share
    FROM weighted WHERE n > 0
    WINDOW before AS (ORDER BY 2 * n / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY 2 * n / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
targets AS (
    SELECT w.source, w.number, w.n, w.budget,
           CASE WHEN f.level <= f.share THEN CAST(2 * w.n AS DOUBLE)
                ELSE w.weight * (SELECT share FROM filled WHERE level > share ORDER BY level, number LIMIT 1) END AS target
    FROM weighted w LEFT JOIN filled f USING (number)
),
queued AS (
    SELECT doc_id, size, number, n, coalesce(target, 0) AS target, budget,
           row_number() OVER q AS place, sum(size) OVER q - size AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    WINDOW q AS (PARTITION BY number ORDER BY md5('20|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING)
),
packets AS (
    SELECT *, copy * n + start + packet * 64 + least(64, size - packet * 64) AS done, least(64, size - packet * 64) AS words
    FROM (SELECT *, unnest(range(0, greatest((size + 63) // 64, 1))) AS packet
          FROM (SELECT *, unnest([0, 1]) AS copy FROM queued))
),
ordered AS (
    SELECT *, sum(words) OVER (ORDER BY CASE WHEN target > 0 THEN done / target ELSE 'inf'::DOUBLE END, number, place, copy, packet
                               ROWS UNBOUNDED PRECEDING) - words AS before
    FROM packets
)
SELECT doc_id, size, n AS source_size, target,
       CAST(sum(greatest(0, least(words, CAST(round_even(budget, 0) AS BIGINT) - before))) AS BIGINT) AS taken
FROM ordered GROUP BY doc_id, size, n, target
"""

QUALITY_RULES = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
threes AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM threes), (VALUES (0), (1), (2)) x(k)
    WHERE times > 1 GROUP BY doc_id
),
eights AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM texts)),
again AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM eights) WHERE times > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) x(k) GROUP BY doc_id),
diagonals AS (
    SELECT a.doc_id, b.i - a.i AS apart, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS run
    FROM again a JOIN again b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
),
longest AS (
    SELECT doc_id, max(n) + 7 AS n FROM (SELECT doc_id, count(*) AS n FROM diagonals GROUP BY doc_id, apart, run) GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
counts AS (
    SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS covered_words, coalesce(l.n, 0) AS longest_repeat
    FROM texts t LEFT JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN covered c USING (doc_id)
    LEFT JOIN longest l USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND covered_words <= 0.3::DOUBLE * n_words AND longest_repeat <= 0.2::DOUBLE * n_words AS kept
FROM counts
"""

NGRAM_JOIN = f"""
WITH RECURSIVE shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.low, d.doc_id)) AS class_id, coalesce(n, 0) AS n_links
FROM documents d LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
"""

# Every mark is escaped by one character more, and a turn has a header, its text, and an end on a line of its own.
CHAT_FORMAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
marked AS (
    SELECT *, len(regexp_extract_all(text, '</turn>|### (?:(?:System|User|Assistant|Tool): |Role ")')) AS n_marks,
           length('### ' || role || ': ') + length(chr(10) || '</turn>' || chr(10)) AS around
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(around + length(text) + n_marks)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op11_chat_format": CHAT_FORMAT,
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_mixing": MIXING,
    "op7_quality_rules": QUALITY_RULES,
    "op9_ngram_join": NGRAM_JOIN,
    "op10_line_dedup": LINE_DEDUP,
}
