"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, lang,
         {WORDS.format(text="text")} AS w, {WORDS.format(text="lower(text)")} AS lw
  FROM documents
),
symbols AS (SELECT r, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
lines AS (
  SELECT r, sum(n - 1)::BIGINT AS n_dup_lines FROM (
    SELECT r, line, count(*) AS n
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL)
  GROUP BY r
),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs))
),
repeats AS (
  SELECT r, count(DISTINCT i + d)::BIGINT AS n_repeat_words
  FROM win, (VALUES (0), (1), (2)) AS t(d) WHERE n > 1 GROUP BY r
),
classes AS (
  SELECT r, lang, [
    length(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{M}}]|\p{{Lu}}|\p{{Lt}}', '', 'g')),
    length(regexp_replace(coalesce(text, ''), '[^\p{{Lu}}\p{{Lt}}]', '', 'g')),
    length(regexp_replace(coalesce(text, ''), '[^\p{{N}}]', '', 'g')),
    length(regexp_replace(coalesce(text, ''), '[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', '', 'g')),
    length(regexp_replace(coalesce(text, ''), '[^.,;:!?]', '', 'g'))] AS h, length(coalesce(text, '')) AS n
  FROM docs
),
own_class AS (SELECT r, lang, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest(list_append(h, n - list_sum(h))) AS n FROM classes),
-- the reference of the whole corpus stands under 'all:', those of the languages under 'l:' and their name
ref_class AS (
  SELECT 'l:' || lang AS lang, k, sum(n) AS n FROM own_class WHERE lang IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'all:', k, sum(n) FROM own_class GROUP BY ALL
),
each_count AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(lw) AS word FROM docs) GROUP BY ALL),
counts AS (
  SELECT 'l:' || lang AS lang, word, n FROM each_count WHERE lang IS NOT NULL
  UNION ALL SELECT 'all:', word, sum(n)::BIGINT FROM each_count GROUP BY word
),
totals AS (SELECT lang, sum(n) AS n FROM counts GROUP BY lang),
langs AS (SELECT lang, n FROM totals WHERE n >= 2000),
named AS (
  SELECT d.* EXCLUDE (lang), coalesce(l.lang, 'all:') AS lang FROM docs d LEFT JOIN langs l ON l.lang = 'l:' || d.lang
),
common AS (
  SELECT lang, word, c.n FROM counts c SEMI JOIN langs USING (lang) WHERE length(word) <= 32
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c.n DESC, word) <= 100
),
ref_word AS (
  SELECT lang, word, n FROM common
  UNION ALL SELECT lang, NULL, any_value(l.n) - sum(c.n) FROM common c JOIN langs l USING (lang) GROUP BY lang
),
judged AS (SELECT r, d.lang, len(w) AS n FROM named d SEMI JOIN langs USING (lang) WHERE len(w) >= 50),
hits AS (
  SELECT d.r, c.word, count(*) AS n
  FROM (SELECT r, lang, unnest(lw) AS word FROM named SEMI JOIN judged USING (r)) d
  LEFT JOIN common c ON c.lang = d.lang AND c.word = d.word GROUP BY ALL
),
word_sides AS (
  SELECT j.r, coalesce(h.n, 0) / sum(coalesce(h.n, 0)) OVER (PARTITION BY j.r) AS p,
         f.n / sum(f.n) OVER (PARTITION BY j.r) AS q
  FROM judged j JOIN ref_word f USING (lang) LEFT JOIN hits h ON h.r = j.r AND h.word IS NOT DISTINCT FROM f.word
),
class_sides AS (
  SELECT j.r, o.n / sum(o.n) OVER (PARTITION BY j.r) AS p, f.n / sum(f.n) OVER (PARTITION BY j.r) AS q
  FROM judged j JOIN own_class o USING (r) JOIN ref_class f ON f.lang = j.lang AND f.k = o.k
),
distances AS (
  SELECT r, side, round(sqrt(greatest(0.0, sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS x
  FROM (SELECT r, 'c' AS side, p, q FROM class_sides UNION ALL SELECT r, 'w', p, q FROM word_sides)
  GROUP BY ALL
),
found AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         s.n_symbols::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(p.n_repeat_words, 0) AS n_repeat_words, c.x AS char_distance, v.x AS word_distance
  FROM docs d JOIN symbols s USING (r) LEFT JOIN lines l USING (r) LEFT JOIN repeats p USING (r)
  LEFT JOIN distances c ON c.r = d.r AND c.side = 'c' LEFT JOIN distances v ON v.r = d.r AND v.side = 'w'
),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (char_distance IS NULL OR (char_distance <= 0.22 + 0.5 / sqrt(n_words)
         AND word_distance <= 0.18 + 2.8 / sqrt(n_words))) AS kept, char_distance, word_distance
FROM ruled
"""

# Every source is a pattern of its own here, so that the flow is the target itself.
SOURCE_MIX = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, len({WORDS.format(text="text")})::BIGINT AS size,
         md5('7:' || doc_id::VARCHAR) AS place
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         [3, 1, 2][1 + row_number() OVER (ORDER BY source NULLS LAST) % 3] AS weight
  FROM docs GROUP BY source
),
ordered AS (
  SELECT *, row_number() OVER o AS turn, sum(3 * source_size) OVER o - 3 * source_size AS capped,
         sum(weight) OVER () - sum(weight) OVER o + weight AS weights, sum(source_size) OVER () AS total
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
),
levels AS (SELECT *, (total - capped) / weights AS level FROM ordered),
free AS (SELECT level AS free_level, turn AS free_turn FROM levels WHERE 3 * source_size >= level * weight ORDER BY turn LIMIT 1),
targets AS (
  SELECT source, source_size, n,
         CASE WHEN total = 0 THEN 0.0 WHEN turn >= free_turn THEN free_level * weight ELSE 3.0 * source_size END::DOUBLE AS target
  FROM levels LEFT JOIN free ON true
),
plan AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS amount,
         CASE WHEN source_size > 0 THEN amount // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN amount % source_size ELSE 0 END AS rest, least((n + 255) // 256, 65536) AS buckets
  FROM targets
),
dealt AS (
  SELECT d.*, p.* EXCLUDE (source),
         floor(('0x' || substr(place, 1, 8))::BIGINT * buckets / 4294967296.0)::BIGINT AS bucket
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
),
upto AS (
  SELECT source, bucket, rest, words, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto
  FROM (SELECT source, bucket, rest, sum(size) AS words FROM dealt GROUP BY ALL)
),
borders AS (
  SELECT source, min(bucket) AS border, arg_min(rest - upto + words, bucket)::BIGINT AS room
  FROM upto WHERE upto > rest GROUP BY source
),
split AS (
  SELECT d.*, b.border, b.room, b.room IS NOT NULL AND bucket >= border AND size BETWEEN 1 AND room AS open
  FROM dealt d LEFT JOIN borders b ON d.source IS NOT DISTINCT FROM b.source
),
lengths AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS turn
  FROM (SELECT source, size, any_value(room) AS room, count(*) AS many FROM split WHERE open GROUP BY source, size)
),
filled AS (
  SELECT source, size, turn, least(many, room // size) AS take, room - size * least(many, room // size) AS room
  FROM lengths WHERE turn = 1
  UNION ALL
  SELECT l.source, l.size, l.turn, least(l.many, f.room // l.size), f.room - l.size * least(l.many, f.room // l.size)
  FROM filled f JOIN lengths l ON l.source IS NOT DISTINCT FROM f.source AND l.turn = f.turn + 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, size, open ORDER BY substr(place, 9), doc_id) AS nth FROM split
)
SELECT s.doc_id, s.size, s.source_size, s.target,
       s.size * CASE WHEN s.border IS NULL THEN 0
                     ELSE least(3, s.whole + (s.bucket < s.border OR (s.open AND s.nth <= coalesce(f.take, 0)))::INT) END AS taken
FROM ranked s LEFT JOIN filled f ON s.open AND f.source IS NOT DISTINCT FROM s.source AND f.size = s.size
"""

FILL_IN_MIDDLE = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
),
drawn AS (
  SELECT doc_id, t, w, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS a,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT AS h3,
         ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM tokens
),
cut AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(w[greatest(a, b) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""

MINHASH_COMPONENTS = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
  SELECT a.r AS x, b.r AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r
  JOIN sizes p ON p.r = a.r JOIN sizes q ON q.r = b.r
  WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))
),
reached AS (
  SELECT r AS x, r AS y FROM docs
  UNION
  SELECT m.x, l.y FROM reached m JOIN links l ON l.x = m.y
),
named AS (SELECT x AS r, min(d.doc_id) AS component_id FROM reached JOIN docs d ON d.r = y GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(d.doc_id = component_id, false) AS kept
FROM docs d JOIN named USING (r) LEFT JOIN sizes USING (r)
"""
