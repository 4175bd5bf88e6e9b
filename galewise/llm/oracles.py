"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':17')) AS draw
    FROM documents),
sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighted AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sums),
-- sources in the order in which a rising level reaches their caps; the level holds before the first cap it doesn't reach
ordered AS (
    SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER below, 0) AS taken, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open
    FROM weighted WINDOW below AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(total - taken AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM ordered),
level AS (SELECT arg_min(level, cap / weight) FILTER (cap > weight * level) AS level FROM levels),
targets AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce(level, 1e300)) AS target FROM weighted, level),
rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM targets),
walked AS (
    SELECT s.*, r.source_size, r.target, r.whole, greatest(r.target - r.whole * r.source_size, 0) AS rest,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw) AS upto, sum(s.size) OVER (PARTITION BY s.source, s.draw) AS own
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
limits AS (
    SELECT source, max(draw) FILTER (own > 0 AND upto - own / 2 <= rest) AS last FROM walked GROUP BY source)
SELECT w.doc_id, CAST(w.size AS BIGINT) AS size, w.source_size, round(w.target, 6) AS target,
    CAST(w.size * CASE WHEN w.source_size > 0 THEN least(w.whole + CASE WHEN w.draw <= l.last THEN 1 ELSE 0 END, 3) ELSE 0 END AS BIGINT) AS taken
FROM walked w JOIN limits l ON w.source IS NOT DISTINCT FROM l.source
"""

EXACT_TOPK = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, i.vec_id, CAST(list_inner_product(q.v, i.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

LINE_DEDUP = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
    SELECT doc_id, i AS line, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS own
    FROM texts, unnest(range(1, len(lines) - 1)) AS t(i)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY own ORDER BY doc_id, line) AS place FROM windows
    WHERE regexp_matches(own, '[^\x20\x09-\x0D]')),
gone AS (SELECT doc_id, list_distinct(flatten(list([line, line + 1, line + 2]))) AS gone FROM ranked WHERE place > 1 GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(t.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
    CASE WHEN g.gone IS NULL THEN t.text
        ELSE coalesce(array_to_string([t.lines[i] for i in range(1, len(t.lines) + 1) if NOT list_contains(g.gone, i)], chr(10)), '') END AS text
FROM texts t LEFT JOIN gone g USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY own) AS group_size, row_number() OVER best = 1 AS kept,
    sha256(own) AS text_sha256
FROM texts WINDOW best AS (PARTITION BY own ORDER BY size DESC, doc_id NULLS LAST)
"""

SPELLING = r"""
WITH RECURSIVE steps AS (
    SELECT list(v ORDER BY b) AS t
    FROM (SELECT b, list_reduce([CAST(b AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(b))),
runs AS (
    SELECT head, run, count(*) AS n FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS head,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents) GROUP BY ALL),
bytes AS (
    SELECT *, hex(encode(head || ':' || run)) AS x FROM runs),
sums AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT,
            [CAST(16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS UBIGINT) for i in range(length(x) // 2)]),
        lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) AS h
    FROM bytes, steps),
damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
spots AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
losses AS (SELECT DISTINCT s.word, s.n, w.word AS near, w.n AS near_n FROM spots s JOIN words w ON w.word = s.a || s.z),
links AS (
    SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM spots x JOIN spots y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
    UNION ALL SELECT * FROM losses UNION ALL SELECT near, near_n, word, n FROM losses),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM links),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
paths AS (
    SELECT word, coalesce(form, word) AS root FROM forms
    UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN paths p USING (word) JOIN forms e ON e.word = p.root WHERE e.form IS NULL
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents),
grams AS (
    SELECT lang, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase, count(*) AS f
    FROM pieces, unnest(range(1, 5)) AS s(size), unnest(range(1, len(words) - size + 2)) AS t(pos) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS words FROM grams WHERE size > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.size, c.f AS a, cut, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
    FROM found c, unnest(range(1, c.size)) AS t(cut)
    JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.words, 1, cut), ' ')
    JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.words, cut + 1, c.size), ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, array_to_string(list_slice(words, pos, pos + k - 1), ' ') AS phrase, max(f) AS most
    FROM found, unnest(range(2, size)) AS s(k), unnest(range(1, size - k + 2)) AS t(pos) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op4_line_dedup": LINE_DEDUP, "op5_mixing": MIXING, "op9_exact_topk": EXACT_TOPK, "op11_spelling": SPELLING, "op12_collocations": COLLOCATIONS,
    "op13_exact_dedup": EXACT_DEDUP,
}
