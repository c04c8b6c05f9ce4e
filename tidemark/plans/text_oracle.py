"""DuckDB SQL of the text queries."""

from __future__ import annotations

from tidemark.plans.text_queries import LINES_SQL, QUERY_SQL, WINDOWS_SQL, tokens_sql

TOKENIZED = f"d AS MATERIALIZED (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)"
SPREAD = f"{TOKENIZED}, p AS MATERIALIZED (SELECT doc_id, unnest(t) AS term FROM d)"

BM25 = f"""{SPREAD}, {QUERY_SQL},
tf AS (SELECT doc_id, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
bm25 AS MATERIALIZED (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.t) / a))) AS score
         FROM tf JOIN df USING (term) JOIN q USING (term) JOIN d USING (doc_id), st GROUP BY item_id, doc_id)"""

HITS = rf"""{LINES_SQL}, {QUERY_SQL},
w AS MATERIALIZED (SELECT doc_id, line_no, word, count(*) AS times FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9_]+')) AS word FROM lines) GROUP BY ALL),
terms AS (SELECT DISTINCT term FROM q), words AS (SELECT DISTINCT word FROM w WHERE length(word) > 2),
pairs AS MATERIALIZED (SELECT term, word FROM terms JOIN words ON contains(word, term)),
hits AS MATERIALIZED (
  SELECT item_id, doc_id, line_no, term, max(CASE WHEN word = term THEN times ELSE 0 END) AS whole, sum(CASE WHEN word = term THEN 0 ELSE times END) AS inside
  FROM w JOIN pairs USING (word) JOIN q USING (term) GROUP BY ALL)"""


def lines_top(score: str, k: int, columns: str = "", joins: str = "") -> str:
    return f"""WITH {HITS}, scored AS (SELECT item_id, doc_id, line_no, CAST({score} AS DOUBLE) AS score FROM hits GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, line_no) AS rank FROM scored)
SELECT item_id, rank, doc_id, line_no{columns}, score FROM best {joins} WHERE rank <= {k}"""


COVERAGE = f"""{LINES_SQL}, {WINDOWS_SQL}, {QUERY_SQL},
own AS (SELECT DISTINCT doc_id, line_no, word AS term FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9_]+')) AS word FROM lines) WHERE word IN (SELECT term FROM q)),
inside AS (SELECT DISTINCT w.doc_id, w."start", w."end", term FROM windows w JOIN own o ON w.doc_id = o.doc_id AND o.line_no BETWEEN w."start" AND w."end"),
coverage AS MATERIALIZED (
  SELECT item_id, doc_id, "start", "end", count(*) AS found, count(*) / max(n) * 0.2 AS score
  FROM inside JOIN q USING (term) JOIN (SELECT item_id, count(*) AS n FROM q GROUP BY item_id) USING (item_id) GROUP BY item_id, doc_id, "start", "end")"""


def suppressed(free: str, cs: str = '"start"', ce: str = '"end"') -> str:
    return f"""WITH RECURSIVE {COVERAGE},
n AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id),
cand AS MATERIALIZED (
  SELECT item_id, doc_id, "start" AS s, "end" AS e, {cs} AS cs, {ce} AS ce, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, "start", "end") AS seq
  FROM coverage JOIN n USING (doc_id)),
fold AS (
  SELECT item_id, 0 AS seq, CAST([] AS STRUCT(d BIGINT, s BIGINT, e BIGINT, k BIGINT)[]) AS chosen FROM (SELECT DISTINCT item_id FROM cand)
  UNION ALL
  SELECT f.item_id, f.seq + 1,
    CASE WHEN len(f.chosen) < 5 AND len(list_filter(f.chosen, lambda z: z.d = c.doc_id AND {free})) = 0
         THEN list_append(f.chosen, {{'d': c.doc_id, 's': c.cs, 'e': c.ce, 'k': c.seq}}) ELSE f.chosen END
  FROM fold f JOIN cand c ON c.item_id = f.item_id AND c.seq = f.seq + 1 WHERE len(f.chosen) < 5),
final AS (SELECT item_id, unnest(chosen).k AS seq, unnest(range(1, len(chosen) + 1)) AS rank FROM (SELECT item_id, arg_max(chosen, seq) AS chosen FROM fold GROUP BY item_id))
SELECT item_id, doc_id, s AS "start", e AS "end", round(score, 6) AS score, rank FROM final JOIN cand USING (item_id, seq)"""


STEM = """CASE WHEN ends_with(term, 'ies') THEN left(term, -3) || 'y' WHEN ends_with(term, 'es') THEN left(term, -2)
 WHEN ends_with(term, 's') AND NOT ends_with(term, 'ss') THEN left(term, -1) WHEN ends_with(term, 'ing') THEN left(term, -3) WHEN ends_with(term, 'ed') THEN left(term, -2)"""

PASSAGES = """passages AS MATERIALIZED (
  SELECT item_id, doc_id, len(string_split(left(d.text, instr(d.text, b.text) - 1), chr(10))) AS "start",
         len(string_split(left(d.text, instr(d.text, b.text) - 1), chr(10))) + len(string_split(b.text, chr(10))) - 1 AS "end"
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

GRAMS = f"""qg AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(list_slice(t, i, i + n - 1), '_') AS gram FROM (
  SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT item_id, {tokens_sql('text')} AS t FROM benchmark), (VALUES (2), (3)) v(n) WHERE len(t) >= n)),
dg AS MATERIALIZED (SELECT DISTINCT doc_id, n, array_to_string(list_slice(t, i, i + n - 1), '_') AS gram FROM (
  SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (VALUES (2), (3)) v(n) WHERE len(t) >= n)),
phrases AS MATERIALIZED (SELECT item_id, doc_id, count(*) FILTER (n = 2) AS bigrams, count(*) FILTER (n = 3) AS trigrams, CAST(sum(CASE WHEN n = 3 THEN 80 ELSE 60 END) AS DOUBLE) AS score
  FROM dg JOIN qg USING (n, gram) GROUP BY item_id, doc_id)"""

ENGINES = f"""{BM25}, {GRAMS}, {PASSAGES},
counts AS (SELECT item_id, doc_id, count(*) + 5.0 * count(DISTINCT term) AS score FROM p JOIN q USING (term) GROUP BY item_id, doc_id),
scored AS (SELECT 'bm25' AS engine, item_id, doc_id, score FROM bm25 UNION ALL SELECT 'counts', item_id, doc_id, score FROM counts UNION ALL SELECT 'phrases', item_id, doc_id, score FROM phrases),
results AS MATERIALIZED (SELECT * FROM (SELECT engine, item_id, doc_id, row_number() OVER (PARTITION BY engine, item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10),
engines(engine) AS (VALUES ('bm25'), ('counts'), ('phrases')),
em AS MATERIALIZED (
  SELECT e.engine, s.item_id, s.doc_id, x.lang,
         least(10.0, CASE WHEN r.doc_id IS NULL THEN 0 ELSE s."end" - s."start" + 1 END / (s."end" - s."start" + 1) * 10) AS marks
  FROM passages s JOIN documents x USING (doc_id) CROSS JOIN engines e
  LEFT JOIN results r ON r.engine = e.engine AND r.item_id = s.item_id AND r.doc_id = s.doc_id AND r.rank = 1),
by_item AS (SELECT engine, item_id, max(marks) AS marks FROM em GROUP BY engine, item_id)"""

SQL = {
    "bm25_topk": f"WITH {BM25} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm25) WHERE rank <= 5",
    "tokenize_counts": f"WITH {TOKENIZED} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM d",
    "corpus_tf": f"WITH {SPREAD} SELECT term, count(*) AS cf FROM p GROUP BY term",
    "doc_freq_idf": f"WITH {SPREAD}, f AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f, (SELECT count(*) AS n FROM documents)",
    "idf_corpus_tf": f"""WITH {SPREAD}, c AS (SELECT term, count(*) AS cf FROM p GROUP BY term), l AS (SELECT sum(len(string_split(coalesce(text, ''), chr(10)))) AS n FROM documents)
SELECT term, cf, CASE WHEN (n - cf + 0.5) / (cf + 0.5) + 1 > 0 THEN round(ln((n - cf + 0.5) / (cf + 0.5) + 1), 6) END AS idf FROM c, l""",
    "split_identifier": r"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(p_name || '_' || p_type || '.XMLParserId', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS x FROM part),
w AS (SELECT p_partkey, unnest(string_split_regex(lower(translate(x, '_-.', '   ')), '\s+')) AS part FROM s)
SELECT part, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM w WHERE length(part) > 1 GROUP BY part""",
    "suffix_stem_counts": f"""WITH {SPREAD}, c AS (SELECT term, count(*) AS cf FROM p GROUP BY term),
s AS (SELECT 'plain' AS rules, {STEM} ELSE term END AS stem, cf FROM c
 UNION ALL SELECT 'tion', {STEM} WHEN ends_with(term, 'tion') THEN left(term, -4) ELSE term END, cf FROM c
 UNION ALL SELECT 'e', {STEM} WHEN ends_with(term, 'tion') THEN left(term, -4) WHEN ends_with(term, 'e') AND length(term) > 3 THEN left(term, -1) ELSE term END, cf FROM c)
SELECT rules, stem, CAST(sum(cf) AS BIGINT) AS n, count(*) AS terms FROM s GROUP BY rules, stem""",
    "ngram_top": f"""WITH {TOKENIZED}, g AS (SELECT n, array_to_string(list_slice(t, i, i + n - 1), '_') AS gram FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (VALUES (2), (3)) v(n) WHERE len(t) >= n)),
c AS (SELECT n, gram, count(*) AS occurrences FROM g GROUP BY n, gram)
SELECT n, gram, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY occurrences DESC, gram) AS r FROM c) WHERE r <= 100""",
    "phrase_match": f"WITH {TOKENIZED}, {GRAMS} SELECT * FROM phrases",
    "substring_backoff": f"""WITH {SPREAD}, {QUERY_SQL}, words AS (SELECT term AS word, count(*) AS cf FROM p WHERE length(term) >= 4 GROUP BY term), terms AS (SELECT DISTINCT term FROM q WHERE length(term) >= 4)
SELECT term, count(*) AS words, CAST(sum(cf) AS BIGINT) AS occurrences, round(sum(cf * CASE WHEN starts_with(word, term) THEN 0.8 ELSE 0.5 END), 4) AS weight FROM terms JOIN words ON contains(word, term) AND word <> term GROUP BY term""",
    "fuzzy_terms": f"""WITH t AS (SELECT DISTINCT unnest({tokens_sql("concat_ws(' ', p_name, p_type)")}) AS term FROM part), e AS (SELECT DISTINCT unnest({tokens_sql('event_type')}) AS term FROM events), a AS (SELECT term FROM t UNION SELECT term FROM e)
SELECT a.term AS a, b.term AS b, round(jaro_winkler_similarity(a.term, b.term), 6) AS sim FROM a, t b WHERE jaro_winkler_similarity(a.term, b.term) >= 0.80""",
    "line_windows": f'WITH {WINDOWS_SQL} SELECT doc_id, "start", "end" FROM windows',
    "line_hits_word_boundary": lines_top("sum(2 * whole + inside)", 5, ', greatest(1, line_no - 3) AS "start", least(n, line_no + 3) AS "end"', "JOIN (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id) USING (doc_id)"),
    "line_fallback_a": f"""WITH {HITS}, scored AS (SELECT item_id, doc_id, line_no, sum(2.0) * max(CASE WHEN regexp_matches(line, '=|function|class') THEN 1.2 ELSE 1.0 END) AS score FROM hits JOIN lines USING (doc_id, line_no) GROUP BY ALL)
SELECT item_id, rank, doc_id, line_no, round(CAST(score AS DOUBLE), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, line_no) AS rank FROM scored) WHERE rank <= 15""",
    "line_fallback_b": lines_top("sum(CASE WHEN whole > 0 THEN 7 ELSE 2 END)", 15),
    "line_fallback_c": lines_top("sum(CASE WHEN whole > 0 THEN 10 ELSE 3 END)", 15),
    "coverage_score": f"""WITH {COVERAGE} SELECT item_id, rank, doc_id, "start", "end", found, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, "start") AS rank FROM coverage) WHERE rank <= 20""",
    "nms_strict": suppressed("z.s <= c.e AND z.e >= c.s"),
    "nms_raw_padded": suppressed("z.s <= c.e AND z.e >= c.s", 'greatest(1, "start" - 4)', 'least(n, "end" + 4)'),
    "nms_half": suppressed("2 * greatest(0, least(z.e, c.e) - greatest(z.s, c.s) + 1) > c.e - c.s + 1"),
    "pad_to_five": f"""WITH {PASSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM passages)
SELECT b.item_id, k.rank, coalesce(r."start", 1) AS "start", coalesce(r."end", 2) AS "end", CASE WHEN r.rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score
FROM (SELECT DISTINCT item_id FROM benchmark) b CROSS JOIN (SELECT unnest(range(1, 6)) AS rank) k LEFT JOIN r ON r.item_id = b.item_id AND r.rank = k.rank""",
    "proximity_score": f"""WITH {TOKENIZED}, {QUERY_SQL}, places AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM d),
g AS (SELECT item_id, doc_id, CASE WHEN lag(term) OVER w <> term THEN pos - lag(pos) OVER w END AS gap FROM places JOIN q USING (term) WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY pos))
SELECT item_id, doc_id, count(gap) AS pairs, round(greatest(0.0, 1 - avg(gap) / 300) * 0.15, 9) AS score FROM g GROUP BY item_id, doc_id HAVING count(gap) > 0""",
    "window_bm25_norm": f"""WITH {LINES_SQL}, {WINDOWS_SQL}, {QUERY_SQL}, lt AS MATERIALIZED (SELECT doc_id, line_no, {tokens_sql('line')} AS t FROM lines),
u AS MATERIALIZED (SELECT w.doc_id, w."start", w."end", sum(len(t)) AS n FROM windows w JOIN lt ON lt.doc_id = w.doc_id AND line_no BETWEEN w."start" AND w."end" GROUP BY ALL),
lw AS (SELECT doc_id, line_no, unnest(t) AS term FROM lt),
tf AS (SELECT w.doc_id, w."start", w."end", term, count(*) AS tf FROM windows w JOIN lw ON lw.doc_id = w.doc_id AND line_no BETWEEN w."start" AND w."end" WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(n) AS a FROM u),
s AS (SELECT item_id, doc_id, "start", "end", sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * u.n / a))) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN u USING (doc_id, "start", "end"), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, "start") AS rank, greatest(1.0, max(score) OVER (PARTITION BY item_id)) AS most FROM s)
SELECT item_id, rank, doc_id, "start", "end", round(score / most * 0.35, 6) AS score FROM r WHERE rank <= 10""",
    "range_join_lines": f"""WITH {LINES_SQL}, {WINDOWS_SQL}, x AS MATERIALIZED (SELECT doc_id, line_no, length(line) AS chars, len(regexp_extract_all(lower(line), '[a-z0-9_]+')) AS words FROM lines)
SELECT w.doc_id, w."start", w."end", count(*) AS lines, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words FROM windows w JOIN x ON x.doc_id = w.doc_id AND line_no BETWEEN w."start" AND w."end" GROUP BY ALL""",
    "smallest_enclosing": """WITH c AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), s AS (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM c),
b AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT doc_id, s AS bs, least(n, s + z - 1) AS be FROM s, (VALUES (16), (80)) v(z)) WHERE be - bs + 1 >= 5), r AS (SELECT doc_id, s AS "start", least(n, s + 4) AS "end" FROM s WHERE least(n, s + 4) - s + 1 >= 5),
m AS (SELECT r.doc_id, r."start", r."end", bs, be, row_number() OVER (PARTITION BY r.doc_id, r."start", r."end" ORDER BY be - bs, bs) AS k FROM r LEFT JOIN b ON b.doc_id = r.doc_id AND bs <= r."start" AND be >= r."end")
SELECT doc_id, "start", "end", bs AS block_start, be AS block_end FROM m WHERE k = 1""",
    "overlapping_windows": f"""WITH {WINDOWS_SQL}, c AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
o AS (SELECT doc_id, s AS s2, least(n, s + 11) AS e2 FROM (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM c) WHERE least(n, s + 11) - s + 1 >= 5)
SELECT w.doc_id, w."start", w."end", count(*) AS others FROM windows w JOIN o ON o.doc_id = w.doc_id AND s2 <= w."end" AND e2 >= w."start" GROUP BY ALL""",
    "best_subwindow": f"""WITH {LINES_SQL}, h AS (SELECT doc_id, line_no, len(regexp_extract_all(lower(line), '[a-z0-9_]+')) AS hits FROM lines),
t AS (SELECT doc_id, line_no, sum(hits) OVER (PARTITION BY doc_id ORDER BY line_no RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS total FROM h)
SELECT doc_id, line_no AS "start", line_no + 9 AS "end", CAST(total AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, line_no) AS k FROM t) WHERE k = 1""",
    "neighbour_band": f"""WITH {LINES_SQL}, h AS MATERIALIZED (SELECT doc_id, line_no, len(regexp_extract_all(lower(line), '[a-z0-9_]+')) AS hits FROM lines),
s AS (SELECT a.doc_id, a.line_no, sum(b.hits / (1.0 + abs(a.line_no - b.line_no))) AS band FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 3 AND a.line_no + 3 GROUP BY ALL)
SELECT doc_id, line_no, round(band, 6) AS band FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(band, 6) DESC, line_no) AS k FROM s) WHERE k = 1""",
    "marks_by_engine": f"WITH {ENGINES} SELECT engine, item_id, marks FROM by_item",
    "marks_by_category": f"WITH {ENGINES} SELECT coalesce(engine, 'all') AS engine, coalesce(lang, 'all') AS lang, round(avg(marks), 4) AS avg_marks, count(*) AS questions FROM em GROUP BY ROLLUP (engine, lang)",
    "engine_rank": f"WITH {ENGINES} SELECT engine, total, accuracy, rank() OVER (ORDER BY total DESC) AS place FROM (SELECT engine, round(sum(marks), 4) AS total, round(sum(marks) * 10.0 / count(*), 2) AS accuracy FROM by_item GROUP BY engine)",
    "engine_leads": f"WITH {ENGINES}, t AS (SELECT engine, round(sum(marks), 4) AS total FROM by_item GROUP BY engine) SELECT engine, total, round(total - coalesce(lead(total) OVER (ORDER BY total DESC, engine), total), 4) AS lead FROM t",
    "category_pivot": f"WITH {ENGINES} SELECT lang, round(avg(marks) FILTER (engine = 'bm25'), 4) AS bm25, round(avg(marks) FILTER (engine = 'counts'), 4) AS counts, round(avg(marks) FILTER (engine = 'phrases'), 4) AS phrases FROM em GROUP BY lang",
    "hit_at_k": f"""WITH {ENGINES}, f AS (SELECT engine, item_id, min(rank) AS k FROM results JOIN (SELECT DISTINCT item_id, doc_id FROM passages) USING (item_id, doc_id) GROUP BY engine, item_id),
a AS (SELECT engine, item_id, k FROM (SELECT DISTINCT item_id FROM passages) CROSS JOIN engines LEFT JOIN f USING (engine, item_id))
SELECT engine, count(*) AS questions, count(*) FILTER (k <= 1) AS hit_1, count(*) FILTER (k <= 3) AS hit_3, count(*) FILTER (k <= 5) AS hit_5, round(count(*) FILTER (k <= 1) * 100.0 / count(*), 2) AS rate_1, round(count(*) FILTER (k <= 3) * 100.0 / count(*), 2) AS rate_3, round(count(*) FILTER (k <= 5) * 100.0 / count(*), 2) AS rate_5 FROM a GROUP BY engine""",
}
