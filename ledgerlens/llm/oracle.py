"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import FLOOR, SKETCH_ERROR, SPREADS, UNITS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

# 1 and 13
def _near_duplicates(size: int) -> str:
    """Distinct word shingles, links by shared shingles, labels spread until they rest."""
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ')
                               ELSE array_to_string(w[i:i + {size - 1}], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, n.n"""


NEAR_DUPLICATES = f"SELECT *, doc_id = component_id AS kept FROM ({_near_duplicates(4)})"
NGRAM_JOIN = _near_duplicates(5)

# 3: inner products in double, all pairs
NEAREST = """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

# 5: digests of the turns as given, and the length of the formatted windows
CHAT = """WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx,
         CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens FROM given),
b AS (SELECT *, idx = 0 AND role = 'system' AS is_system, CASE WHEN idx = 0 AND role = 'system' THEN 0 ELSE tokens END AS body FROM t),
e AS (
  SELECT *, CAST(sum(body) OVER w AS BIGINT) AS past,
         greatest(1, (768 - coalesce(max(CASE WHEN is_system THEN tokens END) OVER w, 0)) // 2) AS half
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
l AS (SELECT *, past - body AS start, body > half AS long FROM e),
s AS (
  SELECT *, coalesce(max(CASE WHEN long THEN past END) OVER (
    PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM l),
k AS (SELECT *, CASE WHEN NOT is_system THEN since || '/' || CASE WHEN long THEN -1 ELSE (start - since) // half END END AS span FROM s),
o AS (SELECT *, NOT is_system AND span IS DISTINCT FROM lag(span) OVER (PARTITION BY conv_id ORDER BY idx) AS opens FROM k),
p AS (
  SELECT *, count(*) FILTER (opens) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 1 FOLLOWING AND 256 FOLLOWING) AS again,
         greatest(1, count(*) FILTER (opens) OVER (PARTITION BY conv_id)) AS windows,
         12 + length(replace(replace(replace(role, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p'), chr(10), chr(92) || 'n'))
         + 1 + length(replace(replace(text, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p')) + 11 AS chars
  FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * CASE WHEN is_system THEN windows ELSE 1 + again END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""

# 6: every window's words, its earliest start, and the words no repeated window covers
SUBSTRINGS = f"""WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1 AS again FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM marked WHERE again),
word AS (SELECT doc_id, w[pos] AS word, pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM w)),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.pos) AS text
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# 8: base counts, quantile sketches by logarithmic bins, fences per language and source
_GAMMA = f"ln({1 + SKETCH_ERROR}::DOUBLE / {1 - SKETCH_ERROR}::DOUBLE)"
_RATIO = f"({1 + SKETCH_ERROR}::DOUBLE / {1 - SKETCH_ERROR}::DOUBLE)"
_FLOOR = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in FLOOR.items())


def _beyond(count: str, measure: str) -> str:
    return f"greatest({count} - {UNITS[measure]}, 0)::DOUBLE"


_SHARES = (_beyond("n_symbols", "symbol_share") + " / greatest(word_chars, 1)", "n_upper::DOUBLE / greatest(word_chars, 1)",
           _beyond("n_marks", "mark_share") + " / greatest(word_chars, 1)",
           _beyond("n_dup_lines", "dup_line_share") + " / greatest(n_lines, 1)",
           _beyond("n_repeat_words", "repeat_share") + " / greatest(n_words, 1)", "word_chars::DOUBLE / greatest(n_words, 1)")
_MEASURES = "[" + ", ".join(f"{{'measure': '{k}', 'value': {v}}}" for k, v in zip(FLOOR, _SHARES)) + "]"


def _fences(name: str, keys: str) -> str:
    group = f"{keys}, measure" if keys else "measure"
    return f"""{name}0 AS (SELECT {group}, bin, sum(n) AS n FROM sketch GROUP BY {group}, bin),
{name}1 AS (
  SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {group}) AS total,
         coalesce(2 * pow({_RATIO}, bin) / ({_RATIO} + 1), 0) AS value,
         coalesce(sum(n) FILTER (bin IS NULL) OVER (PARTITION BY {group}), 0) AS zeros FROM {name}0),
{name}2 AS (
  SELECT {group}, max(total) AS size, max(total - zeros) AS nonzero, min(value) FILTER (upto >= 0.25 * total) AS q25,
         min(value) FILTER (upto >= 0.75 * total) AS q75,
         min(value) FILTER (bin IS NOT NULL AND upto - zeros >= 0.25 * (total - zeros)) AS usual
  FROM {name}1 GROUP BY {group}),
{name} AS (
  SELECT {group}, size, q75 + {SPREADS} * CASE WHEN q75 > 0 THEN q75 - q25 ELSE coalesce(nonzero * usual / size, 0) END
         + CASE measure {_FLOOR} END AS fence FROM {name}2)"""


QUALITY_RULES = rf"""WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
five AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM five) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM again) GROUP BY 1),
m AS (
  SELECT w.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(array_to_string(w, ''), '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         length(regexp_replace(array_to_string(w, ''), '[^!?]+', '', 'g')) AS n_marks
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM w) w
  LEFT JOIN covered USING (r)),
long AS (SELECT r, lang, source, x.measure AS measure, x.value AS value FROM (SELECT *, unnest({_MEASURES}) AS x FROM m)),
sketch AS (
  SELECT lang, source, measure, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {_GAMMA}) AS BIGINT) END AS bin, count(*) AS n
  FROM long GROUP BY ALL),
{_fences('own', 'lang, source')},
{_fences('bylang', 'lang')},
{_fences('overall', '')},
fence AS (
  SELECT own.lang, own.source, own.measure,
         CASE WHEN own.size >= 50 THEN own.fence WHEN bylang.size >= 50 THEN bylang.fence ELSE overall.fence END AS fence
  FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.measure = bylang.measure
  JOIN overall ON own.measure = overall.measure),
broken AS (
  SELECT long.r, list(long.measure) AS rules
  FROM long JOIN fence ON long.lang IS NOT DISTINCT FROM fence.lang AND long.source IS NOT DISTINCT FROM fence.source
    AND long.measure = fence.measure AND long.value > fence.fence GROUP BY 1),
b AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(len(broken.rules), 0) AS n_broken
      FROM m LEFT JOIN broken USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_broken = 0 AS kept, n_broken AS n_broken_rules FROM b"""

# 11: shares and divergences of kept terms, all pairs of a language's sources
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIVERGENCE = f"""WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY 1),
n AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY 1, 2),
lt AS (SELECT lang, sum(total)::HUGEINT AS total FROM gt GROUP BY 1),
p AS (
  SELECT gt.lang, gt.source, kept.term, coalesce(n.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (gt.total + 2 * v.v) AS p
  FROM gt JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN n ON n.lang = gt.lang AND n.source = gt.source AND n.term = kept.term),
q AS (
  SELECT n.lang, n.term, 1 + (1000000000::HUGEINT * (sum(n.n)::HUGEINT + 2)) // (any_value(lt.total) + 2 * any_value(v.v)) AS q
  FROM n JOIN lt USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 10"""

ORACLE = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op3_nearest_neighbours": NEAREST,
    "op5_chat_formatting": CHAT,
    "op6_substring_dedup": SUBSTRINGS,
    "op8_quality_rules": QUALITY_RULES,
    "op11_source_divergence": DIVERGENCE,
    "op13_ngram_jaccard_join": NGRAM_JOIN,
}
