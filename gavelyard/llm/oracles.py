"""DuckDB SQL for the queries that SQL expresses."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE [ws[i] || chr(32) || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS ls FROM d),
g AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]] AS five FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS k FROM g) WHERE k > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM again, range(0, 5) t(o) GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered ON covered.rid = w.rid),
m AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup_lines, word_chars / greatest(n_words, 1) AS word_length FROM b),
v AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'word_length', 'n_words', 'n_lines']) AS measure, unnest([symbols, dup_lines, word_length, CAST(n_words AS DOUBLE), CAST(n_lines AS DOUBLE)]) AS value FROM m WHERE n_words > 0),
k AS (SELECT lang, source, measure, CAST(CASE WHEN value <= 0 THEN -1073741824 ELSE ceil(ln(value) / ln(1.02)) END AS INTEGER) AS bucket, count(*) AS n FROM v GROUP BY ALL),
l AS (SELECT 'source' AS level, lang, source, measure, bucket, n FROM k UNION ALL SELECT 'lang', lang, '', measure, bucket, sum(n) FROM k GROUP BY ALL UNION ALL SELECT 'all', '', '', measure, bucket, sum(n) FROM k GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
  CASE WHEN bucket = -1073741824 THEN 0.0 ELSE 2 * pow(1.02, bucket) / 2.02 END AS mid FROM l),
u AS (SELECT level, lang, source, measure, max(total) AS rows, min(mid) FILTER (WHERE upto >= 0.25 * total) AS lo, min(mid) FILTER (WHERE upto >= 0.5 * total) AS md, min(mid) FILTER (WHERE upto >= 0.75 * total) AS hi FROM r GROUP BY ALL),
q AS (SELECT level, lang, source, measure, rows, unnest(['lo', 'mid', 'hi']) AS side, unnest([lo, md, hi]) AS value FROM u),
p AS (SELECT s.lang, s.source, s.measure || '_' || s.side AS name, (s.rows * s.value + 100.0 * ((g.rows * g.value + 100.0 * a.value) / (g.rows + 100.0))) / (s.rows + 100.0) AS value
  FROM q s JOIN q g ON g.level = 'lang' AND g.lang = s.lang AND g.measure = s.measure AND g.side = s.side JOIN q a ON a.level = 'all' AND a.measure = s.measure AND a.side = s.side WHERE s.level = 'source'),
t AS (PIVOT p ON name IN ('symbols_lo', 'symbols_hi', 'dup_lines_lo', 'dup_lines_hi', 'word_length_lo', 'word_length_hi', 'n_words_mid', 'n_lines_mid') USING max(value) GROUP BY lang, source),
z AS (SELECT m.*, symbols_hi + 3 * greatest(symbols_hi - symbols_lo, 1 / greatest(n_words_mid, 1.0)) * sqrt(greatest(n_words_mid / greatest(n_words, 1), 1.0)) AS symbols_high,
  dup_lines_hi + 3 * greatest(dup_lines_hi - dup_lines_lo, 1 / greatest(n_lines_mid, 1.0)) * sqrt(greatest(n_lines_mid / greatest(n_lines, 1), 1.0)) AS dup_lines_high,
  3 * greatest(word_length_hi - word_length_lo, 1 / greatest(n_words_mid, 1.0)) * sqrt(greatest(n_words_mid / greatest(n_words, 1), 1.0)) AS far, word_length_lo, word_length_hi FROM m LEFT JOIN t ON t.lang = m.lang AND t.source = m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(symbols <= symbols_high AND dup_lines <= dup_lines_high AND word_length BETWEEN word_length_lo - far AND word_length_hi + far, true) AS kept,
  round(symbols_high, 6) AS symbols_high, round(dup_lines_high, 6) AS dup_lines_high, round(word_length_lo - far, 6) AS word_length_low, round(word_length_hi + far, 6) AS word_length_high
FROM z"""

OP10 = r"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
e AS (SELECT t.conv_id, perspective, turn, role, text, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
x AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM e),
y AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(rendered)) OVER w - length(rendered) AS BIGINT) AS start FROM x WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, role, rendered, start, start + length(rendered) AS "end", CASE WHEN role = perspective THEN start + length(head) END AS mask_start, CASE WHEN role = perspective THEN start + length(rendered) END AS mask_end FROM y"""

#: crc32 over UTF-8 bytes, with its table made from the polynomial; words one edit apart meet at the same place cut out, or cut to the other word.
OP13 = r"""WITH RECURSIVE crc AS (SELECT [list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END) FOR i IN range(256)] AS tab),
  found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
  runs AS (SELECT w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS named FROM found WHERE length(w) >= 5 GROUP BY doc_id, w),
  hashed AS (SELECT w, n, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS UBIGINT)] ELSE [CAST(195 AS UBIGINT), CAST(128 + unicode(c) % 64 AS UBIGINT)] END FOR c IN string_split(named, '')])),
    lambda c, b: xor(c // 256, tab[CAST(xor(c, b) % 256 AS INT) + 1])), CAST(4294967295 AS UBIGINT)) AS h FROM runs, crc),
  told AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM hashed),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM told WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
  cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
  near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
  best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
  led AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT led.word, led.next, f.form FROM led JOIN forms f ON f.word = led.next)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON l.word = f.word AND l.next IS NULL"""


# -- XXH64 in SQL: all in 128-bit whole numbers, reduced modulo 2**64 -----------------------------------------------
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _u(v):
    return f"{v}::UHUGEINT"


_ALL = _u(2**64)


def _turned(x, r):
    """Bits turned left by r within 64."""
    return f"({x} * {_u(2**r)} % {_ALL} + {x} // {_u(2 ** (64 - r))})"


def _lane(at, size):
    return "(" + " + ".join(f"b[{at} + {k + 1}] * {_u(256**k)}" for k in range(size)) + ")"


def _mixed(x):
    """A lane as it enters the digest: turned and multiplied. `x` is a plain name."""
    return f"({_turned(f'({x} * {_u(P2)} % {_ALL})', 31)} * {_u(P1)} % {_ALL})"


def _accumulator(j, start):
    return (
        f"list_reduce(list_concat([{_u(start % 2**64)}], [{_lane(f'32 * s + {8 * j}', 8)} FOR s IN range(len(b) // 32)]), lambda v, x: "
        f"{_turned(f'((v + x * {_u(P2)}) % {_ALL})', 31)} * {_u(P1)} % {_ALL})"
    )


def _step(size, turn, times, plus, operand):
    return f"{{'k': {operand}, 'up': {_u(2**turn)}, 'down': {_u(2 ** (64 - turn))}, 'times': {_u(times)}, 'plus': {_u(plus)}}}"


_TAIL = "(len(b) // 32) * 32"
_EIGHTS = f"[{_step(8, 27, P1, P4, _mixed('x'))} FOR x IN [{_lane(_TAIL + ' + 8 * s', 8)} FOR s IN range(len(b) % 32 // 8)]]"
_FOURS = f"[{_step(4, 23, P2, P3, f'{_lane('(len(b) // 8) * 8', 4)} * {_u(P1)} % {_ALL}')} FOR s IN range(len(b) % 8 // 4)]"
_ONES = f"[{_step(1, 11, P1, 0, f'b[(len(b) // 4) * 4 + s + 1] * {_u(P5)} % {_ALL}')} FOR s IN range(len(b) % 4)]"
_MERGED = ", ".join(_step(8, 0, P1, P4, _mixed(f"v{j}")) for j in range(4))

#: XXH64 (seed 42) of shingles in whole numbers, bits by majority, links at 3 bits or fewer between distinct fingerprints.
OP12 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
  shingles AS (SELECT doc_id, unnest([array_to_string(l[i:i + 2], ' ') FOR i IN range(1, greatest(2, len(l) - 1))]) AS s FROM w WHERE len(l) > 0),
  coded AS (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM shingles)),
  bytes AS (SELECT s, [CAST((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS UHUGEINT) FOR i IN range(len(x) // 2)] AS b FROM coded),
  long AS (SELECT *, {', '.join(f'{_accumulator(j, start)} AS v{j}' for j, start in enumerate((42 + P1 + P2, 42 + P2, 42, 42 - P1)))} FROM bytes),
  begun AS (SELECT *, CASE WHEN len(b) < 32 THEN [{_u((42 + P5) % 2**64)}] ELSE [({_turned('v0', 1)} + {_turned('v1', 7)} + {_turned('v2', 12)} + {_turned('v3', 18)}) % {_ALL}] END AS h0, CASE WHEN len(b) < 32 THEN [] ELSE [{_MERGED}] END AS first FROM long),
  merged AS (SELECT s, b, (list_reduce(list_concat([{{'h': h0[1], 'p': NULL}}], [{{'h': 0::UHUGEINT, 'p': p}} FOR p IN first]), lambda a, c: {{'h': (xor(a.h, c.p.k) * c.p.times + c.p.plus) % {_ALL}, 'p': c.p}}).h + len(b)::UHUGEINT) % {_ALL} AS h FROM begun),
  ended AS (SELECT s, list_reduce(list_concat([{{'h': h, 'p': NULL}}], [{{'h': 0::UHUGEINT, 'p': p}} FOR p IN list_concat({_EIGHTS}, {_FOURS}, {_ONES})]),
    lambda a, c: {{'h': ((xor(a.h, c.p.k) * c.p.up % {_ALL} + xor(a.h, c.p.k) // c.p.down) * c.p.times + c.p.plus) % {_ALL}, 'p': c.p}}).h AS h FROM merged),
  m1 AS (SELECT s, xor(h, h // {_u(2**33)}) * {_u(P2)} % {_ALL} AS h FROM ended), m2 AS (SELECT s, xor(h, h // {_u(2**29)}) * {_u(P3)} % {_ALL} AS h FROM m1),
  hashed AS (SELECT s, CAST(xor(h, h // {_u(2**32)}) AS UBIGINT) AS h FROM m2),
  bits AS (SELECT doc_id, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE (h >> {k}) & 1 = 1) AS c{k}' for k in range(64))} FROM shingles JOIN hashed USING (s) GROUP BY doc_id),
  signed AS (SELECT doc_id, CAST({' + '.join(f'CASE WHEN 2 * c{k} > n THEN {_u(2**k)} ELSE 0 END' for k in range(64))} AS UBIGINT) AS f FROM bits UNION ALL SELECT doc_id, 0 FROM w WHERE len(l) = 0),
  nodes AS (SELECT f, min(doc_id) AS least FROM signed GROUP BY f),
  links AS (SELECT a.f, b.f AS other FROM nodes a JOIN nodes b ON a.f <> b.f AND bit_count(xor(a.f, b.f)) <= 3),
  reached AS (SELECT f, f AS other FROM nodes UNION SELECT r.f, l.other FROM reached r JOIN links l ON l.f = r.other),
  roots AS (SELECT r.f, min(n.least) AS component_id FROM reached r JOIN nodes n ON n.f = r.other GROUP BY r.f)
SELECT doc_id, lower(lpad(to_hex(f), 16, '0')) AS fingerprint, component_id FROM signed JOIN roots USING (f)"""
