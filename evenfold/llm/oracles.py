"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

SPACED = "[^\\x20\\x09-\\x0D]+"
PLAIN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = """
WITH t AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
p AS (SELECT c, pos, role, text, string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)) || chr(2), '') OVER (PARTITION BY c ORDER BY pos) AS pre FROM t),
e AS (SELECT c, max(pos) AS n, arg_max(pre, pos) AS whole FROM p GROUP BY c),
inside AS (SELECT DISTINCT p.pre FROM p JOIN e ON p.c = e.c WHERE p.pos < e.n),
kept AS (SELECT min(c) AS c, n FROM e WHERE whole NOT IN (SELECT pre FROM inside) GROUP BY n, whole)
SELECT p.c AS conv_id, kept.n AS n_turns, (pos - 1) // 64 AS part,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS text
FROM p JOIN kept ON p.c = kept.c GROUP BY p.c, kept.n, (pos - 1) // 64
"""

LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM iw),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0)::bigint AS n_hit, coalesce(it.n, 0)::bigint AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

#: crc32 of ``key``, a text of ASCII characters, by the table of its 256 byte remainders.
CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda c: ord(c)::bigint)),
  lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295::bigint)"""
NO_BLANK = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def edited(state: str, cost: str, letter: str) -> str:
    """A cell, written as eight digits of cost and the audit, after one more edit; no cell stays none."""
    return f"(lpad((substr({state}, 1, 8)::int + {cost})::varchar, 8, '0') || substr({state}, 9) || '{letter}')"


def repair_step() -> str:
    """The cells of the four points after a turn x (its initial, then 1 if truncated; 'D' if it must go) and insertions."""
    extra, may = "(3 * (x[1][2] = '1')::int)", "x[1] <> 'D'"
    before_u = "least(a[1], a[2], a[4])"
    def keep(initial: str, state: str) -> str:
        return f"CASE WHEN {may} AND x[1][1] = '{initial}' THEN {edited(state, extra, 'K')} END"
    def turn(state: str) -> str:
        return f"CASE WHEN {may} THEN {edited(state, f'3 + {extra}', 'R')} END"
    t = [edited(f"a[{i}]", "4", "D") for i in range(1, 5)]
    t = [t[0], f"least({t[1]}, {keep('s', 'a[1]')})", f"least({t[2]}, {keep('u', before_u)}, {turn(before_u)})", f"least({t[3]}, {keep('a', 'a[3]')}, {turn('a[3]')})"]
    return f"list_transform([[{', '.join(t)}]], lambda t: {CLOSED})[1]"


CLOSED_U = f"least(t[3], {edited('t[1]', '3', 'I')}, {edited('t[2]', '3', 'I')}, {edited('t[4]', '3', 'I')})"
CLOSED = f"list_transform([{CLOSED_U}], lambda u: [t[1], t[2], u, least(t[4], {edited('u', '3', 'I')})])[1]"

REPAIR = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS kind FROM k, crc),
r AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  {NO_BLANK} AS bare, substr(role, 1, 1) AS i FROM r),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND bare[-1] NOT IN ('.', '!', '?') AS trunc,
  lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM o),
c AS (SELECT conv_id, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  list_prepend(list_transform([['00000000', NULL, NULL, NULL]], lambda t: {CLOSED})[1],
    list([CASE WHEN blank OR dup THEN 'D' ELSE (CASE WHEN i = '' THEN '-' ELSE i END) || (CASE WHEN trunc THEN '1' ELSE '0' END) END] ORDER BY pos)) AS steps FROM f GROUP BY conv_id),
v AS (SELECT * EXCLUDE steps, list_reduce(steps, lambda a, x: {repair_step()}) AS cells FROM c),
b AS (SELECT * EXCLUDE cells, least(cells[1], cells[4]) AS cell FROM v),
l AS (SELECT conv_id, n, letter, sum((letter <> 'I')::int) OVER w AS pos, sum((letter <> 'D')::int) OVER w - 1 AS place FROM
  (SELECT conv_id, unnest(generate_series(1, length(cell) - 8)) AS n, unnest(string_split(substr(cell, 9), '')) AS letter FROM b WHERE length(cell) > 8) WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
p AS (SELECT conv_id, count(*) FILTER (WHERE letter <> 'D') % 2 AS opens FROM l GROUP BY conv_id),
q AS (SELECT l.conv_id, l.n, CASE WHEN letter = 'K' THEN f.role WHEN (place + opens) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
  FROM l JOIN p ON l.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.pos = f.pos WHERE letter <> 'D'),
t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS text FROM q GROUP BY conv_id)
SELECT u.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
  coalesce(illegal, 0)::bigint AS illegal, coalesce(substr(cell, 1, 8)::bigint, 0) AS cost, coalesce(substr(cell, 9), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN b ON u.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON u.conv_id IS NOT DISTINCT FROM t.conv_id
"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SEARCH = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{TERM}') AS t FROM documents),
n AS (SELECT doc_id, len(t)::bigint AS n FROM d WHERE len(t) > 0),
tot AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS terms FROM n),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*)::bigint AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint AS w FROM tf, tot GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), tot GROUP BY ALL)
SELECT item_id, rank::integer AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def either_case(pattern: str) -> str:
    """The pattern with ``(?i:...)`` written as classes: RE2 would also fold letters outside ASCII."""
    head, start, rest = pattern.partition("(?i:")
    inside, end, tail = rest.partition(")")
    return pattern if not start else head + "(?:" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in inside) + end + tail


def secret_spans(rules, base: int) -> str:
    """SQL of the secret scan; ``rules`` are (kind, pattern, least, group), the first ``base`` of them the base ones."""
    parts = []
    for i, r in enumerate(rules):
        p = "'" + either_case(r.pattern).replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {i} AS i, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS s FROM d")
    counts = ", ".join(f"count(*) FILTER (WHERE i = {i}) AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
x AS (SELECT *, unnest(generate_series(1, len(m))) AS j FROM f WHERE len(m) > 0),
y AS (SELECT doc_id, i, kind, (length(array_to_string(s[1:j], '')) + length(array_to_string(m[1:j - 1], '')))::bigint AS a, length(m[j]) AS n FROM x WHERE length(g[j]) >= least),
c AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, i) AS spans, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, i) FILTER (WHERE i < {base}) AS b FROM y GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::bigint AS n_{r.kind}' for r in rules[:base])}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""


def quality_rules(rules, least_group: int, symbols: str) -> str:
    """SQL of the adaptive rules; ``rules`` are (name, upper, reach, spared, low)."""
    counts = {"word_length": ("100", "word_chars", "n_words"), "symbol_rate": ("1000", "n_symbols", "n_words"),
              "dup_line_rate": ("1000", "n_dup_lines", "n_lines"), "repeat_rate": ("1000", "n_repeat_words", "n_words")}

    def rate(name: str, less: int = 0) -> str:
        unit, above, below = counts[name]
        return f"{unit} * greatest({above} - {less}, 0) // greatest({below}, 1)"

    stacked = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {r.upper} AS u, {rate(r.name)} AS v FROM b WHERE NOT base_failed" for r in rules)
    mine = "FROM cut WHERE cut.lang IS NOT DISTINCT FROM b.lang AND cut.source IS NOT DISTINCT FROM b.source AND rule ="
    tests = []
    for r in rules:
        tests.append(f"{rate(r.name, r.spared)} <= (SELECT hi + {r.reach} * greatest(hi - mid, hi // 32 + 1) {mine} '{r.name}')")
        if r.low:
            tests.append(f"{rate(r.name, r.spared)} >= (SELECT lo - {r.reach} * greatest(mid - lo, lo // 32 + 1) {mine} '{r.name}')")

    def levels(keys: str, sketch: str) -> str:
        by = f"PARTITION BY {keys}rule"
        return f"""SELECT {keys}rule, max(t) AS t, {{'lo': min(v) FILTER (WHERE 100 * c >= (100 - u) * t), 'mid': min(v) FILTER (WHERE 100 * c >= 50 * t), 'hi': min(v) FILTER (WHERE 100 * c >= u * t)}} AS s FROM
  (SELECT *, sum(n) OVER ({by} ORDER BY v) AS c, sum(n) OVER ({by}) AS t FROM {sketch}) GROUP BY ALL"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{SPACED}')] AS lines FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d WHERE len(w) > 2)),
often AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + 2)) AS q FROM often) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w)::bigint AS n_words, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
  length(array_to_string(w, ''))::bigint AS word_chars, (length(t) - length(translate(t, '{symbols}', '')))::bigint AS n_symbols, coalesce(rep.n, 0)::bigint AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
st AS ({stacked}),
sk AS (SELECT lang, source, rule, u, v - v % (1::bigint << greatest(length(bin(v)) - 6, 0)) AS v, count(*) AS n FROM st GROUP BY ALL),
q AS ({levels("lang, source, ", "sk")}),
lq AS ({levels("lang, ", "(SELECT lang, rule, u, v, sum(n) AS n FROM sk GROUP BY ALL)")}),
aq AS ({levels("", "(SELECT rule, u, v, sum(n) AS n FROM sk GROUP BY ALL)")}),
cut AS (SELECT lang, source, rule, s.lo AS lo, s.mid AS mid, s.hi AS hi FROM
  (SELECT q.lang, q.source, q.rule, CASE WHEN q.t >= {least_group} THEN q.s WHEN lq.t >= {least_group} THEN lq.s ELSE aq.s END AS s
  FROM q JOIN lq ON q.lang IS NOT DISTINCT FROM lq.lang AND q.rule = lq.rule JOIN aq ON q.rule = aq.rule))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b
"""
