"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from storygauge.llm.license_texts import LICENSES, NOTICES, SPELLINGS

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_duplicates"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""


# --- fixed values, written out here so that a wrong one in the operator shows --------------------------
LONG_LICENSES = (
    ("Apache-2.0", "ed4d0ee78cc123e955c44f930ce77930"),
    ("Artistic-1.0-Perl", "74f1e3cda1403e07ae43420f9f67955a"),
    ("CC0-1.0", "92858801dcc6eb7f6eac73e3a9292b99"),
    ("GFDL-1.2", "5e9e424acea63aff00acfbc560e4eede"),
    ("GFDL-1.3", "d783948c24cf04870467d112fc687824"),
    ("GPL-1.0", "29a20b01260424ac87e15ba1f732eed5"),
    ("GPL-2.0", "d98147d9641afe1b51fd43c885be8da6"),
    ("GPL-3.0", "10b78d4f8fa6382782a227289d64d833"),
    ("LGPL-2.0", "43b4b92842b92066ace36153159f25bc"),
    ("LGPL-2.1", "9ac02a794773f6176c47c73acadf07dd"),
    ("LGPL-3.0", "b6e6f6f56aeefd764d26bc5c57a4f81b"),
    ("MPL-1.1", "63b928d70cda219c2a5f3e4585145dd8"),
    ("MPL-2.0", "91cb597a6809f99333cad35f0bc6f107"),
)
LONG_MARKS = ("gnu", "apache", "mozilla", "artistic", "cc0")
# ------------------------------------------------------------------------------------------------------


def _canonical(text: str) -> str:
    return _words(rf"regexp_replace({text}, '(?im)^[^\p{{L}}\p{{N}}\n]*(?:\(c\)|copyright|©)[^\n]*$', '', 'g')")


def _words(kept: str) -> str:
    out = rf"(' ' || trim(regexp_replace(lower({kept}), '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' ')"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {usual} ')"
    return out


def _known() -> str:
    rows = [(n, t) for n, _, t in LICENSES] + [(n, f"{title}\n\n{t}") for n, title, t in LICENSES] + NOTICES
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in rows)


ORACLES["op4_license_scan"] = f"""
WITH k AS (
  SELECT md5({_canonical("t")}) AS digest, min(n) AS license FROM (VALUES {_known()}) AS v(n, t) GROUP BY 1
), d AS (
  SELECT doc_id, coalesce(text, '') AS body, md5({_canonical("coalesce(text, '')")}) AS digest FROM documents
), l AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d
), m AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, md5({_canonical("line")}) AS digest FROM l WHERE line <> '') JOIN k USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, d.digest, coalesce(CASE WHEN d.digest <> md5('  ') THEN license END, CASE WHEN regexp_matches(lower(body), '{"|".join(LONG_MARKS)}')
  THEN (MAP {{{", ".join(f"'{d}': '{n}'" for n, d in LONG_LICENSES)}}})[md5({_words("body")})] END) AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN m ON m.doc_id = d.doc_id
"""

ORACLES["op5_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || left(md5('20011:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 13) AS BIGINT) AS DOUBLE) + 0.5)
      / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS most,
    greatest(CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(3 * source_size) OVER before AS DOUBLE), 0), 0)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, row_number() OVER (ORDER BY 3 * source_size / weight, weight) AS place
  FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(coalesce((SELECT arg_min(level, place) FROM w WHERE weight * level <= most * (1 + 1e-12)) * weight, most), most) AS target
  FROM w
), z AS (
  SELECT source, size, CAST(count(*) * size AS DOUBLE) AS words, power(CAST(size AS DOUBLE), CAST(0.25 AS DOUBLE)) AS gain
  FROM d WHERE size > 0 GROUP BY source, size
), l AS (
  SELECT z.*, target, greatest(target - coalesce(sum(3 * words) OVER before, 0), 0)
      / (sum(words * gain) OVER (PARTITION BY z.source) - coalesce(sum(words * gain) OVER before, 0)) AS level
  FROM z JOIN t ON t.source IS NOT DISTINCT FROM z.source
  WINDOW before AS (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT source, arg_max(level, size) FILTER (WHERE words * gain * level <= 3 * words * (1 + 1e-12)) AS level FROM l GROUP BY source
), e AS (
  SELECT d.*, source_size, target, CASE WHEN size = 0 THEN 0 ELSE least(coalesce(c.level * power(CAST(size AS DOUBLE), CAST(0.25 AS DOUBLE)), 3), 3) END AS expected
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source
), p AS (
  SELECT *, floor(expected) AS whole, expected - floor(expected) AS pi, target - sum(floor(expected) * size) OVER (PARTITION BY source) AS rest FROM e
), v AS (
  SELECT *, CASE WHEN pi <= 0 THEN 1 ELSE u * (1 - pi) / (u * (1 - pi) + (1 - u) * pi) END AS rank FROM p
), r AS (
  SELECT *, sum(CASE WHEN rank < 1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(size) OVER (PARTITION BY source, rank) AS before, sum(size) OVER (PARTITION BY source, rank) AS same FROM v
)
SELECT doc_id, size, source_size, target, source,
  CAST(whole + CASE WHEN rank < 1 AND before + same / 2 <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST((whole + CASE WHEN rank < 1 AND before + same / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""


def _spans(body: str, kind: str, pattern: str, valid: str) -> str:
    """Spans of one kind: the lengths of the pieces between matches and of the matches add up."""
    found, pieces = f"regexp_extract_all({body}, '{pattern}')", f"string_split_regex({body}, '{pattern}')"
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    start = f"CAST({size(f'{pieces}[:i + 1]')} + {size(f'{found}[:i]')} AS BIGINT)"
    every = f"list_transform(range(len({found})), lambda i: {{'start': {start}, 'value': {found}[i + 1]}})"
    return f"list_transform(list_filter({every}, lambda s: {valid}), lambda s: {{'start': s.start, 'stop': s.start + length(s.value), 'kind': '{kind}', 'value': s.value}})"


_DIGITS = "regexp_replace(s.value, '[^0-9]', '', 'g')"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DOUBLED = f"CAST(reverse({_DIGITS})[k] AS INT) * (2 - k % 2)"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: {_DOUBLED} - CASE WHEN {_DOUBLED} > 9 THEN 9 ELSE 0 END)) % 10 = 0"
_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(s.value, '{_BYTE}(?:\.{_BYTE}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
)
_KIND = "list_position(['email', 'ip', 'card', 'phone', 'term'], kind)"
_TRIM = "regexp_replace({}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
_TERMS = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'), lambda w: lower({_TRIM.format('w')})), lambda w: w <> '')))"

ORACLES["op6_private_data"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
b AS (SELECT row, doc_id, body, unnest(list_concat({', '.join(_spans('body', *k) for k in _BASE[:2])}), recursive := true) FROM d UNION ALL
      SELECT row, doc_id, body, unnest(list_concat({', '.join(_spans('body', *k) for k in _BASE[2:])}), recursive := true) FROM d),
m AS (SELECT DISTINCT row, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(value) END AS entity FROM b),
h AS (SELECT row, {_TERMS} AS terms FROM d),
a AS (SELECT row, list(entity ORDER BY entity) AS entities FROM m GROUP BY row),
g AS (SELECT row, (SELECT count(*) FROM d) AS n, entity, md5(array_to_string(entities, chr(13)) || chr(10) || array_to_string(terms, chr(13))) AS alike
      FROM m JOIN a USING (row) JOIN h USING (row)),
e AS (SELECT entity, any_value(n) AS n, count(*) AS d_e FROM g GROUP BY entity HAVING count(DISTINCT alike) >= 3 AND count(*) < any_value(n)),
w AS (SELECT term, count(*) AS d_t FROM (SELECT unnest(terms) AS term FROM h) GROUP BY term),
p AS (SELECT entity, term, count(*) AS d_et FROM (SELECT entity, alike, unnest(terms) AS term FROM g JOIN h USING (row)) GROUP BY entity, term
      HAVING count(DISTINCT alike) >= 3),
r AS (SELECT entity, term FROM p JOIN w USING (term) JOIN e USING (entity)
      WHERE ln(CAST(n AS DOUBLE) * d_et / (CAST(d_e AS DOUBLE) * d_t)) / ln(CAST(n AS DOUBLE) / d_e) >= 0.8),
f AS (SELECT row, list(DISTINCT term) AS terms FROM m JOIN r USING (entity) GROUP BY row),
o AS (SELECT row, unnest({_spans('body', 'term', '[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]+', f"list_contains(terms, lower({_TRIM.format('s.value')}))")}, recursive := true)
      FROM d JOIN f USING (row)),
t AS (SELECT row, start + length(value) - length(regexp_replace(value, '^[^\\p{{L}}\\p{{N}}]+', '')) AS start,
             start + length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]+$', '')) AS stop, kind FROM o),
s AS (SELECT row, start, stop, kind FROM b UNION ALL
      SELECT row, start, stop, kind FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.row = t.row AND b.start < t.stop AND t.start < b.stop)),
q AS (SELECT row, {', '.join(f"CAST(count_if(kind = '{k}') AS BIGINT) AS n_{k}" for k, *_ in _BASE)},
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {_KIND}) FILTER (WHERE kind <> 'term'), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {_KIND}) AS spans FROM s GROUP BY row)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN q ON q.row = d.row
"""

ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents
), w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(l.v, 0) AS v, coalesce(l.lang_total, 0) AS lang_total, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l ON l.lang = s.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = s.lang AND t.source = s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // (g.total + 5 * g.v) AS p,
    1 + (1000000000 * CAST(k.lang_n + 5 AS HUGEINT)) // (g.lang_total + 5 * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT y.lang, y.source, z.source AS other, sum(abs(y.p - z.p)) AS value
      FROM p y JOIN p z ON z.lang = y.lang AND z.term = y.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def _vector_codes() -> str:
    """Rounds are written out: assign every part (``m`` holds distance and entry in one number), then divide the sums."""
    steps = [r"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM e, range(4) AS r(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS e FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256
)"""]
    for i in range(5):
        steps.append(rf"""a{i} AS MATERIALIZED (
  SELECT vec_id, p.part, any_value(v) AS v, min(256 * CAST(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + entry) AS m
  FROM p JOIN c{i} c ON c.part = p.part GROUP BY vec_id, p.part
)""")
        if i < 4:
            steps.append(rf"""s{i} AS MATERIALIZED (
  SELECT part, m % 256 AS entry, k, CAST(sum(v[k]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) AS k) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(f.e, c.e) AS e FROM c{i} c
  LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS e FROM s{i} GROUP BY ALL) f ON f.part = c.part AND f.entry = c.entry
)""")
    steps.append(r"""o AS (
  SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
FROM o JOIN e USING (vec_id)
""")
    return ", ".join(steps)


ORACLES["op13_vector_codes"] = _vector_codes()

ORACLES["op12_repeated_passages"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(len(h) // 2 - 399)) AS i FROM d)),
s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
n AS (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s)),
p AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM n GROUP BY r, span),
k AS (SELECT p.r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY p.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY p.r ORDER BY a), 0))) AS ahead
  FROM p JOIN d ON d.r = p.r),
o AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(ahead, '' ORDER BY a) AS ahead FROM k GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(ahead, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o ON o.r = d.r
"""
