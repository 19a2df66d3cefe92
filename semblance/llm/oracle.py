"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from semblance.llm.license_scan import TEMPLATES, THRESHOLD, template_bigrams
from semblance.llm.line_dedup import WINDOW
from semblance.llm.phrase_mining import LEAST, MOST_WORDS, TOP
from semblance.llm.secret_scan import BASE_RULES, RULES
from semblance.llm.source_mix import HASH_BITS, MOST, WEIGHTS
from semblance.llm.url_filter import RULES as URL_RULES


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
places AS (SELECT doc_id, ls, unnest(range(1, len(ls) - {WINDOW - 2})) AS p FROM lines),
wins AS (SELECT doc_id, p, list_slice(ls, p, p + {WINDOW - 1}) AS w FROM places),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM wins WHERE regexp_matches(array_to_string(w, ''), '[^ \\t\\n\\x0B\\f\\r]')),
gone AS (SELECT doc_id, list(DISTINCT q) AS covered FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM ranked WHERE k > 1) GROUP BY doc_id)
SELECT doc_id, CASE WHEN covered IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(covered, i)), chr(10)) END AS text,
  len(ls) AS n_lines, coalesce(len(covered), 0) AS n_removed
FROM lines LEFT JOIN gone USING (doc_id)
"""

_GRAMS = ", ".join(f"({text(name)}, {i}, [{', '.join(map(text, grams))}])" for i, (name, grams) in enumerate(template_bigrams(TEMPLATES)))
LICENSE_SCAN = f"""
WITH templates(license, t, theirs) AS (VALUES {_GRAMS}),
units AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, 'line' AS kind, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS u FROM documents
  UNION ALL
  SELECT doc_id, unnest(b), 'paragraph', unnest(range(len(b))) FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), lambda x: contains(trim(x), chr(10))) AS b FROM documents)
),
split AS (SELECT doc_id, kind, u, string_split(trim(regexp_replace({LOWER.format('body')}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units WHERE length(body) > 8),
bigrams AS (SELECT doc_id, kind, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM split),
rated AS (SELECT doc_id, kind, u, license, len(list_intersect(g, theirs)) * 2.0::double / (len(g) + len(theirs)) AS dice FROM bigrams, templates WHERE len(g) > 0),
best AS (SELECT doc_id, kind, u, dice, license, row_number() OVER (PARTITION BY doc_id, kind, u ORDER BY dice DESC, license DESC) AS k FROM rated WHERE dice >= {THRESHOLD}),
hits AS (SELECT doc_id, count(*) AS n, max({{'dice': dice, 'license': license}}) AS top, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM best WHERE k = 1 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_hits, top.license AS license, top.dice AS dice, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN hits USING (doc_id)
"""

_BITS = f"('0x' || substr(md5({{}}), 1, {HASH_BITS // 4}))::bigint"
SOURCE_MIX = f"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint AS size FROM documents),
weighted AS (SELECT source, sum(size)::bigint AS source_size, ([{', '.join(map(str, WEIGHTS))}])[((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % {len(WEIGHTS)} + 1] AS weight FROM sizes GROUP BY source),
fill AS (
  SELECT *, sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights, coalesce(sum(source_size) OVER f, 0) AS before, coalesce(sum(weight) OVER f, 0) AS spent
  FROM weighted WINDOW f AS (ORDER BY source_size::double / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT *, (whole - {MOST} * before)::double / (weights - spent)::double AS share FROM fill),
final AS (SELECT arg_min(share, spent) AS share FROM level WHERE share * weight <= ({MOST} * source_size)::double),
goals AS (
  SELECT source, source_size, CASE WHEN whole > 0 THEN least(final.share * weight, ({MOST} * source_size)::double) ELSE 0.0 END::double AS target,
    {_BITS.format("'mix:' || coalesce('s:' || source, 'n')")}::double / {1 << HASH_BITS}::double AS start FROM level, final
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, h, doc_id, size) AS rank
  FROM (SELECT *, floor(log2(size + 1.0::double) * 16)::int AS class, {_BITS.format("coalesce(doc_id::varchar, 'null')")} AS h FROM sizes)
),
joined AS (SELECT doc_id, size, source_size, target, rank, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::double AS rate FROM ranked JOIN goals ON ranked.source IS NOT DISTINCT FROM goals.source),
dealt AS (SELECT *, least(floor(rank * rate + start) - floor((rank - 1) * rate + start), {MOST})::bigint AS copies FROM joined)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM dealt
"""

_HOST = LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = {h + p: (f"((host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)}))", v) for v, h, p in URL_RULES}
_RULES = " ".join(f"WHEN {c} THEN {text(r)}" for r, (c, _) in sorted(_FITS.items(), key=lambda x: -len(x[0])))
_VERDICTS = " ".join(f"WHEN {text(r)} THEN {text(v)}" for r, (_, v) in _FITS.items())
URL_FILTER = f"""
WITH parts AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, string_split(regexp_extract(coalesce(url, ''), '(?s)://[^?#]*\\?([^#]*)', 1), '&') AS fields FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':[0-9]*$', '') || regexp_replace(path, '/$', '') AS place,
    list_sort(list_filter(fields, lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|ref)(=|$)'))) AS kept FROM parts
),
canon AS (SELECT *, place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM named),
listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(url, '^[a-z]+://([^/?#]*\\.)?(spam-farm|cheap-pills)\\.') AND canonical <> ''),
judged AS (SELECT *, canonical IN (SELECT canonical FROM listed) AS listed, CASE {_RULES} END AS rule FROM canon)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, canonical, listed FROM judged
"""


def _spans(place: int, kind: str, regex: str, group: int, least: int) -> str:
    """Spans of one kind; the parts between matches and the matches alternate."""
    r = text(regex)
    return f"""
  SELECT doc_id, {place} AS place, {text(kind)} AS kind, pos AS start, pos + length(m) AS stop FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(bs[1:i], lambda b: length(b))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS pos
    FROM (SELECT doc_id, regexp_extract_all(t, {r}) AS ms, regexp_extract_all(t, {r}, {group}) AS gs, string_split_regex(t, {r}) AS bs FROM texts WHERE regexp_matches(t, {r}))
  ) WHERE length(g) >= {least}"""


_ALL = " UNION ALL ".join(_spans(i, r.kind, r.regex, r.group, r.least) for i, r in enumerate(RULES))
_TOLD = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){}, '')"
SECRET_SCAN = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_ALL}),
told AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = {text(r.kind)}) AS n_{r.kind}" for r in BASE_RULES)},
    {_TOLD.format(f' FILTER (WHERE place < {len(BASE_RULES)})')} AS base, {_TOLD.format('')} AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(told.spans, '') AS spans FROM texts LEFT JOIN told USING (doc_id)
"""

PHRASE_MINING = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS g FROM listed, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g),
totals AS (SELECT lang, sum(f)::bigint AS n FROM counts WHERE m = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= {LEAST}),
candidates AS (SELECT lang, m, g, f AS a, n FROM frequent JOIN totals USING (lang) WHERE m >= 2),
parts AS (SELECT lang, m, g, a, n, unnest(range(1, m)) AS k FROM candidates),
cuts AS (
  SELECT p.lang, p.g, p.a, p.n, p.k, x.f AS l, y.f AS r, ((1000::hugeint * p.a * p.n) // (x.f::hugeint * y.f))::bigint AS score FROM parts p
  JOIN frequent x ON x.lang = p.lang AND x.g = list_slice(p.g, 1, p.k) JOIN frequent y ON y.lang = p.lang AND y.g = list_slice(p.g, p.k + 1, p.m)
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: list_slice(g, i, i + s - 1))))) AS g FROM candidates WHERE m > 2),
held AS (SELECT lang, g, max(a) AS most FROM inner_parts GROUP BY lang, g),
kept AS (SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.g = s.g WHERE h.most IS NULL OR 100 * h.most < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM kept QUALIFY rank <= {TOP}
"""

# crc32 byte by byte; neighbours by equal rests: one word without its letter i is the other, or both without theirs are equal
SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS tab FROM (SELECT unnest(range(256)) AS b)
),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY doc_id, run
),
bytes AS (
  SELECT run, n, list_concat([4294967295::bigint], flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::bigint[] END))) AS b FROM runs
),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
named AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) ELSE run END AS word, n FROM hashed),
vocabulary AS (SELECT word, sum(n)::bigint AS n FROM named WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
rests AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
less AS (SELECT DISTINCT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM rests a JOIN vocabulary b ON a.rest = b.word),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS bn FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM less UNION ALL SELECT b, a, an FROM less
),
best AS (SELECT a AS word, count(*) AS n_near, max(bn) AS most FROM pairs GROUP BY a),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN most END AS form_n, CASE WHEN most >= 2 * v.n THEN (SELECT min(encode(b)) FROM pairs WHERE a = v.word AND bn = most) END AS form
  FROM vocabulary v LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root, decode(form) AS next FROM forms
  UNION ALL SELECT chain.word, chain.next, decode(forms.form) FROM chain JOIN forms ON forms.word = chain.next
)
SELECT f.word, decode(f.form) AS form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

SQL = {
    "op11_phrase_mining": PHRASE_MINING,
    "op13_spelling_variants": SPELLING_VARIANTS,
    "op1_line_dedup": LINE_DEDUP, "op2_license_scan": LICENSE_SCAN, "op3_source_mix": SOURCE_MIX, "op4_url_filter": URL_FILTER, "op5_secret_scan": SECRET_SCAN,
}
