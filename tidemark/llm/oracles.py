"""DuckDB texts for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from tidemark.llm import licenses, quality

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(separator: str, text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separator}'), lambda x: x <> '')"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UP}', '{_LOW}')"


def decontamination(window: int = 10) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_words(_BETWEEN, _lowered("text"))} AS w FROM documents),
b AS (SELECT item_id, {_words(_BETWEEN, _lowered("text"))} AS w FROM benchmark),
c AS (SELECT item_id, w, least({window}, len(w)) AS size FROM b WHERE len(w) > 0),
items AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM c)),
sizes AS (SELECT DISTINCT size FROM items),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
parts AS (
  SELECT a.doc_id, a.p, size, string_agg(z.x, ' ' ORDER BY z.p) AS s, count(*) AS n
  FROM one a, sizes JOIN one z ON true
  WHERE z.doc_id = a.doc_id AND z.p >= a.p AND z.p < a.p + size GROUP BY ALL),
hits AS (SELECT doc_id, p, size, item_id FROM parts JOIN items USING (size, s) WHERE n = size),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM hits, range({window}) t(k) WHERE k < size GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def neardup(shingle: int = 3, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACE, _lowered("text"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS x
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""


def jaccard_join() -> str:
    return f"SELECT doc_id, n_shingles, component_id FROM ({neardup(3, 90)})"


def license_scans(rare: int = 4, agree: float = 0.75) -> str:
    notices, keys = [], []
    for t in licenses.TEMPLATES:
        words, key = t.notice.split(), t.key.split()
        offset = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        notices += [f"({_text(t.label)}, {_text(w)}, {i})" for i, w in enumerate(words)]
        keys.append(f"({_text(t.label)}, {_text(t.key)}, {offset}, {len(key)})")
    phrases = [f"({_text(p)}, {_text(x)}, {len(p.split())})" for p, x in licenses.BASE]
    return f"""
WITH d AS (SELECT doc_id, {_words(_BETWEEN, _lowered("text"))} AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
notice(label, x, place) AS (VALUES {", ".join(notices)}),
key(label, phrase, shift, size) AS (VALUES {", ".join(keys)}),
phrase(text, label, size) AS (VALUES {", ".join(phrases)}),
df AS (SELECT x, count(DISTINCT doc_id) AS df FROM one WHERE x IN (SELECT x FROM notice) GROUP BY x),
anchor AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY coalesce(df, 0), x, place) AS r
    FROM notice LEFT JOIN df USING (x)) WHERE r <= {rare}),
size AS (SELECT label, count(*) AS n FROM anchor GROUP BY label),
votes AS (
  SELECT doc_id, label, p - place AS start, count(*) AS met FROM one JOIN anchor USING (x) GROUP BY ALL),
given AS (
  SELECT doc_id, v.label, max(met / n) AS share
  FROM votes v JOIN size USING (label) JOIN key k USING (label) JOIN d USING (doc_id)
  WHERE met >= greatest(1, ceil({agree} * n)) AND start + shift >= 0
    AND array_to_string(w[start + shift + 1:start + shift + k.size], ' ') = k.phrase GROUP BY ALL),
placed AS (
  SELECT doc_id, p, label FROM one JOIN phrase ON x = split_part(phrase.text, ' ', 1) JOIN d USING (doc_id)
  WHERE array_to_string(w[p + 1:p + phrase.size], ' ') = phrase.text),
base AS (
  SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS names
  FROM placed GROUP BY doc_id),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names
  FROM (SELECT doc_id, label FROM given UNION SELECT doc_id, label FROM placed) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM given GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(base.names, '') AS base_labels, coalesce(labels.names, '') AS labels,
  greatest(coalesce(share, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


def quality_rules() -> str:
    r = quality.Rules()
    only = lambda chars: f"length(regexp_replace(l, '[^{chars}]+', '', 'g'))"
    n, ends = "len(string_split(l, ' '))", ", ".join(map(_text, quality.TERMINAL))
    fails = f"""(({n} < {r.short_line_words} AND right(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ({ends}))
      OR ({n} <= {r.boilerplate_words} AND regexp_matches(lower(l), '{"|".join(quality.BOILERPLATE)}'))
      OR {only(quality.SYMBOLS)} > {r.max_symbols_per_word} * {n} OR {only(quality.SEPARATORS)} >= {r.max_separators}
      OR ({n} >= 3 AND {only("A-Z")} > {r.max_upper_share} * length(l)))"""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_words(_SPACE, "coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
windows AS (
  SELECT doc_id, p, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS s FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, s FROM windows WHERE s IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
again AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM windows JOIN twice USING (doc_id, s), range(3) t(k) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
    length(array_to_string(lines, '')) AS whole,
    length(array_to_string(list_filter(lines, lambda l: NOT {fails}), '')) AS remains
  FROM d LEFT JOIN again USING (doc_id)),
j AS (SELECT *, n_words < {r.min_words} OR n_repeat_words > {r.max_repeated} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND remains >= {1 - r.max_lost} * whole AS kept FROM j"""


def substring_dedup(window: int = 13) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_words(_SPACE, "coalesce(text, '')")} AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d WHERE len(w) >= {window}),
k AS (
  SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS s
  FROM one),
f AS (SELECT s, min(doc_id) AS low FROM k WHERE len(s) = {window} GROUP BY s),
hit AS (SELECT DISTINCT doc_id, p + j AS p FROM k JOIN f USING (s), range({window}) t(j) WHERE low < doc_id),
h AS (SELECT doc_id, list(p) AS gone FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT max(len(x)) // {parts} AS n FROM v),
p AS MATERIALIZED (
  SELECT r, k::INTEGER AS k, x[k * n + 1:(k + 1) * n]::DOUBLE[] AS x FROM v, w, range({parts}) t(k)),
low AS (SELECT vec_id, min(r) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM v GROUP BY vec_id),
b0 AS MATERIALIZED (SELECT k, i, x FROM low JOIN p USING (r) WHERE i < {entries})"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT p.r, p.k, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x)
    + list_inner_product(b.x, b.x))::BIGINT * {entries} + i) AS best
  FROM p JOIN b{t} b ON b.k = p.k GROUP BY ALL)""")
        if t < rounds:
            steps.append(f"""
m{t} AS MATERIALIZED (
  SELECT k, i, list(mean ORDER BY place)::DOUBLE[] AS x FROM (
    SELECT k, i, place, floor(sum(y) / count(*)) AS mean FROM (
      SELECT k, best % {entries} AS i, unnest(x) AS y, generate_subscripts(x, 1) AS place
      FROM a{t} JOIN p USING (r, k)) GROUP BY ALL) GROUP BY ALL),
b{t + 1} AS MATERIALIZED (
  SELECT k, i, coalesce(m{t}.x, b{t}.x) AS x FROM b{t} LEFT JOIN m{t} USING (k, i))""")
    return f"""
WITH {",".join(steps)},
final AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY k) AS code, sum(best // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY r),
books AS (
  SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY k, i, place)) AS sha
  FROM (SELECT k, i, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM final JOIN v USING (r), books"""


ALL = {
    "op4_decontamination": decontamination(),
    "op5_minhash_neardup": neardup(),
    "op6_license_scans": license_scans(),
    "op9_quality_rules": quality_rules(),
    "op10_substring_dedup": substring_dedup(),
    "op12_jaccard_join": jaccard_join(),
    "op13_vector_codes": vector_codes(),
}
