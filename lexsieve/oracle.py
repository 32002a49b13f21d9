"""DuckDB SQL that screens by joins and windows, to check the engine against.

It shares the constants and the dictionary with the engine, no step of the work.
"""

from __future__ import annotations

from lexsieve.functions import fold
from lexsieve.operators.dictionary import Dictionary
from lexsieve.plans.policy import Category, Policy, ScoreMode


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def cell(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, list):
            return "[" + ", ".join(map(cell, x)) + "]"
        return quoted(x) if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _fold_rows() -> list[tuple]:
    """What is not in a block of separators or silent characters."""
    return [(c, kind, to) for c, (kind, to) in fold.FOLDS.items() if kind >= fold.SOFT]


def _between(blocks: tuple) -> str:
    return " OR ".join(f"unicode(c) BETWEEN {a} AND {b}" for a, b in blocks)


def characters(table: str, key: str, text: str) -> str:
    """CTEs src, ch (one row a character) and k (its kind and fold)."""
    return f"""
src AS (SELECT {key} AS id, {text} AS text FROM {table}),
folds(c, kind, t) AS ({values(_fold_rows())}),
ch AS (SELECT id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS cp FROM src WHERE text <> ''),
k AS (
  SELECT id, cp, c, coalesce(f.kind, CASE WHEN {_between(fold.SILENT_BLOCKS)} THEN {fold.SILENT}
    WHEN {_between(fold.BREAK_BLOCKS)} THEN {fold.BREAK} ELSE {fold.HARD} END) AS kind,
    coalesce(f.t, c) AS t
  FROM ch LEFT JOIN folds f USING (c)
)"""


def streams(table: str, key: str, text: str) -> str:
    """CTEs up to sa (the folded stream) and sb (runs as one, where there are any)."""
    return f"""{characters(table, key, text)},
b AS (SELECT *, sum(CASE WHEN kind = {fold.BREAK} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY cp) AS brk FROM k),
e AS (
  SELECT id, cp, kind, brk, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS part
  FROM b WHERE kind >= {fold.SOFT}
),
sa AS (
  SELECT id, 0 AS s, row_number() OVER o - 1 AS i, c, kind = {fold.HARD} AS hard,
    coalesce(brk <> lag(brk) OVER o, true) AS gap, cp AS a, cp + 1 AS z, 1 AS run
  FROM e WINDOW o AS (PARTITION BY id ORDER BY cp, part)
),
isl AS (
  SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY i) - 1 AS g
  FROM (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS opens FROM sa)
),
sb AS (
  SELECT id, 1 AS s, CAST(g AS BIGINT) AS i, any_value(c) AS c, arg_min(hard, i) AS hard, arg_min(gap, i) AS gap,
    min(a) AS a, max(z) AS z, count(*) AS run
  FROM isl WHERE id IN (SELECT id FROM isl WHERE opens = 0) GROUP BY id, g
)"""


def screening(
    dictionary: Dictionary, policy: Policy, table: str = "documents", key: str = "doc_id", text: str = "text"
) -> str:
    """CTEs up to cand (every occurrence and its reason) and m (the matches); begins with WITH."""
    for text_ in [*dictionary.terms, *map(fold.squeeze, dictionary.terms), *dictionary.allow]:
        # Occurrences are found by splitting, which misses one that overlaps another of the same pattern.
        if any(text_.startswith(text_[k:]) for k in range(1, len(text_))):
            raise ValueError(f"'{text_}' can overlap itself")
    names = [str(c) for c in Category]
    terms = [
        (i, t.text, str(t.category), t.severity, t.word, fold.squeeze(t.text), [n for _, n in fold.runs(t.text)])
        for i, t in enumerate(dictionary.terms.values())
    ]
    chosen = names if policy.categories is None else [str(c) for c in policy.categories]
    in_policy = f"sev >= {policy.min_severity} AND cat IN ({', '.join(map(quoted, chosen)) or 'NULL'})"
    both = "SELECT * FROM sa UNION ALL SELECT * FROM sb" if policy.repeat_tolerance else "SELECT * FROM sa"
    kept = "WHERE last IS NULL OR z > last" if policy.collapse_contained else ""
    return f"""
WITH {streams(table, key, text)},
terms(term_id, term, cat, sev, w, squeezed, runs) AS ({values(terms)}),
allow(word) AS ({values([(w,) for w in sorted(dictionary.allow)] or [(None,)])}),
st AS MATERIALIZED (
  SELECT *, gap OR coalesce(NOT lag(hard) OVER o, true) AS lb,
    coalesce(lead(gap) OVER o OR NOT lead(hard) OVER o, true) AS rb,
    sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER o AS gaps
  FROM ({both}) WINDOW o AS (PARTITION BY id, s ORDER BY i)
),
whole AS (SELECT id, s, string_agg(c, '' ORDER BY i) AS f FROM st GROUP BY id, s),
pat AS (
  SELECT 0 AS s, term_id, term AS p FROM terms WHERE {in_policy}
  UNION ALL SELECT 1, term_id, squeezed FROM terms WHERE {in_policy}
  UNION ALL SELECT 0, -1, word FROM allow WHERE word IS NOT NULL UNION ALL SELECT 1, -1, word FROM allow WHERE word IS NOT NULL
),
cut AS (
  SELECT id, s, term_id, length(p) AS n, list_transform(string_split(f, p), lambda x: length(x)) AS gaps
  FROM whole JOIN pat USING (s) WHERE contains(f, p)
),
hit AS MATERIALIZED (
  SELECT id, s, term_id, n, i0, i0 + n - 1 AS i1
  FROM (SELECT *, CAST(list_sum(gaps[1:q]) + (q - 1) * n AS BIGINT) AS i0 FROM (SELECT *, unnest(range(1, len(gaps))) AS q FROM cut))
),
short AS (
  SELECT r.id, r.term_id, r.i0 FROM (
    SELECT h.id, h.term_id, h.i0, t.runs, unnest(range(h.n)) AS q FROM hit h JOIN terms t USING (term_id) WHERE h.s = 1 AND h.n <> length(t.term)
  ) r JOIN sb ON sb.id = r.id AND sb.i = r.i0 + r.q WHERE sb.run < r.runs[r.q + 1] GROUP BY ALL
),
edges AS MATERIALIZED (
  SELECT st.* FROM st SEMI JOIN (SELECT id, s, i0 AS i FROM hit UNION SELECT id, s, i1 FROM hit) p ON p.id = st.id AND p.s = st.s AND p.i = st.i
),
located AS MATERIALIZED (
  SELECT h.id, h.s, h.term_id, x.a, y.z, x.lb, y.rb, y.gaps > x.gaps AS inner_gap,
    h.s = 1 AND EXISTS (SELECT 1 FROM short q WHERE q.id = h.id AND q.term_id = h.term_id AND q.i0 = h.i0) AS lacks
  FROM hit h JOIN edges x ON x.id = h.id AND x.s = h.s AND x.i = h.i0 JOIN edges y ON y.id = h.id AND y.s = h.s AND y.i = h.i1
),
judged AS MATERIALIZED (
  SELECT l.*, t.sev, t.cat, t.term, CASE
    WHEN lacks THEN 'runs'
    WHEN w AND NOT (lb AND rb) THEN 'edge'
    WHEN NOT w AND inner_gap AND NOT lb THEN 'inner_gap'
    WHEN EXISTS (SELECT 1 FROM located v WHERE v.term_id = -1 AND v.id = l.id AND v.a <= l.a AND v.z >= l.z) THEN 'allowed'
    ELSE 'match' END AS first_reason
  FROM located l JOIN terms t USING (term_id)
),
cand AS (
  SELECT *, CASE WHEN first_reason = 'match' AND s = 1 AND EXISTS (
      SELECT 1 FROM judged v WHERE v.s = 0 AND v.first_reason = 'match' AND v.id = j.id AND v.a < j.z AND v.z > j.a)
    THEN 'preceded' ELSE first_reason END AS reason
  FROM judged j
),
d AS (SELECT DISTINCT id, a, z, term_id, term, cat, sev FROM cand WHERE reason = 'match'),
o AS (
  SELECT *, max(z) OVER (PARTITION BY id ORDER BY a, z DESC, term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM d
),
m AS (SELECT * FROM o {kept})"""


#: Code units of a text's first {n} code points: one more for each beyond U+FFFF.
UNITS = r"{n} + length(regexp_replace(substr(src.text, 1, {n}), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
MATCHES = f"""
SELECT m.id AS doc_id, CAST({UNITS.format(n='a')} AS INTEGER) AS start, CAST({UNITS.format(n='z')} AS INTEGER) AS "end", term, cat,
  CAST(sev AS INTEGER) AS sev, CAST(a AS INTEGER) AS cp_start, CAST(z AS INTEGER) AS cp_end
FROM m JOIN src ON src.id = m.id
"""


def verdicts(policy: Policy) -> str:
    """One row a text: detected and score."""
    score = "max" if policy.score_mode is ScoreMode.MAX else "sum"
    return f"""
SELECT src.id AS doc_id, count(m.id) > 0 AS detected, CAST(coalesce({score}(sev), 0) AS INTEGER) AS score
FROM src LEFT JOIN m ON m.id = src.id GROUP BY src.id
"""


def masked(policy: Policy) -> str:
    """One row a text: the masked text."""
    if policy.mask_token is not None:
        mark = quoted(policy.mask_token)
    else:
        mark = f"repeat({quoted(policy.mask_char)}, CAST(sum(CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END) AS INTEGER))"
    return f""",
isles AS (
  SELECT id, g, min(a) AS a, max(z) AS z FROM (
    SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY a, z DESC, term_id) AS g FROM (
      SELECT *, CASE WHEN a < max(z) OVER (PARTITION BY id ORDER BY a, z DESC, term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS opens FROM m)
  ) GROUP BY id, g
),
pieces AS (
  SELECT ch.id, min(cp) AS cp, {mark} AS piece FROM ch JOIN isles y ON y.id = ch.id AND cp >= a AND cp < z GROUP BY ch.id, g
  UNION ALL
  SELECT id, cp, c FROM ch WHERE NOT EXISTS (SELECT 1 FROM isles y WHERE y.id = ch.id AND cp >= a AND cp < z)
)
SELECT src.id AS doc_id, CASE WHEN src.text = '' THEN '' ELSE string_agg(piece, '' ORDER BY cp) END AS masked
FROM src LEFT JOIN pieces USING (id) GROUP BY src.id, src.text
"""
