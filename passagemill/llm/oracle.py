"""SQL twins of the operators that SQL can express whole."""

from __future__ import annotations


def _nibble_table() -> str:
    """The sixteen steps of the reflected CRC-32, by its rule."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return f"({out}::BIGINT[])"


def crc32(text: str) -> str:
    """Unsigned crc32 of a text expression's UTF-8 bytes, four bits at a time."""
    digits = f"list_transform(range(0, len(hex({text}))), lambda i: strpos('0123456789ABCDEF', hex({text})[xor(i, 1) + 1]) - 1)"
    step = f"lambda c, x: xor(c >> 4, {_nibble_table()}[1 + (xor(c, x) & 15)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"
_RUN = "partition by {tree} level, pos // 8 order by pos rows between"


def _tree(name: str, start: str, key: str) -> str:
    """Recursive levels of trees (name) from ``start``, and the siblings of every node (name_steps)."""
    by = f"{key}, " if key else ""
    over = _RUN.format(tree=by)
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT {by}level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY {by}level, pos // 8, n
),
{name}_steps AS (
  SELECT {by}level, pos, coalesce(string_agg(digest, '') OVER ({over} unbounded preceding AND 1 preceding), '') AS l,
    coalesce(string_agg(digest, '') OVER ({over} 1 following AND unbounded following), '') AS r
  FROM {name} WHERE n > 1
)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf,
    sha256({_LEAF} || {_field(f"CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_LOWERED} ELSE text END")}) AS other
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY lang, doc_id, leaf) AS rid,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
),
{_tree("low", "SELECT lang, 0 AS level, rank AS pos, leaf AS digest, n FROM placed", "lang")},
subroots AS (
  SELECT lang, level AS depth, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
),
{_tree("high", "SELECT 0 AS level, pos, digest, n FROM subroots", "")},
fold AS (
  SELECT rid, lang, 0 AS level, rank AS pos, other AS d, '' AS proof FROM placed
  UNION ALL
  SELECT f.rid, f.lang, f.level + 1, f.pos // 8, sha256(s.l || f.d || s.r), f.proof || s.l || s.r
  FROM fold f JOIN low_steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level AND f.pos = s.pos
),
up AS (
  SELECT f.rid, 0 AS level, r.pos, f.d, f.proof
  FROM fold f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang AND f.level = r.depth
  UNION ALL
  SELECT u.rid, u.level + 1, u.pos // 8, sha256(s.l || u.d || s.r), u.proof || s.l || s.r
  FROM up u JOIN high_steps s ON u.level = s.level AND u.pos = s.pos
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(u.proof) AS proof_sha256, u.d AS folded_root, u.d = t.digest AS verified
FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
JOIN (SELECT level, digest FROM high WHERE n = 1) t ON true
JOIN up u ON u.rid = p.rid AND u.level = t.level
"""

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL
),
hashed AS (SELECT run, c, {crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND n >= 2
),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
swaps AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS p FROM places),
cuts AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS p FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM swaps a JOIN swaps b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.p = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.p = b.word
),
best AS (
  SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1
),
forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 10 * n),
chase AS (
  SELECT word, form AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chase c JOIN forms f ON c.root = f.word
)
SELECT w.word, f.form, coalesce(c.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
LEFT JOIN (SELECT word, root FROM chase WHERE root NOT IN (SELECT word FROM forms)) c USING (word)
"""
