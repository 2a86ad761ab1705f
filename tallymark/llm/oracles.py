"""DuckDB SQL twins of the operators that SQL can express; plain formulations without the operators' shortcuts."""

from __future__ import annotations

from .quality_rules import _VOCABULARY, Rules
from .secret_scan import BASE_DETECTORS, KINDS, MORE_DETECTORS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules(rules: Rules = Rules()) -> str:
    # The character classes, in the operator's order, as patterns of what is not in the class.
    classes = [
        "[^a-z]", "[^A-Z]", "[^0-9]", r"[^ \t]", r"[^\n\r\x0b\x0c]", "[^.,;:]",
        r"""[^!"'()+\-/=?@\[\\\]^_`{}~]""", "[^#*$%&|<>]", r"[\x00-\x7f]", r"[^\x00-\x08\x0e-\x1f\x7f]",
    ]
    hist = ", ".join(f"length(regexp_replace(t, {_sql(c)}, '', 'g'))" for c in classes)
    forms = ", ".join(f"({i}, {_sql(w + tail)})" for i, w in enumerate(_VOCABULARY) for tail in ("", ",", "."))
    other = len(_VOCABULARY)

    def distance(values: str) -> str:
        return f"""
  SELECT p.rid, p.lang, sqrt(greatest(0, sum(
      (CASE WHEN p.a > 0 THEN p.a * log2(p.a / ((p.a + p.b) / 2)) ELSE 0 END
     + CASE WHEN p.b > 0 THEN p.b * log2(p.b / ((p.a + p.b) / 2)) ELSE 0 END) / 2))) AS d
  FROM (SELECT v.rid, r.lang, v.n / v.total AS a, r.n / r.total AS b
        FROM (SELECT *, (sum(n) OVER (PARTITION BY rid))::DOUBLE AS total FROM {values}) v
        JOIN (SELECT lang, k, sum(n) AS n, (sum(sum(n)) OVER (PARTITION BY lang))::DOUBLE AS total
              FROM {values} JOIN doc USING (rid) WHERE lang IS NOT NULL GROUP BY lang, k) r ON v.k = r.k
        WHERE v.total > 0) p GROUP BY p.rid, p.lang"""

    return f"""
WITH doc AS (SELECT row_number() over () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i
         FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM doc)),
gram AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM
  (SELECT rid, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS g,
    lead(word, 4) OVER o AS last_word FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE last_word IS NOT NULL),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM gram, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY rid),
line AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM doc),
dup AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM line
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS chars FROM word GROUP BY rid),
hist AS (SELECT rid, unnest(h) AS n, generate_subscripts(h, 1) AS k FROM (SELECT rid, [{hist}] AS h FROM doc)),
form(k, word) AS (VALUES {forms}),
held AS (SELECT rid, k, count(*) AS n FROM (SELECT rid, translate(word, '{_UPPER}', '{_LOWER}') AS word FROM word) JOIN form USING (word) GROUP BY rid, k),
common AS (SELECT rid, k, n FROM held UNION ALL
           SELECT rid, {other}, n_words - coalesce((SELECT sum(n) FROM held WHERE held.rid = counts.rid), 0) FROM counts),
key AS (SELECT unnest(range({other + 1})) AS k),
whist AS (SELECT doc.rid, key.k, coalesce(common.n, 0) AS n FROM doc CROSS JOIN key LEFT JOIN common ON common.rid = doc.rid AND common.k = key.k),
far_c AS (SELECT rid, min(d) AS d FROM ({distance('hist')}) GROUP BY rid),
far_w AS (SELECT rid, min(d) AS d FROM ({distance('whist')}) GROUP BY rid),
size AS (SELECT rid, sum(n) AS n FROM hist GROUP BY rid),
base AS (SELECT rid, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM doc LEFT JOIN counts USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN repeats USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
  AND NOT (size.n >= {rules.min_chars} AND coalesce(far_c.d, 0) > {rules.max_char_distance})
  AND NOT (n_words >= {rules.min_words_for_distance} AND coalesce(far_w.d, 0) > {rules.max_word_distance}) AS kept
FROM base LEFT JOIN far_c USING (rid) LEFT JOIN far_w USING (rid) LEFT JOIN size USING (rid)
"""


def secret_scan(min_owners: int = 3, min_repos: int = 5) -> str:
    parts = []
    for no, (kind, (pattern, group, least)) in enumerate((BASE_DETECTORS | MORE_DETECTORS).items()):
        value = "m" if group == 0 else f"regexp_extract(m, {_sql(pattern)}, {group})"
        parts.append(f"""SELECT rid, {no} AS no, place - 1 AS start, place - 1 + length(m) AS stop, {value} AS value FROM (
  WITH RECURSIVE step AS (
    SELECT rid, t, ms, 1 AS k, ms[1] AS m, strpos(t, ms[1]) AS place FROM
      (SELECT rid, t, regexp_extract_all(t, {_sql(pattern)}) AS ms FROM doc) WHERE len(ms) > 0
    UNION ALL
    SELECT rid, t, ms, k + 1, ms[k + 1], place + length(m) - 1 + strpos(substr(t, place + length(m)), ms[k + 1])
    FROM step WHERE k < len(ms))
  SELECT * FROM step) WHERE length({value}) >= {least}""")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    n_base = len(BASE_DETECTORS)
    counts = ", ".join(f"coalesce(sum((no = {i})::INT), 0)::BIGINT AS n_{k}" for i, k in enumerate(BASE_DETECTORS))
    listing = "string_agg({names}[no + 1] || ':' || start || ':' || stop, ',' ORDER BY start, no, stop)"
    return f"""
WITH doc AS (SELECT row_number() over () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
span AS ({' UNION ALL '.join(parts)}),
owner AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n,
  count(DISTINCT coalesce('s' || source, '') || chr(10) || coalesce('l' || lang, '')) AS n_repos FROM span JOIN doc USING (rid) GROUP BY value),
live AS (SELECT DISTINCT rid, {len(KINDS) - 1} AS no, stop - length(value) AS start, stop FROM span JOIN owner USING (value)
  WHERE owner.n < {min_owners} AND owner.n_repos < {min_repos} AND length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
every AS (SELECT rid, no, start, stop FROM span UNION ALL SELECT rid, no, start, stop FROM live),
base AS (SELECT rid, {counts}, {listing.format(names=names)} AS s FROM span WHERE no < {n_base} GROUP BY rid),
most AS (SELECT rid, max(n) AS owners, max(n_repos) AS repos FROM span JOIN owner USING (value) GROUP BY rid),
whole AS (SELECT rid, {listing.format(names=names)} AS s, sum((no = {len(KINDS) - 1})::INT) AS n_live FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base.s, '')) AS base_sha256, coalesce(whole.s, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(owners, 0)::BIGINT AS most_owners, coalesce(repos, 0)::BIGINT AS most_repos
FROM doc LEFT JOIN base USING (rid) LEFT JOIN whole USING (rid) LEFT JOIN most USING (rid)
"""
