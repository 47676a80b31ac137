"""DuckDB forms of the operators that SQL can express over whole tables."""

from __future__ import annotations

from paperspark.llm import quality_rules as rules
from paperspark.llm.common import LOWER, UPPER

SPLIT = r"'[ \t\n\x0B\f\r]+'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {SPLIT}), lambda x: x <> '')"


JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 90 * (a.n_shingles + b.n_shingles - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles
"""


def rules_sql() -> str:
    names = list(rules.FLOORS)
    floors = [rules.FLOORS[n] for n in names]
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    without = "length(translate(t, '{}', ''))"
    parts = [f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM d WHERE len(w) >= {rules.WINDOW})),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, sum(least({rules.WINDOW}, coalesce(nxt - i, {rules.WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - {without.format(rules.SYMBOLS)} AS n_symbols, length(t) - {without.format(UPPER)} AS n_upper,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM b),
x AS (SELECT *,
    ln(greatest(word_chars, 1)::DOUBLE / greatest(n_words, 1)) AS x_length,
    ln(1 + 100.0::DOUBLE * n_symbols / greatest(word_chars, 1)) AS x_symbols,
    ln(1 + 100.0::DOUBLE * n_upper / greatest(word_chars, 1)) AS x_upper,
    ln(1 + 100.0::DOUBLE * n_stutters / greatest(n_words, 1)) AS x_stutter,
    ln(1 + 100.0::DOUBLE * n_dup_lines / greatest(n_lines, 1)) AS x_lines,
    ln(1 + 100.0::DOUBLE * n_repeat_words / greatest(n_words, 1)) AS x_repeats FROM c),
ok AS (SELECT * FROM x WHERE NOT base_failed),
mid AS (SELECT lang, source, {", ".join(f"quantile_cont(round({n}, 2), 0.5) AS m_{i}" for i, n in enumerate(names))}
  FROM ok GROUP BY ALL),
e0 AS (SELECT lang, source, {", ".join(f"any_value(m_{i}) AS m_{i}" for i in range(p))},
  {", ".join((f"pow(1.4826 * quantile_cont(round(abs({names[i]} - m_{i}), 2), 0.5), 2) + {floors[i] ** 2!r}" if i == j else "0.0")
             + f" AS c_{i}_{j}" for i, j in pairs)}
  FROM ok JOIN mid USING (lang, source) GROUP BY ALL)"""]

    def distance(k: int) -> str:
        """Cholesky factor of estimate k, then squared distances of ``ok``."""
        out, last = [], f"e{k}"
        for j in range(p):
            less = "".join(f" - l_{j}_{q} * l_{j}_{q}" for q in range(j))
            out.append(f"q{k}_{j}a AS (SELECT *, sqrt(c_{j}_{j}{less}) AS l_{j}_{j} FROM {last})")
            last = f"q{k}_{j}a"
            rows = [f"(c_{i}_{j}{''.join(f' - l_{i}_{q} * l_{j}_{q}' for q in range(j))}) / l_{j}_{j} AS l_{i}_{j}"
                    for i in range(j + 1, p)]
            if rows:
                out.append(f"q{k}_{j}b AS (SELECT *, {', '.join(rows)} FROM {last})")
                last = f"q{k}_{j}b"
        out.append(f"z{k}_0 AS (SELECT ok.*, {last}.* EXCLUDE (lang, source) FROM ok JOIN {last} USING (lang, source))")
        for i in range(p):
            less = "".join(f" - l_{i}_{q} * z_{q}" for q in range(i))
            out.append(f"z{k}_{i + 1} AS (SELECT *, ({names[i]} - m_{i}{less}) / l_{i}_{i} AS z_{i} FROM z{k}_{i})")
        out.append(f"d{k} AS (SELECT *, {' + '.join(f'z_{i} * z_{i}' for i in range(p))} AS d2 FROM z{k}_{p})")
        return ",\n".join(out)

    for k in range(rules.STEPS):
        parts.append(distance(k))
        parts.append(f"""u{k} AS (SELECT *, round(ln(d2 + 1e-6), 2) AS u FROM d{k}),
t{k} AS (SELECT lang, source, quantile_cont(u, {rules.KEEP_SHARE}) AS lim FROM u{k} GROUP BY ALL),
e{k + 1} AS (SELECT lang, source, {", ".join(f"avg({names[i]}) AS m_{i}" for i in range(p))},
  {", ".join(f"{rules.CONSISTENCY} * covar_pop({names[i]}, {names[j]})" + (f" + {floors[i] ** 2!r}" if i == j else "") + f" AS c_{i}_{j}" for i, j in pairs)}
  FROM u{k} JOIN t{k} USING (lang, source) WHERE u <= lim GROUP BY ALL)""")
    parts.append(distance(rules.STEPS))
    return ",\n".join(parts) + f"""
SELECT x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed,
  coalesce(f.d2 <= {rules.CUTOFF}, FALSE) AS kept
FROM x LEFT JOIN d{rules.STEPS} f USING (doc_id)
"""


RULES_SQL = rules_sql()


def codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Codes of vectors of ``parts * width`` components by comparing every
    part with every entry of its codebook."""
    xs = [f"x{j}" for j in range(width)]
    dist = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT a.rid, a.p, min(({dist}) * 256 + b.e) AS best
  FROM parts a JOIN books{r} b ON a.p = b.p GROUP BY a.rid, a.p)""")
        if r < rounds:
            means = ", ".join(f"CAST(floor(CAST(sum({x}) AS DOUBLE) / count(*)) AS BIGINT) AS {x}" for x in xs)
            steps.append(f"""
means{r} AS (
  SELECT n.p, n.best % 256 AS e, {means}
  FROM near{r} n JOIN parts a ON n.rid = a.rid AND n.p = a.p GROUP BY n.p, n.best % 256),
books{r + 1} AS (
  SELECT b.p, b.e, {", ".join(f"coalesce(m.{x}, b.{x}) AS {x}" for x in xs)}
  FROM books{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, p, {", ".join(f"v[p * {width} + {j + 1}] AS x{j}" for j in range(width))}
  FROM kept, (SELECT unnest(range({parts})) AS p)),
books0 AS (SELECT p, rid - 1 AS e, {", ".join(xs)} FROM parts WHERE rid <= {entries}),{",".join(steps)},
codes AS (
  SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code,
    CAST(sum(best // 256) AS BIGINT) AS error
  FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg({" || ',' || ".join(xs)}, ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (rid)
"""


CODES_SQL = codes_sql()

# A row of the state table per conversation, rows read and state, with the
# least (cost, audit); an inserted turn leads to another state of the same row.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(name) + 1),
          lambda i: CAST('0x' || substr(hex(encode(name)), 2 * i - 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM placed),
marked AS MATERIALIZED (
  SELECT conv_id, turn, role, text, n, CASE WHEN ending = '' THEN 'b' WHEN nth > 1 THEN 'd'
      WHEN ending IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM counted),
ids AS (SELECT DISTINCT conv_id FROM conversations),
states AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, q, cost, audit
  FROM ids, (VALUES ('0', CAST(0 AS BIGINT), ''), ('u', 3, 'I'), ('a', 6, 'II')) AS s(q, cost, audit)
  UNION ALL
  (WITH edits AS (
    SELECT s.conv_id, m.n, s.q, s.cost + 4 AS cost, s.audit || 'D' AS audit
    FROM states s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.n + 1
    UNION ALL
    SELECT s.conv_id, m.n, CASE WHEN s.q = 'u' THEN 'a' ELSE 'u' END,
      s.cost + 3 + CASE WHEN fault = 't' THEN 3 ELSE 0 END, s.audit || 'R'
    FROM states s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.n + 1
    WHERE fault NOT IN ('b', 'd')
    UNION ALL
    SELECT s.conv_id, m.n, left(role, 1), s.cost + CASE WHEN fault = 't' THEN 3 ELSE 0 END, s.audit || 'K'
    FROM states s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.n + 1
    WHERE fault NOT IN ('b', 'd') AND s.q || left(role, 1) IN ('0s', '0u', 'su', 'au', 'ua')),
  more AS (
    SELECT * FROM edits
    UNION ALL SELECT conv_id, n, 'u', cost + 3, audit || 'I' FROM edits WHERE q <> 'u'
    UNION ALL SELECT conv_id, n, 'a', cost + 3, audit || 'I' FROM edits WHERE q = 'u'
    UNION ALL SELECT conv_id, n, 'a', cost + 6, audit || 'II' FROM edits WHERE q IN ('0', 's'))
  SELECT conv_id, n, q, min(cost), arg_min(audit, (cost, audit)) FROM more GROUP BY conv_id, n, q)),
lengths AS (
  SELECT conv_id, count(*) AS rows, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (n > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM marked GROUP BY conv_id),
best AS (
  SELECT i.conv_id, coalesce(l.rows, 0) AS rows, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    min(s.cost) AS cost, arg_min(s.audit, (s.cost, s.audit)) AS audit
  FROM ids i LEFT JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM i.conv_id
  JOIN states s ON s.conv_id IS NOT DISTINCT FROM i.conv_id AND s.n = coalesce(l.rows, 0) AND s.q IN ('0', 'a')
  GROUP BY ALL),
-- Edits one by one: the row each takes, and its place among the turns kept.
steps AS (
  SELECT b.conv_id, k, substr(audit, k, 1) AS edit, audit
  FROM best b, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)),
numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS place
  FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
turns AS (
  SELECT t.conv_id, k, edit, place, m.role, m.text,
    count(*) FILTER (edit = 'K' AND left(m.role, 1) = 's') OVER (PARTITION BY t.conv_id) AS heads
  FROM numbered t LEFT JOIN marked m
    ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.n = t.n AND edit <> 'I'
  WHERE edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(
      CASE WHEN edit = 'K' THEN role WHEN (place - heads) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole
  FROM turns GROUP BY conv_id)
SELECT b.conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate,
  CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""
