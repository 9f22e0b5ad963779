"""DuckDB statements that restate the corpus queries that SQL can express."""

from __future__ import annotations

from provena.llm import chat, lexical, mixing, rules

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def mixing_sql(docs: str = "documents", share: float = 1.5, epochs: float = 2.0) -> str:
    return rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size,
         ('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS pos
  FROM {docs}),
src AS (
  SELECT source, source_size, {epochs}::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source)),
tot AS (SELECT {share}::DOUBLE * sum(source_size) AS total FROM src),
level(lvl) AS (
  SELECT total / (SELECT sum(w) FROM src) FROM tot
  UNION
  SELECT (total - coalesce(sum(CASE WHEN lvl * w > cap THEN cap END), 0)) / sum(CASE WHEN NOT lvl * w > cap THEN w END)
  FROM level, src, tot GROUP BY lvl, total HAVING sum(CASE WHEN NOT lvl * w > cap THEN w END) > 0),
plan AS (
  SELECT source, source_size, target, whole, target - whole * source_size AS need
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
        FROM (SELECT source, source_size, least((SELECT max(lvl) FROM level) * w, cap) AS target FROM src))),
run AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.whole, p.need,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.pos, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size AS before
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN need > 0 AND before + size * 0.5::DOUBLE <= need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM run
"""


def _rules_ctes(docs: str) -> str:
    grid = ", ".join(f"({i}, '{r.name}', {c}::DOUBLE)" for i, r in enumerate(rules.RULES) for c in r.cutoffs)
    vals = " UNION ALL ".join(
        f"SELECT rid, doc_id, stratum, base_failed, {i} AS ord, '{r.name}' AS rule, CASE WHEN {r.denominator} > 0 THEN {r.numerator}::DOUBLE / {r.denominator} "
        f"ELSE 0 END AS v FROM stats" for i, r in enumerate(rules.RULES))
    p, n = rules.ALPHA / len(rules.RULES), len(rules.RULES)
    return rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, {WORDS.format("t")} AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g), range(3) r(o)
        WHERE c > 1 GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
stats0 AS (
  SELECT d.rid, doc_id, stratum, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - lines.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats0),
grid(ord, rule, cutoff) AS (VALUES {grid}),
vals AS ({vals}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
seen AS (SELECT stratum, ord, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE v > cutoff) AS k
         FROM vals JOIN good USING (doc_id) JOIN grid USING (ord, rule) WHERE NOT base_failed GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k > n * {p!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
            lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}::DOUBLE) + (n - i) * ln(1 - {p!r}::DOUBLE)))) END AS tail FROM seen),
cuts AS (SELECT stratum, ord, min(cutoff) AS cutoff FROM tails
         WHERE tail <= {rules.DELTA!r}::DOUBLE / ({n} * (SELECT count(DISTINCT stratum) FROM d)) GROUP BY stratum, ord),
failed AS (SELECT rid, arg_min(rule, ord) AS failed_rule FROM vals JOIN cuts USING (stratum, ord) WHERE v > cutoff GROUP BY rid),
judged AS (SELECT s.*, failed_rule, NOT base_failed AND failed_rule IS NULL AS kept FROM stats s LEFT JOIN failed f USING (rid))"""


def rules_sql(docs: str = "documents") -> str:
    return f"""WITH {_rules_ctes(docs)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept, failed_rule FROM judged
"""


def chat_sql(probe: str) -> str:
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def esc(c: str) -> str:
        c = f"replace({c}, {q(chat.ESCAPE)}, {q(chat.ESCAPE * 2)})"
        for s in chat.CONTROL:
            c = f"replace({c}, {q(s)}, {q(s[0] + chat.ESCAPE + s[1:])})"
        return c

    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {q(probe)} UNION ALL SELECT -7, 1, 'assistant', {q(probe)})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({marks} + length({esc("role")}) + length({esc("text")})) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def lexical_sql(docs: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """All scores of all documents, then the best: no lists, no bounds."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')"
    return rf"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS rid, doc_id, {terms} AS w FROM {docs}) WHERE len(w) > 0),
tot AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM {items})),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
gain AS (
  SELECT rid, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT)
                    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * docs) // terms))) AS gain
  FROM tf JOIN df USING (term) JOIN d USING (rid), tot),
scored AS (SELECT item_id, rid, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN gain USING (term) GROUP BY item_id, rid HAVING sum(gain) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN d USING (rid))
WHERE rank <= {k}
"""
