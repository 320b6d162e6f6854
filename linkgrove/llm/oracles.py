"""DuckDB SQL for the operators of this package that SQL can express."""

from __future__ import annotations

from linkgrove.llm.quality import METRICS, PRIOR, REACH, UNIT

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def line_dedup() -> str:
    return r"""
WITH l AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), raw AS (
  SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
), worded AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), win AS (
  SELECT doc_id, k, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS r FROM win WHERE body IS NOT NULL
  ) WHERE r > 1
), gone AS (
  SELECT DISTINCT w.doc_id, w.i FROM worded w JOIN later t ON w.doc_id = t.doc_id AND w.k BETWEEN t.k AND t.k + 2
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text FROM raw r ANTI JOIN gone g
  ON r.doc_id = g.doc_id AND r.i = g.i GROUP BY r.doc_id
)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = l.doc_id)::BIGINT AS n_removed,
  CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""


def quality(docs: str = "documents") -> str:
    def value(name: str, spare: bool = False) -> str:
        part, whole, free, _, _ = METRICS[name]
        v = f"(CASE WHEN {whole} > 0 THEN {f'greatest({part} - {free}, 0)' if spare else part} * 1000 // {whole} ELSE 0 END)"
        return f"({v} >> greatest(length(bin({v})) - 6, 0)::INT) << greatest(length(bin({v})) - 6, 0)::INT"

    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {value(m)} AS v FROM p WHERE NOT base_failed" for m in METRICS)
    level = "CASE metric " + " ".join(f"WHEN '{m}' THEN {rule[3]}" for m, rule in METRICS.items()) + " END"
    lows = ", ".join(f"'{m}'" for m, rule in METRICS.items() if rule[4]) or "''"
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{m}' AS metric, {value(m)} AS v, {value(m, True)} AS spare FROM p" for m in METRICS
    )
    parts = ("low", "mid", "high")

    def quant(by: str, name: str) -> str:
        group = f"{by}, " if by else ""
        return f"""{name} AS (
  SELECT {group}metric, max(total) AS total, min(CASE WHEN cum * 100 >= total * (100 - level) THEN v END) * {UNIT} AS low,
    min(CASE WHEN cum * 100 >= total * 50 THEN v END) * {UNIT} AS mid,
    min(CASE WHEN cum * 100 >= total * level THEN v END) * {UNIT} AS high
  FROM (SELECT {group}metric, v, {level} AS level, sum(n) OVER (PARTITION BY {group}metric ORDER BY v) AS cum,
      sum(n) OVER (PARTITION BY {group}metric) AS total
    FROM (SELECT {group}metric, v, sum(n) AS n FROM sk GROUP BY {group}metric, v))
  GROUP BY {group}metric)"""

    def blend(own: str, other: str) -> str:
        return ", ".join(f"({own}.total * {own}.{c} + {PRIOR} * {other}.{c}) // ({own}.total + {PRIOR}) AS {c}" for c in parts)

    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS ws FROM {docs}),
wins AS (
  SELECT doc_id, i, ws[i:i+4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1
), reps AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN reps USING (doc_id)
), base AS (
  SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM m
), p AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base
), sk AS (
  SELECT lang, source, metric, v, count(*) AS n FROM ({long}) GROUP BY ALL
), {quant("lang, source", "own")}, {quant("lang", "lng")}, {quant("", "every")},
lng2 AS (SELECT l.lang, l.metric, {blend("l", "e")} FROM lng l JOIN every e ON l.metric = e.metric),
lim AS (
  SELECT o.lang, o.source, o.metric, {blend("o", "l")}
  FROM own o JOIN lng2 l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric
), beyond AS (
  SELECT v.doc_id, bool_or(v.spare * {UNIT} > f.high + {REACH} * (f.high - f.mid)
    OR (f.metric IN ({lows}) AND v.v * {UNIT} < f.low - {REACH} * (f.mid - f.low))) AS bad
  FROM ({values}) v JOIN lim f
    ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.metric = f.metric
  GROUP BY v.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM p LEFT JOIN beyond USING (doc_id)
"""
