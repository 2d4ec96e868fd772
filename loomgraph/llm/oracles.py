"""DuckDB SQL of the queries that SQL can express, generated from the same parameters."""

from __future__ import annotations

from loomgraph.llm import quality

_SPACE = r"[\x20\x09-\x0D]"


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END)"
    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "shouted_per_word": ratio("n_shouted", "n_words"),
        "stop_words_per_word": ratio("n_stop", "n_words"),
        "letter_words_per_word": ratio("n_letter_words", "n_words"),
        "dup_lines_per_line": ratio("n_dup_lines", "n_lines"),
        "bullet_lines_per_line": ratio("n_bullet", "n_lines"),
        "ellipsis_lines_per_line": ratio("n_ellipsis", "n_lines"),
    }
    fails = []
    for r in quality.RULES:
        bad = [f"{ratios[r.measure]} < {r.low!r}"] * (r.low is not None) + [f"{ratios[r.measure]} > {r.high!r}"] * (r.high is not None)
        fails.append(f"CASE WHEN ({' OR '.join(bad)}) AND n_words >= {r.min_words} THEN '{r.name}' END")
    w = quality.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT doc_id, w, unnest(range(len(w) - {w - 1})) AS i FROM t WHERE len(w) >= {w}),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + {w}), ' ') AS g FROM i),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k.k) AS n_repeat_words FROM r CROSS JOIN (SELECT unnest(range({w})) AS k) k WHERE n > 1 GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
 len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*!!$'))) AS n_shouted,
 len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…){_SPACE}*$'))) AS n_ellipsis FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {", ".join(fails)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
